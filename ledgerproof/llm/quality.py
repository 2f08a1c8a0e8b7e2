"""Quality rules by cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed and the distinct documents of a host that hold a line are counted.
Lines above the limits are boilerplate and are removed; a document that loses most of its words
that way is depleted and rejected.

Documents are told apart by their texts, so exact copies count once. Near-copies must not make their
own lines look like boilerplate either. So lines that too many texts hold are candidates first, and
in a second pass the documents with a candidate are told apart by what else they say: the smallest
hash among their lines that are no candidates. Lines that are edits of a candidate don't count for
that: those that have a candidate's first or second half, or stand where other texts have a candidate
between the same two lines. Near-copies say nothing else and count as one document.

Defined cases: a null text has no words or lines and fails the base rules; a null host is a host of
its own; repeated rows each get their row back and count as one document; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import ASCII_SPACE, fresh_folder, table

SYMBOL = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A line is removed when more documents of a host hold it than the larger of `documents` and
    `share` of the host's documents. A document is depleted when less than `left` percent of its
    words stay. Halves of lines are compared from `half` words on. Lists of up to `broadcast` lines, of
    some 40 bytes each, go to all tasks; beyond that they are joined by a shuffle."""

    documents: int = 20
    share: float = 0.002
    left: int = 30
    min_words: int = 50
    repeated: int = 50
    half: int = 3
    broadcast: int = 500_000


DEFAULT = Limits()


def normalised(text: Column) -> Column:
    """Lower case, white space within lines as one space."""
    return F.regexp_replace(F.lower(text), "[\\x20\\x09\\x0B-\\x0D]+", " ")


def words_of(text: Column) -> Column:
    """The words in order."""
    plain = F.regexp_replace(text, "[\\x09-\\x0D]", " ")
    return F.array_remove(F.split(plain, " "), "")


def window_hashes(words: Column) -> Column:
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )


def sorted_windows(hashes: Column) -> Column:
    """The 3-word windows as `(h, i)`, sorted by hash and then place; none if all differ, as in most
    texts."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")
    )


def repeated(windows: Column) -> Column:
    """The sorted places of windows that stand twice or more: those with an equal neighbour."""
    def equal(a, b):
        return F.coalesce(F.get(windows, a)["h"] == F.get(windows, b)["h"], F.lit(False))

    return F.sort_array(F.transform(
        F.filter(windows, lambda w, k: equal(k, k - 1) | equal(k, k + 1)), lambda w: w["i"]
    ))


def covered(places: Column) -> Column:
    """Words covered by 3-word windows at sorted places: each window adds its distance to the next
    one, three at most."""
    steps = F.transform(places, lambda p, k: F.least(
        F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))
    ))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def hash60(text: Column) -> Column:
    """The first 60 bits of a digest, as a positive number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def line_entry(line: Column, place: Column, limits: Limits) -> Column:
    """A line's place, hash and words, and keys of its first and second half."""
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    first = F.floor(n / 2).cast("int")

    def half(name, count):
        words = F.call_function("substring_index", line, F.lit(" "), count)
        return F.when(n >= 2 * limits.half, F.xxhash64(F.lit(name), words))

    return F.struct(
        place.alias("place"), hash60(line).alias("h"), n.cast("int").alias("words"),
        half("first", first).alias("first"), half("second", first - n.cast("int")).alias("second"),
    )


def measured(docs: DataFrame, doc_id: str, text: str, host: str, limits: Limits) -> DataFrame:
    """One row per document: the base counts, arrays that describe its lines in order, and `host`
    without nulls."""
    blank = F.lit(ASCII_SPACE)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    ).withColumns({
        "w": words_of(F.col("t")),
        "raw": F.filter(F.split("t", "\n"), lambda line: F.btrim(line, blank) != ""),
        "plain": F.transform(F.split(normalised(F.col("t")), "\n"), lambda line: F.trim(line)),
    }).select(
        "doc_id", "host", "w",
        (F.size(F.split("t", SYMBOL, -1)) - 1).cast("long").alias("n_symbols"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.filter(
            F.transform("plain", lambda line, k: F.when(line != "", line_entry(line, k, limits))),
            lambda entry: entry.isNotNull(),
        ).alias("lines"),
        hash60(F.col("t")).alias("digest"),
    ).withColumn("hashes", window_hashes(F.col("w"))).withColumns({
        "n_words": F.size("w").cast("long"), "windows": sorted_windows(F.col("hashes")),
    }).drop("w", "hashes").withColumn("places", repeated(F.col("windows"))).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered(F.col("places")).alias("n_repeat_words"), "lines", "digest",
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a compressed table in the shared folder."""
    path = fresh_folder(df.sparkSession, f"quality-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, limits: Limits) -> DataFrame:
    """A written list, marked to go to all tasks if its size is checked to be small."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= limits.broadcast else table


def above(counted: DataFrame, hosts: DataFrame, limits: Limits) -> DataFrame:
    """The lines whose `n` documents are more than the limits of their host: `host, h`."""
    return counted.where(F.col("n") > limits.documents).join(hosts, "host").where(
        F.col("n") > F.col("host_documents") * limits.share
    ).select("host", "h")


def lines_of(measures: DataFrame) -> DataFrame:
    """One row per line: `row, host, digest`, the line's fields, and `context`, a key of the lines
    before and after it."""
    fields = ["place", "h", "words", "first", "second"]
    around = F.transform("h", lambda h, k: F.xxhash64(
        F.lit("between"), F.get("h", k - 1), F.get("h", k + 1)
    )).alias("context")
    return measures.select("row", "host", "digest", *fields, around).select(
        "row", "host", "digest", F.explode(F.arrays_zip(*fields, "context")).alias("x")
    ).select("row", "host", "digest", "x.*")


def own_lines(flagged: DataFrame, frequent: DataFrame, limits: Limits) -> DataFrame:
    """`row, own`: the smallest hash among a document's lines that are neither candidates nor edits of
    one. Documents without such a line are absent."""
    halves = frequent.select("host", F.explode(F.array("first", "second")).alias("key")).where(
        F.col("key").isNotNull()
    )
    contexts = frequent.select("host", F.col("context").alias("key"), "digest").distinct().groupBy(
        "host", "key"
    ).agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    known = sized(halves.unionByName(contexts).distinct(), "edits", limits)
    other = flagged.where(F.col("frequent").isNull()).select(
        "row", "host", "h", "first", "second", "context"
    )
    for key in ("first", "second", "context"):
        other = other.join(known.withColumnRenamed("key", key), ["host", key], "left_anti")
    return other.groupBy("row").agg(F.min("h").alias("own"))


def judged(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    limits: Limits = DEFAULT, row: str | None = None,
) -> DataFrame:
    """The verdict on every document: `row, doc_id`, the counts, `n_removed_words, removed` (the
    places of the lines to remove), `base_failed, depleted, kept`.

    `row` names a column that tells rows apart; else they are numbered.
    """
    key = F.monotonically_increasing_id() if row is None else F.col(row)
    keyed = docs.select(
        F.struct(F.col(doc_id).alias("id"), key.alias("row")).alias("both"),
        F.col(text).alias("text"), F.col(host).alias("host"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measures = written(measured(keyed, "both", "text", "host", limits).select(
        F.col("doc_id.row").alias("row"), F.col("doc_id.id").alias("doc_id"), "host", "digest",
        *counts, "lines.place", "lines.h", "lines.words", "lines.first", "lines.second",
    ), "measures")
    hosts = measures.groupBy("host").agg(F.count("*").alias("host_documents"))
    texts = measures.select(
        "host", "digest", F.explode(F.array_distinct("h")).alias("h")
    ).distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    candidates = sized(above(texts, hosts, limits), "candidates", limits)
    flagged = lines_of(measures).join(
        candidates.withColumn("frequent", F.lit(True)), ["host", "h"], "left"
    )
    frequent = written(flagged.where("frequent"), "frequent")
    hits = frequent.join(own_lines(flagged, frequent, limits), "row", "left").select(
        "row", "host", F.coalesce("own", F.lit(-1)).alias("own"), "h", "place", "words"
    )
    counted = hits.select("host", "h", "own").distinct().groupBy("host", "h").agg(
        F.count("*").alias("n")
    )
    removed = frequent.join(
        sized(above(counted, hosts, limits), "removed", limits), ["host", "h"]
    ).groupBy("row").agg(
        F.sum("words").alias("n_removed_words"), F.collect_list("place").alias("removed")
    )
    return measures.select("row", "doc_id", *counts).join(removed, "row", "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long"))
    ).withColumns({
        "base_failed": (F.col("n_words") < limits.min_words)
        | (100 * F.col("n_repeat_words") > limits.repeated * F.col("n_words")),
        "depleted": 100 * (F.col("n_words") - F.col("n_removed_words"))
        < limits.left * F.col("n_words"),
    }).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def quality_rules(docs: DataFrame, limits: Limits = DEFAULT, **columns: str) -> DataFrame:
    """The verdict on every document; see `judged`."""
    return judged(docs, limits=limits, **columns)


def unused(columns: list[str], name: str) -> str:
    """A column name that isn't taken."""
    while name in columns:
        name += "_"
    return name


def cleaned(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    limits: Limits = DEFAULT,
) -> DataFrame:
    """The kept documents without the removed lines, `n_chars` counted anew where there is one.

    Rows are told apart by a key of their own, written with them, since ids may be null or repeated.
    """
    spark, key = docs.sparkSession, unused(docs.columns, "row_key")
    gone, kept = unused(docs.columns, "removed_lines"), unused(docs.columns, "kept_row")
    path = fresh_folder(spark, "quality-keyed")
    docs.withColumn(key, F.monotonically_increasing_id()).write.option(
        "compression", "zstd"
    ).parquet(path)
    keyed = spark.read.parquet(path)
    changes = judged(keyed, doc_id, text, host, limits, row=key).where(
        ~F.col("kept") | F.col("removed").isNotNull()
    ).select(F.col("row").alias(key), F.col("removed").alias(gone), F.col("kept").alias(kept))
    rows = keyed.join(changes, key, "left").where(F.coalesce(kept, F.lit(True)))
    left = F.array_join(F.filter(
        F.split(F.col(text), "\n"), lambda line, k: ~F.array_contains(F.col(gone), k)
    ), "\n")
    out = rows.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_words",
    )


SQL = {"op4_line_frequency": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT row, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM win), range(3) r(k)
  WHERE n >= 2 GROUP BY row
), raw AS (
  SELECT row, host, t, i, line FROM (
    SELECT row, coalesce('=' || host, '') AS host, t, unnest(string_split(t, chr(10))) AS line,
      generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d
  ) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw GROUP BY row
), norm AS (
  SELECT row, host, t, i, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM raw
), h AS (
  SELECT row, host, t, i, line, left(md5(line), 15) AS h, string_split(line, ' ') AS ws,
    lag(line) OVER w AS line_before, lead(line) OVER w AS line_after
  FROM norm WINDOW w AS (PARTITION BY row ORDER BY i)
), keyed AS (
  SELECT *, len(ws) AS words,
    CASE WHEN len(ws) >= 6 THEN '1 ' || array_to_string(ws[1:len(ws) // 2], ' ') END AS first,
    CASE WHEN len(ws) >= 6 THEN '2 ' || array_to_string(ws[len(ws) // 2 + 1:], ' ') END AS second,
    '3 ' || coalesce(md5(line_before), '') || ' ' || coalesce(md5(line_after), '') AS context
  FROM h
), hosts AS (
  SELECT coalesce('=' || host, '') AS host, count(*) AS docs FROM d GROUP BY 1
), candidates AS (
  SELECT host, line FROM (
    SELECT host, line, count(DISTINCT t) AS n FROM keyed GROUP BY host, line
  ) JOIN hosts USING (host) WHERE n > 20 AND n > docs * 0.002
), flagged AS (
  SELECT k.*, c.line IS NOT NULL AS frequent,
    bool_or(c.line IS NOT NULL) OVER (PARTITION BY k.row) AS touched
  FROM keyed k LEFT JOIN candidates c ON k.host = c.host AND k.line = c.line
), known AS (
  SELECT host, first AS key FROM flagged WHERE frequent AND first IS NOT NULL
  UNION SELECT host, second FROM flagged WHERE frequent AND second IS NOT NULL
  UNION SELECT host, context FROM flagged WHERE frequent GROUP BY host, context
    HAVING count(DISTINCT t) > 1
), owns AS (
  SELECT row, min(h) AS own FROM flagged f WHERE touched AND NOT frequent AND NOT EXISTS (
    SELECT 1 FROM known k WHERE k.host = f.host AND k.key IN (f.first, f.second, f.context)
  ) GROUP BY row
), frequent AS (
  SELECT host, line FROM (
    SELECT host, line, count(DISTINCT coalesce(own, '')) AS n
    FROM flagged LEFT JOIN owns USING (row) WHERE frequent GROUP BY host, line
  ) JOIN hosts USING (host) WHERE n > 20 AND n > docs * 0.002
), gone AS (
  SELECT row, sum(words) AS n_removed_words FROM keyed JOIN frequent USING (host, line) GROUP BY row
), m AS (
  SELECT d.doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_words, 0) AS n_removed_words
  FROM d JOIN w USING (row) LEFT JOIN rep USING (row) LEFT JOIN dup USING (row)
  LEFT JOIN gone USING (row)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_removed_words::BIGINT AS n_removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept
FROM m
"""}

QUERIES = {"op4_line_frequency": op4_line_frequency}
