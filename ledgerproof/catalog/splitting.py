"""Page, classification and splitting queries; a conversation is a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.catalog.core import query
from ledgerproof.operators import classify, pages as pg
from ledgerproof.plans import intake


def pages(t):
    return t.conversations.select(
        F.concat(F.lit("C"), "conv_id").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        F.when(F.col("turn") % 4 == 3, "ocr").otherwise("text_layer").alias("text_source"),
        "text",
    )


def answers(t):
    """Page answers: some missing, some given twice, some for unknown pages."""
    n = F.char_length("text")
    kind = F.when(n % 3 == 1, " Letter").when(n % 3 == 2, "").otherwise(" INVOICE ")
    score = F.when(n % 5 == 0, 0.4).when(n % 7 == 0, F.lit(None)).otherwise(0.9)
    base = pages(t).withColumn("n", n)

    def answer(no, page, kind, score):
        return F.struct(
            F.lit(no).alias("answer_no"), page.alias("page_no"), kind.alias("doc_type"),
            score.cast("double").alias("confidence"),
        )

    given = F.array_compact(F.array(
        F.when(n % 11 != 0, answer(1, F.col("page_no"), kind, score)),
        F.when(n % 13 == 0, answer(2, F.col("page_no"), F.lit("invoice"), F.lit(0.8))),
        F.when(n % 13 == 1, answer(3, F.col("page_no") + 1000, F.lit("invoice"), F.lit(0.8))),
    ))
    return base.select("document_id", F.inline(given))


def documents(t):
    """One upload per conversation."""
    return t.conversations.groupBy(F.concat(F.lit("C"), "conv_id").alias("id")).agg(
        F.max("turn").alias("last_turn")
    ).select(
        "id", F.lit("t0").alias("tenant_id"), F.sha2("id", 256).alias("file_hash"),
        F.concat("id", F.lit(".pdf")).alias("filename"),
        F.lit("application/pdf").alias("mime_type"),
        F.concat(F.lit("t0/"), "id").alias("storage_key"),
        F.lit("2024-01-01").cast("date").alias("created_at"),
    )


PAGES_SQL = """
WITH pg AS (
  SELECT 'C' || conv_id AS document_id, CAST(turn + 1 AS INTEGER) AS page_no,
    CASE WHEN turn % 4 = 3 THEN 'ocr' ELSE 'text_layer' END AS text_source, text,
    length(text) AS n
  FROM conversations)
"""
CLASSIFIED_SQL = PAGES_SQL + """,
given AS (
  SELECT document_id, page_no, 1 AS answer_no, CASE n % 3 WHEN 0 THEN 'invoice' ELSE 'other' END AS kind,
    CASE WHEN n % 5 = 0 THEN 0.4e0 WHEN n % 7 = 0 THEN 0e0 ELSE 0.9e0 END AS confidence
  FROM pg WHERE n % 11 <> 0
  UNION ALL
  SELECT document_id, page_no, 2, 'invoice', 0.8e0 FROM pg WHERE n % 13 = 0),
cls AS (
  SELECT pg.document_id, pg.page_no, coalesce(answer_no, 0) AS answer_no,
    CASE WHEN kind = 'invoice' AND confidence >= 0.6e0 THEN 'invoice' ELSE 'unknown' END AS doc_type,
    coalesce(confidence, 0e0) AS confidence
  FROM pg LEFT JOIN given ON given.document_id = pg.document_id AND given.page_no = pg.page_no),
marked AS (
  SELECT *, CASE WHEN lag(doc_type) OVER w IS DISTINCT FROM doc_type AND lag(page_no) OVER w IS NOT NULL
    THEN 1 ELSE 0 END AS change
  FROM cls WINDOW w AS (PARTITION BY document_id ORDER BY page_no, answer_no)),
grouped AS (
  SELECT *, CAST(sum(change) OVER (PARTITION BY document_id ORDER BY page_no, answer_no) AS INTEGER) AS group_no
  FROM marked),
ranges AS (
  SELECT document_id, group_no, min(doc_type) AS doc_type, min(page_no) AS page_start,
    max(page_no) AS page_end, count(*) AS n_pages
  FROM grouped GROUP BY document_id, group_no),
last AS (SELECT document_id, max(group_no) AS last_group FROM ranges GROUP BY document_id),
split AS (
  SELECT CASE WHEN group_no > 0 THEN sha256(r.document_id || ':split' || group_no) ELSE r.document_id END AS id,
    sha256(r.document_id) || CASE WHEN group_no > 0 THEN ':split' || group_no ELSE '' END AS file_hash,
    r.document_id || '.pdf' || CASE WHEN group_no > 0 THEN ' [pages ' || page_start || '-' || page_end || ']'
      ELSE '' END AS filename,
    doc_type, CASE WHEN doc_type = 'invoice' THEN 'classified' ELSE 'needs_review' END AS status,
    CASE WHEN group_no > 0 THEN r.document_id END AS split_from_document_id,
    CASE WHEN last_group > 0 THEN page_start END AS page_start,
    CASE WHEN last_group > 0 THEN page_end END AS page_end
  FROM ranges r JOIN last USING (document_id)),
sp AS (
  SELECT document_id, page_no, text_source FROM pg
  UNION ALL
  SELECT sha256(pg.document_id || ':split' || g.group_no), pg.page_no, pg.text_source
  FROM pg JOIN (SELECT DISTINCT document_id, page_no, group_no FROM grouped WHERE group_no > 0) AS g
    ON g.document_id = pg.document_id AND g.page_no = pg.page_no)
"""


def _grouped(t):
    return classify.page_groups(classify.normalize_answers(pages(t), answers(t)))


def _split(t):
    return intake.split(documents(t), pages(t), answers(t))


@query("doc_page_stats", PAGES_SQL + """
SELECT document_id, count(*) AS page_count, bool_or(text_source = 'ocr') AS used_ocr
FROM pg GROUP BY document_id""")
def doc_page_stats(t):
    return pg.document_stats(pages(t))


@query("text_parts", PAGES_SQL + """
SELECT document_id, page_no,
  '--- Page ' || page_no || ' (' || text_source || ') ---' || chr(10) || text AS part FROM pg""")
def text_parts(t):
    return pg.text_parts(pages(t)).select("document_id", "page_no", "part")


@query("document_text", PAGES_SQL + """
SELECT document_id, string_agg('--- Page ' || page_no || ' (' || text_source || ') ---' || chr(10) || text,
  chr(10) || chr(10) ORDER BY page_no) AS document_text FROM pg GROUP BY document_id""")
def document_text(t):
    return pg.document_text(pages(t))


def long_pages(t):
    """Sixteen conversations bound into one document: far more pages than an upload may have."""
    turns = F.col("conv_id") % 16 * 100 + F.col("turn") + 1
    return t.conversations.select(
        F.concat(F.lit("B"), F.floor(F.col("conv_id") / 16)).alias("document_id"),
        turns.cast("int").alias("page_no"),
        F.when(F.col("turn") % 4 == 3, "ocr").otherwise("text_layer").alias("text_source"), "text",
    )


LONG_SQL = """
WITH pg AS (
  SELECT 'B' || (conv_id // 16) AS document_id, CAST(conv_id % 16 * 100 + turn + 1 AS INTEGER) AS page_no,
    CASE WHEN turn % 4 = 3 THEN 'ocr' ELSE 'text_layer' END AS text_source, text FROM conversations)
"""


@query("long_document_text", LONG_SQL + """
SELECT document_id, count(*) AS n_pages, md5(string_agg(
    '--- Page ' || page_no || ' (' || text_source || ') ---' || chr(10) || text,
    chr(10) || chr(10) ORDER BY page_no)) AS text_md5,
  md5(string_agg('--- Page ' || page_no || ' ---' || chr(10) || left(text, 2000),
    chr(10) || chr(10) ORDER BY page_no)) AS classify_md5
FROM pg GROUP BY document_id""")
def long_document_text(t):
    bound = long_pages(t)
    return (
        pg.document_text(bound)
        .join(pg.classify_input(bound), "document_id")
        .join(pg.document_stats(bound), "document_id")
        .select("document_id", F.col("page_count").alias("n_pages"),
                F.md5("document_text").alias("text_md5"), F.md5("classify_text").alias("classify_md5"))
    )


@query("classify_input", PAGES_SQL + """
SELECT document_id, string_agg('--- Page ' || page_no || ' ---' || chr(10) || left(text, 2000),
  chr(10) || chr(10) ORDER BY page_no) AS classify_text FROM pg GROUP BY document_id""")
def classify_input(t):
    return pg.classify_input(pages(t))


@query("classify_normalize", CLASSIFIED_SQL + """
SELECT document_id, page_no, answer_no, doc_type, confidence FROM cls""")
def classify_normalize(t):
    return classify.normalize_answers(pages(t), answers(t))


@query("page_islands", CLASSIFIED_SQL + "SELECT * FROM ranges")
def page_islands(t):
    return classify.group_ranges(_grouped(t))


@query("split_documents", CLASSIFIED_SQL + "SELECT * FROM split")
def split_documents(t):
    docs, _ = _split(t)
    return docs.select("id", "file_hash", "filename", "doc_type", "status",
                       "split_from_document_id", "page_start", "page_end")


@query("split_pages", CLASSIFIED_SQL + "SELECT * FROM sp")
def split_pages(t):
    _, sp = _split(t)
    return sp.select("document_id", "page_no", "text_source")


@query("split_page_range", CLASSIFIED_SQL + """
SELECT sp.document_id, sp.page_no FROM sp JOIN split ON split.id = sp.document_id
WHERE split.page_start IS NULL OR sp.page_no BETWEEN split.page_start AND split.page_end""")
def split_page_range(t):
    docs, sp = _split(t)
    return pg.own_pages(docs, sp).select("document_id", "page_no")


@query("classify_route", CLASSIFIED_SQL + """
SELECT id AS document_id, 'extract' AS stage, 'queued' AS status FROM split WHERE doc_type = 'invoice'""")
def classify_route(t):
    return classify.extract_work(_split(t)[0])


@query("split_children", CLASSIFIED_SQL + """
SELECT split_from_document_id AS document_id, id AS child_document_id FROM split
WHERE split_from_document_id IS NOT NULL""")
def split_children(t):
    return classify.split_children(_split(t)[0])


@query("text_source_route", r"""
WITH c AS (
  SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '   too short    ' ELSE html END AS layer,
    '  ' || url || chr(10) AS ocr FROM pages),
s AS (SELECT page_id, regexp_replace(layer, '^\s+|\s+$', '', 'g') AS layer, trim(url) AS ocr
  FROM c JOIN pages USING (page_id))
SELECT page_id, CASE WHEN length(layer) >= 20 THEN 'text_layer' ELSE 'ocr' END AS text_source,
  md5(CASE WHEN length(layer) >= 20 THEN layer ELSE ocr END) AS text_md5,
  CASE WHEN length(layer) >= 20 THEN 1 ELSE 0 END AS n_words
FROM s""")
def text_source_route(t):
    word = F.array(F.struct(F.lit("w").alias("text"), F.array(F.lit(0.0)).alias("bbox")))
    candidates = t.pages.select(
        "page_id",
        F.when(F.col("page_id") % 4 == 0, "   too short    ").otherwise(F.col("html"))
        .alias("layer_text"),
        word.alias("layer_words"),
        F.concat(F.lit("  "), "url", F.lit("\n")).alias("ocr_text"),
        F.slice(word, 1, 0).alias("ocr_words"),
    )
    return pg.route_text(candidates).select(
        "page_id", "text_source", F.md5("text").alias("text_md5"), F.size("words").alias("n_words")
    )
