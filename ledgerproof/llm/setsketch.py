"""Near-duplicate detection with SetSketch registers.

A document is the set of its word shingles. Its sketch has registers that hold the truncated,
exponentially spaced minimum of exponential draws over the set: two sketches merge by maximum, and
equal registers are as likely as the sets are similar. Bands of registers give candidates, the joint
likelihood of two sketches (whose cardinalities are known) drops those that can't be similar enough,
and the rest is confirmed on the full sets.

Documents with equal sets are one class and are compared once. Within a bucket, members are compared
with a leader instead of with each other: first the member that shares most buckets with others. Then
buckets that still hold several components form clusters around the largest of them, and members
outside it lead in turn, until every bucket holds one component or every pair in it has been looked
at. So a large group of copies costs about one comparison per member, and no link between two
components is left out. Links are folded into components by alternating stars.

Chances: documents of similarity 0.8 share no band with probability 5e-8, and the likelihood test
drops such a pair with probability below 1e-5.

Defined cases: texts without words, null texts included, have an empty set and are linked with
nothing; a text with fewer words than a shingle is one shingle; rows that share an id but not a text
are told apart by their sets; a null id joins its component but does not name it, and a component of
null ids has a null id; repeated rows get their row back each; an empty table gives an empty result;
other columns are ignored. With a row key exactly one row of each component is kept, whatever its id.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerproof.llm.common import (
    dropping_shuffles,
    fresh_folder,
    staged,
    staged_round,
    table,
    with_python,
)

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    """Two documents are linked from `percent` similarity on. Sketches have `registers` (a power of
    two) of base `base`, in bands of `rows`. A pair is dropped when its likelihood at any similarity
    from `percent` on is less than exp(-`doubt`) of the best. `leaders` members of a cluster are
    compared per round, of `leader_size` shingles in all, with about `block` members per task."""

    words: int = 5
    percent: int = 80
    registers: int = 128
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    doubt: float = 12.0
    leaders: int = 1024
    leader_size: int = 2_000_000
    block: int = 1024


DEFAULT = Options()


# Sets and sketches


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text."""
    # bytes.lower and bytes.split know ASCII only, which is what a word is defined by.
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    # A short text is one shingle of its own length, unlike any of the full length.
    out = np.full(len(tokens) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * GOLDEN + each[k:k + len(out)])
    return np.unique(out)


def sketches(sets: list[np.ndarray], options: Options = DEFAULT) -> np.ndarray:
    """The registers of each set, as a row of 16-bit numbers.

    An element visits random registers at the times of a Poisson process, which gives every register
    an exponential draw per element. It stops when it is later than the largest minimum of its set,
    so a set costs its size and a constant, not their product.
    """
    m = options.registers
    lowest = np.full((len(sets), m), np.inf)
    flat = lowest.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    state = np.concatenate(sets) if len(owner) else np.empty(0, np.uint64)
    time = np.zeros(len(state))
    while len(state):
        state = state + GOLDEN
        drawn = mixed(state)
        time = time - np.log1p(-(drawn >> np.uint64(11)).astype(np.float64) / 2**53) / (
            m * options.rate
        )
        # The low bits choose the register, those above 11 the time: they are independent.
        at = owner * m + (drawn & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(flat, at, time)
        going = time < lowest.max(axis=1)[owner]
        state, owner, time = state[going], owner[going], time[going]
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(lowest) / np.log(options.base))
    return np.clip(values, 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def plausible(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, options: Options = DEFAULT
) -> np.ndarray:
    """Which pairs of sketches (rows of `a` and `b`) may reach the similarity.

    By joint likelihood: with known sizes, a register of the first set is the larger one, the
    smaller one or an equal one with chances that depend on the similarity only.
    """
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    fits = 100 * low >= options.percent * high
    more = (a > b).sum(axis=1)[:, None]
    less = (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    limit = np.minimum(u / v, v / u)
    wanted = options.percent / 100

    def best(lowest, highest):
        j = lowest + (highest - lowest) * np.linspace(0, 1, 33)
        first, second = chance(u - v * j, options.base), chance(v - u * j, options.base)
        total = np.zeros(j.shape)
        for n, p in ((more, first), (less, second), (same, 1 - first - second)):
            total += np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0.0)
        return total.max(axis=1)

    alike = best(np.minimum(wanted, limit), limit)
    return fits & (alike >= best(np.zeros_like(limit), limit) - options.doubt)


def chance(x: np.ndarray, base: float) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)


def linked(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets reach the similarity with set `a`, exactly."""
    if not others:
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in others])
    ends = np.cumsum(sizes)
    found = np.concatenate(([0], np.cumsum(np.isin(np.concatenate(others), a))))
    common = found[ends] - found[ends - sizes]
    return 100 * common >= percent * (len(a) + sizes - common)


# Spark


def sketched(docs: DataFrame, text: str, into: str, options: Options) -> DataFrame:
    """`docs` with `n, digest, registers` of each text in the struct `into`."""

    def compute(texts):
        sets = [shingles(t, options.words) for t in texts]
        rows = sketches(sets, options)
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                     pa.binary()),
            pa.array([r.tobytes() for r in rows], pa.binary()),
        ]

    return with_python(docs, text, into, "n long, digest binary, registers binary", compute)


def components(links: DataFrame) -> DataFrame:
    """`node, component` of every node of the links `a, b`: the smallest node that can be reached.

    Each round a node takes the smallest label around it and then the label of that label, so the
    rounds grow with the logarithm of the longest way.
    """
    there = links.where("a <> b").select("a", "b")
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = staged(there.unionByName(back).distinct().repartition("b"))
    labels = staged_round(edges.groupBy(F.col("b").alias("node")).agg(
        F.least("b", F.min("a")).alias("component")
    ))
    before = None
    while True:
        near = edges.join(labels, edges.b == labels.node).select(
            F.col("a").alias("node"), "component"
        )
        best = labels.unionByName(near).groupBy("node").agg(F.min("component").alias("component"))
        up = best.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = staged_round(
            best.join(up, "component").select("node", F.col("next").alias("component"))
        )
        now = labels.agg(F.count("*"), F.sum(F.col("component").cast("decimal(38,0)"))).first()
        if now == before:
            return labels
        before = now  # labels only fall, so an equal sum means that none did


def confirmed_pairs(pairs: DataFrame, members: DataFrame, options: Options) -> DataFrame:
    """The pairs `a, b` of nodes that are linked. `members` has `node, n, registers, text`."""
    side = lambda x: members.select(*[F.col(c).alias(f"{c}_{x}") for c in members.columns])
    rows = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(
        side("b"), F.col("b") == F.col("node_b")
    ).select("a", "b", "n_a", "n_b", "registers_a", "registers_b", "text_a", "text_b")

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, 256):
                some = part.slice(start, 256)
                column = {c: some.column(k) for k, c in enumerate(some.schema.names)}
                maybe = np.flatnonzero(plausible(
                    register_rows(column["registers_a"]), register_rows(column["registers_b"]),
                    column["n_a"].to_numpy(), column["n_b"].to_numpy(), options,
                ))
                keep = [
                    k for k in maybe
                    if linked(
                        shingles(column["text_a"][k].as_py(), options.words),
                        [shingles(column["text_b"][k].as_py(), options.words)], options.percent,
                    )[0]
                ]
                yield pa.RecordBatch.from_arrays(
                    [column["a"].take(pa.array(keep, pa.int64())),
                     column["b"].take(pa.array(keep, pa.int64()))], ["a", "b"],
                )

    return rows.mapInArrow(run, "a long, b long")


def register_rows(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), -1)


def cluster_links(options: Options):
    """A function that compares the leaders in one block of a cluster with its members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        registers = np.frombuffer(b"".join(group.registers), np.uint16).reshape(len(group), -1)
        bands = registers.reshape(len(group), -1, options.rows)
        sets: dict[int, np.ndarray] = {}

        def set_of(k):
            if k not in sets:
                sets[k] = shingles(group.text.iat[k], options.words)
            return sets[k]

        node, comp = group.node.to_numpy(), group.comp.to_numpy()
        size, lead = group.n.to_numpy(), group.lead.to_numpy()
        is_leader = np.isin(node, node[lead])
        members = np.flatnonzero(~lead)
        out = []
        for k in np.flatnonzero(lead):
            # Two leaders meet twice, once is enough.
            some = members[(comp[members] != comp[k])
                           & (~is_leader[members] | (node[members] > node[k]))]
            some = some[(bands[some] == bands[k]).all(axis=2).any(axis=1)]
            if len(some):
                some = some[plausible(
                    np.broadcast_to(registers[k], (len(some), registers.shape[1])),
                    registers[some], np.full(len(some), size[k]), size[some], options,
                )]
            for part in range(0, len(some), 256):
                few = some[part:part + 256]
                hit = linked(set_of(k), [set_of(x) for x in few], options.percent)
                out += [(node[k], node[x]) for x in few[hit]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def first_leaders(buckets: DataFrame) -> DataFrame:
    """`key, leader`: of each bucket the member that meets most others over all its buckets."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    scores = buckets.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("score"))
    return buckets.join(scores, "node").groupBy("key").agg(
        F.max_by("node", F.struct("score", -F.col("node"))).alias("leader")
    )


def apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component: `key, node, n, comp, cluster`. A
    bucket belongs to the cluster of the component that has most members in it."""
    rows = staged(buckets.join(labels, "node", "left").withColumn(
        "comp", F.coalesce("component", "node")
    ).drop("component"))
    clusters = rows.groupBy("key", "comp").agg(F.count("*").alias("part")).groupBy("key").agg(
        F.max_by("comp", F.struct("part", -F.col("comp"))).alias("cluster"),
        F.count("*").alias("parts"),
    ).where("parts > 1").drop("parts")
    return staged_round(rows.join(clusters, "key"))


def links_between(members: DataFrame, buckets: DataFrame, options: Options) -> DataFrame:
    """`node, component` over all links among the members of `buckets` (`key, node, n`)."""
    hubs = first_leaders(buckets)
    rest = staged(buckets.join(hubs, "key").where(F.col("node") != F.col("leader")))
    pairs = rest.select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
    ).distinct()
    labels = components(confirmed_pairs(pairs, members, options))
    rest = rest.drop("leader")
    while True:
        active = apart(rest, labels)
        if active.isEmpty():
            return labels
        # Of each cluster, what is not in its component leads, smallest components first. Members
        # travel once per cluster, not once per bucket.
        nodes = active.select("cluster", "node", "n", "comp").distinct()
        parts = nodes.groupBy("cluster", "comp").agg(F.count("*").alias("part"))
        order = Window.partitionBy("cluster").orderBy("part", "node")
        leaders = staged(nodes.where("comp <> cluster").join(parts, ["cluster", "comp"]).withColumn(
            "rank", F.row_number().over(order)
        ).where(F.col("rank") <= options.leaders).withColumn(
            "before", F.sum("n").over(order) - F.col("n")
        ).where(F.col("before") < options.leader_size).select("cluster", "node", "comp"))
        # A block is bounded by its members and by the size of their sets.
        sizes = nodes.groupBy("cluster").agg(F.ceil(
            (F.count("*") + F.sum("n") / 1000) / options.block
        ).cast("int").alias("blocks"))
        rows = nodes.join(sizes, "cluster").select(
            "cluster", "node", "comp",
            F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"),
            F.lit(False).alias("lead"),
        ).unionByName(leaders.join(sizes, "cluster").select(
            "cluster", "node", "comp",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(True).alias("lead"),
        ))
        found = rows.join(members, "node").groupBy("cluster", "block").applyInPandas(
            cluster_links(options), "a long, b long"
        )
        stars = labels.where("node <> component").select(
            F.col("node").alias("a"), F.col("component").alias("b")
        )
        labels = components(stars.unionByName(found))
        rest = active.join(leaders.select("cluster", "node"), ["cluster", "node"], "left_anti").select(
            "key", "node", "n"
        )


def linked_classes(
    docs: DataFrame, doc_id: str, text: str, options: Options, row: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketched rows, the classes of rows with equal sets, and the components of classes."""
    spark = docs.sparkSession
    key = [F.col(row).alias("row")] if row else []
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *key
    )
    # What a row is found by again: its key, or its id and a hash of its text.
    found_by = ["row"] if row else ["doc_id", "h"]
    source = source if row else source.withColumn("h", F.xxhash64("text"))
    rows = staged(sketched(source, "text", "s", options).select(
        "doc_id", *(["row"] if row else ["h"]), "s.n", "s.digest", "s.registers"
    ))
    classes = staged(rows.where("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", found_by[-1])).alias("x"),
        F.any_value("n").alias("n"), F.any_value("registers").alias("registers"),
    ).select(
        "digest", F.col("x.doc_id").alias("first"), F.col(f"x.{found_by[-1]}").alias("first_key"),
        "n", "registers", F.monotonically_increasing_id().alias("node"),
    ))
    width = 2 * options.rows
    bands = classes.select("node", "n", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(options.registers // options.rows - 1)),
        lambda j: F.xxhash64(F.substring("registers", j * width + 1, F.lit(width)), j),
    )).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = staged(bands.join(shared, "key", "left_semi").select("key", "node", "n"))
    # The texts of the candidates, by the first row of each class.
    wanted = buckets.select("node").distinct().join(classes, "node")
    same = F.col(f"d.{found_by[-1]}") == F.col("w.first_key")
    if not row:
        same &= F.col("d.doc_id").eqNullSafe(F.col("w.first"))
    path = fresh_folder(spark, "candidates")
    texts = source.alias("d").join(wanted.alias("w"), same).select(
        "node", "n", "digest", "registers", "text"
    ).mapInArrow(same_set(options.words), "node long, n long, registers binary, text string")
    # Rows that repeat id and text are found once.
    (texts if row else texts.groupBy("node").agg(
        *[F.any_value(c).alias(c) for c in ("n", "registers", "text")]
    )).write.option("compression", "zstd").parquet(path)
    members = spark.read.schema(
        "node long, n long, registers binary, text string"
    ).parquet(path)
    return rows, classes, links_between(members, buckets, options)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = DEFAULT,
    row: str | None = None,
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` of each document: the size of its set, the smallest
    id among the documents that links lead to, and whether that is its own.

    `row` names a column that is different in every row. It is returned as `row`, and `kept` is then
    true for one row of each component, the smallest by id (null last), set and `row`, and for every
    row with an empty set."""
    with dropping_shuffles(docs.sparkSession):
        rows, classes, labels = linked_classes(docs, doc_id, text, options, row)
    named = classes.select("digest", "first", "node").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    found = named.join(names, "component").select("digest", "component_id")
    out = rows.drop("registers", "h").join(found, "digest", "left").select(
        "doc_id", *(["row"] if row else []), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"),
    )
    if not row:
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    # First within the classes, then within their components.
    best = rows.where("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("x")
    ).join(named.select("digest", "component"), "digest").groupBy("component").agg(
        F.min(F.struct("x.unnamed", "x.doc_id", "digest", "x.row"))["row"].alias("best")
    ).select("best")
    return out.join(best, F.col("row") == F.col("best"), "left").withColumn(
        "kept", (F.col("n_shingles") == 0) | F.col("best").isNotNull()
    ).drop("best")


def same_set(words: int):
    """Keeps the rows whose text has the set that its class stands for."""

    def run(parts):
        for part in parts:
            digests, texts = part.column(2), part.column(4)
            keep = [
                k for k in range(part.num_rows)
                if hashlib.blake2b(
                    shingles(texts[k].as_py(), words).tobytes(), digest_size=16
                ).digest() == digests[k].as_py()
            ]
            yield part.take(pa.array(keep, pa.int64())).select(
                ["node", "n", "registers", "text"]
            )

    return run


def op8_setsketch_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), options=Options(words=2))


SQL = {"op8_setsketch_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1)
  UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS start, doc_id AS found FROM n
  UNION SELECT start, b FROM reach JOIN ways ON ways.a = reach.found
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(found), w.doc_id) AS component_id,
  w.doc_id = coalesce(min(found), w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.start = w.doc_id
GROUP BY w.doc_id, n.n
"""}

QUERIES = {"op8_setsketch_duplicates": op8_setsketch_duplicates}
