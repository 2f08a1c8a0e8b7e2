"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced parts, so that few
neighbours are separated. A small classifier learns the part of a vector. It puts every vector of
the table into its most probable part, and sends a query to its several most probable ones, where
all vectors are compared by their exact inner product. How many parts a query needs is measured on
the sample.

Equal vectors are searched once: of their ids only the smallest can be among the nearest, and equal
queries have equal neighbours but for themselves. Parts are compared in blocks of bounded size: a
part that holds a third of all rows is only more blocks, and small parts share one.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those without the most frequent length; of rows that share an id one vector counts; ties go to the smaller id; rows
with a null id take no part; with no more vectors than asked for, all are returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerproof.llm.common import staged, table


@dataclass(frozen=True)
class Options:
    """`sample` vectors (smallest hash of the id) are fitted, with `links` neighbours each, into
    about one part per `part_rows` rows, at most `parts`. A query visits so many parts that
    `reached` of the sample's `nearest` neighbours lie in them. `block` rows are compared at once."""

    nearest: int = 20
    sample: int = 4096
    links: int = 12
    parts: int = 128
    part_rows: int = 2000
    hidden: int = 64
    epochs: int = 25
    reached: float = 0.95
    block: int = 4096


DEFAULT = Options()


# Fitting, on the sample


def neighbour_graph(vectors: np.ndarray, links: int) -> np.ndarray:
    """The `links` vectors with the largest inner product to each, itself left out."""
    n = len(vectors)
    links = min(links, n - 1)
    out = np.empty((n, links), np.int64)
    for start in range(0, n, 512):
        score = vectors[start:start + 512] @ vectors.T
        score[np.arange(len(score)), np.arange(start, start + len(score))] = -np.inf
        out[start:start + 512] = np.argpartition(-score, links - 1, axis=1)[:, :links]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """The part of each node: parts grow from seeds along the links until they are full, then nodes
    move to the part of most of their neighbours while there is room, or change places."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    around: list[list[int]] = [[] for _ in range(n)]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            around[a].append(b)
            around[b].append(a)
    full = -(-n // parts)
    part = np.full(n, -1)
    order = rng.permutation(n).tolist()
    number = 0
    for first in order:
        if part[first] >= 0:
            continue
        # Grow one part, breadth first; what a component lacks comes from the next seed.
        held = int((part == number).sum())
        if held >= full:
            number, held = number + 1, 0
        queue, k = [first], 0
        part[first] = number
        held += 1
        while k < len(queue) and held < full:
            for b in around[queue[k]]:
                if part[b] < 0 and held < full:
                    part[b] = number
                    held += 1
                    queue.append(b)
            k += 1
    part = part.tolist()
    size = np.bincount(part, minlength=parts).tolist()
    room = int(full * 1.1) + 1
    for _ in range(rounds):
        moved = 0
        wishes: dict[tuple[int, int], list[int]] = {}
        for a in rng.permutation(n).tolist():
            counts: dict[int, int] = {}
            for b in around[a]:
                counts[part[b]] = counts.get(part[b], 0) + 1
            if not counts:
                continue
            here = part[a]
            best = max(counts, key=lambda p: (counts[p], -p))
            if best == here or counts[best] <= counts.get(here, 0):
                continue
            if size[best] < room:
                part[a], size[best], size[here] = best, size[best] + 1, size[here] - 1
                moved += 1
            elif wishes.get((best, here)):
                other = wishes[best, here].pop()
                if part[other] == best:
                    part[a], part[other] = best, here
                    moved += 2
            else:
                wishes.setdefault((here, best), []).append(a)
        if moved < n // 500:
            break
    return np.array(part)


@dataclass
class Router:
    """A classifier with one hidden layer from vectors to parts."""

    scale: float
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    out: np.ndarray
    probes: int = 1

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        hidden = np.maximum(vectors * self.scale @ self.first + self.bias, 0)
        return hidden @ self.second + self.out

    def route(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The `count` most probable parts of each vector, best first."""
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :count]


def trained_router(
    vectors: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, options: Options
) -> Router:
    """Learns the parts of each vector and its neighbours, by cross entropy."""
    rng = np.random.default_rng(11)
    n, d = vectors.shape
    scale = 1 / (np.sqrt((vectors**2).mean()) + 1e-12)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.arange(n), part), graph.shape[1] / 2)
    for column in graph.T:
        np.add.at(goal, (np.arange(n), part[column]), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    weights = [
        rng.normal(0, np.sqrt(2 / d), (d, options.hidden)), np.zeros(options.hidden),
        rng.normal(0, np.sqrt(1 / options.hidden), (options.hidden, parts)), np.zeros(parts),
    ]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    x = vectors * scale
    for _ in range(options.epochs):
        order = rng.permutation(n)
        for start in range(0, n, 256):
            k = order[start:start + 256]
            hidden = np.maximum(x[k] @ weights[0] + weights[1], 0)
            score = hidden @ weights[2] + weights[3]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            wrong = (p - goal[k]) / len(k)
            back = (wrong @ weights[2].T) * (hidden > 0)
            slopes = [x[k].T @ back, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            step += 1
            for w, g, m, s in zip(weights, slopes, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= 2e-3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Router(scale, *weights)


def fitted(vectors: np.ndarray, rows: int, options: Options = DEFAULT) -> Router:
    """The router for a table of `rows` vectors, from a sample of them."""
    vectors = vectors.astype(np.float64)
    parts = int(max(1, min(options.parts, rows // options.part_rows, len(vectors) // 32)))
    if parts == 1:
        d = vectors.shape[1]
        return Router(1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(vectors, options.links)
    part = balanced_parts(graph, parts)
    router = trained_router(vectors, graph, part, parts, options)
    # On the sample: how often a near neighbour's part is among the first ones of a vector.
    own = router.route(vectors, 1)[:, 0]
    near = neighbour_graph(vectors, options.nearest)
    places = np.argsort(router.route(vectors, parts), axis=1)
    rank = np.take_along_axis(places, own[near], axis=1)
    share = np.array([(rank < m).mean() for m in range(1, parts + 1)])
    router.probes = int(np.argmax(share >= options.reached)) + 1
    return router


def best_rows(
    query: np.ndarray, vectors: np.ndarray, first: np.ndarray, allowed: np.ndarray, count: int
) -> tuple[np.ndarray, np.ndarray]:
    """The places and inner products of the `count` nearest of each query among the vectors it is
    `allowed` to see, in double precision; ties to the smaller `first`. Where a query sees fewer,
    the rest has score -inf."""
    rough = np.where(allowed, query @ vectors.T, -np.inf)
    width = min(len(vectors), count)
    # Whatever may reach the last place: rough and exact scores differ by roundings only.
    last = -np.partition(-rough, width - 1, axis=1)[:, width - 1]
    size = np.sqrt((query**2).sum(axis=1) * (vectors**2).sum(axis=1).max())
    margin = 4 * (query.shape[1] + 1) * np.finfo(float).eps * size
    maybe = allowed & ~(rough < (last - margin)[:, None])
    places = np.zeros((len(query), width), np.int64)
    scores = np.full((len(query), width), -np.inf)
    ends = np.cumsum(maybe.sum(axis=1))
    start = 0
    while start < len(query):  # as many queries as have a million candidates, one at least
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + (1 << 20), "right")))
        asker, some = np.nonzero(maybe[start:stop])
        asker += start
        exact = np.zeros(len(some))
        for d in range(query.shape[1]):  # one order of additions for every pair
            exact += query[asker, d] * vectors[some, d]
        order = np.lexsort((first[some], -exact, asker))
        asker, some, exact = asker[order], some[order], exact[order]
        rank = np.arange(len(some)) - np.searchsorted(asker, asker)
        kept = rank < width
        places[asker[kept], rank[kept]] = some[kept]
        scores[asker[kept], rank[kept]] = exact[kept]
        start = stop
    return places, scores


def bundles(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """Parts that are compared together: `part -> (bundle, blocks)`. Small parts share a bundle of at
    most `block` rows, a larger part is a bundle of several blocks."""
    out, number, held = {}, 0, 0
    for part, size in sorted(sizes.items()):
        if held and held + size > block:
            number, held = number + 1, 0
        out[part] = (number, max(1, -(-size // block)))
        held += size
    return out


# Spark


def usable_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """`vec_id, vector` of the rows that take part. Of rows that share an id, the smallest vector
    counts."""
    x = F.col("vector")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & x.isNotNull()).where(
        finite & F.exists(x, lambda c: c != 0)
    )
    length = sound.groupBy(F.size("vector").alias("d")).count().orderBy(
        F.desc("count"), "d"
    ).first()
    return sound.where(F.size("vector") == (length["d"] if length else 0)).groupBy("vec_id").agg(
        F.min("vector").alias("vector")
    )


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """`vector, first, ids`: each different vector with its `keep` smallest ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).groupBy(
        "vector"
    ).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.get("ids", F.lit(0)))


def fit(vectors: DataFrame, options: Options = DEFAULT) -> Router:
    """The router, from the `sample` different vectors whose first ids have the smallest hashes.
    The driver gets that many vectors."""
    rows = vectors.count()
    chosen = vectors.select("vector", "first").orderBy(F.xxhash64("first"), "first").limit(
        options.sample
    ).toPandas()
    if not rows:
        return Router(1.0, np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    return fitted(np.stack(chosen["vector"]), rows, options)


def routed(vectors: DataFrame, router: Router, count: int, *columns: str) -> DataFrame:
    """`vectors` with one row per part: each vector's `count` most probable parts."""
    target = vectors.select("vector", *columns).schema.simpleString()[len("struct<"):-1]

    def run(parts):
        for part in parts:
            if len(part):
                found = router.route(np.stack(part["vector"]), count)
                yield part.assign(parts=list(found.astype(np.int32)))

    return vectors.select("vector", *columns).mapInPandas(run, f"{target}, parts array<int>").select(
        "vector", *columns, F.explode("parts").alias("part")
    )


def nearest(
    rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    options: Options = DEFAULT,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the nearest found for each id in `queries` (`query_id`)."""
    count = options.nearest
    usable = usable_vectors(rows, vec_id, vector)
    # One id more than asked for: a query is not its own neighbour.
    vectors = staged(distinct_vectors(usable, count + 1))
    router = fit(vectors, options)
    asked = staged(usable.join(
        queries.select(F.col("query_id").cast("long").alias("vec_id")).distinct(), "vec_id"
    ).join(vectors.select("vector", "first"), "vector").select("vec_id", "first"))
    index = staged(routed(vectors, router, 1, "first"))
    sent = routed(
        vectors.join(asked.select("first").distinct(), "first"), router, router.probes, "first"
    )
    # There are `parts` sizes at most.
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    plan = F.broadcast(rows.sparkSession.createDataFrame(
        [(part, *where) for part, where in bundles(sizes, options.block).items()],
        "part int, bundle int, blocks int",
    ))
    asks = staged(sent.join(plan, "part").groupBy("bundle", "blocks", "first").agg(
        F.any_value("vector").alias("vector"), F.collect_list("part").alias("parts")
    ))
    turns = F.broadcast(asks.groupBy("bundle").agg(
        F.ceil(F.count("*") / options.block).cast("int").alias("turns")
    ))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    candidates = index.join(plan, "part").join(turns, "bundle").select(
        F.col("bundle").alias("bundle"), F.pmod(F.xxhash64("first"), "blocks").cast("int").alias("block"),
        spread(F.col("turns")).alias("turn"), "first", "vector", "part",
    )
    questions = asks.join(turns, "bundle").select(
        F.col("bundle").alias("bundle"), spread(F.col("blocks")).alias("block"),
        F.pmod(F.xxhash64("first"), "turns").cast("int").alias("turn"), "first", "vector", "parts",
    )

    def compare(ask: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "first": [], "score": []}).astype(
            {"query": "int64", "first": "int64", "score": "float64"}
        )]
        if not len(ask) or not len(pool):
            return out[0]
        stock, first = np.stack(pool["vector"]), pool["first"].to_numpy()
        own = pool["part"].to_numpy()
        for start in range(0, len(ask), 256):
            some = ask.iloc[start:start + 256]
            allowed = np.array([np.isin(own, parts) for parts in some["parts"]])
            at, score = best_rows(np.stack(some["vector"]), stock, first, allowed, count + 1)
            found = np.isfinite(score).ravel()
            out.append(pd.DataFrame({
                "query": np.repeat(some["first"].to_numpy(), at.shape[1])[found],
                "first": first[at].ravel()[found], "score": score.ravel()[found],
            }))
        return pd.concat(out)

    keys = ("bundle", "block", "turn")
    found = questions.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        compare, "query long, first long, score double"
    )
    # The best different vectors of each different query, then their ids.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count + 1)
    listed = best.join(vectors.select("first", "ids"), "first").select(
        "query", "score", F.explode("ids").alias("vec_id")
    )
    closest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = listed.withColumn("n", F.row_number().over(closest)).where(F.col("n") <= count + 1)
    own = lists.groupBy(F.col("query").alias("first")).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("far"), "vec_id", "score")
    )).alias("list"))
    me = F.col("query_id")
    return asked.withColumnRenamed("vec_id", "query_id").join(own, "first").select(
        "query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != me), 1, count))
    ).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"),
        F.col("col.score").alias("score"),
    )


def op5_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    queries = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"))
    return nearest(rows, queries)


QUERIES = {"op5_learned_partitions": op5_learned_partitions}
