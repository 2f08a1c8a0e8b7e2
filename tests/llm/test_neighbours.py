import numpy as np
from pyspark.sql import functions as F

from ledgerproof.llm import neighbours as N


def brute(rows, queries, count):
    """Every neighbour list by comparing all pairs; the smallest vector of an id counts."""
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        if len(v) == 8 and (i not in best or v < best[i]):
            best[i] = v
    ids = sorted(best)
    matrix = np.array([best[i] for i in ids], float)
    out = {}
    for q in queries:
        if q in best:
            score = [(-sum(a * b for a, b in zip(best[q], v)), i) for i, v in zip(ids, matrix) if i != q]
            out[q] = [(i, -s) for s, i in sorted(score)[:count]]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "part", F.lit("mine")
    ).withColumn("first", F.lit(1))


def found(spark, rows, queries, options):
    asked = spark.createDataFrame([(q,) for q in queries], "query_id long")
    out = {}
    for r in N.nearest(table(spark, rows), asked, options=options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_where_every_part_is_visited(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in rng.integers(-3, 4, 8)]) for k in range(400)]  # many ties
    rows += [(1000 + k, rows[7][1]) for k in range(120)] + [rows[3], (5, rows[9][1])]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [float("nan")] + [1.0] * 7),
             (2004, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2005, [1.0] * 5)]
    queries = [*range(0, 400, 20), 1000, 1060, 2000, 5, 99999]
    options = N.Options(part_rows=50, sample=300, reached=1.0, block=64)
    got, want = found(spark, rows, queries, options), brute(rows, queries, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=0)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    rows = [(k, (centres[k % 40] + 0.15 * rng.normal(size=8)).tolist()) for k in range(4000)]
    options = N.Options(part_rows=200)
    queries = list(range(0, 4000, 20))
    got, want = found(spark, rows, queries, options), brute(rows, queries, 20)
    same = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries)
    assert same >= 0.9 * 20 * len(queries)
    router = N.fitted(np.array([v for _, v in rows]), 4000, options)
    assert router.probes < router.second.shape[1]


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    graph = N.neighbour_graph(rng.normal(size=(1000, 8)), 10)
    sizes = np.bincount(N.balanced_parts(graph, 20), minlength=20)
    assert sizes.sum() == 1000 and sizes.max() <= 56


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0] * 8), (1, [2.0] * 8)]
    assert found(spark, rows, [0], N.DEFAULT) == {0: [(1, 16.0)]}
    assert found(spark, rows[:1], [0], N.DEFAULT) == {}
    assert found(spark, [], [0], N.DEFAULT) == {}


def test_ties_at_the_last_place():
    """Binary vectors: many more than the count tie at its score, the smaller ids win."""
    rng = np.random.default_rng(4)
    bits = np.array([[float(c) for c in f"{k:012b}"] for k in range(1, 4096)])
    first = rng.permutation(len(bits)) * 7
    query, allowed = bits[rng.integers(0, len(bits), 40)], rng.random((40, len(bits))) < 0.9
    allowed[0] = False
    allowed[0, :5] = True
    places, scores = N.best_rows(query, bits, first, allowed, 21)
    for k in range(len(query)):
        want = sorted((-float(query[k] @ bits[i]), first[i]) for i in np.flatnonzero(allowed[k]))[:21]
        seen = np.isfinite(scores[k])
        assert [(-x, i) for x, i in zip(scores[k][seen], first[places[k][seen]])] == want
