import random

import numpy as np
from pyspark.sql import functions as F

from ledgerproof.llm import setsketch as S


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, k, percent=80):
    """Set size and component of each row, by all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        n = min(k, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for a, (doc_id, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a)]
        low = min((i for i in ids if i is not None), default=None)
        name = low if sets[a] else doc_id
        out.append((doc_id, len(sets[a]), name, doc_id == name))
    return sorted(out, key=repr)


def edited(words, rng, share):
    return [rng.choice("uvwxyz") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def corpus():
    rng = random.Random(8)
    rows, number = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            share = rng.choice([0, 0.01, 0.03, 0.05, 0.08, 0.15])
            rows.append((number := number + 1, " ".join(edited(base, rng, share))))
    chain = [f"c{k}" for k in range(200)]
    for step in range(12):  # each near the next one, the ends far apart
        rows.append((number := number + 1, " ".join(chain[step * 9:] + [f"d{k}" for k in range(step * 9)])))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "Two"),
             (None, "null id text here"), (None, "Null ID text here"), (907, "null id TEXT here"),
             (None, "only null ids"), (908, "a\x0bb\x1cc"), (909, "a b\x1cc"), (910, "É é"), (911, "é É")]
    rows += [rows[0], (rows[0][0], "another text under the same id")]
    rng.shuffle(rows)
    return rows


def test_same_as_all_pairs(documents):
    rows = corpus()
    docs = documents(*rows, extra="component")
    for k, options in ((2, S.Options(words=2)), (5, S.Options(leaders=16, block=8))):
        got = sorted(map(tuple, S.near_duplicates(docs, options=options).collect()), key=repr)
        assert got == brute(rows, k)


def test_hard_cluster_without_a_centre(documents):
    """Many near-copies, of which no one is near all others."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(edited(base, rng, 0.05))) for k in range(60)]
    got = sorted(map(tuple, S.near_duplicates(
        documents(*rows), options=S.Options(words=2, leaders=20, block=7)).collect()), key=repr)
    assert got == brute(rows, 2)


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    options = S.Options()
    for share in (0.3, 0.5, 0.8, 0.95):
        n = 2000
        both = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]))
        ka, kb, union = S.sketches([a, b, np.union1d(a, b)], options)
        assert (S.merged(ka, kb) == union).all()
        assert abs((ka == kb).mean() - share) < 0.15
        keep = S.plausible(ka[None], kb[None], np.array([len(a)]), np.array([len(b)]), options)[0]
        assert keep == (share >= 0.8)
    one = S.sketches([np.array([5], np.uint64), np.empty(0, np.uint64)], options)
    assert (one[0] > 0).all() and (one[1] == 0).all()


def test_empty_table_and_long_text(documents):
    assert S.near_duplicates(documents((1, "a")).where("false")).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    got = {r.doc_id: r for r in S.near_duplicates(documents((2, long), (5, long + " x"), (1, "b"))).collect()}
    assert got[5].component_id == 2 and not got[5].kept and got[2].n_shingles == 59_996


def test_ids_that_are_null_or_repeated(documents):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    rows = [(None, t) for t in texts] + [(None, t + " more") for t in texts] + [(None, texts[0])] * 5
    rows += [(5, t) for t in (texts[3], texts[4], texts[3] + " end")]
    got = S.near_duplicates(documents(*rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {None, 5}
    assert sum(r.component_id == 5 for r in got) == 2 * 2 + 3


def test_the_estimated_size_does_not_grow_with_the_rounds(spark):
    def digits(df):
        return len(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())

    links = spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = S.components(links)
    for _ in range(2):
        stars = labels.where("node <> component").select(
            F.col("node").alias("a"), F.col("component").alias("b")
        )
        labels = S.components(links.unionByName(stars))
    buckets = labels.select(F.lit(1).cast("bigint").alias("key"), "node", F.lit(1).alias("n"))
    active = S.apart(buckets, labels.where("node < 5"))
    again = S.apart(active.select("key", "node", "n"), labels.where("node < 5"))
    assert {r.component for r in labels.collect()} == {0} and labels.count() == 10
    assert {r.node for r in again.collect()} == set(range(10))
    assert max(map(digits, (labels, active, again))) < 25
