import hashlib
import math
import random
import re
import zlib
from collections import Counter

from ledgerproof.llm import resample
from ledgerproof.llm.resample import Options

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    """Words by the contract's pattern, and the CRC-32 of each joined run."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return len(words), [
        zlib.crc32(" ".join(words[i:i + n]).encode())
        for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]


def plain(rows, target, o):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(f % o.buckets for f in features(text, o.longest)[1])
    for text in target:
        t.update(f % o.buckets for f in features(text, o.longest)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        n, found = features(text, o.longest)
        gain = [
            math.floor(1000 * math.log((t[f % o.buckets] + 1) * (S + o.buckets)
                                       / ((s[f % o.buckets] + 1) * (T + o.buckets)))) for f in found
        ]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{o.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, n, len(found), weight, score))
    able = sorted((r for r in out if r[1] >= o.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: o.percent * len(able) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=repr)


def of(df):
    return sorted(
        ((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr
    )


def corpus(rng, n):
    words = "the of Night is ÉTÉ été日本 a1 x-y don't 42 _under\x7f".split() + ["\x85", "\xa0q", "Z"]
    gaps = [" ", "\n", ", ", "--", "\x00", "\t"]
    return [
        (k, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for k in range(n)
    ]


def test_same_as_the_formula(spark, documents):
    rng = random.Random(5)
    rows = corpus(rng, 120) + [(500, None), (501, ""), (502, "..."), (None, "the of " * 20), (7, "the " * 30)]
    target = [t for _, t in corpus(rng, 9)] + [None]
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    for options in (Options(), Options(longest=3, buckets=97, percent=60, least_words=5, piece=16)):
        got = resample.resampled(documents(*rows, extra="place").repartition(3), benchmark, options=options)
        assert of(got) == plain(rows, target, options)


def test_pieces_give_the_same_features():
    rng = random.Random(6)
    for _, text in corpus(rng, 40):
        for longest in (1, 2, 4):
            for size in (1, 5, 1 << 20):
                o = Options(longest=longest, piece=size)
                parts = list(resample.checksums(text, o))
                n, found = features(text, longest)
                assert sum(p[0] for p in parts) == n
                assert Counter(x for p in parts for x in p[1]) == Counter(found)


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id doc_id", "id % 7 score", "id row").repartition(9)
    from pyspark.sql import functions as F

    got = resample.ranked(rows, [F.desc("score"), F.asc("doc_id")])
    expected = sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert [r.doc_id for r in sorted(got.collect(), key=lambda r: r.place)] == expected
    assert sorted(r.place for r in got.collect()) == list(range(1, 5001))


def test_empty_tables_and_long_texts(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(documents((1, "x")).limit(0), none).collect() == []
    long = "word Other " * 400_000
    got = resample.resampled(documents((1, long), (2, long)), none).collect()
    assert {(r.n_words, r.n_features) for r in got} == {(800_000, 1_599_999)}
    assert [r["rank"] for r in got] == [None, None]


def test_a_target_pulls_its_own_kind(spark, documents):
    near = [(k, f"moon orbit crater {k} " * 10) for k in range(50)]
    far = [(100 + k, f"tax invoice ledger {k} " * 10) for k in range(150)]
    target = spark.createDataFrame([("moon orbit crater " * 20,)], "text string")
    got = resample.resampled(documents(*near, *far), target).where("rank is not null").collect()
    # A plain sample of 50 would hold 12 or 13 of them.
    assert len(got) == 50 and sum(r.doc_id < 100 for r in got) >= 30
