import random

from ledgerproof.llm.packing import Options, bins_of, pack, packed


def slow(items, capacity):
    """Best-fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [
            (capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins)
            if sum(x[0] for x in b) + size <= capacity and all(
                x[1] != source and (cluster is None or x[2] != cluster) for x in b
            )
        ]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((size, source, cluster))
    return out, len(bins)


def test_same_as_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        items = [
            (rng.randrange(0, 100), rng.choice("aaabcdef"), rng.choice([None, 1, 2, 3]))
            for _ in range(rng.randrange(80))
        ]
        items.sort(key=lambda x: -x[0])
        assert pack(items, 100) == slow(items, 100)


def test_pieces_fill_documents_and_bins(documents):
    rng = random.Random(4)
    rows = [
        (k, " ".join("w" for _ in range(rng.choice([0, 3, 30, 64, 65, 200]))) + f" {k % 7}" * (k % 2),
         None, rng.choice(["a", "a", "b", "c", None]))
        for k in range(300)
    ] + [(600, "same row", None, "a")] * 2 + [(None, None, None, None)] * 2 + [(9999, "", None, "b")]
    docs = documents(*rows, extra="item")
    for shard_rows in (50, 10_000):
        pieces = packed(docs, options=Options(capacity=64, shard_rows=shard_rows))
        got = pieces.collect()
        sizes = sorted(len((r[1] or "").split()) for r in rows)
        whole = {}
        for r in got:
            whole.setdefault(r.item, []).append(r)
        assert len(whole) == len(rows)
        assert sorted(sum(r.n_tokens for r in x) for x in whole.values()) == sizes
        for parts in whole.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at
                at += r.n_tokens
        assert bins_of(pieces).where("n_tokens > 64").count() == 0
        source = {}
        for r in rows:
            source.setdefault(r[0], r[3] if len(r) > 3 else "s")
        for number in {r.bin for r in got}:
            held = [r for r in got if r.bin == number]
            names = [source[r.doc_id] for r in held]
            assert len(names) == len(set(names))
            places = sorted((r.place, r.n_tokens) for r in held)
            assert all(a + n <= b for (a, n), (b, _) in zip(places, places[1:]))


def test_empty_table(documents):
    assert packed(documents((1, "a")).where("false")).count() == 0


def test_numbers_and_nulls_as_source_and_cluster(spark):
    from pyspark.sql import functions as F

    big = 2**60
    rows = [(k, "w " * 4, None if k % 5 == 0 else big + k % 2, None if k % 4 == 0 else big + k % 3) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source long, cluster long")
    got = packed(docs, size=F.lit(4), cluster=F.col("cluster"), options=Options(capacity=64)).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(rows[r.doc_id])
    for held in bins.values():
        sources, clusters = [r[2] for r in held], [r[3] for r in held if r[3] is not None]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    assert any(len(held) > 1 for held in bins.values()) and {r.n_tokens for r in got} == {4}


def test_very_long_text(documents):
    got = packed(documents((1, "word " * 500_000), (2, "a b")), options=Options(capacity=2048)).collect()
    assert sum(r.n_tokens for r in got if r.doc_id == 1) == 500_000
    assert max(r.n_tokens for r in got) == 2048
