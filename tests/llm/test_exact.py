import hashlib
import re

import numpy as np
import pytest

from ledgerproof.llm import exact
from ledgerproof.llm.exact import Options

SMALL = Options(chunk=64, share=3)


def plain(rows):
    """doc_id, keep_id, group_size, kept, sha256 of each row by a dictionary of texts."""
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for at, t in enumerate(texts):
        groups.setdefault(t, []).append(rows[at][0])
    first = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}
    return [
        (rows[at][0], first[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for at, t in enumerate(texts)
    ]


def of(df):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr
    )


def cases():
    long = "wörd " * 40 + "\x00 end"
    return [
        (1, "a b"), (2, "a  b"), (3, "a\n\tb"), (4, " a b"), (5, ""), (6, None), (7, " \n"), (8, " "),
        (9, long), (10, long.replace(" ", "\r\n")), (11, long + "x"), (12, long[:-1] + "e"),
        (13, "x" * 64), (14, "x" * 65), (15, "x" * 128), (16, "x" * 128), (17, "\x00"), (18, "\x00\x00"),
        (19, "\xa0"), (20, "A b"), *[(100 + k, "many copies " * 9) for k in range(40)],
        (9, long), (9, "other"), (None, "a b"), (None, "none"), (None, "none"),
    ]


def test_same_as_a_dictionary_of_texts(spark, documents):
    rows = cases()
    df = documents(*rows, extra="leader").repartition(5)
    got = exact.exact_duplicates(df, options=SMALL)
    assert of(got) == sorted(plain(rows), key=repr)
    kept = got.where("kept").collect()
    assert len(kept) == len({r[3] for r in plain(rows)})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_collisions_cost_rounds_and_no_wrong_group(spark, documents):
    rows = [(k, f"text {k % 7} of {'abcde'[k % 5]} ") for k in range(60)]
    weak = Options(chunk=8, share=2, primes=(3, 5), bases=(2, 3))
    assert of(exact.exact_duplicates(documents(*rows), options=weak)) == sorted(plain(rows), key=repr)


def test_one_row_stays_of_repeated_rows(documents):
    got = exact.exact_duplicates(documents((1, "x"), (1, "x"), (1, "x"), (2, "x"))).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {4}


@pytest.mark.parametrize("cut", [1, 7, 64, 100])
def test_fingerprints_compose(cut):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 500, dtype=np.uint8)
    base, prime = exact.DEFAULT.bases[0], exact.DEFAULT.primes[0]
    power = exact.powers(base, prime, 500)
    assert [pow(base, k, prime) for k in range(500)] == power.tolist()
    whole = sum((int(b) + 1) * pow(base, 499 - k, prime) for k, b in enumerate(data)) % prime
    ends = np.array([*range(cut, 500, cut), 500])
    parts = exact.chunk_hashes(data, ends, base, prime, power)
    assert sum(int(h) * pow(base, 500 - int(e), prime) for h, e in zip(parts, ends)) % prime == whole


def test_empty_chunks_and_table(spark, documents):
    out = exact.chunk_hashes(np.zeros(0, np.uint8), np.array([0, 0]), 5, 7, exact.powers(5, 7, 4))
    assert out.tolist() == [0, 0]
    assert exact.exact_duplicates(documents((1, "x")).limit(0)).collect() == []


def test_very_long_texts(documents):
    long = "abc\t" * 300_000
    rows = [(1, long), (2, long.replace("\t", "  ")), (3, long + "d")]
    assert of(exact.exact_duplicates(documents(*rows))) == sorted(plain(rows), key=repr)
