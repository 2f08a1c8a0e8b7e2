import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerproof.llm import alignment
from ledgerproof.llm.alignment import Csr, Options, Tokens

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_vocabulary_bytes():
    aligner = alignment.Aligner(Options())
    assert aligner.models[0].bytes[50256] == b"<|endoftext|>"
    assert sum(len(b) == 1 for b in aligner.models[0].bytes) == 256
    assert {aligner.models[1].bytes[i] for i in range(3, 259)} == {bytes([k]) for k in range(256)}


def dense(m):
    out = np.zeros((len(m), m.width), int)
    for i in range(len(m)):
        for j in m.indices[m.indptr[i]:m.indptr[i + 1]]:
            out[i, j] += 1
    return out


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_products_equal_dense_ones(block):
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, k, m = rng.integers(1, 9, 3)
        given = [rng.random((n, k)) < 0.4, rng.random((k, m)) < 0.4]
        a, b = (
            Csr(np.concatenate([[0], np.cumsum(g.sum(1))]), np.nonzero(g)[1], g.shape[1]) for g in given
        )
        expected = given[0].astype(int) @ given[1].astype(int)
        found = np.zeros_like(expected)
        for rows, columns, values in alignment.products(a, b, block):
            found[rows, columns] += values
        assert (found == expected).all()
        assert (alignment.product_sizes(a, b) == expected.sum(1)).all()
        assert (dense(b.transposed()) == given[1].T).all()


def plain(rows):
    """Per row: the contract's columns by loops over tokens."""
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    letters = alignment.byte_letters()
    per_row, held = [], Counter()
    for _, text in rows:
        ids = [[], []]
        if text:
            ids = [a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)]
        data = [
            [bytes(letters[c] for c in a_model.id_to_token(i)) for i in ids[0]],
            [bytes([int(b_model.id_to_piece(i)[3:-1], 16)]) if b_model.is_byte(i)
             else b_model.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        ]
        if not text or any(b"".join(d) != b" " + text.encode() for d in data):
            per_row.append(([], [], [], [], 0))
            continue
        spans = []
        for d in data:
            at, out = 0, []
            for t in d:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        linked = [
            (ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1])
            if s < f and t < e
        ]
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            g = ([], [])
            while i < len(spans[0]) and spans[0][i][1] <= cut:
                g[0].append(ids[0][i])
                i += 1
            while j < len(spans[1]) and spans[1][j][1] <= cut:
                g[1].append(ids[1][j])
                j += 1
            groups.append(g)
        per_row.append((ids[0], ids[1], linked, groups, sum(len(x) * len(y) for x, y in groups)))
        held.update(set(linked))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc_id, _), (a, b, linked, groups, shared) in zip(rows, per_row):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), len(linked), shared,
            hashlib.sha256(said.encode()).hexdigest() if a else "",
            sum(held[p] for p in linked), sum(held[p] == best[p[0]] for p in linked),
        ))
    return sorted(out, key=repr)


def of(df):
    return sorted((
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_shared, r.groups_sha256, r.count_sum, r.n_best)
        for r in df.collect()
    ), key=repr)


def cases():
    rng = random.Random(4)
    parts = ["the", "unbeliev", "able", " ", "  ", "é", "日本", "1234", "\n", "!", "<|endoftext|>", "<s>", "🙂", "ing"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for k in range(80)]
    return rows + [
        (900, None), (901, ""), (902, " "), (903, "a▁b"), (904, "\x00"), (905, "<0x41>"),
        (906, "same text here"), (907, "same text here"), (906, "same text here"), (None, "no id"),
        (908, "ab" * 900), (909, "word " * 300), (910, "ﬁ ½ Å"),
    ]


@pytest.mark.parametrize("options", [
    Options(), Options(frequent=20, held=50, block=7, batch=40), Options(frequent=1),
])
def test_same_as_loops_over_tokens(documents, options):
    rows = cases()
    got = alignment.counted_links(documents(*rows, extra="pairs").repartition(3), options=options)
    assert of(got) == plain(rows)


def test_links_are_those_of_the_products(documents):
    rows = cases()
    expected = {r[0]: r for r in plain(rows) if r[0] not in (None, 906)}
    for shared, field in ((False, 4), (True, 5)):
        got = Counter(r.doc_id for r in alignment.links(documents(*rows), shared_group=shared).collect())
        assert {k: got[k] for k in expected} == {k: r[field] for k, r in expected.items()}


def test_shared_bytes_add_up_to_the_text():
    a, b = (Tokens(np.arange(len(e)), np.array(e)) for e in ([2, 3, 7, 9], [1, 3, 4, 8, 9]))
    found = [tuple(map(int, x)) for rows in alignment.overlap_links(a, b, 2) for x in zip(*rows)]
    assert found == [(0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 1), (2, 3, 3), (3, 3, 1), (3, 4, 1)]
    assert alignment.cuts_of(a, b).tolist() == [3, 9]


def test_empty_table_and_long_texts(documents):
    assert alignment.counted_links(documents((1, "x")).limit(0)).collect() == []
    row = alignment.counted_links(documents((1, "some words " * 60_000))).collect()[0]
    assert row.n_links >= row.n_a > 100_000


def test_ranks_encode_as_the_library_does():
    """Every code point between letters, digits, blanks and others; words; white space."""
    model = alignment.ByteLevel(A_PATH)
    assert model.ranked is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = []
    for start in range(0, len(points), 1000):
        part = points[start:start + 1000]
        texts += ["a".join(part), "1 ".join(part), " .".join(part), "".join(part)]
    rng = random.Random(7)
    parts = ["'s", "'LL", " '", "the", "The", "é", "12", "  ", "\n", "\r\n", "\t", "\xa0", "　", "!?", "日", "🙂", "\x85"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["x" * 5000, " " * 5000, "ab\n" * 3000]
    found = model.encode(texts)
    ranked, model.ranked = model.ranked, None
    assert found == model.encode(texts)
