import hashlib
import random
import re

import numpy as np

from pyspark.sql import functions as F

from ledgerproof.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    odd = digits[-1::-2]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, odd)) + sum(even)) % 10 == 0


def plain_spans(text):
    """The contract's patterns, as they are written."""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and checksum(digits):
            found.append(("card", *m.span()))
    return found + [
        ("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]


def test_base_spans_as_written():
    rng = random.Random(1)
    for n in range(30_000):
        text = "".join(rng.choice("a1@.+- (9b") for _ in range(rng.randint(0, 30)))
        if n % 3 == 0:
            text = text.replace("a", "12.3").replace("b", "4539 1488-0343 6467")
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "@" * 300_000,
                 "x1" * 200_000, "a@b" * 100_000):
        pii.base_spans(text)
        pii.added_spans(text, [], None)
        pii.graph_of(text)


def letter(rng):
    return "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(400):
        words = [letter(rng) for _ in range(40)]
        if k % 4 == 0:
            words.insert(rng.randrange(30), f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}")
        if k % 5 == 0:
            words.insert(rng.randrange(30), f"{letter(rng)}.{rng.randint(1, 99)}@mail{k}.example.com")
        if k % 6 == 0:
            words.insert(rng.randrange(30), ".".join(str(rng.randint(0, 255)) for _ in range(4)))
        if k % 7 == 0:
            words.insert(rng.randrange(30), f'token = "{rng.getrandbits(160):040x}"')
        words.insert(rng.randrange(30), f"{rng.randint(1, 2000)}")
        rows.append((k, " ".join(words)))
    return rows


def test_field_adds_spans_and_keeps_base(documents):
    phone = "call +1 (988) 555-2485 now"
    rows = corpus() + [
        (1000, f"{phone} and later 555-2485 or (988) 555-2485 again"), (1001, None), (1002, ""),
        (1003, "only words here"), (None, phone), (1000, phone), (1004, "x " * 20_000 + phone),
    ]
    docs = documents(*rows, extra="spans")
    model = pii.train(docs.select("doc_id", "text"))
    found = pii.with_spans(docs, model).select("doc_id", "text", F.col("pii.spans").alias("s")).collect()
    assert len(found) == len(rows)
    for r in found:
        base = sorted((s.kind, s.start, s.stop) for s in r.s if not s.added)
        assert base == sorted(plain_spans(r.text or ""))
        for s in r.s:
            assert 0 <= s.start < s.stop <= len(r.text)
    secrets = [r for r in found if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 7 == 0]
    hit = [any(s.kind == "secret" and len(r.text[s.start:s.stop]) >= 30 for s in r.s) for r in secrets]
    assert sum(hit) >= 0.9 * len(hit)
    clean = [r for r in found if r.doc_id is not None and r.doc_id < 400
             and all(r.doc_id % k for k in (4, 5, 6, 7))]
    assert sum(bool(r.s) for r in clean) <= 0.02 * len(clean)


def test_skip_links_carry_labels():
    """A bare number is labelled by its distant full form."""
    text = "+1 (988) 555-2485 " + "word " * 50 + "9885552485"
    graph = pii.graph_of(text)
    node = pii.np.zeros((pii.N_FEATURES, len(pii.LABELS)))
    node[0, 0] = 1.0
    power = pii.np.eye(len(pii.LABELS)) * 3
    field = pii.Field(node, power, power)
    fixed = pii.labels_of(graph, pii.base_spans(text))
    assert len(graph.skip) == 1
    fixed[fixed == 0] = -1
    belief = pii.beliefs(field, graph, fixed, 12)
    assert pii.LABELS[belief[-1].argmax()] == "phone"
    alone = pii.beliefs(field, pii.graph_of("9885552485"), pii.np.array([-1]), 12)
    assert pii.LABELS[alone[-1].argmax()] == ""


def test_messages_are_exact_on_a_tree():
    """Against all labellings of a chain of three tokens."""
    rng = pii.np.random.default_rng(0)
    size = len(pii.LABELS)
    both = rng.normal(size=(size, size))
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, size)), both + both.T, both + both.T)
    graph = pii.graph_of("1a 22 b@c")
    assert graph.chain.tolist() == [[0, 1], [1, 2]]
    own = graph.features @ field.node
    total = own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :]
    total = pii.np.exp(total + field.chain[:, :, None] + field.chain[None, :, :])
    total /= total.sum()
    got = pii.beliefs(field, graph, pii.np.full(3, -1), 60)
    for k, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        assert pii.np.allclose(got[k], total.sum(axis=axes), atol=1e-6)


def test_redaction(documents):
    text = "a bc@d.ee, 1.2.3.4 é 𝔸 +12 345 6789 end"
    docs = pii.with_spans(documents((1, text), (2, None), (3, "none")), None)
    got = dict(docs.select("doc_id", pii.redacted(docs, F.col("pii.spans"))).collect())
    assert got == {1: "a [EMAIL], [IP] é 𝔸 [PHONE] end", 2: None, 3: "none"}
    listed = docs.where("doc_id = 1").select(F.sha2(pii.listed(F.col("pii.spans")).cast("binary"), 256))
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
    assert listed.first()[0] == hashlib.sha256(want.encode()).hexdigest()


def test_empty_table(documents):
    none = documents((1, "a")).where("false")
    assert pii.train(none) is None and pii.with_spans(none, None).count() == 0


def test_every_repeat_hears_the_evidence():
    """40 bare repeats of one number, and 400 more tokens between them; before and after it."""
    bare = " ".join(f"word 9885552485 word {k}x{k}" for k in range(40))
    node = pii.np.zeros((pii.N_FEATURES, len(pii.LABELS)))
    node[0, 0] = 1.0
    power = pii.np.eye(len(pii.LABELS)) * 4
    field = pii.Field(node, pii.np.zeros_like(power), power)
    for text in (f"+1 (988) 555-2485 {bare}", f"{bare} word +1 (988) 555-2485"):
        added = pii.added_spans(text, pii.base_spans(text), field)
        assert [(kind, text[a:b]) for kind, a, b in added] == [("phone", "9885552485")] * 40


def test_messages_settle():
    """Evidence at one end of a chain of 60 tokens, against exact sums along it."""
    size, n = len(pii.LABELS), 60
    field = pii.Field(pii.np.zeros((pii.N_FEATURES, size)), pii.np.eye(size) * 6.0, pii.np.eye(size))
    graph = pii.graph_of(" ".join(f"{chr(97 + k % 26)}{k}" for k in range(n)))
    assert len(graph.chain) == n - 1 and not len(graph.skip)
    fixed = pii.np.full(n, -1)
    fixed[0] = 4
    step = pii.np.exp(field.chain) / pii.np.exp(field.chain).sum(axis=1)[0]
    want = pii.np.linalg.matrix_power(step, n - 1)[4]
    assert pii.np.allclose(pii.beliefs(field, graph, fixed, 12)[-1], want, atol=1e-5)


def test_secrets_of_letters_enter_the_field():
    text = 'password = "correcthorsebattery" or user=some and later correcthorsebattery. end 1'
    graph = pii.graph_of(text)
    assert [text[a:b] for a, b in graph.spans.tolist()] == ["correcthorsebattery"] * 2 + ["1"]
    assert graph.skip.tolist() == [[0, 1]]
    assert pii.labels_of(graph, pii.secret_spans(text)).tolist() == [pii.LABELS.index("secret"), 0, 0]
    long = "password=abcdefghijklmnop " * 20_000
    assert len(pii.graph_of(long).spans) == 20_000


def test_sample_is_bounded_whatever_the_ids(spark, documents):
    seen = spark.sparkContext.accumulator(0)
    options = pii.Options(sample=20, drawn=60, steps=3)
    plain = pii.graph_of

    def counting(*given):
        seen.add(1)
        return plain(*given)

    pii.graph_of = counting
    try:
        for ids in ([7] * 400, [None] * 400, range(400)):
            rows = [(i, f"Write to user{k % 90}@mail.example.org or call {k % 90}") for k, i in enumerate(ids)]
            before = seen.value
            assert pii.train(documents(*rows).select("doc_id", "text"), options) is not None
            assert seen.value - before <= 20
    finally:
        pii.graph_of = plain


def test_messages_of_a_long_chain_end():
    field = pii.Field(np.zeros((pii.N_FEATURES, len(pii.LABELS))), *[
        np.full((len(pii.LABELS),) * 2, 0.1) + 2 * np.eye(len(pii.LABELS))
    ] * 2)
    text = " ".join(f"{k % 50}{k}" for k in range(5000))
    graph = pii.graph_of(text)
    fixed = np.full(len(graph.spans), -1)
    fixed[0] = 1
    belief = pii.beliefs(field, graph, fixed, 12, 30)
    assert np.isfinite(belief).all() and belief[0, 1] > 0.99
