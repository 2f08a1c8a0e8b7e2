import random

from pyspark.sql import functions as F

from ledgerproof.llm.language import Classifier, Options, held_out, language_id

EN = "the house and water with that from have this which their would about there people river".split()
DE = "der und nicht mit sich auch werden einer haben diese wurde zwischen straße über fluss".split()


def text(words, seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def test_held_out_accuracy_and_cases(documents):
    rows = [(k, text(EN if k % 2 else DE, k), "en" if k % 2 else "de", "s") for k in range(120)]
    rows += [
        (500, None, "en", "s"), (501, "", None, "s"), (502, "12 -- ½ !", "en", "s"),
        (503, text(EN, 9).upper(), None, None), (None, text(DE, 3), "de", "s"),
        (504, text(EN, 1, 20) + " " + text(DE, 1, 20), "de", "s"), (7, rows[7][1], "en", "s"),
        (505, text(DE, 2, 30_000), None, "s"),
    ]
    found = language_id(documents(*rows, extra="score")).select(
        "doc_id", "lang", held_out(F.col("doc_id")).alias("h"), "language.*"
    ).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 120:
            assert r.lang_pred == r.lang and not r.rejected and 0 < r.score <= 1
    got = {r.doc_id: r for r in found}
    for k in (500, 501, 502):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[503].lang_pred == "en" and got[None].lang_pred == "de" and got[505].lang_pred == "de"
    assert {r.h for r in found} == {True, False}


def test_label_of_held_out_rows_is_never_read(documents):
    rows = [(k, text(EN if k % 2 else DE, k), "en" if k % 2 else "de", "s") for k in range(60)]
    docs = documents(*rows)
    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (
        {r.doc_id: r.lang_pred for r in language_id(d).select("doc_id", "language.*").collect()}
        for d in (docs, wrong)
    )
    assert a == b


def test_no_labels_and_empty_table(documents):
    assert language_id(documents((1, "some words"))).first().language.lang_pred == "und"
    assert language_id(documents((1, "a")).where("false")).count() == 0


def test_narrow_margin_is_rejected():
    model = Classifier({"a": b"one two three four", "b": b"one two three four"}, Options())
    lang, score, rejected = model.classify("one two three four")
    assert (lang, score, rejected) == ("a", 0.0, True)


def test_same_as_compressing_with_every_dictionary(documents):
    import re

    import zstandard

    from ledgerproof.llm import language

    words = {"en": EN, "de": DE, "xx": EN[:7] + DE[:7]}
    rows = [(k, text(words[lang], k, 40), lang, "s") for k, lang in enumerate(list(words) * 40)]
    rows += [(900 + k, text(EN + DE, k, 70), None, "s") for k in range(30)]
    docs = documents(*rows)
    options = Options()
    learned = language.learned(docs.where(~held_out(F.col("doc_id"))), options)
    assert set(learned) == set(words)

    def size(plain, content):
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        total = 0
        for at in range(0, len(plain), options.block):
            one = zstandard.ZstdCompressor(
                level=options.level, dict_data=shared, write_checksum=False, write_content_size=False,
                write_dict_id=False,
            )
            total += len(one.compress(plain[at:at + options.block]))
        return total

    got = {r.doc_id: r for r in language_id(docs, options).select("doc_id", "language.*").collect()}
    for doc_id, t, *_ in rows:
        plain = " ".join(re.findall(r"[^\W\d_]+", t.lower())).encode()
        sizes = sorted((size(plain, content), lang) for lang, content in learned.items())
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        r = got[doc_id]
        assert (r.lang_pred, r.rejected) == (sizes[0][1], margin < options.margin)
        assert abs(r.score - margin) < 1e-9


def test_sample_is_bounded_whatever_the_ids(documents):
    from ledgerproof.llm import language

    options = Options(sample_rows=5, excerpt=200)
    for ids in ([7] * 300, [None] * 300, range(300)):
        rows = [(i, text(EN, k % 60), "en", "s") for k, i in enumerate(ids)]
        found = language.learned(documents(*rows), options)
        assert found["en"].count(b"\n") == 4
