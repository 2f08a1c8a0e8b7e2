import random

import pytest

from ledgerproof.llm.quality import Limits, cleaned, quality_rules

PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi".split()


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randrange(9999)) for _ in range(n))


def counts(text):
    """The contract's counts, by hand."""
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def test_counts_by_hand(documents):
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c a b c", "a a a a a", "x\nx\n y\nx", "é ü  # $",
        "#*$%&|<>", prose(1), "same line\n" * 40, "a b c " * 3 + prose(2), "𝔸 𝔹\n𝔸 𝔹",
    ]
    found = quality_rules(documents(*enumerate(texts)))
    got = {r.doc_id: r for r in found.collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_random_counts(documents):
    rng = random.Random(5)
    texts = [
        "".join(rng.choice("ab \n") for _ in range(rng.randrange(120))) for _ in range(60)
    ]
    got = {r.doc_id: r for r in quality_rules(documents(*enumerate(texts))).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)


def test_boilerplate_goes_and_copies_stay(documents):
    limits = Limits(documents=5, share=0.0)
    notice = "All RIGHTS  reserved 2024 " + "notice " * 3
    rows = [(k, f"{prose(k)}\n{notice}\n{prose(k + 500)}", None, "a") for k in range(12)]
    rows += [(100 + k, f"{prose(77)}\n{prose(78)}", None, "a") for k in range(30)]  # copies
    rows += [(200, f"{(notice + chr(10)) * 30}{prose(9, 20)}", None, "a")]  # depleted
    rows += [(300, f"{prose(3)}\n{notice}", None, "b"), (301, None, None, None)]
    docs = documents(*rows)
    got = {r.doc_id: r for r in quality_rules(docs, limits).collect()}
    assert all(got[k].kept and got[k].n_removed_words == 7 for k in range(12))
    assert all(got[100 + k].kept and got[100 + k].n_removed_words == 0 for k in range(30))
    assert not got[200].kept and got[200].depleted
    assert got[300].n_removed_words == 0  # another host
    assert got[301].base_failed and not got[301].kept
    clean = {r.doc_id: r for r in cleaned(docs, limits=limits).collect()}
    assert clean[0].text == f"{prose(0)}\n{prose(500)}" and clean[0].n_chars == len(clean[0].text)
    assert clean[300].text == rows[-2][1] and set(clean) == {*range(12), *range(100, 130), 300}
    assert clean[0].row == "x"


def test_near_copies_keep_their_lines(documents):
    lines = [prose(k, 20) for k in range(10)]
    rows = []
    for k in range(60):  # each changes one line of the same text
        own = list(lines)
        own[k % 10] = prose(1000 + k, 20)
        rows.append((k, "\n".join(own), None, "a"))
    found = quality_rules(documents(*rows, (99, "\n".join(lines), None, "a")), Limits(documents=5, share=0.0))
    assert all(r.kept and r.n_removed_words == 0 for r in found.collect())


def test_repeated_rows_nulls_and_empty_table(documents):
    rows = [(1, prose(1)), (1, prose(1)), (None, prose(2), None, None), (None, None, None, None)]
    assert quality_rules(documents(*rows)).count() == 4
    assert cleaned(documents(*rows)).count() == 3
    none = documents((1, "a")).where("false")
    assert quality_rules(none).count() == 0 and cleaned(none).count() == 0


def test_long_text(documents):
    text = "\n".join(prose(k, 50) for k in range(2000))
    row = quality_rules(documents((1, text))).first()
    assert row.n_words == 100_000 and row.kept


@pytest.mark.parametrize("shared, own", [(1, 5), (5, 1), (10, 1), (10, 5), (20, 1), (20, 4)])
@pytest.mark.parametrize("place", ["before", "within"])
def test_blocks_of_shared_lines_go(documents, shared, own, place):
    block = [prose(9000 + k, 12) for k in range(shared)]
    rows = []
    for k in range(60):
        mine = [prose(100 * k + j, 14) for j in range(own)]
        at = 0 if place == "before" else shared // 2
        rows.append((k, "\n".join(block[:at] + mine + block[at:]), None, "a"))
    got = quality_rules(documents(*rows)).collect()
    assert {r.n_removed_words for r in got} == {12 * shared}
    assert all(r.depleted == (100 * 14 * own < 30 * r.n_words) for r in got)


def test_number_tables_stay(documents):
    rng = random.Random(8)
    rows = [
        (k, "\n".join(f"{rng.randrange(10**6)} {rng.randrange(10**6)}" for _ in range(40)) + "\n" + prose(k, 30))
        for k in range(100)
    ]
    got = quality_rules(documents(*rows)).collect()
    assert all(r.kept and r.n_removed_words == 0 for r in got)


def test_copies_with_changed_words_keep_their_lines(documents):
    rng = random.Random(9)
    lines = [prose(500 + k, 40).split(" ") for k in range(9)]
    rows = []
    for k in range(200):
        own = [list(line) for line in lines]
        for _ in range(3):
            line = rng.choice(own)
            line[rng.randrange(len(line))] = f"changed{rng.randrange(10**9)}"
        rows.append((k, "\n".join(map(" ".join, own)), None, "a"))
    got = quality_rules(documents(*rows)).collect()
    assert all(r.kept and r.n_removed_words == 0 for r in got)


def test_columns_of_any_name(spark, documents):
    from pyspark.sql import functions as F

    names = ["row_key", "removed_lines", "kept_row", "row", "digest", "host", "removed", "kept"]
    docs = documents((1, prose(1)), (2, "few words"), extra="own").select(
        "*", *[F.lit(k).alias(n) for k, n in enumerate(names)]
    )
    assert quality_rules(docs).count() == 2
    assert [r.asDict()["removed_lines"] for r in cleaned(docs).collect()] == [1]


def test_verdicts_follow_the_host_of_a_row(documents):
    notice = "All rights reserved by the owner of this page"
    rows = [(k, f"{prose(k)}\n{notice}", None, "a") for k in range(30)]
    rows += [(5, f"{prose(5)}\n{notice}", None, "b")]  # the same id and text at another host
    texts = sorted(r.text for r in cleaned(documents(*rows)).collect() if r.doc_id == 5)
    assert texts == sorted([prose(5), f"{prose(5)}\n{notice}"])
