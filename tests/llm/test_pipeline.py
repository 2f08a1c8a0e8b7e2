import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

EN = "the house and water with that from have this which their would about there people river".split()
DE = "der und nicht mit sich auch werden einer haben diese wurde zwischen straße über fluss".split()


def prose(words, seed, n=90):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice("abcdefgh") * (rng.random() < 0.4) for _ in range(n))


def corpus():
    rows = [(k, prose(EN if k % 2 else DE, k), "en" if k % 2 else "de", f"s{k % 3}") for k in range(60)]
    base = rows[5][1]
    rows += [(100 + k, base, "en", "s0") for k in range(20)]  # exact copies
    rows += [(200 + k, base.replace(base.split()[k], "edited", 1), "en", "s1") for k in range(10)]
    rows += [(300, prose(EN, 300, 30), "en", "s0"), (301, None, "en", "s0"), (302, "12 34 56", None, None)]
    rows += [(303, prose(EN, 700) + " write to a.b@mail.example.com or +1 (988) 555-2485", "en", None)]
    rows += [(304, "same " * 200, "en", "s2"), (305, prose(DE, 9, 5000), "de", "s2")]
    return rows


def test_stages_take_effect(documents, tmp_path):
    docs = documents(*corpus(), extra="language")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(docs.sparkSession, docs, "")
        if name != "packing":
            assert out.columns == docs.columns and out.schema["doc_id"] == docs.schema["doc_id"]
        out.write.parquet(str(tmp_path / name))
        docs = docs.sparkSession.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert ids["language_id"] == {r[0] for r in corpus()} - {301, 302}
    assert ids["quality_rules"] == ids["language_id"] - {300, 304}
    assert ids["near_dedup"] == {*range(60), 303, 305}
    assert ids["pii"] == ids["near_dedup"]
    text = {r.doc_id: r for r in kept["pii"]}
    assert text[303].text.endswith(" write to [EMAIL] or [PHONE]")
    assert text[303].n_chars == len(text[303].text)
    assert all(text[k].text == corpus()[k][1] for k in range(60))
    size = {}
    for r in kept["packing"]:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
    assert size == {k: len(r.text.split()) for k, r in text.items()}


def test_run_and_empty_table(documents, tmp_path):
    docs = documents(*corpus()).drop("row")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(docs.sparkSession, str(tmp_path)).select("doc_id").distinct().count() == 62
    docs.where(F.lit(False)).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(docs.sparkSession, str(tmp_path / "none")).count() == 0


def test_near_dedup_by_row(documents):
    """Null and repeated ids: one row of each group stays, and no other row goes."""
    base = prose(EN, 1)
    near = lambda k: base.replace(base.split()[k], "edited", 1)
    only_null, far = prose(EN, 2), [prose(EN, k) for k in range(3, 7)]
    rows = [
        (1, base), (None, near(3)), (None, far[0]), (None, far[1]),  # a null id joins 1
        (2, near(5)), (2, far[2]),  # 2 is a near-copy of 1, and another text
        (3, far[3]), (3, far[3]), (3, far[3].upper()),  # repeated rows
        (None, only_null), (None, only_null), (None, only_null + " more"),  # no id at all
        (None, None), (None, ""),
    ]
    docs = documents(*rows, extra="row_key")
    out = corpus_pipeline.drop_near_duplicates(docs.sparkSession, docs, "")
    assert out.columns == docs.columns
    left = [(r.doc_id, (r.text or "").lower()) for r in out.collect()]
    assert left.count((1, base)) == 1 and left.count((3, far[3])) == 1
    assert (None, far[0]) in left and (None, far[1]) in left and (2, far[2]) in left
    assert sum(text.startswith(only_null) for _, text in left) == 1
    assert left.count((None, "")) == 2 and len(left) == 8
