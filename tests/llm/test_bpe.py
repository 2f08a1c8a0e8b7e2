import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerproof.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = [
    None, "", "  \n", "Hello WORLD's  isn't I'LL", "<|endoftext|>x <|startoftext|><|endoftext|>", "é ñ ÅΣΑΣ İI",
    "日本語 ½ ٣ 𝔸 Ⅻ ", "a\x1cb\x1f \x85c d​e", "1234567890", "!!!??? ...", "x" * 5000, "abcab" * 700,
    "thequickbrownfox" * 300, "ȩ́ ﬁ", "a" * 64, "a" * 65, "ab" * 32,
]


def test_same_as_the_library():
    reference, model = Tokenizer.from_file(PATH), bpe.Model(PATH)
    rng = random.Random(1)
    letters = "abcdefgh ehtaoins éñ'12!Σ日\n"
    texts = CASES + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(300)]
    for text, data in zip(texts, bpe.encoded_texts(model, texts), strict=True):
        ids = np.frombuffer(data, "<u4")
        assert ids.tolist() == reference.encode(text or "", add_special_tokens=False).ids, text
        assert model.decode(ids) == reference.decode(ids.tolist(), skip_special_tokens=False)


def test_trees_agree_with_plain_merging():
    model = bpe.Model(PATH)
    rng = random.Random(2)
    for size in (1, 2, 3, 8, 17, 64, 65, 130):
        word = "".join(rng.choice("thein") for _ in range(size))
        coded = np.frombuffer(word.encode(), np.uint8)
        symbols = model.inner[coded]
        symbols[-1] = model.final[coded[-1]]
        plain = symbols.tolist()
        while True:
            pairs = [(model.rank[p], k) for k, p in enumerate(zip(plain, plain[1:])) if p in model.rank]
            if not pairs:
                break
            rank, k = min(pairs)
            plain[k:k + 2] = [int(model.merged[rank])]
        assert bpe.merge_one(model, symbols).tolist() == plain
        assert np.frombuffer(model.encode_words([word])[0], "<u4").tolist() == plain


def test_columns_and_empty_table(spark, documents):
    docs = documents((1, "Some text"), (1, "Some text"), (None, None), extra="ids")
    got = sorted(bpe.encode(docs, PATH).collect(), key=repr)
    assert len(got) == 3 and {r.decoded for r in got} == {"", "some</w> text</w>"}
    assert bpe.encode(docs.where("false"), PATH).count() == 0
    digests = {hashlib.sha256(bytes(r.ids)).hexdigest() for r in got}
    assert hashlib.sha256(b"").hexdigest() in digests


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    model = bpe.Model(PATH)
    texts = [f"alpha{k} beta gamma" for k in range(20)]
    monkeypatch.setattr(bpe, "SEGMENT", 4)
    assert list(bpe.encoded_texts(model, texts)) == [next(bpe.encoded_texts(model, [t])) for t in texts]
