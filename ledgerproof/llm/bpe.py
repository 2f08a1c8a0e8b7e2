"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold the merge rank of each pair of neighbouring symbols, and its root
the lowest one, leftmost first. Each merge changes three leaves and their paths to the root; it goes
on until the root holds no rank. Short words are merged side by side, one tree per row of an array;
long ones get a tree of their own, so a text without any blank still takes n log n steps.

Words are cached while a partition is read, up to a fixed number. Texts pass whole and in pieces of
bounded size.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the strings of
special tokens are those tokens; repeated rows are encoded alike; a null id is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import batches, table

CACHED_WORDS = 250_000
SEGMENT = 100_000  # words looked at together
LONG_WORD = 64  # symbols; longer words get a tree of their own
NO_PAIR = np.int64(1) << 62
PLACE = (1 << 32) - 1

# Unicode White_Space, which the tokenizer's patterns mean by \s.
SPACES = "\t-\r \x85\xa0  -     　"
SPACE_RUN = regex.compile(f"[{SPACES}]+")
# Python takes these for white space too, the tokenizer does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes are themselves, the others follow from
    U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Model:
    """A word BPE read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace("\\s", SPACES))
        self.added = added
        self.specials = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")"
        ) if added else None
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, number in {**vocab, **added}.items():
            self.tokens[number] = token
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.final = np.array([vocab[c + end] for c in byte_letters()], np.int64)
        #: Rank of a pair by its two symbols, and the symbol it becomes by its rank.
        self.rank = {}
        for number, (a, b) in enumerate(pairs):
            self.rank.setdefault((vocab[a], vocab[b]), number)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of many pairs; NO_PAIR where the two don't merge. A symbol below 0 is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def chunks_of(self, text: str):
        """The parts of a text between white space, in order; special tokens as their ids. No word
        goes beyond its chunk."""
        parts = self.specials.split(text) if self.specials else [text]
        for part in parts:
            if part in self.added:
                yield self.added[part]
            elif part:
                plain = lowered(unicodedata.normalize("NFC", part))
                yield from plain.split() if not SEPARATORS.search(plain) else SPACE_RUN.split(plain)

    def words_of(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [chunk] if chunk.isalpha() else self.words.findall(chunk)
        # Letters newer than the tokenizer's Unicode tables are signs to it.
        known = "".join("※" if unicodedata.category(c) == "Cn" else c for c in chunk)
        if known == chunk:
            return self.words.findall(chunk)
        return [chunk[m.start():m.end()] for m in self.words.finditer(known)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The token ids of each word, as little-endian unsigned 32-bit integers."""
        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        out: list = [b""] * len(words)
        for k in np.flatnonzero(size > LONG_WORD):
            out[k] = merge_one(self, symbols[ends[k] - size[k]:ends[k]]).astype("<u4").tobytes()
        narrow, width = 0, 2
        while width <= LONG_WORD:
            group = np.flatnonzero((size <= width) & (size > narrow))
            for some in batches(group, 1 << 14):
                merged, counts = merge_rows(self, symbols, ends[some] - size[some], size[some], width)
                blob, stop = merged.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                for k, a, b in zip(some.tolist(), (stop - 4 * counts).tolist(), stop.tolist()):
                    out[k] = blob[a:b]
            narrow, width = width, 2 * width
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids: the tokens with a blank between them."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def lowered(text: str) -> str:
    """Lower case of each character by itself; a final sigma is like any other."""
    return text.replace("Σ", "σ").lower()


def merge_one(model: Model, symbols: np.ndarray) -> np.ndarray:
    """Merge one word with a tree of Python ints: rank and place of the lowest pair below a node."""
    n = len(symbols)
    width = 1 << (n - 1).bit_length()
    none = int(NO_PAIR)
    ranks = model.pair_ranks(symbols[:-1], symbols[1:])
    at = np.flatnonzero(ranks >= 0)
    leaves = np.full(width, NO_PAIR)
    leaves[at] = ranks[at] << 32 | at
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    tree = [none] + [int(x) for level in reversed(levels) for x in level]
    sym, rank, merged = symbols.tolist(), model.rank, model.merged
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, key: int) -> None:
        node = place + width
        tree[node] = key
        while node > 1:
            node >>= 1
            low, high = tree[2 * node], tree[2 * node + 1]
            best = low if low < high else high
            if tree[node] == best:
                break
            tree[node] = best

    def key(place: int) -> int:
        if place < 0 or after[place] >= n:
            return none
        found = rank.get((sym[place], sym[after[place]]))
        return none if found is None else found << 32 | place

    while tree[1] != none:
        i = tree[1] & PLACE
        j = after[i]
        sym[i] = int(merged[tree[1] >> 32])
        sym[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    return np.array([s for s in sym if s >= 0], np.int64)


def merge_rows(
    model: Model, symbols: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Merge many words of at most `width` symbols (a power of two, 64 at most), one tree per row.
    Returns the symbols of all words in order, and how many each has."""
    n = len(starts)
    bits, none = width.bit_length() - 1, np.int32(2**31 - 1)
    places = np.arange(width, dtype=np.int32)
    there = places < size[:, None]
    # One more column on the right, always empty, is the end of every word.
    sym = np.full((n, width + 1), -1, np.int64)
    sym[:, :width][there] = symbols[(starts[:, None] + places)[there]]
    after = np.tile(np.arange(1, width + 2), (n, 1))
    after[:, width] = width
    before = np.tile(np.arange(-1, width), (n, 1))
    before[:, 0] = width
    tree = np.full((n, 2 * width), none, np.int32)
    ranks = model.pair_ranks(sym[:, :-1], sym[:, 1:])
    tree[:, width:] = np.where(ranks >= 0, ranks << bits | places, none)
    for level in range(bits, 0, -1):
        half = 1 << (level - 1)
        np.minimum(
            tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2], out=tree[:, half:2 * half]
        )

    def put(row, place, key):
        node = place + width
        tree[row, node] = key
        for _ in range(bits):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def keys(row, place):
        found = model.pair_ranks(sym[row, place], sym[row, after[row, place]])
        return np.where(found >= 0, found << bits | place, none)

    row = np.flatnonzero(tree[:, 1] != none)
    while len(row):
        root = tree[row, 1]
        i = (root & (width - 1)).astype(np.int64)
        j = after[row, i]
        sym[row, i] = model.merged[root >> bits]
        sym[row, j] = -1
        follows = after[row, j]
        after[row, i] = follows
        inside = follows < width
        before[row[inside], follows[inside]] = i[inside]
        put(row, j, none)
        put(row, i, keys(row, i))
        p = before[row, i]
        has = p < width
        put(row[has], p[has], keys(row[has], p[has]))
        row = row[tree[row, 1] != none]
    kept = sym[:, :width]
    return kept[kept >= 0], (kept >= 0).sum(axis=1)


@cache
def model_of(path: str) -> Model:
    return Model(path)


class Words:
    """The ids of words and chunks met before; emptied when there are too many."""

    def __init__(self, model: Model):
        self.model, self.words, self.chunks = model, {}, {}

    def learn(self, chunks) -> None:
        parts = {c: self.model.words_of(c) for c in chunks}
        new = list({w for words in parts.values() for w in words if w not in self.words})
        if new:
            self.words.update(zip(new, self.model.encode_words(new)))
        known = self.words
        for chunk, words in parts.items():
            self.chunks[chunk] = b"".join([known[w] for w in words])

    def trim(self) -> None:
        for kept in (self.words, self.chunks):
            if len(kept) > CACHED_WORDS:
                kept.clear()


def encoded_texts(model: Model, texts, words: Words | None = None):
    """The token ids of each text as little-endian unsigned 32-bit integers."""
    words = words or Words(model)
    known = words.chunks
    waiting: list[tuple[int, list]] = []
    done: dict[int, list[bytes]] = {}
    count = 0

    def flush():
        words.learn({c for _, part in waiting for c in part if type(c) is str and c not in known})
        for k, part in waiting:
            done[k].append(b"".join([
                known[c] if type(c) is str else c.to_bytes(4, "little") for c in part
            ]))
        waiting.clear()
        words.trim()

    for k, text in enumerate(texts):
        done[k] = []
        chunks = model.chunks_of(text or "")
        while part := list(islice(chunks, SEGMENT)):
            waiting.append((k, part))
            count += len(part)
            if count >= SEGMENT:
                flush()
                count = 0
        if not waiting:
            for finished in sorted(done):
                yield b"".join(done.pop(finished))
    flush()
    for finished in sorted(done):
        yield b"".join(done.pop(finished))


def encode(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`doc_id, ids, decoded`: the ids as little-endian unsigned 32-bit integers, and the text they
    decode to. `tokenizer` is the path of the tokenizer file on every executor."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def run(parts):
        model = model_of(tokenizer)
        words = Words(model)
        for part in parts:
            numbers, ids, decoded, held = [], [], [], 0
            found = encoded_texts(model, (t.as_py() for t in part.column(1)), words)
            for number, data in zip(part.column(0), found):
                numbers.append(number)
                ids.append(data)
                decoded.append(model.decode(np.frombuffer(data, "<u4")))
                held += len(data)
                if held > 1 << 22:
                    yield packed(part.schema.field(0).type, numbers, ids, decoded)
                    numbers, ids, decoded, held = [], [], [], 0
            yield packed(part.schema.field(0).type, numbers, ids, decoded)

    return source.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def packed(kind, numbers, ids, decoded):
    return pa.RecordBatch.from_arrays(
        [
            pa.array([n.as_py() for n in numbers], kind), pa.array(ids, pa.binary()),
            pa.array(decoded, pa.string()),
        ],
        ["doc_id", "ids", "decoded"],
    )


def op10_segment_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return encode(table(spark, folder, "documents"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_segment_tree_bpe": op10_segment_tree_bpe}
