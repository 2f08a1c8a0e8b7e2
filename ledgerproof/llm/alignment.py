"""Alignment of two tokenizers' tokens through sparse incidence matrices.

Each tokenizer's tokens of a text are the rows of a token-byte incidence matrix in compressed sparse
rows (CSR), built by hand: a token holds a run of byte columns. The product A * B^T, by Gustavson's
row algorithm, has an entry for every pair of tokens whose bytes overlap, and its value is the number
of shared bytes: the overlap links. Places where tokens of both end cut a text into groups; the
product of the token-group incidence matrices has an entry for every pair of one group: the
shared-group links. Sizes of a product's rows are known before it is made (the symbolic phase), and
rows are made in blocks of bounded size.

How many documents hold a pair of token ids linked is counted over the whole corpus. Links are
written once per document, as distinct pairs and how often they stand; tasks count pairs before they
are shuffled, in tables of bounded size. The counts of the `frequent` most frequent pairs go to all
tasks, a bound on what is sent; the pairs beyond them are joined by key, so all links are counted.

Defined cases: a text that is null or empty, or whose token bytes differ from a space and the text,
has no tokens: zeros and an empty digest column. Rows that repeat an id or text count as documents of
their own. An empty table gives an empty result. Other columns are ignored, whatever their names.
Token ids are 32-bit, a text's tokens hold at least one byte each.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerproof.llm.common import fresh_folder, staged, table


@dataclass(frozen=True)
class Options:
    """Paths of the two vocabularies. `frequent`: pairs whose counts go to all tasks. `held`:
    distinct pairs a task counts before it hands them on. `block`: entries of a product made at
    once. `batch`: characters tokenized at once."""

    byte_level: str = public_tokenizers.path("byte_bpe_50k.json")
    pieces: str = public_tokenizers.path("piece_bpe_32k.model")
    frequent: int = 1 << 18
    held: int = 1 << 21
    block: int = 1 << 20
    batch: int = 1 << 18


DEFAULT = Options()


class Csr:
    """A 0/1 matrix: row i has its entries in the columns `indices[indptr[i]:indptr[i + 1]]`."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, width: int):
        self.indptr, self.indices, self.width = indptr, indices, width

    @classmethod
    def runs(cls, ends: np.ndarray) -> Csr:
        """Row i holds the columns from the end of row i - 1 up to `ends[i]`."""
        width = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]), np.arange(width), width)

    @classmethod
    def labels(cls, label: np.ndarray, width: int) -> Csr:
        """Row i holds the one column `label[i]`."""
        return cls(np.arange(len(label) + 1), label, width)

    def __len__(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.indptr))

    def transposed(self) -> Csr:
        """By counting: entries sorted by column, stable in their rows."""
        counts = np.bincount(self.indices, minlength=self.width)
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.concatenate([[0], np.cumsum(counts)]), self.rows()[order], len(self))


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Symbolic phase: how many terms each row of a * b adds up."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return terms[a.indptr[1:]] - terms[a.indptr[:-1]]


def products(a: Csr, b: Csr, block: int = DEFAULT.block):
    """Numeric phase, Gustavson: row i of a * b adds up the rows of b at the columns of row i of a.

    Yields `(rows, columns, values)` of the entries, in order, for blocks of rows of about `block`
    terms.
    """
    done = np.cumsum(product_sizes(a, b))
    sizes = np.diff(b.indptr)
    single = bool((sizes == 1).all())  # as where every byte has its one token
    start = 0
    while start < len(a):
        before = done[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(done, before + block, "right")))
        middle = a.indices[a.indptr[start]:a.indptr[end]]
        row = np.repeat(np.arange(start, end), np.diff(a.indptr[start:end + 1]))
        first, size = b.indptr[middle], sizes[middle]
        if single:
            column = b.indices[first]
        else:
            behind = np.cumsum(size)
            at = np.arange(behind[-1] if len(behind) else 0) + np.repeat(first - behind + size, size)
            row, column = np.repeat(row, size), b.indices[at]
        key = row * b.width + column
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, row, column = key[order], row[order], column[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        yield row[new], column[new], np.diff(new, append=len(key))
        start = end


@dataclass(frozen=True)
class Tokens:
    """The tokens of one text: ids and the byte offsets where they end."""

    ids: np.ndarray
    ends: np.ndarray


NONE = Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters for
    themselves, the other bytes in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """Byte-level BPE of the tokenizers library, on a space and the text.

    Where the file's merges are in the order of their ids, as in the given one, tiktoken encodes by
    the same ranks, in a third of the time. Texts with a run of `LONG` characters that may be one
    word go to the tokenizers library, which merges long words in less than quadratic time.
    """

    LONG = re.compile(r"\S{2000}|\s{2000}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        letters = byte_letters()
        self.bytes = [b""] * self.model.get_vocab_size()
        special = self.model.get_added_tokens_decoder()
        for entry, i in self.model.get_vocab(with_added_tokens=False).items():
            if i not in special:
                self.bytes[i] = bytes(map(letters.__getitem__, entry))
        for i, entry in special.items():
            self.bytes[i] = entry.content.encode()
        self.ranked = self.by_ranks(path, {b: i for i, b in enumerate(self.bytes) if i not in special})

    def by_ranks(self, path: str, ranks: dict[bytes, int]):
        """The tiktoken encoder, or None where ranks don't say the same as the file's merges."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made) or len(ranks) != len(made) + 256:
            return None
        return tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [
            None if self.ranked is None or len(t) >= 2000 and self.LONG.search(t)
            else self.ranked.encode_ordinary(" " + t) for t in texts
        ]
        rest = [k for k, ids in enumerate(out) if ids is None]
        found = self.model.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False)
        for k, e in zip(rest, found):
            out[k] = e.ids
        return out


class Pieces:
    """A sentencepiece model, which adds the space by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self.piece(i) for i in range(self.model.get_piece_size())]

    def piece(self, i: int) -> bytes:
        entry = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(entry[3:-1], 16)])
        return entry.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers, and what is needed of their vocabularies."""

    def __init__(self, options: Options):
        self.options = options
        self.models = ByteLevel(options.byte_level), Pieces(options.pieces)
        self.lengths = [np.array([len(b) for b in m.bytes]) for m in self.models]
        self.n_b = len(self.models[1].bytes)
        self.most = max(len(m.bytes) for m in self.models)
        # Ids as text with the mark that follows: within a side, between the sides, between groups.
        # Shorter ones are filled up with zero bytes.
        self.marked = np.array([f"{i}{mark}" for mark in ",|;" for i in range(self.most)], "S")

    def tokens(self, texts: list[str]) -> list[tuple[Tokens, Tokens]]:
        """The tokens of each text on both sides; none where a side's bytes differ from the text."""
        sides = [m.encode(texts) for m in self.models]
        out = []
        for k, text in enumerate(texts):
            expected = b" " + text.encode()
            ids = [side[k] for side in sides]
            same = text != "" and all(
                b"".join(map(m.bytes.__getitem__, i)) == expected for m, i in zip(self.models, ids)
            )
            out.append(tuple(
                Tokens(np.array(i), np.cumsum(n[i])) for i, n in zip(ids, self.lengths)
            ) if same else (NONE, NONE))
        return out

    def groups_text(self, a: Tokens, b: Tokens, groups: tuple[Csr, Csr]) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: the ids of both sides, group by group."""
        label = [g.indices for g in groups]
        ends = [np.cumsum(np.bincount(g, minlength=groups[0].width)) for g in label]
        # A token stands behind the other side's tokens of all earlier groups, or of its own as well.
        place_a = np.arange(len(a.ids)) + np.concatenate([[0], ends[1]])[label[0]]
        place_b = np.arange(len(b.ids)) + ends[0][label[1]]
        flat = np.empty(len(a.ids) + len(b.ids), np.int64)
        flat[place_a], flat[place_b] = a.ids, b.ids
        flat[place_a[ends[0] - 1]] += self.most
        flat[place_b[ends[1] - 1]] += 2 * self.most
        return self.marked[flat].tobytes().translate(None, b"\0")[:-1]

    def batches(self, texts: list[str | None]):
        """The texts' tokens, tokenized in lists of about `batch` characters."""
        part, held = [], 0
        for text in texts:
            part.append(text or "")
            held += len(part[-1])
            if held >= self.options.batch:
                yield from zip(part, self.tokens(part))
                part, held = [], 0
        yield from zip(part, self.tokens(part))


def cuts_of(a: Tokens, b: Tokens) -> np.ndarray:
    """The offsets where tokens of both sides end."""
    if not len(a.ends):
        return a.ends
    ends = np.zeros(int(a.ends[-1]) + 1, bool)
    ends[a.ends] = True
    return b.ends[ends[b.ends]]


def overlap_links(a: Tokens, b: Tokens, block: int = DEFAULT.block):
    """Blocks of `(place in a, place in b, shared bytes)` of the tokens that overlap."""
    return products(Csr.runs(a.ends), Csr.runs(b.ends).transposed(), block)


def group_incidence(t: Tokens, cuts: np.ndarray) -> Csr:
    return Csr.labels(np.searchsorted(cuts, t.ends), len(cuts))


def group_links(a: Tokens, b: Tokens, block: int = DEFAULT.block):
    """Blocks of `(place in a, place in b, 1)` of the tokens that share a group."""
    cuts = cuts_of(a, b)
    return products(group_incidence(a, cuts), group_incidence(b, cuts).transposed(), block)


def n_group_links(groups: tuple[Csr, Csr]) -> int:
    """How many shared-group links there are; only the symbolic phase is needed."""
    return int(product_sizes(groups[0], groups[1].transposed()).sum())


MEASURES = (
    "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
    "pairs binary, times binary"
)


def measured(aligner: Aligner, a: Tokens, b: Tokens) -> tuple:
    """The fields of MEASURES; `pairs` are the distinct id pairs as a * n_b + b, in order, each as
    the distance to the one before, `times` how often they stand (both 64- and 32-bit integers)."""
    if not len(a.ids):
        return 0, 0, 0, 0, 0, "", b"", b""
    cuts = cuts_of(a, b)
    groups = group_incidence(a, cuts), group_incidence(b, cuts)
    blocks = [
        np.unique(a.ids[rows] * aligner.n_b + b.ids[columns], return_counts=True)
        for rows, columns, _ in overlap_links(a, b, aligner.options.block)
    ]
    found, n = blocks[0] if len(blocks) == 1 else summed(*map(np.concatenate, zip(*blocks)))
    return (
        len(a.ids), len(b.ids), len(cuts), int(n.sum()), n_group_links(groups),
        sha256(aligner.groups_text(a, b, groups)).hexdigest(),
        np.diff(found, prepend=0).astype("<i8").tobytes(), n.astype("<u4").tobytes(),
    )


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their weights."""
    if not len(keys):
        return keys, weights
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights, len(found)).astype(np.int64)


def pairs_in(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(pairs, "<i8")), np.frombuffer(times, "<u4")


def alignments(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = DEFAULT
) -> DataFrame:
    """`row, doc_id` and the fields of MEASURES per row, written to the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        F.col(text).alias("t"),
    )
    kind = StructType.fromDDL(MEASURES)

    def run(parts):
        aligner = Aligner(options)
        for part in parts:
            texts = part.column(2).to_pylist()
            found = [measured(aligner, *tokens) for _, tokens in aligner.batches(texts)]
            fields = [
                pa.array([f[k] for f in found], TYPES[field.dataType.simpleString()])
                for k, field in enumerate(kind)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *fields], ["row", "doc_id", *kind.names]
            )

    path = fresh_folder(spark, "aligned")
    rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *kind.fields])).write.option(
        "compression", "zstd"
    ).parquet(path)
    return spark.read.parquet(path)


TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shared_group: bool = False,
    options: Options = DEFAULT,
) -> DataFrame:
    """One row per link of each text: `doc_id, a_place, a_id, b_place, b_id, n`.

    Overlap links with the number of shared bytes, or shared-group links with n = 1.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def run(parts):
        aligner = Aligner(options)
        make = group_links if shared_group else overlap_links
        for part in parts:
            ids, texts = part.column(0), part.column(1).to_pylist()
            for k, (_, (a, b)) in enumerate(aligner.batches(texts)):
                for i, j, n in make(a, b, options.block):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[k].as_py()] * len(i), ids.type),
                        *map(pa.array, (i, a.ids[i], j, b.ids[j], n.astype(np.int64))),
                    ], ["doc_id", "a_place", "a_id", "b_place", "b_id", "n"])

    longs = StructType.fromDDL("a_place long, a_id long, b_place long, b_id long, n long")
    return rows.mapInArrow(run, StructType(
        [StructField("doc_id", rows.schema["doc_id"].dataType), *longs.fields]
    ))


def pair_counts(aligned: DataFrame, n_b: int, options: Options = DEFAULT) -> DataFrame:
    """`pair, n, best`: in how many documents a pair is linked, and whether no other pair of its A id
    is linked in more."""

    def run(parts):
        keys, weights = [], []
        size, limit = 0, options.held

        def handed():
            found, n = summed(np.concatenate(keys), np.concatenate(weights))
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pair", "n"])

        for part in parts:
            for pairs, times in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = pairs_in(pairs, times)[0]
                keys.append(found)
                weights.append(np.ones(len(found), np.int64))
                size += len(found)
                if size >= limit:
                    found, n = summed(np.concatenate(keys), np.concatenate(weights))
                    keys, weights, size = [found], [n], len(found)
                    if size > limit // 2:
                        yield handed()
                        keys, weights, size = [], [], 0
        if keys:
            yield handed()

    counted = staged(aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy(
        "pair"
    ).agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {n_b}")))
    return staged(counted.join(
        counted.groupBy("a").agg(F.max("n").alias("most")), "a"
    ).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent_pairs(counts: DataFrame, options: Options = DEFAULT):
    """The pairs with the highest counts, at most `frequent`, in order, with `n` and `best`."""
    rows = counts.orderBy(F.desc("n"), "pair").limit(options.frequent).toArrow()
    found = [rows.column(c).to_numpy() for c in ("pair", "n", "best")]
    order = np.argsort(found[0])
    return [np.asarray(f)[order] for f in found]


def counted_links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = DEFAULT
) -> DataFrame:
    """Per row: `doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256`, `count_sum` (over its
    overlap links, the documents that hold the pair of ids) and `n_best` (links whose pair no other
    pair of the A id exceeds)."""
    spark = docs.sparkSession
    aligned = alignments(docs, doc_id, text, options)
    counts = pair_counts(aligned, Aligner(options).n_b, options)
    known, known_n, known_best = frequent_pairs(counts, options)
    plain = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(parts):
        for part in parts:
            out = []
            columns = part.column("pairs").to_pylist(), part.column("times").to_pylist()
            for pairs, times in zip(*columns):
                pair, n = pairs_in(pairs, times)
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                out.append((
                    int((known_n[at[hit]] * n[hit]).sum()), int((known_best[at[hit]] * n[hit]).sum()),
                    pair[~hit], n[~hit].astype(np.int64),
                ))
            whole, best, rest, times = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [*map(part.column, plain), pa.array(whole, pa.int64()), pa.array(best, pa.int64()),
                 pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                [*plain, "whole", "best", "rest", "times"],
            )

    extra = StructType.fromDDL("whole long, best long, rest array<long>, times array<long>")
    path = fresh_folder(spark, "looked-up")
    aligned.mapInArrow(run, StructType(
        [*[aligned.schema[c] for c in plain], *extra.fields]
    )).write.option("compression", "zstd").parquet(path)
    looked_up = spark.read.parquet(path)
    rest = looked_up.where(F.size("rest") > 0).select(
        "row", F.explode(F.arrays_zip("rest", "times")).alias("x")
    ).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    others = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("times")).alias("more"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
    )
    return looked_up.drop("rest", "times").join(others, "row", "left").select(
        *[c for c in plain if c != "row"],
        (F.col("whole") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
    )


def op11_incidence_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return counted_links(table(spark, folder, "documents"))


QUERIES = {"op11_incidence_alignment": op11_incidence_alignment}
