"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Bins are ordered by the room left in them and carry bitmaps of the sources and duplicate clusters
they hold. An item goes to the tightest bin with room for it; if its source or cluster is there
already, the search goes on to the successor, until a compatible bin is found or a new one opens.

Only `(id, size, source, cluster)` is shuffled, never text. Items are dealt by hash to shards of a
bounded number of rows, so that neither a hot source nor a large cluster gathers in one task, and
each shard is packed by itself, largest items first. A document larger than a bin is cut into full
bins and one rest, which is packed like any other item.

Defined cases: a null or empty text has size 0 and is packed like the others; null sources are one
source, null clusters conflict with nothing; repeated rows are items of their own, told apart by
`item`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import WORD_GAP, lower_ascii, staged, table, words_of


@dataclass(frozen=True)
class Options:
    """`capacity`: tokens per bin. `shard_rows`: about how many documents are packed together."""

    capacity: int = 2048
    shard_rows: int = 4000


DEFAULT = Options()


def pack(items, capacity: int) -> tuple[list[tuple[int, int]], int]:
    """Best-fit of `(size, source, cluster)` in the given order, sizes at most `capacity`.

    Returns `(bin, offset)` for each item, and the number of bins. A cluster of None conflicts with
    nothing.
    """
    rooms: list[tuple[int, int]] = []  # (room, bin), ordered
    sources: list[int] = []  # bitmap of each bin
    clusters: list[int] = []
    source_bits: dict = {}
    cluster_bits: dict = {}
    # A cluster with one item here can't conflict and needs no bit.
    shared = {c for c, n in Counter(c for _, _, c in items if c is not None).items() if n > 1}
    placed = []
    for size, source, cluster in items:
        source_bit = 1 << source_bits.setdefault(source, len(source_bits))
        cluster_bit = 0
        if cluster in shared:
            cluster_bit = 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms):
            b = rooms[at][1]
            if not (sources[b] & source_bit or clusters[b] & cluster_bit):
                break
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source_bit
        clusters[b] |= cluster_bit
        placed.append((b, capacity - room))
        insort(rooms, (room - size, b))
    return placed, len(sources)


def sized(
    docs: DataFrame, doc_id: str, text: str, source: str, size: Column | None,
    cluster: Column | None,
) -> DataFrame:
    """`doc_id, size, source, cluster`: by default the number of words, and a digest of the text
    without regard to case and white space. Source and cluster are text, so that null stays apart from
    every value of any type."""
    plain = F.trim(F.regexp_replace(lower_ascii(F.col(text)), WORD_GAP, " "))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.size(words_of(F.col(text))) if size is None else size).cast("long").alias("size"),
        F.col(source).cast("string").alias("source"),
        (F.md5(plain) if cluster is None else cluster.cast("string")).alias("cluster"),
    )


def packed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    size: Column | None = None, cluster: Column | None = None, options: Options = DEFAULT,
) -> DataFrame:
    """One row per document, or per piece of a document larger than a bin:
    `doc_id, item, piece, start, n_tokens, bin, place`.

    Tokens `start` to `start + n_tokens` of the document stand at `place` in the bin.
    """
    rows = staged(
        sized(docs, doc_id, text, source, size, cluster)
        .withColumn("item", F.monotonically_increasing_id())
    )
    shards = max(1, -(-rows.count() // options.shard_rows))
    capacity = options.capacity

    def pack_shard(shard: pd.DataFrame) -> pd.DataFrame:
        total = shard["size"].fillna(0).astype("int64").to_numpy()
        full, rest = total // capacity, total % capacity
        alone = (full > 0) & (rest == 0)
        order = np.lexsort((shard["item"], -rest))
        order = order[~alone[order]]
        some = shard.iloc[order]
        # A null is None, or NaN in a column of nulls only.
        source, cluster = (
            [x if isinstance(x, str) else None for x in some[c]] for c in ("source", "cluster")
        )
        items = list(zip(rest[order].tolist(), source, cluster))
        placed, bins = pack(items, capacity)
        pieces = [
            (shard["item"].iat[k], int(full[k]), int(full[k]) * capacity, size, b, at)
            for k, (size, _, _), (b, at) in zip(order, items, placed)
        ]
        for k in np.flatnonzero(full):
            for piece in range(int(full[k])):
                pieces.append((shard["item"].iat[k], piece, piece * capacity, capacity, bins, 0))
                bins += 1
        out = pd.DataFrame(pieces, columns=["item", "piece", "start", "n_tokens", "bin", "place"])
        out["bin"] += int(shard["shard"].iat[0]) << 32
        return out

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    places = dealt.drop("doc_id").groupBy("shard").applyInPandas(
        pack_shard,
        "item long, piece long, start long, n_tokens long, bin long, place long",
    )
    return rows.select("doc_id", "item").join(places, "item").select(
        "doc_id", "item", "piece", "start", "n_tokens", "bin", "place"
    )


def bins_of(pieces: DataFrame) -> DataFrame:
    """`bin, n_documents, n_tokens` of every bin."""
    return pieces.groupBy("bin").agg(
        F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens")
    )


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
