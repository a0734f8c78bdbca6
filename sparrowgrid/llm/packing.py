"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are cut into pieces no longer than a bin.  Shards of rows dealt by a
hash of the id and a row number (so that repeated rows part) are packed apart (best fit, longest first): bins lie in order of
their residual room and carry two bitmaps, the sources that have reached their
limit there and the duplicate clusters present.  For a piece, the search starts
at the least residual that can take it and goes on to the next ones until the
tightest compatible bin is found; only then a new bin is opened.  A shard costs
at most one badly filled bin per source, however large the input is.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[^\x20\x09-\x0D]+"


class Bins:
    """The open bins of one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.room: list[int] = []
        self.full: list[int] = []  # bitmap of sources at their limit
        self.clusters: list[int] = []  # bitmap of duplicate clusters
        self.counts: list[dict[int, int]] = []
        self.order: list[int] = []  # residuals that some bin has, ascending
        self.at: dict[int, list[int]] = {}  # residual: its bins
        self.all_full: dict[int, int] = {}  # residual: sources at their limit in all its bins
        self.all_clusters: dict[int, int] = {}

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a piece; source is a bit number or -1, cluster a one-bit map or 0."""
        bit = 1 << source if source >= 0 else 0
        for k in range(bisect_left(self.order, size), len(self.order)):
            room = self.order[k]
            if bit & self.all_full[room] or cluster & self.all_clusters[room]:
                continue
            bins = self.at[room]
            for i, b in enumerate(bins):
                if not bit & self.full[b] and not cluster & self.clusters[b]:
                    del bins[i]
                    if not bins:
                        del self.order[k], self.at[room], self.all_full[room], self.all_clusters[room]
                    return b, self._put(b, size, source, bit, cluster)
        self.room.append(self.capacity)
        self.full.append(0)
        self.clusters.append(0)
        self.counts.append({})
        b = len(self.room) - 1
        return b, self._put(b, size, source, bit, cluster)

    def _put(self, b: int, size: int, source: int, bit: int, cluster: int) -> int:
        offset = self.capacity - self.room[b]
        self.room[b] = room = self.room[b] - size
        self.clusters[b] |= cluster
        if bit:
            self.counts[b][source] = n = self.counts[b].get(source, 0) + 1
            if n >= self.per_source:
                self.full[b] |= bit
        if room:
            if room in self.at:
                self.at[room].append(b)
                self.all_full[room] &= self.full[b]
                self.all_clusters[room] &= self.clusters[b]
            else:
                insort(self.order, room)
                self.at[room] = [b]
                self.all_full[room], self.all_clusters[room] = self.full[b], self.clusters[b]
        return offset


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Adds bin (number within the shard) and bin_offset to a shard's pieces (size, source, cluster, and keys for ties)."""
    pieces = pieces.sort_values(["size", "__id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="first")
    sources = pd.factorize(pieces["source"])[0]
    counts = pieces.groupby("cluster")["cluster"].transform("size").fillna(0)
    repeated = pd.factorize(pieces["cluster"].where(counts > 1))[0]  # others can't conflict
    bins = Bins(capacity, per_source)
    placed = [
        bins.place(int(n), int(s), 1 << int(c) if c >= 0 else 0)
        for n, s, c in zip(pieces["size"], sources, repeated, strict=True)
    ]
    return pieces.assign(bin=[b for b, _ in placed], bin_offset=[o for _, o in placed])


def pack(
    df: DataFrame,
    capacity: int = 2048,
    per_source: int = 4,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    shard_rows: int = 16_384,
) -> DataFrame:
    """One row per piece: id, piece, source, n_words, start_word, bin_id, bin_offset.

    A document counts its words and one end mark; longer ones than ``capacity``
    are cut into full pieces and a rest, so nothing is dropped.  A bin holds at
    most ``per_source`` pieces of one source and at most one piece of a
    duplicate cluster: ``cluster`` names its column, else equal texts form a
    cluster (the full pieces of a document fill bins of their own and so never
    meet).  Null or empty texts are one end mark; null sources and null texts
    conflict with nothing; repeated rows are packed each on its own.  ``bin_id``
    is unique over all shards.
    """
    shards = max(1, -(-df.count() // shard_rows))
    key = F.md5(F.col(cluster).cast("string") if cluster else F.col(text))
    sized = df.select(
        F.col(id).alias("__id"),
        F.col(source).cast("string").alias("source"),
        key.alias("cluster"),
        F.monotonically_increasing_id().alias("row"),
        (F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)) + 1).cast("long").alias("words"),
    )
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / capacity).cast("int")))).select(
        F.pmod(F.xxhash64("__id", "row"), F.lit(shards)).alias("shard"),
        "__id",
        "source",
        "cluster",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start_word"),
        F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("long").alias("size"),
    )
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("bin", T.LongType()), T.StructField("bin_offset", T.LongType())]
    )
    packed = pieces.groupBy("shard").applyInPandas(lambda x: pack_shard(x, capacity, per_source), schema)
    return packed.select(
        F.col("__id").alias(id),
        "piece",
        "source",
        F.col("size").alias("n_words"),
        "start_word",
        (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"),
        "bin_offset",
    )
