"""Conflict-constrained best-fit packing.

Documents go into bins of fixed capacity. Bins stand in the order of their free room and carry bitmaps of the
sources and of the duplicate clusters in them. A document goes to the tightest bin that has room and no conflict: the
search starts at the first bin with enough room and walks on to the next roomier one until a bin is compatible; if
none is, a new bin opens. A bin never holds two documents of a cluster, nor more than `per_source` of a source (one
bitmap per allowed document, filled in turn).

Rows are dealt to shards of about `shard_rows` by a hash of their contents, so a hot source or a large cluster is spread
evenly and bins do not depend on how the files lie; equal rows are counted first and their copies dealt in lots of at
most COPIES. Each shard is packed in decreasing size by one task whose memory the shard bounds. A longer document fills
whole bins of its own, and its rest is packed with the others. Nothing is dropped or cut off.

Clusters are any column of the table: `text_cluster` keys texts that are equal but for case and white space; component
ids of near copies, as the n-gram Jaccard join gives them, serve as well.

Edge cases: null or empty texts and null or negative sizes count as size 0, and such documents take place in the
result with a bin and no room used; a null source or cluster conflicts with nothing; repeated rows are packed each on
its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equal rows are dealt to shards in lots of so many.
COPIES = 64
SCHEMA = "doc_id bigint, piece int, size bigint, bin_id bigint, position bigint"


def text_cluster(text: Column) -> Column:
    """A cluster key of texts that are equal but for case and white space; null for empty texts."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and position of each item, for items no larger than the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    source_bit: dict = {}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    rooms: list[tuple[int, int]] = []  # free room and bin, in order
    planes: list[list[int]] = []
    marks: list[int] = []
    where, position = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size, mark = sizes[i], cluster_bit.get(clusters[i], 0)
        own = 0 if sources[i] is None else source_bit.setdefault(sources[i], 1 << len(source_bit))
        k = bisect_left(rooms, (size, -1))
        while k < len(rooms) and (marks[rooms[k][1]] & mark or planes[rooms[k][1]][-1] & own):
            k += 1
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(planes)
            planes.append([0] * per_source)
            marks.append(0)
        where[i], position[i] = b, capacity - room
        marks[b] |= mark
        for p, plane in enumerate(planes[b]):
            if not plane & own:
                planes[b][p] = plane | own
                break
        insort(rooms, (room - size, b))
    return where, position


def pack(df: DataFrame, id_col: str, size: Column, source: Column, cluster: Column, capacity: int = 32_768, per_source: int = 8, shard_rows: int = 8_192) -> DataFrame:
    """Rows (doc_id, piece, size, bin_id, position): where each piece of each document lies."""
    items = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
        F.xxhash64(source.cast("string")).alias("source_key"),
        source.isNull().alias("no_source"),
        cluster.cast("bigint").alias("cluster_key"),
    )
    shards = max(1, -(-df.count() // shard_rows))
    lots = items.groupBy(*items.columns).agg(F.count("*").alias("copies")).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))))
    lots = lots.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("lot") * COPIES).cast("int"))
    salted = lots.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "source_key", "cluster_key", "lot"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["shard"].iloc[0]) << 32
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].sort_values(["size", "doc_id", "source_key", "cluster_key"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["size"].to_numpy()
        full = np.maximum(sizes - 1, 0) // capacity
        rest = sizes - full * capacity
        sources = [None if n else s for s, n in zip(pdf["source_key"].tolist(), pdf["no_source"].tolist(), strict=True)]
        clusters = [None if c != c or c is pd.NA else c for c in pdf["cluster_key"].tolist()]
        where, position = pack_shard(rest.tolist(), sources, clusters, capacity, per_source)
        packed = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "piece": full.astype("int32"), "size": rest, "bin_id": base + np.array(where, np.int64), "position": np.array(position, np.int64)})
        if not full.any():
            return packed
        whole = np.repeat(np.arange(len(sizes)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        first = base + max(where, default=-1) + 1
        alone = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[whole], "piece": piece.astype("int32"), "size": np.full(len(whole), capacity), "bin_id": first + np.arange(len(whole)), "position": np.zeros(len(whole), np.int64)})
        return pd.concat([packed, alone])

    return salted.groupBy("shard").applyInPandas(run, SCHEMA)
