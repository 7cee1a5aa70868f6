"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form an indivisible group. Groups are first packed, hash
bucket by hash bucket, into parcels far smaller than a shard; the parcels, whose
number is bounded, are then packed into the shards. Both steps take items by
falling size and put each into the tightest bin that still holds it, found in a
balanced search tree of remaining capacities.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


class CapacityTree:
    """An ordered set of (remaining, bin): a root over leaves that split when
    full, so that a search and a change take logarithmic time."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []  # the greatest entry of each leaf but the last

    def add(self, entry: tuple[int, int]) -> None:
        at = bisect_left(self.tops, entry)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.tops.insert(at, leaf[half - 1])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least entry with at least ``size`` remaining."""
        entry = (size, -1)
        for at in range(bisect_left(self.tops, entry), len(self.leaves)):
            leaf = self.leaves[at]
            i = bisect_left(leaf, entry)
            if i < len(leaf):
                found = leaf.pop(i)
                if not leaf and len(self.leaves) > 1:
                    del self.leaves[at]
                    del self.tops[min(at, len(self.tops) - 1)]
                return found
        return None


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """A bin for each item, in the given order of falling size; an item above
    the capacity gets a bin of its own. None if that takes over ``most`` bins."""
    tree, out, bins = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if bins == most:
                return None
            found = (max(capacity, size), bins)
            bins += 1
        out.append(found[1])
        tree.add((found[0] - size, found[1]))
    return out


def pack_evenly(sizes: list[int], bins: int) -> list[int]:
    """A bin for each item (falling sizes) under the least capacity, to one part
    in 10,000, at which they fit. Items above a fair share stand alone."""
    alone, rest, left = 0, sum(sizes), bins
    while alone < len(sizes) and left > 1 and sizes[alone] * left > rest:
        rest, left, alone = rest - sizes[alone], left - 1, alone + 1
    items = sizes[alone:]
    if not items:
        return list(range(alone))
    low = max(math.ceil(rest / left), items[0])
    best, high = None, low
    step = max(1, rest // (left * 10_000))
    while best is None:
        best = best_fit_decreasing(items, high, left)
        if best is None:
            low, high, step = high + 1, high + step, step * 2
    while low < high and high - low > rest // (left * 10_000):
        middle = (low + high) // 2
        found = best_fit_decreasing(items, middle, left)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return [*range(alone), *[alone + b for b in best]]


def shard_rows(rows: DataFrame, shards: int = 40, grain: int = 256, bucket_groups: int = 200_000) -> DataFrame:
    """``rows`` with _print (group), _size and _at (order) -> also shard, slot.

    ``grain``: parcels to a shard, which bounds how unequal shards get;
    ``bucket_groups``: groups that one task packs. Rows of a group land in one
    shard. ``slot`` numbers a shard's rows from 0 without gaps, by prefix sums
    over hash ranges of a shard, so that no shard is sorted in one task.
    """
    groups = materialize(rows.groupBy("_print").agg(F.sum("_size").alias("_bytes")))
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    buckets, capacity = max(1, math.ceil(count / bucket_groups)), max(1, total // (shards * grain))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_bytes", "_print"], ascending=[False, True], ignore_index=True)
        parcels = best_fit_decreasing(pdf["_bytes"].tolist(), capacity)
        return pd.DataFrame({"_print": pdf["_print"], "_bytes": pdf["_bytes"], "_bucket": key[0], "_parcel": parcels})

    bucket = F.pmod(F.xxhash64("_print"), F.lit(buckets)).cast("int")
    packed = materialize(groups.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(pack, "_print string, _bytes long, _bucket int, _parcel int"))
    # At most twice total / capacity parcels, and one to a bucket.
    parcels = packed.groupBy("_bucket", "_parcel").agg(F.sum("_bytes").alias("_bytes")).toPandas()
    parcels = parcels.sort_values(["_bytes", "_bucket", "_parcel"], ascending=[False, True, True], ignore_index=True)
    parcels["shard"] = pd.Series(pack_evenly([int(x) for x in parcels["_bytes"]], shards), dtype="int32")
    schema = "_bucket int, _parcel int, shard int"
    placed = rows.sparkSession.createDataFrame(parcels[["_bucket", "_parcel", "shard"]].values.tolist(), schema)
    where = materialize(packed.join(placed, ["_bucket", "_parcel"]).select("_print", "shard"))
    out = materialize(rows.join(where, "_print").withColumn("_range", F.pmod(F.xxhash64("_at"), F.lit(1024)).cast("int")))
    counts = out.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_at", "_print")) - 1
    return out.join(materialize(counts), ["shard", "_range"]).withColumn("slot", (F.col("_first") + inside).cast("long")).drop("_range", "_first", "_bytes")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is ``bytes``: shards hold nearly equal sizes. Null texts form one
    group, apart from empty ones, and have no checksum. Where a group exceeds a
    fair share, it has its shard to itself and the rest are level. Repeated rows
    each have a slot of their own; rows that agree in id and text are told apart
    by nothing else, so which of them has which slot is open. Other columns of
    ``docs``, whatever their names, are not read.
    """
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    rows = docs.select("doc_id", size.alias("_size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("_print"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_at"))
    out = shard_rows(materialize(rows), shards)
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
