"""Problem 7: filling containers of fixed capacity by harmonic packing.

Lengths are partitioned into reciprocal classes, C/(k+1) < s <= C/k, and each
of these into finer ones with a bound u of their own.  A container is laid out
by bounds alone: of its class it takes a fixed count, C/u rounded down, and the
room that is then left by the bounds holds a fixed count of each smaller class
that fits.  Whatever the lengths within their classes, no container overflows,
so whole series of containers are filled at once, and every worker fills its
own without asking anyone.

An item longer than the capacity is first cut into full containers and a
remainder; no other item is split.  Items are dealt to workers by a hash of
their key, about ``SHARD_ITEMS`` to each, so no group depends on a class, a
length or a source.

Defined results: an item of length 0 or null takes no space and is filed in
the shard's first container; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
SHARD_ITEMS = 20_000
#: A class is at most this share of its bound wide.
FINE = 64


@lru_cache(maxsize=8)
def class_bounds(capacity: int, fine: int = FINE) -> np.ndarray:
    """Ascending bounds of the classes: every C/k, and finer ones between them."""
    bounds, u = {capacity // k for k in range(1, capacity + 1)}, capacity
    while u > 0:
        bounds.add(u)
        u -= max(1, u // fine)
    return np.array(sorted(bounds))


def harmonic_fill(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item; 0-based and dense.  Items are at most ``capacity`` long."""
    bounds, lengths = class_bounds(capacity), np.asarray(sizes, np.int64)
    of = np.searchsorted(bounds, lengths)
    of[lengths == 0] = -1
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(bounds)))
    left = np.bincount(of[of >= 0], minlength=len(bounds))
    bins, opened = np.zeros(len(lengths), np.int64), 0
    filled = [int(c) for c in np.flatnonzero(left)[::-1]]  # classes with items, the largest first
    while filled:
        room, layout = capacity, []
        for c in filled:
            count = min(room // int(bounds[c]), int(left[c]))
            if count:
                layout.append((c, count))
                room -= count * int(bounds[c])
        alike = min(int(left[c]) // count for c, count in layout)  # containers of this layout
        for c, count in layout:
            taken = order[start[c] : start[c] + alike * count]
            bins[taken] = opened + np.repeat(np.arange(alike), count)
            start[c] += alike * count
            left[c] -= alike * count
        opened += alike
        filled = [c for c in filled if left[c]]
    return bins.tolist()


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(container_id, key, piece, start, length)``, one row per item or piece of an item."""
    whole = items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    pieces = whole.select(
        "key", "size",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece"),
    ).select(
        "key", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("bigint") * capacity).alias("length"),
    )
    total = pieces.count()
    shards = max(1, math.ceil(total / shard_items))
    kind = whole.schema["key"].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece"], kind="stable", ignore_index=True)
        bins = np.asarray(harmonic_fill(pdf["length"].tolist(), capacity), dtype=np.int64)
        return pdf.assign(container_id=pdf["shard"].astype(np.int64) * (1 << 32) + bins)[["container_id", "key", "piece", "start", "length"]]

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int"))
    packed = sharded.groupBy("shard").applyInPandas(fill, f"container_id bigint, key {kind}, piece int, start bigint, length bigint")
    return packed.withColumnRenamed("key", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers used, the least number possible by volume, and the share left unused."""
    used = packed.groupBy("container_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("items"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity).alias("least_containers"),
        F.coalesce(F.max("fill"), F.lit(0)).alias("fullest"),
        (1 - F.sum("fill") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
