"""Equi-joins whose keys may be hot: a key's rows on one side are dealt to salts, the other side asks every salt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def salted_join(asking: DataFrame, dealt: DataFrame, key: str, deal_by: str, limit: int) -> DataFrame:
    """``asking`` joined with ``dealt`` on ``key``; at most about ``limit`` rows of ``dealt`` share a key and salt.

    ``dealt`` should be a written table: it is read once to count and once to
    join.  Every pair comes out once; the columns of the sides must differ but
    for ``key``.
    """
    counted = dealt.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = counted.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))  # only the hot keys
    salts = F.coalesce("_salts", F.lit(1))
    right = dealt.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(deal_by), salts).cast("int")).drop("_salts")
    left = asking.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
