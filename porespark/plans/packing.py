"""Group many small samples into bounded packs; split off the large ones.

A grouped pandas/Arrow call loads its group into one Python worker.  ``pack``
measures rows per sample, sends samples of at most ``limit`` rows to packs of
about ``target`` rows, and returns the rest separately for a distributed plan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNEL_ROWS = 4_000_000
PACK_ROWS = 400_000


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash by ``keys`` to the full shuffle width ahead of Python work.

    Adaptive coalescing sizes partitions by bytes; Python stages cost more per
    byte, so their width is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def split_by_size(df: DataFrame, limit: int | None = None,
                  target: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """``(small rows with a pack column, large rows)``; either may be None."""
    limit = KERNEL_ROWS if limit is None else limit
    target = PACK_ROWS if target is None else target
    sizes = df.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n").alias("top"), F.min("n").alias("low"),
                    F.sum(F.when(F.col("n") <= limit, F.col("n"))).alias("small")).first()
    if row["top"] is None:
        return None, None
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = max(width, math.ceil((row["small"] or 0) / target))
    pack = F.pmod(F.xxhash64("ms_id"), F.lit(packs)).alias("pack")

    def packed(rows: DataFrame) -> DataFrame:
        # an explicit width: rows are few but the work per row is in Python
        return rows.select("*", pack).repartition(packs, "pack")

    if row["top"] <= limit:
        return packed(df), None
    large_keys = sizes.filter(F.col("n") > limit).select("ms_id")
    large = df.join(large_keys, "ms_id", "left_semi")
    if row["low"] > limit:
        return None, large
    return packed(df.join(large_keys, "ms_id", "left_anti")), large
