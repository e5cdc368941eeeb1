"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porespark.plans.lineage import cut

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# monotonically_increasing_id keeps the row's place in its partition in the low bits.
_PLACE_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apart(df: DataFrame, *more: Column) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by position and ``more`` beside them, and the new name of each column.

    Whatever the input's columns are called, they cannot clash with an operator's own.
    """
    new = {c: f"_in_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in new.items()], *more), new


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """0-based place of each row in a total order, for a table of any size.

    Rows are range-partitioned and sorted once and stored; a row's rank is its
    place in its partition plus the rows of all earlier partitions.  The only
    table that is broadcast has one row per partition.  Rows with equal order
    keys get distinct ranks; which of them comes first is open.
    """
    tagged = cut(df.repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))))
    parts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # of one row per partition
    earlier = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (tagged.join(F.broadcast(earlier), "_part")
            .withColumn(rank, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"))
