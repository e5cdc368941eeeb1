"""Ranks, running sums and quantiles inside groups of any size.

A window function sends each group to one task.  That is the cheapest plan
while groups are moderate, but a sample may hold a third of all rows.  Each
operator here measures the largest group first: below ``WINDOW_ROWS`` it uses a
plain window, above it a range-partitioned plan in which a group spans many
tasks and only per-partition totals are combined.  Both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespark.plans.lineage import cut

WINDOW_ROWS = 2_000_000
TASK_ROWS = 250_000    # rows of a task that sorts for windows, unless one group has more


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Row counts of the largest group and of all (two-stage aggregate, two numbers back)."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n"), F.sum("count").alias("all")).first()
    return int(row["n"] or 0), int(row["all"] or 0)


def _tasks(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` hashed by ``keys`` to tasks of about TASK_ROWS rows, ahead of windows.

    Adaptive coalescing and a fixed shuffle width go by compressed bytes or not by the
    input at all; the sorts of several windows in one task then grow with the input.
    """
    if rows <= TASK_ROWS:
        return df
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(width, math.ceil(rows / TASK_ROWS)), *keys)


def _spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by (keys, order) and tag rows with (_part, _row)."""
    by = [F.col(k) for k in keys] + list(order)
    tagged = (df.repartitionByRange(*by).sortWithinPartitions(*by)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id()))
    return cut(tagged)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  pos: str = "pos", window_rows: int | None = None) -> DataFrame:
    """1-based row number of each row in its group.  ``order`` must be total."""
    limit = WINDOW_ROWS if window_rows is None else window_rows
    top, rows = group_sizes(df, keys)
    if top <= limit:
        w = Window.partitionBy(*keys).orderBy(*order)
        return _tasks(df, keys, rows).withColumn(pos, F.row_number().over(w).cast("long"))
    tagged = _spread(df, keys, order)
    pieces = (tagged.groupBy("_part", *keys)
              .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (pieces.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .drop("_n"))
    return (tagged.join(pieces, ["_part", *keys])
            .withColumn(pos, F.col("_offset") + F.col("_row") - F.col("_first") + 1)
            .drop("_part", "_row", "_first", "_offset"))


def with_positions(df: DataFrame, keys: Sequence[str], orders: dict[str, Sequence[Column]],
                   window_rows: int | None = None) -> DataFrame:
    """Several positions at once; one size check, one exchange on the window path."""
    limit = WINDOW_ROWS if window_rows is None else window_rows
    top, rows = group_sizes(df, keys)
    if top <= limit:
        df = _tasks(df, keys, rows)
        for name, order in orders.items():
            df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        return df
    for name, order in orders.items():
        df = with_position(df, keys, order, name, window_rows=0)
    return df


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                     value: str, out: str, window_rows: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in each group under a total order."""
    limit = WINDOW_ROWS if window_rows is None else window_rows
    top, rows = group_sizes(df, keys)
    if top <= limit:
        w = (Window.partitionBy(*keys).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return _tasks(df, keys, rows).withColumn(out, F.sum(value).over(w))
    tagged = _spread(df, keys, order)
    local = (Window.partitionBy("_part", *keys).orderBy("_row")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (tagged.groupBy("_part", *keys).agg(F.sum(value).alias("_t"))
              .withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
              .drop("_t"))
    return (tagged.withColumn("_local", F.sum(value).over(local))
            .join(pieces, ["_part", *keys])
            .withColumn(out, F.col("_base") + F.col("_local"))
            .drop("_part", "_row", "_local", "_base"))


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str],
                      out: str, window_rows: int | None = None) -> DataFrame:
    """Tie-averaged ascending rank of a non-null ``value`` in each group."""
    limit = WINDOW_ROWS if window_rows is None else window_rows
    top, rows = group_sizes(df, keys)
    if top <= limit:
        w = Window.partitionBy(*keys).orderBy(value)
        same = Window.partitionBy(*keys, value)
        return _tasks(df, keys, rows).withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0)
    placed = with_position(df, keys, [F.col(value), *[F.col(t) for t in tie]], "_pos", limit)
    ranks = placed.groupBy(*keys, value).agg(F.avg("_pos").alias(out))
    return placed.drop("_pos").join(ranks, [*keys, value])


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    tie: Sequence[str], window_rows: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of the non-null values, one row per group."""
    limit = WINDOW_ROWS if window_rows is None else window_rows
    df = df.filter(F.col(value).isNotNull())
    top, rows = group_sizes(df, keys)
    if top <= limit:
        return _tasks(df, keys, rows).groupBy(*keys).agg(
            *[F.percentile(F.col(value), F.lit(p)).alias(name) for name, p in probs.items()])
    placed = with_position(df, keys, [F.col(value), *[F.col(t) for t in tie]], "_pos", limit)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.select(*keys, value, "_pos").join(counts, list(keys))
    exprs, wanted = [], F.lit(False)
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, frac = F.floor(h), h - F.floor(h)
        at_lo, at_hi = F.col("_pos") == lo + 1, F.col("_pos") == F.ceil(h) + 1
        wanted = wanted | at_lo | at_hi
        low, high = F.max(F.when(at_lo, F.col(value))), F.max(F.when(at_hi, F.col(value)))
        exprs.append((low + (high - low) * F.max(frac)).alias(name))
    return joined.filter(wanted).groupBy(*keys).agg(*exprs)
