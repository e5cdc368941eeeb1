"""Rank and moment statistics per group, with p-values where the reference table has them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from porespark.plans.ordering import group_quantiles, with_average_rank


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, value = 1e-300, 1.0, 0.0, 1.0
    for i in range(500):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or tiny)
        c = (1.0 + term / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * (value - 1.0)


def correlation_p_value(r: float, n: float) -> float:
    """Two-sided Student-t p-value of a correlation coefficient."""
    if r is None or n is None or np.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2.0
    t2 = r * r * df / ((1.0 - r) * (1.0 + r))
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    out = [correlation_p_value(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(r, n)]
    return pd.Series([None if v is None or np.isnan(v) else v for v in out], dtype=float)


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str, tie: Sequence[str], prefix: str = "",
                 p_values: bool = False, window_rows: int | None = None) -> DataFrame:
    """Spearman (tie-averaged ranks) and Pearson per group over complete pairs."""
    sub = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *tie, x, y)
    ranked = with_average_rank(sub, keys, x, tie, "_rx", window_rows)
    ranked = with_average_rank(ranked, keys, y, tie, "_ry", window_rows)
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"), F.corr("_rx", "_ry").alias(f"{prefix}spearman"),
                                    F.corr(x, y).alias(f"{prefix}pearson"))
    for name in ("spearman", "pearson"):
        out = out.withColumn(f"{prefix}{name}", F.nanvl(f"{prefix}{name}", F.lit(None).cast("double")))
        if p_values:
            out = out.withColumn(f"{prefix}{name}_p", correlation_p(F.col(f"{prefix}{name}"), F.col(f"{prefix}n").cast("double")))
    return out


def mann_whitney_p_value(u1: float, n1: int, n2: int, tie_term: float) -> float:
    """Two-sided p-value: exact for a group of at most 8 without ties, else normal."""
    n = n1 + n2
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and tie_term == 0:
        small, large = min(n1, n2), max(n1, n2)
        ways = np.zeros((small + 1, small * large + 1))
        ways[0, 0] = 1.0
        # number of size-k subsets of 1..n by rank sum above the minimum
        for rank in range(1, n + 1):
            for k in range(min(small, rank), 0, -1):
                shift = rank - k
                if shift <= small * large:
                    ways[k, shift:] += ways[k - 1, :small * large + 1 - shift]
        dist = ways[small] / ways[small].sum()
        return float(min(1.0, 2.0 * dist[int(round(u)):].sum()))
    sd = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1))))
    if sd == 0:
        return 1.0
    z = (u - n1 * n2 / 2.0 - 0.5) / sd
    return float(min(1.0, math.erfc(z / math.sqrt(2.0))))


@F.pandas_udf(DoubleType())
def _mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else mann_whitney_p_value(a, int(b), int(c), float(d))
                      for a, b, c, d in zip(u, n1, n2, ties)], dtype=float)


def compare_groups(df: DataFrame, keys: Sequence[str], flag: str, prop: str, tie: Sequence[str],
                   window_rows: int | None = None) -> DataFrame:
    """Medians, means and Mann-Whitney U of ``prop`` inside and outside a flag.

    Fewer than three rows on a side give medians only.
    """
    sub = df.filter(F.col(prop).isNotNull()).select(*keys, *tie, F.col(flag).alias("_in"), F.col(prop).cast("double").alias("_v"))
    ranked = with_average_rank(sub, keys, "_v", tie, "_r", window_rows)
    inside = F.col("_in")
    agg = ranked.groupBy(*keys).agg(
        F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"), F.avg(F.when(inside, F.col("_v"))).alias("mean_in"),
        F.avg(F.when(~inside, F.col("_v"))).alias("mean_out"), F.sum(F.when(inside, F.col("_r"))).alias("_rank_sum"))
    t = F.col("count").cast("double")
    ties = sub.groupBy(*keys, "_v").count().groupBy(*keys).agg(F.sum(t * t * t - t).alias("_ties"))
    med = group_quantiles(sub.withColumn("_side", F.when(inside, "in").otherwise("out")), [*keys, "_side"], "_v",
                          {"m": 0.5}, tie, window_rows)
    med = med.groupBy(*keys).agg(F.max(F.when(F.col("_side") == "in", F.col("m"))).alias("median_in"),
                                 F.max(F.when(F.col("_side") == "out", F.col("m"))).alias("median_out"))
    enough = (F.col("n_in") >= 3) & (F.col("n_out") >= 3)
    u = F.when(enough, F.col("_rank_sum") - F.col("n_in") * (F.col("n_in") + 1) / 2.0)
    out = (agg.join(med, list(keys)).join(ties, list(keys)).withColumn("mannwhitney_u", u)
           .withColumn("mannwhitney_p", _mann_whitney_p("mannwhitney_u", "n_in", "n_out", "_ties"))
           .withColumn("mean_in", F.when(enough, F.col("mean_in"))).withColumn("mean_out", F.when(enough, F.col("mean_out"))))
    return out.select(*keys, F.lit(prop).alias("property"), "n_in", "n_out", "median_in", "median_out", "mean_in", "mean_out",
                      "mannwhitney_u", "mannwhitney_p")


def regression_fit(df: DataFrame, keys: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """R^2 of predictions against the truth's own mean, and MSE."""
    y, p = F.col(truth), F.col(predicted)
    res = F.sum((y - p) * (y - p))
    return df.filter(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (1.0 - F.try_divide(res, F.var_pop(y) * F.count(F.lit(1)))).alias("r2"), (res / F.count(F.lit(1))).alias("mse"))


def mean_sem(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and standard error per group."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"),
                                 F.try_divide(F.stddev_samp(value), F.sqrt(n.cast("double"))).alias("sem"))


def abs_error(x: Column, y: Column) -> Column:
    return F.abs(x - y)
