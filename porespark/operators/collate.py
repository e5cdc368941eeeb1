"""Cross-sample collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.functions import stats
from porespark.functions.scalar import size_class, size_order, top_count
from porespark.operators import analysis
from porespark.plans.ordering import group_quantiles, with_position

# The ordered size classes.
SIZE_ORDER = ("Coarse", "Medium", "Fine")


def sample_rows(table: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Medians, class fractions, top-10 % current share and cross-check per sample."""
    med_c = group_quantiles(table, ["ms_id"], "c", {"median_c": 0.5}, ["throat_id"], window_rows)
    med_g = group_quantiles(table, ["ms_id"], "c_geomean", {"median_c_geomean": 0.5}, ["throat_id"], window_rows)
    agg = table.groupBy("ms_id").agg(
        F.count(F.lit(1)).alias("n_throats"), F.avg((F.col("class") == "bottleneck").cast("double")).alias("frac_bottleneck_class"),
        F.avg((F.col("class") == "highway").cast("double")).alias("frac_highway_class"), F.sum("f").alias("_f"),
        top_count(F.count(F.lit(1)), 0.10, 1).alias("_n"))
    ranked = with_position(table.select("ms_id", "throat_id", "f"), ["ms_id"], [F.col("f").desc(), F.col("throat_id").asc()], "_pos", window_rows)
    top = (ranked.join(agg.select("ms_id", "_n"), "ms_id").filter("_pos <= _n").groupBy("ms_id").agg(F.sum("f").alias("_top")))
    check = analysis.cross_check(table, window_rows).select(
        "ms_id", F.col("spearman").alias("cross_check_spearman"), F.col("median_rel_err_busy").alias("cross_check_median_rel_err"),
        F.col("pass").alias("cross_check_pass"))
    return (agg.join(top, "ms_id").join(med_c, "ms_id", "left").join(med_g, "ms_id", "left").join(check, "ms_id", "left")
            .withColumn("current_top10_frac", F.when(F.col("_f") > 0, F.col("_top") / F.nullif("_f", F.lit(0.0))))
            .withColumn("cross_check_pass", F.coalesce("cross_check_pass", F.lit(False))).drop("_f", "_n", "_top"))


def collate(table: DataFrame, names: DataFrame, summary: DataFrame, overlap: DataFrame | None = None) -> DataFrame:
    """Sample rows joined with their metrics; samples without a summary are left out.

    ``names``: ms_id, ms_name.  ``summary``: ms_id plus metric columns.
    """
    out = sample_rows(table).join(names, "ms_id").join(summary, "ms_id").withColumn("size_class", size_class("ms_name"))
    if overlap is not None:
        for level in ("edge", "throat_only"):
            part = overlap.filter(F.col("level") == level).select(
                "ms_id", F.col("jaccard").alias(f"overlap_{level}_jaccard"), F.col("spearman").alias(f"overlap_{level}_spearman"))
            out = out.join(part, "ms_id", "left")
    return out.orderBy(size_order("size_class"), "ms_name")


def by_size_class(collated: DataFrame, value: str) -> DataFrame:
    """Mean and SEM of a column per size class."""
    return stats.mean_sem(collated, ["size_class"], value)


def by_group(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows and the mean of several columns per group, nulls left out of a mean."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(v).cast("double")).alias(v) for v in values])


def pass_rate(collated: DataFrame) -> DataFrame:
    return collated.groupBy("size_class").agg(F.count(F.lit(1)).alias("n"),
                                              F.avg(F.col("cross_check_pass").cast("double")).alias("pass_rate"))


def report(collated: DataFrame, pairs: list[tuple[str, str, str]]) -> str:
    """Markdown summary from a few aggregated rows."""
    whole = collated.withColumn("_all", F.lit(1))
    per_class = {r["size_class"]: r for r in pass_rate(collated).collect()}
    total = sum(r["n"] for r in per_class.values())
    passed = whole.agg(F.count_if("cross_check_pass").alias("n")).first()["n"]
    lines = ["# Cross-sample collation", "", f"{total} samples, {passed} pass the voxel-vs-network cross-check.", "", "## Coverage", ""]
    lines += [f"- {c}: {per_class[c]['n'] if c in per_class else 0} samples" for c in SIZE_ORDER]
    lines += ["", "## Headline correlations", ""]
    for x, y, label in pairs:
        row = stats.correlations(whole, ["_all"], x, y, ["ms_id"], p_values=True).first()
        if row is None or row["n"] < 3:
            lines.append(f"- {label}: too few points (n={row['n'] if row else 0})")
        elif row["spearman"] is None:
            lines.append(f"- {label}: undefined (n={row['n']})")
        else:
            lines.append(f"- {label}: Spearman r = {row['spearman']:.2f} (p={row['spearman_p']:.2g}, n={row['n']})")
    return "\n".join(lines) + "\n"
