"""What-if removal of throats: selection rules, pruning, re-solve, side-by-side metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.config import NetworkConfig
from porespark.functions.scalar import before_after
from porespark.operators import grid
from porespark.operators.analysis import drawn_subsets
from porespark.plans.lineage import cut
from porespark.plans.ordering import group_quantiles

# A rule adds a boolean ``selected`` column to a throat table, per sample.
Rule = Callable[[DataFrame], DataFrame]

# The metrics compared before and after removal.
METRIC_KEYS = ("n_bodies", "n_throats", "n_streamtubes", "n_fallback_throats", "omega", "omega_c", "v_stuck_total",
               "iota_sq_g", "iota_sq_c", "tau_sq_c", "c_c", "consistency", "phi_total", "phi_c", "f_total", "f_c",
               "total_current", "effective_conductance", "inv_tau_sq_c", "inv_c_c", "inv_f_c")


def _cutoff(df: DataFrame, column: str, percentile: float, tail: str, out: str) -> DataFrame:
    if tail not in ("bottom", "top"):
        raise ValueError(f"tail must be 'bottom' or 'top', got {tail!r}")
    p = percentile / 100.0 if tail == "bottom" else 1.0 - percentile / 100.0
    cut_at = group_quantiles(df.select("ms_id", "throat_id", column), ["ms_id"], column, {"_q": p}, ["throat_id"])
    hit = F.col(column) <= F.col("_q") if tail == "bottom" else F.col(column) >= F.col("_q")
    return df.join(cut_at, "ms_id", "left").withColumn(out, F.coalesce(hit, F.lit(False))).drop("_q")


def rank_rule(column: str, percentile: float, tail: str = "bottom", column2: str | None = None,
              percentile2: float | None = None, tail2: str = "top", combine: str = "and") -> Rule:
    """Quantile rule on one column, or two combined by and/or."""
    if combine not in ("and", "or"):
        raise ValueError(f"combine must be 'and' or 'or', got {combine!r}")

    def rule(df: DataFrame) -> DataFrame:
        out = _cutoff(df, column, percentile, tail, "selected")
        if column2 is None:
            return out
        out = _cutoff(out, column2, percentile if percentile2 is None else percentile2, tail2, "_second")
        both = F.col("selected") & F.col("_second") if combine == "and" else F.col("selected") | F.col("_second")
        return out.withColumn("selected", both).drop("_second")
    return rule


def random_rule(percentile: float | None = None, seed: int = 0, *, n: int | None = None,
                match: Rule | None = None) -> Rule:
    """Seeded random selection of p %, n, or as many throats as another rule takes."""
    if sum(x is not None for x in (percentile, n, match)) != 1:
        raise ValueError("pass exactly one of percentile, n or match")

    def rule(df: DataFrame) -> DataFrame:
        size = df.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_total"))
        if match is not None:
            want = match(df).groupBy("ms_id").agg(F.count_if("selected").alias("want"))
            size = size.join(want, "ms_id")
        elif n is not None:
            size = size.withColumn("want", F.lit(n))
        else:
            size = size.withColumn("want", F.greatest(F.lit(1), F.bround(F.lit(percentile / 100.0) * F.col("n_total"), 0).cast("int")))
        size = size.withColumn("n_pick", F.least("want", "n_total"))
        hit = drawn_subsets(df, size, "throat_id", 1, seed).select("ms_id", "throat_id", F.lit(True).alias("selected"))
        return df.join(hit, ["ms_id", "throat_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return rule


RULES: dict[str, Rule] = {"bottleneck": rank_rule("c_geomean", 10, "bottom", "p_throat_only_frac", 10, "top")}


def resolve_rule(criterion: str | Rule) -> Rule:
    if callable(criterion):
        return criterion
    if criterion not in RULES:
        raise ValueError(f"unknown criterion {criterion!r}; use one of {sorted(RULES)} or a callable")
    return RULES[criterion]


def select_throats(table: DataFrame, criterion: str | Rule = "bottleneck") -> DataFrame:
    """``(ms_id, throat_id)`` of the throats a rule takes."""
    return resolve_rule(criterion)(table).filter("selected").select("ms_id", "throat_id")


def remove_throats(throats: DataFrame, removed: DataFrame) -> DataFrame:
    """Anti-join; unknown ids change nothing, bodies stay."""
    return throats.join(removed.select("ms_id", "throat_id").distinct(), ["ms_id", "throat_id"], "left_anti")


def coordination_numbers(throats: DataFrame, bodies: DataFrame) -> DataFrame:
    """Throats per body, zero included."""
    z = (throats.select("ms_id", F.explode(F.array("body1_id", "body2_id")).alias("body_id"))
         .groupBy("ms_id", "body_id").agg(F.count(F.lit(1)).alias("coordination")))
    return bodies.select("ms_id", "body_id").join(z, ["ms_id", "body_id"], "left").select(
        "ms_id", "body_id", F.coalesce("coordination", F.lit(0)).alias("coordination"))


def newly_isolated(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bodies that had throats before and have none after, per sample."""
    both = before.join(after.withColumnRenamed("coordination", "_after"), ["ms_id", "body_id"])
    return both.groupBy("ms_id").agg(F.count_if((F.col("coordination") > 0) & (F.col("_after") == 0)).alias("n_bodies_newly_isolated"))


def checked(vox: DataFrame) -> DataFrame:
    """``(ms_id, error)`` per sample; the error is NULL where the image can be worked on.

    One pass of aggregates finds images without labels, with missing, repeated or
    negative coordinates, or too large for a node number.
    """
    n = {a: (F.max(a) + 1).cast("long") for a in grid.AXES}
    place = (F.col("x").cast("decimal(38,0)") * F.col("_ny") + F.col("y")) * F.col("_nz") + F.col("z")
    shape = vox.groupBy("ms_id").agg(
        *[n[a].alias(f"_n{a}") for a in grid.AXES], F.count(F.lit(1)).alias("_n"),
        F.least(*[F.min(a) for a in grid.AXES]).alias("_low"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("_lost"),
        F.count_if(F.col("body").isNull()).alias("_bare"))
    # the places of a full image are 0, 1, 2 ...: their number and sum tell
    total = (vox.join(shape.select("ms_id", "_ny", "_nz"), "ms_id").groupBy("ms_id")
             .agg(F.sum(place).alias("_sum"), F.max(place).alias("_most")))
    cells = F.col("_nx").cast("decimal(38,0)") * F.col("_ny") * F.col("_nz")
    top = 1 << 21
    return (shape.join(total, "ms_id").select("ms_id", F.when(F.col("_lost") > 0, "voxels without coordinates")
            .when(F.col("_low") < 0, "negative coordinates")
            .when(F.greatest("_nx", "_ny", "_nz") > top, f"more than {top} voxels along an axis")
            .when((F.col("_n") != cells) | (F.col("_sum") * 2 != cells * (cells - 1)), "voxels missing or repeated")
            .when(F.col("_bare") > 0, "voxels without a body label").alias("error")))


_MARK = "\u0001"   # between a rule's label and a sample's name, within one run over all rules


def sweep(vox: DataFrame, cfg: NetworkConfig, rules: dict[str, str | Rule]) -> DataFrame:
    """One row per rule and sample: baseline, pruned and delta of every metric.

    Images are checked first; a sample that cannot be worked on gets a row with
    ``errored`` and the reason for each rule and stops no other.  Geometry, baseline
    and throat table are made once.  The networks that the rules leave are solved
    together, a rule's label being part of the sample's key, so a sweep has as many
    stages as one what-if.  A sample that removal disconnects has ``solve_failed`` and
    NULL pruned metrics; one that has no route to begin with is ``errored``.
    """
    from porespark.plans import pipelines

    if not rules or any(_MARK in label for label in rules):
        raise ValueError("a sweep needs rules, their labels without control characters")
    ms_type = vox.schema["ms_id"].dataType
    state = cut(checked(vox))
    good = vox.join(state.filter("error is null").select("ms_id"), "ms_id", "left_semi")
    base = pipelines.network_run(good, cfg)
    before = cut(pipelines.network_metrics(base, cfg))
    table = pipelines.throat_table(base)
    labels = F.explode(F.array(*[F.lit(label) for label in rules]))
    removed = None
    for label, criterion in rules.items():
        part = select_throats(table, criterion).select(F.lit(label).alias("rule"), "ms_id", "throat_id")
        removed = part if removed is None else removed.unionByName(part)
    removed = cut(removed)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("ms_id", F.concat_ws(_MARK, "rule", F.col("ms_id").cast("string"))).drop("rule")

    def named(df: DataFrame) -> DataFrame:
        parts = F.split("ms_id", _MARK)
        return df.withColumn("rule", F.element_at(parts, 1)).withColumn("ms_id", F.element_at(parts, 2).cast(ms_type))

    gone = keyed(removed)
    throats_of = cut(keyed(base.throats.withColumn("rule", labels)))
    bodies_of = cut(keyed(base.bodies.drop("phi", "is_inlet", "is_outlet", "spans_domain").withColumn("rule", labels)))
    kept = cut(remove_throats(throats_of, gone))
    after_run = pipelines.solve_network(keyed(base.vox.limit(0).withColumn("rule", labels)), bodies_of, kept,
                                        keyed(base.shape.withColumn("rule", labels)), cfg)
    after = named(cut(pipelines.network_metrics(after_run, cfg)))
    isolated = named(newly_isolated(coordination_numbers(throats_of, bodies_of), coordination_numbers(kept, bodies_of)))
    known = state.withColumn("rule", labels)
    return side_by_side(known, before, after, removed, isolated)


def prune_and_recompute(vox: DataFrame, cfg: NetworkConfig, criterion: str | Rule = "bottleneck") -> DataFrame:
    """``sweep`` of one rule, without its label."""
    return sweep(vox, cfg, {"rule": criterion}).drop("rule")


def side_by_side(known: DataFrame, before: DataFrame, after: DataFrame, removed: DataFrame, isolated: DataFrame) -> DataFrame:
    """Rows of ``known`` (rule, ms_id, error) with the metrics before and after; ``before`` holds for all rules."""
    key = ["rule", "ms_id"]
    n_removed = removed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_throats_removed"))
    failed = F.coalesce(F.col("_a.solve_failed"), F.lit(True))
    no_route = F.coalesce(F.col("_b.solve_failed"), F.lit(True))
    error = F.coalesce("error", F.when(no_route, F.lit("no conducting route from inlet to outlet")))
    errored = error.isNotNull()
    cols = []
    for k in METRIC_KEYS:
        b = F.when(~errored, F.col(f"_b.{k}"))
        a = F.when(~errored & ~failed, F.col(f"_a.{k}"))
        cols += [b.alias(f"baseline_{k}"), a.alias(f"pruned_{k}"), (a - b).alias(f"delta_{k}")]
    return (known.join(before.alias("_b"), "ms_id", "left").join(after.alias("_a"), key, "left").join(n_removed, key, "left")
            .join(isolated, key, "left")
            .select("rule", "ms_id", errored.alias("errored"), error.alias("error"), (~errored & failed).alias("solve_failed"),
                    F.when(~errored, F.coalesce("n_throats_removed", F.lit(0))).alias("n_throats_removed"),
                    F.when(~errored, F.coalesce("n_bodies_newly_isolated", F.lit(0))).alias("n_bodies_newly_isolated"), *cols))


def with_before_after(df: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """``<metric>_before/after`` text columns."""
    for m in metrics:
        for c in (f"baseline_{m}", f"pruned_{m}"):
            if c not in df.columns:
                raise KeyError(f"missing {c!r}")
        df = df.withColumn(f"{m}_before/after", before_after(F.col(f"baseline_{m}").cast("double"), F.col(f"pruned_{m}").cast("double")))
    return df
