"""Chord-corrected path lengths: replace right-angle staircases by chords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from porespark.config import VoxelConfig
from porespark.operators import grid
from porespark.operators.grid import AXES, node_coords
from porespark.plans.lineage import cut, even


# what tells one bend of a sample from another, whatever path takes it
BEND = ["code1", "code2", "a", "b", *AXES]


def path_runs(steps: DataFrame) -> DataFrame:
    """Straight runs of each path (W2, W3): direction code, length, end voxel, first/last flags.

    Windows run over one path, whose length the image bounds.
    """
    moves = steps.filter("kind = 0").select("ms_id", "path_id", "step", "up", "dn")
    a = moves.select("*", F.struct(*node_coords("up")).alias("p"), F.struct(*node_coords("dn")).alias("q"))
    code = F.lit(None)
    for i, name in enumerate(AXES):
        gap = F.col(f"q.{name}") - F.col(f"p.{name}")
        code = F.when(gap == 1, 2 * i + 1).when(gap == -1, 2 * i).otherwise(code)
    a = a.select("ms_id", "path_id", "step", "dn", code.cast("int").alias("code"))
    w = Window.partitionBy("ms_id", "path_id").orderBy("step")
    turned = (F.col("code") != F.lag("code").over(w)).cast("int")
    a = a.withColumn("run", F.sum(F.coalesce(turned, F.lit(0))).over(w))
    runs = a.groupBy("ms_id", "path_id", "run").agg(
        F.first("code").alias("code"), F.count(F.lit(1)).alias("n"), F.max_by("dn", "step").alias("end_node"))
    whole = Window.partitionBy("ms_id", "path_id")
    return runs.withColumn("is_first", F.col("run") == 0).withColumn("is_last", F.col("run") == F.max("run").over(whole))


def bends(steps: DataFrame, radius: float) -> DataFrame:
    """One row per bend with its two arm lengths in voxels."""
    runs = path_runs(steps)
    n, r = F.col("n").cast("double"), F.lit(float(radius))
    full, half = F.least(r, n), F.least(r, 0.5 * n)
    runs = (runs.withColumn("left", F.when(F.col("is_first"), 0.0).when(F.col("is_last"), full).otherwise(half))
            .withColumn("right", F.when(F.col("is_last"), 0.0).when(F.col("is_first"), full).otherwise(half)))
    w = Window.partitionBy("ms_id", "path_id").orderBy("run")
    nxt = runs.withColumn("b", F.lead("left").over(w)).withColumn("code2", F.lead("code").over(w)).filter("code2 is not null")
    out = nxt.select("ms_id", "path_id", "run", F.col("right").alias("a"), "b", F.col("code").alias("code1"), "code2",
                     *node_coords("end_node"))
    a, b = F.col("a"), F.col("b")
    straight_back = F.floor(F.col("code1") / 2) == F.floor(F.col("code2") / 2)
    chord = F.sqrt(F.greatest(a * a + b * b - F.when(straight_back, 2.0 * a * b).otherwise(0.0), F.lit(0.0)))
    return out.withColumn("gain", F.greatest(a + b - chord, F.lit(0.0))).withColumn("chord", chord)


def _along(code: str, axis: int):
    c = F.col(code)
    return F.when(c == 2 * axis + 1, 1).when(c == 2 * axis, -1).otherwise(0)


def box_test(bend: DataFrame, pore: DataFrame, vox_shape: DataFrame, sat: DataFrame) -> DataFrame:
    """Accept a bend when the box spanned by its arms is all pore."""
    lo, hi = {}, {}
    for i, name in enumerate(AXES):
        start = F.col(name) - F.ceil("a").cast("int") * _along("code1", i)
        end = F.col(name) + F.ceil("b").cast("int") * _along("code2", i)
        lo[name], hi[name] = F.least(start, end), F.greatest(start, end)
    # many paths take the same bend: its box is counted once for all of them
    places = bend.filter((F.col("a") > 0) & (F.col("b") > 0) & (F.col("gain") > 0)).select("ms_id", *BEND).distinct()
    boxes = places.join(vox_shape, "ms_id")
    boxes = boxes.select("*", *[lo[a].alias(f"lo_{a}") for a in AXES], *[hi[a].alias(f"hi_{a}") for a in AXES])
    inside, volume = F.lit(True), F.lit(1)
    for a in AXES:
        inside = inside & (F.col(f"lo_{a}") >= 0) & (F.col(f"hi_{a}") < F.col(f"n{a}"))
        volume = volume * (F.col(f"hi_{a}") - F.col(f"lo_{a}") + 1)
    # a box's corners have the axes' names, so the place of the bend goes by others
    held = {a: f"at_{a}" for a in AXES}
    named = [held.get(c, c) for c in BEND] + ["volume"]
    counted = grid.box_counts(boxes.filter(inside).withColumn("volume", volume).withColumnsRenamed(held), sat, named)
    fits = counted.select("ms_id", *[F.col(held.get(c, c)).alias(c) for c in BEND], (F.col("n_inside") == F.col("volume")).alias("fits"))
    out = bend.join(even(fits), ["ms_id", *BEND], "left")
    candidate = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("gain") > 0)
    fits = F.coalesce("fits", F.lit(False))
    return out.select("ms_id", "path_id", "run", "gain", (candidate & fits).alias("accepted"), (candidate & ~fits).alias("rejected"))


def sample_test(bend: DataFrame, pore: DataFrame, samples_per_dx: int) -> DataFrame:
    """Accept a bend when dense samples of its chord are all pore.

    The number of samples is bounded by the bend radius.
    """
    keys = ["ms_id", *BEND]
    # many paths take the same bend: its chord is sampled once for all of them
    live = bend.filter((F.col("a") > 0) & (F.col("b") > 0)).select(*keys, "chord").distinct()
    ends = []
    for i, name in enumerate(AXES):
        ends += [(F.col(name) - F.col("a") * _along("code1", i)).alias(f"s{name}"),
                 (F.col("a") * _along("code1", i) + F.col("b") * _along("code2", i)).alias(f"d{name}")]
    ns = F.greatest(F.lit(2), (F.ceil(F.col("chord") * samples_per_dx) + 1).cast("int"))
    held = {a: f"at_{a}" for a in AXES}
    place = ["ms_id", *[held.get(c, c) for c in BEND]]
    pts = live.select("ms_id", *[F.col(c).alias(held.get(c, c)) for c in BEND], *ends, ns.alias("ns")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
    t = F.when(F.col("k") == F.col("ns") - 1, 1.0).otherwise(F.col("k") * (1.0 / (F.col("ns") - 1)))
    hit = pts.select(*place, *[F.floor(F.col(f"s{a}") + t * F.col(f"d{a}") + 0.5).cast("int").alias(a) for a in AXES]).distinct()
    ok = (hit.join(pore.select("ms_id", *AXES, F.lit(True).alias("in_pore")), ["ms_id", *AXES], "left")
          .groupBy(*place).agg(F.bool_and(F.coalesce("in_pore", F.lit(False))).alias("clear")))
    clear = ok.select("ms_id", *[F.col(held.get(c, c)).alias(c) for c in BEND], "clear")
    out = bend.join(even(clear), keys, "left")
    good = F.col("clear") & (F.col("gain") > 0)
    # a bend without arms is neither
    return out.select("ms_id", "path_id", "run", "gain", F.coalesce(good, F.lit(False)).alias("accepted"), F.coalesce(~good, F.lit(False)).alias("rejected"))


def corrected_lengths(steps: DataFrame, tubes: DataFrame, nodes: DataFrame, cfg: VoxelConfig, test: str = "box") -> DataFrame:
    """Tubes with ``l_gamma_chord`` and bend counts; ``test`` is box, sampler or none."""
    bend = cut(bends(steps, cfg.bend_radius_vox))
    if test == "none" or not cfg.require_chord_inside_phase:
        live = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("gain") > 0)
        judged = bend.select("ms_id", "path_id", "run", "gain", live.alias("accepted"), F.lit(False).alias("rejected"))
    elif test == "box":
        # the box test needs the full grid, solid included: build it from the extents
        judged = box_test(bend, nodes, *_dense_sat(nodes))
    else:
        judged = sample_test(bend, nodes, cfg.chord_samples_per_dx)
    # every bend has a row, judged or not
    agg = judged.groupBy("ms_id", "path_id").agg(
        F.count(F.lit(1)).alias("n_bends"), F.sum(F.when(F.col("accepted"), F.col("gain") * cfg.dx).otherwise(0.0)).alias("length_removed"),
        F.count_if("accepted").alias("n_accepted"), F.count_if("rejected").alias("n_rejected"))
    out = tubes.join(agg, ["ms_id", "path_id"], "left")
    for c, zero in (("n_bends", 0), ("length_removed", 0.0), ("n_accepted", 0), ("n_rejected", 0)):
        out = out.withColumn(c, F.coalesce(c, F.lit(zero)))
    return (out.withColumn("l_gamma_chord", F.col("l_gamma_raw") - F.col("length_removed"))
            .withColumn("tau_sq_chord", F.pow(F.col("l_sample") / F.col("l_gamma_chord"), F.lit(2.0))))


def _dense_sat(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extents and summed-area table of the box that holds all pore voxels."""
    shape = grid.extents(nodes)
    full = shape
    for a in AXES:
        full = full.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"n{a}") - 1)))
    mask = nodes.select("ms_id", *AXES, F.lit(True).alias("m"))
    full = full.select("ms_id", *AXES).join(mask, ["ms_id", *AXES], "left")
    return shape, grid.summed_area(full, F.coalesce("m", F.lit(False)))


def chord_summary(steps: DataFrame, tubes: DataFrame, nodes: DataFrame, transport: DataFrame, cfg: VoxelConfig,
                  test: str = "box") -> DataFrame:
    """Volume-weighted chord tortuosity; constriction stays as it was."""
    t = corrected_lengths(steps, tubes, nodes, cfg, test)
    v = F.col("v_gamma")
    return (t.groupBy("ms_id").agg(
        (F.sum(v * F.col("tau_sq_chord")) / F.sum(v)).alias("tau_sq_c_chord"), F.sum("n_bends").alias("total_bends"),
        F.sum("n_accepted").alias("accepted_bends"), F.sum("n_rejected").alias("rejected_bends"),
        F.count_if(F.col("l_gamma_chord") < F.col("l_sample") - 1e-12).alias("n_paths_below_l_sample"),
        (F.sum(v * F.col("length_removed")) / F.sum(v)).alias("volume_weighted_length_removed"))
        .withColumn("user_tortuosity_chord", F.sqrt(1.0 / F.col("tau_sq_c_chord"))))
