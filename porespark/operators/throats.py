"""Throat extraction and effective three-segment geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespark.config import NetworkConfig
from porespark.functions.scalar import RATIO_LIMIT, distance3
from porespark.operators import geometry, grid
from porespark.operators.grid import AXES
from porespark.plans.lineage import cut, even
from porespark.plans.ordering import with_position


def throat_voxels(vox: DataFrame, dilate_both: bool = True) -> DataFrame:
    """Voxels shared by two dilated bodies on an inner boundary.

    A voxel reaches its own label and those of its six neighbours, so every
    pair it belongs to is known from one stencil: at most 21 pairs, no join of
    bodies with bodies and no pair search.
    """
    linked = grid.with_neighbours(vox.select("ms_id", *AXES, "body", "edt"), ["body"])
    sides = [f"{a}{s}" for a in AXES for s in "pm"]
    differs = F.lit(False)
    for s in sides:
        differs = differs | F.coalesce(F.col(f"{s}.body") != F.col("body"), F.lit(False))
    labels = F.array_compact(F.array("body", *[F.col(f"{s}.body") for s in sides]))
    reach = F.array_sort(F.array_distinct(F.filter(labels, lambda b: b > 0)))
    near = linked.filter((F.col("body") > 0) & differs).select("ms_id", *AXES, "edt", "body", reach.alias("r"))
    near = near.filter(F.size("r") > 1)
    pairs = F.flatten(F.transform("r", lambda a: F.transform(
        F.filter("r", lambda b: b > a), lambda b: F.struct(a.alias("b1"), b.alias("b2")))))
    out = near.select("ms_id", *AXES, "edt", "body", F.explode(pairs).alias("p")).select(
        "ms_id", "p.b1", "p.b2", *AXES, "edt", "body")
    if not dilate_both:
        out = out.filter("body = b2")
    return out.drop("body")


def extract_throats(vox: DataFrame, bodies: DataFrame, cfg: NetworkConfig,
                    with_footprint: bool | None = None) -> DataFrame:
    """One row per throat with centre, lengths, normal and the three areas.

    ``throat_id`` numbers kept pairs 1..n in (b1, b2) order.
    """
    tv = cut(throat_voxels(vox, cfg.dilate_both))
    agg = tv.groupBy("ms_id", "b1", "b2").agg(
        F.count(F.lit(1)).alias("volume_voxels"), *[F.avg(a).alias(f"t{a}") for a in AXES],
        F.max("edt").alias("max_radius"), *geometry.moment_columns())
    agg = agg.filter(F.col("volume_voxels") >= cfg.min_throat_size)
    ends = even(bodies.select("ms_id", "body_id", "cx", "cy", "cz", "is_surface"))
    for k in ("1", "2"):
        agg = agg.join(ends.select("ms_id", F.col("body_id").alias(f"b{k}"),
                                   *[F.col(f"c{a}").alias(f"c{k}{a}") for a in AXES],
                                   F.col("is_surface").alias(f"surf{k}")), ["ms_id", f"b{k}"])
    if cfg.skip_surface_surface:
        agg = agg.filter("not (surf1 and surf2)")
    agg = cut(geometry.with_plane(agg))
    if with_footprint is None:
        with_footprint = cfg.area_method == "vox_projection"
    n = F.col("volume_voxels").cast("double")
    tiny = F.col("volume_voxels") < 3
    if with_footprint:
        big = agg.filter(~tiny).select("ms_id", "b1", "b2", "plane", "tx", "ty", "tz")
        agg = agg.join(geometry.footprint_areas(tv, big, ["ms_id", "b1", "b2"]), ["ms_id", "b1", "b2"], "left")
    else:
        agg = agg.withColumn("footprint", F.lit(None).cast("double"))
    c1, c2, t = [f"c1{a}" for a in AXES], [f"c2{a}" for a in AXES], [f"t{a}" for a in AXES]
    dot = sum((F.element_at("plane", i + 1) * (F.col(q) - F.col(p)) for i, (p, q) in enumerate(zip(c1, c2))), F.lit(0.0))
    normal = [F.when(tiny, float(i == 2)).otherwise(F.element_at("plane", i + 1)).alias(f"n{a}") for i, a in enumerate(AXES)]
    out = (agg.withColumn("length_cc", distance3(c2, c1))
           .withColumn("length_body1_to_ct", distance3(t, c1))
           .withColumn("length_ct_to_body2", distance3(c2, t)))
    cos = F.abs(F.try_divide(dot, F.col("length_cc")))
    out = out.select(
        "ms_id", F.col("b1").alias("body1_id"), F.col("b2").alias("body2_id"), "volume_voxels", *t,
        "length_cc", (F.col("length_body1_to_ct") + F.col("length_ct_to_body2")).alias("length_via_ct"),
        "length_body1_to_ct", "length_ct_to_body2",
        F.when(F.col("length_cc") > 0, (F.col("length_body1_to_ct") + F.col("length_ct_to_body2")) / F.nullif("length_cc", F.lit(0.0)))
        .otherwise(1.0).alias("curvature_ratio"), "max_radius", n.alias("area_naive"),
        F.when(tiny, n).otherwise(n * cos).alias("area_naive_projected"),
        F.when(tiny, n).otherwise(F.col("footprint")).alias("area_vox_projection"),
        *normal, F.when(tiny, 0.0).otherwise(cos).alias("cos_theta"))
    return with_position(out, ["ms_id"], [F.col("body1_id"), F.col("body2_id")], "throat_id")


def overlap_voxels(tv: DataFrame, kept: DataFrame) -> DataFrame:
    """Throat voxels claimed again by a later throat, per sample."""
    mine = tv.join(kept.select("ms_id", F.col("body1_id").alias("b1"), F.col("body2_id").alias("b2")),
                   ["ms_id", "b1", "b2"], "left_semi")
    per = mine.groupBy("ms_id", *AXES).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per.groupBy("ms_id").agg(F.sum("extra").alias("overlap_voxels"))


def throat_label_image(tv: DataFrame, kept: DataFrame) -> DataFrame:
    """Voxel -> throat label; the highest id wins a shared voxel."""
    ids = kept.select("ms_id", F.col("body1_id").alias("b1"), F.col("body2_id").alias("b2"), "throat_id")
    return tv.join(ids, ["ms_id", "b1", "b2"]).groupBy("ms_id", *AXES).agg(F.max("throat_id").alias("throat_label"))


def selected_area(method: str) -> Column:
    """Area column for a method name."""
    known = {"naive": "area_naive", "naive_projected": "area_naive_projected", "vox_projection": "area_vox_projection"}
    if method not in known:
        raise ValueError(f"area_method must be one of {sorted(known)}, got {method!r}")
    return F.col(known[method])


def coordination(throats: DataFrame) -> DataFrame:
    """Throats per body and summed throat area (A1, A10); needs ``area_t``."""
    return (throats.select("ms_id", F.explode(F.array("body1_id", "body2_id")).alias("body_id"), "area_t")
            .groupBy("ms_id", "body_id").agg(F.count(F.lit(1)).alias("n_throats"), F.sum("area_t").alias("area_sum")))


def body_leg(d: Column, a_body: Column, a_throat: Column, alpha: float) -> dict[str, Column]:
    """Effective distance and area of one body leg; uniform above the ratio limit (P20)."""
    ratio = F.when(a_body > 0, a_throat / F.nullif(a_body, F.lit(0.0))).otherwise(F.lit(float("inf")))
    s = F.sqrt(ratio)
    shaped = ratio <= 1.0
    return {"ratio": ratio,
            "d_eff": F.when(shaped, d * (1.0 - alpha * s)).otherwise(d),
            "a_eff": F.when(shaped, a_body * (1.0 - alpha * F.pow(ratio, F.lit(1.5))) / (1.0 - alpha * s)).otherwise(a_body)}


def effective_geometry(throats: DataFrame, bodies: DataFrame, cfg: NetworkConfig) -> DataFrame:
    """Flat throat table with three-segment lengths, areas and volumes.

    A throat with a missing body or a zero leg keeps its row with NULL ``i``/``j``
    and a ``warning`` (J6, J7, Q17).
    """
    t = throats.withColumn("area_t", selected_area(cfg.area_method))
    ends = even(bodies.select("ms_id", "body_id", "volume_voxels", "cx", "cy", "cz")
                .join(even(coordination(t)), ["ms_id", "body_id"]))
    for k in ("1", "2"):
        side = ends.select("ms_id", F.col("body_id").alias(f"body{k}_id"), F.col("volume_voxels").alias(f"vol{k}"),
                           *[F.col(f"c{a}").alias(f"c{k}{a}") for a in AXES],
                           F.col("n_throats").alias(f"z{k}"), F.col("area_sum").alias(f"as{k}"))
        t = t.join(side, ["ms_id", f"body{k}_id"], "left")
    for k in ("1", "2"):
        equal = F.col(f"vol{k}") / F.col(f"z{k}")
        share = equal if cfg.split_volume_equal else F.when(
            F.col(f"as{k}") > 0, F.col(f"vol{k}") * F.col("area_t") / F.nullif(f"as{k}", F.lit(0.0))).otherwise(equal)
        d = distance3([f"t{a}" for a in AXES], [f"c{k}{a}" for a in AXES])
        t = (t.withColumn(f"d{k}", d).withColumn(f"v{k}", share.cast("double"))
             .withColumn(f"a{k}", F.try_divide(F.col(f"v{k}"), F.col(f"d{k}"))))
        leg = body_leg(F.col(f"d{k}"), F.col(f"a{k}"), F.col("area_t"), cfg.alpha)
        t = (t.withColumn(f"ratio{k}", leg["ratio"]).withColumn(f"de{k}", leg["d_eff"]).withColumn(f"ae{k}", leg["a_eff"]))
    missing = F.col("vol1").isNull() | F.col("vol2").isNull()
    zero = (F.col("d1") == 0) | (F.col("d2") == 0)
    valid = ~missing & ~zero
    pipe = (F.col("ratio1") > RATIO_LIMIT) | (F.col("ratio2") > RATIO_LIMIT)
    total = F.col("d1") + F.col("d2")
    t = (t.withColumn("valid", valid).withColumn("is_fallback", F.col("valid") & pipe)
         .withColumn("a_pipe", F.try_divide(F.col("v1") + F.col("v2"), total)).withColumn("l_pipe", total / 3.0))

    def either(fallback: Column, shaped: Column) -> Column:
        return F.when(F.col("valid"), F.when(F.col("is_fallback"), fallback).otherwise(shaped)).otherwise(0.0)

    t = (t.withColumn("i", F.when(F.col("valid"), F.col("body1_id"))).withColumn("j", F.when(F.col("valid"), F.col("body2_id")))
         .withColumn("l_body1", either(F.col("l_pipe"), F.col("de1"))).withColumn("l_body2", either(F.col("l_pipe"), F.col("de2")))
         .withColumn("a_body1", either(F.col("a_pipe"), F.col("ae1"))).withColumn("a_body2", either(F.col("a_pipe"), F.col("ae2")))
         .withColumn("l_to_body1", either(F.col("l_pipe") / 2, F.col("d1") - F.col("de1")))
         .withColumn("l_to_body2", either(F.col("l_pipe") / 2, F.col("d2") - F.col("de2")))
         .withColumn("l_throat", F.col("l_to_body1") + F.col("l_to_body2"))
         .withColumn("throat_area", either(F.col("a_pipe"), F.col("area_t")))
         .withColumn("geometric_throat_area", F.when(F.col("valid"), F.col("area_t")).otherwise(0.0))
         .withColumn("throat_volume", F.col("l_throat") * F.col("throat_area"))
         .withColumn("v_body1", F.col("a_body1") * F.col("l_body1")).withColumn("v_body2", F.col("a_body2") * F.col("l_body2"))
         .withColumn("warning", F.when(missing, "missing_body").when(zero, "zero_distance").when(F.col("is_fallback"), "fallback")))
    return t.select("ms_id", "throat_id", "i", "j", "body1_id", "body2_id", "throat_area", "throat_volume", "l_throat",
                    "l_to_body1", "l_to_body2", "l_body1", "l_body2", "a_body1", "a_body2", "v_body1", "v_body2",
                    "geometric_throat_area", "is_fallback", "warning", F.col("d1"), F.col("d2"),
                    F.col("a1").alias("path_area1"), F.col("a2").alias("path_area2"))


def recompute_leg(distance: Column, path_area: Column, throat_area: Column, alpha: float) -> dict[str, Column]:
    """Effective leg for another alpha, without the pipe fallback."""
    s = F.sqrt(F.try_divide(throat_area, path_area))
    d_eff = F.when(path_area > 0, distance * (1.0 - alpha * s)).otherwise(distance)
    area = F.when(d_eff > 0, (path_area * distance - throat_area * (distance - d_eff)) / F.nullif(d_eff, F.lit(0.0))
                  ).otherwise(path_area)
    return {"effective_distance": d_eff, "effective_area": area, "effective_volume": d_eff * area}


def body_throat_table(flat: DataFrame, alpha: float) -> DataFrame:
    """Connection rows, two per valid throat (A3 schema ``body_throat``)."""
    def side(k: str, end: str):
        return F.struct(F.col(end).alias("body_id"), F.col(f"d{k}").alias("distance"),
                        F.col(f"path_area{k}").alias("body_path_area"), F.col(f"l_body{k}").alias("effective_distance"),
                        F.col(f"a_body{k}").alias("effective_area"), F.col(f"v_body{k}").alias("effective_volume"))
    return (flat.filter("i is not null")
            .select("ms_id", "throat_id", F.explode(F.array(side("1", "i"), side("2", "j"))).alias("s"),
                    F.col("geometric_throat_area").alias("throat_area"), "is_fallback", "geometric_throat_area")
            .select("ms_id", "s.body_id", "throat_id", "s.distance", "s.body_path_area", "throat_area",
                    "s.effective_distance", "s.effective_area", "s.effective_volume", "is_fallback",
                    "geometric_throat_area", F.lit(alpha).alias("alpha")))
