"""Pore bodies: properties, bounding boxes, candidate pairs, merges, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespark.functions.scalar import equivalent_radius
from porespark.operators import graph, grid
from porespark.operators.grid import AXES
from porespark.plans.lineage import cut


def body_props(vox: DataFrame, axis: int = 0) -> DataFrame:
    """Volume, centroids, radii and face contact per body (A4).

    ``vox`` holds all voxels with ``body`` and ``edt``.  The working centroid is
    the face centroid of a surface body, else the volume centroid.
    """
    last = vox.groupBy("ms_id").agg(F.max(AXES[axis]).alias("_last"))
    # sums per body and plane first: only these short tables meet the sample's extent, never its voxels
    planes = vox.filter("body > 0").groupBy("ms_id", F.col("body").alias("body_id"), F.col(AXES[axis]).alias("_plane")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("edt").alias("_edt"), *[F.sum(F.col(a).cast("long")).alias(f"_{a}") for a in AXES])
    face = (F.col("_plane") == 0) | (F.col("_plane") == F.col("_last"))
    n, n_face = F.sum("_n"), F.sum(F.when(face, F.col("_n")).otherwise(0))
    agg = planes.join(last, "ms_id").groupBy("ms_id", "body_id").agg(
        n.alias("volume_voxels"), F.max("_edt").alias("max_radius"), *[(F.sum(f"_{a}") / n).alias(f"vc{a}") for a in AXES],
        n_face.alias("surface_area_voxels"), *[F.try_divide(F.sum(F.when(face, F.col(f"_{a}"))), n_face).alias(f"sc{a}") for a in AXES])
    surface = F.col("surface_area_voxels") > 0
    return agg.select(
        "ms_id", "body_id", surface.cast("int").alias("nodal_state"), "volume_voxels",
        equivalent_radius("volume_voxels").alias("equivalent_radius"), "max_radius",
        *[F.coalesce(f"sc{a}", f"vc{a}").alias(f"c{a}") for a in AXES],
        *[f"vc{a}" for a in AXES], *[f"sc{a}" for a in AXES],
        surface.alias("is_surface"), "surface_area_voxels")


def bounding_boxes(vox: DataFrame, pad: int) -> DataFrame:
    """Half-open boxes grown by ``pad`` and clipped to the image."""
    shape = grid.extents(vox)
    boxes = vox.filter("body > 0").groupBy("ms_id", F.col("body").alias("body_id")).agg(
        *[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES])
    return boxes.join(shape, "ms_id").select(
        "ms_id", "body_id",
        *[F.greatest(F.col(f"min_{a}") - pad, F.lit(0)).alias(f"lo_{a}") for a in AXES],
        *[F.least(F.col(f"max_{a}") + 1 + pad, F.col(f"n{a}")).alias(f"hi_{a}") for a in AXES])


def candidate_pairs(boxes: DataFrame, tile: int = 16) -> DataFrame:
    """Pairs b1 < b2 with overlapping boxes (J4) as a tile equi-join.

    A box goes to every tile it meets; a pair is kept only in the tile holding
    the larger of the two lower corners, so no distinct is needed.
    """
    tiled = boxes
    for a in AXES:
        span = F.sequence(F.floor(F.col(f"lo_{a}") / tile), F.floor((F.col(f"hi_{a}") - 1) / tile))
        tiled = tiled.withColumn(f"t{a}", F.explode(span))
    keys = ["ms_id", "tx", "ty", "tz"]
    left = tiled.select(*keys, F.col("body_id").alias("b1"),
                        *[F.col(f"{s}_{a}").alias(f"{s}1_{a}") for s in ("lo", "hi") for a in AXES])
    right = tiled.select(*keys, F.col("body_id").alias("b2"),
                         *[F.col(f"{s}_{a}").alias(f"{s}2_{a}") for s in ("lo", "hi") for a in AXES])
    cond = F.col("b1") < F.col("b2")
    for a in AXES:
        cond = (cond & (F.col(f"lo1_{a}") < F.col(f"hi2_{a}")) & (F.col(f"lo2_{a}") < F.col(f"hi1_{a}"))
                & (F.floor(F.greatest(f"lo1_{a}", f"lo2_{a}") / tile) == F.col(f"t{a}")))
    return left.join(right, keys).filter(cond).select("ms_id", "b1", "b2")


# --- body merges (K11, K12): contractions of the small body graph --------------

def merge_map(vox: DataFrame, axis: int = 0) -> DataFrame:
    """``(ms_id, body, merged_into, n_face_merged, n_short_merged)`` after both merge stages.

    First, face bodies without an inner neighbour go into their largest face
    neighbour; then inner bodies whose neighbours all touch a face go into the largest
    of them.  The rule is sequential: within a pass labels are taken in ascending order
    and sizes are those left by the labels before.  Ties take the lowest label; a pass
    that merges nothing stops a stage.

    Only the contracted body graph takes part, as joins and aggregates: see
    ``_face_round`` and ``_short_round`` for the labels that a round may retire at once.
    """
    name = AXES[axis]
    last = vox.groupBy("ms_id").agg(F.max(name).alias("_last"))
    # voxels are combined by body before the extent of the sample joins, so a large sample stays spread
    info = (vox.filter("body > 0").groupBy("ms_id", "body")
            .agg(F.count(F.lit(1)).alias("size"), F.min(name).alias("_from"), F.max(name).alias("_to"))
            .join(last, "ms_id").withColumn("face", (F.col("_from") == 0) | (F.col("_to") == F.col("_last")))
            .select("ms_id", "body", "size", "face"))
    first = cut(info)
    return merge_graph(first, grid.label_adjacency(vox).select("ms_id", "body", "other"))


def merge_graph(first: DataFrame, links: DataFrame) -> DataFrame:
    """``merge_map`` of bodies ``(ms_id, body, size, face)`` and contacts in both directions ``(ms_id, body, other)``."""
    info, links = first, cut(links.distinct())
    picks = None
    for stage, round_of in (("face", _face_round), ("short", _short_round)):
        while True:
            state = _with_pending(info, links, stage)
            frozen, before = links, state.count()
            while not state.filter("pending").isEmpty():
                pick = cut(round_of(state, links if stage == "face" else frozen))
                gone = pick.filter("into is not null").select("ms_id", "body", "into", F.lit(stage).alias("stage"))
                picks = gone if picks is None else picks.unionByName(gone)
                state = cut(_absorb(state, pick))
                links = cut(_renamed(links, gone))
            info = state.select("ms_id", "body", "size", "face")
            if state.count() == before:
                break
    if picks is None:
        return first.select("ms_id", "body", F.col("body").alias("merged_into"), F.lit(0).cast("long").alias("n_face_merged"),
                            F.lit(0).cast("long").alias("n_short_merged"))
    counts = picks.groupBy("ms_id").agg(F.count_if(F.col("stage") == "face").alias("n_face_merged"),
                                        F.count_if(F.col("stage") == "short").alias("n_short_merged"))
    up = cut(first.select("ms_id", "body").join(picks.select("ms_id", "body", "into"), ["ms_id", "body"], "left")
             .select("ms_id", "body", F.coalesce("into", "body").alias("merged_into")))
    while True:  # pointers double: a label's target takes its target's place
        nxt = up.select("ms_id", F.col("body").alias("merged_into"), F.col("merged_into").alias("_far"))
        far = cut(up.join(nxt, ["ms_id", "merged_into"]).select("ms_id", "body", "merged_into", "_far"))
        done = far.filter("merged_into <> _far").isEmpty()
        up = far.select("ms_id", "body", F.col("_far").alias("merged_into"))
        if done:
            break
    return (up.join(counts, "ms_id", "left").select("ms_id", "body", "merged_into", F.coalesce("n_face_merged", F.lit(0)).alias("n_face_merged"),
                                                    F.coalesce("n_short_merged", F.lit(0)).alias("n_short_merged")))


def _with_pending(info: DataFrame, links: DataFrame, stage: str) -> DataFrame:
    """``info`` with the labels that a pass will take up: those with neighbours, all of them on a face."""
    far = info.select("ms_id", F.col("body").alias("other"), F.col("face").alias("_oface"))
    near = (links.join(far, ["ms_id", "other"], "left").groupBy("ms_id", "body")
            .agg(F.bool_and(F.coalesce("_oface", F.lit(True))).alias("alone")))
    kind = F.col("face") if stage == "face" else ~F.col("face")
    return cut(info.join(near, ["ms_id", "body"], "left")
               .select("ms_id", "body", "size", "face", (F.coalesce("alone", F.lit(False)) & kind).alias("pending")))


def _options(state: DataFrame, links: DataFrame) -> DataFrame:
    """Contacts of pending labels with the state of the other side."""
    far = state.select("ms_id", F.col("body").alias("other"), F.col("size").alias("osize"), F.col("pending").alias("opending"))
    mine = state.filter("pending").select("ms_id", "body", F.col("size").alias("own"))
    return links.join(mine, ["ms_id", "body"]).join(far, ["ms_id", "other"])


def _largest() -> Column:
    return F.max_by("other", F.struct("osize", -F.col("other")))


def _before_first(rated: DataFrame) -> DataFrame:
    """Pending labels below every label of their sample that is not sure, or free of lower ones around it."""
    unsure = rated.filter(~F.col("sure")).groupBy("ms_id").agg(F.min("body").alias("_stop"))
    return (rated.join(unsure, "ms_id", "left").filter(F.col("free") | F.col("_stop").isNull() | (F.col("body") < F.col("_stop")))
            .select("ms_id", "body", "into"))


def _face_round(state: DataFrame, links: DataFrame) -> DataFrame:
    """Face labels whose turn has come, with their target; NULL where none is left.

    A label may go if no lower pending label is within two contacts of it: what it
    sees - its neighbours and their sizes - changes only when one of those goes, and
    they in turn see nothing of it.  It may also go if it and all lower pending labels
    of its sample are sure of their target, the sample's largest face body: if that is
    larger than any other by more than all pending sizes, no order of merges lets
    another win.  So a hub with many small neighbours takes one round.
    """
    # only contacts of pending labels count: lowest pending label within one contact of a neighbour, then within two
    options = cut(_options(state, links))
    pending = state.filter("pending").select("ms_id", "body")
    at_one = (options.select("ms_id", "other", F.col("body").alias("_p"))
              .unionByName(pending.select("ms_id", F.col("body").alias("other"), F.col("body").alias("_p")))
              .groupBy("ms_id", "other").agg(F.min("_p").alias("_p")))
    at_two = options.select("ms_id", "body", "other").join(at_one, ["ms_id", "other"]).groupBy("ms_id", "body").agg(F.min("_p").alias("_low"))
    top = state.filter("face").groupBy("ms_id").agg(
        F.max_by("body", F.struct("size", -F.col("body"))).alias("_top"), F.max("size").alias("_most"),
        F.sum(F.when(F.col("pending"), F.col("size"))).alias("_all"))
    second = (state.filter("face").join(top.select("ms_id", "_top"), "ms_id").filter(F.col("body") != F.col("_top"))
              .groupBy("ms_id").agg(F.max("size").alias("_next")))
    gone_top = state.filter("pending").select("ms_id", F.col("body").alias("_top"), F.lit(True).alias("_leaves"))
    others = F.col("_all") - F.when(F.col("_leaves"), F.col("_most")).otherwise(0)  # what may go into another than the largest
    clear = (top.join(second, "ms_id", "left").join(gone_top, ["ms_id", "_top"], "left")
             .filter(F.col("_most") > F.coalesce("_next", F.lit(0)) + others).select("ms_id", "_top", "_leaves"))
    best = options.groupBy("ms_id", "body").agg(_largest().alias("into"))
    rated = (pending.join(best, ["ms_id", "body"], "left").join(at_two, ["ms_id", "body"], "left")
             .join(clear, "ms_id", "left")
             .select("ms_id", "body", "into", (F.coalesce("_low", "body") >= F.col("body")).alias("free"),
                     F.coalesce((F.col("into") == F.col("_top")) & (F.col("_leaves").isNull() | (F.col("_top") > F.col("body"))), F.lit(False)).alias("sure")))
    return _before_first(rated)


def _short_round(state: DataFrame, links: DataFrame) -> DataFrame:
    """Inner labels whose turn has come, with their target.

    Targets are the neighbours at the start of the pass, face bodies that stay; only
    their sizes change.  A label may go if no lower pending label shares a target with
    it, or if it and all lower pending labels of its sample are sure: their largest
    target stays ahead of each other one even if all labels around that go into it.
    """
    options = cut(_options(state, links))
    around = options.groupBy("ms_id", "other").agg(F.min("body").alias("_first"), F.sum("own").alias("_gain"))
    seen = options.join(around, ["ms_id", "other"])
    best = seen.groupBy("ms_id", "body").agg(_largest().alias("into"), F.max("osize").alias("_most"), F.min("_first").alias("_low"))
    rivals = (seen.join(best.select("ms_id", "body", "into"), ["ms_id", "body"]).filter(F.col("other") != F.col("into"))
              .groupBy("ms_id", "body").agg(F.max(F.col("osize") + F.col("_gain")).alias("_rival")))
    rated = (best.join(rivals, ["ms_id", "body"], "left")
             .select("ms_id", "body", "into", (F.col("_low") >= F.col("body")).alias("free"),
                     F.coalesce(F.col("_most") > F.col("_rival"), F.lit(True)).alias("sure")))
    return _before_first(rated)


def _absorb(state: DataFrame, pick: DataFrame) -> DataFrame:
    """The labels that are left, with the sizes of those that went into them."""
    turn = pick.select("ms_id", "body", "into", F.lit(True).alias("_went"))
    return (state.join(turn, ["ms_id", "body"], "left").withColumn("_stays", F.col("into").isNull())
            .groupBy("ms_id", F.coalesce("into", "body").alias("body"))
            .agg(F.sum("size").alias("size"), F.bool_or(F.col("face")).alias("face"),
                 F.bool_or(F.col("pending") & F.col("_went").isNull()).alias("pending")))


def _renamed(links: DataFrame, gone: DataFrame) -> DataFrame:
    near = gone.select("ms_id", "body", F.col("into").alias("_b"))
    far = gone.select("ms_id", F.col("body").alias("other"), F.col("into").alias("_o"))
    return (links.join(near, ["ms_id", "body"], "left").join(far, ["ms_id", "other"], "left")
            .select("ms_id", F.coalesce("_b", "body").alias("body"), F.coalesce("_o", "other").alias("other"))
            .filter("body <> other").distinct())


def relabel(vox: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply a merge map to the voxels; solid stays 0."""
    m = mapping.select("ms_id", "body", "merged_into")
    return vox.join(m, ["ms_id", "body"], "left").withColumn(
        "body", F.coalesce("merged_into", "body")).drop("merged_into")


def pool_surface_volumes(bodies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share the volume of dead-end surface bodies among the feeders they touch.

    Feeders are surface bodies with a pair to an inner body; a puddle is a
    connected set of surface bodies.
    """
    flag = bodies.select("ms_id", "body_id", "is_surface")
    tagged = (pairs.select("ms_id", "b1", "b2")
              .join(flag.select("ms_id", F.col("body_id").alias("b1"), F.col("is_surface").alias("s1")), ["ms_id", "b1"])
              .join(flag.select("ms_id", F.col("body_id").alias("b2"), F.col("is_surface").alias("s2")), ["ms_id", "b2"]))
    tagged = cut(tagged)
    feeders = (tagged.filter("s1 <> s2").select("ms_id", F.when(F.col("s1"), F.col("b1")).otherwise(F.col("b2")).alias("body_id"))
               .distinct().withColumn("is_feeder", F.lit(True)))
    puddle = graph.components(tagged.filter("s1 and s2").select("ms_id", F.col("b1").alias("u"), F.col("b2").alias("v")))
    member = (puddle.withColumnRenamed("node", "body_id").join(feeders, ["ms_id", "body_id"], "left")
              .join(bodies.select("ms_id", "body_id", "volume_voxels"), ["ms_id", "body_id"])
              .withColumn("is_feeder", F.coalesce("is_feeder", F.lit(False))))
    pooled = member.groupBy("ms_id", "component").agg(
        F.count_if("is_feeder").alias("n_feeders"),
        F.sum(F.when(~F.col("is_feeder"), F.col("volume_voxels")).otherwise(0)).alias("pooled"))
    share = (member.join(pooled, ["ms_id", "component"]).filter("n_feeders > 0 and pooled > 0")
             .select("ms_id", "body_id", F.when(F.col("is_feeder"), F.col("volume_voxels") + F.col("pooled") / F.col("n_feeders"))
                     .otherwise(0.0).alias("_v")))
    return (bodies.join(share, ["ms_id", "body_id"], "left")
            .withColumn("volume_voxels", F.coalesce("_v", F.col("volume_voxels").cast("double"))).drop("_v"))
