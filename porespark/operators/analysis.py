"""Throat and body tables, classification, overlap, cross-check, clustering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespark.functions import stats
from porespark.functions.scalar import classify, top_count
from porespark.operators.grid import AXES
from porespark.plans.lineage import cut, even
from porespark.plans.ordering import group_quantiles, with_position, with_positions, with_running_sum


# --- tables --------------------------------------------------------------------

def throat_table(currents: DataFrame, bodies: DataFrame, interfaces: DataFrame, tot: DataFrame) -> DataFrame:
    """One row per valid throat: radii, constriction, resistances, current, dissipation.

    ``r_*`` are radii, ``res_*`` are resistances.
    """
    t = currents.filter("i is not null and j is not null").withColumnRenamed("r_throat", "res_throat")
    face = interfaces.select("ms_id", "lo", "hi", F.col("r_throat"), F.col("voxel_count").alias("a_interface_voxels"),
                             F.col("c0").alias("centroid_z"), F.col("c1").alias("centroid_y"), F.col("c2").alias("centroid_x"))
    degree = (t.select("ms_id", F.explode(F.array("i", "j")).alias("body_id")).groupBy("ms_id", "body_id")
              .agg(F.count(F.lit(1)).alias("z")))
    ends = even(bodies.select("ms_id", "body_id", "max_radius").join(even(degree), ["ms_id", "body_id"]))
    # the pairs of bodies meet faces and ends on their own; the wide rows are then exchanged once, not three times
    pairs = t.select("ms_id", "i", "j").distinct().withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    pairs = pairs.join(even(face), ["ms_id", "lo", "hi"], "left").drop("lo", "hi")
    for k, end in (("1", "i"), ("2", "j")):
        pairs = pairs.join(ends.select("ms_id", F.col("body_id").alias(end), F.col("max_radius").alias(f"r_body{k}"), F.col("z").alias(f"z_body{k}")),
                           ["ms_id", end])
    t = t.join(even(pairs), ["ms_id", "i", "j"])
    t = t.join(tot.select("ms_id", "total_current"), "ms_id")
    sq = F.col("current") * F.col("current")
    return shares_and_class(t.select(
        "ms_id", "throat_id", F.col("i").alias("body1"), F.col("j").alias("body2"), "r_throat", "r_body1", "r_body2",
        F.try_divide(F.col("r_throat"), F.least("r_body1", "r_body2")).alias("c"),
        F.try_divide(F.col("r_throat"), F.sqrt(F.col("r_body1") * F.col("r_body2"))).alias("c_geomean"),
        F.col("a_interface_voxels").isNotNull().alias("has_interface"), "a_interface_voxels", "geometric_throat_area", "throat_area",
        "is_fallback", "a_body1", "a_body2", "l_body1", "l_throat", "l_body2", "g", F.col("r1").alias("res1"), "res_throat",
        F.col("r2").alias("res2"), F.col("r_edge").alias("res_edge"), F.col("current").alias("i_throat"),
        F.try_divide(F.abs("current"), F.col("total_current")).alias("f"), (sq * F.col("r_edge")).alias("p_edge"),
        (sq * F.col("res_throat")).alias("p_throat_only"), "centroid_z", "centroid_y", "centroid_x", "z_body1", "z_body2"))


def shares_and_class(t: DataFrame) -> DataFrame:
    """Dissipation shares of the sample total and the class.

    Totals are aggregated and joined back, so one sample is never one group.
    """
    agg = t.groupBy("ms_id").agg(F.sum("p_edge").alias("_pe"), F.sum("p_throat_only").alias("_pt"), F.max("f").alias("_fm"))

    def share(p: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(p) / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return (t.join(agg, "ms_id").withColumn("p_edge_frac", share("p_edge", "_pe"))
            .withColumn("p_throat_only_frac", share("p_throat_only", "_pt"))
            .withColumn("class", classify("c", "f", F.coalesce("_fm", F.lit(0.0)))).drop("_pe", "_pt", "_fm"))


def with_voxel_flux(table: DataFrame, flux: DataFrame, plane: DataFrame) -> DataFrame:
    """Voxel flux of each throat in body1 -> body2 direction and its share."""
    t = table.withColumn("lo", F.least("body1", "body2")).withColumn("hi", F.greatest("body1", "body2"))
    t = t.join(flux, ["ms_id", "lo", "hi"], "left").join(plane, "ms_id", "left")
    signed = F.when(F.col("body1") == F.col("lo"), F.col("flux")).otherwise(-F.col("flux"))
    return (t.withColumn("i_voxel", signed).withColumn("f_voxel", F.try_divide(F.abs(signed), F.col("i_total_plane")))
            .drop("lo", "hi", "flux", "i_total_plane"))


# --- top-N sets ------------------------------------------------------------------

def with_top_count(table: DataFrame, fraction: float = 0.10, at_least: int = 3) -> DataFrame:
    n = table.groupBy("ms_id").agg(top_count(F.count(F.lit(1)), fraction, at_least).alias("top_n"))
    return table.join(n, "ms_id")


def annotate(table: DataFrame, fraction: float = 0.10, at_least: int = 3, window_rows: int | None = None) -> DataFrame:
    """Five top-N flags (W5, T4, T5); equal values keep the lower throat id."""
    t = with_top_count(table, fraction, at_least)
    tid = F.col("throat_id").asc()
    t = with_positions(t, ["ms_id"], {
        "_g": [F.col("c_geomean").asc_nulls_last(), tid], "_e": [F.col("p_edge_frac").desc(), tid],
        "_t": [F.col("p_throat_only_frac").desc(), tid]}, window_rows)
    n = F.col("top_n")
    return (t.withColumn("is_geo_bottleneck", (F.col("_g") <= n) & F.col("c_geomean").isNotNull())
            .withColumn("is_edge_highway", F.col("_e") <= n).withColumn("is_throat_highway", F.col("_t") <= n)
            .withColumn("overlap_edge", F.col("is_geo_bottleneck") & F.col("is_edge_highway"))
            .withColumn("overlap_throat_only", F.col("is_geo_bottleneck") & F.col("is_throat_highway"))
            .drop("_g", "_e", "_t", "top_n"))


def overlap_sets(table: DataFrame, fraction: float = 0.10, at_least: int = 3, window_rows: int | None = None) -> DataFrame:
    """Set membership among throats with an interface, as the overlap report ranks them."""
    t = with_top_count(table, fraction, at_least)
    valid = F.col("c_geomean").isNotNull()
    tid, last = F.col("throat_id").asc(), (~valid).cast("int").asc()
    t = with_positions(t, ["ms_id"], {
        "_g": [F.col("c_geomean").asc_nulls_last(), tid], "_e": [last, F.col("p_edge_frac").desc(), tid],
        "_t": [last, F.col("p_throat_only_frac").desc(), tid]}, window_rows)
    n = F.col("top_n")
    return t.select("ms_id", "throat_id", "top_n", "c_geomean", "p_edge_frac", "p_throat_only_frac", valid.alias("valid"),
                    ((F.col("_g") <= n) & valid).alias("in_geo"), ((F.col("_e") <= n) & valid).alias("in_edge"),
                    ((F.col("_t") <= n) & valid).alias("in_throat"))


def overlap_report(table: DataFrame, fraction: float = 0.10, at_least: int = 3, p_values: bool = False,
                   window_rows: int | None = None) -> DataFrame:
    """Intersection, Jaccard, precision, top-N share and correlations, two rows per sample."""
    sets = cut(overlap_sets(table, fraction, at_least, window_rows))
    out = None
    for label, flag, value in (("edge", "in_edge", "p_edge_frac"), ("throat_only", "in_throat", "p_throat_only_frac")):
        both, either = F.col("in_geo") & F.col(flag), F.col("in_geo") | F.col(flag)
        agg = sets.groupBy("ms_id").agg(
            F.max("top_n").alias("n"), F.count(F.lit(1)).alias("n_throats"), F.count_if("valid").alias("n_valid"),
            F.count_if(both).alias("n_intersection"), F.count_if(either).alias("n_union"),
            F.coalesce(F.sum(F.when(F.col(flag), F.col(value))), F.lit(0.0)).alias("sum_dissipation_frac_in_top_n"))
        rho = stats.correlations(sets, ["ms_id"], "c_geomean", value, ["throat_id"], p_values=p_values, window_rows=window_rows).drop("n")
        part = (agg.join(rho, "ms_id", "left").withColumn("level", F.lit(label))
                .withColumn("jaccard", F.coalesce(F.try_divide("n_intersection", "n_union"), F.lit(0.0)))
                .withColumn("precision_of_top_n", F.coalesce(F.try_divide("n_intersection", "n"), F.lit(0.0))).drop("n_union"))
        out = part if out is None else out.unionByName(part)
    return out


def overlap_rows(table: DataFrame, fraction: float = 0.10, at_least: int = 3) -> DataFrame:
    """The throats in both sets, one row each."""
    sets = overlap_sets(table, fraction, at_least)
    level = F.explode(F.array_compact(F.array(F.when(F.col("in_geo") & F.col("in_edge"), "edge"),
                                              F.when(F.col("in_geo") & F.col("in_throat"), "throat_only"))))
    return sets.select("ms_id", "throat_id", level.alias("level"))


# --- distributions ---------------------------------------------------------------

def current_concentration(table: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Throats by falling f with the cumulative share of current."""
    total = table.groupBy("ms_id").agg(F.sum("f").alias("_total"))
    order = [F.col("f").desc(), F.col("throat_id").asc()]
    t = with_running_sum(table.select("ms_id", "throat_id", "f"), ["ms_id"], order, "f", "_run", window_rows)
    t = with_position(t, ["ms_id"], order, "rank", window_rows)
    return t.join(total, "ms_id").select("ms_id", "throat_id", "rank", "f", F.try_divide("_run", "_total").alias("cumulative_share"))


def ecdf(table: DataFrame, value: str, window_rows: int | None = None) -> DataFrame:
    """Sorted values with row_number / count."""
    t = table.filter(F.col(value).isNotNull()).select("ms_id", "throat_id", value)
    n = t.groupBy("ms_id").agg(F.count(F.lit(1)).alias("_n"))
    t = with_position(t, ["ms_id"], [F.col(value).asc(), F.col("throat_id").asc()], "_pos", window_rows)
    return t.join(n, "ms_id").select("ms_id", "throat_id", value, (F.col("_pos") / F.col("_n")).alias("ecdf"))


def resistance_split(table: DataFrame) -> DataFrame:
    """Mean share of body and throat resistance."""
    return table.groupBy("ms_id").agg(
        F.avg(F.col("res_throat") / F.col("res_edge")).alias("throat_share"),
        F.avg((F.col("res1") + F.col("res2")) / F.col("res_edge")).alias("body_share"))


def plane_current_sum(table: DataFrame, bodies: DataFrame, axis: int, planes: DataFrame) -> DataFrame:
    """Sum of f over throats straddling each plane (A37); ``planes``: ms_id, plane."""
    c = f"c{AXES[axis]}"
    t = table.select("ms_id", "body1", "body2", "f")
    for k in ("1", "2"):
        t = t.join(bodies.select("ms_id", F.col("body_id").alias(f"body{k}"), F.col(c).alias(f"p{k}")), ["ms_id", f"body{k}"])
    # a throat straddles a short run of integer planes: expand those, then join by equality
    lo, hi = F.least("p1", "p2"), F.greatest("p1", "p2")
    spans = (t.withColumn("_a", F.ceil(lo).cast("long")).withColumn("_b", (F.ceil(hi) - 1).cast("long")).filter("_b >= _a")
             .select("ms_id", "f", F.explode(F.sequence("_a", "_b")).alias("plane")))
    return (planes.withColumn("plane", F.col("plane").cast("long"))
            .join(spans.groupBy("ms_id", "plane").agg(F.sum("f").alias("f_sum")), ["ms_id", "plane"], "left")
            .withColumn("f_sum", F.coalesce("f_sum", F.lit(0.0))))


# --- cross-check -------------------------------------------------------------------

def cross_check(table: DataFrame, window_rows: int | None = None, p_values: bool = False) -> DataFrame:
    """Agreement of network and voxel current shares."""
    sub = cut(table.filter("f_voxel is not null").select("ms_id", "throat_id", "f", "f_voxel"))
    rho = stats.correlations(sub, ["ms_id"], "f_voxel", "f", ["throat_id"], p_values=p_values, window_rows=window_rows
                             ).withColumnRenamed("n", "n_matched")
    busy = sub.filter("f > 0.01").withColumn("err", F.abs(F.col("f_voxel") - F.col("f")) / F.col("f"))
    idle = sub.filter("f <= 0.01").withColumn("err", F.abs(F.col("f_voxel") - F.col("f")))
    qb = group_quantiles(busy, ["ms_id"], "err", {"median_rel_err_busy": 0.5, "p90_rel_err_busy": 0.9}, ["throat_id"], window_rows)
    qi = group_quantiles(idle, ["ms_id"], "err", {"median_abs_err_idle": 0.5, "p90_abs_err_idle": 0.9}, ["throat_id"], window_rows)
    n = sub.groupBy("ms_id").agg(F.count_if(F.col("f") > 0.01).alias("n_busy"), F.count_if(F.col("f") <= 0.01).alias("n_idle"))
    ok = (F.coalesce(F.col("spearman") > 0.95, F.lit(False))
          & ((F.col("n_busy") == 0) | F.coalesce(F.col("median_rel_err_busy") < 0.10, F.lit(False))))
    return rho.join(n, "ms_id").join(qb, "ms_id", "left").join(qi, "ms_id", "left").withColumn("pass", ok)


# --- bodies ------------------------------------------------------------------------

FLAGS = {"is_geo_bottleneck": "touches_geo_bottleneck", "is_edge_highway": "touches_edge_highway",
         "is_throat_highway": "touches_throat_highway", "overlap_edge": "touches_overlap_edge",
         "overlap_throat_only": "touches_overlap_throat_only"}


def body_table(bodies: DataFrame, annotated: DataFrame, conducting: DataFrame, shape: DataFrame, axis: int = 0) -> DataFrame:
    """Conducting bodies with position and contact flags."""
    touch = (annotated.select("ms_id", F.explode(F.array("body1", "body2")).alias("body_id"), *FLAGS)
             .groupBy("ms_id", "body_id").agg(*[F.bool_or(k).alias(v) for k, v in FLAGS.items()]))
    name = AXES[axis]
    b = (bodies.join(even(conducting), ["ms_id", "body_id"]).join(even(touch), ["ms_id", "body_id"], "left")
         .join(shape.select("ms_id", F.col(f"n{name}").alias("_n")), "ms_id"))
    flags = [F.coalesce(v, F.lit(False)).alias(v) for v in FLAGS.values()]
    b = b.select("ms_id", "body_id", F.col("volume_voxels").alias("volume"), F.col("max_radius").alias("r_body"), "z_coordination",
                 "is_surface", (F.col(f"c{name}") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("pos_frac_along_flow"),
                 F.col("cx").alias("centroid_z"), F.col("cy").alias("centroid_y"), F.col("cz").alias("centroid_x"), *flags)
    return (b.withColumn("touches_any_topn", F.col("touches_geo_bottleneck") | F.col("touches_edge_highway") | F.col("touches_throat_highway"))
            .withColumn("touches_overlap_any", F.col("touches_overlap_edge") | F.col("touches_overlap_throat_only")))


def body_comparison(body_df: DataFrame, flag: str, keys=("ms_id",),
                    props=("volume", "r_body", "z_coordination", "pos_frac_along_flow")) -> DataFrame:
    """Mann-Whitney comparison of each property, plus surface fractions."""
    out = None
    for prop in props:
        part = stats.compare_groups(body_df, list(keys), flag, prop, ["body_id"] if "ms_id" in keys else ["ms_id", "body_id"])
        out = part if out is None else out.unionByName(part)
    inside = F.col(flag)
    frac = body_df.groupBy(*keys).agg(F.avg(F.when(inside, F.col("is_surface").cast("double"))).alias("frac_surface_in"),
                                      F.avg(F.when(~inside, F.col("is_surface").cast("double"))).alias("frac_surface_out"))
    return out.join(frac, list(keys))


# --- nearest neighbours and clustering ------------------------------------------------

LEAF_POINTS = 16


def _tree(sites: DataFrame, keys: list[str], p: list[str], leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """Cells by level and the sites with their leaf: every cell of more than ``leaf`` sites is halved in each direction.

    A cell is named by its path, a digit per level, and kept with the tight box of its
    sites.  It is halved in the middle of that box, so at least two parts hold sites and
    a tight cluster is split as fast as a wide one, whatever lies far from it.
    """
    level, cells, placed = sites.select(*keys, *p, F.lit("").alias("cell")), [], None
    while True:
        box = cut(level.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo_{c}") for c in p],
                                                   *[F.max(c).alias(f"hi_{c}") for c in p]))
        cells.append(box)
        full = box.filter(F.col("n") > leaf)
        done = full.isEmpty()
        settled = level if done else level.join(full.select(*keys, "cell"), [*keys, "cell"], "left_anti")
        placed = settled if placed is None else placed.unionByName(settled)
        if done:
            return cells, placed
        bits = sum((F.when(F.col(c) > F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2, 1 << i).otherwise(0)
                    for i, c in enumerate(p)), F.lit(0))
        level = cut(level.join(full, [*keys, "cell"]).select(*keys, *p, F.concat("cell", bits.cast("string")).alias("cell")))


def nearest_neighbours(points: DataFrame, keys: list[str], point_id: str, coords: list[str], leaf: int = LEAF_POINTS) -> DataFrame:
    """Distance of every point to its nearest other point in its group.

    A group of at most four times ``leaf`` points is one row of points that are compared in
    their task, so that many small groups cost one exchange.  For the others an octree with at most
    ``leaf`` distinct sites in a leaf is built level by level.
    Their points then go down it together: a point keeps the cells that may hold its
    nearest neighbour - no farther than the far corner of a cell that does hold another
    point - and looks at sites in the leaves that remain.  Groups are never crossed with
    themselves; coincident points are settled by a count.  Points alone in their group
    get no row.
    """
    p = [f"p{i}" for i in range(len(coords))]
    pts = cut(points.select(*keys, F.col(point_id).alias("pid"), *[F.col(c).cast("double").alias(q) for q, c in zip(p, coords)]))
    big = cut(pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 4 * leaf).select(*keys))
    n = big.count()
    if not n:
        found = _within_rows(pts, keys, p)
    else:
        big = _few(big, n)
        found = _within_rows(pts.join(big, keys, "left_anti"), keys, p).unionByName(_down_tree(cut(pts.join(big, keys, "left_semi")), keys, p, leaf))
    return found.select(*keys, F.col("pid").alias(point_id), "nn")


def _apart(p: list[str], a, b) -> tuple[Column, Column]:
    """Whether two sites differ, and the square of their distance."""
    same = F.lit(True)
    for c in p:
        same = same & (a(c) == b(c))
    return ~same, sum(((a(c) - b(c)) * (a(c) - b(c)) for c in p), F.lit(0.0))


def _within_rows(pts: DataFrame, keys: list[str], p: list[str]) -> DataFrame:
    """Nearest other point in groups of a few points, group by group."""
    known = pts.filter(" and ".join(f"{k} is not null" for k in keys))
    rows = known.groupBy(*keys).agg(F.collect_list(F.struct(*p, "pid")).alias("_all"))
    # the pairs of a group stay in its task: they are grouped by the same keys
    pairs = (rows.select(*keys, "_all", F.posexplode("_all").alias("_at", "_a"))
             .select(*keys, "_at", "_a", F.explode("_all").alias("_b")))
    same, whole = F.lit(True), F.lit(True)
    for c in p:
        same = same & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
        whole = whole & F.col(f"_a.{c}").isNotNull()
    differ, d2 = _apart(p, lambda c: F.col(f"_a.{c}"), lambda c: F.col(f"_b.{c}"))
    seen = pairs.groupBy(*keys, "_at", F.col("_a.pid").alias("pid")).agg(
        F.count_if(same).alias("_n"), F.count_if(differ).alias("_others"), F.count_if(whole).alias("_whole"), F.min(F.when(differ, d2)).alias("_d2"))
    single = F.col("_n") == 1
    return (seen.filter((single & (F.col("_others") > 0)) | (~single & (F.col("_whole") > 0)))
            .select(*keys, "pid", F.when(single, F.sqrt("_d2")).otherwise(0.0).alias("nn")))


def _down_tree(pts: DataFrame, keys: list[str], p: list[str], leaf: int) -> DataFrame:
    """Nearest other point by way of the octree."""
    sites = cut(pts.groupBy(*keys, *p).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("sid")))
    cells, placed = _tree(sites, keys, p, leaf)
    gaps = {c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in p}
    least = sum((g * g for g in gaps.values()), F.lit(0.0))
    far = {c: F.greatest(F.abs(F.col(f"lo_{c}") - F.col(c)), F.abs(F.col(c) - F.col(f"hi_{c}"))) for c in p}
    most = sum((g * g for g in far.values()), F.lit(0.0))
    others = F.col("n") - F.when(F.greatest(*gaps.values()) == 0, 1).otherwise(0)  # boxes are disjoint: only its own holds a point
    own = Window.partitionBy(*keys, "sid")
    front = sites.filter("n = 1").select(*keys, *p, "sid", F.lit("").alias("parent"), F.lit(float("inf")).alias("reach"))
    leaves = None
    for depth, box in enumerate(cells):
        below = box.withColumn("parent", F.expr(f"left(cell, {max(depth - 1, 0)})"))
        met = (front.join(below, [*keys, "parent"]).withColumn("least", least).withColumn("most", most).filter(others > 0)
               .withColumn("reach", F.least("reach", F.min("most").over(own)))
               .filter(F.col("least") <= F.col("reach") * (1 + 1e-9)))
        met = cut(met.select(*keys, *p, "sid", "cell", "n", "least", "reach"))
        ends = met.filter(F.col("n") <= leaf).drop("n")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        front = met.filter(F.col("n") > leaf).select(*keys, *p, "sid", F.col("cell").alias("parent"), "reach")
    left = leaves.withColumn("reach", F.min("reach").over(own)).filter(F.col("least") <= F.col("reach") * (1 + 1e-9))
    sought = placed.select(*keys, "cell", *[F.col(c).alias(f"q{c}") for c in p])
    differ, d2 = _apart(p, F.col, lambda c: F.col(f"q{c}"))
    found = (left.join(sought, [*keys, "cell"]).filter(differ).groupBy(*keys, "sid").agg(F.sqrt(F.min(d2)).alias("nn"))
             .withColumnRenamed("sid", "pid"))
    twins = pts.join(sites.filter("n > 1").select(*keys, *p), [*keys, *p], "left_semi").select(*keys, "pid", F.lit(0.0).alias("nn"))
    return found.unionByName(twins)


FEW_ROWS = 50_000      # rows of a side that may be broadcast, whatever its table takes on disk
TASK_POINTS = 50_000   # points of a sample that may meet their draws in one task
TASK_DIGESTS = 4_000_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of a join: the planner goes by file sizes, and repeated values take far more room in memory than in a file."""
    return df if rows <= FEW_ROWS else even(df)


def drawn_subsets(points: DataFrame, sizes: DataFrame, point_id: str, n_draws: int = 1, seed: int = 0) -> DataFrame:
    """``(ms_id, draw, point_id)``: ``n_pick`` points per sample and draw, without replacement.

    ``sizes``: ms_id, n_total, n_pick.  A draw takes the first ``n_pick`` points in the
    order of the MD5 digest of ``seed:draw:ms_id:id``.  Only points whose digest is below
    a threshold, at which a few more than ``n_pick`` are expected, are shuffled and
    ranked; a draw that gets too few is repeated with twice the threshold.  The choice
    depends on seed, draw and ids alone, no task sees a whole sample of many points.
    What is pending is a row per sample, whose draws are told apart behind the join.
    """
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("ms_id").cast("string"), F.col(point_id).cast("string")))
    share = F.conv(F.substring("_hex", 1, 13), 16, 10).cast("double") / float(1 << 52)
    some = F.col("n_pick") + 4 * F.sqrt(F.col("n_pick")) + 4
    draws = F.coalesce("draws", F.sequence(F.lit(0), F.lit(n_draws - 1)))  # no list: all of them
    pending = cut(sizes.filter("n_pick > 0").select("ms_id", F.least("n_pick", "n_total").alias("n_pick"), "n_total", (some / F.col("n_total")).alias("_top"),
                                                    F.lit(None).cast("array<int>").alias("draws")))
    slim = points.select("ms_id", point_id)
    out = None
    while True:
        zero, many = F.lit(0), F.col("n_total") > TASK_POINTS
        n, work, top = pending.agg(F.coalesce(F.sum(F.size(draws)), zero), F.coalesce(F.sum(F.size(draws) * F.col("n_total")), zero),
                                   F.coalesce(F.max("n_total"), zero)).first()
        if n <= FEW_ROWS:
            met = slim.join(pending, "ms_id")
        else:  # tasks by digests: points are few bytes; samples of many points are few, and their points stay where they are
            width = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / TASK_DIGESTS))
            met = slim.repartition(width, "ms_id").join(even(pending.filter(~many)), "ms_id")
            met = met if top <= TASK_POINTS else met.unionByName(slim.join(pending.filter(many), "ms_id"))
        # digests as bytes keep their order in half the room
        tried = (met.select("ms_id", point_id, "n_pick", "_top", F.explode(draws).alias("draw")).withColumn("_hex", text).filter(share < F.col("_top"))
                 .select("ms_id", "draw", point_id, "n_pick", F.unhex("_hex").alias("_h")))
        placed = with_position(tried, ["ms_id", "draw"], [F.col("_h").asc(), F.col(point_id).asc()], "_pos").filter(F.col("_pos") <= F.col("n_pick"))
        placed = cut(placed.select("ms_id", "draw", point_id, "n_pick"))
        full = (placed.groupBy("ms_id", "draw").agg(F.count(F.lit(1)).alias("_n"), F.max("n_pick").alias("n_pick")).filter("_n >= n_pick")
                .groupBy("ms_id").agg(F.collect_list("draw").alias("_full")))
        rest = F.array_except(draws, F.coalesce("_full", F.array().cast("array<int>")))
        short = cut(pending.filter("_top <= 1").join(even(full), "ms_id", "left").withColumn("draws", rest).filter(F.size("draws") > 0)
                    .select("ms_id", "n_pick", "n_total", (F.col("_top") * 2).alias("_top"), "draws"))
        n = short.agg(F.coalesce(F.sum(F.size("draws")), zero)).first()[0]
        placed = placed.drop("n_pick")
        kept = placed if not n else placed.join(_few(short.select("ms_id", F.explode("draws").alias("draw")), n), ["ms_id", "draw"], "left_anti")
        out = kept if out is None else out.unionByName(kept)
        if not n:
            return out
        pending = short


def clustering_report(annotated: DataFrame, flag: str, n_random: int = 200, seed: int = 0,
                      coords: tuple[str, ...] = ("centroid_z", "centroid_y", "centroid_x")) -> DataFrame:
    """Mean nearest-neighbour distance of marked throats against random subsets."""
    coords = list(coords)
    valid = cut(annotated.filter("c_geomean is not null").select("ms_id", "throat_id", F.col(flag).alias("marked"), *coords))
    sizes = valid.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("marked").alias("n_pick"))
    tested = cut(sizes.filter("n_pick >= 3"))
    marked = valid.filter("marked").join(_few(tested.select("ms_id"), tested.count()), "ms_id", "left_semi")
    seen = (nearest_neighbours(marked, ["ms_id"], "throat_id", coords).groupBy("ms_id").agg(F.avg("nn").alias("observed")))
    drawn = drawn_subsets(valid, tested, "throat_id", n_random, seed).join(even(valid.select("ms_id", "throat_id", *coords)), ["ms_id", "throat_id"])
    null = (nearest_neighbours(drawn, ["ms_id", "draw"], "throat_id", coords).groupBy("ms_id", "draw").agg(F.avg("nn").alias("m")))
    # means that differ by rounding only are equal
    below = F.col("m") < F.col("observed") * (1 - 1e-12)
    agg = null.join(seen, "ms_id").groupBy("ms_id").agg(
        F.max("observed").alias("observed_mean_nn"), F.avg("m").alias("null_mean_nn"), F.stddev_pop("m").alias("null_std_nn"),
        (F.avg(below.cast("double")) * 100).alias("percentile"))
    return (sizes.join(agg, "ms_id", "left").select(
        "ms_id", F.col("n_pick").alias("n_marked"), F.col("n_total").alias("n_total_valid"), "observed_mean_nn", "null_mean_nn",
        "null_std_nn", "percentile", (F.col("percentile") < 5).alias("clustered"), (F.col("percentile") > 95).alias("dispersed")))
