"""Body/throat network: conductances, solve, segment potentials, global factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.config import AXIS_INDEX, NetworkConfig
from porespark.functions.scalar import MIN_LENGTH, segment_resistance
from porespark.operators import graph
from porespark.operators.grid import AXES
from porespark.operators.solve import RELATIVE_TOL, solve_recorded
from porespark.plans.lineage import even

DROP_FLOOR = 1e-12


def with_conductance(flat: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Series resistances and conductance of every throat."""
    return (flat.withColumn("r1", segment_resistance("l_body1", "a_body1", sigma))
            .withColumn("r_throat", segment_resistance("l_throat", "throat_area", sigma))
            .withColumn("r2", segment_resistance("l_body2", "a_body2", sigma))
            .withColumn("r_edge", F.col("r1") + F.col("r_throat") + F.col("r2"))
            .withColumn("g", 1.0 / F.col("r_edge")))


def with_terminals(bodies: DataFrame, shape: DataFrame, direction: str = "x") -> DataFrame:
    """Inlet/outlet flags from the surface centroid.

    A body on both faces averages to mid-domain and becomes neither; such rows
    get ``spans_domain``.
    """
    axis = AXES[AXIS_INDEX[direction]]
    last = F.col(f"n{axis}") - 1
    c = F.col(f"c{axis}")
    inlet = F.col("is_surface") & (c <= 1)
    outlet = F.col("is_surface") & ~(c <= 1) & (c >= last - 1)
    return (bodies.join(shape.select("ms_id", f"n{axis}"), "ms_id")
            .withColumn("is_inlet", inlet).withColumn("is_outlet", outlet)
            .withColumn("spans_domain", F.col("is_surface") & ~inlet & ~outlet).drop(f"n{axis}"))


def network_links(flat: DataFrame, bodies: DataFrame, delta_v: float) -> DataFrame:
    """Links of the reduced system: held bodies leave, their throats become held links."""
    held = F.when(F.col("is_inlet"), F.lit(float(delta_v))).when(F.col("is_outlet"), F.lit(0.0))
    end = even(bodies.select("ms_id", "body_id", held.alias("held")))
    t = (flat.filter("i is not null and j is not null").select("ms_id", "i", "j", "g")
         .join(end.select("ms_id", F.col("body_id").alias("i"), F.col("held").alias("hi")), ["ms_id", "i"])
         .join(end.select("ms_id", F.col("body_id").alias("j"), F.col("held").alias("hj")), ["ms_id", "j"]))
    free_i = F.col("hi").isNull()
    return t.filter("hi is null or hj is null").select(
        "ms_id", F.when(free_i, F.col("i")).otherwise(F.col("j")).cast("long").alias("u"),
        F.when(F.col("hi").isNull() & F.col("hj").isNull(), F.col("j")).cast("long").alias("v"), "g",
        F.coalesce("hi", "hj").alias("fixed"))


def network_solution(flat: DataFrame, bodies: DataFrame, delta_v: float = 1.0,
                     kernel_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``bodies`` with ``phi`` and the record of the solve; isolated and floating bodies sit at zero (K3, Q10)."""
    solved, record = solve_recorded(network_links(flat, bodies, delta_v), RELATIVE_TOL, kernel_rows)
    held = F.when(F.col("is_inlet"), F.lit(float(delta_v))).when(F.col("is_outlet"), F.lit(0.0))
    return (bodies.join(even(solved.withColumnRenamed("node_id", "body_id")), ["ms_id", "body_id"], "left")
            .withColumn("phi", F.coalesce(held, "phi", F.lit(0.0)))), record


def network_potentials(flat: DataFrame, bodies: DataFrame, delta_v: float = 1.0,
                       kernel_rows: int | None = None) -> DataFrame:
    """``bodies`` with ``phi``."""
    return network_solution(flat, bodies, delta_v, kernel_rows)[0]


def with_currents(flat: DataFrame, bodies: DataFrame, delta_v: float = 1.0) -> DataFrame:
    """Throat currents, end potentials and interface potentials.

    A drop below DROP_FLOOR of the applied one is solver rounding and counts as
    zero, so a network that does not percolate carries exactly no current.
    """
    end = even(bodies.select("ms_id", "body_id", "phi", "is_inlet", "is_outlet"))
    t = flat
    for k, e in (("i", "i"), ("j", "j")):
        t = t.join(end.select("ms_id", F.col("body_id").alias(e), F.col("phi").alias(f"phi_{k}"),
                              F.col("is_inlet").alias(f"inlet_{k}"), F.col("is_outlet").alias(f"outlet_{k}")),
                   ["ms_id", e], "left")
    drop = F.col("phi_i") - F.col("phi_j")
    current = F.when(F.abs(drop) > DROP_FLOOR * abs(delta_v), F.col("g") * drop).otherwise(0.0)
    t = t.withColumn("current", current)
    live = F.col("i").isNotNull() & F.col("j").isNotNull() & (F.abs("current") >= 1e-30)
    return (t.withColumn("phi_1t", F.when(live, F.col("phi_i") - F.col("current") * F.col("r1")))
            .withColumn("phi_2t", F.when(live, F.col("phi_j") + F.col("current") * F.col("r2"))))


def totals(currents: DataFrame, delta_v: float = 1.0) -> DataFrame:
    """Total current over inlet throats, conductance, threshold."""
    touches = F.coalesce("inlet_i", F.lit(False)) | F.coalesce("inlet_j", F.lit(False))
    return (currents.groupBy("ms_id").agg(
        F.count(F.lit(1)).alias("n_throats"), F.count_if("is_fallback").alias("n_fallback_throats"),
        F.coalesce(F.sum(F.when(touches, F.abs("current"))), F.lit(0.0)).alias("total_current"),
        F.max(F.abs("current")).alias("i_max"))
        .withColumn("effective_conductance", F.col("total_current") / delta_v if delta_v else F.lit(0.0))
        .withColumn("i_threshold", F.least(F.lit(1e-10) * F.abs("total_current"), F.lit(1e-10) * F.col("i_max"), F.lit(1e-10))))


def dead_volume(bodies: DataFrame, active: DataFrame) -> DataFrame:
    """Number, volume and share of the volume of the bodies that are not in ``active``."""
    marked = bodies.select("ms_id", "body_id", "volume_voxels").join(
        active.select("ms_id", "body_id").distinct().withColumn("_active", F.lit(True)), ["ms_id", "body_id"], "left")
    gone = F.col("_active").isNull()
    return marked.groupBy("ms_id").agg(
        F.count_if(gone).alias("n_removed"), F.sum(F.when(gone, F.col("volume_voxels")).otherwise(0)).alias("dead_volume"),
        F.sum("volume_voxels").alias("_all")).withColumn("dead_share", F.try_divide("dead_volume", "_all")).drop("_all")


def local_iota(currents: DataFrame, tot: DataFrame, shape: DataFrame, cfg: NetworkConfig) -> DataFrame:
    """Per-throat conductance-reduction factors of the three segments."""
    axis = AXES[cfg.axis]
    if abs(cfg.delta_v) < 1e-30:
        raise ValueError("delta_v is too close to zero")
    t = (currents.join(tot.select("ms_id", "i_threshold", "total_current"), "ms_id")
         .join(shape.select("ms_id", (F.col(f"n{axis}") * cfg.voxel_size).alias("delta_s")), "ms_id"))
    vol = F.col("v_body1") + F.col("throat_volume") + F.col("v_body2")
    scale = F.pow(F.col("delta_s") / cfg.delta_v, F.lit(2.0))
    t = (t.withColumn("v_total", vol)
         .withColumn("valid", F.col("i").isNotNull() & F.col("j").isNotNull() & (F.col("v_total") > 0))
         .withColumn("conducting", F.col("valid") & (F.abs("current") > F.col("i_threshold")) & F.col("phi_1t").isNotNull()))

    def factor(drop, length):
        return F.when(F.col("conducting"), F.pow(F.abs(drop) / F.greatest(F.col(length), F.lit(MIN_LENGTH)), F.lit(2.0)) * scale
                      ).otherwise(0.0)
    return (t.withColumn("iota1", factor(F.col("phi_i") - F.col("phi_1t"), "l_body1"))
            .withColumn("iota_t", factor(F.col("phi_1t") - F.col("phi_2t"), "l_throat"))
            .withColumn("iota2", factor(F.col("phi_2t") - F.col("phi_j"), "l_body2")))


def global_iota(iota: DataFrame, volume: DataFrame) -> DataFrame:
    """Omega, Omega_c, averages over both, porosities and formation factors.

    ``volume``: ``ms_id, v_domain`` (voxels in the image).
    """
    num = (F.col("v_body1") * F.col("iota1") + F.col("throat_volume") * F.col("iota_t") + F.col("v_body2") * F.col("iota2"))
    agg = iota.groupBy("ms_id").agg(
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("v_total"))), F.lit(0.0)).alias("omega"),
        F.coalesce(F.sum(F.when(F.col("conducting"), F.col("v_total"))), F.lit(0.0)).alias("omega_c_direct"),
        F.coalesce(F.sum(F.when(F.col("conducting"), num)), F.lit(0.0)).alias("_num"))

    def ratio(den):
        return F.when(F.col(den) > 1e-30, F.col("_num") / F.col(den)).otherwise(0.0)
    return (agg.join(volume, "ms_id")
            .withColumn("iota_sq_g", ratio("omega")).withColumn("iota_sq_c_direct", ratio("omega_c_direct"))
            .withColumn("phi_total", F.col("omega") / F.col("v_domain"))
            .withColumn("phi_c", F.col("omega_c_direct") / F.col("v_domain"))
            .withColumn("f_total", F.try_divide(F.lit(1.0), F.col("iota_sq_g") * F.col("phi_total")))
            .withColumn("f_c", F.try_divide(F.lit(1.0), F.col("iota_sq_c_direct") * F.col("phi_c"))).drop("_num"))


def kirchhoff_check(currents: DataFrame, bodies: DataFrame, tot: DataFrame) -> DataFrame:
    """Net current of inner bodies with throats, worst case per sample."""
    net = (currents.filter("i is not null").select("ms_id", F.explode(F.array(
        F.struct(F.col("i").alias("b"), (-F.col("current")).alias("c")),
        F.struct(F.col("j").alias("b"), F.col("current").alias("c")))).alias("e"))
        .groupBy("ms_id", F.col("e.b").alias("body_id")).agg(F.sum("e.c").alias("net")))
    inner = net.join(bodies.filter("not is_inlet and not is_outlet").select("ms_id", "body_id"), ["ms_id", "body_id"])
    out = inner.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_interior_checked"), F.max(F.abs("net")).alias("max_abs_residual"))
    return (tot.select("ms_id", "total_current").join(out, "ms_id", "left")
            .select("ms_id", F.coalesce("n_interior_checked", F.lit(0)).alias("n_interior_checked"),
                    F.coalesce("max_abs_residual", F.lit(0.0)).alias("max_abs_residual"), "total_current",
                    F.try_divide(F.coalesce("max_abs_residual", F.lit(0.0)), F.col("total_current")).alias("max_residual_frac")))


def inlet_consistency(currents: DataFrame) -> DataFrame:
    """Absolute and signed current of inlet-adjacent throats."""
    t = currents.filter("i is not null")
    a, b = F.coalesce("inlet_i", F.lit(False)), F.coalesce("inlet_j", F.lit(False))
    sign = F.when(a & ~b, 1.0).when(b & ~a, -1.0).otherwise(0.0)
    return t.groupBy("ms_id").agg(
        F.count_if(a | b).alias("n_inlet_adjacent"),
        F.sum(F.when(a | b, F.abs("current")).otherwise(0.0)).alias("sum_abs_inlet"),
        F.sum(sign * F.col("current")).alias("net_from_inlet"))


def conducting_bodies(currents: DataFrame, tot: DataFrame) -> DataFrame:
    """Bodies at either end of a throat with |I| >= threshold, and their coordination."""
    live = (currents.filter("i is not null").join(tot.select("ms_id", "i_threshold"), "ms_id")
            .filter((F.abs("current") >= F.col("i_threshold")) & (F.col("current") != 0)))
    return (live.select("ms_id", F.explode(F.array("i", "j")).alias("body_id"))
            .groupBy("ms_id", "body_id").agg(F.count(F.lit(1)).alias("z_coordination")))


def network_components(flat: DataFrame) -> DataFrame:
    """Components of the valid-throat graph (K1)."""
    return graph.components(flat.filter("i is not null").select("ms_id", F.col("i").alias("u"), F.col("j").alias("v")))
