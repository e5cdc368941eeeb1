"""Voxel resistor network: links, potentials, currents, sample-scale transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespark.config import VoxelConfig
from porespark.operators import graph, grid
from porespark.operators.solve import RELATIVE_TOL, solve_recorded


def voxel_links(edges: DataFrame, nodes: DataFrame, cfg: VoxelConfig) -> DataFrame:
    """Inner resistors plus half-cell resistors to the two held faces."""
    g = float(cfg.conductance)
    inner = edges.select("ms_id", "u", "v", F.lit(g).alias("g"), F.lit(None).cast("double").alias("fixed"))
    ends = F.array_compact(F.array(F.when(F.col("is_inlet"), F.lit(cfg.inlet_value)),
                                   F.when(F.col("is_outlet"), F.lit(cfg.outlet_value))))
    held = (nodes.filter("is_inlet or is_outlet")
            .select("ms_id", F.col("node_id").alias("u"), F.lit(None).cast("long").alias("v"),
                    F.lit(2.0 * g).alias("g"), F.explode(ends).alias("fixed")))
    return inner.unionByName(held)


def voxel_solution(edges: DataFrame, nodes: DataFrame, cfg: VoxelConfig, labels: DataFrame | None = None,
                   kernel_rows: int | None = None, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``phi`` and the record of the solve.  Floating parts sit at the mid potential (K2).

    ``cfg.kcl_tol`` can only tighten the tolerance.  ``start`` is a first guess
    ``(ms_id, node_id, phi)`` on the same grid (K24).
    """
    solved, record = solve_recorded(voxel_links(edges, nodes, cfg), min(cfg.kcl_tol, RELATIVE_TOL), kernel_rows, start)
    return _with_potentials(nodes, solved, cfg, labels), record


def voxel_potentials(edges: DataFrame, nodes: DataFrame, cfg: VoxelConfig,
                     labels: DataFrame | None = None, kernel_rows: int | None = None) -> DataFrame:
    """``nodes`` with ``phi``."""
    return voxel_solution(edges, nodes, cfg, labels, kernel_rows)[0]


def _with_potentials(nodes: DataFrame, solved: DataFrame, cfg: VoxelConfig, labels: DataFrame | None) -> DataFrame:
    mid = 0.5 * (cfg.inlet_value + cfg.outlet_value)
    out = nodes.join(solved, ["ms_id", "node_id"], "left")
    if labels is None:
        return out.withColumn("phi", F.coalesce("phi", F.lit(mid)))
    kinds = graph.component_kinds(nodes, labels).select("ms_id", "component", "kind")
    tagged = labels.join(kinds, ["ms_id", "component"])
    return (out.join(tagged, ["ms_id", "node_id"])
            .withColumn("phi", F.when(F.col("kind") == "floating_disconnected", F.lit(mid))
                        .otherwise(F.coalesce("phi", F.lit(mid)))))


def edge_currents(edges: DataFrame, phi: DataFrame, g: Column | float) -> DataFrame:
    """``I = G (phi_u - phi_v)`` on every edge."""
    cond = F.lit(g) if isinstance(g, (int, float)) else g
    left = phi.select("ms_id", F.col("node_id").alias("u"), F.col("phi").alias("phi_u"))
    right = phi.select("ms_id", F.col("node_id").alias("v"), F.col("phi").alias("phi_v"))
    return (edges.join(left, ["ms_id", "u"]).join(right, ["ms_id", "v"])
            .withColumn("current", cond * (F.col("phi_u") - F.col("phi_v"))))


def effective_transport(vox: DataFrame, phi: DataFrame, currents: DataFrame, cfg: VoxelConfig) -> DataFrame:
    """Sample-scale conductance, formation factor and energies."""
    gb, vin, vout = 2.0 * cfg.conductance, cfg.inlet_value, cfg.outlet_value
    dx, sigma, drop = cfg.dx, cfg.sigma, abs(cfg.inlet_value - cfg.outlet_value)
    shape = grid.extents(vox)
    i_in = F.when(F.col("is_inlet"), gb * (vin - F.col("phi")))
    i_out = F.when(F.col("is_outlet"), gb * (F.col("phi") - vout))
    ends = phi.groupBy("ms_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.coalesce(F.sum(i_in), F.lit(0.0)).alias("i_in"),
        F.coalesce(F.sum(i_out), F.lit(0.0)).alias("i_out"),
        F.coalesce(F.sum(i_in * i_in), F.lit(0.0)).alias("_ein"),
        F.coalesce(F.sum(i_out * i_out), F.lit(0.0)).alias("_eout"),
        F.max(F.abs(i_in)).alias("max_inlet_current"))
    inner = currents.groupBy("ms_id").agg(
        F.sum(F.col("current") * F.col("current")).alias("_eint"),
        F.max(F.abs("current")).alias("max_edge_current"))
    n = F.array("nx", "ny", "nz")
    length = F.element_at(n, cfg.axis + 1) * F.lit(dx)
    volume = F.col("nx") * F.col("ny") * F.col("nz") * F.lit(dx ** 3)
    cross = F.col("v_domain") / F.col("l_sample")
    return (ends.join(inner, "ms_id", "left").join(shape, "ms_id")
            .withColumn("i_total", 0.5 * (F.col("i_in") + F.col("i_out")))
            .withColumn("delta_phi", F.lit(drop))
            .withColumn("l_sample", length.cast("double"))
            .withColumn("v_domain", volume.cast("double"))
            .withColumn("g_eff", F.col("i_total") / drop)
            .withColumn("g0", sigma * F.col("v_domain") / (F.col("l_sample") * F.col("l_sample")))
            .withColumn("one_over_f", F.col("g_eff") / F.col("g0"))
            .withColumn("f", F.when(F.col("one_over_f") <= 0, F.lit(float("inf")))
                        .otherwise(F.try_divide(F.lit(1.0), F.col("one_over_f"))))
            .withColumn("a_cross", cross)
            .withColumn("sigma_eff", F.col("g_eff") * F.col("l_sample") / F.col("a_cross"))
            .withColumn("relative_conductivity", F.col("sigma_eff") / sigma)
            .withColumn("energy_internal", F.coalesce(F.col("_eint"), F.lit(0.0)) / cfg.conductance)
            .withColumn("energy_boundary", (F.col("_ein") + F.col("_eout")) / gb)
            .withColumn("energy_total", F.col("energy_internal") + F.col("energy_boundary"))
            .withColumn("power_boundary", F.col("i_total") * drop)
            .drop("_ein", "_eout", "_eint", "nx", "ny", "nz"))


def kirchhoff_residual(phi: DataFrame, currents: DataFrame, cfg: VoxelConfig) -> DataFrame:
    """Net current of every node, boundary resistors included."""
    gb = 2.0 * cfg.conductance
    flows = currents.select("ms_id", F.explode(F.array(
        F.struct(F.col("u").alias("n"), F.col("current").alias("i")),
        F.struct(F.col("v").alias("n"), (-F.col("current")).alias("i")))).alias("e")).select(
        "ms_id", F.col("e.n").alias("node_id"), F.col("e.i").alias("i"))
    ends = phi.select("ms_id", "node_id", (
        F.when(F.col("is_inlet"), gb * (F.col("phi") - cfg.inlet_value)).otherwise(0.0)
        + F.when(F.col("is_outlet"), gb * (F.col("phi") - cfg.outlet_value)).otherwise(0.0)).alias("i"))
    net = flows.unionByName(ends).groupBy("ms_id", "node_id").agg(F.sum("i").alias("net"))
    return net.groupBy("ms_id").agg(F.max(F.abs("net")).alias("max_residual"),
                                    F.sqrt(F.avg(F.col("net") * F.col("net"))).alias("rms_residual"))
