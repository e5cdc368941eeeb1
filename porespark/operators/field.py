"""Steady-state field method: flux field, reconciled tortuosity, divergence.

The field comes from the same half-cell resistor grid as the voxel method;
``D_eff = 1/F`` and ``tau = porosity / D_eff`` (Cooper et al., 2016).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.operators import grid
from porespark.operators.grid import AXES
from porespark.plans.ordering import group_quantiles


def flux_field(phi: DataFrame) -> DataFrame:
    """Cell-centred potential differences: mean of the two masked face differences."""
    linked = grid.with_neighbours(phi.select("ms_id", *AXES, "phi"), ["phi"])
    cols = []
    for a in AXES:
        ahead = F.coalesce(F.col(f"{a}p.phi") - F.col("phi"), F.lit(0.0))
        back = F.coalesce(F.col("phi") - F.col(f"{a}m.phi"), F.lit(0.0))
        cols.append(((ahead + back) / 2.0).alias(f"j{a}"))
    return linked.select("ms_id", *AXES, "phi", *cols)


def field_metrics(flux: DataFrame, transport: DataFrame, axis: int = 0) -> DataFrame:
    """Porosity, D_eff, both tortuosities and constriction_factor."""
    size = F.sqrt(F.col("jx") ** 2 + F.col("jy") ** 2 + F.col("jz") ** 2)
    agg = flux.groupBy("ms_id").agg(F.avg(size).alias("flux_mean"), F.abs(F.avg(f"j{AXES[axis]}")).alias("flux_axis_mean"))
    t = transport.select("ms_id", (F.col("n_nodes") / F.col("v_domain")).alias("porosity"), F.col("one_over_f").alias("d_eff"))
    live = F.col("d_eff") > 1e-12
    return (agg.join(t, "ms_id")
            .withColumn("tau_solver", F.when(live, F.try_divide("porosity", "d_eff")))
            .withColumn("tau_reconciled", F.when(live, F.try_divide("flux_mean", "flux_axis_mean")))
            .withColumn("constriction_factor", F.try_divide(F.col("tau_reconciled") * F.col("tau_reconciled"), F.col("tau_solver"))))


def divergence(flux: DataFrame, vox: DataFrame) -> DataFrame:
    """Central-difference divergence on inner pore voxels, relative to mean |J|."""
    full = vox.select("ms_id", *AXES).join(flux, ["ms_id", *AXES], "left").select(
        "ms_id", *AXES, F.col("jx").isNotNull().alias("pore"), *[F.coalesce(f"j{a}", F.lit(0.0)).alias(f"j{a}") for a in AXES])
    linked = grid.with_neighbours(full, ["jx", "jy", "jz"])
    div = sum(((F.col(f"{a}p.j{a}") - F.col(f"{a}m.j{a}")) / 2.0 for a in AXES), F.lit(0.0))
    inner = linked.filter("pore").select("ms_id", *AXES, F.abs(div).alias("d")).filter("d is not null")
    size = F.sqrt(F.col("jx") ** 2 + F.col("jy") ** 2 + F.col("jz") ** 2)
    base = flux.groupBy("ms_id").agg(F.avg(size).alias("mean_abs_j"))
    stats = inner.groupBy("ms_id").agg(F.avg("d").alias("mean_abs_div"))
    quant = group_quantiles(inner, ["ms_id"], "d", {"median_abs_div": 0.5, "p90_abs_div": 0.9}, list(AXES))
    return (base.join(stats, "ms_id").join(quant, "ms_id")
            .withColumn("div_over_j", F.when(F.col("mean_abs_j") > 0, F.col("mean_abs_div") / F.nullif("mean_abs_j", F.lit(0.0)))))


def interface_flux(vox: DataFrame, flux: DataFrame) -> DataFrame:
    """Signed lo -> hi flux through each body interface."""
    full = vox.select("ms_id", *AXES, "body").join(flux.select("ms_id", *AXES, "jx", "jy", "jz"), ["ms_id", *AXES], "left")
    faces = grid.interface_faces(full, payload=("jx", "jy", "jz"))
    normal = F.element_at(F.array("jx_a", "jy_a", "jz_a"), F.col("axis") + 1)
    return faces.groupBy("ms_id", "lo", "hi").agg(F.sum(F.col("sign") * F.coalesce(normal, F.lit(0.0))).alias("flux"))


def plane_total_current(metrics: DataFrame, flux: DataFrame, shape: DataFrame, axis: int = 0) -> DataFrame:
    """``D_eff * A * dV / L`` (K33), NULL for an image that carries no current: there it would be rounding."""
    span = flux.groupBy("ms_id").agg((F.max("phi") - F.min("phi")).alias("delta_v"))
    n = {a: F.col(f"n{a}") for a in AXES}
    area = F.lit(1.0)
    for i, a in enumerate(AXES):
        if i != axis:
            area = area * n[a]
    return (metrics.select("ms_id", "d_eff").join(span, "ms_id").join(shape, "ms_id")
            .select("ms_id", F.when(F.col("d_eff") > 1e-8, F.col("d_eff") * area * F.col("delta_v") / n[AXES[axis]]).alias("i_total_plane")))
