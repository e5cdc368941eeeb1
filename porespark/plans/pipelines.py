"""End-to-end plans: voxel method, field method, network method, analysis, collation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespark.config import FieldConfig, NetworkConfig, VoxelConfig
from porespark.operators import analysis, bodies, chord, field, graph, grid, network, throats, transport, tubes
from porespark.operators.grid import AXES
from porespark.plans.lineage import cut


@dataclass(frozen=True)
class VoxelRun:
    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame
    phi: DataFrame
    currents: DataFrame
    transport: DataFrame
    record: DataFrame


@dataclass(frozen=True)
class NetworkRun:
    vox: DataFrame
    bodies: DataFrame
    throats: DataFrame
    flat: DataFrame
    currents: DataFrame
    totals: DataFrame
    iota: DataFrame
    factors: DataFrame
    shape: DataFrame
    record: DataFrame


def voxel_run(vox: DataFrame, cfg: VoxelConfig, kernel_rows: int | None = None, start: DataFrame | None = None) -> VoxelRun:
    """Voxel network -> potentials -> currents -> sample-scale transport.

    ``start`` is a first guess of the potentials, ``(ms_id, node_id, phi)``.
    """
    vox = cut(vox)
    nodes = cut(grid.nodes(vox, cfg.phase_id, cfg.axis))
    edges = cut(grid.edges(nodes))
    labels = cut(graph.grid_components(nodes))
    phi, record = transport.voxel_solution(edges, nodes, cfg, labels, kernel_rows, start)
    phi = cut(phi)
    currents = cut(transport.edge_currents(edges, phi, cfg.conductance))
    return VoxelRun(nodes, edges, labels, phi, currents, cut(transport.effective_transport(vox, phi, currents, cfg)), record)


def voxel_tubes(run: VoxelRun, cfg: VoxelConfig, method: str | None = None,
                kernel_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(path steps, tubes)`` of a voxel run."""
    dag = tubes.voxel_dag(run.currents, run.phi, run.transport, cfg)
    steps = tubes.decompose(dag, method or cfg.decomposition_method, kernel_rows)
    return steps, cut(tubes.voxel_tubes(steps, run.transport, cfg))


def voxel_metrics(vox: DataFrame, cfg: VoxelConfig, method: str | None = None) -> DataFrame:
    """All voxel metrics per sample; chord-corrected ones when the config asks."""
    run = voxel_run(vox, cfg)
    return voxel_run_metrics(run, cfg, *voxel_tubes(run, cfg, method))


def voxel_run_metrics(run: VoxelRun, cfg: VoxelConfig, steps: DataFrame, tube: DataFrame) -> DataFrame:
    out = tubes.voxel_summary(tube, run.transport, cfg)
    if cfg.tortuosity_mode == "chord_corrected":
        out = out.join(chord.chord_summary(steps, tube, run.nodes, run.transport, cfg), "ms_id")
    return out


def field_metrics(vox: DataFrame, phase_id: int = 1, axis: int = 0) -> tuple[DataFrame, DataFrame, VoxelRun]:
    """``(metrics, flux field, run)`` of the field method."""
    run = voxel_run(vox, VoxelConfig(phase_id=phase_id, axis=axis))
    flux = cut(field.flux_field(run.phi))
    return field.field_metrics(flux, run.transport, axis), flux, run


def prepare_bodies(vox: DataFrame, cfg: NetworkConfig) -> DataFrame:
    """Distance transform and, unless switched off, both body merges."""
    out = cut(grid.distance_transform(vox, F.col("body") > 0, ["body"]))
    if cfg.merge_bodies:
        out = cut(bodies.relabel(out, bodies.merge_map(out, cfg.axis)))
    return out


def solve_network(vox: DataFrame, body: DataFrame, throat: DataFrame, shape: DataFrame, cfg: NetworkConfig,
                  kernel_rows: int | None = None) -> NetworkRun:
    """Effective geometry, conductances, potentials, currents, factors of given throats."""
    flat = cut(network.with_conductance(throats.effective_geometry(throat, body, cfg), cfg.sigma))
    ends = network.with_terminals(body, shape, cfg.direction)
    solved, record = network.network_solution(flat, ends, cfg.delta_v, kernel_rows)
    solved = cut(solved)
    currents = cut(network.with_currents(flat, solved, cfg.delta_v))
    tot = cut(network.totals(currents, cfg.delta_v))
    # not stored: a projection of stored tables, of which each reader needs a few columns
    iota = network.local_iota(currents, tot, shape, cfg)
    volume = shape.select("ms_id", (F.col("nx") * F.col("ny") * F.col("nz")).cast("double").alias("v_domain"))
    return NetworkRun(vox, solved, throat, flat, currents, tot, iota, network.global_iota(iota, volume), shape, record)


def network_run(vox: DataFrame, cfg: NetworkConfig, kernel_rows: int | None = None) -> NetworkRun:
    """Labelled voxels -> bodies -> throats -> solved network."""
    ready = prepare_bodies(vox, cfg)
    shape = cut(grid.extents(ready))
    body = cut(bodies.body_props(ready, cfg.axis))
    throat = cut(throats.extract_throats(ready, body, cfg))
    return solve_network(ready, body, throat, shape, cfg, kernel_rows)


def network_tubes(run: NetworkRun, method: str, kernel_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    dag = tubes.network_dag(run.currents, run.bodies, run.totals)
    if method == "all_simple_paths":
        steps = tubes.all_simple_paths(dag, run.totals, kernel_rows, terms=tubes.throat_terms(run.iota))
    else:
        steps = tubes.decompose(dag, method, kernel_rows)
    return steps, cut(tubes.network_tubes(steps, run.iota))


def network_metrics(run: NetworkRun, cfg: NetworkConfig) -> DataFrame:
    """All network metrics per sample.  A sample without a conducting route keeps
    its counts and has ``solve_failed`` set."""
    steps, tube = network_tubes(run, cfg.streamtube_method)
    summary = tubes.network_summary(tube, run.iota, cfg.delta_v)
    n_bodies = run.bodies.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_bodies"))
    out = (n_bodies.join(run.totals.drop("i_max"), "ms_id", "left").join(run.factors, "ms_id", "left").join(summary, "ms_id", "left"))
    out = (out.join(tubes.stuck_volume(steps, run.iota), "ms_id", "left")
           .withColumn("v_stuck_total", F.coalesce("v_stuck_total", F.lit(0.0))))
    return (out.withColumn("solve_failed", F.col("n_streamtubes").isNull())
            .withColumn("inv_tau_sq_c", F.try_divide(F.lit(1.0), F.col("tau_sq_c")))
            .withColumn("inv_c_c", F.try_divide(F.lit(1.0), F.col("c_c")))
            .withColumn("inv_f_c", F.try_divide(F.lit(1.0), F.col("f_c"))))


def throat_table(run: NetworkRun) -> DataFrame:
    """Throat table of a solved network with its geometric interfaces."""
    return cut(analysis.throat_table(run.currents, run.bodies, grid.interfaces(run.vox), run.totals))


def analyse(vox: DataFrame, cfg: NetworkConfig, phase_id: int = 1, fraction: float = 0.10,
            n_random: int = 200) -> dict[str, DataFrame]:
    """Throat, body, overlap, comparison and clustering tables of every sample, solved here."""
    metrics, flux, _ = field_metrics(vox, phase_id, cfg.axis)
    return analysis_tables(network_run(vox, cfg), metrics, flux, cfg.axis, fraction, n_random)


#: Throat sets whose clustering an analysis tests.
CLUSTERED_SETS = ("is_geo_bottleneck", "is_edge_highway", "is_throat_highway")


def analysis_tables(run: NetworkRun, metrics: DataFrame, flux: DataFrame, axis: int, fraction: float = 0.10,
                    n_random: int = 200) -> dict[str, DataFrame]:
    """The tables of ``analyse`` from a network run and the field method's metrics and flux, fresh or stored."""
    plane = field.plane_total_current(metrics, flux, run.shape, axis)
    table = analysis.with_voxel_flux(throat_table(run), field.interface_flux(run.vox, flux), plane)
    table = cut(analysis.annotate(table, fraction))
    body = cut(analysis.body_table(run.bodies, table, network.conducting_bodies(run.currents, run.totals), run.shape, axis))
    clustering = None
    for flag in CLUSTERED_SETS:
        part = analysis.clustering_report(table, flag, n_random).withColumn("throat_set", F.lit(flag.removeprefix("is_")))
        clustering = part if clustering is None else clustering.unionByName(part)
    return {"throats": table, "bodies": body, "overlap": analysis.overlap_report(table, fraction, p_values=True),
            "overlap_rows": analysis.overlap_rows(table, fraction),
            "comparison": analysis.body_comparison(body, "touches_overlap_any"), "clustering": clustering,
            "cross_check": analysis.cross_check(table, p_values=True), "field": metrics}


# --- runs with their results kept ------------------------------------------------------

def field_result(vox: DataFrame, cfg: FieldConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(metrics, tables to keep)`` of the field method."""
    metrics, flux, run = field_metrics(vox, cfg.phase_id, cfg.axis)
    return metrics, {"metrics": metrics, "flux": flux, "phi": run.phi, "shape": grid.extents(vox), "record": run.record}


def voxel_result(vox: DataFrame, cfg: VoxelConfig, start: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    run = voxel_run(vox, cfg, start=start)
    steps, tube = voxel_tubes(run, cfg)
    return (voxel_run_metrics(run, cfg, steps, tube).join(run.record.select("ms_id", "iterations", "residual", "converged", "started"), "ms_id", "left"),
            {"phi": run.phi, "currents": run.currents, "transport": run.transport, "tubes": tube, "shape": grid.extents(vox),
             "record": run.record})


def network_result(vox: DataFrame, cfg: NetworkConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    run = network_run(vox, cfg)
    return network_metrics(run, cfg), {f.name: getattr(run, f.name) for f in fields(NetworkRun)}


def stored_network(load: Callable[[str], DataFrame]) -> NetworkRun:
    """A network run from its stored tables; nothing is solved."""
    return NetworkRun(**{f.name: load(f.name) for f in fields(NetworkRun)})


def same_grid(start: DataFrame, stored_shape: DataFrame, shape: DataFrame) -> DataFrame:
    """The rows of a first guess whose sample had the shape it has now."""
    sides = [f"n{a}" for a in AXES]
    return start.join(stored_shape.join(shape, ["ms_id", *sides]).select("ms_id"), "ms_id", "left_semi")
