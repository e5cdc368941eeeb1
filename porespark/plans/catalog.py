"""The registered queries: every operator over whole tables, at any scale factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespark.config import NETWORK_CONFIG_DEFAULTS, NetworkConfig, VoxelConfig
from porespark.functions import stats
from porespark.functions.scalar import aspect_ratio, before_after, drop_last_part, is_curved, safe_inverse, size_class, throat_equivalent_radius
from porespark.operators import (analysis, bodies, chord, collate, field, graph, grid, network, runs, throats, transport,
                                 tubes, whatif)
from porespark.operators.grid import AXES, node_coords
from porespark.plans import pipelines
from porespark.plans.lineage import cut
from porespark.plans.shape import shaped
from porespark.sources import derived

VOXEL = VoxelConfig(phase_id=1)
NAIVE = NetworkConfig(min_throat_size=1, area_method="naive", merge_bodies=False)
FULL = NetworkConfig(min_throat_size=1)
METHODS = ("click", "error", "purchase", "signup", "view")

SPECS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(spec: str):
    """Register a query under its function name with a fixed output shape."""
    def wrap(fn):
        name = fn.__name__
        SPECS[name] = spec
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir), spec)
        return fn
    return wrap


# --- voxel grids -------------------------------------------------------------------

def _images(spark, d) -> DataFrame:
    return derived.images(spark, d)


def _pore(spark, d) -> DataFrame:
    return grid.phase_mask(_images(spark, d), 1)


def _distances(spark, d) -> DataFrame:
    return grid.distance_transform(_images(spark, d), F.col("body") > 0, ["body"])


@query("ms_id:l n_pore:l n_voxels:l porosity:d6")
def pore_porosity(spark, d):
    return grid.porosity(_images(spark, d), 1)


@query("ms_id:l nx:l ny:l nz:l")
def shape_check(spark, d):
    return grid.extents(_images(spark, d))


@query("ms_id:l n_total:l n_disagree:l frac_agree:d6")
def mask_agreement(spark, d):
    return grid.mask_agreement(_images(spark, d), 1)


@query("ms_id:l plane:l pore_fraction:d6")
def plane_profile(spark, d):
    return grid.plane_profile(_images(spark, d), 1, 0)


@query("ms_id:l y:l z:l mean:d6 max:d6")
def axis_projection(spark, d):
    return grid.projection(_distances(spark, d), F.coalesce("edt", F.lit(0.0)), 0)


@query("ms_id:l n_inlet:l n_outlet:l touches_both:b")
def face_counts(spark, d):
    return grid.face_counts(_images(spark, d), 1, 0)


@query("ms_id:l x:l y:l z:l axis:l")
def stencil_edges(spark, d):
    return grid.edges(_pore(spark, d)).select("ms_id", *node_coords("u"), "axis")


@query("ms_id:l degree:l n_nodes:l")
def degree_hist(spark, d):
    return grid.degree_histogram(_pore(spark, d))


@query("ms_id:l x:l y:l z:l cx:l cy:l cz:l")
def components(spark, d):
    lab = graph.grid_components(_pore(spark, d))
    return lab.select("ms_id", *node_coords("node_id"),
                      *[c.alias(f"c{a}") for c, a in zip(node_coords("component"), AXES)])


@query("ms_id:l kind:s n_components:l n_nodes:l")
def component_kinds(spark, d):
    nodes = grid.nodes(_images(spark, d), 1)
    kinds = graph.component_kinds(nodes, graph.grid_components(nodes))
    return kinds.groupBy("ms_id", "kind").agg(F.count(F.lit(1)).alias("n_components"), F.sum("n_nodes").alias("n_nodes"))


@query("ms_id:l x:l y:l z:l edt:d6")
def edt(spark, d):
    return _distances(spark, d)


@query("ms_id:l x:l y:l z:l sat:l")
def summed_area(spark, d):
    return grid.summed_area(_images(spark, d), F.col("phase") == 1)


@query("ms_id:l body_id:l n_inside:l")
def sat_box(spark, d):
    vox = _images(spark, d)
    boxes = bodies.bounding_boxes(vox, 1).select(
        "ms_id", "body_id", *[F.col(f"lo_{a}") for a in AXES], *[(F.col(f"hi_{a}") - 1).alias(f"hi_{a}") for a in AXES])
    return grid.box_counts(boxes, grid.summed_area(vox, F.col("phase") == 1), ["body_id"])


@query("ms_id:l x:l y:l z:l body:l")
def boundary_voxels(spark, d):
    return grid.boundary_voxels(_images(spark, d))


@query("ms_id:l x:l y:l z:l dilated:b")
def dilation(spark, d):
    return grid.dilate(_images(spark, d), F.col("phase") == 1)


@query("ms_id:l lo:l hi:l r_throat:d6 voxel_count:l c0:d6 c1:d6 c2:d6")
def interfaces(spark, d):
    return grid.interfaces(_distances(spark, d))


@query("ms_id:l body:l other:l")
def label_adjacency(spark, d):
    return grid.label_adjacency(_images(spark, d))


@query("ms_id:l x:l y:l z:l")
def through_flow(spark, d):
    nodes = cut(grid.nodes(_images(spark, d), 1))
    arcs = grid.edges(nodes).select("ms_id", F.col("u").alias("tail"), F.col("v").alias("head"))
    both = graph.through_flow(arcs, nodes.filter("is_inlet").select("ms_id", F.col("node_id").alias("node")),
                              nodes.filter("is_outlet").select("ms_id", F.col("node_id").alias("node")))
    return both.select("ms_id", *node_coords("node"))


# --- voxel transport ----------------------------------------------------------------

def _voxel(spark, d) -> pipelines.VoxelRun:
    return pipelines.voxel_run(_images(spark, d), VOXEL)


@query("ms_id:l n_nodes:l i_in:d6 i_out:d6 i_total:d6 g_eff:d6 l_sample:d6 v_domain:d6 g0:d6 one_over_f:d6 sigma_eff:d6 "
       "energy_internal:d6 energy_boundary:d6 energy_total:d6 power_boundary:d6")
def kcl_transport(spark, d):
    return _voxel(spark, d).transport


@query("ms_id:l residual_ok:b")
def kcl_residual(spark, d):
    run = _voxel(spark, d)
    res = transport.kirchhoff_residual(run.phi, run.currents, VOXEL)
    return res.select("ms_id", (F.col("max_residual") < 1e-9).alias("residual_ok"))


@query("ms_id:l x:l y:l z:l axis:l current:d6")
def edge_currents(spark, d):
    return _voxel(spark, d).currents.select("ms_id", *node_coords("u"), "axis", "current")


MODES = (("physical", "geometric_dx"), ("physical", "unit_1"), ("unit_dx", "geometric_dx"), ("topological_G1", "geometric_dx"))


@query("ms_id:l mode:s length_mode:s sum_abs:d6")
def conductance_modes(spark, d):
    """Summed edge currents under every conductance formula, from one solve: potentials do not depend on it."""
    run = _voxel(spark, d)
    found = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(n).alias("length_mode"),
                               F.lit(VoxelConfig(conductance_mode=m, length_mode=n, dx=0.5).conductance).alias("g")) for m, n in MODES])
    edges = run.currents.select("ms_id", "u", "v", F.explode(found).alias("m")).select("ms_id", "u", "v", "m.*")
    return (transport.edge_currents(edges, run.phi, F.col("g")).groupBy("ms_id", "mode", "length_mode")
            .agg(F.sum(F.abs("current")).alias("sum_abs")))


@query("ms_id:l kind:l n_edges:l flow:d6")
def flow_dag(spark, d):
    run = _voxel(spark, d)
    dag = graph.prune_to_sink(tubes.voxel_dag(run.currents, run.phi, run.transport, VOXEL))
    return dag.groupBy("ms_id", "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("flow").alias("flow"))


@query("ms_id:l porosity:d6 d_eff:d6 tau_solver:d5 tau_reconciled:d5 constriction_factor:d5")
def field_metrics(spark, d):
    return pipelines.field_metrics(_images(spark, d), 1)[0]


@query("ms_id:l mean_abs_j:d6 mean_abs_div:d6 median_abs_div:d6 p90_abs_div:d6")
def field_divergence(spark, d):
    vox = _images(spark, d)
    return field.divergence(pipelines.field_metrics(vox, 1)[1], vox)


@query("ms_id:l lo:l hi:l flux:d6")
def interface_flux(spark, d):
    vox = _images(spark, d)
    return field.interface_flux(vox, pipelines.field_metrics(vox, 1)[1])


def _balance(spark, d, method):
    run = _voxel(spark, d)
    _, tube = pipelines.voxel_tubes(run, VOXEL, method)
    return tube.groupBy("ms_id").agg(F.sum("i_gamma").alias("i_decomp"), F.sum("v_gamma").alias("omega_c"))


@query("ms_id:l i_decomp:d6 omega_c:d6")
def tube_balance_greedy(spark, d):
    return _balance(spark, d, "greedy_fast")


@query("ms_id:l i_decomp:d6 omega_c:d6")
def tube_balance_topological(spark, d):
    return _balance(spark, d, "topological")


SUMMARY = ("ms_id:l n_paths:l omega:d6 omega_c:d6 phi:d6 phi_c:d6 i_decomp:d6 current_loss_rel:d6 tau_sq_c:d6 user_tortuosity:d6 "
           "c_c:d6 one_over_c_c:d6 one_over_f:d6 tortuosity_from_phi_c:d6 tortuosity_from_phi:d6")


@query(SUMMARY)
def streamtubes_greedy(spark, d):
    return pipelines.voxel_metrics(_images(spark, d), VOXEL, "greedy_fast")


@query(SUMMARY)
def streamtubes_topological(spark, d):
    return pipelines.voxel_metrics(_images(spark, d), VOXEL, "topological")


CHORD = ("ms_id:l tau_sq_c_chord:d6 user_tortuosity_chord:d6 total_bends:l accepted_bends:l rejected_bends:l "
         "n_paths_below_l_sample:l volume_weighted_length_removed:d6")


def _chord(spark, d, test):
    run = _voxel(spark, d)
    steps, tube = pipelines.voxel_tubes(run, VOXEL, "topological")
    return chord.chord_summary(steps, tube, run.nodes, run.transport, VOXEL, test)


@query(CHORD)
def chord_box(spark, d):
    return _chord(spark, d, "box")


@query(CHORD)
def chord_sampler(spark, d):
    return _chord(spark, d, "sampler")


# --- bodies and throats ---------------------------------------------------------------

@query("ms_id:l body_id:l nodal_state:l volume_voxels:l equivalent_radius:d6 max_radius:d6 cx:d6 cy:d6 cz:d6 vcx:d6 vcy:d6 vcz:d6 "
       "is_surface:b surface_area_voxels:l")
def body_props(spark, d):
    return bodies.body_props(_distances(spark, d))


@query("ms_id:l b1:l b2:l")
def bbox_pairs(spark, d):
    return bodies.candidate_pairs(bodies.bounding_boxes(_images(spark, d), 1), tile=2)


@query("ms_id:l body:l merged_into:l")
def body_merges(spark, d):
    return bodies.merge_map(_images(spark, d))


@query("ms_id:l body_id:l volume:d6")
def surface_pooling(spark, d):
    dist = cut(_distances(spark, d))
    pairs = grid.label_adjacency(dist).filter("body < other").select("ms_id", F.col("body").alias("b1"), F.col("other").alias("b2"))
    return bodies.pool_surface_volumes(bodies.body_props(dist), pairs).withColumnRenamed("volume_voxels", "volume")


@query("ms_id:l b1:l b2:l x:l y:l z:l")
def throat_voxels(spark, d):
    return throats.throat_voxels(_distances(spark, d))


@query("ms_id:l b1:l b2:l x:l y:l z:l")
def throat_voxels_one_sided(spark, d):
    return throats.throat_voxels(_distances(spark, d), dilate_both=False)


@query("ms_id:l throat_id:l body1_id:l body2_id:l volume_voxels:l tx:d6 ty:d6 tz:d6 length_cc:d6 length_via_ct:d6 curvature_ratio:d6 "
       "max_radius:d6 area_naive:d6")
def throat_extraction(spark, d):
    dist = cut(_distances(spark, d))
    return throats.extract_throats(dist, bodies.body_props(dist), NAIVE)


@query("ms_id:l throat_id:l is_curved:b equivalent_radius:d6 aspect_ratio:d6 inverse_length:d6")
def throat_shapes(spark, d):
    dist = cut(_distances(spark, d))
    out = throats.extract_throats(dist, bodies.body_props(dist), NAIVE)
    return (out.withColumn("equivalent_radius", throat_equivalent_radius("volume_voxels", "length_cc"))
            .select("ms_id", "throat_id", is_curved("curvature_ratio").alias("is_curved"), "equivalent_radius",
                    aspect_ratio("length_cc", "equivalent_radius").alias("aspect_ratio"), safe_inverse("length_cc").alias("inverse_length")))


@query("ms_id:l throat_id:l volume_voxels:l nx:d6 ny:d6 nz:d6 area_naive_projected:d6 area_vox_projection:d6 cos_theta:d6")
def throat_areas(spark, d):
    dist = cut(_distances(spark, d))
    out = throats.extract_throats(dist, bodies.body_props(dist), FULL)
    # the sign of a best-fit normal is arbitrary
    return out.select("ms_id", "throat_id", "volume_voxels", F.abs("nx").alias("nx"), F.abs("ny").alias("ny"), F.abs("nz").alias("nz"),
                      "area_naive_projected", "area_vox_projection", "cos_theta")


@query("ms_id:l n_throats:l total_throat_voxels:l overlap_voxels:l labelled_voxels:l")
def throat_conservation(spark, d):
    dist = cut(_distances(spark, d))
    tv = cut(throats.throat_voxels(dist))
    kept = cut(throats.extract_throats(dist, bodies.body_props(dist), NAIVE))
    lab = throats.throat_label_image(tv, kept).groupBy("ms_id").agg(F.count(F.lit(1)).alias("labelled_voxels"))
    return (kept.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_throats"), F.sum("volume_voxels").alias("total_throat_voxels"))
            .join(throats.overlap_voxels(tv, kept), "ms_id").join(lab, "ms_id"))


# --- body/throat network ----------------------------------------------------------------

def _naive(spark, d) -> pipelines.NetworkRun:
    return pipelines.network_run(_images(spark, d), NAIVE)


@query("ms_id:l throat_id:l i:l j:l l_body1:d6 l_throat:d6 l_body2:d6 a_body1:d6 throat_area:d6 a_body2:d6 throat_volume:d6 v_body1:d6 "
       "v_body2:d6 is_fallback:b r1:d6 r_throat:d6 r2:d6 g:d6")
def effective_geometry(spark, d):
    dist = cut(_distances(spark, d))
    body = cut(bodies.body_props(dist))
    flat = throats.effective_geometry(throats.extract_throats(dist, body, NAIVE), body, NAIVE)
    return network.with_conductance(flat)


@query("ms_id:l throat_id:l l_body1:d6 l_throat:d6 l_body2:d6 a_body1:d6 a_body2:d6 v_body1:d6 v_body2:d6 is_fallback:b")
def effective_geometry_weighted(spark, d):
    cfg = NetworkConfig(min_throat_size=1, area_method="naive", merge_bodies=False, split_volume_equal=False, alpha=0.3)
    dist = cut(_distances(spark, d))
    body = cut(bodies.body_props(dist))
    return throats.effective_geometry(throats.extract_throats(dist, body, cfg), body, cfg)


@query("ms_id:l body_id:l throat_id:l effective_distance:d6 effective_area:d6 effective_volume:d6")
def connection_recompute(spark, d):
    dist = cut(_distances(spark, d))
    body = cut(bodies.body_props(dist))
    flat = throats.effective_geometry(throats.extract_throats(dist, body, NAIVE), body, NAIVE)
    conn = throats.body_throat_table(flat, NAIVE.alpha)
    leg = throats.recompute_leg(F.col("distance"), F.col("body_path_area"), F.col("throat_area"), 0.25)
    return conn.select("ms_id", "body_id", "throat_id", *[c.alias(k) for k, c in leg.items()])


@query("ms_id:l n_bodies:l n_inlet:l n_outlet:l n_spanning:l")
def network_terminals(spark, d):
    dist = cut(_distances(spark, d))
    ends = network.with_terminals(bodies.body_props(dist), grid.extents(dist))
    return ends.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_bodies"), F.count_if("is_inlet").alias("n_inlet"),
                                     F.count_if("is_outlet").alias("n_outlet"), F.count_if("spans_domain").alias("n_spanning"))


@query("ms_id:l n_throats:l n_fallback_throats:l total_current:d6 effective_conductance:d6")
def network_transport(spark, d):
    return _naive(spark, d).totals


@query("ms_id:l throat_id:l current:d6 phi_1t:d6 phi_2t:d6")
def segment_potentials(spark, d):
    return _naive(spark, d).currents


@query("ms_id:l omega:d6 omega_c_direct:d6 iota_sq_g:d6 iota_sq_c_direct:d6 phi_total:d6 phi_c:d6")
def network_factors(spark, d):
    return _naive(spark, d).factors


@query("ms_id:l n_interior_checked:l residual_ok:b")
def network_kirchhoff(spark, d):
    run = _naive(spark, d)
    chk = network.kirchhoff_check(run.currents, run.bodies, run.totals)
    return chk.select("ms_id", "n_interior_checked", (F.col("max_abs_residual") < 1e-9).alias("residual_ok"))


@query("ms_id:l n_inlet_adjacent:l sum_abs_inlet:d6 net_from_inlet:d6")
def inlet_consistency(spark, d):
    return network.inlet_consistency(_naive(spark, d).currents)


@query("ms_id:l n_components:l largest:l")
def network_components(spark, d):
    comp = network.network_components(_naive(spark, d).flat)
    return comp.groupBy("ms_id", "component").count().groupBy("ms_id").agg(
        F.count(F.lit(1)).alias("n_components"), F.max("count").alias("largest"))


@query("ms_id:l body_id:l active:b")
def boundary_filter(spark, d):
    run = _naive(spark, d)
    return graph.boundary_connected(run.flat.filter("i is not null").select("ms_id", "i", "j"), run.bodies)


@query("ms_id:l body_id:l z_coordination:l")
def conducting_bodies(spark, d):
    run = _naive(spark, d)
    return network.conducting_bodies(run.currents, run.totals)


@query("ms_id:l n_removed:l dead_volume:l dead_share:d6")
def dead_volume(spark, d):
    run = _naive(spark, d)
    return network.dead_volume(run.bodies, network.conducting_bodies(run.currents, run.totals))


@query("ms_id:l n_paths:l i_decomp:d6 v_tubes:d6 mean_length:d6")
def all_simple_paths(spark, d):
    run = _naive(spark, d)
    _, tube = pipelines.network_tubes(run, "all_simple_paths")
    return tube.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_paths"), F.sum("i_gamma").alias("i_decomp"),
                                     F.sum("v_gamma").alias("v_tubes"), F.avg("l_gamma").alias("mean_length"))


def _net_balance(spark, d, method):
    run = _naive(spark, d)
    _, tube = pipelines.network_tubes(run, method)
    return tube.groupBy("ms_id").agg(F.sum("i_gamma").alias("i_decomp"), F.sum("v_gamma").alias("v_tubes"))


@query("ms_id:l i_decomp:d6 v_tubes:d6")
def network_tubes_greedy(spark, d):
    return _net_balance(spark, d, "greedy_fast")


@query("ms_id:l i_decomp:d6 v_tubes:d6")
def network_tubes_topological(spark, d):
    return _net_balance(spark, d, "topological")


@query("ms_id:l i_decomp:d6 v_tubes:d6")
def network_tubes_flow_decomposition(spark, d):
    return _net_balance(spark, d, "flow_decomposition")


NETWORK = " ".join(f"{k}:{'l' if k.startswith('n_') else 'd6'}" for k in whatif.METRIC_KEYS)


@query(f"ms_id:l solve_failed:b {NETWORK}")
def network_metrics(spark, d):
    return pipelines.network_metrics(pipelines.network_run(_images(spark, d), FULL), FULL)


@query("ms_id:l throat_id:l body1:l body2:l r_throat:d6 r_body1:d6 r_body2:d6 c:d6 c_geomean:d6 has_interface:b a_interface_voxels:l "
       "res_edge:d6 i_throat:d6 f:d6 p_edge_frac:d6 p_throat_only_frac:d6 z_body1:l z_body2:l class:s")
def throat_table(spark, d):
    return pipelines.throat_table(_naive(spark, d))


@query("ms_id:l throat_id:l i_voxel:d6 f_voxel:d6")
def throat_voxel_flux(spark, d):
    vox = cut(_images(spark, d))
    run = pipelines.network_run(vox, NAIVE)
    metrics, flux, _ = pipelines.field_metrics(vox, 1)
    ends = run.currents.filter("i is not null and j is not null").select("ms_id", "throat_id", F.col("i").alias("body1"), F.col("j").alias("body2"))
    return analysis.with_voxel_flux(ends, field.interface_flux(vox, flux), field.plane_total_current(metrics, flux, run.shape))


@query("ms_id:l body_id:l volume:l r_body:d6 z_coordination:l is_surface:b pos_frac_along_flow:d6 touches_any_topn:b touches_overlap_any:b")
def body_table(spark, d):
    run = _naive(spark, d)
    table = analysis.annotate(pipelines.throat_table(run))
    return analysis.body_table(run.bodies, table, network.conducting_bodies(run.currents, run.totals), run.shape)


@query("ms_id:l n_throats:l f_sum:d6")
def plane_sums(spark, d):
    run = _naive(spark, d)
    planes = run.shape.select("ms_id", F.explode(F.sequence(F.lit(1), F.col("nx") - 1)).alias("plane"))
    out = analysis.plane_current_sum(pipelines.throat_table(run), run.bodies, 0, planes)
    return out.groupBy("ms_id").agg(F.count(F.lit(1)).alias("n_throats"), F.sum("f_sum").alias("f_sum"))


@query("ms_id:l throat_id:l nn:d6")
def nn_distance(spark, d):
    dist = cut(_distances(spark, d))
    kept = throats.extract_throats(dist, bodies.body_props(dist), NAIVE)
    return analysis.nearest_neighbours(kept, ["ms_id"], "throat_id", ["tx", "ty", "tz"])


@query("ms_id:l n_marked:l n_total_valid:l observed_mean_nn:d6 null_mean_nn:d6 percentile:d6 clustered:b dispersed:b")
def clustering_null(spark, d):
    table = analysis.annotate(pipelines.throat_table(_naive(spark, d)))
    return analysis.clustering_report(table, "is_edge_highway")


@query("ms_id:l n_marked:l n_total_valid:l observed_mean_nn:d6 null_mean_nn:d6 null_std_nn:d6 percentile:d6 clustered:b dispersed:b")
def clustering_draws(spark, d):
    dist = cut(_distances(spark, d))
    kept = cut(throats.extract_throats(dist, bodies.body_props(dist), NAIVE))
    marked = whatif.rank_rule("volume_voxels", 30, "bottom")(kept).withColumn("c_geomean", F.lit(1.0))
    return analysis.clustering_report(marked, "selected", n_random=20, seed=5, coords=("tx", "ty", "tz"))


@query("property:s n_in:l n_out:l median_in:d6 median_out:d6 mean_in:d6 mean_out:d6 mannwhitney_u:d2 frac_surface_in:d6 frac_surface_out:d6")
def body_comparison(spark, d):
    run = _naive(spark, d)
    table = analysis.annotate(pipelines.throat_table(run))
    body = cut(analysis.body_table(run.bodies, table, network.conducting_bodies(run.currents, run.totals), run.shape))
    return analysis.body_comparison(body.withColumn("grp", F.lit(1)), "touches_any_topn", keys=("grp",))


# --- what-if -------------------------------------------------------------------------------

@query("ms_id:l n_throats:l n_removed:l n_left:l n_bodies_newly_isolated:l")
def prune_isolated(spark, d):
    dist = cut(_distances(spark, d))
    body = cut(bodies.body_props(dist))
    kept = cut(throats.extract_throats(dist, body, NAIVE))
    gone = cut(whatif.rank_rule("volume_voxels", 20, "bottom")(kept).filter("selected").select("ms_id", "throat_id"))
    left = cut(whatif.remove_throats(kept, gone))
    iso = whatif.newly_isolated(whatif.coordination_numbers(kept, body), whatif.coordination_numbers(left, body))

    def count(df, name):
        return df.groupBy("ms_id").agg(F.count(F.lit(1)).alias(name))
    out = count(kept, "n_throats").join(count(gone, "n_removed"), "ms_id", "left").join(count(left, "n_left"), "ms_id", "left").join(iso, "ms_id")
    return out.na.fill(0, ["n_removed", "n_left"])


@query("ms_id:l errored:b solve_failed:b n_throats_removed:l n_bodies_newly_isolated:l baseline_total_current:d6 pruned_total_current:d6 "
       "delta_total_current:d6 baseline_tau_sq_c:d6 pruned_tau_sq_c:d6 delta_tau_sq_c:d6")
def whatif_sweep(spark, d):
    return whatif.prune_and_recompute(_images(spark, d), FULL, "bottleneck")


@query("rule:s ms_id:l errored:b solve_failed:b n_throats_removed:l n_bodies_newly_isolated:l baseline_total_current:d6 "
       "pruned_total_current:d6 delta_total_current:d6")
def whatif_rules(spark, d):
    rules = {"thin": whatif.rank_rule("geometric_throat_area", 20, "bottom"), "wide": whatif.rank_rule("geometric_throat_area", 30, "top"),
             "random": whatif.random_rule(n=2, seed=3)}
    return whatif.sweep(_images(spark, d), NAIVE, rules)


@query("ms_id:l error:s")
def image_checks(spark, d):
    """Every third image lacks a voxel, every fifth gets it once more; with both an image is whole."""
    vox = _images(spark, d)
    first = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 1)
    return whatif.checked(vox.filter(~(first & (F.col("ms_id") % 3 == 0))).unionByName(vox.filter(first & (F.col("ms_id") % 5 == 0))))


@query("ms_id:l throat_id:l")
def random_rule(spark, d):
    rule = whatif.random_rule(match=whatif.rank_rule("c_geomean", 10, "bottom"), seed=0)
    return whatif.select_throats(_table(spark, d), rule)


# --- throat analysis on whole lineitem -------------------------------------------------------

def _table(spark, d) -> DataFrame:
    """Throat table of the derived network: shares, dissipation, class."""
    t = derived.throats(spark, d)
    tot = t.groupBy("ms_id").agg(F.sum("current_raw").alias("_i"), F.sum("flux_raw").alias("_v"))
    t = (t.join(tot, "ms_id").withColumn("f", F.col("current_raw") / F.col("_i")).withColumn("f_voxel", F.col("flux_raw") / F.col("_v")))
    sq = F.col("current_raw") * F.col("current_raw")
    t = t.withColumn("p_edge", sq * F.col("r_edge")).withColumn("p_throat_only", sq * F.col("r_throat_res"))
    return cut(analysis.shares_and_class(t.drop("_i", "_v")))


@query("ms_id:l throat_id:l class:s")
def classify(spark, d):
    return _table(spark, d)


@query("ms_id:l throat_id:l f:d9 p_edge_frac:d9 p_throat_only_frac:d9")
def dissipation_share(spark, d):
    return _table(spark, d)


@query("ms_id:l throat_id:l is_geo_bottleneck:b is_edge_highway:b is_throat_highway:b overlap_edge:b overlap_throat_only:b")
def topn_sets(spark, d):
    return analysis.annotate(_table(spark, d))


@query("ms_id:l level:s n:l n_throats:l n_valid:l n_intersection:l jaccard:d6 precision_of_top_n:d6 sum_dissipation_frac_in_top_n:d6 "
       "spearman:d6 pearson:d6")
def topn_overlap(spark, d):
    return analysis.overlap_report(_table(spark, d))


@query("ms_id:l throat_id:l level:s")
def overlap_rows(spark, d):
    return analysis.overlap_rows(_table(spark, d))


@query("ms_id:l throat_id:l selected:b")
def quantile_rule(spark, d):
    return whatif.RULES["bottleneck"](_table(spark, d))


@query("ms_id:l n_matched:l spearman:d6 pearson:d6 n_busy:l n_idle:l median_rel_err_busy:d6 p90_rel_err_busy:d6 median_abs_err_idle:d6 "
       "p90_abs_err_idle:d6 pass:b")
def cross_check(spark, d):
    return analysis.cross_check(_table(spark, d))


@query("ms_id:l throat_id:l rank:l cumulative_share:d6")
def current_concentration(spark, d):
    return analysis.current_concentration(_table(spark, d))


@query("ms_id:l throat_id:l ecdf:d9")
def ecdf(spark, d):
    return analysis.ecdf(_table(spark, d), "c_geomean")


@query("ms_id:l n_in:l n_out:l median_in:d6 median_out:d6 mannwhitney_u:d2")
def mannwhitney_u(spark, d):
    t = _table(spark, d).withColumn("inside", F.col("class") == "highway")
    return stats.compare_groups(t, ["ms_id"], "inside", "c_geomean", ["throat_id"])


def _collated(spark, d) -> DataFrame:
    names = derived.size_classes(spark, d)
    acct = derived.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ms_id"), F.col("s_acctbal").alias("porosity"))
    table = _table(spark, d)
    return collate.collate(table, names, acct, analysis.overlap_report(table))


@query("ms_id:l ms_name:s size_class:s n_throats:l median_c:d6 median_c_geomean:d6 frac_bottleneck_class:d6 frac_highway_class:d6 "
       "current_top10_frac:d6 cross_check_pass:b overlap_edge_jaccard:d6 overlap_throat_only_jaccard:d6 porosity:d6")
def collated(spark, d):
    return _collated(spark, d)


@query("size_class:s n:l mean:d6 sem:d6")
def size_class_sem(spark, d):
    return collate.by_size_class(_collated(spark, d), "current_top10_frac")


TYPE_METRICS = ("median_c", "median_c_geomean", "frac_bottleneck_class", "frac_highway_class", "current_top10_frac")


@query("type:s n:l " + " ".join(f"{m}:d6" for m in TYPE_METRICS))
def type_means(spark, d):
    return collate.by_group(_collated(spark, d).withColumn("type", drop_last_part("ms_name")), ["type"], TYPE_METRICS)


@query("size_class:s n:l r2:d6 mse:d6")
def r2_mse(spark, d):
    named = _table(spark, d).join(derived.size_classes(spark, d), "ms_id").withColumn("size_class", size_class("ms_name"))
    return stats.regression_fit(named, ["size_class"], "f_voxel", "f")


@query("ms_id:l text:s")
def before_after_delta(spark, d):
    t = _table(spark, d).groupBy("ms_id").agg(F.max("current_raw").alias("a"), F.max(F.when(F.col("class") == "bottleneck", F.col("current_raw"))).alias("b"))
    return t.select("ms_id", before_after(F.col("a"), F.col("b")).alias("text"))


# --- runs --------------------------------------------------------------------------------------

def _runs(spark, d) -> DataFrame:
    method = F.col("method")
    unknown = F.raise_error(F.concat(F.lit("no column for method "), method))
    asked = derived.run_requests(spark, d).withColumn("method", F.when(method.isNull() | method.isin(*METHODS), method).otherwise(unknown))
    req = runs.assign_versions(asked).withColumn("config_hash", runs.hash_column())
    return cut(runs.resolve_reuse(req))


def _metrics(r: DataFrame) -> DataFrame:
    return r.filter("status = 'real'").select("ms_id", "version", "method", F.lit("value").alias("key"), F.col("metric").alias("value"))


@query("ms_id:l method:s version:l status:s points_to_version:l config_hash:s has_full:b")
def run_pointers(spark, d):
    return _runs(spark, d)


@query("ms_id:l method:s version:l resolved_version:l value:d6")
def dereferenced_metrics(spark, d):
    r = _runs(spark, d)
    return runs.dereference(r, _metrics(r))


WIDE = " ".join(f"{m}.version:l {m}.is_pointer:b {m}.value:d6" for m in METHODS)
LONG = " ".join(f"{m}.status:s {m}.config_hash:s {m}.resolved_version:l {m}.value:d6" for m in METHODS)


@query(f"ms_id:l latest_version:l {WIDE}")
def latest_wide(spark, d):
    r = _runs(spark, d)
    return runs.latest_wide(r, _metrics(r), METHODS, ["value"])


@query(f"ms_id:l version:l {LONG}")
def all_versions_long(spark, d):
    r = _runs(spark, d)
    return runs.all_versions(r, _metrics(r), METHODS, ["value"])


@query("ms_id:l latest_version:l method:s status:s has_full:b best_version:l differs_from_naive:b")
def inventory(spark, d):
    return runs.inventory(_runs(spark, d), METHODS)


@query("method:s n_real:l n_pointer:l n_missing:l n_full:l n_no_full:l")
def inventory_counts(spark, d):
    return runs.inventory_counts(runs.inventory(_runs(spark, d), METHODS))


@query("ms_id:l method:s version:l has_full:b")
def config_match(spark, d):
    return runs.matching(_runs(spark, d), {"k": 42, "alpha": 0.5}, {**NETWORK_CONFIG_DEFAULTS})


@query("ms_id:l next_version:l")
def next_version(spark, d):
    return runs.next_version(_runs(spark, d))


@query("ms_id:l is_noop:b")
def noop_check(spark, d):
    r = _runs(spark, d)
    newest = r.groupBy("ms_id", "method").agg(F.max_by("config_hash", "version").alias("config_hash"))
    return runs.all_match_latest(r, newest)
