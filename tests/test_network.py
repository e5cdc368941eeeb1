import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from porespark.config import NetworkConfig
from porespark.operators import analysis, bodies, geometry, graph, grid, network, solve, throats, tubes, whatif
from porespark.plans import pipelines
from porespark.plans.lineage import cut


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(5)
    out = {}
    for k in range(4):
        body = rng.integers(0, 9, (5, 4, 4))
        out[f"s{k}"] = ((body > 0).astype(int), body)
    return out


@pytest.fixture(scope="module")
def quadrants():
    """Slab-quadrant bodies that conduct from the first to the last layer."""
    rng = np.random.default_rng(8)
    x, y, z = np.meshgrid(range(5), range(4), range(4), indexing="ij")
    out = {}
    for k in range(3):
        pore = rng.random((5, 4, 4)) < 0.8
        out[f"q{k}"] = (pore.astype(int), np.where(pore, 1 + 4 * x + 2 * (y // 2) + z // 2, 0))
    return out


def test_merges_match_image_relabelling(spark, labelled):
    got = bodies.merge_map(brute.frame(spark, labelled), 0).toPandas()
    for ms, (_, body) in labelled.items():
        want = brute.merge_bodies(body)
        m = got[got["ms_id"] == ms].set_index("body")["merged_into"]
        for b in np.unique(body[body > 0]):
            assert set(want[body == b]) == {m[b]}


def _random_graphs():
    """Sizes, faces and contacts: sparse, dense, tied sizes, and hubs with many small neighbours."""
    rng = np.random.default_rng(11)
    for k in range(14):
        n, p, face = int(rng.integers(3, 12)), rng.choice([0.08, 0.2, 0.5]), rng.choice([0.4, 0.8, 1.0])
        size = rng.integers(1, 5 if k % 2 else 100, n)
        pairs = [(a + 1, b + 1) for a in range(n) for b in range(a) if rng.random() < p]
        yield f"g{k}", dict(zip(range(1, n + 1), size.tolist())), {b for b in range(1, n + 1) if rng.random() < face}, pairs
    many = range(1, 61)
    yield "faces", {**dict.fromkeys(many, 1), 400: 10_000, 401: 50}, {*many, 400, 401}, [(b, h) for b in many for h in (400, 401) if h == 400 or b % 3 == 0]
    yield "inner", {**dict.fromkeys(many, 2), 400: 10_000, 401: 50}, {400, 401}, [(b, h) for b in many for h in (400, 401) if h == 400 or b % 3 == 0]


def test_merges_follow_the_sequential_rule(spark, monkeypatch):
    graphs = list(_random_graphs())
    info = [(m, b, n, b in face) for m, size, face, _ in graphs for b, n in size.items()]
    links = [(m, *x) for m, _, _, pairs in graphs for a, b in pairs for x in ((a, b), (b, a))]
    rounds = []
    for name in ("_face_round", "_short_round"):
        real = getattr(bodies, name)
        monkeypatch.setattr(bodies, name, lambda *x, real=real, name=name: rounds.append(name) or real(*x))
    got = bodies.merge_graph(spark.createDataFrame(info, "ms_id string, body long, size long, face boolean"),
                             spark.createDataFrame(links, "ms_id string, body long, other long")).collect()
    for m, size, face, pairs in graphs:
        mapping, n_face, n_short = brute.merge_sequentially(size, face, pairs)
        mine = [r for r in got if r["ms_id"] == m]
        assert {r["body"]: r["merged_into"] for r in mine} == mapping
        assert {(r["n_face_merged"], r["n_short_merged"]) for r in mine} == {(n_face, n_short)}
    assert len(rounds) < 24  # not one for each of the 120 labels around the hubs


def test_a_round_of_merges_reads_the_contacts_once(spark):
    """What a label sees within two contacts comes from the contacts of pending labels, not from joins of all contacts."""
    graphs = list(_random_graphs())
    info = spark.createDataFrame([(m, b, n, b in face) for m, size, face, _ in graphs for b, n in size.items()],
                                 "ms_id string, body long, size long, face boolean")
    links = cut(spark.createDataFrame([(m, *x) for m, _, _, pairs in graphs for a, b in pairs for x in ((a, b), (b, a))],
                                      "ms_id string, body long, other long").distinct())
    for stage, round_of in (("face", bodies._face_round), ("short", bodies._short_round)):
        state = bodies._with_pending(info, links, stage)
        pick = round_of(state, links)
        assert not set(pick.inputFiles()) & set(links.inputFiles())
        near = {}
        for m, b, o in links.collect():
            near.setdefault((m, b), set()).add(o)
        face = {(r["ms_id"], r["body"]): r["face"] for r in info.collect()}
        want = {k for k, others in near.items() if face[k] == (stage == "face") and all(face[k[0], o] for o in others)}
        assert {(r["ms_id"], r["body"]) for r in state.filter("pending").collect()} == want
        assert want and {(r["ms_id"], r["body"]) for r in pick.collect()} <= want


def test_strip_union_equals_raster_and_single_cube():
    n = np.array([1.0, 2.0, 2.0]) / 3
    e1 = np.array([2.0, -2.0, 1.0]) / 3
    e2 = np.cross(n, e1)
    one = sum(geometry.strip_union_area([0.0], [0.0], e1, e2, y, y + 1) for y in np.arange(-3.0, 3.0))
    assert one == pytest.approx(np.abs(n).sum())  # shadow of a unit cube
    cubes = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [3, 1, 2]])
    px, py = cubes @ e1, cubes @ e2
    area = sum(geometry.strip_union_area(px, py, e1, e2, y, y + 2) for y in np.arange(-8.0, 8.0, 2))
    corners = geometry.CORNERS
    g = np.arange(-6, 6, 0.01)
    rng = np.random.default_rng(0)  # one random point per raster cell: no bias along the edges
    gx, gy = (m + 0.01 * rng.random(m.shape) for m in np.meshgrid(g, g))
    inside = np.zeros(gx.shape, bool)
    hull = geometry._hull(np.stack([corners @ e1, corners @ e2], 1))
    for a, b in zip(px, py):
        ok = np.ones(gx.shape, bool)
        for (x0, y0), (x1, y1) in zip(hull, np.roll(hull, -1, 0)):
            ok &= (x1 - x0) * (gy - b - y0) - (y1 - y0) * (gx - a - x0) >= 0
        inside |= ok
    assert area == pytest.approx(inside.sum() * 0.01 ** 2, rel=2e-3)


def test_tiles_add_up_to_the_whole_footprint(spark):
    """Clipped tiles against the union of whole strips, on flat, oblique and thick sheets of voxels."""
    rng = np.random.default_rng(5)
    sheets = {"flat": np.argwhere(np.ones((40, 37, 1), bool)), "thick": np.argwhere(rng.random((25, 20, 3)) < 0.4),
              "sparse": rng.integers(-60, 60, (120, 3))}
    normals = {"flat": (0.0, 0.0, 1.0), "thick": (0.2, 0.3, 0.93), "sparse": (0.6, -0.5, 0.62)}
    rows, planes, want = [], [], {}
    for name, at in sheets.items():
        n = np.array(normals[name]) / np.linalg.norm(normals[name])
        e1 = np.cross(n, (0.0, 1.0, 0.0))
        e1 /= np.linalg.norm(e1)
        e2, centre = np.cross(n, e1), at.mean(axis=0)
        rows += [(name, *map(int, v)) for v in at]
        planes.append((name, [float(v) for v in (*n, *e1, *e2)], *map(float, centre)))
        px, py = (at - centre) @ e1, (at - centre) @ e2
        want[name] = sum(geometry.strip_union_area(px, py, e1, e2, y, y + 7) for y in np.arange(-112.0, 112.0, 7))
    got = geometry.footprint_areas(spark.createDataFrame(rows, "k string, x long, y long, z long"),
                                   spark.createDataFrame(planes, "k string, plane array<double>, tx double, ty double, tz double"), ["k"])
    assert {r["k"]: r["footprint"] for r in got.collect()} == pytest.approx(want, rel=1e-9)
    assert want["flat"] == pytest.approx(40 * 37)


def test_footprint_groups_do_not_grow_with_the_plane(spark, monkeypatch):
    """A flat throat of n x n voxels is cut into groups of one tile, and equal tiles are worked out alike."""
    held = []
    for n in (30, 200):
        at = spark.range(n * n).select(F.lit("a").alias("k"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"), F.lit(0).alias("z"))
        plane = spark.createDataFrame([("a", [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0], 0.0, 0.0, 0.0)],
                                      "k string, plane array<double>, tx double, ty double, tz double")
        sizes = []
        monkeypatch.setattr(geometry, "_tile_area", lambda px, py, p: sizes.append(F.size(px)) or F.size(px).cast("double"))
        most = geometry.footprint_areas(at, plane, ["k"])  # the sum over tiles of the rows in each
        held.append(most.first()["footprint"] / n ** 2)
        monkeypatch.undo()
        assert geometry.footprint_areas(at, plane, ["k"]).first()["footprint"] == pytest.approx(n * n)
    assert max(held) < 1.3  # a voxel is in little more than one tile


def test_flat_throat_normal_and_area(spark):
    """Two slabs that touch in a 3x4 plane: normal x, footprint of both layers 12."""
    body = np.zeros((4, 3, 4), int)
    body[:2], body[2:] = 1, 2
    cfg = NetworkConfig(min_throat_size=1, skip_surface_surface=False)
    vox = grid.distance_transform(brute.frame(spark, {"a": ((body > 0).astype(int), body)}), F.col("body") > 0, ["body"])
    row = throats.extract_throats(vox, bodies.body_props(vox), cfg).first()
    assert row["volume_voxels"] == 24 and abs(row["nx"]) == pytest.approx(1)
    assert row["area_vox_projection"] == pytest.approx(12) and row["area_naive_projected"] == pytest.approx(24)


def test_network_solve_matches_dense(spark):
    rng = np.random.default_rng(0)
    n = 12
    links = [(i, j, rng.random() + 0.1) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
    rows = [("a", i, j, g, None) for i, j, g in links] + [("a", 0, None, 2.0, 1.0), ("a", n - 1, None, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "ms_id string, u long, v long, g double, fixed double")
    a, b = np.zeros((n, n)), np.zeros(n)
    for i, j, g in links:
        a[[i, j], [i, j]] += g
        a[i, j] -= g
        a[j, i] -= g
    a[0, 0] += 2
    b[0] = 2
    a[-1, -1] += 3
    got = {r["node_id"]: r["phi"] for r in solve.solve_potentials(df).collect()}
    want = np.linalg.solve(a, b)
    assert all(got[k] == pytest.approx(want[k], abs=1e-10) for k in got)


def test_tubes_reproduce_the_local_average(spark, quadrants):
    """tau^2_c / C_c equals the volume average of the local factor, for every method."""
    run = pipelines.network_run(brute.frame(spark, quadrants), NetworkConfig(min_throat_size=1))
    direct = {r["ms_id"]: r for r in run.factors.collect()}
    for method in ("greedy_fast", "topological", "flow_decomposition", "all_simple_paths"):
        _, tube = pipelines.network_tubes(run, method)
        rows = tubes.network_summary(tube, run.iota, 1.0).join(run.totals.select("ms_id", "total_current"), "ms_id").collect()
        assert len(rows) == 3
        for r in rows:
            assert r["consistency"] == pytest.approx(r["iota_sq_c"]) == pytest.approx(direct[r["ms_id"]]["iota_sq_c_direct"])
            assert r["v_tubes"] == pytest.approx(r["omega_c"])
            assert r["i_decomp"] == pytest.approx(r["total_current"])
    chk = network.kirchhoff_check(run.currents, run.bodies, run.totals).collect()
    assert all(r["max_abs_residual"] < 1e-10 for r in chk)


def test_components_of_random_graph(spark):
    rng = np.random.default_rng(2)
    pairs = [(0, int(v)) for v in rng.integers(1, 40, 25)] + [(int(a), int(b)) for a, b in rng.integers(41, 120, (60, 2))]
    df = spark.createDataFrame([("a", u, v) for u, v in pairs], "ms_id string, u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    label = {k: k for p in pairs if p[0] != p[1] for k in p}
    for _ in label:
        for u, v in pairs:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label


def test_boundary_filter_against_direct_rule(spark):
    links = [(1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (6, 2), (7, 8), (3, 9)]
    kinds = {1: "in", 4: "out", 7: "in"}
    alive = set(range(1, 10))
    while True:
        near = {b: {j for i, j in links + [(q, p) for p, q in links] if i == b and j in alive} for b in alive}
        seen = {}
        for b in alive:
            todo, part = [b], {b}
            while todo:
                for o in near[todo.pop()] - part:
                    part.add(o)
                    todo.append(o)
            seen[b] = part
        has = lambda b, k: any(kinds.get(o) == k for o in seen[b])
        keep = {b for b in alive if (len(near[b]) >= 1 and has(b, "out") if kinds.get(b) == "in" else
                                     len(near[b]) >= 1 and has(b, "in") if kinds.get(b) == "out" else
                                     len(near[b]) >= 2 and has(b, "in") and has(b, "out"))}
        if keep == alive:
            break
        alive = keep
    body = spark.createDataFrame([("a", b, kinds.get(b) == "in", kinds.get(b) == "out") for b in range(1, 10)],
                                 "ms_id string, body_id long, is_inlet boolean, is_outlet boolean")
    got = graph.boundary_connected(spark.createDataFrame([("a", i, j) for i, j in links], "ms_id string, i long, j long"), body)
    assert {r["body_id"] for r in got.filter("active").collect()} == alive


def test_nearest_neighbour_literal_and_random(spark):
    pts = [("a", k, *map(float, p)) for k, p in enumerate([(0, 0, 0), (1, 0, 0), (5, 5, 5), (5, 5, 6)])]
    rng = np.random.default_rng(4)
    cloud = np.concatenate([rng.random((40, 3)), rng.random((10, 3)) * 1e-3, [[9, 9, 9], [9, 9, 9]]])
    pts += [("b", k, *map(float, p)) for k, p in enumerate(cloud)]
    df = spark.createDataFrame(pts, "ms_id string, throat_id long, x double, y double, z double")
    got = {(r["ms_id"], r["throat_id"]): r["nn"] for r in analysis.nearest_neighbours(df, ["ms_id"], "throat_id", ["x", "y", "z"]).collect()}
    assert [got[("a", k)] for k in range(4)] == [1, 1, 1, 1]
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert all(got[("b", k)] == pytest.approx(d[k].min()) for k in range(len(cloud)))


def test_a_tight_cluster_fills_no_cell(spark):
    """500 points in a cluster a millionth as wide as the distance to an outlier, some of them on a line."""
    rng = np.random.default_rng(2)
    cloud = np.concatenate([rng.random((400, 3)) * 1e-6, np.c_[np.linspace(0, 1e-6, 100), np.zeros((100, 2))], [[1.0, 1.0, 1.0]]])
    df = spark.createDataFrame([("a", k, *map(float, p)) for k, p in enumerate(cloud)], "ms_id string, pid long, p0 double, p1 double, p2 double")
    cells, placed = analysis._tree(df, ["ms_id"], ["p0", "p1", "p2"], 8)
    sizes = placed.groupBy("cell").count().collect()
    assert max(r["count"] for r in sizes) <= 8 and sum(r["count"] for r in sizes) == len(cloud) and len(cells) < 12
    got = {r["pid"]: r["nn"] for r in analysis.nearest_neighbours(df, ["ms_id"], "pid", ["p0", "p1", "p2"], leaf=8).collect()}
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == pytest.approx(dict(enumerate(d.min(axis=1))), rel=1e-9)


def test_draws_are_the_first_by_digest(spark):
    points = [("a", k) for k in range(40)] + [("b", k) for k in range(3)] + [("c", 7)]
    sizes = [("a", 40, 12), ("b", 3, 3), ("c", 1, 0)]
    df = spark.createDataFrame(points, "ms_id string, throat_id long")
    got = analysis.drawn_subsets(df, spark.createDataFrame(sizes, "ms_id string, n_total long, n_pick long"), "throat_id", 30, 7).collect()
    for ms, total, n in sizes:
        for draw in range(30):
            first = sorted((hashlib.md5(f"7:{draw}:{ms}:{k}".encode()).hexdigest(), k) for m, k in points if m == ms)[:n]
            assert sorted(r["throat_id"] for r in got if (r["ms_id"], r["draw"]) == (ms, draw)) == sorted(k for _, k in first)


def test_draws_refine_a_threshold_that_was_too_low(spark, monkeypatch):
    """With a threshold that expects far too few, repeated rounds still give the exact choice."""
    df = spark.range(300).select(F.lit("a").alias("ms_id"), F.col("id").alias("throat_id"))
    size = spark.createDataFrame([("a", 300, 200)], "ms_id string, n_total long, n_pick long")
    want = {(r["draw"], r["throat_id"]) for r in analysis.drawn_subsets(df, size, "throat_id", 2, 1).collect()}
    monkeypatch.setattr(analysis.F, "sqrt", lambda c: F.lit(-48.0))
    assert {(r["draw"], r["throat_id"]) for r in analysis.drawn_subsets(df, size, "throat_id", 2, 1).collect()} == want


CHAIN = [("a", 1, 1, 2), ("a", 2, 2, 3), ("a", 3, 2, 4)]


@pytest.mark.parametrize("gone,left,lonely", [([2], 2, {3}), ([3], 2, {4}), ([1, 2, 3], 0, {1, 2, 3, 4}), ([999], 3, set())])
def test_remove_throats_on_chain(spark, gone, left, lonely):
    t = spark.createDataFrame(CHAIN, "ms_id string, throat_id long, body1_id long, body2_id long")
    b = spark.createDataFrame([("a", k) for k in (1, 2, 3, 4)], "ms_id string, body_id long")
    kept = whatif.remove_throats(t, spark.createDataFrame([("a", g) for g in gone], "ms_id string, throat_id long"))
    assert kept.count() == left and t.count() == 3
    z = whatif.coordination_numbers(kept, b)
    assert {r["body_id"] for r in z.filter("coordination = 0").collect()} == lonely and z.count() == 4
    iso = whatif.newly_isolated(whatif.coordination_numbers(t, b), z).first()
    assert iso["n_bodies_newly_isolated"] == len(lonely)


def test_rules(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"ms_id": "a", "throat_id": range(50), "c_geomean": np.where(rng.random(50) < 0.1, np.nan, rng.random(50)),
                        "p_throat_only_frac": rng.random(50)})
    df = spark.createDataFrame(pdf).withColumn("c_geomean", F.nanvl("c_geomean", F.lit(None)))
    c, p = pdf["c_geomean"], pdf["p_throat_only_frac"]
    want = set(pdf["throat_id"][(c <= c.quantile(0.3)) & (p >= p.quantile(0.6))])
    rule = whatif.rank_rule("c_geomean", 30, "bottom", "p_throat_only_frac", 40, "top")
    assert {r["throat_id"] for r in whatif.select_throats(df, rule).collect()} == want
    n = whatif.random_rule(match=rule, seed=0)(df).filter("selected").count()
    assert n == len(want)
    with pytest.raises(ValueError):
        whatif.random_rule(percentile=5, n=3)
    with pytest.raises(ValueError):
        whatif.rank_rule("c", 5, "middle")(df.withColumn("c", F.lit(1.0)))
    with pytest.raises(ValueError):
        whatif.resolve_rule("nothing")


def test_sweep_marks_failures(spark, quadrants):
    out = whatif.prune_and_recompute(brute.frame(spark, {"q1": quadrants["q1"]}), NetworkConfig(min_throat_size=1),
                                     lambda t: t.withColumn("selected", F.lit(True)))
    row = whatif.with_before_after(out, ["total_current"]).first()
    assert row["solve_failed"] and not row["errored"] and row["pruned_total_current"] is None
    assert row["total_current_before/after"].endswith("/failed") and row["n_bodies_newly_isolated"] > 0


def test_sweep_runs_rules_together_and_isolates_bad_samples(spark, quadrants):
    cfg = NetworkConfig(min_throat_size=1, area_method="naive", merge_bodies=False)
    good = {k: quadrants[k] for k in sorted(quadrants)[:2]}
    rules = {"thin": whatif.rank_rule("geometric_throat_area", 30, "bottom"), "all": lambda t: t.withColumn("selected", F.lit(True)),
             "none": lambda t: t.withColumn("selected", F.lit(False))}
    vox = brute.frame(spark, good)
    name = sorted(good)[0]
    torn = vox.filter(F.col("ms_id") == name).withColumn("ms_id", F.lit("torn")).filter("not (x = 1 and y = 1 and z = 1)")
    bare = vox.filter(F.col("ms_id") == name).withColumn("ms_id", F.lit("bare")).withColumn("body", F.lit(None).cast(vox.schema["body"].dataType))
    rows = {(r["rule"], r["ms_id"]): r for r in whatif.sweep(vox.unionByName(torn).unionByName(bare), cfg, rules).collect()}
    assert set(rows) == {(r, m) for r in rules for m in (*good, "torn", "bare")}
    assert {rows[r, "torn"]["error"] for r in rules} == {"voxels missing or repeated"}
    assert {rows[r, "bare"]["error"] for r in rules} == {"voxels without a body label"}
    for r in rules:
        alone = {x["ms_id"]: x for x in whatif.prune_and_recompute(vox, cfg, rules[r]).collect()}
        for m in good:
            for key, value in alone[m].asDict().items():
                assert rows[r, m][key] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value)
    assert all(rows["none", m]["delta_total_current"] == pytest.approx(0, abs=1e-12) for m in good if not rows["none", m]["errored"])


@pytest.mark.parametrize("kernel_rows", [None, 0])
def test_a_start_vector_saves_rounds_and_changes_nothing(spark, kernel_rows):
    chain = [("a", k, k + 1, 1.0 + k % 3, None) for k in range(12)] + [("a", 0, None, 2.0, 1.0), ("a", 12, None, 2.0, 0.0)]
    chain += [("b", 1, 2, 1.0, None)]  # floats: nothing holds it
    links = spark.createDataFrame(chain, "ms_id string, u long, v long, g double, fixed double")
    cold, record = solve.solve_recorded(links, 1e-11, kernel_rows)
    want = {(r["ms_id"], r["node_id"]): r["phi"] for r in cold.collect()}
    start = cold.union(spark.createDataFrame([("a", 99, 5.0), ("c", 1, 5.0)], "ms_id string, node_id long, phi double"))
    warm, again = solve.solve_recorded(links, 1e-11, kernel_rows, start)
    assert {(r["ms_id"], r["node_id"]): r["phi"] for r in warm.collect()} == pytest.approx(want, abs=1e-9)
    first, second = ({r["ms_id"]: r for r in x.collect()} for x in (record, again))
    assert first["a"]["converged"] and first["a"]["iterations"] > 5 and not first["a"]["started"]
    assert second["a"]["converged"] and second["a"]["iterations"] <= 1 and second["a"]["started"]
    assert first["a"]["residual"] < 1e-10 and second["b"]["converged"]


def _all_paths(arcs, inlets, outlets):
    """Edges and weight of every path, one after another."""
    out = {}
    for up, _, flow, _ in arcs:
        out[up] = out.get(up, 0.0) + flow
    found, todo = [], [([e], f) for e, (u, _, f, _) in enumerate(arcs) if u in inlets]
    while todo:
        path, weight = todo.pop()
        at = arcs[path[-1]][1]
        if at in outlets:
            found.append((tuple(arcs[e][3] for e in path), round(weight, 9)))
        todo += [(path + [e], weight * f / out[u]) for e, (u, _, f, _) in enumerate(arcs) if u == at]
    return sorted(found)


def _path_dag(spark, samples):
    rows = []
    for ms, (arcs, inlets, outlets) in samples.items():
        rows += [(ms, u, v, f, 0.5, 0, e, 1.0 + e) for u, v, f, e in arcs]
        rows += [(ms, -1, n, 1.0, 0.0, 1, -1, 0.0) for n in inlets] + [(ms, n, -2, 1.0, 0.0, 2, -1, 0.0) for n in outlets]
    return spark.createDataFrame(rows, "ms_id string, up long, dn long, flow double, dphi double, kind int, edge_id long, seg_len double")


@pytest.mark.parametrize("kernel_rows, task_steps", [(None, None), (None, 0), (None, 40), (0, None), (60, 25)])
def test_simple_paths_of_walkers_and_rounds(spark, kernel_rows, task_steps):
    rng = np.random.default_rng(4)
    samples = {"none": ([(1, 2, 1.0, 7)], [1], [])}
    for k in range(6):
        n = 5 + k
        arcs = [(int(a), int(b), float(rng.uniform(0.5, 2)), 100 + i) for i, (a, b) in enumerate(
            p for p in ((a, b) for a in range(n) for b in range(a + 1, n)) if rng.random() < 0.6)]
        # node 2 is an inlet that paths may also pass, the last but one an outlet that they may leave again
        samples[f"s{k}"] = (arcs, [0, 2], [n - 2, n - 1])
    samples["twin"] = ([(1, 2, 1.0, 1), (1, 2, 3.0, 2), (2, 3, 1.0, 3)], [1, 1], [3, 3])
    dag = _path_dag(spark, samples)
    terms = spark.createDataFrame([(ms, a[3], 2.0 * a[3]) for ms, s in samples.items() for a in s[0]], "ms_id string, edge_id long, twice double")
    got = tubes.all_simple_paths(dag, None, kernel_rows, task_steps, terms).collect()
    paths = {}
    for r in got:
        paths.setdefault((r["ms_id"], r["path_id"]), {})[r["step"]] = r
        assert r["twice"] == 2.0 * r["edge_id"] and r["seg_len"] == 1.0 + r["edge_id"] and r["kind"] == 0 and r["path_id"] >= 0
    found = {ms: [] for ms in samples}
    for (ms, _), steps in paths.items():
        assert sorted(steps) == list(range(len(steps)))
        assert all(steps[k]["dn"] == steps[k + 1]["up"] for k in range(len(steps) - 1))
        found[ms].append((tuple(steps[k]["edge_id"] for k in range(len(steps))), round(steps[0]["i_gamma"], 9)))
    assert {ms: sorted(p) for ms, p in found.items()} == {ms: _all_paths(*s) for ms, s in samples.items()}


def test_simple_paths_take_no_job_per_step(spark):
    """Long paths of small samples used to take a round of jobs a step."""
    jobs = []
    for n in (3, 12):
        dag = _path_dag(spark, {"a": ([(k, k + 1, 1.0, k) for k in range(n)], [0], [n])})
        spark.sparkContext.setJobGroup(f"paths of {n}", "test")
        assert tubes.all_simple_paths(dag, None).count() == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"paths of {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_wide_throat_rows_are_stored_once_and_keep_their_copies(spark, quadrants, monkeypatch):
    stored = []
    monkeypatch.setattr(pipelines, "cut", lambda df, cut=pipelines.cut: stored.append(df.columns) or cut(df))
    run = pipelines.network_run(brute.frame(spark, quadrants), NetworkConfig(min_throat_size=1))
    assert not any("iota1" in c for c in stored)  # a copy of every throat's row beside its currents
    face = grid.interfaces(run.vox)
    once = analysis.throat_table(run.currents, run.bodies, face, run.totals)
    # rows that are there twice stay twice
    twice = analysis.throat_table(run.currents.unionByName(run.currents), run.bodies, face, run.totals)
    assert twice.count() == 2 * once.count() > 0
