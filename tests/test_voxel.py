import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from porespark.config import VoxelConfig
from porespark.operators import chord, graph, grid, solve, transport, tubes
from porespark.plans import packing, pipelines

CFG = VoxelConfig(phase_id=1)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    out = {f"r{k}": ((rng.random((5, 4, 4)) < 0.62).astype(int), None) for k in range(5)}
    tube = np.zeros((8, 8, 8), int)
    tube[:, 2:5, 2:5] = 1
    out["cuboid"] = (tube, None)
    tiny = np.ones((3, 2, 2), int)
    tiny[1, 0, 0] = 0
    out["tiny"] = (tiny, None)
    return out


@pytest.fixture(scope="module")
def run(spark, images):
    return pipelines.voxel_run(brute.frame(spark, images), CFG)


def test_straight_cuboid_is_exact(run):
    row = run.transport.filter("ms_id = 'cuboid'").first()
    assert row["one_over_f"] == pytest.approx((3 / 8) ** 2, abs=1e-12)
    for method in ("greedy_fast", "topological"):
        _, tube = pipelines.voxel_tubes(run, CFG, method)
        s = tubes.voxel_summary(tube, run.transport, CFG).filter("ms_id = 'cuboid'").first()
        assert s["tau_sq_c"] == pytest.approx(1) and s["c_c"] == pytest.approx(1) and s["n_paths"] == 9


def test_potentials_match_dense_solve(run, images):
    phi = {(r["ms_id"], r["x"], r["y"], r["z"]): r["phi"] for r in run.phi.collect()}
    for ms, (mask, _) in images.items():
        coords, edges, want, cur = brute.solve_grid(mask == 1)
        comp = {r["node_id"]: r["kind"] for r in run.phi.filter(F.col("ms_id") == ms).collect()}
        assert len(comp) == len(coords)
        total = sum(2 * (1 - want[i]) for i, c in enumerate(coords) if c[0] == 0)
        got = run.transport.filter(F.col("ms_id") == ms).first()
        assert got["i_in"] == pytest.approx(total, abs=1e-9) and got["i_out"] == pytest.approx(total, abs=1e-9)
        assert got["energy_total"] == pytest.approx(got["power_boundary"], abs=1e-9)
    floating = [r for r in run.phi.filter("kind = 'floating_disconnected'").collect()]
    assert all(r["phi"] == 0.5 for r in floating) and phi


def test_distributed_solve_equals_packed(spark, images):
    small = {"tiny": images["tiny"]}
    vox = brute.frame(spark, small)
    nodes = grid.nodes(vox, 1)
    links = transport.voxel_links(grid.edges(nodes), nodes, CFG)
    key = lambda df: {(r["ms_id"], r["node_id"]): r["phi"] for r in df.collect()}
    a, b = key(solve.solve_potentials(links)), key(solve.solve_potentials(links, kernel_rows=0, tol=1e-9))
    # nodes cut off from both faces stay at zero in both
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def paths_of(steps, nodes):
    """ms -> sorted [(amount, node list)] with nodes numbered in grid order."""
    order = {}
    for r in nodes.orderBy("ms_id", "node_id").collect():
        order.setdefault(r["ms_id"], {})[r["node_id"]] = len(order.get(r["ms_id"], {}))
    out = {}
    for r in steps.filter("kind in (0, 1)").orderBy("ms_id", "path_id", "step").collect():
        out.setdefault((r["ms_id"], r["path_id"]), [r["i_gamma"], []])[1].append(order[r["ms_id"]][r["dn"]])
    grouped = {}
    for (ms, _), (amount, nodes_) in out.items():
        grouped.setdefault(ms, []).append((amount, nodes_))
    return grouped


@pytest.mark.parametrize("method", ["greedy_fast", "topological"])
@pytest.mark.parametrize("rows", [None, 0])
def test_tubes_match_brute_force(run, images, method, rows):
    keep = ["tiny"] if rows == 0 else list(images)
    dag = tubes.voxel_dag(run.currents, run.phi, run.transport, CFG).filter(F.col("ms_id").isin(keep))
    got = paths_of(tubes.decompose(dag, method, kernel_rows=rows), run.nodes)
    seen = 0
    for ms in keep:
        _, phi, flows, thr = brute.flow_edges(images[ms][0] == 1)
        want = brute.greedy_paths(flows, thr) if method == "greedy_fast" else brute.fifo_paths(flows, phi, thr)
        mine = got.get(ms, [])
        assert sum(a for a, _ in mine) == pytest.approx(sum(a for a, _ in want), abs=1e-8)
        seen += 1
        if ms not in ("cuboid", "tiny"):  # equal currents in the channel leave the order of equals to rounding
            total = {}
            for a, p in want:
                total[tuple(p)] = total.get(tuple(p), 0) + a
            for a, p in mine:
                total[tuple(p)] = total.get(tuple(p), 0) - a
            off = sum(abs(v) for v in total.values())
            assert off < 1e-6 or method == "greedy_fast" and off < 0.5 * sum(a for a, _ in want)
    assert seen


def test_a_sample_beyond_the_bound_spoils_no_other(run):
    dag = tubes.voxel_dag(run.currents, run.phi, run.transport, CFG)
    sizes = {r["ms_id"]: r["count"] for r in dag.groupBy("ms_id").count().collect()}
    big = max(sizes, key=sizes.get)
    steps = tubes.decompose(dag, "flow_decomposition", kernel_rows=sizes[big] - 1)
    assert {r["ms_id"] for r in steps.filter("path_id >= 0").collect()} >= {m for m in sizes if m != big and sizes[m] < sizes[big]} - {big}
    marked = tubes.ledger(steps).filter(F.col("n_stuck") == tubes.UNDECOMPOSED).collect()
    assert big in {r["ms_id"] for r in marked} and all(r["current_dropped"] is None for r in marked)


def test_paths_do_not_depend_on_samples_beside_them(run):
    dag = tubes.voxel_dag(run.currents, run.phi, run.transport, CFG)
    whole = paths_of(tubes.decompose(dag, "topological"), run.nodes)
    alone = paths_of(tubes.decompose(dag.filter("ms_id = 'tiny'"), "topological"), run.nodes)
    assert sorted((round(a, 9), p) for a, p in whole["tiny"]) == sorted((round(a, 9), p) for a, p in alone["tiny"])


@pytest.mark.parametrize("n", [1, 2, 7, 33])
def test_envelopes_are_the_minimum_over_all_sites(n):
    rng = np.random.default_rng(n)
    c = np.cumsum(rng.integers(1, 4, (50, n)), axis=1).astype(float)
    v = np.where(rng.random((50, n)) < 0.4, np.inf, rng.integers(0, 60, (50, n))).astype(float)
    v[0], v[1] = np.inf, 0
    c[2:9, n // 2:] = np.inf
    v[2:9, n // 2:] = np.inf
    got = grid.envelopes(c, v)
    for i in range(50):
        for a in range(n):
            if np.isfinite(c[i, a]):
                live = np.isfinite(v[i])
                assert got[i, a] == ((v[i, live] + (c[i, a] - c[i, live]) ** 2).min() if live.any() else np.inf)


def test_volume_split_covers_touched_nodes(run):
    steps, tube = pipelines.voxel_tubes(run, CFG, "topological")
    share = tube.groupBy("ms_id").agg(F.sum("v_gamma").alias("v"))
    nodes = steps.filter("kind in (0, 1)").groupBy("ms_id").agg(F.countDistinct("dn").alias("n"))
    assert all(r["v"] == pytest.approx(r["n"]) for r in share.join(nodes, "ms_id").collect())


@pytest.mark.parametrize("tile", [2, 3, 32])
def test_components_for_any_tile(spark, images, tile):
    pore = brute.frame(spark, images).filter("phase = 1")
    got = {}
    for r in graph.grid_components(pore, tile).collect():
        got.setdefault((r["ms_id"], r["component"]), set()).add(r["node_id"])
    n = sum(len(v) for v in got.values())
    assert n == sum((m == 1).sum() for m, _ in images.values())
    want = 0
    for mask, _ in images.values():
        coords, edges = brute.nodes_edges(mask == 1)
        label = list(range(len(coords)))
        for _ in coords:
            for u, v, _a in edges:
                label[u] = label[v] = min(label[u], label[v])
        want += len(set(label))
    assert len(got) == want


def test_exact_distance_transform(spark, images):
    vox = brute.frame(spark, images)
    got = {(r["ms_id"], r["x"], r["y"], r["z"]): r["edt"] for r in grid.distance_transform(vox, F.col("phase") == 1).collect()}
    for ms, (mask, _) in images.items():
        solid = np.argwhere(mask == 0)
        for c in np.argwhere(mask >= 0):
            want = 0.0 if mask[tuple(c)] == 0 else np.sqrt(((solid - c) ** 2).sum(1).min())
            assert got[(ms, *map(int, c))] == pytest.approx(want)


def test_distance_is_null_without_solid(spark):
    vox = brute.frame(spark, {"full": (np.ones((2, 2, 2), int), None)})
    assert {r["edt"] for r in grid.distance_transform(vox, F.col("phase") == 1).collect()} == {None}


def test_chord_of_one_bend(spark):
    """Six steps along x, four along y in open space: both tests accept the bend."""
    open_ = np.ones((8, 6, 1), int)
    vox = brute.frame(spark, {"b": (open_, None)})
    nodes = grid.nodes(vox, 1)
    pos = [(x, 0, 0) for x in range(7)] + [(6, y, 0) for y in range(1, 5)]
    ids = [(x << 42) + (y << 21) + z for x, y, z in pos]
    rows = [("b", 0, k, a, b, 0, 0, 1.0, 1.0, 0.1) for k, (a, b) in enumerate(zip(ids, ids[1:]))]
    steps = spark.createDataFrame(rows, "ms_id string, path_id long, step int, up long, dn long, kind int, edge_id long, i_gamma double, seg_len double, dphi double")
    tube = spark.createDataFrame([("b", 0, 10.0, 8.0, 1.0)], "ms_id string, path_id long, l_gamma_raw double, l_sample double, v_gamma double")
    for test in ("box", "sampler", "none"):
        r = chord.corrected_lengths(steps, tube, nodes, CFG, test).first()
        assert r["l_gamma_chord"] == pytest.approx(10 - (6 - np.sqrt(18))) and r["n_bends"] == 1
    closed = open_.copy()
    closed[4, 1, 0] = 0
    shut = grid.nodes(brute.frame(spark, {"b": (closed, None)}), 1)
    for test in ("box", "sampler"):
        r = chord.corrected_lengths(steps, tube, shut, CFG, test).first()
        assert r["l_gamma_chord"] == pytest.approx(10) and r["n_rejected"] == 1


def test_chord_metrics_when_configured(spark, images):
    cfg = VoxelConfig(phase_id=1, tortuosity_mode="chord_corrected")
    rows = pipelines.voxel_metrics(brute.frame(spark, {"r0": images["r0"], "cuboid": images["cuboid"]}), cfg).collect()
    assert {r["ms_id"] for r in rows} >= {"cuboid"}
    assert all(r["tau_sq_c_chord"] >= r["tau_sq_c"] - 1e-12 for r in rows)


def test_a_bend_of_many_paths_is_looked_up_once(spark, monkeypatch):
    """Paths that share a bend share its box and its samples; those without bends keep their length."""
    vox = brute.frame(spark, {"b": (np.ones((8, 6, 1), int), None)})
    nodes = grid.nodes(vox, 1)
    bent = [(x, 0, 0) for x in range(7)] + [(6, y, 0) for y in range(1, 5)]
    rows = [("b", path, k, a, b, 0, 0, 1.0, 1.0, 0.1) for path, pos in [*((p, bent) for p in range(20)), (20, bent[:7])]
            for ids in [[(x << 42) + (y << 21) + z for x, y, z in pos]] for k, (a, b) in enumerate(zip(ids, ids[1:]))]
    steps = spark.createDataFrame(rows, "ms_id string, path_id long, step int, up long, dn long, kind int, edge_id long, i_gamma double, seg_len double, dphi double")
    tube = spark.createDataFrame([("b", p, 10.0, 8.0, 1.0) for p in range(21)], "ms_id string, path_id long, l_gamma_raw double, l_sample double, v_gamma double")
    boxes, real = [], grid.box_counts
    monkeypatch.setattr(grid, "box_counts", lambda found, *x: boxes.append(found.count()) or real(found, *x))
    for test in ("box", "sampler", "none"):
        got = {r["path_id"]: (r["n_bends"], r["n_accepted"], r["n_rejected"], round(r["length_removed"], 9))
               for r in chord.corrected_lengths(steps, tube, nodes, CFG, test).collect()}
        assert got == {**dict.fromkeys(range(20), (1, 1, 0, round(6 - np.sqrt(18), 9))), 20: (0, 0, 0, 0.0)}
    assert boxes == [1]


def test_greedy_walks_of_a_pack_make_one_table(monkeypatch):
    """Samples of a pack get the paths they get alone, without tables of their own."""
    rng = np.random.default_rng(5)
    rows = []
    for ms in range(40):
        for n, (up, dn) in enumerate([(tubes.SOURCE, 1), (tubes.SOURCE, 2), (1, 3), (1, 4), (2, 4), (3, 5), (4, 5), (4, 6), (5, tubes.SINK), (6, tubes.SINK)]):
            kind = 1 if up == tubes.SOURCE else 2 if dn == tubes.SINK else 0
            rows.append((ms, up, dn, float(rng.integers(1, 9)), 0.1, kind, n, 1.0, 6 * kind, n, 1.0, 1e-9))
    pack = pd.DataFrame(rows, columns=tubes.DAG_COLUMNS).sample(frac=1, random_state=0)
    real, parts = pd.concat, []
    monkeypatch.setattr(tubes.pd, "concat", lambda found, **x: parts.append(len(found)) or real(found, **x))
    for method in tubes.WALKS:
        walk = tubes._pack_decomposer(method)
        parts.clear()
        whole = walk(pack)
        assert parts[0] <= 3
        by = ["path_id", "kind", "step", "up", "dn"]
        for ms, part in pack.groupby("ms_id"):
            mine = whole[whole["ms_id"] == ms].sort_values(by).reset_index(drop=True)
            pd.testing.assert_frame_equal(mine, walk(part).sort_values(by).reset_index(drop=True), check_dtype=False)
            assert (mine["kind"] == tubes.LEDGER).sum() == 1
    assert whole["path_id"].max() > 0


def _tangle(seed, n=14):
    """A flow that is not conserved, so that walks get stuck; one node leads nowhere, inlets come twice."""
    rng = np.random.default_rng(seed)
    edges = [(a, b, 0) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.35] + [(1, 50, 0), (0, 3, 0), (0, 3, 0)]
    edges += [(tubes.SOURCE, a, 1) for a in (0, 1, 2, 2)] + [(a, tubes.SINK, 2) for a in (n - 1, n - 2)]
    return [(seed, up, dn, float(rng.integers(1, 30)) / 8, 0.1, kind, k, 1.0, 6 * kind + k % 2, k, 1.0, 0.3) for k, (up, dn, kind) in enumerate(edges)]


def _as_walked(steps):
    """Paths as sets of steps, numbers of paths and drained edges left out."""
    paths, other = {}, []
    for r in steps:
        if r["path_id"] >= 0:
            paths.setdefault((r["ms_id"], r["path_id"]), []).append((r["step"], r["up"], r["dn"], r["kind"], r["edge_id"], r["i_gamma"], r["seg_len"], r["dphi"]))
        else:
            other.append(tuple(r[c] for c in tubes.STEP_COLUMNS))
    return {k: sorted(v) for k, v in paths.items()}, sorted(other)


def test_samples_of_any_size_are_walked_like_small_ones(spark, monkeypatch):
    rows = [r for seed in range(25) for r in _tangle(seed)] + [(30, 1, 2, 1.0, 0.1, 0, 0, 1.0, 0, 0, 1.0, 0.3)]
    dag = spark.createDataFrame(rows, "ms_id long, up long, dn long, flow double, dphi double, kind int, edge_id long, seg_len double, ord int, seq long, phi_up double, thr double")
    want = tubes._pack_decomposer("flow_decomposition")(pd.DataFrame(rows, columns=tubes.DAG_COLUMNS)).to_dict("records")
    paths, other = _as_walked(want)
    assert len({k for k, _ in paths}) == 25 and any(r[5] == tubes.DRAINED for r in other)
    monkeypatch.setattr(packing, "KERNEL_ROWS", 0)
    assert _as_walked(tubes.decompose(dag, "flow_decomposition").collect()) == (paths, other)
    monkeypatch.setattr(packing, "KERNEL_ROWS", 40)  # some in packs, some alone
    assert _as_walked(tubes.decompose(dag, "flow_decomposition").collect()) == (paths, other)


@pytest.mark.parametrize("block, most, size", [(1, 1, 3), (2, 50, 1000), (7, 10_000, 11)])
def test_a_stored_walk_does_not_depend_on_its_blocks(block, most, size):
    rows = [r for seed in range(8) for r in _tangle(seed)]
    table = pd.DataFrame(rows, columns=tubes.DAG_COLUMNS).rename(columns={"flow": "left"}).sort_values(["ms_id", "up", "ord", "seq"])
    table["edge"] = table["edge_id"]
    for _ in range(20):  # without the edges that lead nowhere
        live = {(r.ms_id, r.up) for r in table.itertuples()} | {(ms, tubes.SINK) for ms in range(8)}
        table = table[[(r.ms_id, r.dn) in live for r in table.itertuples()]]
    batches = pa.Table.from_pandas(table, preserve_index=False).to_batches(size)
    schema = pa.schema([("ms_id", "int64"), ("path_id", "int64"), ("step", "int32"), ("kind", "int32"), ("edge", "int64"), ("i_gamma", "float64")])
    got = [r for b in tubes._stored_walker(schema, block, most)(iter(batches)) for r in b.to_pylist()]
    want = tubes._pack_decomposer("flow_decomposition")(pd.DataFrame(rows, columns=tubes.DAG_COLUMNS)).rename(columns={"edge_id": "edge"})
    key = lambda r: (r["ms_id"], r["path_id"], r["kind"], r["step"], r["edge"], r["i_gamma"])
    assert sorted(map(key, got)) == sorted(map(key, want.to_dict("records")))
