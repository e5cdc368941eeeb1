import json
import os

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from porespark import cli, config
from porespark.operators import collate, network, runs, transport
from porespark.plans import lineage, pipelines
from porespark.sources import npy, results, runstore, samples
from porespark.streaming import latest as stream


def test_config_rules():
    assert config.resolve_axis() == 0 and config.resolve_axis("z") == 2 and config.resolve_axis(axis=1) == 1
    for bad in (dict(direction="w"), dict(direction="x", axis=1), dict(axis=7)):
        with pytest.raises(ValueError):
            config.resolve_axis(**bad)
    with pytest.raises(ValueError):
        config.VoxelConfig(conductance_mode="other")
    assert config.config_hash({"b": 1, "a": 2}) == config.config_hash({"a": 2, "b": 1})
    made = config.method_configs({"axis": 1, "network_config": {"alpha": 0.3}}, network={"alpha": 0.5, "sigma": 2})
    assert made["network"] == {"alpha": 0.3, "sigma": 2, "direction": "y", "body_array_file": "body_array.npy"}
    assert config.VoxelConfig(dx=2.0).conductance == 2.0 and config.VoxelConfig(dx=2.0, conductance_mode="unit_dx").conductance == 4.0


def test_reuse_matches_sequential_rule(spark):
    rng = np.random.default_rng(0)
    req = [("a", "m", v, f"h{rng.integers(0, 4)}", bool(rng.random() < 0.4)) for v in range(1, 60)]
    real, want = {}, {}
    for _, _, v, h, full in req:
        hit = next((w for w, kept in real.get(h, []) if kept or not full), None)
        if hit is None:
            real.setdefault(h, []).append((v, full))
        want[v] = hit
    df = spark.createDataFrame(req, "ms_id string, method string, version long, config_hash string, save_full boolean")
    got = {r["version"]: r["points_to_version"] for r in runs.resolve_reuse(df).collect()}
    assert got == want


def test_matching_uses_defaults(spark):
    rows = [("a", 1, "network", "real", None, "h", False, json.dumps({"alpha": 0.5})),
            ("a", 2, "network", "real", None, "h", False, json.dumps({"min_throat_size": 8})),
            ("a", 3, "network", "pointer", 1, "h", False, None)]
    df = spark.createDataFrame(rows, runstore.RUN_SCHEMA)
    pick = lambda **c: [r["version"] for r in runs.matching(df, c).collect()]
    assert pick(min_throat_size=5) == [1] and pick(min_throat_size=8) == [2] and pick(alpha=0.5) == [2]
    assert pick(dilate_both=True) == [2] and pick(surface_axis=None) == [2] and pick(alpha=0.7) == []


def test_matching_compares_numbers_as_numbers(spark):
    configs = [{"alpha": 1.0, "k": 1e-05}, {"alpha": 1, "k": 0.00001}, {"alpha": None, "k": 2}]
    rows = [(f"s{i}", 1, "network", "real", None, "h", False, json.dumps(c)) for i, c in enumerate(configs)]
    df = spark.createDataFrame(rows, runstore.RUN_SCHEMA)
    pick = lambda **c: sorted(r["ms_id"] for r in runs.matching(df, c).collect())
    assert pick(alpha=1.0) == pick(alpha=1) == pick(k=1e-05) == ["s0", "s1"]
    assert pick(alpha=0.5) == [] and pick(alpha=None) == ["s2"]


def test_latest_falls_back_to_maximum(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "ms_id string, version long")
    rec = spark.createDataFrame([("a", 1), ("b", 9)], "ms_id string, version long")
    assert {r["ms_id"]: r["latest_version"] for r in runs.latest(df, rec).collect()} == {"a": 1, "b": 2}


@pytest.fixture()
def tree(tmp_path):
    rng = np.random.default_rng(0)
    vols = {}
    for ms in ("s1", "s2"):
        folder = tmp_path / ms
        folder.mkdir()
        vols[ms] = rng.integers(0, 3, (5, 3, 4))
        np.save(folder / "segmented.npy", vols[ms])
        np.save(folder / "body_array.npy", np.asfortranarray(vols[ms] * 2))
    (tmp_path / "s1" / "manifest.json").write_text(json.dumps({"phase_id": 2}))
    return str(tmp_path), vols


def test_npy_source_reads_slabs(spark, tree):
    root, vols = tree
    df = npy.read_volumes(spark, root, slab_voxels=24)
    assert df.rdd.getNumPartitions() == 6
    got = {(r["ms_id"], r["x"], r["y"], r["z"]): (r["phase"], r["body"]) for r in df.collect()}
    assert len(got) == 120 and all(got[(m, *map(int, i))] == (v[tuple(i)], 2 * v[tuple(i)]) for m, v in vols.items() for i in np.argwhere(v >= 0))


def shelf(root):
    """A store of its own: ``shelf://<folder>`` shows what lies in a local folder."""
    base = root.removeprefix("shelf://")
    return fs.SubTreeFileSystem(base, fs.LocalFileSystem()), ""


@pytest.mark.parametrize("orders", ["CC", "FF", "CF"])
def test_npy_source_reads_ranges_of_any_store(spark, tmp_path, monkeypatch, orders):
    rng = np.random.default_rng(1)
    phase, body = rng.integers(0, 3, (5, 4, 3)), rng.integers(0, 9, (5, 4, 3)).astype(">i2")
    os.makedirs(tmp_path / "s1")
    os.makedirs(tmp_path / "empty")
    (tmp_path / "note.txt").write_text("no sample")
    for name, a, order in (("segmented", phase, orders[0]), ("body_array", body, orders[1])):
        np.save(tmp_path / "s1" / f"{name}.npy", np.asarray(a, order=order))
    root = f"shelf://{tmp_path}"
    reader = npy.NpyReader({"root": root, "filesystem": f"{__name__}:shelf", "slab_voxels": "24"})
    parts = reader.partitions()
    assert [(p.axis, p.start, p.stop) for p in parts] == ([(2, 0, 1), (2, 1, 2), (2, 2, 3)] if orders == "FF" else [(0, 0, 2), (0, 2, 4), (0, 4, 5)])
    rows = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(rows) == sorted(("s1", x, y, z, int(phase[x, y, z]), int(body[x, y, z])) for x, y, z in np.ndindex(5, 4, 3))
    if orders == "CC":  # a slab is one range, not the file
        store, _ = shelf(root)
        at = npy.layout(store, "s1/segmented.npy")
        with store.open_input_file(at.path) as file:
            data = file.read_at(2 * 12 * 8, at.offset + 2 * 12 * 8)
        assert (np.frombuffer(data, at.dtype).reshape(2, 4, 3) == npy.read_slab(store, at, 0, 2, 4)).all()
    df = npy.read_volumes(spark, f"file://{tmp_path}")
    assert df.count() == 60
    blob = (tmp_path / "s1" / "segmented.npy").read_bytes()
    (tmp_path / "s1" / "segmented.npy").write_bytes(blob[:-8])
    with pytest.raises(ValueError, match="shorter"):
        list(reader.read(parts[-1]))


def test_manifest_configs(spark, tree):
    root, _ = tree
    m = samples.manifests(spark, root, npy.read_volumes(spark, root))
    got = {(r["ms_id"], r["method"]): r for r in samples.requested_configs(m, phase_id=1).collect()}
    assert json.loads(got[("s1", "voxel")]["config"])["phase_id"] == 2 and json.loads(got[("s2", "voxel")]["config"])["phase_id"] == 1
    assert got[("s1", "network")]["config_hash"] == got[("s2", "network")]["config_hash"]


def test_import_tree_and_stream(spark, tmp_path):
    def put(path, text=""):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    base = tmp_path / "data" / "s1"
    put(base / "version1" / "network" / "config.json", '{"alpha": 0.5}')
    put(base / "version1" / "network" / "metrics.json", '{"f_c": 2.5, "_cache_hit": false}')
    put(base / "version1" / "network" / "_SUCCESS")
    put(base / "version2" / "network" / "pointer.json", json.dumps({"points_to_version": 1, "config_hash": "abc"}))
    put(base / "version3" / "network" / "config.json", '{"alpha": 0.9}')  # no marker: not a run
    made, metrics = runstore.import_tree(spark, str(tmp_path / "data"))
    rows = {r["version"]: r for r in made.collect()}
    assert set(rows) == {1, 2} and rows[1]["config_hash"] == config.config_hash({"alpha": 0.5}) and rows[2]["points_to_version"] == 1
    assert runs.dereference(made, metrics).filter("version = 2").first()["value"] == 2.5
    store = str(tmp_path / "store")
    runstore.append_runs(made, metrics, store)
    schema = spark.read.parquet(f"{store}/runs").schema
    view, mark = str(tmp_path / "view"), str(tmp_path / "mark")
    stream.maintain(spark, store, schema, view, mark).awaitTermination(120)
    assert [r["version"] for r in stream.read_view(spark, view).collect()] == [2]
    made.filter("version = 1").withColumn("version", F.lit(7).cast("long")).write.mode("append").partitionBy("method").parquet(f"{store}/runs")
    stream.maintain(spark, store, schema, view, mark).awaitTermination(120)
    assert [r["version"] for r in stream.read_view(spark, view).collect()] == [7] and os.path.isdir(view)


def test_report_text(spark):
    rows = [(k, ["Coarse", "Medium"][k % 2], k % 3 == 0, float(k), float(k * k)) for k in range(8)]
    df = spark.createDataFrame(rows, "ms_id long, size_class string, cross_check_pass boolean, porosity double, tau double")
    text = collate.report(df, [("porosity", "tau", "porosity vs. tau")])
    assert "Spearman r = 1.00" in text and "- Fine: 0 samples" in text and "8 samples, 3 pass" in text


def test_batch_solves_what_it_records(spark, tmp_path):
    """Own axis per sample, no-op on repetition, pointers and one new run after a change."""
    grid = np.ones((4, 4, 4), dtype=np.uint8)
    grid[1:3, 1:3, 0] = 0  # the axes differ
    for ms in ("s1", "s2"):
        os.makedirs(tmp_path / "in" / ms)
        np.save(tmp_path / "in" / ms / "segmented.npy", grid)
        np.save(tmp_path / "in" / ms / "body_array.npy", np.repeat([1, 2], 2)[:, None, None] * grid)
    (tmp_path / "in" / "s2" / "manifest.json").write_text(json.dumps({"axis": 2, "vox": {}, "v_config": {"kcl_maxiter": 9}}))
    args = ["batch", "--data-dir", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--override-keys", '{"voxel": "v_config"}']

    def run(*more):
        cli.batch(spark, cli._parser().parse_args(args + list(more)))
        made, metrics = runstore.load_runs(spark, str(tmp_path / "out"))
        return made.orderBy("ms_id", "version", "method").collect(), metrics.orderBy("ms_id", "version", "method", "key").collect()

    made, metrics = run()
    assert [(r["ms_id"], r["version"], r["method"], r["status"]) for r in made] == [
        (ms, 1, m, "real") for ms in ("s1", "s2") for m in ("field", "network", "voxel")]
    value = {r["ms_id"]: r["value"] for r in metrics if (r["method"], r["key"]) == ("field", "d_eff")}
    assert abs(value["s1"] - value["s2"]) > 1e-6
    assert json.loads(made[5]["config"])["kcl_maxiter"] == 9
    assert run() == (made, metrics)
    again, more = run("--voxel-config", '{"sigma": 2.0}')
    assert [(r["method"], r["status"], r["points_to_version"]) for r in again if (r["ms_id"], r["version"]) == ("s1", 2)] == [
        ("field", "pointer", 1), ("network", "pointer", 1), ("voxel", "real", None)]
    assert {(r["version"], r["method"]) for r in more} == {(1, "field"), (1, "network"), (1, "voxel"), (2, "voxel")}


def test_settings_are_known_or_refused():
    with pytest.raises(ValueError):
        config.method_configs({"other_config": {}})
    assert config.solver_config("voxel", {"axis": 1, "kcl_maxiter": 3, "segmented_file": "a.npy"}) == config.VoxelConfig(axis=1)
    with pytest.raises(ValueError):
        config.solver_config("network", {"alhpa": 0.3})


def _blocks(root, names=("s1", "s2")):
    """Images with a pore channel through them and quadrant bodies."""
    rng = np.random.default_rng(5)
    for ms in names:
        phase = (rng.random((4, 4, 4)) < 0.75).astype(np.uint8)
        phase[:, 2, 2] = 1
        x, y, z = np.indices(phase.shape)
        body = np.where(phase > 0, 1 + 4 * x + 2 * (y // 2) + z // 2, 0)
        os.makedirs(root / ms)
        np.save(root / ms / "segmented.npy", phase)
        np.save(root / ms / "body_array.npy", body)


def _rows(df):
    df = df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_full_results_are_kept_and_analysed_without_a_solve(spark, tmp_path, monkeypatch):
    _blocks(tmp_path / "in", names := ("s1",))
    store, args = str(tmp_path / "out"), ["--data-dir", str(tmp_path / "in"), "--out", str(tmp_path / "out")]
    more = ["--network-config", '{"min_throat_size": 1, "merge_bodies": false, "area_method": "naive"}']

    def run(*extra):
        cli.batch(spark, cli._parser().parse_args(["batch", *args, *more, *extra]))
        return sorted((r["ms_id"], r["version"], r["method"], r["status"], r["has_full"]) for r in runstore.load_runs(spark, store)[0].collect())

    plain = run()
    assert not any(r[4] for r in plain) and not os.path.exists(f"{store}/results")
    kept = run("--save-full")  # same configs, but the stored runs have no tables: new real runs
    assert kept == sorted(plain + [(ms, 2, m, "real", True) for ms in names for m in ("field", "network", "voxel")])
    assert run("--save-full") == kept
    values = {(r["ms_id"], r["version"], r["key"]): r["value"] for r in runstore.load_runs(spark, store)[1].filter("method = 'voxel'").collect()}
    for ms in names:  # the second batch began with the field's potentials (warm start)
        assert values[ms, 2, "started"] == 1 and values[ms, 1, "started"] == 0 and values[ms, 2, "converged"] == 1
        assert values[ms, 2, "iterations"] < values[ms, 1, "iterations"] / 2
        assert values[ms, 2, "f"] == pytest.approx(values[ms, 1, "f"], rel=1e-9)
    fresh = pipelines.analyse(npy.read_volumes(spark, str(tmp_path / "in")), config.NetworkConfig(**json.loads(more[1])), n_random=3)
    want = {name: _rows(df) for name, df in fresh.items()}

    def refuse(*_, **__):
        raise AssertionError("solved again")

    for module in (transport, network):
        monkeypatch.setattr(module, "solve_recorded", refuse)
    got = cli.analyse_stored(spark, store, n_random=3)
    assert set(got) == set(want) and {name: _rows(df) for name, df in got.items()} == want
    assert results.pick_best(spark, store, "network", {"min_throat_size": 1}).count() == len(names)
    with pytest.raises(ValueError):
        cli.analyse_stored(spark, store, {"min_throat_size": 7})
    out = str(tmp_path / "tables")
    cli.inventory(spark, cli._parser().parse_args(["inventory", "--data-dir", store, "--out", out]))
    counts = {r["method"]: (r["n_real"], r["n_full"]) for r in spark.read.json(f"{out}/inventory_counts.json").collect()}
    assert counts == {m: (len(names), len(names)) for m in ("field", "network", "voxel")}


def test_a_batch_that_dies_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    _blocks(tmp_path / "in", ("s1",))
    store = str(tmp_path / "out")
    args = cli._parser().parse_args(["batch", "--data-dir", str(tmp_path / "in"), "--out", store, "--save-full",
                                     "--network-config", '{"min_throat_size": 1, "merge_bodies": false, "area_method": "naive"}'])

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(runstore, "append_runs", die)  # all result tables are written, the commit is not
        with pytest.raises(KeyboardInterrupt):
            cli.batch(spark, args)
    assert os.path.isdir(f"{store}/results/network.currents")
    assert results.pick_best(spark, store, "network").count() == 0
    cli.batch(spark, args)
    made = runstore.load_runs(spark, store)[0]
    assert {(r["version"], r["has_full"]) for r in made.collect()} == {(2, True)}  # number 1 is not used again
    picked = results.pick_best(spark, store, "network")
    stored = spark.read.parquet(f"{store}/results/network.bodies")
    assert stored.select("version").distinct().count() == 2
    loaded = results.load(spark, store, "network", "bodies", picked)
    assert loaded.count() == stored.filter("version = 2").count() and "version" not in loaded.columns


def test_loading_prunes_buckets(spark, tmp_path):
    root = str(tmp_path)
    for version in (1, 9, 17):
        table = spark.range(50).withColumn("ms_id", F.lit("a"))
        results.save({"t": table}, "field", spark.createDataFrame([("a", version)], "ms_id string, version long"), root)
    picked = lineage.cut(spark.createDataFrame([("a", 9)], "ms_id string, version long").withColumn("bucket", results.bucket()))
    df = results.load(spark, root, "field", "t", picked)
    assert df.count() == 50 and {f.split("bucket=")[1][0] for f in df.inputFiles() if "bucket=" in f} >= {"1"}
    assert "PartitionFilters: [isnotnull(bucket" in (plan := df._jdf.queryExecution().toString()) and "(bucket#" in plan and " = 1)" in plan
    with pytest.raises(ValueError):
        results.save({"t": spark.range(1).withColumn("version", F.lit(1))}, "field", picked, root)
