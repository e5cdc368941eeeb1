"""Command line: ``python -m porespark.cli {batch,analyse,collect,whatif} ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespark.config import AXIS_INDEX, AXIS_NAMES, METHODS, NetworkConfig, solver_config
from porespark.operators import collate as collations
from porespark.operators import grid, whatif
from porespark.operators import runs as run_ops
from porespark.plans import pipelines
from porespark.plans.lineage import cut
from porespark.sources import npy, results, runstore, samples, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="porespark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("batch", "analyse", "whatif"):
        s = sub.add_parser(name)
        s.add_argument("--data-dir", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--phase-id", type=int, default=1)
        s.add_argument("--axis", type=int, default=0)
        s.add_argument("--voxel-config", type=json.loads, default={})
        s.add_argument("--network-config", type=json.loads, default={})
        if name == "batch":
            s.add_argument("--field-config", type=json.loads, default={})
            s.add_argument("--override-keys", type=json.loads, default={})
            s.add_argument("--segmented-file", default="segmented.npy")
            s.add_argument("--body-file", default="body_array.npy")
            s.add_argument("--save-full", action="store_true", help="keep the tables of every run")
        if name == "analyse":
            s.add_argument("--stored", help="store of a batch with full results; nothing is solved")
            s.add_argument("--criteria", type=json.loads, default={}, help="settings that the stored network run must have")
        if name == "whatif":
            s.add_argument("--criterion", action="append", help=f"rule, repeatable; one of {sorted(whatif.RULES)}")
    for name in ("collate", "inventory"):
        s = sub.add_parser(name)
        s.add_argument("--data-dir", required=True)
        s.add_argument("--out", required=True)
    c = sub.add_parser("collect")
    c.add_argument("--data-dir", required=True)
    c.add_argument("--out")
    c.add_argument("--out-long")
    return p


def _network(args) -> NetworkConfig:
    return NetworkConfig(**{"direction": AXIS_NAMES[args.axis], **args.network_config})


def _result(vox: DataFrame, method: str, config: dict, start: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Metrics and tables of one method for samples that share a config."""
    cfg = solver_config(method, config)
    if method == "field":
        return pipelines.field_result(vox, cfg)
    if method == "voxel":
        return pipelines.voxel_result(vox, cfg, start)
    return pipelines.network_result(vox, cfg)


def _first_guess(spark: SparkSession, root: str, vox: DataFrame, fresh: list[dict[str, DataFrame]]) -> DataFrame | None:
    """Field potentials of these samples where the grid is the same: of this batch, else of the store."""
    found = [(t["phi"].select("ms_id", "node_id", "phi"), t["shape"]) for t in fresh]
    picked = results.pick_best(spark, root, "field")
    for _, shape in found:
        picked = picked.join(shape.select("ms_id"), "ms_id", "left_anti")
    if not picked.isEmpty():
        phi, shape = (results.load(spark, root, "field", name, picked) for name in ("phi", "shape"))
        found.append((phi.select("ms_id", "node_id", "phi"), shape))
    now, out = cut(grid.extents(vox)), None
    for phi, shape in found:
        part = pipelines.same_grid(phi, shape, now)
        out = part if out is None else out.unionByName(part)
    return out


def batch(spark: SparkSession, args) -> None:
    """All three methods over every sample folder, each sample with its own effective config.

    Samples that are up to date are left alone; known configs become pointers.
    The rest is solved with one plan per distinct config, so the plans number as
    many as there are configs, not samples.  With ``--save-full`` the tables of
    every run are kept, and voxel solves start from stored field potentials.
    """
    vox = npy.read_volumes(spark, args.data_dir, segmented_file=args.segmented_file, body_file=args.body_file)
    wanted = samples.requested_configs(
        samples.manifests(spark, args.data_dir, vox), phase_id=args.phase_id, axis=args.axis, segmented_file=args.segmented_file,
        body_file=args.body_file, field=args.field_config, voxel=args.voxel_config, network=args.network_config,
        override_keys=args.override_keys)
    stored, known = runstore.stored_or_empty(spark, args.out)
    taken = known.select("ms_id", "version").distinct().unionByName(results.claims(spark, args.out))
    made = cut(run_ops.plan_versions(wanted, stored, taken, args.save_full))
    results.claim(made, args.out)
    real = made.filter("status = 'real'")
    rows = spark.createDataFrame([], runstore.METRIC_SCHEMA)
    fresh: list[dict[str, DataFrame]] = []
    for own in real.select("method", "config").distinct().orderBy("method", "config").collect():
        config = json.loads(own["config"])
        mine = real.filter((F.col("method") == own["method"]) & (F.col("config") == own["config"])).select("ms_id", "version")
        files = {"segmented_file": config.get("segmented_file", args.segmented_file), "body_file": config.get("body_array_file", args.body_file)}
        images = npy.read_volumes(spark, args.data_dir, **files).join(mine, "ms_id", "left_semi")
        start = _first_guess(spark, args.out, images, fresh) if args.save_full and own["method"] == "voxel" else None
        df, tables = _result(images, own["method"], config, start)
        if own["method"] == "field":
            fresh.append(tables)
        if args.save_full:
            results.save(tables, own["method"], mine, args.out)
        keys = [c for c in df.columns if c not in ("ms_id", "solve_failed")]
        values = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k).cast("double") for k in keys]))
        rows = rows.unionByName(df.join(mine, "ms_id").select("ms_id", "version", F.lit(own["method"]).alias("method"),
                                                              F.explode(values).alias("key", "value")))
    runstore.append_runs(made, rows, args.out)


def analyse(spark: SparkSession, args) -> None:
    """Analysis tables and reports, solved here or from the full results of a batch."""
    if args.stored:
        tables = analyse_stored(spark, args.stored, args.criteria)
    else:
        tables = pipelines.analyse(npy.read_volumes(spark, args.data_dir), _network(args), args.phase_id)
    sinks.write_analysis(tables, args.out)
    sinks.write_json(tables["overlap"], f"{args.out}/bottleneck_overlap.json")
    sinks.write_json(tables["comparison"], f"{args.out}/body_comparison.json")
    sinks.write_json(tables["clustering"], f"{args.out}/spatial_clustering.json")


def analyse_stored(spark: SparkSession, root: str, criteria: dict | None = None, fraction: float = 0.10,
                   n_random: int = 200) -> dict[str, DataFrame]:
    """The analysis of every sample with full network and field results; nothing is solved.

    Network runs are chosen by ``criteria`` or as the best of the latest config, field
    runs as the latter.  Samples are taken together by flow axis, three plans at most.
    """
    network, field = (results.pick_best(spark, root, m, c) for m, c in (("network", criteria), ("field", None)))
    network = network.join(field.select("ms_id"), "ms_id", "left_semi")
    direction = F.coalesce(F.try_variant_get(F.try_parse_json("config"), "$.direction", "string"), F.lit("x"))
    network = cut(network.withColumn("direction", direction))
    out: dict[str, DataFrame] = {}
    for own in network.select("direction").distinct().orderBy("direction").collect():
        mine = network.filter(F.col("direction") == own["direction"])
        theirs = field.join(mine.select("ms_id"), "ms_id", "left_semi")
        run = pipelines.stored_network(lambda name, m=mine: results.load(spark, root, "network", name, m))
        tables = pipelines.analysis_tables(run, results.load(spark, root, "field", "metrics", theirs),
                                           results.load(spark, root, "field", "flux", theirs), AXIS_INDEX[own["direction"]],
                                           fraction, n_random)
        out = {name: out[name].unionByName(df) if name in out else df for name, df in tables.items()}
    if not out:
        raise ValueError("the store has no sample with full network and field results that meet the criteria")
    return out


def what_if(spark: SparkSession, args) -> None:
    """A sweep over the named rules; one row per rule and sample."""
    rules = {c: c for c in args.criterion or ["bottleneck"]}
    out = whatif.sweep(npy.read_volumes(spark, args.data_dir), _network(args), rules)
    out.write.mode("overwrite").parquet(args.out)


def _keys(metrics: DataFrame) -> list[str]:
    return [r["key"] for r in metrics.select("key").distinct().orderBy("key").collect()]


def collect(spark: SparkSession, args) -> None:
    made, metrics = runstore.load_runs(spark, args.data_dir)
    keys = _keys(metrics)
    if args.out:
        run_ops.latest_wide(made, metrics, METHODS, keys).write.mode("overwrite").option("header", True).csv(args.out)
    if args.out_long:
        run_ops.all_versions(made, metrics, METHODS, keys).write.mode("overwrite").option("header", True).csv(args.out_long)


def collate(spark: SparkSession, args) -> None:
    """One row per sample of a stored batch: analysis summary beside the latest metrics, as a table and a report."""
    tables = analyse_stored(spark, args.data_dir)
    made, metrics = runstore.load_runs(spark, args.data_dir)
    table = cut(tables["throats"])
    summary = run_ops.latest_wide(made, metrics, METHODS, _keys(metrics))
    summary = summary.toDF(*[c.replace(".", "_") for c in summary.columns])
    names = table.select("ms_id").distinct().select("ms_id", F.col("ms_id").cast("string").alias("ms_name"))
    rows = cut(collations.collate(table, names, summary, tables["overlap"]))
    rows.write.mode("overwrite").parquet(f"{args.out}/collated.parquet")
    text = collations.report(rows, [("field_porosity", "field_tau_reconciled", "porosity vs. tortuosity")])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/report.md")


def inventory(spark: SparkSession, args) -> None:
    """What the store has of each sample and method, counted; an error if most samples lack full network results."""
    made = runstore.load_runs(spark, args.data_dir)[0]
    rows = cut(run_ops.inventory(made, METHODS))
    counts = cut(run_ops.inventory_counts(rows))
    sinks.write_json(rows, f"{args.out}/inventory.json")
    sinks.write_json(counts, f"{args.out}/inventory_counts.json")
    if run_ops.hard_stop(counts):
        raise SystemExit("fewer than half of the samples have full network results; run batch with --save-full")


def main(argv=None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("porespark").getOrCreate()
    {"batch": batch, "analyse": analyse, "whatif": what_if, "collect": collect, "collate": collate, "inventory": inventory}[args.command](spark, args)


if __name__ == "__main__":
    main()
