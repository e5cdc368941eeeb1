"""Run tables on disk, and import of a versioned folder tree."""

from __future__ import annotations

import json

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespark.config import canonical_json, config_hash
from porespark.sources.npy import open_store


def append_runs(runs: DataFrame, metrics: DataFrame, root: str) -> None:
    """Append to the run and metric tables; Spark's committer writes ``_SUCCESS`` last."""
    metrics.write.mode("append").partitionBy("method").parquet(f"{root}/metrics")
    runs.write.mode("append").partitionBy("method").parquet(f"{root}/runs")


def load_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/runs"), spark.read.parquet(f"{root}/metrics")


def stored_or_empty(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Run and metric tables of a store, each empty where the store has none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return tuple(spark.read.parquet(f"{root}/{name}").select(*empty.columns) if path(root, name).getFileSystem(conf).exists(path(root, name))
                 else empty for name, empty in (("runs", spark.createDataFrame([], RUN_SCHEMA)),
                                                ("metrics", spark.createDataFrame([], METRIC_SCHEMA))))


_PLACE = r"/([^/]+)/version(\d+)/([^/]+)/[^/]+$"


def _json_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Files of a name under ``<sample>/version<N>/<method>/``."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)
            .select(F.regexp_extract("path", _PLACE, 1).alias("ms_id"), F.regexp_extract("path", _PLACE, 2).alias("v"),
                    F.regexp_extract("path", _PLACE, 3).alias("method"), "path", F.col("content").cast("string").alias("text"))
            .filter("v <> ''").withColumn("version", F.col("v").cast("long")).drop("v"))


def _present(paths: list[str]) -> list[bool]:
    """Whether files are there.  Spark lists no names that begin with an underscore, Arrow's file systems do."""
    if not paths:
        return []
    store, _ = open_store(paths[0])
    return [i.type == fs.FileType.File for i in store.get_file_info([open_store(p)[1] for p in paths])]


def import_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(runs, metrics)`` from ``<sample>/version<N>/<method>/*.json``, in any store that Spark and Arrow read.

    A real run needs its ``_SUCCESS`` marker.  Binary result dumps are only
    noted as present, never opened.
    """
    def real(frames):
        for f in frames:
            folders = [path.rsplit("/", 1)[0] for path in f["path"]]
            done, full = (_present([f"{d}/{name}" for d in folders]) for name in ("_SUCCESS", "full_result.pkl"))
            rows = []
            for ms, method, text, version, ok, kept in zip(f["ms_id"], f["method"], f["text"], f["version"], done, full):
                if ok:
                    cfg = json.loads(text)
                    rows.append((ms, int(version), method, "real", None, config_hash(cfg), kept, canonical_json(cfg)))
            yield pd.DataFrame(rows, columns=RUN_COLUMNS)

    def pointer(frames):
        for f in frames:
            rows = []
            for ms, method, text, version in zip(f["ms_id"], f["method"], f["text"], f["version"]):
                p = json.loads(text)
                rows.append((ms, int(version), method, "pointer", int(p["points_to_version"]), p["config_hash"], False, None))
            yield pd.DataFrame(rows, columns=RUN_COLUMNS).astype({"config": object})

    def values(frames):
        for f in frames:
            rows = [(ms, int(version), method, key, float(v))
                    for ms, method, text, version in zip(f["ms_id"], f["method"], f["text"], f["version"])
                    for key, v in json.loads(text).items()
                    if not key.startswith("_") and isinstance(v, (int, float))]
            yield pd.DataFrame(rows, columns=["ms_id", "version", "method", "key", "value"])

    runs = _json_files(spark, root, "config.json").mapInPandas(real, RUN_SCHEMA).unionByName(
        _json_files(spark, root, "pointer.json").mapInPandas(pointer, RUN_SCHEMA))
    metrics = _json_files(spark, root, "metrics.json").mapInPandas(
        values, METRIC_SCHEMA)
    return runs, metrics


RUN_COLUMNS = ["ms_id", "version", "method", "status", "points_to_version", "config_hash", "has_full", "config"]
RUN_SCHEMA = ("ms_id string, version long, method string, status string, points_to_version long, config_hash string, "
              "has_full boolean, config string")
METRIC_SCHEMA = "ms_id string, version long, method string, key string, value double"
