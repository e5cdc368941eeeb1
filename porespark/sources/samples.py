"""Sample folders: manifests and layered per-sample configs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespark.config import canonical_json, config_hash, method_configs


def manifests(spark: SparkSession, root: str, vox: DataFrame | None = None) -> DataFrame:
    """``(ms_id, manifest)`` JSON text; samples of ``vox`` without a file get ``{}``."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").load(root)
             .select(F.element_at(F.split("path", "/"), -2).alias("ms_id"), F.col("content").cast("string").alias("manifest")))
    if vox is None:
        return found
    return (vox.select("ms_id").distinct().join(found, "ms_id", "left")
            .select("ms_id", F.coalesce("manifest", F.lit("{}")).alias("manifest")))


def requested_configs(manifest: DataFrame, **batch) -> DataFrame:
    """Merged config and hash of every (sample, method): batch, manifest, then defaults."""
    ms_type = manifest.schema["ms_id"].dataType.simpleString()

    def merge(frames):
        for frame in frames:
            rows = []
            for ms, text in zip(frame["ms_id"], frame["manifest"]):
                for method, cfg in method_configs(json.loads(text), **batch).items():
                    rows.append((ms, method, canonical_json(cfg), config_hash(cfg)))
            yield pd.DataFrame(rows, columns=["ms_id", "method", "config", "config_hash"])
    return manifest.select("ms_id", "manifest").mapInPandas(merge, f"ms_id {ms_type}, method string, config string, config_hash string")
