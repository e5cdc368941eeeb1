"""Domain tables derived from the benchmark's parquet tables, all rows used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespark.operators import grid

EDGE = 4  # a 64-float vector is one 4x4x4 image


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as segmented images: phase 1 where the value is positive.

    ``body`` labels slab quadrants of the pore phase (0 = solid).
    """
    vox = grid.voxels_from_flat(table(spark, sf_dir, "embeddings"), "vec_id", "embedding",
                                (EDGE, EDGE, EDGE), keep=["label"])
    pore = F.col("value") > 0
    quadrant = 1 + 4 * F.col("x") + 2 * F.floor(F.col("y") / 2) + F.floor(F.col("z") / 2)
    return vox.select("ms_id", "label", "x", "y", "z", pore.cast("int").alias("phase"),
                      F.when(pore, quadrant).otherwise(0).cast("long").alias("body"))


def throats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` pairs (supplier, part) as throats of sample ``l_suppkey``.

    Two shares of current (``current_raw`` network, ``flux_raw`` voxel), a
    resistance split and a constriction ratio; NULL where no interface exists.
    """
    line = table(spark, sf_dir, "lineitem")
    agg = line.groupBy(F.col("l_suppkey").alias("ms_id"), F.col("l_partkey").alias("throat_id")).agg(
        F.sum("l_quantity").alias("current_raw"), F.sum("l_extendedprice").alias("flux_raw"),
        F.min("l_discount").alias("d"), F.max("l_tax").alias("t"), F.count(F.lit(1)).alias("n_lines"))
    matched = F.col("t") < 0.08
    return agg.select(
        "ms_id", "throat_id", "current_raw",
        F.when(matched, F.col("flux_raw")).alias("flux_raw"),
        matched.alias("has_interface"),
        F.when(matched, 0.6 + 5.0 * F.col("d")).alias("c"),
        F.when(matched, (0.6 + 5.0 * F.col("d")) * (0.9 + F.col("t"))).alias("c_geomean"),
        (0.5 + F.col("t")).alias("r_throat_res"), (1.0 + F.col("d") + F.col("t")).alias("r_edge"), "n_lines")


def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample -> size class, from the supplier's region."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ms_id"), "s_nationkey")
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    name = (F.when(F.col("n_regionkey").isin(0, 1), "Coarse").when(F.col("n_regionkey").isin(2, 3), "Medium")
            .otherwise("Fine"))
    return sup.join(nat, "s_nationkey").select(
        "ms_id", F.concat(name, F.lit("_microstructure_"), F.col("ms_id").cast("string")).alias("ms_name"))


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as solve requests: user = sample, type = method, order of ts = version."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("ms_id"), F.col("event_type").alias("method"), "ts", "event_id",
                     F.col("props").alias("config"), F.col("value").alias("metric"),
                     (F.col("value") > 20).alias("save_full"))
