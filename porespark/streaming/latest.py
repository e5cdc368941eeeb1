"""Keep the latest-version view current while runs are appended.

The reference lets results be collected during a batch; here new run files are
a stream and each micro-batch folds its newest versions into the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_stream(spark: SparkSession, root: str, schema) -> DataFrame:
    """Appended run files as a stream."""
    return spark.readStream.schema(schema).parquet(f"{root}/runs")


def latest_versions(runs: DataFrame) -> DataFrame:
    """Newest run per (sample, method); the aggregate state is one row per pair."""
    fields = ["version", "status", "points_to_version", "config_hash"]
    return (runs.groupBy("ms_id", "method").agg(F.max_by(F.struct(*fields), "version").alias("r"))
            .select("ms_id", "method", "r.*"))


def maintain(spark: SparkSession, root: str, schema, view: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's changed rows; readers take the newest row per pair."""
    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(view)
    return (latest_versions(run_stream(spark, root, schema)).writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_view(spark: SparkSession, view: str) -> DataFrame:
    """Current view: the newest version per pair over all epochs."""
    return latest_versions(spark.read.parquet(view))
