"""Full results of runs as typed tables: stored, committed and loaded by version.

A store is a folder with, beside the ``runs`` and ``metrics`` tables of ``runstore``,

    claims                       (ms_id, version): numbers a batch has taken
    results/<method>.<table>     the run's table with its ``version``, partitioned by ``bucket``
                                 (a range of versions)

A batch claims its versions first, then writes the result tables, the metrics and, last,
the rows of ``runs``.  Those rows commit it: readers take result rows only for real runs in
``runs`` that say ``has_full``, and a number that was claimed is never given out again.  So
what a batch that died has written is seen by nobody, and no batch adds rows to it.

Loading names its runs as a small table ``(ms_id, version, bucket)``.  Its buckets, no more
than versions by ``VERSIONS_PER_BUCKET``, become a filter on the partition column, so
buckets that hold no run asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespark.plans.lineage import cut
from porespark.sources import runstore

VERSIONS_PER_BUCKET = 8


def bucket(version: str = "version"):
    return F.floor(F.col(version) / VERSIONS_PER_BUCKET).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def claims(spark: SparkSession, root: str) -> DataFrame:
    """``(ms_id, version)`` of every version that a batch has taken, finished or not."""
    if not _exists(spark, f"{root}/claims"):
        return spark.createDataFrame([], "ms_id string, version long")
    return spark.read.parquet(f"{root}/claims").select("ms_id", "version")


def claim(made: DataFrame, root: str) -> None:
    """Takes the versions of new ``runs`` rows."""
    made.select("ms_id", "version").distinct().write.mode("append").parquet(f"{root}/claims")


def save(tables: dict[str, DataFrame], method: str, versions: DataFrame, root: str) -> None:
    """Writes the tables of the samples in ``versions`` (ms_id, version), one version a sample."""
    for name, df in tables.items():
        if "version" in df.columns or "bucket" in df.columns:
            raise ValueError(f"{method}.{name}: version and bucket are the store's own columns")
        (df.join(versions.select("ms_id", "version"), "ms_id").withColumn("bucket", bucket())
         .write.mode("append").partitionBy("bucket").parquet(f"{root}/results/{method}.{name}"))


def chosen(runs: DataFrame, picked: DataFrame, method: str) -> DataFrame:
    """The runs of ``picked`` (ms_id, version) that are real, committed and full, with their bucket and config."""
    full = runs.filter((F.col("status") == "real") & F.col("has_full") & (F.col("method") == method))
    return full.join(picked.select("ms_id", "version"), ["ms_id", "version"]).select("ms_id", "version", bucket().alias("bucket"), "config")


def load(spark: SparkSession, root: str, method: str, name: str, runs: DataFrame) -> DataFrame:
    """A result table of the runs that ``chosen`` gave; stored columns only, one version a sample."""
    buckets = [r["bucket"] for r in runs.select("bucket").distinct().collect()]
    stored = spark.read.parquet(f"{root}/results/{method}.{name}").filter(F.col("bucket").isin(buckets))
    return stored.join(runs.select("ms_id", "version", "bucket"), ["bucket", "ms_id", "version"]).drop("bucket", "version")


def pick_best(spark: SparkSession, root: str, method: str, criteria: dict | None = None) -> DataFrame:
    """The stored run of each sample that an analysis should read.

    Without criteria the best run of the latest version's config, else the newest whose
    config meets them; only runs with full results count.
    """
    from porespark.operators import runs as run_ops

    made = runstore.stored_or_empty(spark, root)[0]
    if criteria:
        found = run_ops.matching(made.filter("has_full"), criteria).filter(F.col("method") == method).select("ms_id", "version")
    else:
        found = (run_ops.best_full(made).filter((F.col("method") == method) & F.col("best_has_full"))
                 .select("ms_id", F.col("best_version").alias("version")))
    return cut(chosen(made, found, method))
