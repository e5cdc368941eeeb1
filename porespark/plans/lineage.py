"""Lineage cuts on reliable storage.

Operators that read a result several times, and loops that re-read their own
output, store it as a table under the cluster's ``spark.checkpoint.dir``.  A
lost executor then costs one step, the plan does not grow, and the planner sees
real file sizes, so a join broadcasts a side only when its measured size is
under the session's threshold.  (An RDD checkpoint keeps the size *estimates* of
the plan it replaces, which multiply from round to round.)
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the checkpoint folder and read it back."""
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def even(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by node, body or throat: shuffled, never collected on the driver.

    Such sides grow with the input, and loops join them round after round, so that
    broadcasts would send the driver their bytes times rounds.
    """
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Drop a table made by ``cut`` that a later round has replaced."""
    files = df.inputFiles()
    if not files:
        return
    folder = files[0].rsplit("/", 1)[0]
    if "/cut-" not in folder:
        raise ValueError("not a stored cut")
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
