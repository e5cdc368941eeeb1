"""Session helpers shared by the CLI, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the plans are written for.  A cluster deployment sets its own
# ``spark.checkpoint.dir`` (shared storage) and shuffle width.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "porespark", **conf) -> SparkSession:
    """Local session used by tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores)))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
