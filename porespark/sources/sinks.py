"""Table sinks and the per-sample CSV scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_analysis(tables: dict[str, DataFrame], out: str, csv: bool = True) -> None:
    """Every table as parquet partitioned by nothing but size; flat CSV copies on request."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        if csv:
            df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}.csv")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_throat_csvs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """``<sample>_throats.csv`` files with the sample name taken from the file name."""
    df = spark.read.option("header", True).schema(schema).csv(pattern)
    return df.withColumn("ms_name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_throats\.csv$", 1))
