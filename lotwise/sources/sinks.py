"""Where results go: partitioned tables and CSV views."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_run(df: DataFrame, path: str, run_date: str,
               by: tuple[str, ...] = ()) -> None:
    """Append one run to a history table, partitioned by run date.  Running
    the same date again replaces just that date."""
    spark = df.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.withColumn("run_date", F.lit(run_date).cast("date")).write.mode(
            "overwrite").partitionBy("run_date", *by).parquet(path)
    finally:
        spark.conf.set(mode, before)


def read_history(spark, path: str) -> DataFrame:
    """A history table whose columns may have grown over time."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A flat view as CSV; arrays are joined to text."""
    flat = [F.array_join(F.col(n).cast("array<string>"), "; ").alias(n)
            if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
