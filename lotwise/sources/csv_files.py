"""CSV folders whose files may differ in their header."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of every file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("at"))
    return lines.filter("start = 0").groupBy("file").agg(
        F.regexp_replace(F.min_by("value", "at"), "^\ufeff", "")
        .alias("header"))


def tables(spark: SparkSession, path: str) -> list[DataFrame]:
    """One table per distinct header, each file read by its own; `file` is
    the file's name. One row per file comes to the driver, as in a listing."""
    groups: dict[str, list[str]] = {}
    for row in headers(spark, path).orderBy("file").collect():
        groups.setdefault(row["header"], []).append(row["file"])
    out = []
    for files in groups.values():
        raw = spark.read.option("header", True).csv(files)
        raw = raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))
        out.append(raw.withColumn("file", F.element_at(F.split(
            F.col("_metadata.file_path"), "/"), -1)))
    return out
