"""Catalogue files: scan, typing and content check."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.guide_price import PRICE_COLUMNS, cents
from . import csv_files

REQUIRED = ("product-name", "console-name")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any folder of catalogue CSVs, each file by its own header; the
    file-name prefix names the host. Files without the required columns are
    left out and listed by `rejected_files`."""
    good = [typed(t) for t in csv_files.tables(spark, path)
            if set(REQUIRED) <= set(t.columns)]
    if not good:
        raise ValueError(f"no file with {', '.join(REQUIRED)} in {path}")
    return reduce(DataFrame.unionByName, good)


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, header) of the files that read_csv leaves out."""
    named = F.transform(F.split("header", ","), lambda c: F.trim(c, F.lit('" ')))
    return csv_files.headers(spark, path).filter(F.size(F.array_intersect(
        named, F.array(*map(F.lit, REQUIRED)))) < len(REQUIRED))


def typed(raw: DataFrame) -> DataFrame:
    """Integer cents, trimmed names and the host of text catalogue rows."""
    def column(name):
        return F.col(f"`{name}`") if name in raw.columns else F.lit(
            None).cast("string")

    host = F.when(F.lower("file").startswith("sportscardspro--"), "sports"
                  ).when(F.lower("file").startswith("pricecharting--"),
                         "general").otherwise("")
    return raw.select(
        column("id").alias("product_id"),
        F.trim(column("product-name")).alias("product_name"),
        F.trim(F.coalesce(column("console-name"), F.lit(""))
               ).alias("console_name"),
        *[cents(column(c.replace("_", "-"))).alias(c)
          for c in PRICE_COLUMNS],
        column("genre").alias("genre"),
        column("sales-volume").try_cast("long").alias("sales_volume"),
        host.alias("host"), "file"
    ).filter(F.coalesce("product_name", F.lit("")) != "")


def game_share(catalogue: DataFrame) -> DataFrame:
    """Per file: share of rows that are game consoles."""
    game = F.lit(False)
    for marker in vocab.GAME_CONSOLE_MARKERS:
        game = game | F.lower("console_name").contains(marker)
    return catalogue.filter(F.col("console_name") != "").groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(game).alias("games"))


def accepted(catalogue: DataFrame) -> DataFrame:
    """Rows of files that hold what their host promises: a sports file that
    is mostly game consoles is set aside whole."""
    wrong = game_share(catalogue).filter(
        (F.col("games") * 2 > F.col("rows"))
        & F.lower("file").startswith("sportscardspro")).select("file")
    return catalogue.join(wrong, "file", "left_anti")
