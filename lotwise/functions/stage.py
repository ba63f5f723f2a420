"""Compute columns once, then use them many times."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns behind a one-row generator.

    Without it the optimizer may merge projections and copy a large
    expression into every place that uses its column, which makes the
    generated code grow with each step of a long formula.
    """
    keep = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    # the columns are made below the generator: where a stage is too large
    # for one generated function, Spark compiles a projection in parts but
    # interprets what a generator holds
    return df.select(*keep, made.alias("_made")).select(
        *keep, F.explode(F.array("_made")).alias("_staged")).select(
        *keep, "_staged.*")
