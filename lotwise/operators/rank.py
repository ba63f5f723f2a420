"""Order statistics that hold up when one key owns most of the rows.

Values are first reduced to a distribution: one row per (key, value) with
counts and weights, partially aggregated before the shuffle.  Ordinary keys
are then ranked with windows over one shuffle.  Keys with more than
`hot_rows` rows are cut into value ranges, each range is ranked on its own,
and the range totals are added up, so no task ever holds such a key.  That
path refers to its input several times per step, so each step is written to
the shared checkpoint folder; it runs only when a hot key exists.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_ROWS = 500_000
RANGES = 64


class ColdKeys:
    """Keys that fit a task: windows over one hash partitioning."""

    def __init__(self, keys: list[str]):
        self.window = Window.partitionBy(*keys)

    def totals(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        return df.select("*", *[a.over(self.window).alias(name)
                                for name, a in aggregates.items()])

    def running(self, df: DataFrame, order: str, **measures: str) -> DataFrame:
        """Totals over rows ordered up to and including ties."""
        upto = self.window.orderBy(order)
        return df.select("*", *[F.sum(m).over(upto).alias(name)
                                for name, m in measures.items()])


class HotKeys:
    """Keys too large for a task: ranges of the ordered value."""

    def __init__(self, keys: list[str], ranges: int = RANGES):
        self.keys, self.ranges = keys, ranges

    def totals(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        per_key = df.groupBy(*self.keys).agg(
            *[a.alias(name) for name, a in aggregates.items()])
        return cut_lineage(df.join(cut_lineage(per_key), self.keys))

    def running(self, df: DataFrame, order: str, **measures: str) -> DataFrame:
        points = [i / self.ranges for i in range(1, self.ranges)]
        cuts = df.groupBy(*self.keys).agg(
            F.percentile_approx(order, points, 1000).alias("_cuts"))
        ranged = df.join(cut_lineage(cuts), self.keys).withColumn(
            "_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))
        ).drop("_cuts")
        inside = Window.partitionBy(*self.keys, "_range").orderBy(order)
        before = (Window.partitionBy(*self.keys).orderBy("_range")
                  .rowsBetween(Window.unboundedPreceding, -1))
        offsets = ranged.groupBy(*self.keys, "_range").agg(
            *[F.sum(m).alias(f"_t_{name}") for name, m in measures.items()]
        ).select(*self.keys, "_range",
                 *[F.sum(f"_t_{name}").over(before).alias(f"_o_{name}")
                   for name in measures])
        ranked = ranged.select("*", *[F.sum(m).over(inside).alias(name)
                                      for name, m in measures.items()])
        joined = ranked.join(offsets, [*self.keys, "_range"])
        types = dict(ranked.dtypes)

        def added(name: str) -> Column:
            # Spark drops a decimal place when it adds full-width decimals
            kind = types[name].replace("decimal(38,", "decimal(37,")
            return F.col(name).cast(kind) + F.col(f"_o_{name}").cast(kind)

        return cut_lineage(joined.select(*df.columns, *[
            F.when(F.col(f"_o_{name}").isNull(), F.col(name))
            .otherwise(added(name)).alias(name) for name in measures]))


def by_temperature(dist: DataFrame, keys: list[str],
                   steps: Callable[[DataFrame, object], DataFrame],
                   hot_rows: int = HOT_ROWS,
                   bound: DataFrame | None = None) -> DataFrame:
    """Run `steps(rows, strategy)` on cold and hot keys and unite them.

    `bound` is a cheaper frame with at least as many rows per key as `dist`
    (the raw table, say); it is counted once, on the key columns only, to see
    whether a hot key exists.
    """
    source = dist if bound is None else bound
    hot = (source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
           .filter(F.col("_rows") > hot_rows)
           .select(*[F.col(k).alias(f"_{k}") for k in keys]))
    if hot.isEmpty():
        return steps(dist, ColdKeys(keys))
    # every hot key, however many; the joins are shuffles that Spark splits
    # where a key is hot, and broadcasts where it has seen the side is small
    hot, dist = cut_lineage(hot), cut_lineage(dist)
    same = [dist[k].eqNullSafe(hot[f"_{k}"]) for k in keys]
    return steps(dist.join(hot, same, "left_anti"), ColdKeys(keys)
                 ).unionByName(steps(dist.join(hot, same, "left_semi"),
                                     HotKeys(keys)))


def distribution(df: DataFrame, keys: list[str], value: str,
                 **measures: Column) -> DataFrame:
    """One row per (keys, value) with its count `n` and summed measures."""
    return df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(m).alias(name) for name, m in measures.items()])


def element(order: str, running: str, index: Column) -> Column:
    """Aggregate: the value at a zero-based position of the sorted rows."""
    return F.min(F.when(F.col(running) > index, F.col(order)))


def half(total: str) -> Column:
    return F.floor(F.col(total) / 2)


def upper_median(df: DataFrame, keys: list[str], value: str, out: str,
                 hot_rows: int = HOT_ROWS,
                 bound: DataFrame | None = None) -> DataFrame:
    """Per key: row count `n` and the element at n // 2 of the sorted values
    (not the interpolated median)."""
    def steps(rows, by):
        rows = by.totals(rows, total=F.sum("n"))
        rows = by.running(rows, value, upto="n")
        return rows.groupBy(*keys).agg(
            F.max("total").alias("n"),
            element(value, "upto", half("total")).alias(out))

    return by_temperature(distribution(df, keys, value), keys, steps,
                          hot_rows, bound)


def best_by(df: DataFrame, keys: list[str], order: list[Column],
            columns: list[str] | None = None) -> DataFrame:
    """One row per key, the smallest by `order` (end it with a unique
    column).  An aggregate, so copies collapse before the shuffle."""
    names = columns or [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(
        F.struct(*names), F.struct(*[o.alias(f"o{i}")
                                     for i, o in enumerate(order)])
    ).alias("_row"))
    return picked.select(*keys, "_row.*")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
          rank: str | None = None) -> DataFrame:
    """First n rows per key.  Spark limits each map partition to n rows per
    key before the shuffle (WindowGroupLimit), so a hot key stays small."""
    ranked = df.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col("_rank") <= n)
    return (ranked.withColumnRenamed("_rank", rank) if rank
            else ranked.drop("_rank"))


def descending(value) -> Column:
    """A number negated for ascending struct orders; missing sorts last."""
    c = F.col(value) if isinstance(value, str) else value
    return -c
