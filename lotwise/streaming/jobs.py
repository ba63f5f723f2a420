"""Streaming twins of the batch history jobs.

Every job keys its state and gives it an end: a watermark, a time-to-live or
a durable table it is checked against.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SNAPSHOT = ("item_id string, site string, sweep long, observed_at timestamp, "
            "price double, bids int, end_time timestamp")


def observations(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Typed snapshots, one per item and sweep.  The sweep is part of the
    key, so the result does not depend on micro-batch borders."""
    return stream.withWatermark("observed_at", late
                                ).dropDuplicatesWithinWatermark(
        ["site", "item_id", "sweep"])


def settle(observed: DataFrame, closes: DataFrame, days: int = 10,
           late: str = "1 hour") -> DataFrame:
    """Left-outer interval join: a close within `days` of the end settles an
    item (price plus shipping, 0 stays unsold); a NULL price comes out once
    the watermark shows that no close can follow."""
    left = observed.withWatermark("end_time", late).alias("o")
    right = closes.withWatermark("closed_at", late).alias("c")
    joined = left.join(right, F.expr(
        "o.item_id = c.item_id AND c.closed_at >= o.end_time AND "
        f"c.closed_at <= o.end_time + interval {days} days"), "left_outer")
    actual = F.when(F.col("c.actual_price") > 0, F.col("c.actual_price")
                    + F.coalesce("o.shipping", F.lit(0.0))
                    ).otherwise(F.col("c.actual_price"))
    return joined.select("o.item_id", "o.end_time", "c.closed_at",
                         actual.alias("settled_price"))


def health_windows(calls: DataFrame, width: str = "30 minutes",
                   late: str = "10 minutes") -> DataFrame:
    """Outcome counts per source and tumbling window."""
    from ..operators.history import health_status, source_of
    counts = [F.count_if(F.col("outcome") == o).alias(o)
              for o in ("ok", "failed", "skipped")]
    return calls.withWatermark("ts", late).groupBy(
        F.window("ts", width), source_of(F.col("endpoint")).alias("source")
    ).agg(*counts).select("source", F.col("window.start").alias("start"),
                          "ok", "failed", "skipped",
                          health_status().alias("status"))


def daily_sales(sales: DataFrame, late: str = "1 day") -> DataFrame:
    """Sales per query and day; trailing velocity sums these rows instead of
    expanding every sale into 45 sliding windows."""
    return sales.withWatermark("sold_at", late).groupBy(
        F.window("sold_at", "1 day"), "query").agg(
        F.count(F.lit(1)).alias("sold")).select(
        "query", F.to_date("window.start").alias("day"), "sold")


def trailing_velocity(daily: DataFrame, as_of, days: int = 45) -> DataFrame:
    """Sales per month over the trailing days, from daily counts."""
    recent = daily.filter((F.col("day") > F.date_sub(as_of, days))
                          & (F.col("day") <= as_of))
    return recent.groupBy("query").agg(
        (F.sum("sold") / F.lit(days / 30.0)).alias("sales_per_month"))


def _latest(key, batches: Iterator[pd.DataFrame], state: GroupState
            ) -> Iterator[pd.DataFrame]:
    """Keep the newest snapshot of an item until its close is past due."""
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    for rows in batches:
        newest = rows.loc[rows["observed_at"].idxmax()]
        stamp = int(newest["observed_at"].value // 1000)
        if held is None or stamp > held[0]:
            end = newest["end_time"]
            end_us = (stamp if pd.isna(end) else int(end.value // 1000))
            held = (stamp, float(newest["price"]), int(newest["bids"]),
                    end_us)
    state.update(held)
    limit = max(held[3], held[0]) // 1000 + 10 * 86_400_000
    state.setTimeoutTimestamp(max(limit, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({
        "item_id": [key[0]], "observed_at": [pd.Timestamp(held[0], unit="us")],
        "price": [held[1]], "bids": [held[2]]})


def latest_state(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Current price and bids per item as updates; state ends ten days after
    the item's end."""
    return stream.withWatermark("observed_at", late).groupBy(
        "item_id").applyInPandasWithState(
        _latest, "item_id string, observed_at timestamp, price double, "
        "bids int", "seen long, price double, bids int, ends long",
        "update", GroupStateTimeout.EventTimeTimeout)


def alert_sink(path: str, deliver):
    """foreachBatch function: deliver candidates never alerted before, then
    record them.  The durable table is the memory: a replayed batch that was
    recorded delivers nothing again.  Delivery comes first, so no alert is
    lost; a stop between delivery and record repeats that batch once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "item_key string, alerted_batch long"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(
                spark._jsc.hadoopConfiguration()).exists(place):
            done = spark.read.schema(schema).parquet(path)
        else:
            done = spark.createDataFrame([], schema)
        fresh = batch.dropDuplicates(["item_key"]).join(
            done.select("item_key"), "item_key", "left_anti").persist()
        try:
            deliver(fresh)
            fresh.select("item_key", F.lit(batch_id).cast("long").alias(
                "alerted_batch")).write.mode("append").partitionBy(
                "alerted_batch").parquet(path)
        finally:
            fresh.unpersist()
    return run
