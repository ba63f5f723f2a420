"""History tables: closes, trends, source health, calibration, learning."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from . import rank

DAY = 86400


def first_closes(closes: DataFrame) -> DataFrame:
    """Insert-or-ignore: the first recorded close of an item stays."""
    return rank.best_by(closes, ["item_id"], [F.col("seq")],
                        ["closed_s", "actual_price"])


def match_closed(sales: DataFrame, observed: DataFrame, closed: DataFrame
                 ) -> DataFrame:
    """Sales of observed items that are not settled yet."""
    return sales.join(observed.select("item_id").distinct(), "item_id",
                      "left_semi").join(
        closed.select("item_id"), "item_id", "left_anti")


def awaiting(observed: DataFrame, closed: DataFrame, as_of_s: int,
             days: int = 10, limit: int | None = None) -> DataFrame:
    """Ended, unsettled items of the last days, newest end first."""
    ended = observed.filter(
        (F.col("site") == "ebay") & (F.col("end_s") < as_of_s)
        & (F.col("end_s") > as_of_s - days * DAY))
    out = ended.join(closed.select("item_id"), "item_id", "left_anti"
                     ).groupBy("item_id").agg(
        F.max("shipping").alias("shipping"), F.max("end_s").alias("end_s"))
    return out if limit is None else out.orderBy(
        F.desc("end_s"), "item_id").limit(limit)


def trend(history: DataFrame, current: DataFrame, as_of_s: int,
          days: int = 30, min_days: int = 3) -> DataFrame:
    """Change against the trusted value at or before `days` ago, else the
    oldest one if at least `min_days` old.  An as-of join done as one
    aggregation per query."""
    target = as_of_s - days * DAY
    past = history.filter(F.col("trusted") == 1).groupBy("query").agg(
        F.max_by(F.when(F.col("ts_s") <= target, F.col("fair")),
                 F.when(F.col("ts_s") <= target, F.struct("ts_s", "seq"))
                 ).alias("then"),
        F.min_by("fair", F.struct("ts_s", "seq")).alias("oldest"),
        F.min("ts_s").alias("oldest_s"))
    base = F.coalesce("then", F.when(
        F.col("oldest_s") <= as_of_s - min_days * DAY, F.col("oldest")))
    return current.join(past, "query", "left").select(
        "query", "fair", F.when(base != 0, (F.col("fair") - base) / base
                                ).alias("trend"))


def source_of(endpoint: Column) -> Column:
    """Health source an endpoint counts towards."""
    rules = {"ebay/api": "ebay/listings", "ebay/oauth": "ebay/listings",
             "ebay/html": "ebay/comps", "130point/html": "130point/comps"}
    out = F.concat(F.split_part(endpoint, F.lit("/"), F.lit(1)),
                   F.lit("/listings"))
    for name, source in rules.items():
        out = F.when(endpoint == name, F.lit(source)).otherwise(out)
    return F.when(endpoint.startswith("guide"), "catalogue/guide"
                  ).otherwise(out)


def health_status() -> Column:
    ok, failed = F.col("ok"), F.col("failed")
    return (F.when(F.col("skipped") > 0, "cooling")
            .when((failed > 0) & (ok > 0), "degraded")
            .when(failed > 0, "failing").when(ok > 0, "healthy")
            .otherwise("idle"))


def health(calls: DataFrame, by: list | None = None) -> DataFrame:
    """Outcome counts and status per source (and any extra grouping)."""
    keys = [source_of(F.col("endpoint")).alias("source"), *(by or [])]
    counts = [F.count_if(F.col("outcome") == o).alias(o)
              for o in ("ok", "failed", "skipped")]
    return calls.groupBy(*keys).agg(*counts).withColumn("status",
                                                        health_status())


def breaker_trips(calls: DataFrame, threshold: int = 3) -> DataFrame:
    """Failure streaks per endpoint and the cool-down they would cause.

    A streak is a run of failures between two successes, over any number of
    days.  Strikes double the half-hour pause up to a day and reset after a
    quiet day.  Successes are counted per endpoint and day, because a call log
    is the one table here that a single endpoint can dominate; the successes
    of earlier days (one row per day) then number the streaks through.
    """
    per_day = [F.col("endpoint"), F.floor(F.col("ts_s") / DAY).alias("day")]
    w = Window.partitionBy("endpoint", "day").orderBy("ts_s", "seq")
    judged = calls.filter(F.col("outcome") != "skipped").select("*",
                                                                per_day[1])
    runs = judged.select("*", F.coalesce(F.sum(
        F.when(F.col("outcome") == "ok", 1)).over(w), F.lit(0)).alias("run"))
    before = Window.partitionBy("endpoint").orderBy("day").rowsBetween(
        Window.unboundedPreceding, -1)
    days = judged.groupBy("endpoint", "day").agg(
        F.count_if(F.col("outcome") == "ok").alias("_oks")).select(
        "endpoint", "day", F.coalesce(F.sum("_oks").over(before), F.lit(0)
                                      ).alias("_before"))
    failed = runs.filter(F.col("outcome") == "failed").join(
        days, ["endpoint", "day"])
    streaks = failed.groupBy("endpoint", (F.col("_before") + F.col("run")
                                          ).alias("run")).agg(
        F.count(F.lit(1)).alias("failures"), F.max("ts_s").alias("tripped_s"))
    trips = streaks.filter(F.col("failures") >= threshold)
    # one row per trip now
    order = Window.partitionBy("endpoint").orderBy("tripped_s")
    quiet = (F.col("tripped_s") - F.lag("tripped_s").over(order)) >= DAY
    spans = trips.select("*", F.coalesce(quiet, F.lit(True)).cast("int"
                                                                  ).alias("_q"))
    spans = spans.select("*", F.sum("_q").over(order).alias("_span"))
    strikes = F.row_number().over(Window.partitionBy(
        "endpoint", "_span").orderBy("tripped_s"))
    return spans.select(
        "endpoint", "tripped_s", "failures", strikes.alias("strikes")
    ).withColumn("pause_minutes", F.least(
        F.lit(1440.0), F.lit(30.0) * F.pow(F.lit(2.0),
                                           F.col("strikes") - 1)))


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(
        F.struct(*others), F.col(order)).alias("_r")).select(key, "_r.*")


# ------------------------------------------------------------------- learning
def settled(observed: DataFrame, closed: DataFrame) -> DataFrame:
    return observed.join(closed, "item_id").filter(
        (F.col("fair") > 0) & (F.col("actual_price") > 0))


def training(observed: DataFrame, closed: DataFrame,
             s: Settings = DEFAULT) -> DataFrame:
    """Settled snapshots with target ratio, features and the first reason
    they may not train (NULL = kept)."""
    low, high = s.learner_ratio_band
    target = F.col("actual_price") / F.col("fair")
    reason = (F.when(F.col("fair") < s.learner_min_fair, "fair below floor")
              .when(F.col("n_comps").isNull(), "no evidence recorded")
              .when(F.col("n_comps") < s.min_specific_comps, "thin comps")
              .when(~F.col("trusted").eqNullSafe(F.lit(1)), "not trusted")
              .when(~F.col("target").between(low, high),
                    "ratio out of band"))
    return settled(observed, closed).withColumns({
        "target": target,
        "hours_feature": F.coalesce("hours_left", F.lit(72.0)),
        "cost_ratio": F.least((F.col("price") + F.col("shipping"))
                              / F.col("fair"), F.lit(2.0)),
        "bids_feature": F.coalesce("bids", F.lit(0)).cast("double"),
        "log_fair": F.log10(F.greatest("fair", F.lit(1.0)))
    }).withColumn("reason", reason)


def per_item(kept: DataFrame) -> DataFrame:
    """The best-evidenced snapshot of every auction."""
    return rank.best_by(kept, ["item_id"], [
        -F.col("n_comps"), -F.col("observed_s"), F.col("seq")])


def price_band() -> Column:
    return (F.when(F.col("fair") < 500, "lt500")
            .when(F.col("fair") < 2000, "500to2000").otherwise("gte2000"))


def settle_params(items: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Median close / fair overall and per price band; a band counts only
    with enough items.  Also the error of the overall median."""
    grouped = items.select(F.explode(F.array(F.lit("all"), price_band())
                                     ).alias("band"), "target")
    medians = rank.upper_median(grouped, ["band"], "target", "ratio")
    overall = medians.filter(F.col("band") == "all").select(
        F.col("ratio").alias("_all"))
    errors = grouped.join(F.broadcast(overall)).groupBy("band").agg(
        (F.sum(F.abs(F.col("target") - F.col("_all")).cast("decimal(28,12)")
               ).cast("double") / F.count(F.lit(1))).alias("mae"))
    return medians.join(errors, "band").filter(
        (F.col("band") == "all") | (F.col("n") >= s.min_parametric))


def calibration(observed: DataFrame, closed: DataFrame) -> DataFrame:
    """Median close / fair by hours left, buckets of at least five."""
    hours = F.col("hours_left")
    bucket = (F.when(hours < 6, "0-6").when(hours < 24, "6-24")
              .when(hours < 72, "24-72").when(hours >= 72, "72+"))
    rows = settled(observed, closed).select(
        bucket.alias("bucket"), (F.col("actual_price") / F.col("fair")
                                 ).alias("ratio")
    ).filter(F.col("bucket").isNotNull())
    return rank.upper_median(rows, ["bucket"], "ratio", "median_ratio"
                             ).filter(F.col("n") >= 5)


def settlements(observed: DataFrame, closes: DataFrame, days: int = 10
                ) -> DataFrame:
    """First close of an item within `days` of its last known end: price
    plus shipping, 0 stays unsold, NULL is unsettled.  One row per item goes
    into the join, so it grows with the closes only."""
    ends = observed.filter(F.col("end_s").isNotNull()).groupBy(
        "item_id").agg(F.max("end_s").alias("end_s"),
                       F.max("shipping").alias("shipping"))
    joined = ends.join(closes.select("item_id", "closed_s", "seq",
                                     "actual_price"), "item_id", "left")
    inside = F.col("closed_s").between(F.col("end_s"),
                                       F.col("end_s") + days * DAY)
    first = joined.groupBy("item_id", "end_s", "shipping").agg(F.min_by(
        F.when(inside, F.col("actual_price")),
        F.when(inside, F.struct("closed_s", "seq"))).alias("actual_price"))
    return first.select("item_id", "end_s", F.when(
        F.col("actual_price") > 0, F.col("actual_price") + F.col("shipping")
    ).otherwise(F.col("actual_price")).alias("settled_price"))
