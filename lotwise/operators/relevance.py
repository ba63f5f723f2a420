"""Does a listing belong to its query?  One ordered rule, one reason."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import economics, grades, identity, text, variants
from .comps import hours_between, score, variant_clash

TARGET_FIELDS = tuple(dict.fromkeys(
    identity.MATCH_FIELDS + identity.ASSET_FIELDS
    + ("set_tokens", "grade", "printed_grade", "variant")))


def attach_queries(listings: DataFrame, queries: DataFrame) -> DataFrame:
    """Listing rows with the attributes of the query that found them.  The
    query table is small; Spark's own size estimate decides the join."""
    graded = F.lower("query").rlike(r"\b(psa|bgs|cgc|sgc|bvg|wata|vga)\s*\d")
    q = queries.select(
        "query", "discovery", "set_need", "structured_target", "grade_min",
        "grade_max", "value_floor_override", "max_buy_price",
        F.coalesce("resale_channel", F.lit("auto")).alias("resale_channel"),
        (~F.col("discovery") & (F.col("priority") | graded)
         ).alias("priority"))
    return listings.join(q, "query")


def sweep_queries(queries: DataFrame) -> DataFrame:
    """Queries a fixed-price sweep runs: priority, or naming a grade."""
    return queries.filter(F.col("priority") | grades.grade_info("query")
                          .isNotNull())


def with_clock(listings: DataFrame, as_of: Column) -> DataFrame:
    """Age and time left at an explicit clock, never the wall clock."""
    def hours(stamp, span):
        return F.when(F.col(stamp).isNotNull(),
                      F.greatest(F.lit(0.0), span))

    return listings.withColumns({
        "hours_remaining": hours("end_time", hours_between(as_of,
                                                           "end_time")),
        "age_hours": hours("created_at", hours_between("created_at",
                                                       as_of))})


def target_mismatch(want: Column, found: Column, low: Column, high: Column
                    ) -> Column:
    """Why a listing is not the structured target, or NULL."""
    banded = low.isNotNull() | high.isNotNull()

    def lacks(field):
        return want[field].isNotNull() & ~want[field].eqNullSafe(found[field])

    return (F.when(banded & found["grade"].isNull(), "not graded")
            .when(found["grade"] < low, "grade below band")
            .when(found["grade"] > high, "grade above band")
            .when((want["object_class"] != "unknown")
                  & (want["object_class"] != found["object_class"]),
                  "object class")
            .when(want["year"].isNotNull()
                  & ~F.array_contains(found["years"], want["year"]), "year")
            .when(~text.covers(want["subject"], found["subject"]), "subject")
            .when(lacks("number"), "card number")
            .when(~text.covers(want["set_tokens"], found["set_tokens"]),
                  "set")
            .when(~banded & grades.grade_conflict(
                want["effective"], found["effective"], True), "grade")
            .when(lacks("parallel"), "parallel")
            .when(lacks("serial"), "serial")
            .when(want["is_auto"] & ~found["is_auto"], "autograph")
            .when(want["is_relic"] & ~found["is_relic"], "relic"))


def past_horizon(s: Settings = DEFAULT) -> Column:
    """An auction ending too far away; fixed listings are exempt."""
    return F.coalesce((F.col("listing_type") != "fixed")
                      & (F.col("hours_remaining")
                         > s.auction_horizon_hours), F.lit(False))


def in_dead_zone(s: Settings = DEFAULT) -> Column:
    """A fixed listing neither fresh nor long forgotten."""
    start, end = s.bin_dead_days
    days = F.col("age_hours") / 24.0
    return F.coalesce((F.col("listing_type") != "auction")
                      & (days >= start) & (days < end), F.lit(False))


def with_relevance(listings: DataFrame, s: Settings = DEFAULT,
                   stored: DataFrame | None = None) -> DataFrame:
    """Add `reason` (NULL keeps the row).  Each distinct (query, title) is
    judged once; price and time rules follow per row."""
    pairs = listings.select("query", "title").distinct()
    bands = listings.select("query", "structured_target", "grade_min",
                            "grade_max").distinct()
    parsed = identity.attach(
        pairs, "title", "t", TARGET_FIELDS, stored).join(identity.attach(
            bands, "query", "q", TARGET_FIELDS, stored), "query")
    q, t = F.col("q"), F.col("t")
    strict = parsed.select(
        "query", "title",
        F.when(F.col("structured_target"), target_mismatch(
            q, t, F.col("grade_min"), F.col("grade_max"))).alias("r_target"),
        grades.grade_conflict(q["effective"], t["effective"]
                              ).alias("r_grade"),
        variants.language_conflict(q["low"], t["low"]).alias("r_language"),
        variant_clash(q, t).alias("r_variant"),
        variants.subject_missing(q["subject_all"], t["words"]
                                 ).alias("r_subject"),
        (score(q, t, s) < s.min_listing_match).alias("r_match"))
    cost = economics.landed_cost("current_price")
    foreign_site = F.col("site") == "yahoo_jp"
    worded = ~foreign_site & ~F.col("discovery") & F.col("misspell_from"
                                                        ).isNull()
    reason = (
        F.when(F.lit(s.drop_fixed) & (F.col("listing_type") == "fixed"),
               "fixed price")
        .when(text.excluded_keyword("title", s.excluded_keywords),
              "excluded keyword")
        .when(text.has_condition_mark("title", s.condition_marks),
              "condition mark")
        .when(F.col("r_target").isNotNull(),
              F.concat(F.lit("target: "), F.col("r_target")))
        .when(F.col("r_grade"), "grade conflict")
        .when(~foreign_site & F.col("r_language"), "language conflict")
        .when(F.col("r_variant"), "variant conflict")
        .when(worded & F.col("r_subject"), "wrong subject")
        .when(worded & F.col("r_match"), "title match below threshold")
        .when(cost > F.col("max_buy_price"), "over query price cap")
        .when(cost > s.max_price, "over global price cap")
        .when(past_horizon(s), "auction too far away")
        .when(in_dead_zone(s), "fixed price aged"))
    return listings.join(strict, ["query", "title"]).withColumn(
        "reason", reason).drop("r_target", "r_grade", "r_language",
                               "r_variant", "r_subject", "r_match")
