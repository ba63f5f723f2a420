"""Why a valued row may not be acted on, learned from, or shown.

Each gate is one ordered expression: the first rule that applies is the
reason, NULL passes.  Gates read note codes, never note text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import grades
from ..functions.text import contains_any
from . import rank
from .fair import has_note, value_floor

# ---------------------------------------------------------------- fixed values
# Note codes that bar a row, and the reasons that readers of reports filter on.
BLOCKERS = (("ASK-BASED", "ask-based valuation"),
            ("MIXED POOL", "mixed comp pool"),
            ("SUSPICIOUS", "suspicious listing"),
            ("BELOW DECISION FLOOR", "below decision value floor"),
            ("IDENTITY UNRESOLVED", "card identity not resolved"),
            ("STALE COMPS", "comp evidence frozen by a blocked source"))
DISCOVERY, NO_VALUE = "discovery query", "no fair value"
DISPUTED, REGRADED = "disputed valuation", "listing-specific regrade"
OUTSIDE = "outside collection standards"
LOW_TRUST = "fair value below trust floor"
THIN = "too few matched comps"
# ------------------------------------------------------------ end fixed values
UNRESOLVED = ("IDENTITY UNRESOLVED", "MIXED POOL", "ASK-BASED")
STAGES = ("Fair-value floor", "ROI sanity ceiling", "Collection standards",
          "Output economics", "Report row cap")
QUARANTINE = "Decision-only quarantine"


def note_blocker() -> Column:
    return F.coalesce(*[F.when(has_note(code), reason)
                        for code, reason in BLOCKERS])


def tradeability() -> Column:
    return (F.when(F.col("discovery"), DISCOVERY)
            .when(F.coalesce(F.col("fair_value"), F.lit(0.0)) <= 0, NO_VALUE)
            .when(F.col("disputed"), DISPUTED)
            .otherwise(note_blocker()))


def evidence(s: Settings = DEFAULT) -> Column:
    fair = F.coalesce(F.col("fair_value"), F.lit(0.0))
    return (F.when(F.col("discovery"), DISCOVERY)
            .when(collection(s).isNotNull(), OUTSIDE)
            .when(fair <= 0, NO_VALUE)
            .when(fair < s.learner_min_fair, LOW_TRUST)
            .when(F.col("n_comps") < s.min_specific_comps, THIN)
            .when(F.col("regraded"), REGRADED)
            .when(F.col("disputed"), DISPUTED)
            .otherwise(note_blocker()))


def collection(s: Settings = DEFAULT) -> Column:
    low, query = F.lower("title"), F.lower("query")
    sealed = contains_any(low, ("sealed", "new in box", "nib", "shrink wrap",
                                "shrinkwrap"))
    graded = grades.grade_info("title").isNotNull()
    return (F.when(F.col("wanted").isNotNull(), F.lit(None).cast("string"))
            .when((F.col("category") == "Pokemon Cards")
                  & ~contains_any(query, s.era_exempt_queries)
                  & ~contains_any(low, s.accepted_eras),
                  "era outside the collection")
            .when((F.col("category") == "Video Games") & ~sealed & ~graded,
                  "game neither sealed nor graded"))


def output(s: Settings = DEFAULT) -> Column:
    grade = grades.grade_info("title")["effective"]
    takeable = F.col("has_buy_now") & (F.col("buy_now_price") > 0)
    near = F.coalesce(F.col("hours_remaining") <= s.zero_bid_hours,
                      F.lit(False))
    return (F.when(F.col("wanted").isNotNull(), F.lit(None).cast("string"))
            .when((grade <= s.pokemon_grade_floor)
                  & (F.col("category") == "Pokemon Cards"),
                  "grade at or below floor")
            .when(F.col("expected_value") < s.min_expected_value,
                  "expected value too low")
            .when(F.col("roi") < 0, "negative ROI")
            .when((F.col("listing_type") == "auction")
                  & (F.col("bid_count") < 1) & ~takeable & ~near
                  & (F.col("site") != "yahoo_jp"),
                  "zero-bid auction far from close"))


def unresolved() -> Column:
    test = F.lit(False)
    for code in UNRESOLVED:
        test = test | has_note(code)
    return test


def classify(valued: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Add `stage` and `reason` to every valued row; NULL stage is kept.

    Kept rows under the decision floor get a note, which quarantines them
    from decisions.  The row cap keeps every wanted item and the best scores;
    the rest are labelled, not dropped.
    """
    floor = F.greatest(value_floor("category", "value_floor_override", s),
                       F.lit(0.01))
    decision = F.greatest(value_floor(
        "category", "value_floor_override", s, s.decision_floor), F.lit(0.01))
    fair = F.coalesce(F.col("fair_value"), F.lit(0.0))
    found = F.coalesce(
        F.when(fair < floor, F.struct(F.lit(STAGES[0]).alias("stage"),
                                      F.lit("below floor").alias("reason"))),
        F.when(F.col("roi") > s.max_roi,
               F.struct(F.lit(STAGES[1]).alias("stage"),
                        F.lit("ROI above ceiling").alias("reason"))),
        F.when(F.col("_collection").isNotNull(),
               F.struct(F.lit(STAGES[2]).alias("stage"),
                        F.col("_collection").alias("reason"))),
        F.when(F.col("_output").isNotNull(),
               F.struct(F.lit(STAGES[3]).alias("stage"),
                        F.col("_output").alias("reason"))))
    judged = valued.withColumns({"_collection": collection(s),
                                 "_output": output(s)})
    judged = judged.withColumn("_found", found).withColumn(
        "notes", F.when(F.col("_found").isNull() & (fair < decision),
                        F.array_append("notes", F.struct(
                            F.lit("BELOW DECISION FLOOR").alias("code"),
                            F.lit("BELOW DECISION FLOOR").alias("text"))))
        .otherwise(F.col("notes")))
    judged = judged.drop("_collection", "_output")
    return cap_rows(judged, s)


def cap_rows(judged: DataFrame, s: Settings) -> DataFrame:
    """Label kept rows beyond the report size, if the caller states one.

    Candidates are a top-k of `max_rows`, so no global sort is needed; how
    many of them fit depends on the number of wanted items, a one-row table.
    """
    named = [c for c in judged.columns if c != "_found"]
    if s.max_rows is None:
        return judged.select(*named, F.col("_found.stage").alias("stage"),
                             F.col("_found.reason").alias("reason"))
    open_rows = F.col("_found").isNull() & F.col("wanted").isNull()
    taken = judged.agg(F.count_if(
        F.col("_found").isNull() & F.col("wanted").isNotNull())
        .alias("_taken"))
    order = [F.desc("opportunity_score"), F.asc("row_id")]
    # max_rows rows at most: one window over them is intended
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    best = (judged.filter(open_rows).select("opportunity_score", "row_id")
            .orderBy(*order).limit(s.max_rows).withColumn("_place", place)
            .join(F.broadcast(taken), F.col("_place") <= F.lit(s.max_rows)
                  - F.col("_taken"))
            .select("row_id", F.lit(True).alias("_fits")))
    out = judged.join(best, "row_id", "left")
    over = open_rows & F.col("_fits").isNull()
    return out.select(
        *named,
        F.when(over, STAGES[4]).otherwise(F.col("_found.stage")
                                          ).alias("stage"),
        F.when(over, "below row cap").otherwise(F.col("_found.reason")
                                                ).alias("reason"))


def research(classified: DataFrame) -> DataFrame:
    """Rejected rows, plus a copy of kept rows barred from decisions; one
    pass, each row giving at most one record."""
    barred = F.col("stage").isNull() & tradeability().isNotNull()
    record = F.when(F.col("stage").isNotNull(), F.struct("stage", "reason")
                    ).when(barred, F.struct(F.lit(QUARANTINE).alias("stage"),
                                            tradeability().alias("reason")))
    others = [c for c in classified.columns if c not in ("stage", "reason")]
    return classified.select(*others, F.explode(F.array_compact(
        F.array(record))).alias("_r")).select(*others, "_r.*")


def waterfall(classified: DataFrame) -> DataFrame:
    """Rows entering, removed and remaining per stage, with the reasons.

    One aggregation over the rows; the rest works on its few result rows.
    """
    stage = F.coalesce("stage", F.when(tradeability().isNotNull(),
                                       QUARANTINE), F.lit("kept"))
    counts = classified.groupBy(
        stage.alias("stage"), F.coalesce("reason", tradeability()
                                         ).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))
    per_stage = counts.groupBy("stage").agg(
        F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(
            F.collect_list(F.struct((-F.col("n")).alias("n"), "reason"))),
            lambda r: F.concat(r["reason"], F.lit(" x"),
                               (-r["n"]).cast("string"))), "; "
        ).alias("detail"))
    names = STAGES + (QUARANTINE, "kept")
    listed = F.explode(F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(n).alias("stage"))
        for i, n in enumerate(names)]))
    spark = classified.sparkSession
    stages = spark.range(1).select(listed.alias("s")).select("s.*")
    rows = stages.join(per_stage, "stage", "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    # seven rows: one window over the whole list is intended
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("n").over(every.orderBy("ord").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", before.alias("before"),
                       F.sum("n").over(every).alias("total"))
    return rows.filter(F.col("stage") != "kept").select(
        "stage", (F.col("total") - F.col("before")).alias("starting"),
        F.col("n").alias("removed"),
        (F.col("total") - F.col("before") - F.col("n")).alias("remaining"),
        F.coalesce(F.nullif("detail", F.lit("")), F.lit("none")
                   ).alias("detail"))


def collisions(valued: DataFrame, min_group: int = 3, sample: int = 3
               ) -> DataFrame:
    """One fair value shared by several different assets, with the first
    `sample` titles; they are a per-value top list, limited before the
    shuffle."""
    rows = valued.filter(F.col("fair_value") > 0).withColumn(
        "fair", F.round("fair_value", 2))
    groups = rows.groupBy("fair").agg(
        F.countDistinct(F.coalesce("identity_key", "title")).alias("assets"),
        F.count(F.lit(1)).alias("listings")
    ).filter(F.col("assets") >= min_group)
    titles = rank.top_n(rows.select("fair", "title", "row_id"), ["fair"],
                        [F.asc("row_id")], sample).groupBy("fair").agg(
        F.array_sort(F.collect_list(F.struct("row_id", "title"))).alias("s"))
    return groups.join(titles, "fair").select(
        "fair", "assets", "listings", F.array_join(F.transform(
            "s", lambda r: r["title"]), "; "
        ).alias("titles"))


def coverage(classified: DataFrame, raw: DataFrame) -> DataFrame:
    """Per-query funnel of the sports categories.

    raw: query, raw, relevant counts.
    """
    sports = F.col("category").isin("Sports Cards", "Sports Memorabilia")
    rows = classified.filter(sports)
    kept = F.col("stage").isNull()
    funnel = rows.groupBy("query").agg(
        F.count(F.lit(1)).alias("valued"),
        F.count_if(F.col("match").isin("exact", "strong")
                   & (F.col("guide_value") > 0)).alias("guide_resolved"),
        F.count_if((F.col("n_comps") >= 3)
                   & ~has_note("MIXED POOL")).alias("exact_comps"),
        F.count_if("promoted_from_discovery").alias("promoted"),
        F.count_if(has_note("ASK-BASED")).alias("ask_based"),
        F.count_if(kept).alias("browse"),
        F.count_if(kept & tradeability().isNull()
                   & (F.col("expected_value") > 0)).alias("action"))
    reasons = research(classified).filter(sports).groupBy(
        "query", "reason").agg(F.count(F.lit(1)).alias("n"))
    top = reasons.groupBy("query").agg(F.min_by(
        F.concat("reason", F.lit(" x"), F.col("n").cast("string")),
        F.struct((-F.col("n")).alias("n"), "reason")).alias("top_rejection"))
    return funnel.join(raw, "query", "left").join(top, "query", "left")
