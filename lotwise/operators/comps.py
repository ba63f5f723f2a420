"""Comparable sales: relevance, robust value, velocity, freshness, cache."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import grades, identity, matching, text, variants
from ..functions.numbers import nearest
from . import rank

WEIGHT = "decimal(38,28)"


def hours_between(earlier, later) -> Column:
    """Hours from one timestamp to another, from whole microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def relevance(q: Column, t: Column, s: Settings = DEFAULT) -> Column:
    """First reason a sale (identity t) does not price a text (identity q);
    NULL when it does.  `score` is judged separately, being the costly one.
    """
    return (F.when(grades.grade_conflict(q["effective"], t["effective"],
                                         True), "grade")
            .when(variants.language_conflict(q["low"], t["low"]), "language")
            .when(variant_clash(q, t), "variant")
            .when(variants.subject_missing(q["subject_all"], t["words"]),
                  "subject")
            .when(variants.year_conflict(q["years"], t["years"]), "year")
            .when(variants.number_conflict(q["card_number"],
                                           t["card_number"]), "number"))


def variant_clash(q: Column, t: Column) -> Column:
    """variants.variant_conflict on two parsed identities."""
    test = F.lit(False)
    for name in ("holo", "edition", "series", "completeness"):
        test = test | variants.stated_and_different(q[name], t[name])
    return test


def score(q: Column, t: Column, s: Settings = DEFAULT) -> Column:
    return matching.match_score(q["tokens"], t["tokens"], q["low"], t["low"],
                                s.similarity)


def relevant_sales(sales: DataFrame, as_of: Column, s: Settings = DEFAULT,
                   parsed: DataFrame | None = None) -> DataFrame:
    """Sales judged against their own standing query.

    Needs query, title, price, sold_at.  Titles repeat, so each distinct
    (query, title) is parsed and scored once and joined back.  Adds match,
    grader and weight; keeps only rows that price the query.
    """
    pairs = sales.select("query", "title").distinct()
    fields = identity.MATCH_FIELDS
    both = identity.attach(pairs, "title", "t", fields, parsed).join(
        identity.parse_distinct(sales, "query", "q", fields, parsed),
        "query")
    q, t = F.col("q"), F.col("t")
    # cheap exact rules and the lossless coverage bound first, the text
    # similarity only on what is left
    near = both.filter(relevance(q, t, s).isNull() & (
        matching.coverage(q["tokens"], t["tokens"])
        >= matching.coverage_floor(s.min_match)))
    scored = near.select("query", "title", score(q, t, s).alias("match"),
                         t["grader"].alias("grader"),
                         q["effective"].isNotNull().alias("query_graded"))
    scored = scored.filter(F.col("match") >= s.min_match)
    joined = sales.filter(F.col("price") > 0).join(
        scored, ["query", "title"])
    return weigh(joined, as_of, s)


def weigh(sales: DataFrame, as_of: Column,
          s: Settings = DEFAULT) -> DataFrame:
    """Grader-normalised price and recency weight x match, as an exact
    decimal so that sums do not depend on the order of rows."""
    factor = F.greatest(grades.grader_premium(F.col("grader"), s.premiums),
                        F.lit(0.01))
    age_days = F.coalesce(hours_between("sold_at", as_of) / 24.0,
                          F.lit(float(s.half_life_days)))
    recency = F.exp(-F.log(F.lit(2.0)) * age_days / s.half_life_days)
    return sales.withColumn(
        "price", F.when(F.col("query_graded"), F.col("price") / factor)
        .otherwise(F.col("price"))
    ).withColumn("weight", (recency * F.col("match")).cast(WEIGHT)
                 ).withColumn("match_exact", F.col("match").cast(WEIGHT))


def robust_value(rows: DataFrame, keys: list[str], s: Settings = DEFAULT,
                 hot_rows: int = rank.HOT_ROWS,
                 bound: DataFrame | None = None) -> DataFrame:
    """Recency-weighted median after dropping outliers, per key.

    rows: keys + price, weight, match_exact.  Result: value (NULL below
    three sales), n_used, dispersion, avg_match.
    """
    dist = rank.distribution(rows, keys, "price", w=F.col("weight"),
                             m=F.col("match_exact"))

    def steps(d, by):
        d = by.totals(d, kept=F.sum("n"))
        thin = d.filter(F.col("kept") < 3).groupBy(*keys).agg(
            F.max("kept").alias("n_used"))
        d = by.running(d.filter(F.col("kept") >= 3), "price", upto="n")
        d = by.totals(d, med=rank.element("price", "upto", half_of("kept")))
        d = by.running(d.withColumn("dev", F.abs(F.col("price")
                                                 - F.col("med"))),
                       "dev", dev_upto="n")
        d = by.totals(d, mad=rank.element("dev", "dev_upto",
                                          half_of("kept")))
        limit = s.mad_k * F.when(F.col("mad") == 0, F.col("med") * 0.05
                                 ).otherwise(F.col("mad"))
        d = d.withColumn("inside", F.col("dev") <= limit)
        d = by.totals(d, n_inside=F.sum(F.when(F.col("inside"), F.col("n"))))
        d = d.filter(F.col("inside") | (F.coalesce(
            F.col("n_inside"), F.lit(0)) < 3)).select(
            *keys, "price", "n", "w", "m")
        d = by.totals(d, used=F.sum("n"), weight_all=F.sum("w"),
                      match_all=F.sum("m"))
        d = by.running(d, "price", upto="n", w_upto="w")
        d = by.totals(
            d, value=F.min(F.when(reaches_half("w_upto", "weight_all"),
                                  F.col("price"))),
            med2=rank.element("price", "upto", half_of("used")))
        d = by.running(d.withColumn("dev", F.abs(F.col("price")
                                                 - F.col("med2"))),
                       "dev", dev_upto="n")
        full = d.groupBy(*keys).agg(
            F.max("value").alias("value"), F.max("used").alias("n_used"),
            rank.element("dev", "dev_upto", half_of("used")).alias("mad2"),
            F.max("med2").alias("med2"), F.max("match_all").alias("m"))
        full = full.select(
            *keys, "value", "n_used",
            F.when(F.col("med2") != 0, F.col("mad2") / F.col("med2"))
            .otherwise(F.lit(0.0)).alias("dispersion"),
            (F.col("m").cast("double") / F.col("n_used")).alias("avg_match"))
        return full.unionByName(thin.select(
            *keys, F.lit(None).cast("double").alias("value"), "n_used",
            F.lit(0.0).alias("dispersion"), F.lit(0.0).alias("avg_match")))

    return rank.by_temperature(dist, keys, steps, hot_rows, bound)


def half_of(total: str) -> Column:
    return F.floor(F.col(total) / 2)


def reaches_half(part: str, total: str) -> Column:
    """Twice a weight is at least another, to the last digit.  Spark rounds
    the product of a full-width weight to 26 places, and with it the other
    side, while weights of old sales begin beyond the 24th."""
    twice = (F.col(part).try_cast("decimal(36,28)")
             * F.lit(2).cast("decimal(1,0)"))
    return F.coalesce(twice >= F.col(total),
                      F.col(part) * 2 >= F.col(total))


def trimmed_floor(rows: DataFrame, keys: list[str], s: Settings = DEFAULT,
                  hot_rows: int = rank.HOT_ROWS,
                  bound: DataFrame | None = None) -> DataFrame:
    """Value floor from live asks, per key: at least three asks, outliers
    dropped, the element at a quarter of the rest, less ten percent."""
    return floor_of(rank.distribution(rows, keys, "price"), keys, hot_rows,
                    bound)


def floor_of(dist: DataFrame, keys: list[str],
             hot_rows: int = rank.HOT_ROWS,
             bound: DataFrame | None = None) -> DataFrame:
    """trimmed_floor of a distribution: keys, price, n."""
    def steps(d, by):
        d = by.totals(d, asks=F.sum("n")).filter(F.col("asks") >= 3)
        d = by.running(d, "price", upto="n")
        d = by.totals(d, med=rank.element("price", "upto", half_of("asks")))
        d = by.running(d.withColumn("dev", F.abs(F.col("price")
                                                 - F.col("med"))),
                       "dev", dev_upto="n")
        d = by.totals(d, mad=rank.element("dev", "dev_upto",
                                          half_of("asks")))
        limit = 3.0 * F.when(F.col("mad") == 0, F.col("med") * 0.05
                             ).otherwise(F.col("mad"))
        d = d.withColumn("inside", F.col("dev") <= limit)
        d = by.totals(d, n_inside=F.sum(F.when(F.col("inside"), F.col("n"))))
        d = d.filter(F.col("inside") | (F.coalesce(
            F.col("n_inside"), F.lit(0)) < 3)).select(
            *keys, "price", "n", "asks")
        d = by.totals(d, kept=F.sum("n"))
        d = by.running(d, "price", upto="n")
        return d.groupBy(*keys).agg(
            F.max("asks").alias("asks"),
            (rank.element("price", "upto", F.floor(F.col("kept") * 0.25))
             * 0.90).alias("ask_value"))

    return rank.by_temperature(dist, keys, steps, hot_rows, bound)


def velocity(rows: DataFrame, keys: list[str], as_of: Column,
             dated_site: str = "130point") -> DataFrame:
    """Sales per month: dated venues count 45 days, others a third of all."""
    dated = (F.col("site") == dated_site) & F.col("sold_at").isNotNull()
    recent = dated & (hours_between("sold_at", as_of) <= 45 * 24.0)
    agg = rows.groupBy(*keys).agg(
        F.bool_or(dated).alias("any_dated"),
        F.count_if(recent).alias("recent"), F.count_if(~dated).alias("rest"))
    return agg.select(*keys, F.when(F.col("any_dated"), nearest(
        F.col("recent") / 1.5, 2)).when(F.col("rest") > 0, nearest(
            F.col("rest") / 3.0, 2)).alias("sales_per_month"))


def newest_age(rows: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.greatest(
        F.lit(0.0), F.min(hours_between("sold_at", as_of))
    ).alias("comp_age_hours"))


def upsert_sales(sales: DataFrame) -> DataFrame:
    """One physical sale per (query, site, sale_key); the last write wins,
    so old and new captures are simply united first."""
    return rank.best_by(sales, ["query", "site", "sale_key"], [
        -F.unix_micros("scanned_at"), F.col("sale_id")])


def cached_sales(sales: DataFrame, as_of: Column, max_age_hours: float,
                 s: Settings = DEFAULT, allow_stale: bool = False
                 ) -> DataFrame:
    """Newest sales per query, only for queries with enough fresh ones."""
    newest = rank.top_n(sales, ["query"], [
        F.desc("scanned_at"), F.asc("sale_id")], s.comp_cache_rows)
    if allow_stale:
        return newest
    fresh = sales.groupBy("query").agg(F.count_if(
        hours_between("scanned_at", as_of) <= max_age_hours).alias("fresh"))
    return newest.join(fresh.filter(
        F.col("fresh") >= s.comp_cache_min).select("query"), "query",
        "left_semi")


def stale_note(age_hours: Column, blocked: Column, has_specific: Column,
               s: Settings = DEFAULT) -> Column:
    """Marker for evidence a blocked source has frozen; NULL when fresh."""
    stale = age_hours.isNull() | (age_hours >= s.stale_block_hours)
    return F.when(blocked & ~has_specific, F.when(stale, "STALE COMPS")
                  .otherwise("AGING COMPS"))
