"""Fair value from sales, catalogue and live asks, with its confidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.numbers import nearest
from ..functions.stage import stage
from ..functions.text import as_col

NOTE = "struct<code:string,text:string>"


def note(test: Column, code: str, text=None) -> Column:
    """A note struct when the test holds, else NULL (dropped later)."""
    body = F.lit(code) if text is None else as_col(text)
    return F.when(test, F.struct(F.lit(code).alias("code"),
                                 body.alias("text")))


def notes(*made: Column) -> Column:
    return F.array_compact(F.array(*made)).cast(f"array<{NOTE}>")


def has_note(code: str, column="notes") -> Column:
    return F.exists(as_col(column), lambda n: n["code"] == code)


def value_floor(category, override, s: Settings = DEFAULT,
                default: float | None = None) -> Column:
    """Smallest value worth showing: the row's own floor, else the
    category's, else the default."""
    out = F.lit(s.browse_floor if default is None else default)
    for name, amount in s.floor_by_category.items():
        out = F.when(as_col(category) == name, F.lit(float(amount))
                     ).otherwise(out)
    return F.coalesce(as_col(override), out)


def guide_worth(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Add `guide_skip`: why a catalogue lookup cannot change the row, or
    NULL.  Needs wanted, object_class, specificity, grade, category,
    value_floor_override, comps_value, n_comps."""
    floor = value_floor("category", "value_floor_override", s)
    reason = (
        F.when(F.col("wanted").isNotNull(), F.lit(None).cast("string"))
        .when(~F.col("object_class").isin("card", "game", "comic"),
              "class not covered")
        .when(F.col("specificity") < s.identity_floor, "identity too vague")
        .when((F.col("object_class") == "card")
              & (F.col("grade") <= s.pokemon_grade_floor)
              & (F.col("category") == "Pokemon Cards"), "grade below floor")
        .when((F.col("n_comps") >= s.min_specific_comps) & (floor > 0)
              & (F.col("comps_value") < floor * s.guide_skip_floor_ratio),
              "sales far below floor"))
    return df.withColumn("guide_skip", reason)


def blend(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Query-led value: sales and catalogue blended by sample and spread.

    Needs comps_value, n_comps, dispersion, avg_match, guide_value,
    ask_value, asks.  The catalogue is ignored from `guide_skip_comps`
    matched sales on.
    """
    names = df.columns
    n = F.coalesce(F.col("n_comps"), F.lit(0))
    cv = F.col("comps_value")
    df = stage(df, _n=n, _guide=F.when(
        ~F.coalesce(cv.isNotNull() & (n >= s.guide_skip_comps),
                    F.lit(False)), F.col("guide_value")))
    gv, n = F.col("_guide"), F.col("_n")
    disp = F.coalesce(F.col("dispersion"), F.lit(0.0))
    sample = F.least(F.lit(1.0), n / 8.0)
    weight = F.greatest(F.lit(0.35), sample * F.exp(-2.0 * disp))
    gap = F.least(F.lit(1.0), F.abs(cv - gv) / F.greatest(cv, gv))
    df = stage(df, _both=cv.isNotNull() & gv.isNotNull(),
               _weight=weight, _agree=F.lit(1.0) - gap,
               _by_asks=cv.isNull() & gv.isNull()
               & F.col("ask_value").isNotNull())
    both, agree = F.col("_both"), F.col("_agree")
    disputed = F.coalesce(both & (agree < 0.25), F.lit(False))
    base = (0.45 * sample + 0.35 * F.exp(-3.0 * disp)
            + 0.20 * F.when(n > 0, F.coalesce(F.col("avg_match"), F.lit(0.0))
                            ).otherwise(F.lit(0.5)))
    raised = F.when(both, F.least(F.lit(1.0), base + 0.1 * agree)
                    ).otherwise(base)
    confidence = F.when(disputed, F.least(raised, F.lit(0.30))
                        ).otherwise(raised)
    fair = (F.when(F.col("_by_asks"), F.col("ask_value"))
            .when(both, F.col("_weight") * cv
                  + (F.lit(1.0) - F.col("_weight")) * gv)
            .when(cv.isNotNull(), cv).when(gv.isNotNull(), gv * 0.95))
    ask_conf = F.least(F.lit(0.35), 0.15 + 0.02 * F.col("asks"))
    return df.select(
        *[c for c in names if c != "guide_value"],
        gv.alias("guide_value"), fair.alias("fair_value"),
        nearest(F.when(F.col("_by_asks"), ask_conf)
                .when(fair.isNotNull(), confidence)
                .otherwise(F.lit(0.0)), 3).alias("confidence"),
        disputed.alias("disputed"),
        notes(note(F.col("_by_asks"), "ASK-BASED"),
              note(disputed, "VALUE DISPUTED"),
              note(fair.isNull(), "NO VALUE")).alias("notes"))


def identity_led(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Value of one identified asset.

    The catalogue leads when it landed on the asset; sales of the asset may
    only lower it.  Otherwise the asset's sales, then an unlanded catalogue
    price, then the asset's live asks.  A broad query median is shown for
    browsing and never tradeable.

    Needs specificity; own pool: comps_value, n_comps, dispersion,
    avg_match, comp_age_hours, sales_per_month; query pool: broad_value,
    broad_n, broad_dispersion, broad_match, broad_age_hours; catalogue:
    guide_value, match, landed, sales_volume; asks: ask_value, asks;
    targeted.
    """
    names = df.columns
    landed = F.coalesce(F.col("landed"), F.lit(False))
    fallback = (F.col("comps_value").isNull() & ~landed
                & F.col("broad_value").isNotNull())
    df = stage(df, _landed=landed, _broad=fallback)
    broad = F.col("_broad")

    def pick(wide, own, missing):
        return F.when(broad, F.col(wide)).otherwise(
            F.coalesce(F.col(own), F.lit(missing)))

    df = stage(
        df, _cv=F.coalesce(F.col("comps_value"),
                           F.when(broad, F.col("broad_value"))),
        _n=pick("broad_n", "n_comps", 0),
        _disp=pick("broad_dispersion", "dispersion", 0.0),
        _match=pick("broad_match", "avg_match", 0.0),
        _age=F.when(broad, F.col("broad_age_hours")
                    ).otherwise(F.col("comp_age_hours")))
    cv, gv, n = F.col("_cv"), F.col("guide_value"), F.col("_n")
    landed = F.col("_landed")
    enough = n >= s.min_specific_comps
    lower = landed & F.coalesce(enough & (cv < gv), F.lit(False))
    asked = (cv.isNull() & gv.isNull() & F.col("ask_value").isNotNull()
             & (F.col("asks") >= s.min_specific_comps))
    fair = (F.when(lower, cv).when(landed, gv).when(cv.isNotNull(), cv)
            .when(gv.isNotNull(), gv).when(asked, F.col("ask_value")))
    vague = F.col("specificity") < s.identity_floor
    proven = F.col("targeted") & ~broad & enough
    agree = F.lit(1.0) - F.least(F.lit(1.0), F.abs(cv - gv)
                                 / F.greatest(cv, gv))
    df = stage(df, _fair=fair, _asked=asked, _lower=lower,
               _unresolved=~asked & fair.isNotNull()
               & (vague | (~landed & ~proven)),
               _mixed=~landed & cv.isNotNull() & (broad | ~enough),
               _disputed=F.coalesce(agree < 0.25, F.lit(False)))
    base = (F.when(F.col("match") == "exact", 0.72)
            .when(F.col("match") == "strong", 0.58).otherwise(0.30)
            * F.greatest(F.lit(0.35), F.col("specificity")))
    evidence = F.when(n > 0, 0.25 * (
        0.5 * F.least(F.lit(1.0), n / 8.0) + 0.3 * F.exp(-3.0 * F.col("_disp"))
        + 0.2 * F.col("_match"))).otherwise(F.lit(0.0))
    old = F.least(F.lit(1.0), F.col("_age") / s.comp_fresh_hours - 1.0)
    aged = (base + evidence) * F.when(
        F.col("_age") > s.comp_fresh_hours, F.lit(1.0) - 0.35 * old
    ).otherwise(F.lit(1.0))
    capped = F.when(~landed, F.least(aged, F.lit(s.mixed_pool_confidence))
                    ).otherwise(aged)
    capped = nearest(F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), 3)
    confidence = (F.when(F.col("_fair").isNull(), F.lit(0.0))
                  .when(F.col("_asked"), nearest(F.least(
                      F.lit(0.35), 0.15 + 0.02 * F.col("asks")), 3))
                  .when(F.col("_disputed"), F.least(capped, F.lit(0.30)))
                  .otherwise(capped))
    monthly = F.coalesce(nearest(F.nullif(F.col("sales_volume"), F.lit(0))
                                 / 12.0, 2), F.col("sales_per_month"))
    replaced = ("comps_value", "n_comps", "dispersion", "sales_per_month",
                "comp_age_hours", "avg_match")
    return df.select(
        *[c for c in names if c not in replaced],
        cv.alias("comps_value"), n.alias("n_comps"),
        F.col("_disp").alias("dispersion"), F.col("_match").alias("avg_match"),
        F.col("_age").alias("comp_age_hours"),
        monthly.alias("sales_per_month"),
        F.col("_fair").alias("fair_value"), confidence.alias("confidence"),
        F.col("_disputed").alias("disputed"),
        notes(note(F.col("_lower"), "COMPS BELOW GUIDE"),
              note(F.col("_asked"), "ASK-BASED"),
              note(F.col("_mixed"), "MIXED POOL"),
              note(F.col("_unresolved"), "IDENTITY UNRESOLVED"),
              note(F.col("_disputed"), "VALUE DISPUTED"),
              note(F.col("_fair").isNull(), "NO VALUE")).alias("notes"))


def promotable(s: Settings = DEFAULT) -> Column:
    """A discovery row whose own evidence identifies the asset."""
    blocked = F.lit(False)
    for code in ("ASK-BASED", "MIXED POOL", "IDENTITY UNRESOLVED",
                 "SUSPICIOUS"):
        blocked = blocked | has_note(code)
    return F.coalesce(
        F.col("targeted") & (F.col("fair_value") > 0)
        & (F.col("specificity") >= s.promotion_floor)
        & (F.col("match").isin("exact", "strong")
           | (F.col("n_comps") >= s.min_specific_comps))
        & ~F.col("disputed") & ~blocked, F.lit(False))


def promoted(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Discovery rows whose evidence identifies the asset become ordinary
    ones; `promoted_from_discovery` and a note tell so, and those that stay
    are marked as browsing only."""
    up = F.col("discovery") & promotable(s)
    marks = notes(note(up, "PROMOTED FROM DISCOVERY"),
                  note(F.col("discovery") & ~promotable(s), "DISCOVERY"))
    return stage(df, notes=F.concat("notes", marks),
                 promoted_from_discovery=up,
                 discovery=F.col("discovery") & ~up)
