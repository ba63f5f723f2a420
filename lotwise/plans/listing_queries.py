"""Queries over listings: keys, duplicates, costs, exits, relevance."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import economics, guide_price, identity, text
from ..functions.stage import stage
from ..operators import dedupe, relevance
from ..sources.adapters import AS_OF, at, ctes, view
from .. import vocab
from . import duck
from .comp_queries import LANDED_SQL, now
from .registry import query

S = DEFAULT


def listings(spark, sf_dir):
    return view(spark, sf_dir, "listings").withColumns({
        "end_time": at("end_s"), "created_at": at("created_s")})


def queries(spark, sf_dir):
    return view(spark, sf_dir, "standing_queries")


def prepared(spark, sf_dir):
    """Listings with query attributes, clock and duplicate key."""
    rows = relevance.attach_queries(listings(spark, sf_dir),
                                    queries(spark, sf_dir))
    return dedupe.with_listing_key(relevance.with_clock(rows, now()))


KEY_SQL = f"""coalesce('asset:' || nullif(lower(regexp_replace(
 canonical_asset_id, '\\s+', '', 'g')), ''), 'listing:' || lower(site) || ':'
 || coalesce(nullif(lower(trim(listing_id)), ''),
 {duck.part('url', vocab.ITEM_PATH)}), 'url:' || lower(site) || ':' ||
 nullif(lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '')),
 ''), 'anonymous:' || lower(site) || ':' || row_id)"""
PREPARED = f"""{ctes('listings', 'standing_queries')}, prepared AS (
 SELECT l.*, q.discovery, q.set_need, q.structured_target, q.grade_min,
 q.grade_max, q.value_floor_override, q.max_buy_price,
 coalesce(q.resale_channel, 'auto') AS resale_channel,
 NOT q.discovery AND (q.priority OR regexp_matches(lower(l.query),
 '\\b(psa|bgs|cgc|sgc|bvg|wata|vga)\\s*\\d')) AS priority,
 {KEY_SQL} AS listing_key, {LANDED_SQL} AS landed,
 greatest(0e0, (end_s - {AS_OF}) / 3600e0) AS hrs0,
 CASE WHEN end_s IS NOT NULL THEN greatest(0e0, (end_s - {AS_OF}) / 3600e0)
 END AS hours_remaining,
 CASE WHEN created_s IS NOT NULL THEN greatest(0e0, ({AS_OF} - created_s)
 / 3600e0) END AS age_hours
 FROM listings l JOIN standing_queries q ON l.query = q.query)"""


@query("listing_keys", "W1 J1 F11", f"""{PREPARED}
SELECT row_id, listing_key, priority, discovery, resale_channel,
 hours_remaining, age_hours FROM prepared""")
def listing_keys(spark, sf_dir):
    return prepared(spark, sf_dir).select(
        "row_id", "listing_key", "priority", "discovery", "resale_channel",
        "hours_remaining", "age_hours")


@query("dedupe_within_query", "W2 R2", f"""{PREPARED}
SELECT query, listing_key, row_id, current_price FROM (SELECT *, row_number()
 OVER (PARTITION BY query, listing_key ORDER BY landed, row_id) AS n
 FROM prepared) WHERE n = 1""")
def dedupe_within_query(spark, sf_dir):
    return dedupe.within_query(prepared(spark, sf_dir)).select(
        "query", "listing_key", "row_id", "current_price")


CONTEXT = f"""{PREPARED}, lp AS (SELECT DISTINCT query, title FROM prepared),
 lq AS (SELECT DISTINCT query AS qtext FROM prepared),
 {duck.identity('lp', 'title', 't')}, {duck.identity('lq', 'qtext', 'q')}"""
MATCH = duck.match_score("q.tokens", "t.tokens", "q.low", "t.low")


@query("dedupe_across_queries", "W3", f"""{CONTEXT}, sc AS (SELECT p.*,
 {MATCH} AS match, len(regexp_extract_all(lower(p.query), '[a-z0-9]+'))
 AS n_words FROM prepared p JOIN t ON p.query = t.query AND p.title = t.title
 JOIN q ON p.query = q.qtext), r AS (SELECT *, row_number() OVER (PARTITION BY
 listing_key ORDER BY NOT set_need, NOT structured_target, discovery,
 NOT priority, -match, -n_words, landed, row_id) AS n FROM sc)
SELECT listing_key, max(CASE WHEN n = 1 THEN row_id END) AS row_id,
 max(CASE WHEN n = 1 THEN query END) AS query,
 array_to_string(list_sort(list(DISTINCT query)), '; ') AS matched_queries,
 count(*) AS contexts, bool_or(priority) AS priority,
 bool_and(discovery) AS discovery, bool_or(set_need) AS set_need,
 bool_or(structured_target) AS structured_target,
 min(value_floor_override) AS value_floor_override
FROM r GROUP BY listing_key""")
def dedupe_across_queries(spark, sf_dir):
    rows = dedupe.with_context(prepared(spark, sf_dir))
    return dedupe.across_queries(rows).select(
        "listing_key", "row_id", "query",
        F.array_join("matched_queries", "; ").alias("matched_queries"),
        "contexts", "priority", "discovery", "set_need",
        "structured_target", "value_floor_override")


def target_sql(w: str, f: str) -> str:
    def lacks(c):
        return f"({w}.{c} IS NOT NULL AND {w}.{c} IS DISTINCT FROM {f}.{c})"
    banded = "(grade_min IS NOT NULL OR grade_max IS NOT NULL)"
    return duck.case([
        (f"{banded} AND {f}.grade IS NULL", "'not graded'"),
        (f"{f}.grade < grade_min", "'grade below band'"),
        (f"{f}.grade > grade_max", "'grade above band'"),
        (f"{w}.object_class <> 'unknown' AND {w}.object_class <> "
         f"{f}.object_class", "'object class'"),
        (f"{w}.year IS NOT NULL AND NOT list_contains({f}.years, {w}.year)",
         "'year'"),
        (f"NOT list_has_all({f}.subject, {w}.subject)", "'subject'"),
        (lacks("number"), "'card number'"),
        (f"NOT list_has_all({f}.set_tokens, {w}.set_tokens)", "'set'"),
        (f"NOT {banded} AND coalesce({w}.effective, 5e0) <> "
         f"coalesce({f}.effective, 5e0)", "'grade'"),
        (lacks("parallel"), "'parallel'"), (lacks("serial"), "'serial'"),
        (f"{w}.is_auto AND NOT {f}.is_auto", "'autograph'"),
        (f"{w}.is_relic AND NOT {f}.is_relic", "'relic'")])


CLASH = " OR ".join(f"coalesce(q.{f} <> t.{f}, false)" for f in (
    "holo", "edition", "series", "completeness"))
RELEVANT = f"""{CONTEXT}, judged AS (SELECT p.*, {MATCH} AS match,
 t.object_class AS object_class, t.gi AS gi,
 {target_sql('q', 't')} AS tm,
 coalesce(q.effective <> t.effective, false) AS rg,
 t.is_foreign OR ({duck.hit('t.low', vocab.JAPANESE)} AND NOT
 {duck.hit('q.low', vocab.JAPANESE_NATIVE_QUERY)}) AS rl, {CLASH} AS rv,
 len(q.subject_all) > 0 AND NOT list_has_any(q.subject_all, t.words) AS rs
 FROM prepared p JOIN t ON p.query = t.query AND p.title = t.title
 JOIN q ON p.query = q.qtext), reasoned AS (SELECT *, CASE
 WHEN {duck.contains_any('lower(title)', S.excluded_keywords)}
 THEN 'excluded keyword'
 WHEN regexp_matches(title, '(?:^|[^A-Za-z0-9])\\(?(?:OC|MK|ST)\\)?(?:$|[^A-Za-z0-9])')
 THEN 'condition mark'
 WHEN structured_target AND tm IS NOT NULL THEN 'target: ' || tm
 WHEN rg THEN 'grade conflict'
 WHEN site <> 'yahoo_jp' AND rl THEN 'language conflict'
 WHEN rv THEN 'variant conflict'
 WHEN site <> 'yahoo_jp' AND NOT discovery AND misspell_from IS NULL AND rs
 THEN 'wrong subject'
 WHEN site <> 'yahoo_jp' AND NOT discovery AND misspell_from IS NULL AND
 match < 0.6 THEN 'title match below threshold'
 WHEN landed > max_buy_price THEN 'over query price cap'
 WHEN landed > 100000 THEN 'over global price cap'
 WHEN listing_type <> 'fixed' AND hours_remaining > 168
 THEN 'auction too far away'
 WHEN listing_type <> 'auction' AND age_hours / 24e0 >= 7
 AND age_hours / 24e0 < 60 THEN 'fixed price aged' END AS reason
 FROM judged)"""


@query("relevance", "F1 F2 F3 F4", f"""{RELEVANT}
SELECT row_id, reason FROM reasoned""")
def relevance_query(spark, sf_dir):
    return relevance.with_relevance(prepared(spark, sf_dir)).select(
        "row_id", "reason")


@query("relevance_counts", "A14", f"""{RELEVANT}
SELECT query, coalesce(reason, 'kept') AS reason, count(*) AS listings
FROM reasoned GROUP BY 1, 2""")
def relevance_counts(spark, sf_dir):
    return relevance.with_relevance(prepared(spark, sf_dir)).groupBy(
        "query", F.coalesce("reason", F.lit("kept")).alias("reason")
    ).agg(F.count("*").alias("listings"))


# ------------------------------------------------------------------ economics
INVERSE_SQL = """(CASE WHEN ({x} - fixed_c) / (1e0 + var_r + buyer_fee_rate
 * ins_m) * buyer_fee_rate >= minimum_buyer_fee
 THEN greatest(0e0, ({x} - fixed_c) / (1e0 + var_r + buyer_fee_rate * ins_m))
 ELSE greatest(0e0, (({x} - fixed_c) - minimum_buyer_fee * ins_m)
 / (1e0 + var_r)) END)"""
COSTS = f"""{PREPARED}, costs AS (SELECT *,
 (shipping + buyer_fees + international_shipping) AS fixed_c,
 (insurance_rate + import_duty_rate + fx_spread_rate) AS var_r,
 CASE WHEN insurance_on_buyer_fee THEN 1e0 + insurance_rate ELSE 1e0 END
 AS ins_m, greatest(current_price * buyer_fee_rate, minimum_buyer_fee) AS fee,
 CASE WHEN marketplace IN ('YAHOO_JP', 'PAYPAY_JP') THEN 0e0 ELSE 8e-2 END
 AS tax FROM prepared)"""


@query("landed_costs", "V1 V2 V3 V4", f"""{COSTS}
SELECT row_id, fee AS buyer_fee, landed AS landed_cost, tax AS tax_rate,
 landed * (1e0 + tax) AS total_cost,
 abs({INVERSE_SQL.format(x='landed')} - current_price) < 1e-6
 AS inverse_holds,
 {INVERSE_SQL.format(x='(5e2 / (1e0 + tax))')} AS price_at_500
FROM costs""")
def landed_costs(spark, sf_dir):
    landed = economics.landed_cost("current_price")
    tax = economics.tax_rate(F.lit(False))
    return prepared(spark, sf_dir).select(
        "row_id", economics.buyer_fee(F.col("current_price")
                                      ).alias("buyer_fee"),
        landed.alias("landed_cost"), tax.alias("tax_rate"),
        economics.total_cost("current_price", tax).alias("total_cost"),
        (F.abs(economics.price_for_landed_cost(landed)
               - F.col("current_price")) < 1e-6).alias("inverse_holds"),
        economics.price_for_total_cost(F.lit(500.0), tax
                                       ).alias("price_at_500"))


GRADED_SQL = ("regexp_matches(title, '(?i)\\b(?:PSA|BGS|CGC|SGC|BVG|WATA|"
              "VGA)\\b')")
VAULT_SQL = """(site = 'ebay' AND object_class = 'card' AND category IN
 ('Pokemon Cards', 'Sports Cards') AND lower(regexp_extract(title,
 '(?i)\\b(PSA|BGS|CGC|SGC|BVG)\\b', 1)) IN
 ('psa', 'bgs', 'cgc', 'sgc', 'bvg'))"""


def exit_cols(v: str, p: str) -> str:
    """net of every route, as columns with a prefix."""
    rate = f"CASE WHEN {v} <= 1e4 THEN 83e-3 ELSE 6e-2 END"
    return f"""greatest(0e0, {v} * (1e0 - 1325e-4) - 0e0) AS {p}ebay,
 greatest(0e0, {v} * (1e0 - ({rate})) - 0e0) AS {p}goldin,
 {rate} AS {p}goldin_rate,
 greatest(0e0, {v} * (1e0 - 2e-1) - 5e0) AS {p}heritage,
 greatest(0e0, {v} * (1e0 - 7e-2) - 0e0) AS {p}vault,
 ({v} >= 100 AND lower(category) = 'sports cards' AND {GRADED_SQL}) AS {p}g_ok,
 ({v} >= 5000) AS {p}h_ok"""


def exit_channel(p: str, vault: str) -> str:
    return f"""CASE WHEN resale_channel = 'heritage' THEN 'heritage'
 WHEN {vault} THEN 'psa_vault'
 WHEN {p}h_ok AND {p}heritage > {p}ebay AND (NOT {p}g_ok OR
 {p}heritage > {p}goldin) THEN 'heritage'
 WHEN {p}g_ok AND {p}goldin > {p}ebay THEN 'goldin' ELSE 'ebay' END"""


def by_channel(c: str, p: str, what: str = "net") -> str:
    if what == "net":
        return (f"CASE {c} WHEN 'heritage' THEN {p}heritage WHEN 'psa_vault' "
                f"THEN {p}vault WHEN 'goldin' THEN {p}goldin ELSE {p}ebay END")
    return (f"CASE {c} WHEN 'heritage' THEN 2e-1 WHEN 'psa_vault' THEN 7e-2 "
            f"WHEN 'goldin' THEN {p}goldin_rate ELSE 1325e-4 END")


# Fair value used by the economics queries: the item's own list price.
ECON = f"""{COSTS}, et AS (SELECT DISTINCT title FROM costs),
 {duck.identity('et', 'title', 'ei')}, econ AS (SELECT c.*, ei.object_class,
 c.current_price * 15e-1 AS fair,
 {duck.category('c.query', 'ei.object_class')} AS category
 FROM costs c JOIN ei ON c.title = ei.title), routes AS (SELECT *,
 {VAULT_SQL} AS vault_asset, {exit_cols('fair', 'n_')} FROM econ)"""


def economic_rows(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    parsed = identity.parse_distinct(rows, "title", "ident",
                                     ("object_class",))
    # a query's category is found once per query, not once per row
    known = queries(spark, sf_dir).select(
        "query", text.category("query").alias("_base"))
    rows = rows.join(parsed, "title").join(known, "query").withColumn(
        "object_class", F.col("ident.object_class")).drop("ident")
    return rows.withColumns({
        "category": text.of_object("_base", "object_class"),
        "fair": F.col("current_price") * 1.5}).drop("_base")


@query("exit_routes", "V5 V6 V7 V8", f"""{ECON},
 picked AS (SELECT *, {exit_channel('n_', 'fair >= 500 AND vault_asset')}
 AS channel FROM routes)
SELECT row_id, category, vault_asset, channel,
 {by_channel('channel', 'n_')} AS net, {by_channel('channel', 'n_', 'rate')}
 AS fee_rate, {by_channel('channel', 'n_')} - n_ebay AS advantage
FROM picked""")
def exit_routes(spark, sf_dir):
    rows = economic_rows(spark, sf_dir).withColumn(
        "vault_asset", economics.vault_eligible(
            "site", "category", "title", "object_class"))
    best = economics.best_exit(
        F.col("fair"), "resale_channel", "category", "title",
        F.col("fair") >= S.vault.min_price, F.col("vault_asset"))
    return rows.select("row_id", "category", "vault_asset", best.alias("e")
                       ).select("row_id", "category", "vault_asset",
                                "e.channel", "e.net", "e.fee_rate",
                                "e.advantage")


def level_sql(divisor: str) -> str:
    plain = INVERSE_SQL.format(x=f"(nn / {divisor} / (1e0 + tax))")
    vaulted = INVERSE_SQL.format(x=f"(vn / {divisor} / 1e0)")
    cap = INVERSE_SQL.format(x="5e2")
    back = landed_of(vaulted)
    return f"""CASE WHEN NOT vault_asset THEN CASE WHEN {plain} > 0
 THEN CAST(floor({plain}) AS BIGINT) END ELSE CAST(floor(greatest(
 CASE WHEN {cap} > 0 AND least({plain}, {cap} - 1e-9) > 0
 THEN least({plain}, {cap} - 1e-9) END,
 CASE WHEN {back} >= 5e2 AND {vaulted} > 0 THEN {vaulted} END)) AS BIGINT)
 END"""


def landed_of(x: str) -> str:
    fee = f"greatest(greatest(0e0, {x}) * buyer_fee_rate, minimum_buyer_fee)"
    return (f"(greatest(0e0, {x}) * (1e0 + var_r) + fixed_c + {fee} + {fee} "
            "* (ins_m - 1e0))")


@query("bid_levels", "V17", f"""{ECON}, nets AS (SELECT *,
 {by_channel(exit_channel('n_', 'false'), 'n_')} AS nn,
 {by_channel(exit_channel('n_', 'vault_asset'), 'n_')} AS vn FROM routes)
SELECT row_id, {level_sql('115e-2')} AS max_bid, {level_sql('1e0')}
 AS breakeven FROM nets""")
def bid_levels(spark, sf_dir):
    rows = economic_rows(spark, sf_dir)
    return economics.with_bid_levels(rows, "fair").select(
        "row_id", "max_bid", "breakeven")


def price_sql(grade: str, grader: str, printed: str, p: str = "") -> str:
    rungs = [("5e0", "loose_price")] + [
        (f"{at_}e0" if at_ != 9.5 else "95e-1", name)
        for at_, name in ((7, "cib_price"), (8, "new_price"),
                          (9, "graded_price"), (9.5, "box_only_price"),
                          (10, "manual_only_price"))]
    pts = ("list_filter([" + ", ".join(
        f"{{'at': {a}, 'c': CAST(nullif({p}{n}, 0) AS DOUBLE)}}"
        for a, n in rungs) + "], lambda x: x.c IS NOT NULL)")
    lo = (f"list_filter({pts}, lambda x: x.at <= {grade})[-1]")
    hi = (f"list_filter({pts}, lambda x: x.at > {grade})[1]")
    raw = f"CAST(nullif({p}loose_price, 0) AS DOUBLE)"
    curve = duck.case([
        (f"({lo}).at IS NULL", raw),
        (f"({lo}).at = {grade} OR ({hi}).at IS NULL", f"({lo}).c")],
        f"({lo}).c + (({hi}).c - ({lo}).c) * (({grade} - ({lo}).at) / "
        f"(({hi}).at - ({lo}).at))")
    tops = [(f"{grader} = '{g}' AND {printed} >= 10 AND nullif({p}{n}, 0) "
             "IS NOT NULL", f"CAST({p}{n} AS DOUBLE)") for g, n in (
        ("cgc", "condition_17_price"), ("sgc", "condition_18_price"),
        ("bgs", "bgs_10_price"))]
    return duck.case(tops + [(f"{grade} IS NULL", raw)], curve)


SLABS = """slabs AS (SELECT * FROM (VALUES (CAST(NULL AS VARCHAR),
 CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('psa', 3e0, 3e0),
 ('psa', 5e0, 5e0), ('psa', 6e0, 6e0), ('psa', 75e-1, 75e-1),
 ('psa', 85e-1, 85e-1), ('psa', 9e0, 9e0), ('psa', 92e-1, 92e-1),
 ('psa', 1e1, 1e1), ('cgc', 9e0, 1e1), ('bgs', 85e-1, 95e-1),
 ('bgs', 9e0, 1e1), ('sgc', 9e0, 1e1)) AS v(grader, grade, printed))"""


@query("guide_prices", "V9", f"""{ctes('catalogue')}, {SLABS}
SELECT product_id, grader, grade, printed, {price_sql('grade', 'grader',
'printed')} AS cents FROM catalogue, slabs""")
def guide_prices(spark, sf_dir):
    """Price ladder of every product: a fixed list of slabs per row."""
    slab = "STRUCT<grader: STRING, grade: DOUBLE, printed: DOUBLE>"
    rows = [(None, None, None), ("psa", 3.0, 3.0), ("psa", 5.0, 5.0),
            ("psa", 6.0, 6.0), ("psa", 7.5, 7.5), ("psa", 8.5, 8.5),
            ("psa", 9.0, 9.0), ("psa", 9.2, 9.2), ("psa", 10.0, 10.0),
            ("cgc", 9.0, 10.0), ("bgs", 8.5, 9.5), ("bgs", 9.0, 10.0),
            ("sgc", 9.0, 10.0)]
    slabs = F.array(*[F.struct(*[F.lit(v) for v in r]).cast(slab)
                      for r in rows])
    ladder = view(spark, sf_dir, "catalogue").select(
        "*", F.explode(slabs).alias("s"))
    return ladder.select(
        "product_id", "s.grader", "s.grade", "s.printed",
        guide_price.price_cents(F.col("s.grade"), F.col("s.grader"),
                                F.col("s.printed")).alias("cents"))


@query("guide_monotone", "Q4", f"""{ctes('catalogue')}, {SLABS},
 g AS (SELECT product_id, grade, {price_sql('grade', "'none'", 'grade')} AS c
 FROM catalogue, slabs WHERE grader = 'psa'), w AS (SELECT *, lag(c) OVER (
 PARTITION BY product_id ORDER BY grade) AS before FROM g)
SELECT product_id, grade, before, c AS cents FROM w WHERE c < before""")
def guide_monotone(spark, sf_dir):
    """Products whose price falls as the grade rises (expected: none)."""
    grades_ = [3.0, 5.0, 6.0, 7.5, 8.5, 9.0, 9.2, 10.0]
    at = {f"at{i}": guide_price.price_cents(F.lit(g))
          for i, g in enumerate(grades_)}
    steps = F.array(*[F.struct(
        F.lit(g).alias("grade"), F.col(f"at{i - 1}").alias("before"),
        F.col(f"at{i}").alias("cents"))
        for i, g in enumerate(grades_) if i])
    rows = stage(view(spark, sf_dir, "catalogue"), **at).select(
        "product_id", F.explode(steps).alias("p"))
    return rows.select("product_id", "p.grade", "p.before", "p.cents"
                       ).filter(F.col("cents") < F.col("before"))
