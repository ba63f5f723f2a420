"""Queries over gates and decision views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT, replace
from ..operators import gates, report
from ..sources.adapters import at, ctes, view
from . import duck
from .comp_queries import now
from .registry import query


def valued(spark, sf_dir):
    rows = view(spark, sf_dir, "valued").withColumns({
        "end_time": at("end_s"), "created_at": at("created_s")})
    note = F.struct(F.col("note_code").alias("code"),
                    F.col("note_code").alias("text"))
    return rows.withColumn("notes", F.when(
        F.col("note_code").isNotNull(), F.array(note)).otherwise(
        F.array().cast("array<struct<code:string,text:string>>"))
    ).drop("note_code")


BLOCK = duck.case([(f"{{n}} = '{c}'", f"'{r}'") for c, r in gates.BLOCKERS])


def trade_sql(note: str = "note_code", below: str = "false") -> str:
    block = duck.case(
        [(f"{note} = '{c}'", f"'{r}'") for c, r in gates.BLOCKERS[:3]]
        + [(below, "'below decision value floor'")]
        + [(f"{note} = '{c}'", f"'{r}'") for c, r in gates.BLOCKERS[4:]])
    return duck.case([("discovery", "'discovery query'"),
                      ("fair_value <= 0", "'no fair value'"),
                      ("disputed", "'disputed valuation'")], block)


ERA = f"""(category = 'Pokemon Cards' AND NOT {duck.contains_any(
    'lower(query)', DEFAULT.era_exempt_queries)} AND NOT {duck.contains_any(
    'lower(title)', DEFAULT.accepted_eras)})"""
GI = "list_filter({}, lambda x: x.grade IS NOT NULL)[1]".format(
    duck.grade_tokens("lower(title)"))
COLLECTION = duck.case([
    ("wanted IS NOT NULL", "NULL"), (ERA, "'era outside the collection'"),
    (f"category = 'Video Games' AND NOT {duck.contains_any('lower(title)', ('sealed', 'new in box', 'nib', 'shrink wrap', 'shrinkwrap'))} AND gi IS NULL",
     "'game neither sealed nor graded'")])
OUTPUT = duck.case([
    ("wanted IS NOT NULL", "NULL"),
    (f"{duck.effective('gi.grader', 'gi.grade')} <= 3 AND category = "
     "'Pokemon Cards'", "'grade at or below floor'"),
    ("expected_value < 0", "'expected value too low'"),
    ("roi < 0", "'negative ROI'"),
    ("listing_type = 'auction' AND bid_count < 1 AND NOT (has_buy_now AND "
     "buy_now_price > 0) AND NOT coalesce(hours_remaining <= 24, false) AND "
     "site <> 'yahoo_jp'", "'zero-bid auction far from close'")])
GATED = f"""{ctes('valued')}, g AS (SELECT *, {GI} AS gi FROM valued),
 gated AS (SELECT *, {COLLECTION} AS collection, {OUTPUT} AS output,
 {trade_sql()} AS trade FROM g)"""


@query("decision_gates", "F5 F6 F7 F8 F9 Q3", f"""{GATED}
SELECT row_id, collection, output, trade, CASE WHEN discovery THEN
 'discovery query' WHEN collection IS NOT NULL THEN
 'outside collection standards' WHEN fair_value <= 0 THEN 'no fair value'
 WHEN fair_value < 50 THEN 'fair value below trust floor' WHEN n_comps < 3 THEN
 'too few matched comps' WHEN regraded THEN 'listing-specific regrade'
 WHEN disputed THEN 'disputed valuation' ELSE {BLOCK.format(n='note_code')} END
 AS evidence FROM gated""")
def decision_gates(spark, sf_dir):
    return valued(spark, sf_dir).select(
        "row_id", gates.collection().alias("collection"),
        gates.output().alias("output"), gates.tradeability().alias("trade"),
        gates.evidence().alias("evidence"))


FLOOR = ("greatest(coalesce(value_floor_override, CASE WHEN category = "
         "'Video Games' THEN {g} ELSE {d} END), 1e-2)")
CLASSED = f"""{GATED}, st AS (SELECT *, CASE
 WHEN fair_value < {FLOOR.format(g='25e1', d='5e2')} THEN 'Fair-value floor'
 WHEN roi > 1e1 THEN 'ROI sanity ceiling' WHEN collection IS NOT NULL THEN
 'Collection standards' WHEN output IS NOT NULL THEN 'Output economics' END
 AS st0, CASE WHEN fair_value < {FLOOR.format(g='25e1', d='5e2')} THEN
 'below floor' WHEN roi > 1e1 THEN 'ROI above ceiling' WHEN collection IS NOT
 NULL THEN collection WHEN output IS NOT NULL THEN output END AS rs0,
 fair_value < {FLOOR.format(g='25e1', d='9e2')} AS low FROM gated),
 cp AS (SELECT *, row_number() OVER (PARTITION BY st0 IS NULL AND wanted IS
 NULL ORDER BY opportunity_score DESC, row_id) AS place FROM st),
 classed AS (SELECT * EXCLUDE (trade), CASE WHEN over THEN 'Report row cap'
 ELSE st0 END AS stage, CASE WHEN over THEN 'below row cap' ELSE rs0 END AS
 reason, {trade_sql(below='(st0 IS NULL AND low)')} AS trade FROM (SELECT *,
 st0 IS NULL AND wanted IS NULL AND place > 1000 - (SELECT count(*) FROM st
 WHERE st0 IS NULL AND wanted IS NOT NULL) AS over FROM cp))"""
# A decision floor above the browse floor, so that the marker is used, and a
# stated report size.
STRICT = replace(DEFAULT, decision_floor=900.0, max_rows=1000)


def classified(spark, sf_dir):
    return gates.classify(valued(spark, sf_dir), STRICT)


@query("row_classes", "U3 F14 F15 W10", f"""{CLASSED}
SELECT row_id, stage, reason, trade FROM classed""")
def row_classes(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "row_id", "stage", "reason", gates.tradeability().alias("trade"))


RESEARCH = f"""{CLASSED}, research AS (SELECT row_id, query, category, stage,
 reason FROM classed WHERE stage IS NOT NULL UNION ALL SELECT row_id, query,
 category, 'Decision-only quarantine', trade FROM classed WHERE stage IS NULL
 AND trade IS NOT NULL)"""


@query("filter_waterfall", "A12 Q2", f"""{RESEARCH}, sg AS (SELECT * FROM (
 VALUES (0, 'Fair-value floor'), (1, 'ROI sanity ceiling'),
 (2, 'Collection standards'), (3, 'Output economics'), (4, 'Report row cap'),
 (5, 'Decision-only quarantine')) AS t(ord, stage)), rc AS (SELECT stage,
 reason, count(*) AS n FROM research GROUP BY 1, 2), ag AS (SELECT stage,
 CAST(sum(n) AS BIGINT) AS removed, string_agg(reason || ' x' || n, '; '
 ORDER BY n DESC, reason) AS detail FROM rc GROUP BY 1), w AS (SELECT
 sg.stage, coalesce(removed, 0) AS removed, coalesce(detail, 'none') AS detail,
 CAST(coalesce(sum(coalesce(removed, 0)) OVER (ORDER BY ord ROWS BETWEEN
 UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
 (SELECT count(*) FROM valued) AS total
 FROM sg LEFT JOIN ag ON ag.stage = sg.stage)
SELECT stage, total - before AS starting, removed, total - before - removed AS
 remaining, detail FROM w""")
def filter_waterfall(spark, sf_dir):
    return gates.waterfall(classified(spark, sf_dir))


@query("value_collisions", "A11", f"""{ctes('valued')}, r AS (SELECT *,
 CAST(floor(fair_value / 25) AS BIGINT) * 25e0 AS fair FROM valued
 WHERE floor(fair_value / 25) > 0), s AS (SELECT fair, string_agg(
 title, '; ' ORDER BY row_id) AS titles FROM (SELECT *,
 row_number() OVER (PARTITION BY fair ORDER BY row_id) AS n FROM r)
 WHERE n <= 3 GROUP BY fair)
SELECT fair, count(DISTINCT identity_key) AS assets, count(*) AS listings,
 titles FROM r JOIN s USING (fair) GROUP BY fair, titles
 HAVING count(DISTINCT identity_key) >= 3""")
def value_collisions(spark, sf_dir):
    """Values rounded to 25 dollars here, so that collisions exist."""
    rows = valued(spark, sf_dir).withColumn(
        "fair_value", F.floor(F.col("fair_value") / 25) * 25.0)
    return gates.collisions(rows)


@query("research_view", "K8", f"""{RESEARCH}
SELECT r.row_id, r.stage, r.reason, CASE WHEN v.listing_type = 'fixed' AND
 v.best_offer THEN 'BIN+OBO' WHEN v.listing_type = 'fixed' THEN 'BIN' ELSE
 'AUCTION' END AS kind, v.title, v.n_comps FROM research r JOIN valued v USING
 (row_id)""")
def research_view(spark, sf_dir):
    """Why each row is not in the report, or not to be acted on."""
    return report.research_view(gates.research(classified(
        spark, sf_dir))).select("row_id", "stage", "reason", "kind", "title",
                                "n_comps")


@query("sports_coverage", "A13", f"""{RESEARCH}, sp AS (SELECT * FROM classed
 WHERE category IN ('Sports Cards', 'Sports Memorabilia')), fu AS (SELECT
 query, count(*) AS valued, count(CASE WHEN match IN ('exact', 'strong') AND
 guide_value > 0 THEN 1 END) AS guide_resolved, count(CASE WHEN n_comps >= 3
 AND coalesce(note_code, '') <> 'MIXED POOL' THEN 1 END) AS exact_comps,
 count(CASE WHEN promoted_from_discovery THEN 1 END) AS promoted,
 count(CASE WHEN note_code = 'ASK-BASED' THEN 1 END) AS ask_based,
 count(CASE WHEN stage IS NULL THEN 1 END) AS browse, count(CASE WHEN stage IS
 NULL AND trade IS NULL AND expected_value > 0 THEN 1 END) AS action
 FROM sp GROUP BY query), rw AS (SELECT query, count(*) AS raw, count(*) AS
 relevant FROM valued GROUP BY query), rj AS (SELECT query, reason, count(*)
 AS n FROM research WHERE category IN ('Sports Cards', 'Sports Memorabilia')
 GROUP BY 1, 2), tp AS (SELECT query, arg_min(reason || ' x' || n, (-n,
 reason)) AS top_rejection FROM rj GROUP BY query)
SELECT fu.*, raw, relevant, top_rejection FROM fu LEFT JOIN rw USING (query)
 LEFT JOIN tp USING (query)""")
def sports_coverage(spark, sf_dir):
    rows = classified(spark, sf_dir)
    raw = rows.groupBy("query").agg(F.count("*").alias("raw")).withColumn(
        "relevant", F.col("raw"))
    return gates.coverage(rows, raw)


INTEREST = "expected_value * greatest(confidence, 1e-1)"
UNRES = "coalesce(note_code IN ('IDENTITY UNRESOLVED', 'MIXED POOL', 'ASK-BASED'), false)"


@query("interest_tiers", "F13 W11", f"""{ctes('valued')}
SELECT row_id, {INTEREST} AS interest, CASE WHEN {UNRES} THEN 'browse'
 WHEN {INTEREST} >= 100 THEN 'high' WHEN {INTEREST} >= 25 THEN 'medium'
 ELSE 'low' END AS tier FROM valued""")
def interest_tiers(spark, sf_dir):
    return valued(spark, sf_dir).orderBy(*report.by_interest()).select(
        "row_id", report.interest().alias("interest"),
        report.interest_tier().alias("tier"))


@query("unresolved_cap", "W8", f"""{ctes('valued')}, r AS (SELECT *,
 CAST(floor(fair_value / 1e2) * 1e2 AS DOUBLE) AS fv FROM valued)
SELECT row_id FROM (SELECT row_id, {UNRES} AS u, row_number() OVER (PARTITION
 BY query, fv, {UNRES} ORDER BY {INTEREST} DESC, row_id) AS n FROM r)
 WHERE NOT u OR n <= 3""")
def unresolved_cap(spark, sf_dir):
    rows = valued(spark, sf_dir).withColumn(
        "fair_value", F.floor(F.col("fair_value") / 100.0) * 100.0)
    return report.cap_unresolved(rows).select("row_id")


@query("book_views", "K8 W8", f"""{ctes('valued')}, pg AS (SELECT *, unnest(
 list_filter([CASE WHEN set_need THEN 'Set needs' END, CASE WHEN wanted IS NULL
 AND NOT discovery THEN category END, CASE WHEN wanted IS NULL AND discovery
 THEN 'Discovery' END], lambda x: x IS NOT NULL)) AS view FROM valued), r AS
 (SELECT *, {UNRES} AS u, {INTEREST} AS interest FROM pg)
SELECT view, row_id, u AS open_last, interest FROM (SELECT *, row_number() OVER
 (PARTITION BY view, query, round(fair_value, 2), u ORDER BY interest DESC,
 row_id) AS n FROM r) WHERE NOT u OR n <= 3 OR view = 'Set needs'""")
def book_views(spark, sf_dir):
    """Set needs, one page per category, discovery."""
    return report.book_views(valued(spark, sf_dir)).select(
        "view", "row_id", "open_last", "interest")


@query("collapsed_assets", "W9", f"""{ctes('valued')}, g AS (SELECT *, {GI} AS
 gi, current_price + shipping AS cost FROM valued), k AS (SELECT *, coalesce(
 CAST({duck.effective('gi.grader', 'gi.grade')} AS VARCHAR), 'raw') AS gr
 FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY query, listing_type,
 gr, identity_key ORDER BY expected_value DESC, cost, row_id) AS n, count(*)
 OVER (PARTITION BY query, listing_type, gr, identity_key) AS c FROM k)
SELECT max(CASE WHEN n = 1 THEN row_id END) AS row_id, max(c) - 1 AS others,
 min(CASE WHEN n > 1 THEN cost END) AS others_from FROM r
 GROUP BY query, listing_type, gr, identity_key""")
def collapsed_assets(spark, sf_dir):
    return report.collapse(valued(spark, sf_dir)).select(
        "row_id", "others", "others_from")


def similar_sql() -> str:
    """Clusters by all pairs of a block and their transitive closure."""
    from .comp_queries import score_sql
    clash = " OR ".join(f"coalesce(a.{f} <> b.{f}, false)" for f in (
        "holo", "edition", "series", "completeness"))
    return f"""{ctes('valued').replace('WITH ', 'WITH RECURSIVE ', 1)}, g AS
 (SELECT *, {GI} AS gi, current_price + shipping AS cost FROM valued), k AS
 MATERIALIZED (SELECT *, concat_ws('~', query, listing_type, coalesce(CAST(
 {duck.effective('gi.grader', 'gi.grade')} AS VARCHAR), 'raw')) AS block
 FROM g), vt AS (SELECT DISTINCT title FROM k),
 {duck.identity('vt', 'title', 'i')}, bt AS MATERIALIZED (SELECT DISTINCT
 k.block, i.* FROM k JOIN i USING (title)), ln AS MATERIALIZED (SELECT a.block,
 a.title AS x, b.title AS y FROM bt a JOIN bt b ON a.block = b.block AND
 a.title <> b.title WHERE (len(a.subject_all) = 0 OR len(b.subject_all) = 0 OR
 list_has_any(a.subject_all, b.subject_all)) AND NOT ({clash}) AND
 {score_sql('a', 'b')} >= 6e-1), un AS MATERIALIZED (SELECT block, x, y FROM ln
 UNION SELECT block, y, x FROM ln), cl AS (SELECT block, title AS x, title AS y
 FROM bt UNION SELECT cl.block, cl.x, un.y FROM cl JOIN un ON un.block =
 cl.block AND un.x = cl.y), id AS (SELECT block, x, min(y) AS cluster FROM cl
 GROUP BY 1, 2), r AS (SELECT k.*, id.cluster, row_number() OVER w AS n,
 count(*) OVER (PARTITION BY k.block, id.cluster) AS c FROM k JOIN id ON
 id.block = k.block AND id.x = k.title WINDOW w AS (PARTITION BY k.block,
 id.cluster ORDER BY expected_value DESC, cost, row_id))
SELECT max(CASE WHEN n = 1 THEN row_id END) AS row_id, max(c) - 1 AS others,
 min(CASE WHEN n > 1 THEN cost END) AS others_from FROM r
 GROUP BY block, cluster"""


@query("similar_listings", "W9", similar_sql())
def similar_listings(spark, sf_dir):
    """One row per card across sellers who name it differently."""
    return report.collapse_similar(valued(spark, sf_dir)).select(
        "row_id", "others", "others_from")


TRADE = f"{ctes('valued')}, v AS (SELECT *, {trade_sql()} AS trade FROM valued)"


@query("today_view", "K1 R6", f"""{TRADE}
SELECT row_id, 1 AS section, hours_remaining AS sort_key FROM v WHERE trade IS
 NULL AND confidence >= 0.25 AND listing_type = 'auction' AND hours_remaining >
 0 AND hours_remaining <= 24 AND expected_value >= 75 UNION ALL
SELECT row_id, 2, -opportunity_score FROM v WHERE trade IS NULL AND confidence
 >= 0.25 AND listing_type <> 'auction' AND age_hours <= 24 AND edge_now >= 75
""")
def today_view(spark, sf_dir):
    return report.today(valued(spark, sf_dir)).select(
        "row_id", "section", "sort_key")


@query("action_view", "K2", f"""{TRADE}, p AS (SELECT *, row_number() OVER (
 ORDER BY {UNRES}, {INTEREST} DESC, row_id) AS n FROM v WHERE NOT discovery
 AND wanted IS NULL AND category <> 'Watches' AND trade IS NULL)
SELECT row_id FROM p WHERE expected_value > 0 OR n <= 50 OR (edge_now > 0 AND
 (coalesce(hours_remaining <= 6, false) OR (listing_type = 'fixed' AND
 coalesce(age_hours <= 6, false))))""")
def action_view(spark, sf_dir):
    return report.action(valued(spark, sf_dir)).select("row_id")


@query("wanted_view", "W12", f"""{ctes('valued')}
SELECT wanted, wanted_score, row_id, place FROM (SELECT *, row_number() OVER (
 PARTITION BY wanted ORDER BY current_price + shipping, row_id) AS place
 FROM valued WHERE wanted IS NOT NULL) WHERE place <= 5""")
def wanted_view(spark, sf_dir):
    return report.wanted_view(valued(spark, sf_dir)).select(
        "wanted", "wanted_score", "row_id", "place")


FEE = """CASE WHEN fair_value <= 500 THEN 25e0 WHEN fair_value <= 1500 THEN
 75e0 WHEN fair_value <= 2500 THEN 15e1 ELSE 3e2 END"""


@query("crossover_view", "V18", f"""{TRADE}, g AS (SELECT *, {GI} AS gi, {FEE}
 AS fee FROM v)
SELECT row_id, fee, edge_now - fee AS profit, (edge_now - fee) /
 (current_price + shipping) AS regrade_roi FROM g WHERE trade IS NULL AND
 gi.grader IN ('cgc', 'bgs', 'sgc', 'bvg') AND category IN ('Pokemon Cards',
 'Sports Cards') AND edge_now - fee >= 100""")
def crossover_view(spark, sf_dir):
    return report.crossover(valued(spark, sf_dir)).select(
        "row_id", "fee", "profit", "regrade_roi")


@query("digest_view", "K3", f"""{TRADE}
(SELECT row_id, 'profit' AS section FROM v WHERE trade IS NULL AND
 expected_value > 0 ORDER BY opportunity_score DESC, row_id LIMIT 25)
UNION ALL (SELECT row_id, 'wanted' FROM v WHERE trade IS NULL AND wanted IS NOT
 NULL AND listing_type = 'auction' AND (hours_remaining IS NULL OR
 hours_remaining > 0) ORDER BY wanted_score DESC, coalesce(hours_remaining,
 1e9), row_id LIMIT 25)""")
def digest_view(spark, sf_dir):
    return report.digest(valued(spark, sf_dir)).select("row_id", "section")


@query("alert_candidates", "K4 J13 R5", f"""{TRADE}, hot AS (SELECT *, 2 AS w
 FROM v WHERE trade IS NULL AND edge_now >= 150 AND roi BETWEEN 0.15 AND 10 AND
 confidence >= 0.15 AND priority AND (listing_type <> 'fixed' OR capture >=
 0.5) UNION ALL SELECT * FROM (SELECT *, 1 FROM v WHERE trade IS NULL AND
 wanted IS NOT NULL AND coalesce(CASE WHEN listing_type = 'fixed' THEN age_hours
 <= 24 ELSE hours_remaining <= 24 END, false) ORDER BY wanted_score DESC,
 current_price + shipping, row_id LIMIT 5)), one AS (SELECT row_id,
 min(w) AS w FROM hot GROUP BY row_id)
SELECT v.row_id, CASE WHEN w = 1 THEN 'wanted' ELSE 'edge' END AS why,
 coalesce(nullif(listing_id, ''), url) AS item_key FROM one JOIN v USING
 (row_id) WHERE NOT (listing_type = 'fixed' AND expected_value < 0) AND NOT
 EXISTS (SELECT 1 FROM v o WHERE o.bid_count = 3 AND coalesce(nullif(
 o.listing_id, ''), o.url) = coalesce(nullif(v.listing_id, ''), v.url))""")
def alert_candidates(spark, sf_dir):
    """Items with three bids stand for those alerted before."""
    rows = valued(spark, sf_dir)
    before = rows.filter(F.col("bid_count") == 3).select(
        report.alert_key().alias("item_key"))
    return report.alerts(rows, before).select("row_id", "why", "item_key")


@query("movers_view", "A24", f"""{ctes('valued')}, f AS (SELECT query,
 arg_min(trend_30d, row_id) AS trend_30d, arg_min(fair_value, row_id) AS
 fair_value FROM valued WHERE NOT discovery AND wanted IS NULL GROUP BY query)
SELECT query, trend_30d, fair_value FROM f ORDER BY abs(trend_30d) DESC, query
 LIMIT 30""")
def movers_view(spark, sf_dir):
    return report.movers(valued(spark, sf_dir)).select(
        "query", "trend_30d", "fair_value")


@query("main_view", "K8 V22")
def main_view(spark, sf_dir):
    return report.main_view(valued(spark, sf_dir), now())
