"""Queries over portfolio, ledger, basket, history and learning."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..config import DEFAULT
from ..operators import (basket, close_model, gates, history, learning, ledger,
                         rank)
from ..sources.adapters import AS_OF, EVENTS_AS_OF, at, ctes, view
from ..streaming import timers
from . import duck
from .comp_queries import now
from .listing_queries import KEY_SQL, price_sql
from .registry import query
from .report_queries import TRADE, valued


def held(spark, sf_dir):
    return ledger.positions(view(spark, sf_dir, "positions"))


MONEY = "TRY_CAST(regexp_replace(trim({}), '[$,]', '', 'g') AS DOUBLE)"
HELD = f"""{ctes('positions', 'fair_history')}, held AS (SELECT *,
 {MONEY.format('cost_basis')} AS cost, TRY_CAST(date_bought AS DATE) AS bought,
 TRY_CAST(date_sold AS DATE) AS sold, {MONEY.format('sale_proceeds')} AS
 proceeds FROM positions WHERE {MONEY.format('cost_basis')} > 0),
 fairs AS (SELECT lower(query) AS q, arg_max(fair, seq) AS fair
 FROM fair_history WHERE trusted = 1 GROUP BY 1),
 m0 AS (SELECT h.*, f.fair, {duck.category('query')} AS category FROM held h
 LEFT JOIN fairs f ON f.q = lower(h.query)), m1 AS (SELECT *, CASE WHEN sold IS
 NOT NULL AND proceeds IS NOT NULL THEN 'SOLD' ELSE 'OPEN' END AS state,
 CASE WHEN sold IS NOT NULL AND proceeds IS NOT NULL THEN proceeds WHEN fair >
 0 THEN CASE WHEN resale_channel = 'heritage' THEN greatest(0e0, fair * (1e0 -
 2e-1) - 5e0) ELSE greatest(0e0, fair * (1e0 - 1325e-4) - 0e0) END END AS
 value, greatest(date_diff('day', bought, coalesce(sold, DATE '2002-01-01')),
 1) AS days FROM m0), marked AS (SELECT *, value - cost AS pnl, CASE WHEN value
 > 0 AND value / cost < 100 THEN pow(value / cost, 365e0 / days) - 1 END AS
 cagr FROM m1)"""


@query("portfolio_marks", "V19 J15 S14 A17", f"""{HELD}
SELECT seq, state, cost, value, pnl, days, round(cagr, 6) AS cagr FROM marked
""")
def portfolio_marks(spark, sf_dir):
    fairs = ledger.latest_fair(view(spark, sf_dir, "fair_history"))
    return ledger.mark(held(spark, sf_dir), fairs, now()).select(
        "seq", "state", "cost", "value", "pnl", "days",
        F.round("cagr", 6).alias("cagr"))


@query("portfolio_totals", "A18", f"""{HELD}
SELECT coalesce(CAST(sum(CASE WHEN state = 'OPEN' THEN CAST(cost AS
 DECIMAL(28,6)) END) AS DOUBLE), 0) AS open_cost, coalesce(CAST(sum(CASE WHEN
 state = 'OPEN' THEN CAST(value AS DECIMAL(28,6)) END) AS DOUBLE), 0) AS
 open_value, coalesce(CAST(sum(CASE WHEN state <> 'OPEN' THEN CAST(pnl AS
 DECIMAL(28,6)) END) AS DOUBLE), 0) AS realised, open_value - open_cost AS
 unrealised FROM marked""")
def portfolio_totals(spark, sf_dir):
    fairs = ledger.latest_fair(view(spark, sf_dir, "fair_history"))
    return ledger.totals(ledger.mark(held(spark, sf_dir), fairs, now()))


def trades(spark, sf_dir):
    """Ledger stand-in: sold positions with their costs."""
    return held(spark, sf_dir).select(
        "seq", F.col("cost").alias("actual_purchase_price"),
        (F.col("cost") * 0.05).alias("buyer_fees_paid"),
        F.lit(25.0).alias("shipping_paid"),
        F.lit(None).cast("double").alias("tax_paid"),
        F.col("bought").alias("date_won"), F.col("sold").alias("date_sold"),
        F.col("proceeds").alias("sale_proceeds"))


@query("ledger_derive", "V20", f"""{HELD}, l AS (SELECT seq, cost + cost * 5e-2
 + 25e0 + 0e0 AS landed, proceeds, bought, sold FROM held)
SELECT seq, landed AS actual_landed_cost, proceeds - landed AS realized_profit,
 CASE WHEN landed > 0 THEN (proceeds - landed) / landed END AS realized_roi,
 CASE WHEN sold IS NOT NULL THEN greatest(0, date_diff('day', bought, sold))
 ELSE 0 END AS holding_days FROM l""".replace(
     "ELSE 0 END AS holding_days", "END AS holding_days"))
def ledger_derive(spark, sf_dir):
    out = ledger.derive(trades(spark, sf_dir))
    return out.select(
        "seq", "actual_landed_cost", "realized_profit", "realized_roi",
        F.when(F.col("date_sold").isNotNull(), F.col("holding_days"))
        .alias("holding_days"))


@query("ledger_capture", "K5 V24", f"""{TRADE}
SELECT {KEY_SQL} AS listing_key, site, CAST(current_price AS DECIMAL(18,2)) AS
 current_price, CAST(roi AS DECIMAL(18,6)) AS roi FROM v WHERE trade IS NULL
 AND NOT discovery AND wanted IS NULL AND category <> 'Watches'
 ORDER BY opportunity_score DESC, row_id LIMIT 50""")
def ledger_capture(spark, sf_dir):
    rows = valued(spark, sf_dir)
    picked = ledger.eligible(rows, gates.tradeability().isNull())
    return ledger.opportunity_rows(picked, now()).select(
        "listing_key", "site", "current_price", "roi")


@query("ledger_upsert", "J18", f"""{ctes('valued')}, o AS (SELECT row_id AS
 listing_key, 1 AS first_seen, 1 AS last_seen, current_price * 2 AS
 current_price, 'Watching' AS status, 'mine' AS notes FROM valued WHERE
 bid_count <= 3), n AS (SELECT row_id AS listing_key, 2 AS first_seen, 2 AS
 last_seen, current_price FROM valued WHERE bid_count >= 2)
SELECT coalesce(o.listing_key, n.listing_key) AS listing_key,
 coalesce(o.first_seen, n.first_seen) AS first_seen, CASE WHEN n.listing_key IS
 NOT NULL THEN n.last_seen ELSE o.last_seen END AS last_seen, CASE WHEN
 n.listing_key IS NOT NULL THEN n.current_price ELSE o.current_price END AS
 current_price, coalesce(o.status, 'Discovered') AS status, o.notes AS notes
FROM o FULL JOIN n ON o.listing_key = n.listing_key""")
def ledger_upsert(spark, sf_dir):
    rows = valued(spark, sf_dir)
    old = rows.filter(F.col("bid_count") <= 3).select(
        F.col("row_id").alias("listing_key"), F.lit(1).alias("first_seen"),
        F.lit(1).alias("last_seen"),
        (F.col("current_price") * 2).alias("current_price"),
        F.lit("Watching").alias("status"), F.lit("mine").alias("notes"))
    new = rows.filter(F.col("bid_count") >= 2).select(
        F.col("row_id").alias("listing_key"), F.lit(2).alias("first_seen"),
        F.lit(2).alias("last_seen"), "current_price")
    return ledger.upsert(old, new)


# --------------------------------------------------------------------- basket
LINES = f"""{ctes('catalogue')}, basket AS (SELECT product_id AS line,
 CASE CAST(product_id AS BIGINT) % 6 WHEN 0 THEN product_name WHEN 1 THEN
 concat('1999 1st Edition ', split_part(product_name, ' [', 1)) WHEN 2 THEN
 concat(split_part(product_name, ' #', 1), ' Sticker') WHEN 3 THEN
 concat(split_part(split_part(product_name, ' #', 1), ' [', 1), ' yellow')
 WHEN 4 THEN concat('unlisted ', product_name) ELSE product_name END AS name,
 CASE CAST(product_id AS BIGINT) % 4 WHEN 0 THEN 'PSA 9' WHEN 1 THEN 'CGC 10'
 WHEN 2 THEN 'PSA 8.5' ELSE '' END AS grade, CASE CAST(product_id AS BIGINT)
 % 3 WHEN 0 THEN console_name WHEN 1 THEN substr(console_name, 6) ELSE '' END
 AS "set", CAST(loose_price AS DOUBLE) / 2e2 AS cost FROM catalogue)"""


def holdings(spark, sf_dir):
    k = F.col("product_id").cast("long")
    name = F.col("product_name")
    before = F.split_part(name, F.lit(" ["), F.lit(1))
    bare = F.split_part(name, F.lit(" #"), F.lit(1))
    return view(spark, sf_dir, "catalogue").select(
        F.col("product_id").alias("line"),
        F.when(k % 6 == 1, F.concat(F.lit("1999 1st Edition "), before))
        .when(k % 6 == 2, F.concat(bare, F.lit(" Sticker")))
        .when(k % 6 == 3, F.concat(F.split_part(
            bare, F.lit(" ["), F.lit(1)), F.lit(" yellow")))
        .when(k % 6 == 4, F.concat(F.lit("unlisted "), name))
        .otherwise(name).alias("Card"),
        F.when(k % 4 == 0, "PSA 9").when(k % 4 == 1, "CGC 10")
        .when(k % 4 == 2, "PSA 8.5").otherwise("").alias("Grade"),
        F.when(k % 3 == 0, F.col("console_name")).when(
            k % 3 == 1, F.substring("console_name", 6, 1000)).otherwise("")
        .alias("Set"), (F.col("loose_price") / 200.0).cast("string"
                                                           ).alias("Cost"))


def norm_sql(e: str) -> str:
    return (f"trim(regexp_replace(lower(coalesce({e}, '')), '\\s+', ' ', "
            "'g'))")


def split_sql(name: str) -> tuple[str, str]:
    """CTE-free core and variants of a hand-written name."""
    t = f"lower(trim(regexp_replace({name}, {duck.lit(vocab.YEAR_PREFIX)}, '')))"
    found = []
    for phrase in sorted(vocab.BASKET_VARIANTS, key=len, reverse=True):
        pattern = duck.lit(rf"\[?\b{phrase}\b\]?")
        found.append(f"CASE WHEN regexp_matches({t}, {pattern}) THEN "
                     f"'{phrase}' END")
        t = f"regexp_replace({t}, {pattern}, ' ', 'g')"
    return t, "[" + ", ".join(found) + "]"


def variants_sql(name: str) -> str:
    t = f"lower(array_to_string(regexp_extract_all({name}, '\\[([^\\]]*)\\]', 1), ' | '))"
    found = []
    for phrase in sorted(vocab.BASKET_VARIANTS, key=len, reverse=True):
        found.append(f"CASE WHEN contains({t}, '{phrase}') THEN '{phrase}' "
                     "END")
        t = f"replace({t}, '{phrase}', ' ')"
    return ("list_sort(list_distinct(list_filter([" + ", ".join(found)
            + "], lambda x: x IS NOT NULL)))")


CORE, FOUND = split_sql("name")
ODD = duck.case([(f"contains(a, '{w}') <> contains(b, '{w}')", f"'{w}'")
                 for w in vocab.DISTINGUISHING])
BASKET = f"""{LINES}, b0 AS (SELECT *, {CORE} AS t, {FOUND} AS found,
 {norm_sql('name')} AS n, {norm_sql('"set"')} AS s FROM basket),
 b1 AS (SELECT *, CASE regexp_extract(t, '(\\S+)\\s*$', 1) WHEN 'yellow' THEN ''
  WHEN 'red' THEN 'red cheeks' WHEN '1st' THEN '1st edition' END AS alias
  FROM b0),
 b2 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN
  alias IS NOT NULL THEN regexp_replace(t, '\\S+\\s*$', '') ELSE t END,
  '#\\s*\\d+', ' ', 'g'), '[\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')) AS core,
  list_sort(list_distinct(list_filter(list_concat(found, [nullif(alias, '')]),
  lambda x: x IS NOT NULL))) AS variants FROM b1),
 ix AS (SELECT *, {norm_sql('product_name')} AS p_name,
  {norm_sql('console_name')} AS p_set, {norm_sql("split_part(split_part(product_name, '[', 1), '#', 1)")}
  AS p_core, {variants_sql('product_name')} AS p_variants FROM catalogue),
 mt AS (SELECT line, product_id, p_set, CASE WHEN s <> '' AND s = p_set THEN 1
  WHEN s <> '' AND (contains(p_set, s) OR contains(s, p_set)) THEN 2 ELSE 3 END
  AS rule FROM b2 JOIN ix ON n = p_name UNION ALL SELECT line, product_id,
  p_set, CASE WHEN s <> '' AND (contains(p_set, s) OR contains(s, p_set)) THEN
  4 ELSE 5 END FROM b2 JOIN ix ON core = p_core AND variants = p_variants),
 br AS (SELECT *, min(rule) OVER (PARTITION BY line) AS best FROM mt),
 ch AS (SELECT line, min(product_id) AS product_id, min(rule) AS rule,
  count(DISTINCT p_set) > 1 AS guess FROM br WHERE rule = best GROUP BY line),
 gr AS (SELECT b2.line, name, cost, {norm_sql('name')} AS a, list_filter(
  {duck.grade_tokens("lower(concat_ws(' ', name, grade))")}, lambda x: x.grade
  IS NOT NULL)[1] AS gi FROM b2),
 pc AS (SELECT gr.*, ch.product_id, ch.rule, coalesce(ch.guess, false) AS
  guess, ix.p_name AS b, {price_sql(duck.effective('gi.grader', 'gi.grade'),
  'gi.grader', 'gi.grade', 'ix.')} AS cents FROM gr LEFT JOIN ch ON
  ch.line = gr.line LEFT JOIN ix ON ix.product_id = ch.product_id),
 rf AS (SELECT *, coalesce({ODD}, list_filter({duck.uniq(duck.every(
  "regexp_replace(regexp_replace(b, '\\[[^\\]]*\\]', ' ', 'g'), '#\\S*', ' ', 'g')",
  '[a-z]+'))}, lambda x: NOT list_contains({duck.every('a', '[a-z]+')}, x) AND
  len(x) >= 3 AND x NOT IN ('the', 'and'))[1]) AS refused FROM pc),
 priced AS (SELECT line, cost, product_id, rule, guess, CASE WHEN product_id IS
  NULL THEN 'not found' WHEN refused IS NOT NULL THEN 'refused' WHEN cents IS
  NULL THEN 'no price at grade' ELSE 'priced' END AS outcome, CASE WHEN
  product_id IS NOT NULL AND refused IS NULL THEN round(cents) / 1e2 END AS
  price FROM rf)"""


@query("basket_prices", "J16 J17 V21 T48 T50 W13 S15", f"""{BASKET}
SELECT line, cost, product_id, rule, guess, outcome, price FROM priced""")
def basket_prices(spark, sf_dir):
    return basket.price(basket.read(holdings(spark, sf_dir)),
                        view(spark, sf_dir, "catalogue")).drop("name")


@query("basket_summary", "A19", f"""{BASKET}
SELECT count(*) AS lines, count(price) AS priced, CAST(sum(CAST(price AS
 DECIMAL(28,4))) AS DOUBLE) AS total_value, CAST(sum(CAST(cost AS
 DECIMAL(28,4))) AS DOUBLE) AS total_cost, total_value - total_cost AS pnl
FROM priced""")
def basket_summary(spark, sf_dir):
    return basket.summary(basket.price(basket.read(holdings(spark, sf_dir)),
                                       view(spark, sf_dir, "catalogue")))


@query("catalogue_sets", "A20", f"""{ctes('catalogue')}
SELECT console_name, count(*) AS products FROM catalogue GROUP BY 1
ORDER BY 2 DESC, 1""")
def catalogue_sets(spark, sf_dir):
    return view(spark, sf_dir, "catalogue").groupBy("console_name").agg(
        F.count("*").alias("products")).orderBy(
        F.desc("products"), "console_name")


@query("seed_set", "K6 T49", f"""{ctes('catalogue')}
SELECT product_id, CAST(nullif(regexp_extract(product_name, '#\\s*([0-9]+)', 1),
 '') AS INT) AS number FROM catalogue WHERE contains(lower(console_name),
 'pokemon base set') AND contains(lower(product_name), '1st edition')""")
def seed_set(spark, sf_dir):
    return basket.seed(view(spark, sf_dir, "catalogue"), "Pokemon Base Set",
                       "1st Edition").select("product_id", "number")


# -------------------------------------------------------------------- history
@query("awaiting_close", "J9 J10", f"""{ctes('observations', 'closed')}
SELECT item_id, max(shipping) AS shipping, max(end_s) AS end_s FROM
 observations o WHERE site = 'ebay' AND end_s < 1704240000 AND end_s >
 1704240000 - 864000 AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.item_id =
 o.item_id AND closed_s < 1704153600) GROUP BY item_id""")
def awaiting_close(spark, sf_dir):
    done = view(spark, sf_dir, "closed").filter(
        F.col("closed_s") < 1704153600)
    return history.awaiting(view(spark, sf_dir, "observations"), done,
                            1704240000)


@query("settlements", "R4", f"""{ctes('observations', 'closes')}, e AS (SELECT
 item_id, max(end_s) AS end_s, max(shipping) AS shipping FROM observations
 GROUP BY 1), j AS (SELECT e.*, c.closed_s, c.seq,
 c.actual_price FROM e LEFT JOIN closes c ON c.item_id = e.item_id AND
 c.closed_s BETWEEN e.end_s AND e.end_s + 864000), f AS (SELECT item_id, end_s,
 shipping, arg_min(actual_price, (closed_s, seq)) FILTER (WHERE closed_s IS NOT
 NULL) AS a FROM j GROUP BY ALL)
SELECT item_id, end_s, CASE WHEN a > 0 THEN a + shipping ELSE a END AS
 settled_price FROM f""")
def settlements(spark, sf_dir):
    """Every observed item; without a close in time it stays NULL."""
    return history.settlements(view(spark, sf_dir, "observations"),
                               view(spark, sf_dir, "closes"))


@query("close_model_error", "M3 M4")
def close_model_error(spark, sf_dir):
    """Cross-validated error by auction, and whether the model may run."""
    kept = snapshots(spark, sf_dir).filter(F.col("reason").isNull())
    params = history.settle_params(history.per_item(kept)).filter(
        F.col("band") == "all").select(F.col("n").alias("items"), "mae")
    error = spark.range(1).select(F.lit(
        close_model.grouped_error(kept)).alias("cv_error"))
    reason = close_model.refusal(F.col("items"), F.col("cv_error"),
                                 F.col("mae"))
    return params.crossJoin(error).select(
        "items", "cv_error", (reason == "").alias("deployed"),
        reason.alias("reason"))


@query("matched_closes", "J9", f"""{ctes('observations', 'closes', 'closed')}
SELECT item_id, seq, actual_price FROM closes c WHERE EXISTS (SELECT 1 FROM
 observations o WHERE o.item_id = c.item_id AND o.site = 'ebay') AND NOT
 EXISTS (SELECT 1 FROM closed d WHERE d.item_id = c.item_id AND d.closed_s <
 1704153600)""")
def matched_closes(spark, sf_dir):
    seen = view(spark, sf_dir, "observations").filter(F.col("site") == "ebay")
    done = view(spark, sf_dir, "closed").filter(
        F.col("closed_s") < 1704153600)
    return history.match_closed(view(spark, sf_dir, "closes"), seen, done
                                ).select("item_id", "seq", "actual_price")


@query("fair_trend", "J12 V23", f"""{ctes('fair_history')}, t AS (SELECT * FROM
 fair_history WHERE trusted = 1), cur AS (SELECT query, arg_max(fair, seq) AS
 fair FROM fair_history GROUP BY query), p AS (SELECT query, arg_max(fair,
 (ts_s, seq)) FILTER (WHERE ts_s <= {EVENTS_AS_OF} - 2592000) AS th,
 arg_min(fair, (ts_s, seq)) AS old, min(ts_s) AS old_s FROM t GROUP BY query),
 b AS (SELECT cur.query, cur.fair, coalesce(th, CASE WHEN old_s <=
 {EVENTS_AS_OF} - 259200 THEN old END) AS base FROM cur LEFT JOIN p USING
 (query))
SELECT query, fair, CASE WHEN base <> 0 THEN (fair - base) / base END AS trend
FROM b""")
def fair_trend(spark, sf_dir):
    past = view(spark, sf_dir, "fair_history")
    current = history.latest_by(past.select("query", "fair", "seq"), "query",
                                "seq").select("query", "fair")
    return history.trend(past, current, EVENTS_AS_OF)


@query("first_trusted_fair", "W6", f"""{ctes('fair_history')}
SELECT query, seq, fair FROM (SELECT *, row_number() OVER (PARTITION BY query
 ORDER BY seq) AS n FROM fair_history WHERE trusted = 1) WHERE n = 1""")
def first_trusted_fair(spark, sf_dir):
    rows = view(spark, sf_dir, "fair_history").filter(F.col("trusted") == 1)
    return rank.best_by(rows, ["query"], [F.col("seq")], ["seq", "fair"])


SOURCE = """CASE WHEN endpoint = 'ebay/api' THEN 'ebay/listings' WHEN endpoint
 = 'ebay/html' THEN 'ebay/comps' WHEN endpoint = '130point/html' THEN
 '130point/comps' WHEN starts_with(endpoint, 'guide') THEN 'catalogue/guide'
 ELSE concat(split_part(endpoint, '/', 1), '/listings') END"""
COUNTS = ", ".join(f"count(CASE WHEN outcome = '{o}' THEN 1 END) AS \"{o}\""
                   for o in ("ok", "failed", "skipped"))
STATUS = """CASE WHEN skipped > 0 THEN 'cooling' WHEN failed > 0 AND ok > 0
 THEN 'degraded' WHEN failed > 0 THEN 'failing' WHEN ok > 0 THEN 'healthy' ELSE
 'idle' END AS status"""


@query("source_health", "A15", f"""{ctes('calls')}, c AS (SELECT {SOURCE} AS
 source, {COUNTS} FROM calls GROUP BY 1) SELECT *, {STATUS} FROM c""")
def source_health(spark, sf_dir):
    return history.health(view(spark, sf_dir, "calls"))


@query("source_health_windows", "R7", f"""{ctes('calls')}, c AS (SELECT
 {SOURCE} AS source, ts_s - ts_s % 1800 AS window_s, {COUNTS} FROM calls
 GROUP BY 1, 2) SELECT *, {STATUS} FROM c""")
def source_health_windows(spark, sf_dir):
    calls = view(spark, sf_dir, "calls")
    return history.health(calls, [(F.col("ts_s") - F.col("ts_s") % 1800
                                   ).alias("window_s")])


@query("breaker_trips", "R7", f"""{ctes('calls')}, r AS (SELECT *,
 coalesce(sum(CASE WHEN outcome = 'ok' THEN 1 END) OVER (PARTITION BY endpoint
 ORDER BY ts_s, seq), 0) AS run FROM calls WHERE outcome <> 'skipped'), s AS (
 SELECT endpoint, run, count(*) AS failures, max(ts_s) AS tripped_s FROM r
 WHERE outcome = 'failed' GROUP BY 1, 2 HAVING count(*) >= 3), q AS (SELECT *, CASE WHEN tripped_s -
 lag(tripped_s) OVER (PARTITION BY endpoint ORDER BY tripped_s) < 86400 THEN 0
 ELSE 1 END AS quiet FROM s), p AS (SELECT *, sum(quiet) OVER (PARTITION BY
 endpoint ORDER BY tripped_s) AS span FROM q), k AS (SELECT endpoint,
 tripped_s, failures, row_number() OVER (PARTITION BY endpoint, span ORDER BY
 tripped_s) AS strikes FROM p)
SELECT *, least(144e1, 3e1 * pow(2e0, strikes - 1)) AS pause_minutes FROM k""")
def breaker_trips(spark, sf_dir):
    return history.breaker_trips(view(spark, sf_dir, "calls"))


@query("bidding_sessions", "R9", f"""{ctes('observations')}, g AS (SELECT *,
 CASE WHEN observed_s - lag(observed_s) OVER w < 1800 THEN 0 ELSE 1 END AS new
 FROM observations WINDOW w AS (PARTITION BY item_id ORDER BY observed_s, seq)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY observed_s, seq)
 AS k FROM g)
SELECT item_id, min(observed_s) AS start_s, max(observed_s) AS last_s, count(*)
 AS snapshots, min(price) AS low, max(price) AS high, max(bids) - min(bids) AS
 bids_gained FROM s GROUP BY item_id, k""")
def bidding_sessions(spark, sf_dir):
    """Bursts of observations per auction, half an hour apart at most."""
    rows = view(spark, sf_dir, "observations").withColumn(
        "observed_at", at("observed_s"))
    return timers.sessions(rows).select(
        "item_id", F.unix_seconds("start_at").alias("start_s"),
        F.unix_seconds("last_at").alias("last_s"), "snapshots", "low", "high",
        "bids_gained")


@query("ending_reminders", "R6", f"""{ctes('observations')}, h AS (SELECT *,
 lead(observed_s) OVER (PARTITION BY item_id ORDER BY observed_s, seq) AS nxt
 FROM observations), d AS (SELECT *, greatest(observed_s, end_s - hours * 3600)
 AS due_s FROM h CROSS JOIN (VALUES (24), (6), (1)) AS v(hours)), f AS (SELECT
 *, row_number() OVER (PARTITION BY item_id, hours ORDER BY due_s, observed_s,
 seq) AS n FROM d WHERE end_s IS NOT NULL AND due_s < end_s AND (nxt IS NULL OR
 due_s < nxt))
SELECT item_id, hours, due_s, price FROM f WHERE n = 1""")
def ending_reminders(spark, sf_dir):
    """When each auction was first known to end within 24, 6 and 1 hours."""
    return timers.reminders_batch(view(spark, sf_dir, "observations"))


@query("latest_observation", "R3 A17", f"""{ctes('observations')}
SELECT item_id, arg_max(price, seq) AS price, arg_max(bids, seq) AS bids,
 max(seq) AS seq FROM observations GROUP BY item_id""")
def latest_observation(spark, sf_dir):
    rows = view(spark, sf_dir, "observations").select(
        "item_id", "price", "bids", "seq")
    return history.latest_by(rows, "item_id", "seq")


# ------------------------------------------------------------------- learning
TRAIN = f"""{ctes('observations', 'closed')}, tr0 AS (SELECT o.*,
 c.actual_price, c.actual_price / o.fair AS target FROM observations o JOIN
 closed c USING (item_id) WHERE o.fair > 0 AND c.actual_price > 0), tr AS
 (SELECT *, CASE WHEN fair < 50 THEN 'fair below floor' WHEN n_comps IS NULL
 THEN 'no evidence recorded' WHEN n_comps < 3 THEN 'thin comps' WHEN trusted IS
 DISTINCT FROM 1 THEN 'not trusted' WHEN NOT (target BETWEEN 0.1 AND 3) THEN
 'ratio out of band' END AS reason FROM tr0), it AS (SELECT * FROM (SELECT *,
 row_number() OVER (PARTITION BY item_id ORDER BY n_comps DESC, observed_s
 DESC, seq) AS n FROM tr WHERE reason IS NULL) WHERE n = 1)"""


def snapshots(spark, sf_dir):
    return history.training(view(spark, sf_dir, "observations"),
                            view(spark, sf_dir, "closed"))


@query("training_reasons", "A8 J11 Q3", f"""{TRAIN}
SELECT coalesce(reason, 'kept') AS reason, count(*) AS snapshots FROM tr
GROUP BY 1""")
def training_reasons(spark, sf_dir):
    return snapshots(spark, sf_dir).groupBy(F.coalesce(
        "reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("snapshots"))


@query("training_features", "M1 A9", f"""{TRAIN}
SELECT item_id, seq, target, coalesce(hours_left, 72e0) AS hours_feature,
 least((price + shipping) / fair, 2e0) AS cost_ratio, CAST(bids AS DOUBLE) AS
 bids_feature, round(log10(greatest(fair, 1e0)), 9) AS log_fair FROM it""")
def training_features(spark, sf_dir):
    kept = snapshots(spark, sf_dir).filter(F.col("reason").isNull())
    return history.per_item(kept).select(
        "item_id", "seq", "target", "hours_feature", "cost_ratio",
        "bids_feature", F.round("log_fair", 9).alias("log_fair"))


@query("settle_ratios", "A10 A6 M5", f"""{TRAIN}, g AS (SELECT 'all' AS band,
 target FROM it UNION ALL SELECT CASE WHEN fair < 500 THEN 'lt500' WHEN fair <
 2000 THEN '500to2000' ELSE 'gte2000' END, target FROM it), o AS (SELECT *,
 row_number() OVER (PARTITION BY band ORDER BY target) AS rn, count(*) OVER
 (PARTITION BY band) AS c FROM g), m AS (SELECT band, max(c) AS n, max(CASE
 WHEN rn = c // 2 + 1 THEN target END) AS ratio FROM o GROUP BY band), e AS
 (SELECT band, CAST(sum(CAST(abs(target - (SELECT ratio FROM m WHERE band =
 'all')) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mae FROM g GROUP BY band)
SELECT band, n, ratio, round(mae, 9) AS mae FROM m JOIN e USING (band)
WHERE band = 'all' OR n >= 20""")
def settle_ratios(spark, sf_dir):
    kept = snapshots(spark, sf_dir).filter(F.col("reason").isNull())
    return history.settle_params(history.per_item(kept)).select(
        "band", "n", "ratio", F.round("mae", 9).alias("mae"))


@query("calibration", "A7", f"""{TRAIN}, b AS (SELECT CASE WHEN hours_left < 6
 THEN '0-6' WHEN hours_left < 24 THEN '6-24' WHEN hours_left < 72 THEN '24-72'
 WHEN hours_left >= 72 THEN '72+' END AS bucket, target AS ratio FROM tr), o AS
 (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ratio) AS rn,
 count(*) OVER (PARTITION BY bucket) AS c FROM b WHERE bucket IS NOT NULL)
SELECT bucket, max(c) AS n, max(CASE WHEN rn = c // 2 + 1 THEN ratio END) AS
 median_ratio FROM o GROUP BY bucket HAVING max(c) >= 5""")
def calibration(spark, sf_dir):
    return history.calibration(view(spark, sf_dir, "observations"),
                               view(spark, sf_dir, "closed"))


@query("close_model", "M2 M5")
def close_model_query(spark, sf_dir):
    """Fit on every kept snapshot and predict each auction's close ratio."""
    kept = snapshots(spark, sf_dir).filter(F.col("reason").isNull())
    fitted = close_model.model().fit(kept)
    return close_model.predict(fitted, history.per_item(kept)).select(
        "item_id", "target", "predicted_ratio")


# Learning runs: before the first close, early, in mid-month and at the end.
RUNS = (1703000000, 1704500000, 1705276800, 1706745600)
VERSIONS = f"""{ctes('observations', 'closed')}, runs(run_s) AS (VALUES {
    ', '.join(f'({r})' for r in RUNS)}), kept AS (SELECT o.*, c.closed_s,
 c.actual_price / o.fair AS target FROM observations o JOIN closed c USING
 (item_id) WHERE o.fair >= 50 AND c.actual_price > 0 AND o.n_comps >= 3 AND
 o.trusted = 1 AND c.actual_price / o.fair BETWEEN 0.1 AND 3), kn AS (SELECT
 run_s, k.* FROM runs JOIN kept k ON k.closed_s <= run_s), it AS (SELECT *,
 CASE WHEN fair < 500 THEN 'lt500' WHEN fair < 2000 THEN '500to2000' ELSE
 'gte2000' END AS band FROM (SELECT *, row_number() OVER (PARTITION BY run_s,
 item_id ORDER BY n_comps DESC, observed_s DESC, seq) AS rn FROM kn) WHERE rn =
 1), me AS (SELECT run_s, band, count(*) AS n, list_sort(list(target))[
 count(*) // 2 + 1] AS ratio FROM (SELECT run_s, band, target FROM it UNION ALL
 SELECT run_s, 'all', target FROM it) GROUP BY 1, 2), ev AS (SELECT run_s, n,
 ratio FROM me WHERE band = 'all'), er AS (SELECT run_s, CAST(sum(CAST(abs(
 target - ratio) AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mae FROM it JOIN
 ev USING (run_s) GROUP BY 1), sn AS (SELECT run_s, count(*) AS n_snapshots FROM
 kn GROUP BY 1), bd AS (SELECT run_s, {', '.join(
     f"max(CASE WHEN band = '{b}' AND n >= 20 THEN ratio END) AS r_{b}"
     for b in learning.BANDS)} FROM me GROUP BY 1),
 versions AS (SELECT run_s, coalesce(n, 0) AS n, coalesce(n_snapshots, 0) AS
 n_snapshots, CASE WHEN n >= 20 THEN ratio END AS settle_ratio, {', '.join(
     f'CASE WHEN n >= 20 THEN r_{b} END AS ratio_{b}'
     for b in learning.BANDS)}, CASE WHEN n >= 20 THEN mae END AS
 parametric_mae, CASE WHEN NOT coalesce(n >= 20, false) THEN 'cold start' WHEN
 n < 150 THEN 'too few items' ELSE 'not validated' END AS verdict FROM runs LEFT
 JOIN ev USING (run_s) LEFT JOIN er USING (run_s) LEFT JOIN sn USING (run_s)
 LEFT JOIN bd USING (run_s))"""


def versions(spark, sf_dir):
    runs = spark.createDataFrame([(r,) for r in RUNS], "run_s long")
    return learning.parameters(snapshots(spark, sf_dir), runs)


@query("learned_parameters", "M4 A10", f"{VERSIONS} SELECT * FROM versions")
def learned_parameters(spark, sf_dir):
    """What each learning run would have learned from the closes so far."""
    return versions(spark, sf_dir).drop("cv_error", "deployed")


@query("settle_ratios_as_of", "M5", f"""{VERSIONS}, u AS (SELECT *, lead(run_s)
 OVER (ORDER BY run_s) AS until FROM versions)
SELECT seq, u.run_s, coalesce(CASE WHEN fair < 500 THEN coalesce(ratio_lt500,
 settle_ratio) WHEN fair < 2000 THEN coalesce(ratio_500to2000, settle_ratio)
 ELSE coalesce(ratio_gte2000, settle_ratio) END, 92e-2) AS settle_ratio FROM
 observations LEFT JOIN u ON observed_s >= run_s AND (until IS NULL OR
 observed_s < until)""")
def settle_ratios_as_of(spark, sf_dir):
    """The ratio that held when each observation was made."""
    rows = view(spark, sf_dir, "observations")
    return learning.predicted(learning.with_settle(
        rows, versions(spark, sf_dir), "observed_s", "fair")).select(
        "seq", "run_s", F.col("predicted_ratio").alias("settle_ratio"))
