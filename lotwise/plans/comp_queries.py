"""Queries over comparable sales."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import identity, urls
from ..operators import comps, rank
from ..sources.adapters import AS_OF, at, ctes, view
from . import duck
from .registry import query
from .text_queries import SALE_KEY_SQL

def now():
    return F.timestamp_seconds(F.lit(AS_OF))


def sales(spark, sf_dir):
    return view(spark, sf_dir, "sales").withColumns({
        "sold_at": at("sold_s"), "scanned_at": at("scanned_s"),
        "sale_key": urls.sale_key("title", "price", F.col("sold_s"), "url",
                                  "site")})


def relevance_sql(q: str, t: str) -> str:
    """All relevance rules of one (text, sale title) pair, as a reason."""
    from .. import vocab
    clash = " OR ".join(f"coalesce({q}.{f} <> {t}.{f}, false)" for f in (
        "holo", "edition", "series", "completeness"))
    return duck.case([
        (f"coalesce({q}.effective, 5e0) <> coalesce({t}.effective, 5e0)",
         "'grade'"),
        (f"{t}.is_foreign OR ({duck.hit(t + '.low', vocab.JAPANESE)} AND NOT "
         f"{duck.hit(q + '.low', vocab.JAPANESE_NATIVE_QUERY)})",
         "'language'"),
        (clash, "'variant'"),
        (f"len({q}.subject_all) > 0 AND NOT list_has_any({q}.subject_all, "
         f"{t}.words)", "'subject'"),
        (f"len({q}.years) > 0 AND NOT list_has_any({q}.years, {t}.years)",
         "'year'"),
        (f"{q}.card_number IS NOT NULL AND {q}.card_number IS DISTINCT FROM "
         f"{t}.card_number", "'number'")])


def score_sql(q: str, t: str) -> str:
    return duck.match_score(f"{q}.tokens", f"{t}.tokens", f"{q}.low",
                            f"{t}.low")


# kept: sales that price their own query, with weight and match.
KEPT = f"""{ctes('sales')},
 pairs AS (SELECT DISTINCT query, title FROM sales),
 qs AS (SELECT DISTINCT query AS qtext FROM sales),
 {duck.identity('pairs', 'title', 't')}, {duck.identity('qs', 'qtext', 'q')},
 scored AS (SELECT t.query, t.title, {relevance_sql('q', 't')} AS reason,
  {score_sql('q', 't')} AS match FROM t JOIN q ON q.qtext = t.query),
 kept AS (SELECT s.*, k.match,
  CAST(exp(-ln(2e0) * (({AS_OF} - s.sold_s) / 3600e0 / 24e0) / 30e0)
   * k.match AS DECIMAL(38,28)) AS weight,
  CAST(k.match AS DECIMAL(38,28)) AS match_exact
  FROM sales s JOIN scored k ON s.query = k.query AND s.title = k.title
  WHERE s.price > 0 AND k.reason IS NULL AND k.match >= 0.55)"""


def robust_sql(source: str, key: str, out: str) -> str:
    """CTEs computing the robust value per key from price/weight/match."""
    return f"""
 {out}_a AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS kept_n,
  row_number() OVER (PARTITION BY {key} ORDER BY price) AS rn FROM {source}),
 {out}_b AS (SELECT *, max(CASE WHEN rn = kept_n // 2 + 1 THEN price END)
  OVER (PARTITION BY {key}) AS med FROM {out}_a WHERE kept_n >= 3),
 {out}_c AS (SELECT *, abs(price - med) AS dev, row_number() OVER (
  PARTITION BY {key} ORDER BY abs(price - med)) AS dn FROM {out}_b),
 {out}_d AS (SELECT *, max(CASE WHEN dn = kept_n // 2 + 1 THEN dev END)
  OVER (PARTITION BY {key}) AS mad FROM {out}_c),
 {out}_e AS (SELECT *, dev <= 3e0 * CASE WHEN mad = 0 THEN med * 5e-2 ELSE mad
  END AS inside FROM {out}_d),
 {out}_f AS (SELECT *, count(CASE WHEN inside THEN 1 END) OVER (
  PARTITION BY {key}) AS n_in FROM {out}_e),
 {out}_g AS (SELECT {key}, price, weight, match_exact,
  count(*) OVER (PARTITION BY {key}) AS used,
  row_number() OVER (PARTITION BY {key} ORDER BY price) AS rn,
  sum(weight) OVER (PARTITION BY {key} ORDER BY price RANGE BETWEEN UNBOUNDED
   PRECEDING AND CURRENT ROW) AS wu,
  sum(weight) OVER (PARTITION BY {key}) AS wt
  FROM {out}_f WHERE inside OR n_in < 3),
 {out}_h AS (SELECT *, max(CASE WHEN rn = used // 2 + 1 THEN price END)
  OVER (PARTITION BY {key}) AS med2 FROM {out}_g),
 {out}_i AS (SELECT *, row_number() OVER (PARTITION BY {key}
  ORDER BY abs(price - med2)) AS dn FROM {out}_h),
 {out} AS (SELECT {key}, min(CASE WHEN wu * 2 >= wt THEN price END) AS value,
  max(used) AS n_used, CASE WHEN max(med2) <> 0 THEN
  max(CASE WHEN dn = used // 2 + 1 THEN abs(price - med2) END) / max(med2)
  ELSE 0e0 END AS dispersion,
  CAST(sum(match_exact) AS DOUBLE) / max(used) AS avg_match
  FROM {out}_i GROUP BY {key}
  UNION ALL SELECT {key}, CAST(NULL AS DOUBLE), count(*), 0e0, 0e0
  FROM {source} GROUP BY {key} HAVING count(*) < 3)"""


@query("comp_value", "A1 A2 J6 T52", f"""{KEPT},
 {robust_sql('kept', 'query', 'v')}
SELECT query, value, n_used, round(dispersion, 9) AS dispersion,
 round(avg_match, 9) AS avg_match FROM v""")
def comp_value(spark, sf_dir):
    """Robust comparable-sale value of every standing query."""
    sold = sales(spark, sf_dir)
    out = comps.robust_value(comps.relevant_sales(sold, now()), ["query"],
                             bound=sold)
    return out.select("query", "value", "n_used",
                      F.round("dispersion", 9).alias("dispersion"),
                      F.round("avg_match", 9).alias("avg_match"))


@query("comp_velocity", "A4 R8", duck.nearest_rounds(f"""{KEPT}
SELECT query, CASE WHEN bool_or(site = '130point') THEN round(
 count(CASE WHEN site = '130point' AND ({AS_OF} - sold_s) / 3600e0 <= 1080
 THEN 1 END) / 1.5e0, 2) WHEN count(CASE WHEN site <> '130point' THEN 1 END)
 > 0 THEN round(count(CASE WHEN site <> '130point' THEN 1 END) / 3e0, 2) END
 AS sales_per_month FROM kept GROUP BY query"""))
def comp_velocity(spark, sf_dir):
    kept = comps.relevant_sales(sales(spark, sf_dir), now())
    return comps.velocity(kept, ["query"], now())


@query("comp_age", "A5", f"""{ctes('sales')}
SELECT query, greatest(0e0, min(({AS_OF} - sold_s) / 3600e0))
 AS comp_age_hours FROM sales GROUP BY query""")
def comp_age(spark, sf_dir):
    return comps.newest_age(sales(spark, sf_dir), ["query"], now())


UPSERT = f"""{ctes('sales')}, keyed AS (SELECT *, {SALE_KEY_SQL} AS sale_key
 FROM sales), uniq AS (SELECT * FROM (SELECT *, row_number() OVER (
 PARTITION BY query, site, sale_key ORDER BY scanned_s DESC, sale_id) AS n
 FROM keyed) WHERE n = 1)"""


@query("comp_upsert", "W4", f"""{UPSERT}
SELECT query, site, sale_key, sale_id, price FROM uniq""")
def comp_upsert(spark, sf_dir):
    return comps.upsert_sales(sales(spark, sf_dir)).select(
        "query", "site", "sale_key", "sale_id", "price")


@query("comp_cache", "W5", f"""{ctes('sales')}, r AS (SELECT query, sale_id,
 price, row_number() OVER (PARTITION BY query ORDER BY scanned_s DESC,
 sale_id) AS n, count(CASE WHEN ({AS_OF} - scanned_s) / 3600e0 <= 4380 THEN 1
 END) OVER (PARTITION BY query) AS fresh FROM sales)
SELECT query, sale_id, price FROM r WHERE n <= 120 AND fresh >= 5""")
def comp_cache(spark, sf_dir):
    return comps.cached_sales(sales(spark, sf_dir), now(), 4380.0).select(
        "query", "sale_id", "price")


@query("comp_cache_health", "A16 F10 R10", f"""{ctes('sales')}, c AS (
 SELECT query, count(*) AS sales, ({AS_OF} - max(scanned_s)) / 3600e0
 AS age FROM sales GROUP BY query)
SELECT query, sales, greatest(0e0, age) AS age_hours,
 CASE WHEN age <= 4380 THEN 'healthy' ELSE 'stale' END AS status,
 CASE WHEN age <= 4380 THEN NULL WHEN age >= 8760 THEN 'STALE COMPS'
 ELSE 'AGING COMPS' END AS note FROM c""")
def comp_cache_health(spark, sf_dir):
    from ..config import replace
    s = replace(DEFAULT, stale_block_hours=8760.0)
    limit = 4380.0
    c = sales(spark, sf_dir).groupBy("query").agg(
        F.count("*").alias("sales"),
        F.greatest(F.lit(0.0), comps.hours_between(
            F.max("scanned_at"), now())).alias("age_hours"))
    age = F.col("age_hours")
    return c.select("*", F.when(age <= limit, "healthy").otherwise("stale")
                    .alias("status"),
                    comps.stale_note(age, age > limit, F.lit(False), s
                                     ).alias("note"))


ASKS = f"""{ctes('listings')}, asks AS (SELECT query, {{landed}} AS price
 FROM listings WHERE listing_type = 'fixed')"""
LANDED_SQL = """(greatest(0e0, current_price) * (1e0 + (insurance_rate +
 import_duty_rate + fx_spread_rate)) + (shipping + buyer_fees +
 international_shipping) + greatest(greatest(0e0, current_price) *
 buyer_fee_rate, minimum_buyer_fee) + greatest(greatest(0e0, current_price) *
 buyer_fee_rate, minimum_buyer_fee) * ((CASE WHEN insurance_on_buyer_fee THEN
 1e0 + insurance_rate ELSE 1e0 END) - 1e0))"""


def ask_floor_sql(source: str, key: str, out: str) -> str:
    return f"""
 {out}_a AS (SELECT {key}, price, count(*) OVER (PARTITION BY {key}) AS c,
  row_number() OVER (PARTITION BY {key} ORDER BY price) AS rn FROM {source}
  WHERE price > 0),
 {out}_b AS (SELECT *, max(CASE WHEN rn = c // 2 + 1 THEN price END) OVER (
  PARTITION BY {key}) AS med FROM {out}_a WHERE c >= 3),
 {out}_c AS (SELECT *, row_number() OVER (PARTITION BY {key}
  ORDER BY abs(price - med)) AS dn FROM {out}_b),
 {out}_d AS (SELECT *, max(CASE WHEN dn = c // 2 + 1 THEN abs(price - med) END)
  OVER (PARTITION BY {key}) AS mad FROM {out}_c),
 {out}_e AS (SELECT *, abs(price - med) <= 3e0 * CASE WHEN mad = 0
  THEN med * 5e-2 ELSE mad END AS inside FROM {out}_d),
 {out}_f AS (SELECT *, count(CASE WHEN inside THEN 1 END) OVER (
  PARTITION BY {key}) AS n_in FROM {out}_e),
 {out}_g AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS k, row_number()
  OVER (PARTITION BY {key} ORDER BY price) AS r2 FROM {out}_f
  WHERE inside OR n_in < 3),
 {out} AS (SELECT {key}, max(c) AS asks, max(CASE WHEN r2 =
  CAST(floor(k * 25e-2) AS BIGINT) + 1 THEN price END) * 9e-1 AS ask_value
  FROM {out}_g GROUP BY {key})"""


@query("ask_floor", "A3", f"""{ASKS.format(landed=LANDED_SQL)},
 {ask_floor_sql('asks', 'query', 'v')} SELECT query, asks, ask_value FROM v""")
def ask_floor(spark, sf_dir):
    from ..functions.economics import landed_cost
    asks = view(spark, sf_dir, "listings").filter(
        F.col("listing_type") == "fixed").select(
        "query", landed_cost("current_price").alias("price")).filter(
        F.col("price") > 0)
    return comps.trimmed_floor(asks, ["query"],
                               bound=view(spark, sf_dir, "listings"))
