"""Domain views over the TPC-H-style tables the test driver provides.

Each view is one SQL text in the common subset of Spark and DuckDB, so both
engines derive the same rows.  Table names appear as {table}; {epoch:col}
stands for "whole seconds since 1970".  Number literals use E notation so
that both engines read them as doubles.
"""
from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import stage

# Every job takes an explicit clock.  Listings and sales are judged at
# 2002-01-01, the event tables at 2024-02-01 (UTC, epoch seconds).
AS_OF = 1009843200
EVENTS_AS_OF = 1706745600

BRAND = "CAST(SUBSTR(p_brand, 7) AS INT)"
MAKER = f"""CASE {BRAND} % 8 WHEN 0 THEN 'Topps Chrome' WHEN 1 THEN 'Fleer'
 WHEN 2 THEN 'Bowman' WHEN 3 THEN 'Panini Prizm' WHEN 4 THEN 'Pokemon Base Set'
 WHEN 5 THEN 'Pokemon Jungle' WHEN 6 THEN 'Nintendo NES'
 ELSE 'Upper Deck' END"""
QUERY = f"""CONCAT(CASE WHEN {BRAND} % 8 = 7 AND p_name LIKE 'old%' THEN '1999 '
 ELSE '' END, {MAKER}, ' ', p_name,
 CASE WHEN {BRAND} % 8 = 2 THEN ' PSA 9' ELSE '' END)"""
EDITION = """CASE l_suppkey % 7 WHEN 0 THEN ' 1st Edition'
 WHEN 1 THEN ' Unlimited' WHEN 2 THEN ' Shadowless' ELSE '' END"""
STATE = f"""CASE WHEN {BRAND} % 8 <> 6 THEN '' WHEN l_suppkey % 3 = 0
 THEN ' Factory Sealed' WHEN l_suppkey % 3 = 1 THEN ' CIB'
 ELSE ' loose' END"""
FINISH = """CASE l_partkey % 5 WHEN 0 THEN ' Refractor' WHEN 1 THEN
 ' Gold Wave' WHEN 2 THEN ' Holo' ELSE '' END"""
STAMP = """CASE l_suppkey % 11 WHEN 3 THEN ' #/99' WHEN 4 THEN ' /25'
 WHEN 5 THEN ' 1/1' ELSE '' END"""
EXTRA = """CASE l_suppkey % 29 WHEN 4 THEN ' Signed Photo' WHEN 5 THEN ' Auto'
 WHEN 6 THEN ' Japanese' WHEN 7 THEN ' reprint' WHEN 8 THEN ' (OC)'
 WHEN 9 THEN ' Patch' WHEN 10 THEN ' Authentic' WHEN 11 THEN ' Korean'
 WHEN 12 THEN ' Wrapper' WHEN 13 THEN ' Pokémon Café' ELSE '' END"""
GRADE = """CASE l_linenumber WHEN 1 THEN ' PSA 10' WHEN 2 THEN ' PSA 9'
 WHEN 3 THEN ' BGS 9.5' WHEN 4 THEN ' CGC 8' WHEN 5 THEN ' SGC 92'
 WHEN 6 THEN ' CGC 85' ELSE '' END"""
TITLE = (f"CONCAT(1980 + p_size, ' ', {MAKER}, ' ', p_name, {EDITION}, "
         f"{STATE}, ' #', p_size, {FINISH}, {STAMP}, {EXTRA}, {GRADE})")
LINE_ID = ("CONCAT(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', "
           "l_suppkey)")
ITEM = "(100000000000 + l_orderkey * 10 + l_linenumber)"

VIEWS: dict[str, str] = {}

# Every title in the data, live or sold.
VIEWS["titles"] = f"""
SELECT {QUERY} AS query, {TITLE} AS title, COUNT(*) AS copies
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2"""

VIEWS["sales"] = f"""
SELECT {LINE_ID} AS sale_id, {QUERY} AS query, {TITLE} AS title,
 l_extendedprice / l_quantity AS price, {{epoch:l_shipdate}} AS sold_s,
 {{epoch:l_shipdate}} + (l_suppkey % 9) * 3600 AS scanned_s,
 CASE l_returnflag WHEN 'A' THEN '130point' WHEN 'R' THEN 'ebay'
 ELSE 'goldin' END AS site,
 CASE WHEN l_suppkey % 4 = 0 THEN CONCAT('https://www.ebay.com/itm/', {ITEM})
 WHEN l_suppkey % 4 = 1 THEN CONCAT('https://www.ebay.com/itm/a-b/', {ITEM},
 '?hash=x') WHEN l_suppkey % 4 = 2 THEN CONCAT(
 'HTTPS://Sales.Example.com/lot/', l_partkey, '/?utm_source=f&b=2&a=1#t')
 ELSE '' END AS url
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
WHERE l_linestatus = 'F'"""

VIEWS["listings"] = f"""
SELECT {LINE_ID} AS row_id, {QUERY} AS query, {TITLE} AS title,
 CASE l_returnflag WHEN 'A' THEN 'ebay' WHEN 'R' THEN 'goldin'
 ELSE 'yahoo_jp' END AS site,
 CASE l_returnflag WHEN 'A' THEN 'EBAY_US' WHEN 'R' THEN 'GOLDIN'
 ELSE 'YAHOO_JP' END AS marketplace,
 CASE WHEN l_orderkey % 3 = 0 THEN 'fixed' ELSE 'auction' END AS listing_type,
 CASE WHEN l_suppkey % 6 = 5 THEN '' ELSE CAST({ITEM} AS {{text}}) END
 AS listing_id,
 CASE WHEN l_suppkey % 6 = 5 THEN CONCAT('https://x.example.com/L/', l_partkey,
 '/?ref=', l_suppkey) ELSE CONCAT('https://www.ebay.com/itm/', {ITEM}) END
 AS url,
 CASE WHEN l_suppkey % 10 = 0 THEN CONCAT('PSA : ', l_partkey * 7) ELSE ''
 END AS canonical_asset_id,
 (l_extendedprice / l_quantity) * (3E-1 + 9E-1 * ((l_partkey * 31 +
 l_orderkey * 17 + l_linenumber) % 100) / 1E2) AS current_price,
 (l_suppkey % 5) * 25E-1 AS shipping, 0E0 AS buyer_fees,
 CASE WHEN l_returnflag = 'R' THEN 22E-2 ELSE 0E0 END AS buyer_fee_rate,
 CASE WHEN l_returnflag = 'R' THEN 19E0 ELSE 0E0 END AS minimum_buyer_fee,
 CASE WHEN l_returnflag = 'N' THEN 35E0 ELSE 0E0 END
 AS international_shipping,
 CASE l_returnflag WHEN 'N' THEN 1E-2 WHEN 'R' THEN 9E-3 ELSE 0E0 END
 AS insurance_rate, l_returnflag = 'R' AS insurance_on_buyer_fee,
 CASE WHEN l_returnflag = 'N' THEN 15E-2 ELSE 0E0 END AS import_duty_rate,
 CASE WHEN l_returnflag = 'N' THEN 3E-2 ELSE 0E0 END AS fx_spread_rate,
 l_linenumber - 1 AS bid_count,
 l_orderkey % 3 = 0 AND l_suppkey % 2 = 0 AS best_offer,
 l_orderkey % 3 = 1 AND l_suppkey % 4 = 0 AS has_buy_now,
 CASE WHEN l_orderkey % 3 = 1 AND l_suppkey % 4 = 0
 THEN l_extendedprice / l_quantity ELSE 0E0 END AS buy_now_price,
 CASE WHEN l_orderkey % 3 = 0 OR l_suppkey % 13 = 0 THEN NULL ELSE
 {AS_OF} + ((l_orderkey * 7 + l_suppkey) % 240 - 20) * 3600 + l_partkey % 60
 END AS end_s,
 CASE WHEN l_orderkey % 3 = 0 AND l_suppkey % 17 <> 0 THEN
 {AS_OF} - ((l_orderkey * 5 + l_partkey) % 2400) * 3600 END AS created_s,
 CASE WHEN l_suppkey % 19 = 0 THEN NULL
 ELSE CAST(FLOOR(s_acctbal / 1E2) AS INT) END AS seller_feedback,
 CASE WHEN l_suppkey % 31 = 1 THEN 'red widgt' ELSE NULL END AS misspell_from
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
JOIN {{supplier}} ON l_suppkey = s_suppkey WHERE l_linestatus = 'O'"""

VIEWS["standing_queries"] = f"""
SELECT {QUERY} AS query, MIN(p_partkey) AS ord,
 MAX(CASE WHEN {BRAND} % 8 IN (0, 4) THEN 1 ELSE 0 END) = 1 AS priority,
 MAX(CASE WHEN {BRAND} % 8 = 1 THEN 1 ELSE 0 END) = 1 AS discovery,
 MAX(CASE WHEN {BRAND} % 8 = 5 AND p_name LIKE 'red%' THEN 1 ELSE 0 END) = 1
 AS set_need,
 MAX(CASE WHEN {BRAND} % 8 = 3 THEN 1 ELSE 0 END) = 1 AS structured_target,
 MAX(CASE WHEN {BRAND} % 8 = 3 THEN 7E0 END) AS grade_min,
 MAX(CASE WHEN {BRAND} % 8 = 3 THEN 1E1 END) AS grade_max,
 MAX(CASE WHEN {BRAND} % 8 = 5 AND p_name LIKE 'red%' THEN 0E0
 WHEN {BRAND} % 8 = 3 THEN 1E2 END) AS value_floor_override,
 MAX(CASE WHEN {BRAND} % 8 = 7 THEN 25E2 END) AS max_buy_price,
 MAX(CASE WHEN {BRAND} % 8 = 7 AND p_name LIKE 'new%' THEN 'heritage'
 END) AS resale_channel
FROM {{part}} GROUP BY 1"""

VIEWS["catalogue"] = f"""
SELECT CAST(p_partkey AS {{text}}) AS product_id,
 CONCAT(p_name, CASE p_partkey % 5 WHEN 0 THEN ' [Refractor]'
 WHEN 1 THEN ' [Gold Wave]' ELSE '' END,
 CASE WHEN p_partkey % 9 = 4 THEN ' [1st Edition]' ELSE '' END,
 ' #', p_size) AS product_name,
 CONCAT(1980 + p_size, ' ', {MAKER}) AS console_name,
 CAST(FLOOR(p_retailprice * 1E2) AS BIGINT) AS loose_price,
 CASE WHEN p_partkey % 4 <> 0 THEN CAST(FLOOR(p_retailprice * 12E1) AS BIGINT)
 END AS cib_price,
 CASE WHEN p_partkey % 3 <> 0 THEN CAST(FLOOR(p_retailprice * 15E1) AS BIGINT)
 END AS new_price,
 CASE WHEN p_partkey % 7 <> 0 THEN CAST(FLOOR(p_retailprice * 2E2) AS BIGINT)
 END AS graded_price,
 CASE WHEN p_partkey % 2 = 0 THEN CAST(FLOOR(p_retailprice * 26E1) AS BIGINT)
 END AS box_only_price,
 CAST(FLOOR(p_retailprice * 35E1) AS BIGINT) AS manual_only_price,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(FLOOR(p_retailprice * 3E2) AS BIGINT)
 END AS bgs_10_price,
 CASE WHEN p_partkey % 5 = 0 THEN CAST(FLOOR(p_retailprice * 28E1) AS BIGINT)
 END AS condition_17_price, CAST(NULL AS BIGINT) AS condition_18_price,
 CASE {BRAND} % 8 WHEN 4 THEN 'Pokemon Card' WHEN 5 THEN 'Pokemon Card'
 WHEN 6 THEN 'Platformer' ELSE 'Trading Card' END AS genre,
 CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 97 END AS sales_volume,
 CASE WHEN {BRAND} % 8 IN (4, 5, 6) THEN 'general' ELSE 'sports' END AS host
FROM {{part}}"""

# Event tables: user_id stands for the auctioned item.
VIEWS["observations"] = """
SELECT CAST(user_id AS {text}) AS item_id, {epoch:ts} AS observed_s,
 event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'goldin' ELSE 'ebay' END
 AS site, CONCAT('query ', user_id % 40) AS query, value + 1E1 AS price,
 (event_id % 4) * 25E-1 AS shipping, CAST(event_id % 9 AS INT) AS bids,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 13) % 100 AS
 DOUBLE) END AS hours_left,
 (value + 5E1) * (1E0 + (event_id % 7) / 1E1) AS fair,
 (value + 5E1) * 9E-1 AS predicted_settle,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 12 AS INT) END
 AS n_comps, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1 END AS trusted,
 {epoch:ts} + 3600 * (event_id % 100) AS end_s
FROM {events} WHERE event_type IN ('view', 'click', 'signup')"""

VIEWS["closes"] = """
SELECT CAST(user_id AS {text}) AS item_id, {epoch:ts} AS closed_s,
 event_id AS seq, CASE WHEN event_id % 8 = 0 THEN 0E0 ELSE value + 4E1 END
 AS actual_price
FROM {events} WHERE event_type = 'purchase'"""

# First recorded close per item (insert-or-ignore).
VIEWS["closed"] = """
SELECT item_id, closed_s, actual_price FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY seq) AS n
 FROM (%s) x) y WHERE n = 1""" % VIEWS["closes"].strip()

VIEWS["fair_history"] = """
SELECT CONCAT('query ', user_id) AS query, {epoch:ts} AS ts_s,
 event_id AS seq, value + 1E2 AS fair, CAST(event_id % 10 AS INT) AS n_comps,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE 1 END AS trusted
FROM {events}"""

VIEWS["calls"] = """
SELECT CASE user_id % 8 WHEN 0 THEN 'ebay/api' WHEN 1 THEN 'ebay/html'
 WHEN 2 THEN '130point/html' WHEN 3 THEN 'yahoo_jp/html' WHEN 4 THEN
 'goldin/api' WHEN 5 THEN 'heritage/html' WHEN 6 THEN 'newvenue/feed'
 ELSE 'guide/api' END AS endpoint,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped'
 ELSE 'ok' END AS outcome, {epoch:ts} AS ts_s, event_id AS seq
FROM {events}"""

VIEWS["positions"] = """
SELECT CONCAT('lot ', o_orderkey) AS description,
 CONCAT('query ', o_custkey % 300) AS query,
 CASE WHEN o_orderkey % 50 = 0 THEN '(bad)' ELSE CONCAT('$',
 CAST(o_totalprice AS {text})) END AS cost_basis,
 {date:o_orderdate} AS date_bought,
 CASE WHEN o_orderstatus = 'F' THEN {date:o_orderdate+} END AS date_sold,
 CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice * 11E-1 AS {text}) END
 AS sale_proceeds,
 CASE WHEN o_orderkey % 20 = 0 THEN 'heritage' ELSE '' END AS resale_channel,
 o_orderkey AS seq
FROM {orders}"""


# Listings with a valuation made of plain arithmetic, for the gates and views
# that only read valuation columns.
VIEWS["valued"] = f"""
SELECT l.row_id, l.query, l.title, l.site, l.listing_type, l.url, l.listing_id,
 l.current_price, l.shipping, l.bid_count, l.has_buy_now, l.buy_now_price,
 l.best_offer, l.canonical_asset_id, l.end_s, l.created_s,
 CASE WHEN l.end_s IS NULL THEN NULL WHEN l.end_s < {AS_OF} THEN 0E0
 ELSE (l.end_s - {AS_OF}) / 36E2 END AS hours_remaining,
 CASE WHEN l.created_s IS NOT NULL THEN ({AS_OF} - l.created_s) / 36E2 END
 AS age_hours, q.set_need, q.value_floor_override, q.structured_target,
 q.discovery AND l.k % 4 <> 0 AS discovery,
 q.discovery AND l.k % 4 = 0 AS promoted_from_discovery,
 q.priority AS priority, 'auto' AS resale_channel,
 CASE WHEN l.query LIKE 'Pokemon%' THEN 'Pokemon Cards' WHEN l.query LIKE
 'Nintendo%' THEN 'Video Games' WHEN l.k % 41 = 0 THEN 'Watches'
 WHEN l.title LIKE '%Signed Photo%' THEN 'Sports Memorabilia'
 ELSE 'Sports Cards' END AS category,
 CASE WHEN l.k % 37 = 0 THEN 0E0 ELSE l.current_price * (5E-1 +
 (l.k % 211) / 1E2) END AS fair_value,
 CASE WHEN l.k % 5 = 0 THEN NULL ELSE l.current_price * 11E-1 END
 AS comps_value, CASE WHEN l.k % 3 = 0 THEN l.current_price * 12E-1 END
 AS guide_value, CAST(l.k % 14 AS INT) AS n_comps,
 CASE l.k % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'strong' WHEN 2 THEN 'weak'
 ELSE 'none' END AS match, l.k % 23 = 0 AS disputed, l.k % 17 = 0 AS regraded,
 CASE l.k % 11 WHEN 1 THEN 'ASK-BASED' WHEN 2 THEN 'MIXED POOL' WHEN 3 THEN
 'IDENTITY UNRESOLVED' WHEN 4 THEN 'SUSPICIOUS' WHEN 5 THEN 'FRESH'
 WHEN 6 THEN 'STALE COMPS' END AS note_code,
 l.current_price * ((l.k % 97) - 3E1) / 1E2 AS expected_value,
 l.current_price * ((l.k % 89) - 25E0) / 1E2 AS edge_now,
 ((l.k % 97) - 3E1) / 1E2 AS roi, (l.k % 101) / 1E2 AS confidence,
 (l.k % 61) / 6E1 AS capture, (l.k % 997) / 997E0 AS opportunity_score,
 (l.k % 50) / 5E1 - 4E-1 AS trend_30d,
 CASE l.k % 3 WHEN 0 THEN 'ebay' WHEN 1 THEN 'goldin' ELSE 'psa_vault' END
 AS exit_channel, l.current_price * 9E-1 AS net_proceeds,
 CONCAT(l.query, '|', l.k % 700) AS identity_key,
 CASE WHEN l.k % 53 = 0 THEN CONCAT('wanted ', l.k % 7) END AS wanted,
 CASE WHEN l.k % 53 = 0 THEN 1E2 - (l.k % 7) * 1E1 END AS wanted_score
FROM ({VIEWS['listings'].replace("SELECT", "SELECT (l_partkey * 7919 + " 
 "l_orderkey * 104729 + l_suppkey) % 1000003 AS k,", 1)}) l
JOIN ({VIEWS['standing_queries']}) q ON l.query = q.query"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def render(sql: str, dialect: str) -> str:
    """Fill the dialect marks; table names become {table} or plain names."""
    spark = dialect == "spark"

    def epoch(match):
        column = match.group(1)
        return (f"unix_seconds(CAST({column} AS TIMESTAMP))" if spark
                else f"CAST(floor(epoch({column})) AS BIGINT)")

    def day(match):
        column = match.group(1)
        if column.endswith("+"):
            column = column[:-1]
            return (f"CAST(date_add(CAST({column} AS DATE), 90) AS STRING)"
                    if spark else
                    f"CAST(CAST({column} AS DATE) + 90 AS VARCHAR)")
        return (f"CAST(CAST({column} AS DATE) AS STRING)" if spark
                else f"CAST(CAST({column} AS DATE) AS VARCHAR)")

    sql = re.sub(r"\{epoch:(\w+)\}", epoch, sql)
    sql = re.sub(r"\{date:([\w+]+)\}", day, sql)
    sql = sql.replace("{text}", "STRING" if spark else "VARCHAR")
    if not spark:
        for table in TABLES:
            sql = sql.replace("{%s}" % table, table)
    return sql


def used_tables(sql: str) -> list[str]:
    return [t for t in TABLES if "{%s}" % t in sql]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame; *_s columns stay epoch seconds."""
    sql = render(VIEWS[name], "spark")
    frames = {t: table(spark, sf_dir, t) for t in used_tables(sql)}
    df = spark.sql(sql, **frames)
    # "valued" stands for a stored table of valued rows: its columns are made
    # once per row and not re-derived inside every predicate over them
    return stage(df, **{c: df[c] for c in df.columns}
                 ) if name == "valued" else df


@lru_cache(maxsize=None)
def ctes(*names: str) -> str:
    """DuckDB WITH list of the named views."""
    return "WITH " + ",\n".join(
        f"{n} AS ({render(VIEWS[n], 'duckdb')})" for n in names)


def at(seconds):
    """Epoch seconds to a timestamp column."""
    return F.timestamp_seconds(F.col(seconds) if isinstance(seconds, str)
                               else seconds)
