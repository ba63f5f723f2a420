"""Captured result pages of several sites to lots, by rules kept as data.

`rules` is a table (site, field, pattern).  The pattern of the field `block`
cuts a page into lots; every other pattern finds one field inside a lot, in its
first group.  A site is added by adding rows.  `venues` is a table of what a
site's pages never say: currency, address prefix, cost of buying there.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank
from . import feeds

TEXTS = ("lot_id", "title", "url", "price", "bids", "end_s", "shipping",
         "currency")
COSTS = ("shipping", "buyer_fees", "buyer_fee_rate", "minimum_buyer_fee",
         "international_shipping", "insurance_rate", "import_duty_rate",
         "fx_spread_rate", "insurance_on_buyer_fee")
#: Rows that a table of rules or venues may have; it is configuration.
CONFIGURED = 10_000

# ---------------------------------------------------------------- fixed values
# Markup names of the five sites' result pages, and texts that are no lot.
PATTERNS = {
    "ebay": {
        "block": r'(?s)<li class="s-(?:item|card)".*?</li>',
        "lot_id": r'href="[^"]*/itm/(\d+)', "url": r'href="([^"]*/itm/[^"]*)"',
        "title": r'class="s-(?:item|card)__title">([^<]*)<',
        "price": r'class="s-(?:item|card)__price">([^<]*)<',
        "shipping": r'class="s-item__(?:shipping|logisticsCost)">([^<]*)<',
        "bids": r'class="s-item__bid(?:s|Count)">([^<]*)<'},
    "yahoo_jp": {
        "block": r'(?s)<li class="Product".*?</li>',
        "lot_id": r'data-auction-id="([^"]*)"',
        "url": r'data-auction-id="([^"]*)"',
        "title": r'data-auction-title="([^"]*)"',
        "price": r'data-auction-price="([^"]*)"',
        "end_s": r'data-cl-params="[^"]*end:(\d{9,11})',
        "bids": r'class="Product__bid">([^<]*)<'},
    "130point": {
        "block": r'(?s)<a data-sold-result.*?</a>',
        "lot_id": r'href="([^"]*)"', "url": r'href="([^"]*)"',
        "title": r'<p>([^<]*)</p>', "price": r'data-price-amount="([^"]*)"',
        "currency": r'data-price-currency="([^"]*)"'},
    "heritage": {
        "block": r"(?s)<a href='[^']*/itm/.*?(?=<a href='|$)",
        "lot_id": r"href='([^']*)'", "url": r"href='([^']*)'",
        "title": r"href='[^']*'>([^<]*)</a>",
        "price": r'(?i)Current Bid\s*:\s*\$([\d,]+(?:\.\d+)?)'},
    "pristine": {
        "block": r'(?s)<div class="row product" aria-label="Auction item"'
                 r'.*?</div>',
        "lot_id": r'data-pristine-product-venue-id="([^"]*)"',
        "url": r'class="title" href="([^"]*)"',
        "title": r'data-pristine-title="([^"]*)"',
        "price": r'data-high-bid="([^"]*)"',
        "end_s": r'data-pristine-end-time="(\d+)'}}
NO_LOT = "shop on ebay"
# Site, currency, address prefix, sold pages, then COSTS in their order.
VENUE_ROWS = (
    ("ebay", "USD", "", False, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False),
    ("yahoo_jp", "JPY", "https://buyee.jp/item/jdirectitems/auction/", False,
     8.0, 10.0, 0.0, 0.0, 35.0, 0.01, 0.15, 0.03, False),
    ("goldin", "USD", "https://goldin.co/item/", False,
     19.0, 0.0, 0.0, 19.0, 0.0, 0.009, 0.0, 0.0, True),
    ("heritage", "USD", "https://sports.ha.com", False,
     0.0, 0.0, 0.22, 29.0, 0.0, 0.0, 0.0, 0.0, False),
    ("pristine", "USD", "https://www.pristineauction.com", False,
     0.0, 0.0, 0.17, 0.0, 0.0, 0.0, 0.0, 0.0, False),
    ("alt", "USD", "", False, 0.0, 0.0, 0.20, 0.0, 0.0, 0.0, 0.0, 0.0, False),
    ("130point", "USD", "", True, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
     False))
# ------------------------------------------------------------ end fixed values


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(site, field, pattern) for site, fields in PATTERNS.items()
         for field, pattern in fields.items()],
        "site string, field string, pattern string")


def default_venues(spark: SparkSession) -> DataFrame:
    numbers = ", ".join(f"{c} double" for c in COSTS[:-1])
    return spark.createDataFrame(
        list(VENUE_ROWS), "site string, currency string, prefix string, "
        f"sold_pages boolean, {numbers}, {COSTS[-1]} boolean")


def configured(table: DataFrame) -> DataFrame:
    """A table of settings, broadcast; refused when it is none."""
    if table.limit(CONFIGURED + 1).count() > CONFIGURED:
        raise ValueError(f"more than {CONFIGURED} rows of settings")
    return F.broadcast(table)


def blocks(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """site, page_id, position and the text fields of every lot found.

    Pages of sites without a block rule give nothing; a field without a rule
    or a match is NULL.
    """
    by_site = rules.groupBy("site").agg(F.map_from_entries(F.collect_list(
        F.struct("field", "pattern"))).alias("_rules"))
    cut = pages.join(configured(by_site), "site").select(
        "site", "page_id", "_rules", F.posexplode(F.expr(
            "regexp_extract_all(html, _rules['block'], 0)")).alias(
            "position", "_block"))
    return cut.select("site", "page_id", "position", *(
        plain(F.expr(f"regexp_extract(_block, _rules['{f}'], 1)")).alias(f)
        for f in TEXTS))


def plain(text: Column) -> Column:
    """Text of a piece of markup: common entities decoded, NULL if empty."""
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"),
                         ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.nullif(F.trim(text), F.lit(""))


def amount(text: Column) -> Column:
    """First number of a text, thousands separators dropped."""
    return F.replace(F.regexp_extract(text, r"(\d[\d,]*(?:\.\d+)?)", 1),
                     F.lit(","), F.lit("")).try_cast("double")


def lots(pages: DataFrame, rules: DataFrame, venues: DataFrame,
         as_of: Column, rates: dict | None = None) -> DataFrame:
    """One row per lot: site, lot_id, title, url, current_price (dollars),
    shipping (NULL when the page says none), bid_count, end_time.

    The first capture of a lot wins, by page and position.  Lots without
    title, id or price and, except on pages of sales, lots that have ended
    are dropped.
    """
    found = blocks(pages, rules).join(configured(venues.select(
        "site", F.col("currency").alias("_currency"), "prefix",
        "sold_pages")), "site")
    money = F.coalesce(F.upper("currency"), "_currency")
    end = F.col("end_s").try_cast("long")
    typed = found.select(
        "site", "lot_id", "title", F.concat("prefix", "url").alias("url"),
        feeds.usd(amount(F.col("price")), money, rates).alias(
            "current_price"),
        F.when(F.col("shipping").isNotNull(), F.coalesce(
            amount(F.col("shipping")), F.lit(0.0))).alias("shipping"),
        F.coalesce(F.regexp_extract("bids", r"(\d+)", 1).try_cast("int"),
                   F.lit(0)).alias("bid_count"),
        F.timestamp_seconds(end).alias("end_time"), "page_id", "position",
        (amount(F.col("price")).isNotNull() & F.col("title").isNotNull()
         & F.col("lot_id").isNotNull()
         & ~F.lower(F.coalesce("title", F.lit(""))).contains(NO_LOT)
         & (F.col("sold_pages") | F.coalesce(
             F.timestamp_seconds(end) > as_of, F.lit(True)))).alias("_ok"))
    usable = typed.filter("_ok").drop("_ok")
    return rank.best_by(usable, ["site", "lot_id"], [
        F.col("page_id"), F.col("position")], [
        c for c in usable.columns
        if c not in ("site", "lot_id", "page_id", "position")])


def with_venue_costs(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """Cost columns with the venue's defaults where a listing has none.

    A stated value, zero included, is kept; an unknown venue costs nothing
    extra.  Columns that the listings lack altogether are added.
    """
    costs = venues.select("site", *(F.col(c).alias(f"_{c}") for c in COSTS))
    zero = {c: F.lit(False) if c == COSTS[-1] else F.lit(0.0) for c in COSTS}
    joined = listings.join(configured(costs), "site", "left")
    return joined.withColumns({c: F.coalesce(
        *([F.col(c)] if c in listings.columns else []), F.col(f"_{c}"),
        zero[c]) for c in COSTS}).drop(*(f"_{c}" for c in COSTS))
