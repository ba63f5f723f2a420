"""Queries over captured pages of several venues and their costs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import economics
from ..sources import captures
from ..sources.adapters import AS_OF, at, ctes, view
from .comp_queries import LANDED_SQL, now
from .registry import query

# Lots as five sites would show them: each on one page of its query, some on a
# second page later on, at another price.
SITE = """CASE k % 5 WHEN 0 THEN 'ebay' WHEN 1 THEN 'yahoo_jp' WHEN 2 THEN
 '130point' WHEN 3 THEN 'heritage' ELSE 'pristine' END"""
SHOWN = f"""SELECT {SITE} AS site, CONCAT(query, '~', copy) AS page_id, row_id,
 CONCAT(k, CASE WHEN k % 5 = 0 THEN '' ELSE 'x' END) AS lot, CONCAT(title,
 CASE WHEN k % 9 = 0 THEN ' & Co' ELSE '' END) AS title, CASE WHEN k % 11 = 0
 THEN NULL ELSE CAST(FLOOR(current_price) AS BIGINT) + copy END AS price,
 bid_count AS bids, coalesce(end_s, {AS_OF} + 86400) AS end_s, copy
 FROM (SELECT *, CAST(REPLACE(row_id, '-', '') AS BIGINT) AS k FROM
 {{listings}}) l CROSS JOIN (VALUES (1), (2)) AS c(copy)
 WHERE copy = 1 OR k % 7 = 0"""


def shown_pages(spark, sf_dir):
    """(site, page_id, html): result pages with the lots of a query."""
    # the joined keys outgrow 64 bits where each of them is still short
    wide = SHOWN.replace("AS BIGINT) AS k", "AS DECIMAL(38, 0)) AS k")
    rows = spark.sql(wide, listings=view(spark, sf_dir, "listings"))
    title = F.replace("title", F.lit("&"), F.lit("&amp;"))
    price = F.coalesce(F.col("price").cast("string"), F.lit("soon"))
    lot, bids, end = (F.col(c).cast("string") for c in ("lot", "bids",
                                                        "end_s"))

    def markup(pattern):
        """Fill {name} places of a text."""
        out, names = [], {"lot": lot, "title": title, "price": price,
                          "bids": bids, "end": end}
        for i, part in enumerate(pattern.replace("}", "{").split("{")):
            out.append(names[part] if i % 2 else F.lit(part))
        return F.concat(*out)

    block = (F.when(F.col("site") == "ebay", markup(
        '<li class="s-item"><a class="s-item__link" href="https://www.ebay.com'
        '/itm/{lot}?hash=x"><div class="s-item__title">{title}</div></a><span '
        'class="s-item__price">${price}</span><span class="s-item__shipping"'
        '>+$5.00 shipping</span><span class="s-item__bids">{bids} bids</span>'
        '</li>'))
        .when(F.col("site") == "yahoo_jp", markup(
            '<li class="Product"><a data-auction-id="{lot}" data-auction-title='
            '"{title}" data-auction-price="{price}" data-cl-params="st:1;'
            'end:{end};"></a><span class="Product__bid">{bids}</span></li>'))
        .when(F.col("site") == "130point", markup(
            '<a data-sold-result href="https://130point.com/s/{lot}"><span '
            'data-original-price-amount="99999" data-price-amount="{price}" '
            'data-price-currency="USD"></span><p>{title}</p></a>'))
        .when(F.col("site") == "heritage", markup(
            "<a href='/itm/{lot}'>{title}</a> <b>Current Bid: ${price}</b>\n"))
        .otherwise(markup(
            '<div class="row product" aria-label="Auction item" data-pristine-'
            'product-venue-id="{lot}" data-pristine-title="{title}"><a class='
            '"title" href="/a/{lot}">x</a><i class="high-bid" data-high-bid='
            '"{price}"></i><i data-pristine-end-time="{end}"></i></div>')))
    shop = F.when(F.col("site") == "ebay", F.lit(
        '<li class="s-item"><div class="s-item__title">Shop on eBay</div>'
        '<span class="s-item__price">$1.00</span></li>')).otherwise("")
    return rows.groupBy("site", "page_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("row_id", block.alias("b")))),
        lambda x: x["b"]), "").alias("b")).select(
        "site", "page_id", F.concat(F.lit("<html><body>"), shop, "b", F.lit(
            "</body></html>")).alias("html"))


def captured(spark, sf_dir):
    return captures.lots(shown_pages(spark, sf_dir),
                         captures.default_rules(spark),
                         captures.default_venues(spark), now())


PREFIX = """CASE site WHEN 'ebay' THEN 'https://www.ebay.com/itm/' || lot ||
 '?hash=x' WHEN 'yahoo_jp' THEN 'https://buyee.jp/item/jdirectitems/auction/' ||
 lot WHEN '130point' THEN 'https://130point.com/s/' || lot WHEN 'heritage' THEN
 'https://sports.ha.com/itm/' || lot ELSE
 'https://www.pristineauction.com/a/' || lot END"""
LOTS = f"""{ctes('listings')}, shown AS ({SHOWN.format(listings='listings')}),
 ok AS (SELECT *, row_number() OVER (PARTITION BY site, lot ORDER BY page_id)
 AS n FROM shown WHERE price IS NOT NULL AND (site IN ('ebay', '130point',
 'heritage') OR end_s > {AS_OF})), lots AS (SELECT site, CASE site WHEN
 '130point' THEN 'https://130point.com/s/' || lot WHEN 'heritage' THEN '/itm/'
 || lot ELSE lot END AS lot_id, title, {PREFIX} AS url, price * CASE WHEN site =
 'yahoo_jp' THEN 63e-4 ELSE 1e0 END AS current_price, CASE WHEN site = 'ebay'
 THEN 5e0 END AS shipping, CASE WHEN site IN ('ebay', 'yahoo_jp') THEN bids
 ELSE 0 END AS bid_count, CASE WHEN site IN ('yahoo_jp', 'pristine') THEN end_s
 END AS end_s FROM ok WHERE n = 1)"""


@query("captured_lots", "S8", f"""{LOTS}
SELECT * FROM lots""")
def captured_lots(spark, sf_dir):
    """Lots of five sites' result pages, read by one table of rules."""
    return captured(spark, sf_dir).select(
        "site", "lot_id", "title", "url", "current_price", "shipping",
        "bid_count", F.unix_seconds("end_time").alias("end_s"))


def venue_sql() -> str:
    rows = ", ".join(f"({', '.join(repr(v).lower() if isinstance(v, bool) else f'{v!r}' if isinstance(v, str) else f'{v!r}e0' for v in row)})"
                     for row in captures.VENUE_ROWS)
    names = ", ".join(("site", "currency", "prefix", "sold_pages",
                       *(f"d_{c}" for c in captures.COSTS)))
    filled = ", ".join(f"d_{c} AS {c}" for c in captures.COSTS[1:])
    return f"""{LOTS}, v({names}) AS (VALUES {rows}), filled AS (SELECT site,
 lot_id, current_price, coalesce(shipping, d_shipping) AS shipping, {filled}
 FROM lots JOIN v USING (site))
SELECT site, lot_id, shipping, {LANDED_SQL} AS landed_cost FROM filled"""


@query("venue_costs", "S11", venue_sql())
def venue_costs(spark, sf_dir):
    """Landed cost of captured lots, blank costs filled from the venue."""
    rows = captures.with_venue_costs(captured(spark, sf_dir),
                                     captures.default_venues(spark))
    return rows.select("site", "lot_id", "shipping", economics.landed_cost(
        "current_price").alias("landed_cost"))
