"""Queries over sources, targets, wanted items and planning."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..config import DEFAULT
from ..functions import identity, text
from ..operators import planning, rank, relevance, resolve, wanted
from ..sources import feeds, guide_files, targets
from ..sources.adapters import ctes, table, view
from . import duck
from .guide_queries import parsed_titles
from .listing_queries import PREPARED, prepared
from .registry import query
from .text_queries import TITLES


def feed_items(spark, sf_dir):
    """Every listing as one feed item in JSON, under changing aliases."""
    k = F.split_part("row_id", F.lit("-"), F.lit(3)).cast("long")
    rows = view(spark, sf_dir, "listings")
    price = F.col("current_price").cast("string")
    return rows.select(
        "row_id", F.to_json(F.struct(
            "title", F.col("row_id").alias("uuid"),
            F.when(k % 7 != 0, F.col("url")).alias("listing_url"),
            F.when(k % 2 == 0, F.concat(F.lit("$"), price)).alias("price"),
            F.when(k % 2 == 1, price).alias("currentBid"),
            F.when(k % 5 == 0, "sold").when(k % 5 == 1, "Active")
            .alias("status"),
            F.when(F.col("listing_type") == "fixed", "buy-now").otherwise(
                "weekly").alias("type"),
            F.when(k % 3 == 0, "20").alias("buyerFeeRate"),
            F.when(k % 4 == 0, F.concat(F.lit("00-"), k.cast("string"))
                   ).alias("certNumber"),
            F.lit("P.S.A").alias("grader"))).alias("item"))


@query("feed_listings", "S1 S4", f"""{ctes('listings')}, f AS (SELECT *,
 CAST(split_part(row_id, '-', 3) AS BIGINT) AS k FROM listings WHERE
 listing_type = 'auction')
SELECT row_id, title, current_price, CASE WHEN k % 4 = 0 THEN concat('psa:00',
 k) ELSE '' END AS canonical_asset_id, CASE WHEN k % 3 = 0 THEN 2e-1 ELSE
 25e-2 END AS buyer_fee_rate FROM f WHERE k % 5 <> 0 AND k % 7 <> 0""")
def feed_listings(spark, sf_dir):
    items = feed_items(spark, sf_dir)
    return feeds.listings(items, feeds.json_fields(F.col("item")), "venue",
                          "auction", 0.25, ("row_id",)).select(
        "row_id", "title", "current_price", "canonical_asset_id",
        "buyer_fee_rate")


MANIFEST = {
    "id": "house", "display_name": "House", "capabilities": ["auctions"],
    "field_map": {"title": "lot.name", "url": "lot.href",
                  "current_price": "money.bid", "bid_count": "money.count"},
    "economics": {"auction_buyer_fee_rate": 0.2, "shipping": 12},
}


@query("manifest_listings", "S2 S3", f"""{ctes('listings')}
SELECT row_id, title, current_price, bid_count, 2e-1 AS buyer_fee_rate,
 12e0 AS shipping, 'HOUSE' AS marketplace FROM listings""")
def manifest_listings(spark, sf_dir):
    assert not feeds.validate_manifest(MANIFEST)
    items = view(spark, sf_dir, "listings").select("row_id", F.to_json(
        F.struct(F.struct(F.col("title").alias("name"),
                          F.col("url").alias("href")).alias("lot"),
                 F.struct(F.col("current_price").alias("bid"),
                          F.col("bid_count").alias("count")
                          ).alias("money"))).alias("item"))
    fields = feeds.manifest_fields(F.col("item"), MANIFEST, "auction")
    return feeds.listings(items, fields, "house", keep=("row_id",)).select(
        "row_id", "title", "current_price", "bid_count", "buyer_fee_rate",
        "shipping", "marketplace")


@query("export_prematch", "S5", f"""{TITLES}, w AS (SELECT *, list_filter(
 regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: len(x) > 2) AS ws
 FROM titles)
SELECT title, query FROM w WHERE len(ws) > 0 AND len(list_filter(ws, lambda x:
 contains(lower(title), x))) >= greatest(1, ceil(len(ws) * 0.5))""")
def export_prematch(spark, sf_dir):
    words = text.find_all(F.lower("query"), "[a-z0-9]+")
    return view(spark, sf_dir, "titles").filter(feeds.matches_export(
        F.col("title"), words, None, F.col("query"))).select("title", "query")


CURRENCY = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' "
            "THEN 'GBP' WHEN '3-MEDIUM' THEN 'JPY' WHEN '5-LOW' THEN 'USD' "
            "ELSE 'XXX' END")


@query("fx_amounts", "S10", f"""
SELECT o_orderkey, o_totalprice * CASE {CURRENCY} WHEN 'EUR' THEN 108e-2 WHEN
 'GBP' THEN 127e-2 WHEN 'JPY' THEN 63e-4 ELSE 1e0 END AS usd FROM orders""")
def fx_amounts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", feeds.usd(
        F.col("o_totalprice").cast("string"), F.expr(CURRENCY)).alias("usd"))


BLOCK = '<li><a href="[^"]*">[^<]*</a></li>'
LINK = {"link": 'href="([^"]*)"', "label": '">([^<]*)</a>'}


@query("captured_blocks", "S8", f"""
WITH b AS (SELECT page_id, unnest(range(0, len(x))) AS position, x FROM (SELECT
 page_id, regexp_extract_all(html, '{BLOCK}', 0) AS x FROM pages))
SELECT page_id, position, nullif(regexp_extract(x[position + 1],
 '{LINK["link"]}', 1), '') AS link, nullif(regexp_extract(x[position + 1],
 '{LINK["label"]}', 1), '') AS label FROM b""")
def captured_blocks(spark, sf_dir):
    return feeds.extract(table(spark, sf_dir, "pages"), BLOCK, LINK)


MARKS = """CASE page_id % 6 WHEN 0 THEN 'Winning bid: US $1,250.50 now' WHEN 1
 THEN 'Sold for about $99' WHEN 2 THEN 'The item went unsold' WHEN 3 THEN
 'This listing has ended.' ELSE '' END"""


@query("close_prices", "S20", f"""
WITH p AS (SELECT page_id, concat({MARKS}, html) AS body FROM pages)
SELECT page_id, CASE WHEN {duck.contains_any('lower(body)',
 vocab.CHALLENGE)} THEN NULL ELSE coalesce({', '.join(
 f"TRY_CAST(replace(regexp_extract(body, {duck.lit('(?is)' + p)}, 1), ',', '') AS DOUBLE)"
 for p in vocab.SOLD_PRICE)}, CASE WHEN regexp_matches(body,
 {duck.lit('(?i)' + vocab.UNSOLD)}) OR regexp_matches(body,
 {duck.lit('(?i)' + vocab.ENDED)}) THEN 0e0 END) END AS price FROM p""")
def close_prices(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn(
        "body", F.concat(F.expr(MARKS), F.col("html")))
    return pages.select("page_id", feeds.close_price("body").alias("price"))


@query("sold_cards", "S9", f"""{ctes('sales')}
SELECT sale_id, title, price + 5e0 AS price, coalesce(
 CASE WHEN sold_s % 5 <> 0 THEN sold_s END, scanned_s) AS sold_s FROM sales
WHERE site <> 'goldin' AND len(title) >= 15""")
def sold_cards(spark, sf_dir):
    cards = view(spark, sf_dir, "sales").withColumns({
        "currency": F.when(F.col("site") == "goldin", "EUR"),
        "shipping": F.lit(5.0), "sold_at": F.timestamp_seconds(
            F.when(F.col("sold_s") % 5 != 0, F.col("sold_s")))})
    return feeds.sold(cards, F.timestamp_seconds("scanned_s")).select(
        "sale_id", "title", "price", F.unix_seconds("sold_at"
                                                    ).alias("sold_s"))


def guide_text(spark, sf_dir):
    """The catalogue as untyped file rows; one file is mostly games."""
    c = view(spark, sf_dir, "catalogue")
    dollars = F.concat(F.lit("$"), (F.col("loose_price") / 100).cast("string"))
    return c.select(
        F.col("product_id").alias("id"),
        F.col("product_name").alias("product-name"),
        F.col("console_name").alias("console-name"),
        dollars.alias("loose-price"),
        F.col("cib_price").cast("string").alias("cib-price"),
        F.col("genre"), F.col("sales_volume").cast("string"
                                                   ).alias("sales-volume"),
        F.when(F.col("console_name").contains("Nintendo"),
               "sportscardspro--a.csv").when(
            F.col("host") == "sports", "sportscardspro--b.csv").otherwise(
            "pricecharting--c.csv").alias("file"))


@query("guide_file_rows", "S12 S13", f"""{ctes('catalogue')}
SELECT product_id, loose_price, cib_price, sales_volume, CASE WHEN host =
 'sports' THEN 'sports' ELSE 'general' END AS host FROM catalogue WHERE NOT
 contains(console_name, 'Nintendo')""")
def guide_file_rows(spark, sf_dir):
    rows = guide_files.typed(guide_text(spark, sf_dir))
    return guide_files.accepted(rows).select(
        "product_id", "loose_price", "cib_price", "sales_volume", "host")


def target_rows(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.lit(None)
    return table(spark, sf_dir, "part").select(
        (1980 + F.col("p_size")).alias("year"), F.lit("Fleer").alias("set"),
        F.col("p_name").alias("player"), F.col("p_size").alias("number"),
        F.when(k % 4 == 0, "Gold").alias("parallel"),
        F.when(k % 9 == 0, "/99").alias("serial"),
        (k % 7 == 0).alias("auto"), (k % 11 == 0).alias("relic"),
        F.when(k % 3 == 0, F.concat(F.lit("BGS "), (k % 10 + 1).cast(
            "string"))).when(k % 3 == 1, (k % 10 + 1).cast("string")
                             ).alias("grade"),
        F.when(k % 3 == 2, F.when(k % 2 == 0, F.array(
            F.lit("PSA 8"), F.lit("SGC 92"))).otherwise(F.array(
                F.lit("raw"), F.lit("")))).alias("grades"),
        F.when(k % 13 == 0, F.array(F.lit(9.0), F.lit(6.0))).alias("band"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(none.cast("double")
                                                 ).alias("min_value"),
        k.alias("ord"))


@query("target_queries", "S16", """
WITH t AS (SELECT *, p_partkey AS k, p_partkey % 10 + 1 AS g FROM part),
 e AS (SELECT k, concat_ws(' ', 1980 + p_size, 'Fleer', p_name, concat('#',
 p_size), CASE WHEN k % 4 = 0 THEN 'Gold' END, CASE WHEN k % 9 = 0 THEN '/99'
 END, CASE WHEN k % 7 = 0 THEN 'Auto' END, CASE WHEN k % 11 = 0 THEN 'Patch'
 END) AS q, CASE WHEN k % 13 = 0 THEN 6e0 WHEN k % 3 < 2 THEN greatest(1e0, g -
 1) WHEN k % 2 = 0 THEN 8e0 END AS lo, CASE WHEN k % 13 = 0 THEN 9e0 WHEN k % 3
 < 2 THEN least(1e1, g + 2) WHEN k % 2 = 0 THEN 85e-1 END AS hi FROM t)
SELECT k AS ord, q AS query, lo AS grade_min, hi AS grade_max, CASE WHEN k % 5 =
 0 THEN 0e0 ELSE 1e2 END AS value_floor_override FROM e WHERE lo IS NOT NULL
UNION ALL SELECT k, q || ' raw', NULL, NULL, NULL FROM e WHERE lo IS NULL
UNION ALL SELECT k, q, NULL, NULL, NULL FROM e WHERE lo IS NULL""")
def target_queries(spark, sf_dir):
    return targets.expand(target_rows(spark, sf_dir)).select(
        "ord", "query", "grade_min", "grade_max", "value_floor_override")


ENTRIES = """entries AS (SELECT query, CAST(NULL AS DOUBLE) AS
 value_floor_override, max_buy_price, priority, set_need, structured_target,
 discovery, ord + 1000000 AS ord FROM standing_queries UNION ALL SELECT
 upper(query), value_floor_override, CAST(NULL AS DOUBLE), discovery,
 structured_target, false, false, ord FROM standing_queries WHERE ord % 2 = 0)
"""


@query("merged_queries", "S17 U1", f"""{ctes('standing_queries')}, {ENTRIES}
SELECT arg_min(query, ord) AS query, arg_min(value_floor_override, ord)
 FILTER (WHERE value_floor_override IS NOT NULL) AS value_floor_override,
 arg_min(max_buy_price, ord) FILTER (WHERE max_buy_price IS NOT NULL) AS
 max_buy_price, bool_or(priority) AS priority, bool_or(set_need) AS set_need,
 bool_or(structured_target) AS structured_target, arg_min(discovery, ord) AS
 discovery, min(ord) AS ord FROM entries GROUP BY lower(query)""")
def merged_queries(spark, sf_dir):
    q = view(spark, sf_dir, "standing_queries")
    names = ["query", "value_floor_override", "max_buy_price", "priority",
             "set_need", "structured_target", "discovery", "ord"]
    watch = q.withColumns({"value_floor_override": F.lit(None).cast("double"),
                           "ord": F.col("ord") + 1000000}).select(*names)
    needs = q.filter(F.col("ord") % 2 == 0).select(
        F.upper("query").alias("query"), "value_floor_override",
        F.lit(None).cast("double").alias("max_buy_price"),
        F.col("discovery").alias("priority"),
        F.col("structured_target").alias("set_need"),
        F.lit(False).alias("structured_target"),
        F.lit(False).alias("discovery"), "ord")
    return targets.merge(watch.unionByName(needs)).select(*names)


def wanted_list(spark, sf_dir):
    """Catalogue names as a wanted list; position by name."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(
        F.min("p_partkey").alias("k"))
    # a configured list: its length is read once
    size = names.count()
    return targets.wanted_items(names.select(
        F.concat(F.col("p_name"), F.when(F.col("k") % 3 == 0, " signed"
                                         ).when(F.col("k") % 3 == 1,
                                                " first edition"
                                                ).otherwise("")
                 ).alias("name"),
        F.col("k").alias("position"), F.when(
            F.col("k") % 10 == 0, F.lit(55.0)).alias("weight"),
        F.when(F.col("k") % 4 == 0, F.lit(1500.0)).alias("max_price")), size)


ITEMS = f"""wl AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1),
 items AS (SELECT concat(p_name, CASE k % 3 WHEN 0 THEN ' signed' WHEN 1 THEN
 ' first edition' ELSE '' END) AS name, k AS position, coalesce(CASE WHEN k % 10
 = 0 THEN 55e0 END, round(1e2 - 6e1 * k / greatest((SELECT count(*) FROM wl) -
 1, 1), 1)) AS score, CASE WHEN k % 4 = 0 THEN 15e2 END AS max_price FROM wl)"""


def wanted_words(e: str) -> str:
    from .text_queries import replace_sql
    return (f"list_distinct(regexp_extract_all({replace_sql(duck.folded(e), vocab.WANTED_PHRASES)}"
            ", '[a-z0-9]+'))")


SYN = duck.case([(f"list_contains({duck.words(g)}, tok)", duck.words(g))
                 for g in vocab.WANTED_SYNONYMS], "[tok]")


@query("wanted_matches", "S21 J14", f"""{TITLES}, {ITEMS}, tt AS (SELECT title,
 any_value({wanted_words('title')}) AS tw FROM titles GROUP BY title), gi AS
 (SELECT name, score, position, max_price, list_transform({wanted_words('name')},
 lambda tok: {SYN}) AS gs FROM items), hit AS (SELECT title, g.*, row_number()
 OVER (PARTITION BY title ORDER BY score DESC, position) AS n FROM tt, gi g
 WHERE len(list_filter(gs, lambda x: list_has_any(x, tw))) = len(gs))
SELECT title, name AS wanted, score AS wanted_score, max_price FROM hit
WHERE n = 1""")
def wanted_matches(spark, sf_dir):
    return wanted.tag(view(spark, sf_dir, "titles"),
                      wanted_list(spark, sf_dir))


@query("new_wanted_queries", "U2", f"""{ctes('standing_queries')}, {ITEMS}
SELECT name FROM items WHERE lower(name) NOT IN (SELECT lower(query) FROM
 standing_queries)""")
def new_wanted_queries(spark, sf_dir):
    return planning.new_queries(wanted_list(spark, sf_dir), view(
        spark, sf_dir, "standing_queries")).select("name")


@query("sweep_queries", "S18", f"""{ctes('standing_queries')}, g AS (SELECT *,
 list_filter({duck.grade_tokens('lower(query)')}, lambda x: x.grade IS NOT
 NULL)[1] AS gi FROM standing_queries)
SELECT query FROM g WHERE priority OR gi IS NOT NULL""")
def sweep_queries(spark, sf_dir):
    """Queries of a fixed-price sweep: priority ones and those with a grade."""
    return relevance.sweep_queries(view(spark, sf_dir, "standing_queries")
                                   ).select("query")


@query("warm_queries", "K7", f"""{ctes('standing_queries', 'sales')}
SELECT query, ord FROM standing_queries WHERE NOT priority AND query NOT IN
 (SELECT query FROM sales WHERE site = 'ebay' AND price > 2000) ORDER BY ord,
 query """)
def warm_queries(spark, sf_dir):
    watch = view(spark, sf_dir, "standing_queries").select(
        "query", "ord", "priority")
    cached = view(spark, sf_dir, "sales").filter(
        (F.col("site") == "ebay") & (F.col("price") > 2000))
    return planning.warm_queries(watch, watch.filter("priority"), cached
                                 ).select("query", "ord")


VALUATION = f"""{PREPARED}, pv AS (SELECT *, {duck.category('query')} AS
 category FROM prepared), pl AS (SELECT DISTINCT title FROM pv), pq AS (SELECT
 DISTINCT query AS qtext FROM pv), {duck.identity('pl', 'title', 't')},
 {duck.identity('pq', 'qtext', 'q')}, tq AS (SELECT p.*, CASE WHEN p.discovery
 THEN CASE WHEN t.object_class = 'card' AND t.number IS NOT NULL AND t.grade IS
 NOT NULL AND {duck.specificity('t.')} >= 0.8 THEN concat_ws(' ',
 {duck.guide_phrase('lower(t.title)', 't.')}, upper(t.grader),
 {duck.num('t.printed_grade')}) END WHEN t.card_number IS NOT NULL AND
 (coalesce(q.effective, 5e0) <> coalesce(t.effective, 5e0) OR (q.card_number IS
 NULL) OR (len(q.subject_all) = 0 AND len(t.subject) > 0)) THEN concat_ws(' ',
 trim(regexp_replace(regexp_replace(p.query, {duck.lit('(?i)' + vocab.GRADE_TOKEN)},
 ' ', 'g'), '\\s+', ' ', 'g')), CASE WHEN len(q.subject_all) = 0 THEN
 nullif(array_to_string(t.subject, ' '), '') END, CASE WHEN q.card_number IS
 NULL THEN '#' || t.card_number END, nullif(concat_ws(' ', upper(t.grader),
 {duck.num('t.printed_grade')}), '')) END AS targeted_query
 FROM pv p JOIN t ON t.title = p.title JOIN q ON q.qtext = p.query)"""


@query("targeted_lookups", "W7 V13", f"""{VALUATION}, u AS (SELECT
 targeted_query, min((NOT priority, coalesce(CASE WHEN listing_type = 'fixed'
 THEN age_hours ELSE hours_remaining END, 1e9), landed)) AS r FROM tq WHERE
 category IN ('Pokemon Cards', 'Sports Cards') AND targeted_query IS NOT NULL
 GROUP BY 1)
SELECT targeted_query, r[2] AS timing, r[3] AS cost FROM u ORDER BY r,
 targeted_query""")
def targeted_lookups(spark, sf_dir):
    rows = prepared(spark, sf_dir).withColumn("category",
                                              text.category("query"))
    return planning.plan_lookups(rows).select("targeted_query", "timing",
                                                   "cost")


@query("class_histogram", "A23", f"""{TITLES},
 {duck.identity('titles', 'title', 'i')}, c AS (SELECT object_class,
 {duck.category('query', 'object_class')} AS category FROM i)
SELECT object_class, category, count(*) AS titles FROM c GROUP BY 1, 2""")
def class_histogram(spark, sf_dir):
    rows = view(spark, sf_dir, "titles").select("title", "query").distinct()
    return identity.with_identity(rows, "title", "i", ("object_class",)
                                  ).groupBy(
        F.col("i.object_class").alias("object_class"),
        text.category("query", "i.object_class").alias("category")
    ).agg(F.count("*").alias("titles"))


@query("corpus_invariants", "Q1")
def corpus_invariants(spark, sf_dir):
    """Rule violations over every title (expected: none)."""
    rows, parsed = parsed_titles(spark, sf_dir)
    # a quote depends on its own title only, and the rule on quotes reads
    # those of memorabilia
    quotes = resolve.resolve(
        rows.filter(F.col("category") == "Sports Memorabilia"),
        view(spark, sf_dir, "catalogue"), parsed=parsed)
    return planning.invariants(rows, quotes)


@query("source_precedence", "", f"""{ctes('valued')}, q AS (SELECT title,
 category, CASE WHEN bid_count % 2 = 0 THEN 'local' ELSE 'remote' END AS source,
 confidence AS score, match IN ('exact', 'strong') AND guide_value IS NOT NULL
 AS landed, row_id FROM valued), m AS (SELECT title, category, source,
 max(score) AS score, bool_or(landed) AS landed FROM q GROUP BY 1, 2, 3)
SELECT title, category, source, score, landed FROM (SELECT *, row_number() OVER
 (PARTITION BY title, category ORDER BY NOT landed, CASE WHEN landed THEN CASE
 source WHEN 'local' THEN 0 ELSE 1 END ELSE 0 END, -score, CASE source WHEN
 'local' THEN 0 ELSE 1 END) AS n FROM m) WHERE n = 1""")
def source_precedence(spark, sf_dir):
    rows = view(spark, sf_dir, "valued").select(
        "title", "category", F.when(F.col("bid_count") % 2 == 0, "local"
                                    ).otherwise("remote").alias("source"),
        F.col("confidence").alias("score"),
        (F.col("match").isin("exact", "strong")
         & F.col("guide_value").isNotNull()).alias("landed"))
    quotes = rows.groupBy("title", "category", "source").agg(
        F.max("score").alias("score"), F.bool_or("landed").alias("landed"))
    return planning.first_landed(quotes, {"local": 0, "remote": 1})
