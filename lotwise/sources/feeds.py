"""Listing feeds and captured pages to listing rows."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text
from . import csv_files

# ---------------------------------------------------------------- fixed values
ALIASES = {
    "title": ("title",),
    "listing_id": ("listing_id", "listingId", "id", "uuid"),
    "url": ("url", "listing_url"),
    "current_price": ("current_price", "currentPrice", "current_bid",
                      "currentBid", "price"),
    "shipping": ("shipping", "shipping_cost"),
    "bid_count": ("bid_count", "bidCount"),
    "end_time": ("end_time", "endTime"),
    "image_url": ("image_url", "imageUrl"),
    "status": ("status",),
    "listing_type": ("listing_type", "listingType", "type"),
    "currency": ("currency",),
    "marketplace": ("marketplace",),
    "best_offer": ("best_offer", "bestOffer"),
    "buyer_fees": ("buyer_fees", "buyerFees"),
    "buyer_fee_rate": ("buyer_fee_rate", "buyerFeeRate"),
    "minimum_buyer_fee": ("minimum_buyer_fee", "minimumBuyerFee"),
    "international_shipping": ("international_shipping",
                               "internationalShipping"),
    "insurance_rate": ("insurance_rate", "insuranceRate"),
    "insurance_on_buyer_fee": ("insurance_on_buyer_fee",
                               "insuranceOnBuyerFee"),
    "import_duty_rate": ("import_duty_rate", "importDutyRate"),
    "fx_spread_rate": ("fx_spread_rate", "fxSpreadRate"),
    "canonical_asset_id": ("canonical_asset_id", "canonicalAssetId"),
    "certificate": ("certificate_number", "certificateNumber",
                    "cert_number", "certNumber"),
    "grader": ("grader", "grading_company"),
}
LIVE = ("live", "active", "open", "listed")
FIXED_TYPES = ("buy_now", "buy-now", "bin", "marketplace")
AUCTION_TYPES = ("weekly", "premier", "lot")
MANIFEST_KEYS = ("schema_version", "id", "display_name", "enabled",
                 "capabilities", "access", "field_map", "economics", "notes")
ECONOMIC_KEYS = ("buyer_fee_rate", "auction_buyer_fee_rate",
                 "fixed_buyer_fee_rate", "minimum_buyer_fee", "shipping",
                 "insurance_rate", "insurance_on_buyer_fee",
                 "international_shipping", "import_duty_rate",
                 "fx_spread_rate", "marketplace")
SECRET_KEYS = ("api_key", "access_token", "token", "password", "secret",
               "client_secret")
CAPABILITIES = ("auctions", "fixed", "sold", "guide")
# ------------------------------------------------------------ end fixed values


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def number(value: Column) -> Column:
    return F.regexp_replace(value, "[$,]", "").try_cast("double")


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("1", "true", "yes", "y", "on"),
                      F.lit(False))


def json_fields(item: Column) -> dict[str, Column]:
    """Canonical fields of a JSON text column, by alias."""
    return {name: F.coalesce(*[blank_to_null(F.get_json_object(
        item, f"$.{alias}")) for alias in aliases])
        for name, aliases in ALIASES.items()}


def manifest_fields(item: Column, manifest: dict, kind: str
                    ) -> dict[str, Column]:
    """Fields mapped by a manifest's dotted paths, on top of the aliases;
    its economics fill only what the feed leaves blank."""
    out = json_fields(item)
    for name, path in manifest["field_map"].items():
        mapped = blank_to_null(F.get_json_object(item, f"$.{path}"))
        out[name] = F.coalesce(mapped, out.get(name, mapped))
    economics = manifest.get("economics") or {}
    rate = economics.get(f"{kind}_buyer_fee_rate",
                         economics.get("buyer_fee_rate"))
    defaults = {**{k: economics.get(k) for k in ECONOMIC_KEYS
                   if k in out}, "buyer_fee_rate": rate, "status": "live",
                "listing_type": kind}
    defaults["marketplace"] = (economics.get("marketplace")
                               or manifest["id"].upper())
    for name, value in defaults.items():
        if value is not None:
            out[name] = F.coalesce(out[name], F.lit(str(value)))
    return out


def listings(items: DataFrame, fields: dict[str, Column], site: str,
             kind: str = "auction", premium: float = 0.0,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed listing rows of one kind; sold, unpriced and untitled items are
    dropped.  Premiums above 1 are percentages."""
    raw = items.select(*keep, *[c.alias(n) for n, c in fields.items()])
    declared = F.lower(F.coalesce("listing_type", F.lit(kind)))
    type_ = F.when(declared.isin(*FIXED_TYPES), "fixed").when(
        declared.isin(*AUCTION_TYPES), "auction").otherwise(declared)
    rate = F.coalesce(number(F.col("buyer_fee_rate")), F.lit(
        premium if kind == "auction" else 0.0))

    def bare(name):
        return F.lower(F.regexp_replace(F.col(name), "[^a-zA-Z0-9]", ""))

    def amount(name):
        return F.coalesce(number(F.col(name)), F.lit(0.0))

    asset = F.coalesce(F.lower("canonical_asset_id"), F.when(
        (bare("certificate") != "") & (bare("grader") != ""),
        F.concat(bare("grader"), F.lit(":"), bare("certificate"))))
    price = number(F.col("current_price"))
    rows = raw.withColumn("listing_type", type_).filter(
        F.lower(F.coalesce("status", F.lit("live"))).isin(*LIVE)
        & (F.col("listing_type") == kind) & F.col("title").isNotNull()
        & F.col("url").isNotNull() & (price >= 0))
    return rows.select(
        *keep, F.lit(site).alias("site"), "title", "url",
        price.alias("current_price"), amount("shipping").alias("shipping"),
        amount("bid_count").cast("int").alias("bid_count"),
        F.try_to_timestamp("end_time").alias("end_time"), "listing_id",
        F.coalesce(asset, F.lit("")).alias("canonical_asset_id"),
        "listing_type", flag(F.col("best_offer")).alias("best_offer"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.coalesce("marketplace", F.lit(site.upper())).alias("marketplace"),
        amount("buyer_fees").alias("buyer_fees"),
        F.greatest(F.lit(0.0), F.when(rate > 1, rate / 100).otherwise(rate)
                   ).alias("buyer_fee_rate"),
        amount("minimum_buyer_fee").alias("minimum_buyer_fee"),
        amount("international_shipping").alias("international_shipping"),
        amount("insurance_rate").alias("insurance_rate"),
        flag(F.col("insurance_on_buyer_fee")
             ).alias("insurance_on_buyer_fee"),
        amount("import_duty_rate").alias("import_duty_rate"),
        amount("fx_spread_rate").alias("fx_spread_rate"))


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed JSON captures ({"items": [...]} or a bare list), one
    row each as JSON text."""
    raw = spark.read.text(path, wholetext=True)
    array = F.when(F.ltrim("value").startswith("["), F.col("value")
                   ).otherwise(F.get_json_object("value", "$.items"))
    return raw.select(F.explode(F.from_json(array, "array<string>")
                                ).alias("item"))


def csv_items(spark: SparkSession, path: str) -> DataFrame:
    """Rows of landed CSV captures as JSON text, each by its file's header."""
    return reduce(DataFrame.unionByName, [
        t.select(F.to_json(F.struct(*[c for c in t.columns if c != "file"])
                           ).alias("item"))
        for t in csv_files.tables(spark, path)])


def validate_manifest(data: dict) -> list[str]:
    """Problems of a source manifest; empty when it can be used."""
    problems = []

    def secrets(value, path):
        if isinstance(value, dict):
            for key, child in value.items():
                if key.lower() in SECRET_KEYS and child not in (None, ""):
                    problems.append(f"{path}.{key}: embedded secret")
                secrets(child, f"{path}.{key}")
        elif isinstance(value, list):
            for i, child in enumerate(value):
                secrets(child, f"{path}[{i}]")

    secrets(data, "manifest")
    problems += [f"unknown field {k}" for k in sorted(
        set(data) - set(MANIFEST_KEYS))]
    if not re.fullmatch(r"[a-z][a-z0-9_]{1,40}", str(data.get("id") or "")):
        problems.append("bad id")
    stated = data.get("capabilities") or []
    if not stated or set(map(str.lower, stated)) - set(CAPABILITIES):
        problems.append("bad capabilities")
    mapping = data.get("field_map") or {}
    problems += [f"field_map.{k} is required"
                 for k in ("title", "url", "current_price")
                 if not mapping.get(k)]
    for key, value in (data.get("economics") or {}).items():
        if key not in ECONOMIC_KEYS:
            problems.append(f"unknown economics {key}")
        elif key not in ("insurance_on_buyer_fee", "marketplace"):
            try:
                float(value)
            except (TypeError, ValueError):
                problems.append(f"economics.{key} must be numeric")
    return problems


# ------------------------------------------------------------ captured payloads
SUMMARY = """itemId string, title string, itemWebUrl string,
 buyingOptions array<string>, bidCount int, itemEndDate string,
 itemCreationDate string, currentBidPrice struct<value:string,currency:string>,
 price struct<value:string,currency:string>, shippingOptions
 array<struct<shippingCost:struct<value:string,currency:string>>>,
 seller struct<feedbackScore:string>"""


def usd(amount: Column, currency: Column, rates: dict | None = None
        ) -> Column:
    """Dollars at the configured rate; unknown currencies count as dollars."""
    rate = F.lit(1.0)
    for code, value in (rates or vocab.DEFAULT_FX).items():
        rate = F.when(currency == code, F.lit(float(value))).otherwise(rate)
    return F.coalesce(amount.try_cast("double"), F.lit(0.0)) * rate


def summaries(payloads: DataFrame, rates: dict | None = None) -> DataFrame:
    """Browse payloads (one JSON text `payload` per row) to listings."""
    items = payloads.select("query", F.explode(F.from_json(
        F.get_json_object("payload", "$.itemSummaries"),
        f"array<struct<{_struct(SUMMARY)}>>")).alias("i"))
    auction = F.coalesce(F.array_contains("i.buyingOptions", "AUCTION"),
                         F.lit(False))
    hybrid = auction & F.array_contains("i.buyingOptions", "FIXED_PRICE")
    money = F.when(auction, F.coalesce("i.currentBidPrice", "i.price")
                   ).otherwise(F.col("i.price"))
    ship = F.get(F.col("i.shippingOptions"), F.lit(0))["shippingCost"]
    price = usd(money["value"], money["currency"], rates)
    return items.filter(F.coalesce("i.title", F.lit("")) != "").select(
        "query", F.col("i.itemId").alias("listing_id"),
        F.col("i.title").alias("title"), F.col("i.itemWebUrl").alias("url"),
        price.alias("current_price"),
        usd(ship["value"], ship["currency"], rates).alias("shipping"),
        F.coalesce("i.bidCount", F.lit(0)).alias("bid_count"),
        F.try_to_timestamp("i.itemEndDate").alias("end_time"),
        F.try_to_timestamp("i.itemCreationDate").alias("created_at"),
        F.when(auction, "auction").otherwise("fixed").alias("listing_type"),
        hybrid.alias("has_buy_now"),
        F.when(hybrid, usd(F.col("i.price.value"), F.col("i.price.currency"),
                           rates)).otherwise(F.lit(0.0)
                                             ).alias("buy_now_price"),
        F.col("i.seller.feedbackScore").try_cast("int"
                                                 ).alias("seller_feedback")
    ).filter(F.col("current_price") > 0)


def _struct(ddl: str) -> str:
    """'a string, b int' to 'a:string,b:int' for a nested type."""
    return re.sub(r"(\w+) (array<|struct<|string|int)", r"\1:\2",
                  " ".join(ddl.split()))


# ---------------------------------------------------------------- fixed values
# Words of single cards, and of lots that are not single cards.
SINGLE = (r"(?i)\b(card|topps|bowman|fleer|panini|pokemon|upper deck|donruss|"
          r"prizm|psa|bgs|sgc)\b")
NOT_SINGLE = (r"(?i)\b(box|case|pack|wax|jersey|helmet|shoe|bat|ball|puck|"
              r"ticket|memorabilia|game-used|game used|watch|poster|print)\b")
# ------------------------------------------------------------ end fixed values


def live_lots(lots: DataFrame, minimum_fee: float = 19.0,
              small: float = 6.0, large: float = 19.0) -> DataFrame:
    """Live auction-house lots: premium in percent with a minimum, shipping
    by price realised (single cards under 1,000 ship cheaply)."""
    price = F.coalesce(F.nullif("current_price", F.lit(0.0)),
                       "min_bid_price", F.lit(0.0))
    rate = F.greatest(F.lit(0.0), F.coalesce("buyer_premium", F.lit(0.0))
                      ) / 100
    fee = F.greatest(price * rate, F.when(rate > 0, F.lit(minimum_fee)
                                          ).otherwise(F.lit(0.0)))
    single = F.col("title").rlike(SINGLE) & ~F.col("title").rlike(NOT_SINGLE)
    cheap = single & (price + fee < 1000)
    return lots.filter((F.lower("status") == "live")
                       & (F.coalesce("title", F.lit("")) != "")).select(
        "lot_id", "title", price.alias("current_price"),
        rate.alias("buyer_fee_rate"),
        F.when(rate > 0, F.lit(minimum_fee)).otherwise(F.lit(0.0)
                                                       ).alias("minimum_buyer_fee"),
        F.when(cheap, F.lit(small)).otherwise(F.lit(large)
                                              ).alias("shipping"))


def extract(pages: DataFrame, card: str, fields: dict[str, str],
            key: str = "page_id", html: str = "html") -> DataFrame:
    """Repeated blocks of captured pages: `card` cuts the blocks, each field
    is one pattern whose first group is its value.  First block wins per
    position; absent fields are NULL."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(
        html, F.lit(card), F.lit(0))).alias("position", "_block"))
    return blocks.select(key, "position", *[
        F.nullif(F.regexp_extract("_block", pattern, 1), F.lit("")
                 ).alias(name) for name, pattern in fields.items()])


def close_price(body) -> Column:
    """Winning price of a closed item's page: 0 when it went unsold or just
    ended, NULL when the page tells nothing (retry)."""
    raw = text.as_col(body)
    found = F.coalesce(*[F.regexp_replace(F.regexp_extract(
        raw, "(?is)" + p, 1), ",", "").try_cast("double")
        for p in vocab.SOLD_PRICE])
    ended = raw.rlike("(?i)" + vocab.UNSOLD) | raw.rlike("(?i)" + vocab.ENDED)
    return (F.when(text.contains_any(F.lower(raw), vocab.CHALLENGE),
                   F.lit(None).cast("double"))
            .when(found.isNotNull(), found).when(ended, F.lit(0.0)))


def sold(cards: DataFrame, scanned_at: Column) -> DataFrame:
    """Completed sales: real price in dollars, a real title; a missing sale
    date counts as the capture time."""
    return cards.filter(
        (F.col("price") > 0)
        & (F.upper(F.coalesce("currency", F.lit("USD"))) == "USD")
        & (F.length("title") >= 15)).withColumns({
            "price": F.col("price") + F.coalesce("shipping", F.lit(0.0)),
            "sold_at": F.coalesce("sold_at", scanned_at)})


def matches_export(title: Column, query_words: Column, tags: Column | None,
                   query: Column) -> Column:
    """Loose pre-match of an export row: tagged with the query, or half of
    the query's words (longer than two letters) occur in the title."""
    words = F.filter(query_words, lambda w: F.length(w) > 2)
    low = F.lower(title)
    hits = F.size(F.filter(words, lambda w: low.contains(w)))
    enough = (F.size(words) > 0) & (hits >= F.greatest(
        F.lit(1), F.ceil(F.size(words) * 0.5)))
    if tags is None:
        return enough
    tagged = F.exists(tags, lambda t: F.lower(t) == F.lower(query))
    return enough | F.coalesce(tagged, F.lit(False))
