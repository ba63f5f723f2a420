"""Portfolio marks and the trade ledger."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import economics, text
from ..functions.stage import stage
from . import rank

# ---------------------------------------------------------------- fixed values
# Ledger columns the user owns; a refresh never overwrites them.
USER_COLUMNS = (
    "status", "verified", "planned_bid_or_offer", "actual_purchase_price",
    "buyer_fees_paid", "shipping_paid", "tax_paid", "date_won",
    "date_received", "date_listed", "asking_price", "date_sold",
    "sale_proceeds", "notes")
STATUSES = ("Discovered", "Verified", "Watching", "Bid/Offer Placed", "Won",
            "Lost", "Received", "Listed", "Sold", "Passed")
TERMINAL = ("Lost", "Sold", "Passed")
# ------------------------------------------------------------ end fixed values


def money(value) -> Column:
    """Tolerant amount: '$1,200.50' is a number, anything else NULL."""
    return F.regexp_replace(F.trim(text.as_col(value)), "[$,]", ""
                            ).try_cast("double")


def day(value) -> Column:
    return F.try_to_date(F.substring(text.as_col(value), 1, 10))


def positions(raw: DataFrame) -> DataFrame:
    """Position rows from text columns; rows without a cost are dropped."""
    return raw.withColumns({
        "cost": money("cost_basis"), "bought": day("date_bought"),
        "sold": day("date_sold"), "proceeds": money("sale_proceeds")
    }).filter(F.col("cost") > 0)


def latest_fair(history: DataFrame, current: DataFrame | None = None
                ) -> DataFrame:
    """query (lower case) -> newest trusted value; this run's values, when
    given, override the history."""
    trusted = history.filter(F.col("trusted") == 1).select(
        F.lower("query").alias("query"), "fair", "seq", F.lit(0).alias("run"))
    if current is not None:
        trusted = trusted.unionByName(current.select(
            F.lower("query").alias("query"), "fair", "seq",
            F.lit(1).alias("run")))
    return trusted.groupBy("query").agg(F.max_by(
        "fair", F.struct("run", "seq")).alias("fair"))


def mark(held: DataFrame, fairs: DataFrame, as_of: Column,
         s: Settings = DEFAULT) -> DataFrame:
    """Open positions at net proceeds, closed ones realised; annual growth
    from the days held."""
    rows = held.join(fairs.withColumnRenamed("query", "_q"),
                     F.lower("query") == F.col("_q"), "left").drop("_q")
    closed = F.col("sold").isNotNull() & F.col("proceeds").isNotNull()
    rows = stage(rows, _closed=closed, _category=text.category("query"))
    rows = stage(rows, _exit=economics.best_exit(
        F.col("fair"), F.col("resale_channel"), F.col("_category"),
        F.col("description"), F.lit(False), F.lit(False), s))
    value = F.when(F.col("_closed"), F.col("proceeds")).when(
        F.col("fair") > 0, F.col("_exit.net"))
    end = F.coalesce("sold", F.to_date(as_of))
    days = F.greatest(F.datediff(end, F.col("bought")), F.lit(1))
    rows = rows.withColumns({"value": value, "days": days})
    ratio = F.col("value") / F.col("cost")
    return rows.select(
        *held.columns, F.when(F.col("_closed"), "SOLD").otherwise("OPEN"
                                                                 ).alias("state"),
        "value", (F.col("value") - F.col("cost")).alias("pnl"), "days",
        F.when((F.col("value") > 0) & (ratio > 0) & (ratio < 100),
               F.pow(ratio, F.lit(365.0) / F.col("days")) - 1).alias("cagr"))


def totals(marked: DataFrame) -> DataFrame:
    """Unmarked open positions count in cost but not in value."""
    is_open = F.col("state") == "OPEN"

    def exact(value):
        return F.coalesce(F.sum(value.cast("decimal(28,6)")).cast("double"),
                          F.lit(0.0))

    out = marked.agg(
        exact(F.when(is_open, F.col("cost"))).alias("open_cost"),
        exact(F.when(is_open, F.col("value"))).alias("open_value"),
        exact(F.when(~is_open, F.col("pnl"))).alias("realised"))
    return out.withColumn("unrealised",
                          F.col("open_value") - F.col("open_cost"))


def derive(rows: DataFrame) -> DataFrame:
    """Landed cost, realised profit and return, holding days."""
    def amount(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    landed = F.col("actual_purchase_price") + amount("buyer_fees_paid") \
        + amount("shipping_paid") + amount("tax_paid")
    profit = F.col("sale_proceeds") - F.col("actual_landed_cost")
    return rows.withColumn("actual_landed_cost", landed).withColumns({
        "realized_profit": profit,
        "realized_roi": F.when(F.col("actual_landed_cost") > 0,
                               profit / F.col("actual_landed_cost")),
        "holding_days": F.greatest(F.lit(0), F.datediff("date_sold",
                                                        "date_won"))})


def eligible(rows: DataFrame, tradeable: Column, s: Settings = DEFAULT
             ) -> DataFrame:
    """The best tradeable rows of a run, for capture into the ledger."""
    return rows.filter(tradeable & ~F.col("discovery")
                       & F.col("wanted").isNull()
                       & (F.lower("category") != "watches")
                       ).orderBy(F.desc("opportunity_score"), "row_id"
                                 ).limit(s.ledger_rows)


def opportunity_rows(rows: DataFrame, as_of: Column) -> DataFrame:
    """Fresh ledger rows: money with two decimals, ratios with six."""
    from ..functions.urls import listing_key
    amounts = {"current_price": 2, "shipping": 2, "fair_value": 2,
               "edge_now": 2, "net_proceeds": 2, "confidence": 6, "roi": 6,
               "opportunity_score": 6}
    return rows.select(
        listing_key("canonical_asset_id", "site", "listing_id", "url",
                    "row_id").alias("listing_key"),
        as_of.alias("first_seen"), as_of.alias("last_seen"), "site",
        "listing_type", "title", "query", "url", "identity_key",
        *[F.col(c).cast(f"decimal(18,{d})").alias(c)
          for c, d in amounts.items()])


def upsert(ledger: DataFrame, fresh: DataFrame, key: str = "listing_key"
           ) -> DataFrame:
    """Refresh machine columns, keep user columns and the first sighting."""
    machine = [c for c in fresh.columns if c not in (key, "first_seen")]
    old, new = ledger.alias("o"), fresh.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"),
                      "full_outer")
    out = [F.coalesce(f"o.{key}", f"n.{key}").alias(key),
           F.coalesce("o.first_seen", "n.first_seen").alias("first_seen")]
    for name in ledger.columns:
        if name in (key, "first_seen"):
            continue
        if name in machine:
            out.append(F.when(F.col(f"n.{key}").isNotNull(),
                              F.col(f"n.{name}")).otherwise(
                F.col(f"o.{name}")).alias(name))
        elif name == "status":
            out.append(F.coalesce("o.status", F.lit("Discovered")
                                  ).alias("status"))
        elif name == "verified":
            out.append(F.coalesce("o.verified", F.lit("no")
                                  ).alias("verified"))
        else:
            out.append(F.col(f"o.{name}").alias(name))
    return joined.select(*out)


def ordered(rows: DataFrame) -> DataFrame:
    """Open work first, by status, newest first."""
    place = F.lit(len(STATUSES))
    for i, name in enumerate(STATUSES):
        place = F.when(F.col("status") == name, i).otherwise(place)
    return rows.orderBy(F.col("status").isin(*TERMINAL), place,
                        F.desc("last_seen"))
