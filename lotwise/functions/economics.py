"""Acquisition cost, exit routes and bid levels as Column expressions.

Cost columns are read by name from a listing row: current_price, shipping,
buyer_fees, buyer_fee_rate, minimum_buyer_fee, international_shipping,
insurance_rate, insurance_on_buyer_fee, import_duty_rate, fx_spread_rate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Route, Settings
from .stage import stage
from .text import as_col




def positive(name) -> Column:
    """A cost component: missing and negative amounts count as zero."""
    return F.greatest(F.lit(0.0), F.coalesce(as_col(name), F.lit(0.0)))


def fixed_cost() -> Column:
    return (positive("shipping") + positive("buyer_fees")
            + positive("international_shipping"))


def variable_rate() -> Column:
    return (positive("insurance_rate") + positive("import_duty_rate")
            + positive("fx_spread_rate"))


def insured_premium() -> Column:
    """Multiplier on the buyer premium when insurance covers it too."""
    return F.when(F.coalesce(F.col("insurance_on_buyer_fee"), F.lit(False)),
                  F.lit(1.0) + positive("insurance_rate")
                  ).otherwise(F.lit(1.0))


def buyer_fee(price: Column) -> Column:
    """Percentage premium with the venue's minimum."""
    return F.greatest(positive(price) * positive("buyer_fee_rate"),
                      positive("minimum_buyer_fee"))


def landed_cost(price) -> Column:
    """Price plus every known fee needed to hold the item."""
    price = as_col(price)
    fee = buyer_fee(price)
    return (positive(price) * (F.lit(1.0) + variable_rate()) + fixed_cost()
            + fee + fee * (insured_premium() - F.lit(1.0)))


def price_for_landed_cost(landed: Column) -> Column:
    """Largest item price whose landed cost is `landed` (inverse)."""
    available = landed - fixed_cost()
    rate, minimum = positive("buyer_fee_rate"), positive("minimum_buyer_fee")
    by_rate = available / (F.lit(1.0) + variable_rate()
                           + rate * insured_premium())
    by_minimum = ((available - minimum * insured_premium())
                  / (F.lit(1.0) + variable_rate()))
    return F.greatest(F.lit(0.0), F.when(by_rate * rate >= minimum, by_rate)
                      .otherwise(by_minimum))


def total_cost(price, tax: Column) -> Column:
    return landed_cost(price) * (F.lit(1.0) + F.greatest(F.lit(0.0), tax))


def price_for_total_cost(total: Column, tax: Column) -> Column:
    return price_for_landed_cost(
        total / (F.lit(1.0) + F.greatest(F.lit(0.0), tax)))


def tax_rate(vault_route: Column, marketplace="marketplace",
             s: Settings = DEFAULT) -> Column:
    exempt = F.upper(F.coalesce(as_col(marketplace), F.lit(""))).isin(
        *[m.upper() for m in s.tax_free_marketplaces])
    return F.when(vault_route | exempt, F.lit(0.0)).otherwise(
        F.lit(max(0.0, s.sales_tax)))


def tier_value(value: Column, tiers, default: float) -> Column:
    """First tier whose cap is not below the value; open cap = None."""
    out = F.lit(float(default))
    for cap, rate in reversed(list(tiers)):
        hit = F.lit(True) if cap is None else value <= F.lit(float(cap))
        out = F.when(hit, F.lit(float(rate))).otherwise(out)
    return out


def fee_rate(route: Route, value: Column) -> Column:
    return F.least(F.lit(0.95), F.greatest(F.lit(0.0), tier_value(
        value, route.fee_tiers, route.fee_rate)))


def net_of(route: Route, value: Column) -> Column:
    return F.greatest(F.lit(0.0), value * (F.lit(1.0) - fee_rate(route, value))
                      - F.lit(max(0.0, route.fixed_cost)))


GRADED_MARK = r"(?i)\b(?:PSA|BGS|CGC|SGC|BVG|WATA|VGA)\b"


def graded_mark(title) -> Column:
    """The title names a grading company."""
    return F.coalesce(as_col(title), F.lit("")).rlike(GRADED_MARK)


def route_eligible(route: Route, value: Column, category, graded: Column
                   ) -> Column:
    test = F.lit(route.auto) & (value >= F.lit(float(route.min_value)))
    if route.max_value is not None:
        test = test & (value <= F.lit(float(route.max_value)))
    if route.categories:
        test = test & F.lower(F.coalesce(as_col(category), F.lit(""))).isin(
            *[c.lower() for c in route.categories])
    if route.requires_graded:
        test = test & graded
    return test


def vault_eligible(site, category, title, object_class,
                   s: Settings = DEFAULT) -> Column:
    """Assets the vault can receive: graded cards of one marketplace."""
    v = s.vault
    if not v.enabled:
        return F.lit(False)
    test = ((F.lower(F.coalesce(as_col(site), F.lit(""))) == "ebay")
            & (as_col(object_class) == "card"))
    if v.categories:
        test = test & F.lower(F.trim(F.coalesce(
            as_col(category), F.lit("")))).isin(
            *[c.lower() for c in v.categories])
    if v.requires_graded:
        first = F.lower(F.regexp_extract(
            as_col(title), r"(?i)\b(PSA|BGS|CGC|SGC|BVG)\b", 1))
        test = test & first.isin(*v.graders)
    return F.coalesce(test, F.lit(False))


def exit_struct(channel, rate, fixed, net) -> Column:
    return F.struct(net.alias("net"), channel.alias("channel"),
                    rate.alias("fee_rate"), fixed.alias("fixed_cost"))


def _route_struct(route: Route, value: Column) -> Column:
    return exit_struct(F.lit(route.channel), fee_rate(route, value),
                       F.lit(max(0.0, route.fixed_cost)), net_of(route, value))


def best_exit(value: Column, pinned, category, title, vault_ok: Column,
              vault_asset: Column, s: Settings = DEFAULT,
              graded: Column | None = None) -> Column:
    """Exit with the highest net: struct(net, channel, fee_rate, fixed_cost,
    advantage).  A pinned channel is honoured; an allowed vault is exclusive;
    the earlier route wins a tie.

    vault_ok     this purchase price goes through the vault
    vault_asset  the vault can receive this asset at all
    graded       graded_mark(title), when it is a column already
    """
    graded = graded_mark(title) if graded is None else graded
    value = F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))
    routes = {r.channel: r for r in s.routes}
    ebay = routes.get("ebay", Route("ebay", 0.1325))
    routes.setdefault("ebay", ebay)
    vault = Route("psa_vault", s.vault.sell_fee_rate,
                  fixed_cost=s.vault.fixed_cost)
    ordered = [r for r in routes.values() if r.channel != "psa_vault"]
    best = None
    for route in ordered:
        made = _route_struct(route, value)
        ok = route_eligible(route, value, category, graded)
        if best is None:
            best = F.when(ok, made)
        else:
            better = ok & (best.isNull() | (made["net"] > best["net"]))
            best = F.when(better, made).otherwise(best)
    auto = F.when(vault_ok & vault_asset & F.lit(s.vault.enabled),
                  _route_struct(vault, value)
                  ).otherwise(F.coalesce(best, _route_struct(ebay, value)))
    wanted = F.lower(F.coalesce(F.nullif(as_col(pinned), F.lit("")),
                                F.lit("auto")))
    wanted = F.when((wanted == "psa_vault") & ~vault_asset, "ebay"
                    ).otherwise(wanted)
    chosen = auto
    named = dict(routes)
    for channel, rate in s.other_fees.items():
        named.setdefault(channel, Route(channel, rate))
    for channel, route in named.items():
        chosen = F.when(wanted == channel, _route_struct(route, value)
                        ).otherwise(chosen)
    return chosen.withField("advantage",
                            chosen["net"] - net_of(ebay, value))


def whole_dollars(price: Column) -> Column:
    return F.when(price > 0, F.floor(price).cast("long"))


def with_bid_levels(df: DataFrame, fair: str, s: Settings = DEFAULT
                    ) -> DataFrame:
    """Add max_bid and breakeven in whole dollars.

    Needs site, category, title, object_class, resale_channel, marketplace
    and the cost columns.  Normal checkout holds strictly below the vault
    boundary and the vault only when the bid itself reaches it; the better
    valid one wins.
    """
    names = df.columns
    asset = vault_eligible("site", "category", "title", "object_class", s)
    value = F.col(fair)
    df = stage(df, _asset=asset, _tax=tax_rate(F.lit(False), s=s))
    exits = [best_exit(value, "resale_channel", "category", "title", ok,
                       F.col("_asset"), s)["net"]
             for ok in (F.lit(False), F.lit(True))]
    df = stage(df, _normal=exits[0], _vault=exits[1], _cap=price_for_landed_cost(
        F.lit(float(s.vault.min_price))))
    keep = 1.0 + max(0.0, s.target_roi)
    wanted = {"max_bid": keep, "breakeven": 1.0}
    levels = {}
    for name, divisor in wanted.items():
        levels[f"_n_{name}"] = price_for_total_cost(
            F.col("_normal") / F.lit(divisor), F.col("_tax"))
        levels[f"_v_{name}"] = price_for_total_cost(
            F.col("_vault") / F.lit(divisor), F.lit(0.0))
    df = stage(df, **levels)

    def level(name):
        plain, vaulted = F.col(f"_n_{name}"), F.col(f"_v_{name}")
        below = F.when(F.col("_cap") > 0,
                       F.least(plain, F.col("_cap") - F.lit(1e-9)))
        reached = F.when(landed_cost(vaulted) >= F.lit(s.vault.min_price),
                         vaulted)
        return F.when(value > 0, whole_dollars(F.when(
            F.col("_asset"), F.greatest(F.when(below > 0, below),
                                        F.when(reached > 0, reached))
        ).otherwise(plain)))

    return df.select(*names, *[level(n).alias(n) for n in wanted])
