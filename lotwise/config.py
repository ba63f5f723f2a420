"""Run parameters.  Every number a result depends on, in one place."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

__all__ = ["Route", "Vault", "Settings", "DEFAULT", "replace"]


@dataclass(frozen=True)
class Route:
    """One way to sell: fee rate or fee tiers, fixed cost, eligibility."""
    channel: str
    fee_rate: float
    fee_tiers: tuple[tuple[float | None, float], ...] = ()
    fixed_cost: float = 0.0
    min_value: float = 0.0
    max_value: float | None = None
    categories: tuple[str, ...] = ()
    requires_graded: bool = False
    auto: bool = True


@dataclass(frozen=True)
class Vault:
    enabled: bool = True
    min_price: float = 500.0
    sell_fee_rate: float = 0.07
    fixed_cost: float = 0.0
    categories: tuple[str, ...] = ("Pokemon Cards", "Sports Cards")
    requires_graded: bool = True
    graders: tuple[str, ...] = ("psa", "bgs", "cgc", "sgc", "bvg")


@dataclass(frozen=True)
class Settings:
    # comparable sales
    min_match: float = 0.55
    mad_k: float = 3.0
    half_life_days: float = 30.0
    min_specific_comps: int = 3
    comp_fresh_hours: float = 48.0
    comp_cache_rows: int = 120
    comp_cache_min: int = 5
    stale_block_hours: float = 72.0
    guide_skip_comps: int = 8
    similarity: str = "levenshtein"
    premiums: dict = field(default_factory=dict)
    # identity and catalogue
    identity_floor: float = 0.70
    promotion_floor: float = 0.80
    match_margin: float = 0.06
    mixed_pool_confidence: float = 0.25
    guide_skip_floor_ratio: float = 0.5
    pokemon_grade_floor: float = 3.0
    # auction model
    auction_pricing: str = "live"
    settle_ratio: float = 0.92
    late_hours: float = 6.0
    tau_hours: float = 24.0
    proxy_per_bid: float = 0.02
    proxy_cap: float = 0.15
    sniper_floor: float = 0.75
    capture_half_life: float = 12.0
    zero_bid_hours: float = 24.0
    bin_half_life: float = 24.0
    too_good_ratio: float = 0.35
    min_feedback: int = 10
    # costs and exits
    sales_tax: float = 0.08
    tax_free_marketplaces: tuple[str, ...] = ("YAHOO_JP", "PAYPAY_JP")
    routes: tuple[Route, ...] = (
        Route("ebay", 0.1325),
        Route("goldin", 0.083, ((10000.0, 0.083), (None, 0.06)),
              min_value=100.0, categories=("Sports Cards",),
              requires_graded=True),
        Route("heritage", 0.20, fixed_cost=5.0, min_value=5000.0),
    )
    # sell-side fees of channels that are pinned but not configured
    other_fees: dict = field(default_factory=lambda: {
        "psa_vault": 0.07, "fanatics_collect": 0.15})
    vault: Vault = Vault()
    target_roi: float = 0.15
    regrade_tiers: tuple[tuple[float, float], ...] = (
        (500.0, 25.0), (1500.0, 75.0), (2500.0, 150.0), (1e9, 300.0))
    regrade_min_profit: float = 100.0
    # relevance
    excluded_keywords: tuple[str, ...] = ("reprint", "you pick", "custom")
    condition_marks: tuple[str, ...] = ("OC", "MK", "ST")
    min_listing_match: float = 0.6
    max_price: float = 100000.0
    auction_horizon_hours: float = 168.0
    bin_dead_days: tuple[float, float] = (7.0, 60.0)
    drop_fixed: bool = False
    wanted_min_price: float = 3000.0
    # report gates
    browse_floor: float = 500.0
    decision_floor: float = 500.0
    floor_by_category: dict = field(
        default_factory=lambda: {"Video Games": 250.0})
    max_roi_live: float = 10.0
    max_roi_projected: float = 2.0
    min_expected_value: float = 0.0
    #: Report size; rows beyond it are labelled. None: no such limit.
    max_rows: int | None = None
    accepted_eras: tuple[str, ...] = ("1st edition", "first edition",
                                      "1st ed", "no rarity")
    era_exempt_queries: tuple[str, ...] = ("topsun", "carddass",
                                           "movie promo", "no rarity")
    learner_min_fair: float = 50.0
    learner_ratio_band: tuple[float, float] = (0.1, 3.0)
    min_parametric: int = 20
    min_model_items: int = 150
    max_cv_mae: float = 0.25
    # today, alerts, digest, ledger
    today_hours: float = 24.0
    fresh_hours: float = 24.0
    today_min_ev: float = 75.0
    today_min_confidence: float = 0.25
    alert_min_edge: float = 150.0
    alert_min_roi: float = 0.15
    alert_min_capture: float = 0.5
    alert_min_confidence: float = 0.15
    alert_priority_only: bool = True
    alert_wanted_cap: int = 5
    digest_rows: int = 25
    ledger_rows: int = 50

    @property
    def max_roi(self) -> float:
        return (self.max_roi_live if self.auction_pricing == "live"
                else self.max_roi_projected)


DEFAULT = Settings()
