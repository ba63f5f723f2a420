"""Imports every operator module, so that all queries are registered."""
from . import (  # noqa: F401
    decontamination,
    exact_dedup,
    merkle,
    near_dedup,
    packing,
    pieces,
    quality,
    resampling,
    secret_scan,
    sharding,
    substring_dedup,
    topk_search,
    url_filter,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
