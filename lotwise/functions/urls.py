"""Listing and sale identity from URLs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import as_col, extract

URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def item_id(url, site=None) -> Column:
    """Marketplace item id from the usual URL shapes; NULL when absent.

    A bare id in the path counts on one marketplace only, so that dates and
    order numbers elsewhere are not taken for ids.
    """
    u = as_col(url)
    known = F.coalesce(extract(u, vocab.ITEM_PATH), extract(u, vocab.ITEM_PARAM))
    if site is None:
        return known
    path = F.regexp_extract(u, URL, 3)
    return F.coalesce(known, F.when(F.lower(as_col(site)) == "ebay",
                                    extract(path, vocab.PATH_ITEM)))


def normal_url(url) -> Column:
    """Lower scheme and host, no tracking parameters, sorted query, no
    fragment, no trailing slash."""
    u = F.trim(as_col(url))
    scheme = F.lower(F.regexp_extract(u, URL, 1))
    host = F.lower(F.regexp_extract(u, URL, 2))
    path = F.regexp_replace(F.regexp_extract(u, URL, 3), "/+$", "")

    def wanted(pair):
        key = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
        return ((pair != "") & ~key.startswith("utm_")
                & ~key.isin(*vocab.TRACKING_PARAMS))

    query = F.array_join(F.array_sort(F.filter(
        F.split(F.regexp_extract(u, URL, 4), "&"), wanted)), "&")
    prefix = F.when(scheme != "", F.concat(scheme, F.lit("://"), host)
                    ).otherwise(F.lit(""))
    return F.concat(prefix, path, F.when(
        query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def plain_url(url) -> Column:
    """Scheme, host and path only."""
    return F.regexp_replace(normal_url(F.split_part(
        as_col(url), F.lit("?"), F.lit(1))), "/+$", "")


def sale_key(title, price, sold_date, url, site) -> Column:
    """One physical sale: item id, else normal URL, else a content digest."""
    content = F.concat_ws(
        "\x1f", F.lower(F.trim(F.coalesce(as_col(site), F.lit("")))),
        F.trim(F.regexp_replace(F.lower(as_col(title)), r"\s+", " ")),
        F.floor(F.coalesce(as_col(price), F.lit(0.0)) * 100 + 0.5
                ).cast("string"),
        F.coalesce(as_col(sold_date).cast("string"), F.lit("")))
    return F.coalesce(
        F.concat(F.lit("item:"), item_id(url, site)),
        F.concat(F.lit("url:"), F.nullif(normal_url(url), F.lit(""))),
        F.concat(F.lit("fallback:"), F.sha2(content, 256)))


def listing_key(asset_id, site, native_id, url, row_id) -> Column:
    """Duplicate-suppression key: trusted asset, native id, URL; else the
    row itself, because missing identity is not evidence of sameness."""
    asset = F.nullif(F.lower(F.regexp_replace(
        F.coalesce(as_col(asset_id), F.lit("")), r"\s+", "")), F.lit(""))
    venue = F.coalesce(F.nullif(F.lower(as_col(site)), F.lit("")),
                       F.lit("unknown"))
    native = F.coalesce(F.nullif(F.lower(F.trim(as_col(native_id))),
                                 F.lit("")),
                        extract(as_col(url), vocab.ITEM_PATH))
    link = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(
        F.coalesce(as_col(url), F.lit("")), r"^([^?#]*)", 1), "/+$", "")),
        F.lit(""))
    return F.coalesce(
        F.concat(F.lit("asset:"), asset),
        F.concat(F.lit("listing:"), venue, F.lit(":"), native),
        F.concat(F.lit("url:"), venue, F.lit(":"), link),
        F.concat(F.lit("anonymous:"), venue, F.lit(":"), as_col(row_id)))
