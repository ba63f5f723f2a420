"""Rule-driven page extraction and venue costs."""
import re

import pytest
from pyspark.sql import functions as F

from lotwise.functions import economics
from lotwise.sources import captures


def lots(spark, pages, extra=()):
    rules = captures.default_rules(spark)
    if extra:
        rules = rules.unionByName(spark.createDataFrame(extra, rules.schema))
    df = spark.createDataFrame(pages, "site string, page_id string, "
                               "html string")
    venues = captures.default_venues(spark).unionByName(
        captures.default_venues(spark).filter("site = 'alt'").withColumn(
            "site", F.lit("newsite")))
    return {(r["site"], r["lot_id"]): r for r in captures.lots(
        df, rules, venues,
        F.timestamp_seconds(F.lit(1_000_000_000))).collect()}


def test_yahoo_lots_in_yen_with_real_ends(spark):
    card = ('<li class="Product"><a data-auction-id="p1" data-auction-title='
            '"トップサン &amp; 1円〜" data-auction-price="103999" '
            'data-cl-params="st:1;end:1786623522;"></a>'
            '<span class="Product__bid">7</span></li>')
    ended = card.replace("p1", "p2").replace("1786623522", "999999999")
    blank = card.replace("p1", "p3").replace("103999", "")
    got = lots(spark, [("yahoo_jp", "a", card + ended + blank)])
    assert set(got) == {("yahoo_jp", "p1")}
    r = got["yahoo_jp", "p1"]
    assert r["title"] == "トップサン & 1円〜" and r["bid_count"] == 7
    assert r["current_price"] == pytest.approx(103999 * 0.0063)
    assert r["url"].endswith("/auction/p1") and r["end_time"].year == 2026


def test_sales_take_the_price_paid_and_may_have_ended(spark):
    card = ('<a data-sold-result href="u{k}"><i data-original-price-amount='
            '"900"></i><i data-price-amount="1,250.50" data-price-currency='
            '"{c}"></i><p>A title of fifteen letters</p></a>')
    got = lots(spark, [("130point", "a", card.format(k=1, c="USD")
                        + card.format(k=2, c="GBP"))])
    assert got["130point", "u1"]["current_price"] == 1250.5
    assert got["130point", "u2"]["current_price"] == pytest.approx(
        1250.5 * 1.27, rel=0.1)


def test_first_capture_of_a_lot_wins_and_sites_are_data(spark):
    row = "<tr id=9><td>{t}</td><b>{p}</b></tr>"
    rules = [("newsite", "block", "<tr.*?</tr>"),
             ("newsite", "lot_id", r"id=(\d+)"),
             ("newsite", "title", "<td>([^<]*)"),
             ("newsite", "price", "<b>([^<]*)")]
    pages = [("newsite", "b", row.format(t="second", p="$2")),
             ("newsite", "a", row.format(t="first", p="$1,000.25") * 2),
             ("unknown", "a", row.format(t="x", p="$1")), ("ebay", "e", None),
             ("ebay", "f", "")]
    got = lots(spark, pages, rules)
    assert set(got) == {("newsite", "9")}
    assert got["newsite", "9"]["title"] == "first"
    assert got["newsite", "9"]["current_price"] == 1000.25


def test_venue_costs_fill_blanks_only(spark):
    rows = [("yahoo_jp", 100.0, None, None), ("yahoo_jp", 100.0, 0.0, None),
            ("heritage", 100.0, None, None), ("nowhere", 100.0, None, 4.0)]
    df = spark.createDataFrame(rows, "site string, current_price double, "
                               "shipping double, buyer_fees double")
    got = [r[0] for r in captures.with_venue_costs(
        df, captures.default_venues(spark)).select(
        economics.landed_cost("current_price")).collect()]
    # 100 + 8 domestic + 10 proxy + 35 abroad + 1 + 15 + 3
    assert sorted(got) == pytest.approx(sorted(
        [172.0, 164.0, 129.0, 104.0]))


def test_lots_of_keys_beyond_64_bits(spark, sf_dir, monkeypatch):
    """Row ids of large tables join to more than 19 digits."""
    from lotwise.plans import capture_queries
    rows = capture_queries.view(spark, sf_dir, "listings").limit(40)
    wide = rows.withColumn("row_id", F.concat(
        F.lit("9000000-1-1200000-6"), F.lpad(
            F.substring_index("row_id", "-", 1), 6, "0"))).cache()
    monkeypatch.setattr(capture_queries, "view", lambda *_: wide)
    keys = {int(r["row_id"].replace("-", "")) for r in wide.collect()}
    seen = {int(n) for r in capture_queries.shown_pages(spark, sf_dir)
            .collect() for n in re.findall(r"(\d{20,})", r["html"])}
    assert seen == keys and min(keys) > 2 ** 63
