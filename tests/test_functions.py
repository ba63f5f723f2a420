"""Literal cases of the text, grade, identity and economics functions."""
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lotwise.config import DEFAULT, Route, Vault, replace
from lotwise.functions import (economics, grades, guide_price, identity,
                               matching, text, urls)
from lotwise.sources import feeds


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k)
                                 for k, v in values.items()] or ["id"])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title, want", [
    ("Charizard PSA 10 Gem", ("psa", 10.0, 10.0)),
    ("Card BGS 9.5 (10 subs)", ("bgs", 9.5, 8.5)),
    ("Card CGC 1", ("cgc", 1.0, 1.0)),
    ("1952 Topps Mantle SGC 92", ("sgc", 8.5, 7.5)),
    ("T206 Cobb SGC 30", ("sgc", 1.5, 1.0)),
    ("Super Mario VGA 85", ("vga", 8.5, 8.5)),
    ("Topsun Blue Back 1997 CGC 85 Rare", None),
])
def test_grades(spark, title, want):
    got = one(spark, grades.grade_info(F.lit(title)))
    assert (got and (got["grader"], got["grade"], got["effective"])) == want


def test_accents_fold_but_japanese_stays(spark):
    assert one(spark, text.fold(F.lit("Pokémon Café トップサン リザードン"))
               ) == "Pokemon Cafe トップサン リザードン"


@pytest.mark.parametrize("title, want", [
    ("1940 Superman Gum R145 Superman Racing the Shells #40 PSA 6", "card"),
    ("1940 SUPERMAN Leader Novelty Premium Coupon R146 Vintage", "coupon"),
    ("1940 Gum Inc. Superman Gum Wax Pack Wrapper VERY SCARCE!", "wrapper"),
    ("1940 D.C. Comics Action Comics 22 Early Superman Cover", "comic"),
    ('McFarlane DC Superman Classic 1940 Animation 7" Figure', "figure"),
    ("Patek Philippe Ref 1593 platinum dial for restoration", "watch_part"),
    ("Patek Philippe Calatrava 4864R complete watch", "watch"),
    ("1986 Fleer Michael Jordan #57 Signed Photo PSA 9", "memorabilia"),
])
def test_object_class(spark, title, want):
    df = identity.with_identity(
        spark.createDataFrame([(title,)], "title string"))
    assert df.first()["ident"]["object_class"] == want


def test_parallels_make_different_assets(spark):
    base = "2023 Topps Chrome Disney 100 "
    titles = [base + t for t in (
        "Cinderella Pink Refractor #/399 PSA 10",
        "Meg Year Diamond Refractor #/100 PSA 10",
        "Escape from a Plane Toy Story Black #/10 PSA 10",
        "The Dance Beauty Beast Gold Wave #/50 PSA 10",
        "Zurg Orange Wave Refractor #/25 PSA 10",
        "Mirabel Madrigal Bruno Dual Auto #/99 PSA 10")]
    df = identity.with_identity(spark.createDataFrame(
        [(t,) for t in titles], "title string"))
    rows = df.select("title", identity.fingerprint(F.col("ident")).alias(
        "k"), "ident").collect()
    assert len({r["k"] for r in rows}) == 6
    pink = next(r["ident"] for r in rows if "Pink" in r["title"])
    assert (pink["parallel"], pink["serial"]) == ("pink refractor", 399)


def test_equal_fingerprints_never_conflict(spark, sf_dir):
    from lotwise.sources.adapters import view
    rows = identity.with_identity(view(spark, sf_dir, "titles")).select(
        identity.fingerprint(F.col("ident")).alias("k"), "ident")
    pairs = rows.alias("a").join(rows.alias("b"), "k")
    bad = pairs.filter(identity.conflict_reason(
        F.col("a.ident"), F.col("b.ident")).isNotNull())
    assert bad.count() == 0


LADDER = dict(loose_price=90000, cib_price=180000, new_price=330000,
              graded_price=671800, box_only_price=1200000,
              manual_only_price=2500000)


def quote(spark, grade, rungs, grader=None, printed=None):
    row = spark.range(1).select(*[F.lit(rungs.get(c)).cast("long").alias(c)
                                  for c in guide_price.PRICE_COLUMNS])
    out = row.select(guide_price.price_cents(
        F.lit(grade).cast("double"), F.lit(grader).cast("string"),
        F.lit(printed).cast("double")).alias("x")).first()["x"]
    return None if out is None else out / 100


def test_price_ladder(spark):
    assert quote(spark, 8.0, LADDER) == 3300
    assert quote(spark, 9.0, LADDER) == 6718
    assert quote(spark, None, LADDER) == 900
    assert 3300 < quote(spark, 8.5, LADDER) < 6718
    sparse = dict(loose_price=90000, graded_price=671800)
    assert all(quote(spark, g, sparse) < 6718 for g in (6., 7., 8., 8.5))
    assert quote(spark, 7.0, dict(graded_price=671800)) is None
    top = dict(LADDER, condition_17_price=800000)
    assert quote(spark, 9.0, top, "cgc", 10.0) == 8000
    steps = [quote(spark, g / 2, LADDER) for g in range(10, 21)]
    assert steps == sorted(steps)


COSTS = dict(current_price=100.0, shipping=0.0, buyer_fees=0.0,
             buyer_fee_rate=0.0, minimum_buyer_fee=0.0,
             international_shipping=0.0, insurance_rate=0.0,
             insurance_on_buyer_fee=False, import_duty_rate=0.0,
             fx_spread_rate=0.0)


def test_landed_cost_and_inverse(spark):
    full = dict(COSTS, shipping=8.0, buyer_fees=10.0,
                international_shipping=35.0, insurance_rate=0.01,
                import_duty_rate=0.15, fx_spread_rate=0.03)
    assert one(spark, economics.landed_cost("current_price"), **full
               ) == pytest.approx(172.0)
    fee = dict(COSTS, buyer_fee_rate=0.22, minimum_buyer_fee=19.0)
    for price, landed in ((10.0, 29.0), (100.0, 122.0)):
        assert one(spark, economics.landed_cost(F.lit(price)), **fee
                   ) == pytest.approx(landed)
        assert one(spark, economics.price_for_landed_cost(F.lit(landed)),
                   **fee) == pytest.approx(price)


def test_exit_routes(spark):
    s = replace(DEFAULT, routes=(Route("ebay", 0.1325), Route(
        "goldin", 0.083, min_value=100.0, categories=("Sports Cards",),
        requires_graded=True)))

    def best(title, pinned="auto"):
        return one(spark, economics.best_exit(
            F.lit(1000.0), F.lit(pinned), F.lit("Sports Cards"),
            F.lit(title), F.lit(False), F.lit(False), s))

    graded = best("Jordan PSA 9")
    assert (graded["channel"], graded["net"]) == ("goldin", 917.0)
    assert graded["advantage"] == pytest.approx(49.5)
    assert best("Jordan PSA 9", "ebay")["net"] == pytest.approx(867.5)
    assert best("Jordan raw")["channel"] == "ebay"


def levels(spark, fair, s, **row):
    base = dict(COSTS, site="ebay", marketplace="EBAY_US", title="Card PSA 9",
                category="Sports Cards", object_class="card",
                resale_channel="auto", fair=fair)
    base.update(row)
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()])
    out = economics.with_bid_levels(df, "fair", s).first()
    return out["max_bid"], out["breakeven"]


def test_bid_levels(spark):
    s = replace(DEFAULT, routes=(Route("ebay", 0.1325),))
    assert levels(spark, 600.0, s) == (419, 558)
    odd = replace(s, vault=Vault(sell_fee_rate=0.40), target_roi=0.0)
    assert levels(spark, 650.0, odd)[0] == 499
    watch = levels(spark, 2450.0, s, object_class="watch", title="Watch")
    assert watch[1] == int(2450 * (1 - .1325) / 1.08)
    assert levels(spark, 2450.0, s, title="Card raw") == watch


@pytest.mark.parametrize("url", [
    "https://www.ebay.com/itm/123456789012",
    "https://www.ebay.com/itm/Charizard-PSA-9/123456789012?hash=x",
    "https://www.ebay.com/sch/i.html?item=123456789012&mkcid=1"])
def test_item_id(spark, url):
    assert one(spark, urls.item_id(F.lit(url), F.lit("ebay"))
               ) == "123456789012"


def test_catalogue_cents(spark):
    for raw, want in (("$2,255.00", 225500), ("1234", 1234), ("12.5", 1250),
                      ("", None), ("n/a", None)):
        assert one(spark, guide_price.cents(F.lit(raw))) == want


def test_sequence_ratio_is_exact(spark):
    a, b = "1986 fleer jordan", "fleer michael jordan 1986"
    assert one(spark, matching.sequence_ratio(F.lit(a), F.lit(b))
               ) == SequenceMatcher(None, a, b).ratio()


def test_coverage_prefilter_is_lossless():
    floor = matching.coverage_floor(0.55)
    assert 0.7 * (floor - 1e-9) + 0.3 * 1.0 < 0.55


def test_typo_variants(spark):
    assert one(spark, text.typo_variants(F.lit("gengar"))) == ["gengor",
                                                               "genger"]
    assert one(spark, text.typo_variants(F.lit("abcdefg"))) == [
        "acdefg", "abdefg", "abcefg"]


def test_manifest_problems():
    good = {"id": "house", "capabilities": ["auctions"], "field_map": {
        "title": "t", "url": "u", "current_price": "p"}}
    assert feeds.validate_manifest(good) == []
    assert feeds.validate_manifest({**good, "id": "Bad Id"})
    assert feeds.validate_manifest({**good, "extra": 1})
    assert feeds.validate_manifest({**good, "access": {"token": "x"}})
    assert feeds.validate_manifest({**good, "economics": {
        "shipping": "much"}})


def test_payloads(spark):
    body = ('{"itemSummaries":[{"itemId":"1","title":"A","itemWebUrl":"u",'
            '"buyingOptions":["AUCTION","FIXED_PRICE"],"bidCount":0,'
            '"currentBidPrice":{"value":"10","currency":"GBP"},'
            '"price":{"value":"50","currency":"USD"}},'
            '{"itemId":"2","title":"B","buyingOptions":["FIXED_PRICE"],'
            '"price":{"value":"0","currency":"USD"}}]}')
    df = spark.createDataFrame([("q", body)], "query string, payload string")
    rows = feeds.summaries(df).collect()
    assert len(rows) == 1
    assert rows[0]["current_price"] == pytest.approx(12.7)
    assert rows[0]["has_buy_now"] and rows[0]["buy_now_price"] == 50.0
    lots = spark.createDataFrame(
        [("1", "live", "PSA 9 card", 100.0, 5.0, 22.0),
         ("2", "sold", "x", 1.0, 1.0, 0.0)],
        "lot_id string, status string, title string, current_price double, "
        "min_bid_price double, buyer_premium double")
    lot = feeds.live_lots(lots).collect()
    assert len(lot) == 1 and lot[0]["shipping"] == 6.0
    assert lot[0]["minimum_buyer_fee"] == 19.0


def test_sql_functions_agree(spark):
    from lotwise.functions import sqlfunctions
    assert "match_band" in sqlfunctions.register(spark)
    row = spark.sql("SELECT effective_grade('cgc', 10D) AS e, match_band(0.7D)"
                    " AS b, buyer_fee(10D, 0.22D, 19D) AS f, "
                    "fold_accents('Pok\u00e9mon') AS p").first()
    assert tuple(row) == (9.0, "strong", 19.0, "Pokemon")


def test_sinks(spark):
    import tempfile
    from lotwise.sources import sinks
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([("a", ["x", "y"])], "k string, t array<string>")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        sinks.append_run(df, folder + "/h", day)
    assert sinks.read_history(spark, folder + "/h").count() == 2
    sinks.write_csv(df, folder + "/c")
    assert spark.read.option("header", True).csv(folder + "/c").first()[
        "t"] == "x; y"


def test_quick_patterns_match_the_same(spark):
    """Every fixed pattern finds the same with its first characters named."""
    import re
    from lotwise import vocab
    from lotwise.functions import text
    fixed = [p for p in vars(vocab).values()
             if isinstance(p, str) and "|" in p]
    assert sum(text.quick(p) != p for p in fixed) > 20
    assert text.quick("a|b*") == "a|b*" and text.quick("a|.b") == "a|.b"
    words = sorted({w for p in fixed for w in re.findall(r"[a-z]{2,}", p)})
    rows = [f"{a} {b}#{i} {c} {i % 40}/{i} [{a}] 19{i % 90 + 10}-{i % 90 + 10}"
            f" no. {i} 1st ed psa {i % 12} pop! 4\" figure"
            for i, (a, b, c) in enumerate(zip(words, words[1:], words[2:]))]
    df = spark.createDataFrame([(r,) for r in rows + words + ["", " ", "トップサン"]],
                               "t string")
    for p in fixed:
        old = F.regexp_extract_all("t", F.lit(p), F.lit(0))
        new = F.regexp_extract_all("t", F.lit(text.quick(p)), F.lit(0))
        assert df.filter(~old.eqNullSafe(new)).count() == 0, p
