"""Work that must not grow faster than the input."""
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from lotwise import vocab
from lotwise.functions import guide_price, identity, text, variants
from lotwise.functions.stage import stage
from lotwise.operators import close_model, pools
from lotwise.plans import QUERIES
from lotwise.sources import adapters


class Counted(Pipeline):
    """A pipeline that notes the rows of every fit."""
    seen: list = []

    def _fit(self, dataset):
        Counted.seen.append(dataset.count())
        return super()._fit(dataset)


def test_every_fold_is_fitted_once(spark, monkeypatch):
    rows = spark.range(400).select(
        (F.col("id") % 40).cast("string").alias("item_id"),
        *((F.hash("id", F.lit(i)) % 50 / 50.0).alias(c)
          for i, c in enumerate([*close_model.FEATURES, "target"])))
    small = close_model.model(3).getStages()
    monkeypatch.setattr(close_model, "model",
                        lambda trees: Counted(stages=small))
    Counted.seen = []
    got = close_model.grouped_error(rows, folds=4)
    sizes = [r["count"] for r in rows.groupBy(F.pmod(F.xxhash64(
        "item_id"), F.lit(4)).alias("fold")).count().collect()]
    assert sorted(Counted.seen) == sorted(400 - n for n in sizes)
    assert got == pytest.approx(close_model.grouped_error(rows, folds=4))
    assert 0 < got < 2


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def curve_cents(product, grade):
    """The price curve by hand: exact rung, else linear, else the last."""
    names = ((5.0, "loose_price"), *guide_price.LADDER)
    points = [(at, float(product[n])) for at, n in names if product[n]]
    low = [p for p in points if p[0] <= grade]
    high = [p for p in points if p[0] > grade]
    if not low:
        return float(product["loose_price"] or 0) or None
    (at, cents), above = low[-1], high[:1]
    if at == grade or not above:
        return cents
    return cents + (above[0][1] - cents) * ((grade - at) / (above[0][0] - at))


def test_price_curves_have_no_interpreted_lambdas(spark, sf_dir):
    for name in ("guide_prices", "guide_monotone"):
        assert "lambda" not in plan_of(QUERIES[name](spark, sf_dir)), name
    products = {r["product_id"]: r.asDict() for r in adapters.view(
        spark, sf_dir, "catalogue").collect()}
    got = QUERIES["guide_prices"](spark, sf_dir).filter(
        "grader = 'psa'").collect()
    assert len(got) == 8 * len(products)
    for r in got:
        assert r["cents"] == curve_cents(products[r["product_id"]],
                                         r["grade"]), r


def test_pools_parse_every_text_once(spark, sf_dir, monkeypatch):
    """Not once per pair of a listing and a sale, nor once per pool."""
    parse, seen = identity.with_identity, []

    def noted(df, title="title", out="ident", fields=None):
        seen.append((title, df.count(), df.select(title).distinct().count()))
        return parse(df, title, out, fields)

    monkeypatch.setattr(identity, "with_identity", noted)
    assert QUERIES["targeted_values"](spark, sf_dir).count() > 0
    assert seen and all(n == texts for _, n, texts in seen), seen
    assert [t for t, *_ in seen].count("text") == 1
    assert {t for t, *_ in seen} == {"text", "targeted_query"}


def test_queries_run_with_methods_the_jvm_compiles(spark, sf_dir):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    QUERIES["research_view"](spark, sf_dir)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_staged_columns_are_made_below_the_generator(spark):
    """A generator is interpreted where its stage is too large to compile."""
    df = stage(spark.range(3), up=F.exp(F.col("id") * 2.5), n=F.col("id") + 1)
    lines = [x for x in plan_of(df).splitlines() if "Generate" in x]
    assert lines and all("EXP" not in x.upper().replace("EXPLODE", "")
                         for x in lines), lines
    assert [r["n"] for r in df.orderBy("id").collect()] == [1, 2, 3]


def test_a_text_is_searched_for_its_number_once_or_twice(spark):
    """Not again in each test of what was found."""
    low = F.col("low")
    cases = {"jordan #57 psa 9": "57", "card no. 12": "12", "x 4/102 y": None,
             "pokemon 4/102": "4", "topps #1986 star": None, "#5/10": None,
             "pokemon #5/10 a": "5", "# 19865": None, "no 1999": None,
             "1/2 no. 7": None, "": None, "plain": None, "#0203": "0203"}
    df = spark.createDataFrame([*cases.items(), (None, None)],
                               "low string, want string")
    got = df.select("low", "want", variants.card_number(low).alias("n"))
    for r in got.collect():
        assert r["n"] == r["want"], r
    low = F.col("id").cast("string")
    searches = plan_of(spark.range(3).select(variants.card_number(
        low).alias("n"))).count(text.quick(vocab.ANY_NUMBER))
    assert 1 <= searches <= 2, searches


def test_floors_without_the_own_ask_do_not_multiply_the_rows(spark):
    pools_ = spark.createDataFrame(
        [("q", "s", float(i), 1) for i in range(9)],
        "query string, sig string, price double, n long")
    got = pools.leave_one_out(pools_, ["query", "sig"])
    assert "Generate" not in plan_of(got)
    assert got.count() == 9
