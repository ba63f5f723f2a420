"""A sample of registered queries against their check SQL, and the chain."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import canon, check, duck
from lotwise.plans import COVERS, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", [
    "comp_value", "dedupe_within_query", "landed_costs", "settle_ratios",
    "basket_prices", "portfolio_marks"])
def test_query_matches_check_sql(spark, con, sf_dir, name):
    out, _ = check(spark, con, name, entry.queries()[name],
                   entry.oracle_sql()[name], sf_dir)
    assert out.startswith("ok"), out


def test_every_check_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert canon(1.5) == "1.5"


def test_unbuilt_survey_operators_are_not_claimed():
    claimed = {i for ids in COVERS.values() for i in ids.split()}
    assert not claimed & {"V14"}
    assert {"V1", "W1", "J5", "J8"} <= claimed


def test_appraisal_values_each_item_once(spark, sf_dir):
    rows = QUERIES["appraisal"](spark, sf_dir).cache()
    assert rows.count() > 0
    assert rows.count() == rows.select("row_id").distinct().count()
    priced = rows.filter(F.col("fair_value") > 0)
    assert priced.count() > 0
    assert priced.filter(~F.col("confidence").between(0, 1)).count() == 0
    # the steps behind the value take effect
    assert rows.filter("evidence = 'targeted'").count() > 0
    assert rows.filter("wanted IS NOT NULL").count() > 0
    assert rows.filter("notes LIKE '%STALE COMPS%'").count() > 0
    assert rows.filter("stage IS NULL").count() > 0
    assert rows.filter("(stage IS NULL) <> (reason IS NULL)").count() == 0
    asks = QUERIES["compatible_asks"](spark, sf_dir).select(
        "row_id", F.col("asks").alias("most"))
    # only rows that passed the relevance rules are asks in the chain
    assert rows.join(asks, "row_id", "left").filter(
        "asks > coalesce(most, 0)").count() == 0
