"""The small rules as SQL functions, which Catalyst inlines."""
from __future__ import annotations

from pyspark.sql import SparkSession

from .. import vocab

SHIFT = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.GRADE_SHIFT.items())
FUNCTIONS = {
    "effective_grade(grader STRING, grade DOUBLE)": (
        "DOUBLE", f"greatest(1.0D, grade + CASE grader {SHIFT} ELSE 0 END)"),
    "match_band(score DOUBLE)": (
        "STRING", "CASE WHEN score >= 0.80 THEN 'exact' WHEN score >= 0.62 "
        "THEN 'strong' WHEN score >= 0.40 THEN 'weak' ELSE 'none' END"),
    "fold_accents(title STRING)": (
        "STRING", f"translate(title, '{vocab.ACCENTS_FROM}', "
        f"'{vocab.ACCENTS_TO}')"),
    "buyer_fee(price DOUBLE, rate DOUBLE, minimum DOUBLE)": (
        "DOUBLE", "greatest(greatest(price, 0D) * greatest(rate, 0D), "
        "greatest(minimum, 0D))"),
    "interest(expected_value DOUBLE, confidence DOUBLE)": (
        "DOUBLE", "coalesce(expected_value, 0D) * greatest(coalesce("
        "confidence, 0D), 0.1D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for signature, (returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} "
                  f"RETURNS {returns} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
