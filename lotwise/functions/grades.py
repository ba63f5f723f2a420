"""Grade parsing: company, modern grade, comparable (effective) grade."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import as_col, find_all, first, number_text


def normal_grade(grader: Column, number: Column) -> Column:
    """Printed label to a modern 1-10 grade, or NULL when impossible."""
    value = number.cast("double")
    legacy = F.create_map(*[x for k, v in vocab.SGC_LEGACY.items()
                            for x in (F.lit(k), F.lit(v))])
    return (F.when(value <= 0, F.lit(None).cast("double"))
            .when(value <= vocab.MAX_GRADE, value)
            .when((grader == "vga") & (value / 10.0 <= vocab.MAX_GRADE),
                  value / 10.0)
            .when(grader == "sgc", F.try_element_at(
                legacy, F.split_part(number, F.lit("."), F.lit(1)))))


def effective_grade(grader: Column, grade: Column,
                    shift: dict | None = None) -> Column:
    """Grade on the leading company's scale, never below 1."""
    delta = F.lit(0.0)
    for name, value in (shift or vocab.GRADE_SHIFT).items():
        delta = F.when(grader == name, F.lit(float(value))).otherwise(delta)
    return F.greatest(F.lit(1.0), grade + delta)


def grade_tokens(text, shift: dict | None = None) -> Column:
    """Every grade token: array<struct(grader, label, grade, effective)>.

    `grade` and `effective` are NULL for impossible labels.
    """
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    pairs = F.arrays_zip(
        find_all(low, vocab.GRADE_TOKEN, 1).alias("grader"),
        find_all(low, vocab.GRADE_TOKEN, 2).alias("label"))

    def entry(pair):
        grade = normal_grade(pair["grader"], pair["label"])
        return F.struct(
            pair["grader"].alias("grader"), pair["label"].alias("label"),
            grade.alias("grade"),
            effective_grade(pair["grader"], grade, shift).alias("effective"))

    return F.transform(F.transform(pairs, lambda p: F.struct(
        p["grader"].alias("grader"), p["label"].alias("label"))), entry)


def grade_info(text, shift: dict | None = None) -> Column:
    """First valid token as struct(grader, label, grade, effective), or NULL."""
    return first(F.filter(grade_tokens(text, shift),
                          lambda t: t["grade"].isNotNull()))


def valid_effective(tokens: Column) -> Column:
    """Effective grades of the valid tokens, in order."""
    return F.transform(
        F.filter(tokens, lambda t: t["grade"].isNotNull()),
        lambda t: t["effective"])


def grade_conflict(query_effective: Column, title_effective: Column,
                   assume_ungraded: bool = False,
                   ungraded: float = vocab.UNGRADED_GRADE) -> Column:
    """Effective grades differ.  A missing grade never conflicts, unless
    `assume_ungraded` counts it as a raw copy."""
    if assume_ungraded:
        return (F.coalesce(query_effective, F.lit(ungraded))
                != F.coalesce(title_effective, F.lit(ungraded)))
    return F.coalesce(query_effective != title_effective, F.lit(False))


def grader_premium(grader: Column, premiums: dict | None) -> Column:
    """Price multiplier of a grading company; 1.0 when none is set."""
    out = F.lit(1.0)
    for name, value in (premiums or {}).items():
        out = F.when(grader == name, F.lit(float(value))).otherwise(out)
    return out


def product_key(query) -> Column:
    """Grade-free catalogue key: #015 equals #15, case and spacing ignored."""
    low = F.lower(as_col(query))
    bare = F.regexp_replace(low, vocab.GRADE_TOKEN, " ")
    bare = F.regexp_replace(bare, r"#0+(\d+)\b", "#$1")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def value_key(query) -> Column:
    """Catalogue key plus the effective grade the value is for."""
    effective = grade_info(query)["effective"]
    return F.concat(product_key(query), F.lit("|psa:"),
                    F.coalesce(number_text(effective), F.lit("raw")))
