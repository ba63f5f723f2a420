"""Variant classes, years, numbers and the conflicts between two texts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import as_col, extract, find_all, hit, overlap, quick

# All functions here take lower-cased text.


def holo_class(low: Column) -> Column:
    return (F.when(hit(low, vocab.NON_HOLO), "nonholo")
            .when(hit(low, vocab.REVERSE_HOLO), "reverse")
            .when(hit(low, vocab.HOLO), "holo"))


def edition_class(low: Column) -> Column:
    return (F.when(hit(low, vocab.FIRST_EDITION), "1st")
            .when(hit(low, vocab.UNLIMITED), "unlimited")
            .when(hit(low, vocab.SHADOWLESS), "shadowless"))


def topsun_series(low: Column) -> Column:
    return F.when(hit(low, vocab.TOPSUN),
                  F.when(hit(low, vocab.VERSUS), "vs").otherwise("original"))


def completeness(low: Column) -> Column:
    return (F.when(hit(low, vocab.SEALED), "sealed")
            .when(hit(low, vocab.COMPLETE_IN_BOX), "cib")
            .when(hit(low, vocab.LOOSE), "loose"))


def variant_array(low: Column) -> Column:
    """Stated variants, in fixed order."""
    return F.array_compact(F.array(holo_class(low), edition_class(low),
                                   topsun_series(low), completeness(low)))


def stated_and_different(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def variant_conflict(query_low: Column, title_low: Column) -> Column:
    """Any variant class stated on both sides and different."""
    test = F.lit(False)
    for fn in (holo_class, edition_class, topsun_series, completeness):
        test = test | stated_and_different(fn(query_low), fn(title_low))
    return test


def language_conflict(query_low: Column, title_low: Column) -> Column:
    """Foreign print, or a Japanese print the query does not ask for."""
    return hit(title_low, vocab.FOREIGN) | (
        hit(title_low, vocab.JAPANESE)
        & ~hit(query_low, vocab.JAPANESE_NATIVE_QUERY))


def years(low: Column) -> Column:
    """Four-digit years plus the end year of seasons such as 1984-85."""
    plain = find_all(low, vocab.YEAR, 1)
    season = low.rlike(vocab.SEASON)
    starts = find_all(low, vocab.SEASON, 1)
    suffixes = find_all(low, vocab.SEASON, 2)

    def season_end(start, suffix):
        first_year = start.cast("int")
        end = first_year - first_year % 100 + suffix.cast("int")
        return F.when(end < first_year, end + 100).otherwise(end).cast("string")

    return F.when(season, F.array_union(plain, F.zip_with(
        starts, suffixes, season_end))).otherwise(F.array_distinct(plain))


def year_conflict(query_years: Column, title_years: Column) -> Column:
    return (F.size(query_years) > 0) & ~overlap(query_years, title_years)


def card_number(low: Column) -> Column:
    """Number within a set: #n, No. n, or a/b in a trading-card context.

    The first form found in the text decides; four-digit years are not
    numbers.
    """
    head = F.regexp_extract(low, quick(vocab.ANY_NUMBER), 0)
    # the first digits of the form that was found, as an array of at most
    # one: its text is searched once, however often the result is tested
    number = F.get(F.regexp_extract_all(
        head, F.lit(r"^\D*(?!(?:1[89]\d{2}|20\d{2})(?!\d))(\d+)"), F.lit(1)),
        F.lit(0))
    return F.when(head.rlike("^[#n]") | hit(low, vocab.TCG_CONTEXT), number)


def full_number(low: Column) -> Column:
    """Card number including alphanumeric insert numbers (#T264)."""
    return F.coalesce(card_number(low),
                      F.upper(extract(low, vocab.ALNUM_NUMBER)))


def number_conflict(query_number: Column, title_number: Column) -> Column:
    """The query names a number and the title does not show that number."""
    return query_number.isNotNull() & ~query_number.eqNullSafe(title_number)


def subject_missing(query_subject: Column, title_words: Column) -> Column:
    """The query names a subject and the title shows none of it."""
    return (F.size(query_subject) > 0) & ~overlap(query_subject, title_words)


def text_low(value) -> Column:
    return F.lower(F.coalesce(as_col(value), F.lit("")))
