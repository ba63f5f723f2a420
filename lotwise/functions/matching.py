"""Title match score and catalogue candidate score."""
from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from . import identity, text

MIN_MATCH = 0.55
# Weight of token coverage and of text similarity in a match score.
COVERAGE_WEIGHT, RATIO_WEIGHT = 0.7, 0.3
# Identity fields of a listing that a candidate score reads one by one, and
# those it reads together: listings that agree on SHARED differ by little.
OWN = ("serial", "is_auto", "variant", "foreign")
SHARED = ("year", "subject", "number", "parallel", "set_tokens", "region")
# Bits of a key of asset_keys, from the lowest: likeness, place, score.
LIKE_VARIANT, LIKE_SERIAL, LIKE_COLOUR, LIKE_SUBJECT, LIKE_NUMBER = (
    1 << i for i in range(5))
LIKE_BITS, PLACE_BITS = 5, 24
LIKE_ALL, PLACES = 1 << LIKE_BITS, 1 << PLACE_BITS
KEY_BITS = LIKE_BITS + PLACE_BITS


def coverage(query_tokens: Column, title_tokens: Column) -> Column:
    """Share of the query's tokens found in the title (0 when it has none)."""
    total = F.size(query_tokens)
    shared = F.size(F.array_intersect(query_tokens, title_tokens))
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two texts, Arrow batch at a time."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio()
                      for x, y in zip(a, b)], dtype="float64")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """JVM-side similarity: 1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.lit(1.0) - F.levenshtein(a, b) / longest
                  ).otherwise(F.lit(1.0))


RATIOS = {"sequence": sequence_ratio, "levenshtein": levenshtein_ratio}


def match_score(query_tokens: Column, title_tokens: Column, query_low: Column,
                title_low: Column, similarity: str = "levenshtein") -> Column:
    """0..1 blend of coverage and text similarity.

    similarity: 'sequence' is the exact blocks ratio (Arrow UDF),
    'levenshtein' stays in the JVM, 'coverage' uses coverage alone.
    """
    cover = coverage(query_tokens, title_tokens)
    if similarity == "coverage":
        return cover
    ratio = RATIOS[similarity](query_low, title_low)
    return F.when(F.size(query_tokens) > 0,
                  F.lit(COVERAGE_WEIGHT) * cover + F.lit(RATIO_WEIGHT) * ratio
                  ).otherwise(F.lit(0.0))


def coverage_floor(min_match: float) -> float:
    """Coverage below which no ratio can lift a pair over `min_match`; a
    lossless prefilter in front of the text similarity."""
    return max(0.0, (min_match - RATIO_WEIGHT) / COVERAGE_WEIGHT)


def word_overlap(a: Column, b: Column) -> Column:
    """0..1 overlap of two word arrays; NULL when either is unknown."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def wanted_name(i: Column, phrase: Column) -> Column:
    """The card as a catalogue would name it: subject, number, parallel."""
    parts = F.array_compact(F.concat(i["subject"], F.array(
        F.concat(F.lit("#"), i["number"]), i["parallel"])))
    return F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), phrase)


def asset_facts(i: Column, phrase: Column) -> dict[str, Column]:
    """What the candidate score reads of a listing, beside the fields of its
    identity: made once per asset, not once per pair."""
    return {"colours": identity.colours(i["parallel"]),
            "finish": F.split(i["parallel"], " "),
            "asked": text.without(text.find_all(phrase, "[a-z0-9]+"),
                                  vocab.SET_WORDS)}


def product_facts(other: Column, name: Column, console: Column
                  ) -> dict[str, Column]:
    """The same of a product; `other` is the identity of "name console" with
    the product's bracketed parallel already applied.

    bracket  words in the name's first brackets
    surplus  words of the full name that count against a game that does not
             ask for them
    """
    offered = F.array_distinct(text.find_all(text.join_platforms(F.lower(
        F.concat_ws(" ", name, console))), "[a-z0-9]+"))
    return {"colours": identity.colours(other["parallel"]),
            "finish": F.split(other["parallel"], " "),
            "bracket": text.find_all(F.lower(F.regexp_extract(
                name, vocab.BRACKET, 1)), "[a-z]{3,}"),
            "offered": offered,
            "surplus": F.filter(
                text.without(offered, vocab.SET_WORDS + vocab.GAME_STOPWORDS),
                lambda w: (F.length(w) > 1) | w.rlike(r"^\d$")),
            "console_low": F.lower(F.coalesce(console, F.lit("")))}


def score_parts(mine: Column, other: Column, said: Column,
                name_match: Column) -> dict[str, Column]:
    """What the confidence that a catalogue product is this asset takes from
    the fields in SHARED; asset_keys adds the few others.

    mine, other  identity fields with asset_facts and product_facts
    said         those bracket words of the product (and perhaps others)
                 that the listing's text contains
    name_match   match score of the wanted name against the product name
    """
    def both(field):
        return mine[field].isNotNull() & other[field].isNotNull()

    def contradicts(field):
        return both(field) & (mine[field] != other[field])

    is_game = mine["is_game"]
    wrong_subject = (~is_game & (F.size(mine["subject"]) > 0)
                     & (F.size(other["subject"]) > 0)
                     & ~text.overlap(mine["subject"], other["subject"]))
    ruled_out = contradicts("number") | contradicts("year") | wrong_subject

    colour = F.when((F.size(mine["colours"]) > 0)
                    & (F.size(other["colours"]) > 0),
                    F.when(text.overlap(mine["colours"], other["colours"]),
                           F.lit(0.16)).otherwise(F.lit(-0.22))
                    ).otherwise(F.lit(0.0))
    shared = word_overlap(mine["finish"], other["finish"])
    finish = (F.when(shared >= 0.5, F.lit(0.08) * shared)
              .when(shared == 0.0, F.lit(-0.12))
              .when(shared.isNotNull(), F.lit(0.0))
              .when(mine["parallel"].isNotNull(), F.lit(0.02))
              .when(other["parallel"].isNotNull(), F.lit(-0.08))
              .otherwise(F.lit(0.0)))
    unasked = F.when(F.size(other["bracket"]) > 0, F.size(F.filter(
        other["bracket"], lambda w: ~F.array_contains(said, w)))).otherwise(0)

    asked = mine["asked"]
    surplus = F.size(F.array_except(other["surplus"], asked))
    recall = (F.size(F.array_intersect(asked, other["offered"]))
              / F.greatest(F.size(asked), F.lit(1)))
    game = F.when(is_game & (F.size(asked) > 0),
                  F.lit(0.22) * recall - F.lit(0.11)
                  - F.least(F.lit(0.24), F.lit(0.09) * surplus)
                  ).otherwise(F.lit(0.0))

    console_low = other["console_low"]
    hits = F.size(F.filter(mine["set_tokens"],
                           lambda w: console_low.contains(w)))
    wants_set = (console_low != "") & (F.size(mine["set_tokens"]) > 0)
    placed = (F.when(wants_set, F.lit(0.26)
                     * (hits / F.greatest(F.size(mine["set_tokens"]),
                                          F.lit(1)))
                     + F.when(hits == 0, F.lit(-0.12)).otherwise(F.lit(0.0)))
              .when((console_low != "")
                    & F.coalesce(console_low.contains(mine["year"]),
                                 F.lit(False)), F.lit(0.08))
              .otherwise(F.lit(0.0)))

    head = (F.lit(0.42) * name_match
            + amount(both("number") & (mine["number"] == other["number"]),
                     0.18)
            + colour + finish
            - F.least(F.lit(0.18), F.lit(0.07) * unasked))
    # each term is stored as it is added, so that sums keep their last digit
    return {"ruled_out": ruled_out, "head": head,
            "region": amount(mine["region"] != other["region"], -0.25),
            "game": game, "placed": placed}


def told_apart(mine: Column, other: Column, printed: Column) -> Column:
    """Bits of the fields in SHARED in which a product is like the listing:
    a product that has a bit which another lacks is told apart from it."""
    def bit(test, value):
        return F.when(test, F.lit(value)).otherwise(F.lit(0))

    return (bit(text.overlap(identity.colours(mine["parallel"]),
                             identity.colours(printed)), LIKE_COLOUR)
            + bit(text.overlap(mine["subject"], other["subject"]),
                  LIKE_SUBJECT)
            + bit(mine["number"].isNotNull()
                  & mine["number"].eqNullSafe(other["number"]), LIKE_NUMBER))


def asset_keys(mine: dict[str, Column], parts: Column) -> Column:
    """One number per offered product, in the order of `parts`: the greater,
    the better; of equal scores the earlier product is greater.

    It holds the 0..1 score in thousandths (key_score), the place in `parts`
    (key_place) and the bits in which the product is like the listing
    (key_likeness).  mine: the fields in OWN.  parts: per product what
    score_parts and told_apart give for the other fields, and its own.
    """
    def key(part, place):
        serial, theirs = mine["serial"], part["serial"]
        stated = serial.isNotNull() & theirs.isNotNull()
        same_serial = stated & (serial == theirs)
        both_variants = ((F.size(mine["variant"]) > 0)
                         & (F.size(part["variant"]) > 0))
        like_variant = both_variants & text.overlap(mine["variant"],
                                                    part["variant"])
        variant = F.when(both_variants, F.when(
            like_variant, F.lit(0.10)).otherwise(F.lit(-0.08))
        ).otherwise(F.lit(0.0))
        total = (part["head"] + amount(same_serial, 0.06)
                 + amount(mine["is_auto"] == part["is_auto"], 0.04)
                 + variant
                 + amount(mine["foreign"] != part["foreign"], -0.30)
                 + part["region"] + part["game"] + part["placed"])
        score = F.when(part["ruled_out"] | (stated & (serial != theirs)),
                       F.lit(0).cast("long")).otherwise(thousandths(
                           F.greatest(F.lit(0.0), F.least(F.lit(1.0),
                                                          total))))
        return (score * (PLACES * LIKE_ALL)
                + (F.lit(PLACES - 1) - place) * F.lit(LIKE_ALL)
                + part["told"]
                + F.when(like_variant, LIKE_VARIANT).otherwise(0)
                + F.when(same_serial, LIKE_SERIAL).otherwise(0))

    return F.transform(parts, key)


def key_score(key: Column) -> Column:
    return F.shiftright(key, KEY_BITS) / 1000.0


def key_place(key: Column) -> Column:
    """Zero-based place in the array of products."""
    return (F.lit(PLACES - 1) - F.shiftright(key, LIKE_BITS).bitwiseAND(
        F.lit(PLACES - 1))).cast("int")


def rival_key(keys: Column, best: Column) -> Column:
    """The best of the other products that the listing does not tell apart
    from the best one; NULL without any."""
    likeness = best.bitwiseAND(F.lit(LIKE_ALL - 1))
    return F.array_max(F.filter(keys, lambda k: (k != best) & (
        k.bitwiseAND(likeness) == likeness)))


def amount(test: Column, value: float) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def thousandths(value: Column) -> Column:
    """A non-negative score in thousandths, rounded half up."""
    return F.floor(value * 1000.0 + 0.5)
