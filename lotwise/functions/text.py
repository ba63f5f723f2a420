"""Text primitives as Column expressions."""
from __future__ import annotations

import re
from functools import lru_cache
from re import _parser as patterns

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def word_list(items) -> Column:
    """A constant array; folds to one literal at planning time."""
    return F.split(F.lit("\t".join(items)), "\t")


def fold(text) -> Column:
    """Drop accents from Latin letters only; other scripts pass through."""
    text = as_col(text)
    stripped = F.regexp_replace(text, r"([A-Za-z])[̀-ͯ]+", "$1")
    # ASCII has nothing to drop: as many bytes as characters
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(
        F.translate(stripped, vocab.ACCENTS_FROM, vocab.ACCENTS_TO))


def folded(text) -> Column:
    """Accent-folded, lower-cased text; NULL reads as empty."""
    return F.lower(fold(F.coalesce(as_col(text), F.lit(""))))


def first_characters(parsed) -> tuple[set[str] | None, bool]:
    """(characters that a match may begin with, whether it may be empty);
    None when they cannot be listed."""
    found: set[str] = set()
    for op, value in parsed:
        name, empty = str(op), False
        if name == "AT":                    # word and text boundaries
            continue
        if name == "LITERAL":
            chars = {chr(value)}
        elif name == "IN":
            chars = set()
            for kind, item in value:
                if str(kind) == "LITERAL":
                    chars.add(chr(item))
                elif str(kind) == "RANGE" and item[1] < 128:
                    chars.update(map(chr, range(item[0], item[1] + 1)))
                elif str(item) == "CATEGORY_DIGIT":
                    chars.update("0123456789")
                elif str(item) == "CATEGORY_SPACE":
                    chars.update(" \t\n\r\f\v")
                else:
                    return None, False
        elif name in ("BRANCH", "SUBPATTERN", "MAX_REPEAT"):
            parts = value[1] if name == "BRANCH" else [value[-1]]
            each = [first_characters(part) for part in parts]
            if any(c is None for c, _ in each):
                return None, False
            chars = set().union(*(c for c, _ in each))
            empty = any(e for _, e in each) or (
                name == "MAX_REPEAT" and value[0] == 0)
        else:
            return None, False
        found |= chars
        if not empty:
            return found, False
    return found, True


@lru_cache(maxsize=None)
def quick(pattern: str) -> str:
    """The same pattern, entered only where a match can begin: one look at a
    character instead of one try per alternative.  Groups keep their number."""
    if "|" not in pattern or "(?i" in pattern:
        return pattern
    chars, empty = first_characters(patterns.parse(pattern))
    if chars is None or empty:
        return pattern
    listed = "".join(re.escape(c) for c in sorted(chars))
    return f"(?=[{listed}])(?:{pattern})"


def hit(text: Column, pattern: str) -> Column:
    return text.rlike(quick(pattern))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(quick(pattern)), F.lit(group))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, or NULL."""
    return F.nullif(F.regexp_extract(text, quick(pattern), group), F.lit(""))


def without(array: Column, items) -> Column:
    """Distinct elements not in a fixed list, in order (one set lookup per
    element, however long the list)."""
    return F.array_distinct(F.filter(array, lambda w: ~w.isin(*items)))


def only(array: Column, items) -> Column:
    """Distinct elements of a fixed list, in order of the array."""
    return F.array_distinct(F.filter(array, lambda w: w.isin(*items)))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def contains_any(text: Column, needles) -> Column:
    """Substring (not word) containment of any needle, as one pattern of
    quoted texts so that the searched text is evaluated once."""
    needles = list(needles)
    if not needles:
        return F.lit(False)
    return text.rlike("|".join(rf"\Q{needle}\E" for needle in needles))


def overlap(a: Column, b: Column) -> Column:
    """True when both arrays share an element; never NULL."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def covers(needed: Column, available: Column) -> Column:
    """Every element of `needed` is in `available`."""
    return F.size(F.array_except(needed, available)) == 0


def alpha_words(low: Column) -> Column:
    return find_all(low, "[a-z]+")


def match_tokens(low: Column, graded: Column) -> Column:
    """Comparison tokens: grade tokens become one grade word, noise dropped.

    `low` is folded text and `graded` the array of its valid effective
    grades (see grades.parse_grades).  Grade text never survives as words,
    so an impossible grade cannot match another impossible grade.
    """
    stripped = F.regexp_replace(low, quick(vocab.GRADE_TOKEN), " ")
    plain = find_all(stripped, vocab.WORD_TOKEN)
    grade_words = F.transform(
        graded, lambda g: F.concat(F.lit("grade"), number_text(g)))
    return without(F.concat(plain, grade_words), vocab.NOISE_WORDS)


def number_text(value: Column) -> Column:
    """Shortest text of a grade-like number: 9, 8.5."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def subject_words(low: Column) -> Column:
    """Words that name the subject: not context, longer than one letter."""
    kept = without(alpha_words(low), vocab.GENERIC_WORDS)
    return F.filter(kept, lambda w: F.length(w) > 1)


def subject_candidates(low: Column, limit: int = 2) -> Column:
    """First distinct subject words of three letters or more, title order."""
    kept = without(alpha_words(low), vocab.GENERIC_WORDS)
    return F.slice(F.filter(kept, lambda w: F.length(w) >= 3), 1, limit)


def join_platforms(low: Column) -> Column:
    for pattern, word in vocab.PLATFORM_SPELLING:
        low = F.regexp_replace(low, pattern, word)
    return low


def set_words(text) -> Column:
    """Maker and set words of a title, in title order, at most four."""
    low = join_platforms(F.lower(F.coalesce(as_col(text), F.lit(""))))
    return F.slice(only(alpha_words(low), vocab.SET_WORDS), 1, 4)


def redact(text) -> Column:
    """Common credential shapes replaced by a marker."""
    out = as_col(text)
    for pattern in vocab.SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, "$1<redacted>")
    return out


def excluded_keyword(text, keywords) -> Column:
    """Any configured keyword as a case-insensitive substring."""
    return contains_any(F.lower(as_col(text)), [k.lower() for k in keywords])


def has_condition_mark(text, marks) -> Column:
    """A capital-letter condition mark as a whole token, optional parens."""
    quoted = "|".join(r"\Q%s\E" % m.strip() for m in marks if m.strip())
    return as_col(text).rlike(
        rf"(?:^|[^A-Za-z0-9])\(?(?:{quoted})\)?(?:$|[^A-Za-z0-9])")


def translate_query(query) -> Column:
    """English standing query to Japanese search terms, longest term first."""
    out = F.lower(as_col(query))
    for term in sorted(vocab.JAPANESE_TERMS, key=len, reverse=True):
        out = F.replace(out, F.lit(term), F.lit(vocab.JAPANESE_TERMS[term]))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def wanted_tokens(text) -> Column:
    """Tokens for wanted-item matching, common phrases normalised first."""
    low = folded(text)
    for phrase, replacement in vocab.WANTED_PHRASES:
        low = F.replace(low, F.lit(phrase), F.lit(replacement))
    return F.array_distinct(find_all(low, "[a-z0-9]+"))


def typo_variants(word) -> Column:
    """Plausible misspellings of one word: curated, else the first three
    distinct results of dropping a letter or swapping two neighbours."""
    low = F.lower(as_col(word))
    size = F.length(low)

    def dropped(i):
        return F.concat(F.substring(low, F.lit(1), i),
                        F.substring(low, i + 2, size))

    def swapped(i):
        return F.concat(F.substring(low, F.lit(1), i),
                        F.substring(low, i + 2, F.lit(1)),
                        F.substring(low, i + 1, F.lit(1)),
                        F.substring(low, i + 3, size))

    long_enough = size >= 3
    drops = F.transform(F.sequence(F.lit(1), size - 1), dropped)
    swaps = F.when(long_enough, F.transform(
        F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), swapped)
    ).otherwise(F.array().cast("array<string>"))
    made = F.slice(F.filter(F.array_distinct(F.concat(drops, swaps)),
                            lambda w: w != low), 1, 3)
    curated = F.create_map(*[x for k, v in vocab.KNOWN_TYPOS.items()
                             for x in (F.lit(k), word_list(v))])
    skip = (size < 6) | F.array_contains(word_list(vocab.TYPO_STOPWORDS), low)
    return (F.when(skip, F.array().cast("array<string>"))
            .otherwise(F.coalesce(F.try_element_at(curated, low), made)))


def category(query, object_class=None) -> Column:
    """Report category of a standing query; the listing's own object class
    overrides sports cards when it is memorabilia."""
    low = folded(query)
    base = (F.when(contains_any(low, vocab.WATCH_KEYWORDS), "Watches")
            .when(contains_any(low, vocab.PLATFORM_KEYWORDS), "Video Games")
            .when(contains_any(low, vocab.POKEMON_KEYWORDS), "Pokemon Cards")
            .when(contains_any(low, vocab.GAME_TITLE_KEYWORDS), "Video Games")
            .when(contains_any(low, vocab.POP_KEYWORDS), "Other")
            .otherwise("Sports Cards"))
    if object_class is None:
        return base
    return of_object(base, object_class)


def of_object(base, object_class) -> Column:
    """The category of a query, given the listing's own object class."""
    base = as_col(base)
    return F.when((base == "Sports Cards")
                  & (as_col(object_class) == "memorabilia"),
                  "Sports Memorabilia").otherwise(base)


def sealed_product(name) -> Column:
    """Sealed product rather than a single: a sealed word and no number."""
    low = F.lower(as_col(name))
    return ~low.rlike(r"#\s*\d+") & low.rlike(vocab.SEALED_PRODUCT)


def text_or_empty(value) -> Column:
    return F.lower(F.coalesce(as_col(value), F.lit("")))
