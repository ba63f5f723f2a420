"""Title to structured identity, as staged projections.

`with_identity` adds one struct column.  The stages are separate projections
so that an expensive intermediate (grade tokens, folded text) is computed
once per row; Catalyst keeps them apart because later stages use them more
than once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from . import grades, text, variants

FIELDS = (
    "low", "object_class", "year", "years", "subject", "subject_all", "words",
    "card_number", "number", "parallel", "serial", "is_auto", "is_relic",
    "grader", "grade", "printed_grade", "qualifier", "holo", "edition",
    "series", "completeness", "variant", "set_tokens", "effective", "tokens",
    "foreign", "region",
)
# What judging one text against another needs.
MATCH_FIELDS = ("low", "subject_all", "words", "years", "card_number",
                "grader", "holo", "edition", "series", "completeness",
                "effective", "tokens")
# What deciding whether two assets differ needs.
ASSET_FIELDS = ("object_class", "year", "subject", "number", "parallel",
                "serial", "is_auto", "is_relic", "qualifier")


def object_class(low: Column, grader: Column) -> Column:
    """Coarse physical class; the first rule that applies wins."""
    def hit(pattern):
        return text.hit(low, pattern)

    card_graded = grader.isin(*vocab.CARD_GRADERS)
    return (F.when(hit(vocab.WATCH_PART), "watch_part")
            .when(hit(vocab.WATCH), "watch")
            .when(hit(vocab.FIGURE), "figure")
            .when(hit(vocab.WRAPPER), "wrapper")
            .when(hit(vocab.COUPON), "coupon")
            .when(hit(vocab.PACK), "pack")
            .when(hit(vocab.STRONG_MEMORABILIA) & ~hit(vocab.CARD_PRODUCT),
                  "memorabilia")
            .when(hit(vocab.MEMORABILIA) & ~hit(vocab.CARD_ONLY),
                  "memorabilia")
            .when(card_graded & hit(vocab.COMIC) & ~hit(vocab.CARD_ONLY),
                  "comic")
            .when(card_graded, "card")
            .when(grader.isin(*vocab.GAME_GRADERS), "game")
            .when(hit(vocab.COMIC), "comic")
            .when(hit(vocab.GAME), "game")
            .when(hit(vocab.CARD), "card")
            .otherwise("unknown"))


def normal_finish(word: Column) -> Column:
    for raw, spelling in vocab.FINISH_SPELLING.items():
        word = F.when(word == raw, F.lit(spelling)).otherwise(word)
    return word


def parallel(low: Column, found: Column | None = None) -> Column:
    """Sorted finish and colour words; a bare colour is not a parallel
    unless a finish word or a print run corroborates it.  `found`: the words
    when they are a column already."""
    if found is None:
        found = text.find_all(low, vocab.PARALLEL, 1)
    corroborated = (text.overlap(found, text.word_list(vocab.FINISH_WORDS))
                    | low.rlike(vocab.SERIAL))
    joined = F.array_join(F.array_sort(F.array_distinct(
        F.transform(found, normal_finish))), " ")
    return F.when((F.size(found) > 0) & corroborated, joined)


def catalogue_parallel(name) -> Column:
    """The parallel a catalogue name declares in brackets."""
    inside = F.lower(F.regexp_extract(text.as_col(name), vocab.BRACKET, 1))
    found = text.only(F.transform(text.alpha_words(inside), normal_finish),
                      vocab.PARALLEL_WORDS)
    return F.nullif(F.array_join(F.array_sort(found), " "), F.lit(""))


def serial(low: Column, number: Column) -> Column:
    """Print-run size: smallest n of /n up to 5000; 1 for one-of-one.  A set
    position such as 6/102 is not a print run."""
    runs = text.find_all(low, vocab.SERIAL, 1)
    positions = F.when(number.isNotNull(), F.regexp_extract_all(
        low, F.concat(F.lit(r"\b"), number, F.lit(r"\s*/\s*(\d{1,5})\b")),
        F.lit(1)))
    sizes = F.transform(
        F.when(positions.isNull(), runs)
        .otherwise(F.array_except(runs, positions)), lambda r: r.cast("int"))
    smallest = F.array_min(F.filter(
        sizes, lambda n: (n >= 1) & (n <= vocab.MAX_PRINT_RUN)))
    return F.when(low.rlike(vocab.ONE_OF_ONE), F.lit(1)).otherwise(smallest)


def qualifier(low: Column) -> Column:
    """Grade qualifier word: altered, authentic, qualified, or as printed."""
    word = F.regexp_replace(text.extract(low, vocab.QUALIFIER, 1), r"\s+", " ")
    # nearly all texts state none: one search settles them
    return (F.when(~text.hit(low, vocab.QUALIFIER), F.lit(None))
            .when(word.contains("altered"), "altered")
            .when(word.isin("auth", "authentic"), "authentic")
            .when(word.isin("mk", "qualified"), "qualified")
            .otherwise(word))


def with_identity(df: DataFrame, title: str = "title", out: str = "ident",
                  fields: tuple[str, ...] | None = None) -> DataFrame:
    """Add the identity struct of a text column (all fields, or the named
    ones).

    The struct passes through a one-row generator.  Predicates on its fields
    then stay above the parse instead of being pushed below it with the
    whole expression copied into each of them; predicates on other columns
    still reach the scan.
    """
    p = f"_{out}_"
    keep = df.columns
    staged = df.select(
        "*", text.folded(title).alias(p + "low"),
        grades.grade_tokens(title).alias(p + "tokens"))
    low = F.col(p + "low")
    staged = staged.select(
        *keep, p + "low",
        text.first(F.filter(p + "tokens", lambda t: t["grade"].isNotNull())
                   ).alias(p + "g"),
        grades.valid_effective(F.col(p + "tokens")).alias(p + "eff"),
        variants.years(low).alias(p + "years"),
        variants.card_number(low).alias(p + "plain"),
        qualifier(low).alias(p + "qual"),
        text.alpha_words(low).alias(p + "words"),
        variants.holo_class(low).alias(p + "holo"),
        variants.edition_class(low).alias(p + "edition"),
        variants.topsun_series(low).alias(p + "series"),
        variants.completeness(low).alias(p + "complete"),
        text.find_all(low, vocab.PARALLEL, 1).alias(p + "finish"))
    named = text.without(F.col(p + "words"), vocab.GENERIC_WORDS)
    numeric = ~F.coalesce(F.col(p + "qual").isin("authentic", "altered"),
                          F.lit(False))
    made = [
        low.alias("low"),
        object_class(low, F.col(p + "g.grader")).alias("object_class"),
        F.array_min(p + "years").alias("year"),
        F.col(p + "years").alias("years"),
        F.slice(F.filter(named, lambda w: F.length(w) >= 3), 1, 2
                ).alias("subject"),
        F.filter(named, lambda w: F.length(w) > 1).alias("subject_all"),
        F.array_distinct(p + "words").alias("words"),
        F.col(p + "plain").alias("card_number"),
        F.coalesce(F.col(p + "plain"),
                   F.upper(text.extract(low, vocab.ALNUM_NUMBER))
                   ).alias("number"),
        parallel(low, F.col(p + "finish")).alias("parallel"),
        serial(low, F.col(p + "plain")).alias("serial"),
        text.hit(low, vocab.AUTOGRAPH).alias("is_auto"),
        text.hit(low, vocab.RELIC).alias("is_relic"),
        F.col(p + "g.grader").alias("grader"),
        F.when(numeric, F.col(p + "g.effective")).alias("grade"),
        F.when(numeric, F.col(p + "g.grade")).alias("printed_grade"),
        F.col(p + "qual").alias("qualifier"),
        F.col(p + "holo").alias("holo"),
        F.col(p + "edition").alias("edition"),
        F.col(p + "series").alias("series"),
        F.col(p + "complete").alias("completeness"),
        F.array_compact(F.array(p + "holo", p + "edition", p + "series",
                                p + "complete")).alias("variant"),
        text.set_words(title).alias("set_tokens"),
        F.col(p + "g.effective").alias("effective"),
        text.match_tokens(low, F.col(p + "eff")).alias("tokens"),
        text.hit(low, vocab.FOREIGN).alias("foreign"),
        text.hit(low, vocab.REGION).alias("region")]
    if fields is not None:
        made = [c for name, c in zip(FIELDS, made) if name in fields]
    return staged.select(*keep, F.explode(F.array(F.struct(*made))).alias(out))


def fingerprint(i: Column) -> Column:
    """Grouping key: equal keys are the same tradeable asset."""
    grade = (F.when(i["qualifier"].isNotNull(),
                    F.concat(F.lit("auth:"), i["qualifier"]))
             .otherwise(F.coalesce(text.number_text(i["grade"]),
                                   F.lit("raw"))))

    def joined(array, missing):
        return F.coalesce(F.nullif(F.array_join(array, " "), F.lit("")),
                          F.lit(missing))

    return F.concat_ws(
        "|", i["object_class"], F.coalesce(i["year"], F.lit("?")),
        joined(i["subject"], "?"), F.coalesce(i["number"], F.lit("?")),
        F.coalesce(i["parallel"], F.lit("-")),
        F.coalesce(i["serial"].cast("string"), F.lit("-")),
        F.when(i["is_auto"], "auto").otherwise("-"),
        F.when(i["is_relic"], "relic").otherwise("-"),
        joined(i["variant"], "-"), grade)


def specificity(i: Column) -> Column:
    """0..1: how precisely the title names one physical asset."""
    def points(test, amount):
        return F.when(test, F.lit(amount)).otherwise(F.lit(0))

    graded = i["grade"].isNotNull() | i["qualifier"].isNotNull()
    has_number = i["number"].isNotNull()
    has_variant = F.size(i["variant"]) > 0
    # whole thousandths, so that the sum is exact
    base = (points(i["object_class"] != "unknown", 150)
            + points(F.size(i["subject"]) > 0, 200)
            + points(i["year"].isNotNull(), 100))
    game = (points((F.size(i["set_tokens"]) > 0) | has_variant, 250)
            + points(graded, 250) + points(has_number, 50))
    comic = points(has_number, 300) + points(graded, 200)
    other = (points(has_number, 250) + points(graded, 150)
             + F.when(i["serial"].isNotNull() | i["parallel"].isNotNull(), 150)
             .when(has_variant, 100).otherwise(0))
    extra = (F.when(i["object_class"] == "game", game)
             .when(i["object_class"] == "comic", comic).otherwise(other))
    return F.least(F.lit(1000), base + extra) / F.lit(1000.0)


def conflict_reason(a: Column, b: Column) -> Column:
    """Why two identities are different assets, or NULL when compatible.

    Only fields stated on both sides can conflict; autograph, relic and
    qualifier are always stated.  There is no variant rule here: variants
    are judged by variants.variant_conflict.
    """
    def differ(field):
        return F.coalesce(a[field] != b[field], F.lit(False))

    both_classes = ((a["object_class"] != "unknown")
                    & (b["object_class"] != "unknown"))
    both_subjects = (F.size(a["subject"]) > 0) & (F.size(b["subject"]) > 0)
    return (F.when(both_classes & differ("object_class"), "object class")
            .when(differ("year"), "year")
            .when(differ("number"), "card number")
            .when(differ("parallel"), "parallel")
            .when(differ("serial"), "serial")
            .when(a["is_auto"] != b["is_auto"], "autograph")
            .when(a["is_relic"] != b["is_relic"], "relic")
            .when(~a["qualifier"].eqNullSafe(b["qualifier"]), "qualifier")
            .when(both_subjects & ~text.overlap(a["subject"], b["subject"]),
                  "subject"))


def colours(parallel_text: Column) -> Column:
    return text.only(F.split(F.coalesce(parallel_text, F.lit("")), " "),
                     vocab.COLOUR_WORDS)


def guide_phrase(i: Column, title: Column) -> Column:
    """Grade-free catalogue search phrase of an identity."""
    words = text.find_all(text.join_platforms(text.text_or_empty(title)),
                          "[a-z0-9]+")
    game = F.array_join(F.slice(F.filter(
        text.without(words, vocab.GAME_STOPWORDS),
        lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$")), 1, 8), " ")
    parts = F.concat(
        F.array(i["year"]), i["set_tokens"], i["subject"],
        F.array(F.concat(F.lit("#"), i["number"]), i["parallel"],
                F.when(i["serial"] > 1,
                       F.concat(F.lit("/"), i["serial"].cast("string"))),
                F.when(i["is_auto"], F.lit("auto"))))
    card = F.array_join(F.array_distinct(F.array_compact(parts)), " ")
    return F.when(i["object_class"] == "game", game).otherwise(card)


def genre_class(genre) -> Column:
    low = F.lower(text.as_col(genre))
    return (F.when(low.contains("card"), "card")
            .when(low.contains("comic"), "comic")
            .when(text.contains_any(low, vocab.GAME_GENRE_WORDS), "game"))


def match_band(score: Column) -> Column:
    return (F.when(score >= 0.80, "exact").when(score >= 0.62, "strong")
            .when(score >= 0.40, "weak").otherwise("none"))


def attach(df: DataFrame, column: str, out: str = "ident",
           fields: tuple[str, ...] | None = None,
           parsed: DataFrame | None = None) -> DataFrame:
    """with_identity, or a join with a stored table of parsed texts."""
    if parsed is None:
        return with_identity(df, column, out, fields)
    return df.join(parsed.select(F.col("text").alias(column),
                                 F.col("ident").alias(out)), column)


def parse_distinct(df: DataFrame, column: str, out: str = "ident",
                   fields: tuple[str, ...] | None = None,
                   parsed: DataFrame | None = None) -> DataFrame:
    """(column, identity) once per distinct text, to be joined back."""
    return attach(df.select(column).distinct(), column, out, fields, parsed)


def parse_texts(*columns: DataFrame, fields: tuple[str, ...] | None = None
                ) -> DataFrame:
    """(text, ident) of every distinct text of one-column frames, with all
    fields or the named ones; worth storing when several operators read the
    same texts."""
    texts = columns[0].toDF("text")
    for other in columns[1:]:
        texts = texts.union(other.toDF("text"))
    return with_identity(texts.filter(F.col("text").isNotNull()).distinct(),
                         "text", "ident", fields)
