"""Queries over the text-to-structure functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..config import DEFAULT
from ..functions import grades, identity, matching, text, urls, variants
from ..functions.stage import stage
from ..sources.adapters import ctes, table, view
from . import duck
from .registry import query

TITLES = ctes("titles")


def titles(spark, sf_dir):
    return view(spark, sf_dir, "titles")


def lowered(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "*", text.folded("title").alias("low"),
        text.folded("query").alias("qlow"))


LOWERED = f"""{TITLES}, t AS (SELECT *, {duck.folded('title')} AS low,
 {duck.folded('query')} AS qlow, lower(title) AS raw_low FROM titles)"""


@query("text_fold", "T1", f"""
SELECT doc_id, {duck.fold('text')} AS folded FROM documents""")
def text_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.fold("text").alias("folded"))


@query("text_redact", "T51", """
SELECT doc_id, {} AS clean FROM documents""".format(
    "regexp_replace(" * 4 + "text, "
    + ", ".join(f"{duck.lit(p)}, '\\1<redacted>', 'g')"
                for p in vocab.SECRET_PATTERNS)))
def text_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.redact("text").alias("clean"))


@query("text_tokens", "T2", f"""{LOWERED}
SELECT title, query, array_to_string(list_sort({duck.tokens('low', 'gt')}),
 ' ') AS tokens FROM (SELECT *, {duck.grade_tokens('raw_low')} AS gt FROM t)
""")
def text_tokens(spark, sf_dir):
    staged = lowered(spark, sf_dir).select(
        "*", grades.valid_effective(grades.grade_tokens("title")).alias("e"))
    return staged.select("title", "query", F.array_join(F.array_sort(
        text.match_tokens(F.col("low"), F.col("e"))), " ").alias("tokens"))


@query("grade_parse", "T3 T4 T5", f"""{LOWERED}, g AS (SELECT title, query,
 list_filter({duck.grade_tokens('raw_low')},
 lambda x: x.grade IS NOT NULL)[1] AS gi FROM t)
SELECT title, query, gi.grader AS grader, gi.grade AS grade,
 {duck.effective('gi.grader', 'gi.grade')} AS effective FROM g""")
def grade_parse(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "title", "query", grades.grade_info("title").alias("g")).select(
        "title", "query", "g.grader", "g.grade", "g.effective")


@query("grade_rejects", "T6", f"""{LOWERED}
SELECT upper(x.grader) || ' ' || x.label AS label,
 CAST(sum(copies) AS BIGINT) AS uses, count(*) AS titles
FROM (SELECT copies, unnest({duck.grade_tokens('raw_low')}) AS x FROM t)
WHERE x.grade IS NULL GROUP BY 1""")
def grade_rejects(spark, sf_dir):
    """Grade tokens no rule accepts, as evidence of new seller habits."""
    token = F.explode(F.filter(grades.grade_tokens("title"),
                               lambda t: t["grade"].isNull()))
    return (titles(spark, sf_dir).select("copies", token.alias("t"))
            .groupBy(F.concat_ws(" ", F.upper("t.grader"), "t.label")
                     .alias("label"))
            .agg(F.sum("copies").alias("uses"), F.count("*").alias("titles")))


@query("grade_conflicts", "T19", f"""{TITLES}, e AS (SELECT title, query,
 list_filter({duck.grade_tokens('lower(title)')}, lambda x: x.grade IS NOT NULL)[1] AS t,
 list_filter({duck.grade_tokens('lower(query)')}, lambda x: x.grade IS NOT NULL)[1] AS q
 FROM titles), f AS (SELECT title, query,
 {duck.effective('t.grader', 't.grade')} AS te,
 {duck.effective('q.grader', 'q.grade')} AS qe FROM e)
SELECT title, query, coalesce(te <> qe, false) AS listing_conflict,
 coalesce(te, 5e0) <> coalesce(qe, 5e0) AS comp_conflict FROM f""")
def grade_conflicts(spark, sf_dir):
    staged = titles(spark, sf_dir).select(
        "title", "query", grades.grade_info("title")["effective"].alias("te"),
        grades.grade_info("query")["effective"].alias("qe"))
    q, t = F.col("qe"), F.col("te")
    return staged.select(
        "title", "query",
        grades.grade_conflict(q, t).alias("listing_conflict"),
        grades.grade_conflict(q, t, True).alias("comp_conflict"))


@query("title_match", "T7", f"""{LOWERED}, g AS (SELECT *,
 {duck.grade_tokens('raw_low')} AS gt, {duck.grade_tokens('qlow')} AS qg FROM t),
 k AS (SELECT *, {duck.tokens('low', 'gt')} AS tt,
 {duck.tokens('qlow', 'qg')} AS qt FROM g)
SELECT title, query, round({duck.coverage('qt', 'tt')}, 6) AS coverage,
 round({duck.match_score('qt', 'tt', 'qlow', 'low')}, 6) AS score FROM k""")
def title_match(spark, sf_dir):
    staged = identity.with_identity(identity.with_identity(
        titles(spark, sf_dir), "title", "t"), "query", "q")
    return staged.select(
        "title", "query",
        F.round(matching.coverage(F.col("q.tokens"), F.col("t.tokens")), 6
                ).alias("coverage"),
        F.round(matching.match_score(
            F.col("q.tokens"), F.col("t.tokens"), F.col("q.low"),
            F.col("t.low")), 6).alias("score"))


@query("title_match_sequence", "T7")
def title_match_sequence(spark, sf_dir):
    """Exact block-similarity score; the coverage filter in front of the
    Arrow function loses no pair that could reach the threshold."""
    staged = identity.with_identity(identity.with_identity(
        titles(spark, sf_dir), "title", "t"), "query", "q")
    cover = matching.coverage(F.col("q.tokens"), F.col("t.tokens"))
    near = staged.filter(cover >= matching.coverage_floor(DEFAULT.min_match))
    score = matching.match_score(
        F.col("q.tokens"), F.col("t.tokens"), F.col("q.low"), F.col("t.low"),
        similarity="sequence")
    # staged, so that the filter does not run the function a second time
    return stage(near, score=F.round(score, 6)).select(
        "title", "query", "score").filter(F.col("score") >= DEFAULT.min_match)


@query("variant_classes", "T8 T9 T10 T11 T12 T13", f"""{LOWERED}
SELECT title, query, {duck.holo('low')} AS holo,
 {duck.edition('low')} AS edition, {duck.series('low')} AS series,
 {duck.completeness('low')} AS completeness,
 {duck.hit('low', vocab.FOREIGN)} OR ({duck.hit('low', vocab.JAPANESE)}
 AND NOT {duck.hit('qlow', vocab.JAPANESE_NATIVE_QUERY)}) AS language_conflict,
 {" OR ".join(f"coalesce({fn('low')} <> {fn('qlow')}, false)"
              for fn in (duck.holo, duck.edition, duck.series,
                         duck.completeness))} AS variant_conflict FROM t""")
def variant_classes(spark, sf_dir):
    low, qlow = F.col("low"), F.col("qlow")
    return lowered(spark, sf_dir).select(
        "title", "query", variants.holo_class(low).alias("holo"),
        variants.edition_class(low).alias("edition"),
        variants.topsun_series(low).alias("series"),
        variants.completeness(low).alias("completeness"),
        variants.language_conflict(qlow, low).alias("language_conflict"),
        variants.variant_conflict(qlow, low).alias("variant_conflict"))


@query("years_and_numbers", "T14 T15 T16 T17 T18", f"""{LOWERED},
 y AS (SELECT title, query, {duck.years('low')} AS ty,
 {duck.years('qlow')} AS qy, {duck.card_number('low')} AS tn,
 {duck.card_number('qlow')} AS qn,
 upper({duck.part('low', vocab.ALNUM_NUMBER)}) AS an FROM t)
SELECT title, query, array_to_string(list_sort(list_distinct(ty)), ' ') AS years,
 len(qy) > 0 AND NOT list_has_any(qy, ty) AS year_conflict,
 tn AS card_number, coalesce(tn, an) AS full_number,
 qn IS NOT NULL AND qn IS DISTINCT FROM tn AS number_conflict FROM y""")
def years_and_numbers(spark, sf_dir):
    staged = lowered(spark, sf_dir).select(
        "*", variants.years(F.col("low")).alias("ty"),
        variants.years(F.col("qlow")).alias("qy"),
        variants.card_number(F.col("low")).alias("card_number"),
        variants.card_number(F.col("qlow")).alias("qn"))
    return staged.select(
        "title", "query",
        F.array_join(F.array_sort("ty"), " ").alias("years"),
        variants.year_conflict(F.col("qy"), F.col("ty")).alias(
            "year_conflict"), "card_number",
        variants.full_number(F.col("low")).alias("full_number"),
        variants.number_conflict(F.col("qn"), F.col("card_number")
                                 ).alias("number_conflict"))


@query("document_years", "T14", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(
 {duck.years(duck.folded('text'))})), ' ') AS years FROM documents""")
def document_years(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.array_sort(variants.years(
            text.folded("text"))), " ").alias("years"))


@query("subject_words", "T20 T21 T22", f"""{LOWERED}, w AS (SELECT title,
 query, {duck.every('low', '[a-z]+')} AS tw, {duck.every('qlow', '[a-z]+')}
 AS qw FROM t), s AS (SELECT *, list_filter({duck.minus(duck.uniq('tw'),
 duck.words(vocab.GENERIC_WORDS))}, lambda x: len(x) > 1) AS ts,
 list_filter({duck.minus('qw', duck.words(vocab.GENERIC_WORDS))},
 lambda x: len(x) > 1) AS qs FROM w)
SELECT title, query, array_to_string(list_sort(ts), ' ') AS subject,
 array_to_string(list_filter(ts, lambda x: len(x) >= 3)[1:2], ' ')
 AS candidates, len(qs) > 0 AND NOT list_has_any(qs, tw) AS subject_missing
FROM s""")
def subject_words(spark, sf_dir):
    low, qlow = F.col("low"), F.col("qlow")
    return lowered(spark, sf_dir).select(
        "title", "query", F.array_join(F.array_sort(
            text.subject_words(low)), " ").alias("subject"),
        F.array_join(text.subject_candidates(low), " ").alias("candidates"),
        variants.subject_missing(text.subject_words(qlow),
                                 text.alpha_words(low)
                                 ).alias("subject_missing"))


@query("conversation_subjects", "T21", f"""
SELECT conv_id, turn, array_to_string(list_filter({duck.minus(
    duck.uniq(duck.every(duck.folded('text'), '[a-z]+')),
    duck.words(vocab.GENERIC_WORDS))}, lambda x: len(x) >= 3)[1:2], ' ')
 AS candidates FROM conversations""")
def conversation_subjects(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(text.subject_candidates(
            text.folded("text")), " ").alias("candidates"))


IDENT = f"{TITLES}, {duck.identity('titles', 'title', 'i')}"


@query("identity", "T17 T23 T24 T25 T27 T28 T29 T30 T31 T32", f"""{IDENT}
SELECT title, query, object_class, year,
 array_to_string(subject, ' ') AS subject, number, parallel, serial, is_auto,
 is_relic, grader, grade, printed_grade, qualifier,
 array_to_string(variant, ' ') AS variant,
 array_to_string(set_tokens, ' ') AS set_tokens,
 {duck.fingerprint()} AS fingerprint, {duck.specificity()} AS specificity
FROM i""")
def identity_query(spark, sf_dir):
    i = F.col("ident")
    return identity.with_identity(titles(spark, sf_dir)).select(
        "title", "query", "ident.object_class", "ident.year",
        F.array_join("ident.subject", " ").alias("subject"), "ident.number",
        "ident.parallel", "ident.serial", "ident.is_auto", "ident.is_relic",
        "ident.grader", "ident.grade", "ident.printed_grade",
        "ident.qualifier",
        F.array_join("ident.variant", " ").alias("variant"),
        F.array_join("ident.set_tokens", " ").alias("set_tokens"),
        identity.fingerprint(i).alias("fingerprint"),
        identity.specificity(i).alias("specificity"))


@query("guide_phrase", "T35", f"""{IDENT}
SELECT title, query, {duck.guide_phrase('raw_low')} AS phrase FROM i""")
def guide_phrase(spark, sf_dir):
    return identity.with_identity(titles(spark, sf_dir)).select(
        "title", "query", identity.guide_phrase(
            F.col("ident"), F.col("title")).alias("phrase"))


@query("query_title_conflict", "T33", f"""{IDENT.replace('titles', 'titles')},
 {duck.identity('titles', 'query', 'q')}
SELECT i.title, i.query, {duck.conflict('q', 'i')} AS reason
FROM i JOIN q ON i.title = q.title AND i.query = q.query""")
def query_title_conflict(spark, sf_dir):
    both = identity.with_identity(identity.with_identity(
        titles(spark, sf_dir), "title", "t"), "query", "q")
    return both.select("title", "query", identity.conflict_reason(
        F.col("q"), F.col("t")).alias("reason"))


@query("catalogue_names", "T26 T38 T49", f"""{ctes('catalogue')}
SELECT product_id, {duck.catalogue_parallel('product_name')} AS parallel,
 {duck.case([("contains(lower(genre), 'card')", "'card'"),
             ("contains(lower(genre), 'comic')", "'comic'"),
             (duck.contains_any('lower(genre)', vocab.GAME_GENRE_WORDS),
              "'game'")])} AS genre_class,
 NOT regexp_matches(lower(product_name), '#\\s*\\d+') AND
 {duck.hit('lower(product_name)', vocab.SEALED_PRODUCT)} AS sealed
FROM catalogue""")
def catalogue_names(spark, sf_dir):
    return view(spark, sf_dir, "catalogue").select(
        "product_id",
        identity.catalogue_parallel("product_name").alias("parallel"),
        identity.genre_class("genre").alias("genre_class"),
        text.sealed_product("product_name").alias("sealed"))


@query("category_routing", "T39", f"""{IDENT}
SELECT title, query, {duck.category('query', 'object_class')} AS category
FROM i""")
def category_routing(spark, sf_dir):
    return identity.with_identity(titles(spark, sf_dir)).select(
        "title", "query",
        text.category("query", "ident.object_class").alias("category"))


@query("title_exclusions", "T40 T41", f"""{TITLES}
SELECT title, query, {duck.contains_any(
    'lower(title)', DEFAULT.excluded_keywords)} AS keyword,
 regexp_matches(title, '(?:^|[^A-Za-z0-9])\\(?(?:OC|MK|ST)\\)?(?:$|[^A-Za-z0-9])')
 AS condition_mark FROM titles""")
def title_exclusions(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "title", "query", text.excluded_keyword(
            "title", DEFAULT.excluded_keywords).alias("keyword"),
        text.has_condition_mark("title", DEFAULT.condition_marks
                                ).alias("condition_mark"))


URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def normal_url_sql(u: str) -> str:
    def piece(n):
        return f"regexp_extract(trim({u}), {duck.lit(URL_PARTS)}, {n})"
    drop = duck.words(vocab.TRACKING_PARAMS)
    pairs = (f"list_sort(list_filter(string_split({piece(4)}, '&'), lambda p: "
             "p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), "
             f"'utm_') AND NOT list_contains({drop}, "
             "lower(split_part(p, '=', 1)))))")
    q = f"array_to_string({pairs}, '&')"
    return (f"concat(CASE WHEN {piece(1)} <> '' THEN concat(lower({piece(1)}), "
            f"'://', lower({piece(2)})) ELSE '' END, "
            f"regexp_replace({piece(3)}, '/+$', ''), CASE WHEN {q} <> '' "
            f"THEN concat('?', {q}) ELSE '' END)")


def item_id_sql(u: str, site: str) -> str:
    path = f"regexp_extract({u}, {duck.lit(URL_PARTS)}, 3)"
    return (f"coalesce({duck.part(u, vocab.ITEM_PATH)}, "
            f"{duck.part(u, vocab.ITEM_PARAM)}, CASE WHEN lower({site}) = "
            f"'ebay' THEN {duck.part(path, vocab.PATH_ITEM)} END)")


@query("normal_urls", "T43", f"""
SELECT page_id, {normal_url_sql('url')} AS url FROM pages""")
def normal_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.normal_url("url").alias("url"))


SALE_KEY_SQL = f"""coalesce('item:' || {item_id_sql('url', 'site')},
 'url:' || nullif({normal_url_sql('url')}, ''),
 'fallback:' || sha256(concat_ws(chr(31), lower(trim(site)),
 trim(regexp_replace(lower(title), '\\s+', ' ', 'g')),
 CAST(CAST(floor(price * 100 + 0.5) AS BIGINT) AS VARCHAR), CAST(sold_s AS VARCHAR))))"""


@query("sale_keys", "T42 T44", f"""{ctes('sales')}
SELECT sale_id, {item_id_sql('url', 'site')} AS item_id,
 {SALE_KEY_SQL} AS sale_key FROM sales""")
def sale_keys(spark, sf_dir):
    return view(spark, sf_dir, "sales").select(
        "sale_id", urls.item_id("url", "site").alias("item_id"),
        urls.sale_key("title", "price", F.col("sold_s"), "url", "site"
                      ).alias("sale_key"))


def typo_sql(w: str) -> str:
    drops = (f"list_transform(range(1, len({w})), lambda i: "
             f"substr({w}, 1, i) || substr({w}, i + 2))")
    swaps = (f"list_transform(range(1, len({w}) - 1), lambda i: "
             f"substr({w}, 1, i) || substr({w}, i + 2, 1) || "
             f"substr({w}, i + 1, 1) || substr({w}, i + 3))")
    made = f"list_concat({drops}, {swaps})"
    known = duck.case([(f"{w} = {duck.lit(k)}", duck.words(v))
                       for k, v in vocab.KNOWN_TYPOS.items()],
                      f"list_filter({duck.uniq(made)}, lambda x: x <> {w})"
                      "[1:3]")
    skip = duck.words(vocab.TYPO_STOPWORDS)
    return (f"CASE WHEN len({w}) < 6 OR list_contains({skip}, {w}) "
            f"THEN [] ELSE {known} END")


@query("typo_dictionary", "T45", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name),
 '[a-z'']+')) AS word FROM part UNION SELECT 'gengar' UNION SELECT 'edition')
SELECT word, unnest({typo_sql('word')}) AS typo FROM w""")
def typo_dictionary(spark, sf_dir):
    """Misspellings of every word of the catalogue names."""
    words = (table(spark, sf_dir, "part").select(F.explode(text.find_all(
        F.lower("p_name"), "[a-z']+")).alias("word"))
        .union(spark.sql("SELECT explode(array('gengar', 'edition'))"))
        .distinct())
    return words.select("word", F.explode(text.typo_variants("word"))
                        .alias("typo"))


def replace_sql(value: str, pairs) -> str:
    for a, b in pairs:
        value = f"replace({value}, {duck.lit(a)}, {duck.lit(b)})"
    return value


@query("query_translation", "T46", """{}
SELECT query, trim(regexp_replace({}, '\\s+', ' ', 'g')) AS query_ja
FROM standing_queries""".format(ctes("standing_queries"), replace_sql(
    "lower(query)", [(k, vocab.JAPANESE_TERMS[k]) for k in sorted(
        vocab.JAPANESE_TERMS, key=len, reverse=True)])))
def query_translation(spark, sf_dir):
    return view(spark, sf_dir, "standing_queries").select(
        "query", text.translate_query("query").alias("query_ja"))


@query("wanted_tokens", "T47", f"""{TITLES}
SELECT title, query, array_to_string(list_sort(list_distinct({duck.every(
    replace_sql(duck.folded('title'), vocab.WANTED_PHRASES), '[a-z0-9]+')})),
 ' ') AS tokens FROM titles""")
def wanted_tokens(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "title", "query", F.array_join(F.array_sort(text.wanted_tokens(
            "title")), " ").alias("tokens"))


@query("catalogue_keys", "T53", f"""{TITLES}, k AS (SELECT title, query,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(title),
 {duck.lit(vocab.GRADE_TOKEN)}, ' ', 'g'), '#0+(\\d+)\\b', '#\\1', 'g'),
 '\\s+', ' ', 'g')) AS product_key,
 list_filter({duck.grade_tokens('lower(title)')},
 lambda x: x.grade IS NOT NULL)[1] AS g FROM titles)
SELECT title, query, product_key, product_key || '|psa:' ||
 coalesce({duck.num(duck.effective('g.grader', 'g.grade'))}, 'raw')
 AS value_key FROM k""")
def catalogue_keys(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "title", "query", grades.product_key("title").alias("product_key"),
        grades.value_key("title").alias("value_key"))
