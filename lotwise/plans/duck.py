"""Builders of DuckDB check SQL for the text functions.

An independent restatement in another engine's SQL of what
lotwise.functions computes with Spark columns; both read the fixed values of
lotwise.vocab.
"""
from __future__ import annotations

from .. import vocab


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def hit(low: str, pattern: str) -> str:
    return f"regexp_matches({low}, {lit(pattern)})"


def every(low: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({low}, {lit(pattern)}, {group})"


def part(low: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({low}, {lit(pattern)}, {group}), '')"


def uniq(array: str) -> str:
    """Distinct elements, first occurrence first."""
    return (f"list_filter({array}, lambda x, i: "
            f"list_position({array}, x) = i)")


def minus(array: str, items: str) -> str:
    return f"list_filter({array}, lambda x: NOT list_contains({items}, x))"


def within(array: str, items: str) -> str:
    return f"list_filter({array}, lambda x: list_contains({items}, x))"


def fold(text: str) -> str:
    bare = (f"regexp_replace({text}, '([A-Za-z])[\\x{{0300}}-\\x{{036f}}]+', "
            "'\\1', 'g')")
    return (f"translate({bare}, {lit(vocab.ACCENTS_FROM)}, "
            f"{lit(vocab.ACCENTS_TO)})")


def folded(text: str) -> str:
    return f"lower({fold(f'coalesce({text}, {chr(39)*2})')})"


def num(value: str) -> str:
    """Shortest text of a grade-like number."""
    return f"regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '')"


def contains_any(low: str, needles) -> str:
    return "(" + " OR ".join(f"contains({low}, {lit(n)})"
                             for n in needles) + ")"


def case(branches, default: str = "NULL") -> str:
    return ("CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
            + f" ELSE {default} END")


def normal_grade(grader: str, label: str) -> str:
    value = f"CAST({label} AS DOUBLE)"
    legacy = case([(f"split_part({label}, '.', 1) = {lit(k)}", f"{v}::DOUBLE")
                   for k, v in vocab.SGC_LEGACY.items()])
    return case([(f"{value} <= 0", "NULL"), (f"{value} <= 10", value),
                 (f"{grader} = 'vga' AND {value} / 10 <= 10",
                  f"{value} / 10"),
                 (f"{grader} = 'sgc'", legacy)])


def effective(grader: str, grade: str) -> str:
    return (f"CASE WHEN {grade} IS NULL THEN NULL ELSE greatest(1e0, {grade} "
            f"+ CASE WHEN {grader} IN ('cgc','bgs','sgc','bvg') THEN -1e0 "
            "ELSE 0e0 END) END")


def grade_tokens(low: str) -> str:
    graders = every(low, vocab.GRADE_TOKEN, 1)
    labels = every(low, vocab.GRADE_TOKEN, 2)
    made = normal_grade("x.g", "x.n")
    return (f"list_transform(list_transform(range(1, len({graders}) + 1), "
            f"lambda i: {{'g': {graders}[i], 'n': {labels}[i]}}), "
            f"lambda x: {{'grader': x.g, 'label': x.n, 'grade': {made}}})")


def category(query: str, object_class: str | None = None) -> str:
    low = folded(query)
    base = case([
        (contains_any(low, vocab.WATCH_KEYWORDS), "'Watches'"),
        (contains_any(low, vocab.PLATFORM_KEYWORDS), "'Video Games'"),
        (contains_any(low, vocab.POKEMON_KEYWORDS), "'Pokemon Cards'"),
        (contains_any(low, vocab.GAME_TITLE_KEYWORDS), "'Video Games'"),
        (contains_any(low, vocab.POP_KEYWORDS), "'Other'")],
        "'Sports Cards'")
    if object_class is None:
        return base
    return (f"CASE WHEN {base} = 'Sports Cards' AND {object_class} = "
            f"'memorabilia' THEN 'Sports Memorabilia' ELSE {base} END")


def holo(low: str) -> str:
    return case([(hit(low, vocab.NON_HOLO), "'nonholo'"),
                 (hit(low, vocab.REVERSE_HOLO), "'reverse'"),
                 (hit(low, vocab.HOLO), "'holo'")])


def edition(low: str) -> str:
    return case([(hit(low, vocab.FIRST_EDITION), "'1st'"),
                 (hit(low, vocab.UNLIMITED), "'unlimited'"),
                 (hit(low, vocab.SHADOWLESS), "'shadowless'")])


def series(low: str) -> str:
    return case([(f"NOT {hit(low, vocab.TOPSUN)}", "NULL"),
                 (hit(low, vocab.VERSUS), "'vs'")], "'original'")


def completeness(low: str) -> str:
    return case([(hit(low, vocab.SEALED), "'sealed'"),
                 (hit(low, vocab.COMPLETE_IN_BOX), "'cib'"),
                 (hit(low, vocab.LOOSE), "'loose'")])


def years(low: str) -> str:
    starts, ends = every(low, vocab.SEASON, 1), every(low, vocab.SEASON, 2)
    a, b = f"CAST({starts}[i] AS INT)", f"CAST({ends}[i] AS INT)"
    end = f"({a} - {a} % 100 + {b})"
    spans = (f"list_transform(range(1, len({starts}) + 1), lambda i: CAST("
             f"CASE WHEN {end} < {a} THEN {end} + 100 ELSE {end} END "
             "AS VARCHAR))")
    return f"list_concat({every(low, vocab.YEAR, 1)}, {spans})"


def card_number(low: str) -> str:
    head = f"nullif(regexp_extract({low}, {lit(vocab.ANY_NUMBER)}, 0), '')"
    hashed = part(head, "^" + vocab.HASH_NUMBER)
    numbered = part(head, r"^no\.?\s*(\d{1,4})\b")
    slashed = (f"CASE WHEN {hit(low, vocab.TCG_CONTEXT)} THEN "
               f"{part(head, r'^(\d{1,3})\s*/')} END")
    chosen = f"coalesce({hashed}, {numbered}, {slashed})"
    return (f"CASE WHEN NOT regexp_matches({chosen}, "
            f"'^(1[89]\\d{{2}}|20\\d{{2}})$') THEN {chosen} END")


def object_class(low: str, grader: str) -> str:
    h = lambda p: hit(low, p)                      # noqa: E731
    card_graded = f"coalesce({grader} IN ('psa','bgs','cgc','sgc','bvg'), false)"
    return case([
        (h(vocab.WATCH_PART), "'watch_part'"), (h(vocab.WATCH), "'watch'"),
        (h(vocab.FIGURE), "'figure'"), (h(vocab.WRAPPER), "'wrapper'"),
        (h(vocab.COUPON), "'coupon'"), (h(vocab.PACK), "'pack'"),
        (f"{h(vocab.STRONG_MEMORABILIA)} AND NOT {h(vocab.CARD_PRODUCT)}",
         "'memorabilia'"),
        (f"{h(vocab.MEMORABILIA)} AND NOT {h(vocab.CARD_ONLY)}",
         "'memorabilia'"),
        (f"{card_graded} AND {h(vocab.COMIC)} AND NOT {h(vocab.CARD_ONLY)}",
         "'comic'"),
        (card_graded, "'card'"),
        (f"coalesce({grader} IN ('wata','vga'), false)", "'game'"),
        (h(vocab.COMIC), "'comic'"), (h(vocab.GAME), "'game'"),
        (h(vocab.CARD), "'card'")], "'unknown'")


def finish(word: str) -> str:
    return case([(f"{word} = {lit(k)}", lit(v))
                 for k, v in vocab.FINISH_SPELLING.items()], word)


def parallel(low: str) -> str:
    found = every(low, vocab.PARALLEL, 1)
    ok = (f"(list_has_any({found}, {words(vocab.FINISH_WORDS)}) OR "
          f"{hit(low, vocab.SERIAL)})")
    joined = (f"array_to_string(list_sort(list_distinct(list_transform("
              f"{found}, lambda x: {finish('x')}))), ' ')")
    return f"CASE WHEN len({found}) > 0 AND {ok} THEN {joined} END"


def catalogue_parallel(name: str) -> str:
    inside = f"lower(regexp_extract({name}, {lit(vocab.BRACKET)}, 1))"
    found = (f"list_transform({every(inside, '[a-z]+')}, "
             f"lambda x: {finish('x')})")
    known = words(sorted(set(vocab.FINISH_WORDS) | set(vocab.COLOUR_WORDS)))
    return (f"nullif(array_to_string(list_sort(list_distinct("
            f"{within(found, known)})), ' '), '')")


def serial(low: str, number: str) -> str:
    runs = every(low, vocab.SERIAL, 1)
    spots = (f"CASE WHEN {number} IS NULL THEN [] ELSE regexp_extract_all("
             f"{low}, concat('\\b', {number}, '\\s*/\\s*(\\d{{1,5}})\\b'), 1)"
             " END")
    sizes = (f"list_filter(list_transform({minus(runs, spots)}, "
             "lambda x: CAST(x AS INT)), lambda n: n >= 1 AND n <= 5000)")
    return (f"CASE WHEN {hit(low, vocab.ONE_OF_ONE)} THEN 1 "
            f"ELSE list_min({sizes}) END")


def qualifier(low: str) -> str:
    word = (f"regexp_replace({part(low, vocab.QUALIFIER, 1)}, '\\s+', ' ', "
            "'g')")
    return case([(f"contains({word}, 'altered')", "'altered'"),
                 (f"{word} IN ('auth', 'authentic')", "'authentic'"),
                 (f"{word} IN ('mk', 'qualified')", "'qualified'")], word)


def platforms(low: str) -> str:
    for pattern, word in vocab.PLATFORM_SPELLING:
        low = f"regexp_replace({low}, {lit(pattern)}, {lit(word)}, 'g')"
    return low


def identity(source: str, text: str, out: str, keep: str = "*") -> str:
    """CTEs ending in `out`: the rows of `source` with identity columns."""
    a, b, c = f"{out}_a", f"{out}_b", f"{out}_c"
    graded = ("list_filter(gt, lambda x: x.grade IS NOT NULL)")
    return f"""
{a} AS (SELECT {keep}, {folded(text)} AS low,
  lower(coalesce({text}, '')) AS raw_low FROM {source}),
{b} AS (SELECT *, {grade_tokens('raw_low')} AS gt,
  {years('low')} AS years0, {card_number('low')} AS card_number,
  {qualifier('low')} AS qualifier, {every('low', '[a-z]+')} AS words0,
  {holo('low')} AS holo, {edition('low')} AS edition,
  {series('low')} AS series, {completeness('low')} AS completeness,
  {every(platforms('raw_low'), '[a-z]+')} AS pw FROM {a}),
{c} AS (SELECT *, {uniq('words0')} AS words,
  {graded}[1] AS gi, {uniq('years0')} AS years,
  {uniq('pw')} AS pwu,
  coalesce(qualifier IN ('authentic', 'altered'), false) AS no_grade
  FROM {b}),
{out} AS (SELECT * EXCLUDE (gt, years0, words0, pw, pwu),
  {object_class('low', 'gi.grader')} AS object_class,
  list_min(years) AS year,
  {minus('words', words(vocab.GENERIC_WORDS))} AS named,
  list_filter({minus('words', words(vocab.GENERIC_WORDS))},
    lambda x: len(x) >= 3)[1:2] AS subject,
  list_filter({minus('words', words(vocab.GENERIC_WORDS))},
    lambda x: len(x) > 1) AS subject_all,
  coalesce(card_number, upper({part('low', vocab.ALNUM_NUMBER)})) AS number,
  {parallel('low')} AS parallel, {serial('low', 'card_number')} AS serial,
  {hit('low', vocab.AUTOGRAPH)} AS is_auto, {hit('low', vocab.RELIC)} AS is_relic,
  gi.grader AS grader,
  {effective('gi.grader', 'gi.grade')} AS effective,
  CASE WHEN NOT no_grade THEN {effective('gi.grader', 'gi.grade')} END AS grade,
  CASE WHEN NOT no_grade THEN gi.grade END AS printed_grade,
  list_filter([holo, edition, series, completeness],
    lambda x: x IS NOT NULL) AS variant,
  {within('pwu', words(vocab.SET_WORDS))}[1:4] AS set_tokens,
  {tokens('low', 'gt')} AS tokens,
  {hit('low', vocab.FOREIGN)} AS is_foreign, {hit('low', vocab.REGION)} AS region
  FROM {c})"""


def tokens(low: str, gt: str) -> str:
    bare = f"regexp_replace({low}, {lit(vocab.GRADE_TOKEN)}, ' ', 'g')"
    eff = effective("x.grader", "x.grade")
    made = (f"list_concat({every(bare, vocab.WORD_TOKEN)}, list_transform("
            f"list_filter({gt}, lambda x: x.grade IS NOT NULL), lambda x: "
            f"concat('grade', {num(eff)})))")
    return f"list_distinct({minus(made, words(vocab.NOISE_WORDS))})"


def fingerprint(p: str = "") -> str:
    def joined(a, missing):
        return f"coalesce(nullif(array_to_string({a}, ' '), ''), '{missing}')"
    grade = (f"CASE WHEN {p}qualifier IS NOT NULL THEN concat('auth:', "
             f"{p}qualifier) ELSE coalesce({num(p + 'grade')}, 'raw') END")
    return (f"concat_ws('|', {p}object_class, coalesce({p}year, '?'), "
            f"{joined(p + 'subject', '?')}, coalesce({p}number, '?'), "
            f"coalesce({p}parallel, '-'), "
            f"coalesce(CAST({p}serial AS VARCHAR), '-'), "
            f"CASE WHEN {p}is_auto THEN 'auto' ELSE '-' END, "
            f"CASE WHEN {p}is_relic THEN 'relic' ELSE '-' END, "
            f"{joined(p + 'variant', '-')}, {grade})")


def specificity(p: str = "") -> str:
    graded = f"({p}grade IS NOT NULL OR {p}qualifier IS NOT NULL)"

    def pts(c, n):
        return f"CASE WHEN {c} THEN {n} ELSE 0 END"
    base = (pts(f"{p}object_class <> 'unknown'", 150) + " + "
            + pts(f"len({p}subject) > 0", 200) + " + "
            + pts(f"{p}year IS NOT NULL", 100))
    game = (pts(f"len({p}set_tokens) > 0 OR len({p}variant) > 0", 250) + " + "
            + pts(graded, 250) + " + " + pts(f"{p}number IS NOT NULL", 50))
    comic = pts(f"{p}number IS NOT NULL", 300) + " + " + pts(graded, 200)
    other = (pts(f"{p}number IS NOT NULL", 250) + " + " + pts(graded, 150)
             + f" + CASE WHEN {p}serial IS NOT NULL OR {p}parallel IS NOT NULL"
             f" THEN 150 WHEN len({p}variant) > 0 THEN 100 ELSE 0 END")
    return (f"least(1000, {base} + CASE {p}object_class WHEN 'game' THEN "
            f"{game} WHEN 'comic' THEN {comic} ELSE {other} END) / 1000e0")


def conflict(a: str, b: str) -> str:
    def differ(f):
        return f"({a}.{f} IS NOT NULL AND {b}.{f} IS NOT NULL AND {a}.{f} <> {b}.{f})"
    return case([
        (f"{a}.object_class <> 'unknown' AND {b}.object_class <> 'unknown' "
         f"AND {a}.object_class <> {b}.object_class", "'object class'"),
        (differ("year"), "'year'"), (differ("number"), "'card number'"),
        (differ("parallel"), "'parallel'"), (differ("serial"), "'serial'"),
        (f"{a}.is_auto <> {b}.is_auto", "'autograph'"),
        (f"{a}.is_relic <> {b}.is_relic", "'relic'"),
        (f"{a}.qualifier IS DISTINCT FROM {b}.qualifier", "'qualifier'"),
        (f"len({a}.subject) > 0 AND len({b}.subject) > 0 AND NOT "
         f"list_has_any({a}.subject, {b}.subject)", "'subject'")])


def coverage(q: str, t: str) -> str:
    return (f"CASE WHEN len({q}) > 0 THEN len({within(q, t)}) / "
            f"CAST(len({q}) AS DOUBLE) ELSE 0e0 END")


def lev_ratio(a: str, b: str) -> str:
    return (f"CASE WHEN greatest(len({a}), len({b})) > 0 THEN 1e0 - "
            f"levenshtein({a}, {b}) / CAST(greatest(len({a}), len({b})) AS "
            "DOUBLE) ELSE 1e0 END")


def match_score(qt: str, tt: str, ql: str, tl: str) -> str:
    return (f"CASE WHEN len({qt}) > 0 THEN 7e-1 * ({coverage(qt, tt)}) + "
            f"3e-1 * ({lev_ratio(ql, tl)}) ELSE 0e0 END")


def guide_phrase(title_low: str, p: str = "") -> str:
    ws = every(platforms(title_low), "[a-z0-9]+")
    game = (f"array_to_string(list_filter("
            f"{minus(uniq(ws), words(vocab.GAME_STOPWORDS))}, lambda x: "
            "len(x) > 1 AND NOT regexp_matches(x, '^\\d+$'))[1:8], ' ')")
    raw = (f"list_filter(list_concat([{p}year], {p}set_tokens, {p}subject, "
           f"['#' || {p}number, {p}parallel, CASE WHEN {p}serial > 1 THEN "
           f"'/' || CAST({p}serial AS VARCHAR) END, CASE WHEN {p}is_auto THEN "
           "'auto' END]), lambda x: x IS NOT NULL)")
    return (f"CASE WHEN {p}object_class = 'game' THEN {game} ELSE "
            f"array_to_string({uniq(raw)}, ' ') END")


def nearest_rounds(sql: str) -> str:
    """Replace round(x, n) by the half-up double form the library uses."""
    while (start := sql.find("round(")) >= 0:
        depth, i = 1, start + 6
        comma = i
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        body, digits = sql[start + 6:comma], int(sql[comma + 1:i - 1])
        sql = (f"{sql[:start]}(floor(({body}) * 1e{digits} + 5e-1) / "
               f"1e{digits}){sql[i:]}")
    return sql
