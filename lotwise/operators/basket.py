"""Pricing a list of named holdings against the catalogue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import grades, guide_price, text
from ..functions.stage import stage

# ---------------------------------------------------------------- fixed values
HEADERS = {
    "name": ("card", "name", "product", "product-name", "item", "title"),
    "grade": ("grade", "condition", "slab"),
    "set": ("set", "console", "console-name", "series"),
    "cost": ("cost", "paid", "basis", "purchase", "purchase price"),
}
# ------------------------------------------------------------ end fixed values


def norm(value) -> Column:
    """Case, spacing and missing values are not identity."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(
        text.as_col(value), F.lit(""))), r"\s+", " "))


def resolve_headers(columns: list[str]) -> dict[str, str | None]:
    """Loose header matching on the schema: exact first, then containment."""
    lowered = [" ".join(c.lower().replace("_", "-").split())
               for c in columns]
    out: dict[str, str | None] = {}
    for role, names in HEADERS.items():
        exact = [columns[lowered.index(n)] for n in names if n in lowered]
        near = [c for c, low in zip(columns, lowered)
                if any(n in low for n in names)]
        out[role] = (exact or near or [None])[0]
    if out["name"] is None:
        out["name"] = columns[0]
    return out


def signed_money(value) -> Column:
    """Amounts with accounting negatives: (12) is -12."""
    bare = F.trim(F.regexp_replace(text.as_col(value), "[$,]", ""))
    return F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast("double")


def read(raw: DataFrame) -> DataFrame:
    """name, grade, set, cost of any holdings table; blank rows dropped."""
    found = resolve_headers(raw.columns)

    def cell(role):
        return (F.trim(F.col(f"`{found[role]}`").cast("string"))
                if found[role] else F.lit(None).cast("string"))

    extra = [c for c in raw.columns if c == "line"]
    return raw.select(*extra, cell("name").alias("name"),
                      cell("grade").alias("grade"), cell("set").alias("set"),
                      signed_money(cell("cost")).alias("cost")
                      ).filter(F.coalesce("name", F.lit("")) != "")


def product_core(name: Column) -> Column:
    """Catalogue name before its bracket and number."""
    return norm(F.split_part(F.split_part(name, F.lit("["), F.lit(1)),
                             F.lit("#"), F.lit(1)))


def product_variants(name: Column) -> Column:
    """Known variant phrases inside brackets, longest first, each text used
    once."""
    inside = F.lower(F.array_join(text.find_all(name, r"\[([^\]]*)\]", 1),
                                  " | "))
    found = []
    for phrase in sorted(vocab.BASKET_VARIANTS, key=len, reverse=True):
        found.append(F.when(inside.contains(phrase), phrase))
        inside = F.replace(inside, F.lit(phrase), F.lit(" "))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def split_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Add core and variants of a hand-written name."""
    bare = F.lower(F.trim(F.regexp_replace(F.col(name), vocab.YEAR_PREFIX,
                                           "")))
    df = df.withColumns({"_text": bare, "_found": F.array().cast(
        "array<string>")})
    for phrase in sorted(vocab.BASKET_VARIANTS, key=len, reverse=True):
        pattern = rf"\[?\b{phrase}\b\]?"
        df = df.withColumns({
            "_found": F.when(F.col("_text").rlike(pattern), F.array_append(
                "_found", F.lit(phrase))).otherwise(F.col("_found")),
            "_text": F.regexp_replace("_text", pattern, " ")})
    # a trailing colour names a variant rather than the card
    last = F.regexp_extract("_text", r"(\S+)\s*$", 1)
    aliases = {k: v for k, v in vocab.BASKET_ALIASES.items() if " " not in k}
    mapped = F.lit(None).cast("string")
    for word, value in aliases.items():
        mapped = F.when(last == word, F.lit(value)).otherwise(mapped)
    df = df.withColumn("_alias", mapped)
    core = F.when(F.col("_alias").isNotNull(), F.regexp_replace(
        "_text", r"\S+\s*$", "")).otherwise(F.col("_text"))
    core = F.regexp_replace(F.regexp_replace(core, r"#\s*\d+", " "),
                            r"[\[\]]", " ")
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        norm(core).alias("core"),
        F.array_sort(F.array_distinct(F.array_compact(F.concat(
            "_found", F.array(F.nullif("_alias", F.lit(""))))))
                     ).alias("variants"))


def index(catalogue: DataFrame) -> DataFrame:
    name = F.col("product_name")
    return stage(catalogue, p_name=norm(name), p_set=norm("console_name"),
                 p_core=product_core(name), p_variants=product_variants(name))


def matches(basket: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(line, product) by the best of four rules: exact set and name, name
    with a containing set, name alone, core name with equal variants."""
    lines = split_name(basket).withColumns({
        "n": norm("name"), "s": norm("set")})
    listed = index(catalogue)
    contains = ((F.col("s") != "") & (
        F.col("p_set").contains(F.col("s"))
        | F.col("s").contains(F.col("p_set"))))
    by_name = lines.join(listed, F.col("n") == F.col("p_name")).withColumn(
        "rule", F.when((F.col("s") != "") & (F.col("s") == F.col("p_set")),
                       1).when(contains, 2).otherwise(3))
    by_core = lines.join(listed, (F.col("core") == F.col("p_core"))
                         & (F.col("variants") == F.col("p_variants"))
                         ).withColumn("rule", F.when(contains, 4
                                                     ).otherwise(5))
    # a line names few products, so its window is small; the matches are
    # computed once
    best = F.min("rule").over(Window.partitionBy("line"))
    return by_name.unionByName(by_core).withColumn("_best", best).filter(
        F.col("rule") == F.col("_best")).drop("_best")


def first_products(catalogue: DataFrame) -> DataFrame:
    """Of products that no rule tells apart, the first by product_id."""
    alike = ["p_name", "p_set", "p_core", "p_variants"]
    return index(catalogue).groupBy(*alike).agg(F.min_by(F.struct(
        *catalogue.columns), "product_id").alias("_p")).select("_p.*")


def mismatch(supplied: Column, matched: Column) -> Column:
    """First identity-changing word on one side only, else a subject word of
    the product that was never written; NULL when the names agree."""
    a, b = norm(supplied), norm(matched)
    odd = F.lit(None).cast("string")
    for word in reversed(vocab.DISTINGUISHING):
        odd = F.when(a.contains(word) != b.contains(word), F.lit(word)
                     ).otherwise(odd)
    core = F.regexp_replace(F.regexp_replace(b, r"\[[^\]]*\]", " "),
                            r"#\S*", " ")
    missing = F.get(F.filter(
        F.array_except(text.alpha_words(core), text.alpha_words(a)),
        lambda w: (F.length(w) >= 3) & ~w.isin("the", "and")), F.lit(0))
    return F.coalesce(odd, missing)


def price(basket: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each line priced at its grade, refused with a reason, or unmatched.
    A line found in several sets is a guess.  Equal lines meet once, with the
    first of equal products, so copies don't multiply each other."""
    graded = basket.withColumn("g", grades.grade_info(F.concat_ws(
        " ", "name", "grade")))
    asked = basket.select("name", "set").distinct().withColumn(
        "line", F.struct("name", "set"))
    found = matches(asked, first_products(catalogue))
    chosen = found.groupBy("line").agg(
        F.size(F.collect_set("p_set")).alias("sets"),
        F.min_by(F.struct("product_id", "product_name", "console_name",
                          "rule", *guide_price.PRICE_COLUMNS), "product_id"
                 ).alias("_r")).select(
        F.col("line.name").alias("_name"), F.col("line.set").alias("_set"),
        "sets", "_r.*")
    rows = graded.join(chosen, F.col("name").eqNullSafe(F.col("_name"))
                       & F.col("set").eqNullSafe(F.col("_set")), "left")
    rows = stage(rows, refused=mismatch(F.col("name"), F.col("product_name")),
                 cents=guide_price.price_cents(
                     F.col("g.effective"), F.col("g.grader"),
                     F.col("g.grade")))
    matched = F.col("product_id").isNotNull()
    return rows.select(
        "line", "name", "cost", "product_id", "rule",
        F.coalesce(F.col("sets") > 1, F.lit(False)).alias("guess"),
        F.when(~matched, "not found").when(
            F.col("refused").isNotNull(), "refused").when(
            F.col("cents").isNull(), "no price at grade").otherwise("priced"
                                                                   ).alias("outcome"),
        F.when(matched & F.col("refused").isNull(),
               F.round(F.col("cents")) / 100.0).alias("price"))


def summary(priced: DataFrame) -> DataFrame:
    def exact(value):
        return F.coalesce(F.sum(value.cast("decimal(28,4)")).cast("double"),
                          F.lit(0.0))

    out = priced.agg(F.count(F.lit(1)).alias("lines"),
                     F.count("price").alias("priced"),
                     exact(F.col("price")).alias("total_value"),
                     exact(F.col("cost")).alias("total_cost"))
    return out.withColumn("pnl", F.col("total_value") - F.col("total_cost"))


def seed(catalogue: DataFrame, set_name: str, variant: str = "") -> DataFrame:
    """Products of a set for a new basket, sealed ones marked, ordered by
    card number."""
    wanted = " ".join(set_name.lower().split())
    rows = catalogue.filter(norm("console_name").contains(wanted))
    if variant:
        rows = rows.filter(norm("product_name").contains(
            " ".join(variant.lower().split())))
    number = text.extract(F.col("product_name"), r"#\s*([0-9]+)").cast("int")
    return rows.select(
        "product_id", "product_name", "console_name",
        text.sealed_product("product_name").alias("sealed"),
        number.alias("number")).orderBy(
        F.col("number").isNull(), "number", "product_name", "product_id")
