"""URL verdicts: host and path rules, and boosted trees for the rest.

Rules are ``host/path`` prefixes; a rule fits its host and all subdomains if
the url's path starts with the rule's, and the longest fitting rule decides.
All other urls are judged by gradient-boosted trees on lexical features:
lengths, depth, digit ratio, character entropy, parameter counts, and
statistics of the host's suffixes and the path's first segment. The trees are trained from labelled urls;
the registered query labels by the rules, so the rows that rules decide teach
the trees about those that none decides. Those statistics (smoothed block
rates of the last one and two host labels and of the segment) come from one half of the sample
and the trees from the other, so no url counts towards its own statistic.

The sample is bounded: TRAIN_ROWS expected rows, chosen by a hash of the url.
Everything is column expressions and MLlib.

Defined cases: a null url, or one without ``://``, has empty host and path
and no rule; it is judged by the trees. Without labelled urls the rest is
allowed; if all labels agree, they decide. Rows are judged one by one, so
repeated rows and null ids are returned as they come; other columns are
ignored.
"""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .registry import query, table

TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 4
#: Weight of the prior rate (one half) in a suffix statistic.
PRIOR = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "labels", "label_length",
            "depth", "digits", "entropy", "parameters", "query_length",
            "hyphens", "fragment", "suffix1", "suffix2", "suffix_rows",
            "segment")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lowered), path, and what follows the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    pattern = r"(?s)^([^/?#]*)([^?#]*)(.*)$"
    host, path, tail = (F.regexp_extract(rest, pattern, i) for i in (1, 2, 3))
    return F.translate(host, UPPER, LOWER), path, tail


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]
            ) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict (null: none).

    rules: (verdict, "host/path") of a configuration, not of a table.
    """
    found = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, tail = rule.partition("/")
        fits = (((host == name) | host.endswith("." + name))
                & path.startswith(slash + tail))
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return found, verdict


def entropy(text: Column) -> Column:
    """Bits per character of a text."""
    n = F.length(text)
    each = F.array_distinct(F.split(text, ""))
    count = lambda c: n - F.length(F.replace(text, c))      # noqa: E731
    part = lambda c: count(c) / n * F.log2(count(c) / n)
    return F.when(n > 0, -F.aggregate(
        F.filter(each, lambda c: c != ""), F.lit(0.0),
        lambda acc, c: acc + part(c))).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path, tail) with the features that need no statistic."""
    url = F.coalesce("url", F.lit(""))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    parts = F.split("host", r"\.")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    two = F.concat_ws(".", F.coalesce(F.try_element_at(parts, F.lit(-2)),
                                      F.lit("")), last)
    number = lambda c: c.cast("double")                     # noqa: E731
    return rows.select(
        "*", number(F.length(url)).alias("length"),
        number(F.length("host")).alias("host_length"),
        number(F.length("path")).alias("path_length"),
        number(F.size(parts)).alias("labels"),
        number(F.array_max(F.transform(parts, F.length))).alias("label_length"),
        number(F.regexp_count("path", F.lit("/"))).alias("depth"),
        (digits / F.greatest(F.length(url), F.lit(1))).alias("digits"),
        entropy(url).alias("entropy"),
        number(F.regexp_count("tail", F.lit("="))).alias("parameters"),
        number(F.length("tail")).alias("query_length"),
        number(F.regexp_count("host", F.lit("-"))).alias("hyphens"),
        number(F.instr("tail", "#") > 0).alias("fragment"),
        last.alias("s1"), two.alias("s2"),
        F.regexp_extract("path", "^/([^/]*)", 1).alias("s3"))


def with_suffixes(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """Adds suffix1, suffix2, suffix_rows and segment. The rate tables have no
    more rows than the bounded sample."""
    for name, t in rates.items():
        rows = rows.join(F.broadcast(t), name, "left")
    return (rows.withColumn("suffix1", F.coalesce("r_s1", F.lit(0.5)))
            .withColumn("suffix2", F.coalesce("r_s2", F.lit(0.5)))
            .withColumn("suffix_rows", F.log1p(F.coalesce("n_s2", F.lit(0))))
            .withColumn("segment", F.coalesce("r_s3", F.lit(0.5))))


class UrlTrees:
    """Boosted trees and suffix statistics of a labelled sample."""

    def __init__(self, labelled: DataFrame, rows: int = TRAIN_ROWS):
        """labelled: lexical() rows with a 0/1 column `blocked`."""
        share = min(1.0, rows / max(1, labelled.count()))
        draw = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(1 << 30))
        # a bounded sample: four partitions hold it
        sample = stored(labelled.filter(draw < share * (1 << 30))
                        .repartition(4), "urls")
        half = F.pmod(F.xxhash64("url", F.lit(6)), F.lit(2)) == 0
        self.base = sample.agg(F.avg("blocked")).first()[0]
        self.model = None
        if self.base in (None, 0.0, 1.0):
            return
        # both classes weigh the same: an unknown suffix says nothing
        weight = F.when(F.col("blocked") == 1, 0.5 / self.base).otherwise(
            0.5 / (1 - self.base))
        sample = sample.withColumn("weight", weight)
        taught = sample.filter(half)
        self.rates = {s: stored(taught.groupBy(s).agg(
            ((F.sum(F.col("blocked") * F.col("weight")) + PRIOR / 2)
             / (F.sum("weight") + PRIOR))
            .alias(f"r_{s}"), F.count("*").alias(f"n_{s}")), "rates")
            for s in ("s1", "s2", "s3")}
        rest = self.vectors(sample.filter(~half)).select(
            "features", "weight", F.col("blocked").cast("double")
            .alias("label"))
        rest = stored(rest.coalesce(4), "vectors")
        if rest.isEmpty():
            return
        self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=3,
                                   weightCol="weight").fit(rest)

    def vectors(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES),
                               outputCol="features").transform(
            with_suffixes(rows, self.rates))

    def judged(self, rows: DataFrame) -> DataFrame:
        """rows with the trees' `said`, block or allow."""
        if self.model is None:
            said = "block" if (self.base or 0.0) > 0.5 else "allow"
            return rows.withColumn("said", F.lit(said))
        return self.model.transform(self.vectors(rows)).withColumn(
            "said", F.when(F.col("prediction") == 1, "block")
            .otherwise("allow"))


def url_rows(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    host, path, tail = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"),
                        path.alias("path"), tail.alias("tail"))
    found, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", found).withColumn("ruled", verdict)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]],
                 labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per input row.

    labelled: (url, blocked) rows to train from; by default the urls that
    rules decide.
    """
    rows = lexical(url_rows(pages, rules))
    if labelled is None:
        known = rows.filter("ruled IS NOT NULL").withColumn(
            "blocked", (F.col("ruled") == "block").cast("int"))
    else:
        known = lexical(url_rows(labelled.withColumn("page_id", F.lit(0)), [])
                        .join(labelled, "url"))
    trees = UrlTrees(known)
    return trees.judged(rows).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", "said").alias("verdict"))


#: The rules of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"),
         ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]


@query("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)
