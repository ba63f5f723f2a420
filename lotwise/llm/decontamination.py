"""Benchmark decontamination over a distributed positional inverted index.

A word is a run of letters, digits and non-ASCII characters, A-Z lowered. The
phrases of a benchmark item are its runs of `size` consecutive words; an item
of fewer words, but not none, is one phrase.

1. Postings (term, document, position) of every benchmark term in every
   document are written once, in segments sorted by term. Terms that occur in
   no item answer no question and are left out of the index. The end of a
   document is a posting too, so the index also knows its length.
2. Terms are counted in the index. A phrase with a term that no document has
   is gone. The lists of its two rarest terms, each shifted by the term's
   offset in the phrase, are intersected on (document, phrase, start).
3. The survivors' other terms are looked up at their places; what has them
   all is an exact match. The postings meet the survivors by a shuffle after
   a filter on BUCKETS hashed documents, a table that cannot grow beyond
   BUCKETS rows.
4. `proximity` needs no order: an item is near where its `terms` rarest terms
   all lie within `span` words of a document.

Equal phrases of several items are one phrase, so a passage that many items
share is sought once. Tables of terms and phrases are broadcast up to
common.BROADCAST_ROWS rows and joined by shuffles beyond.

Defined cases: null and empty texts have no words; rows without doc_id are
judged like others; a doc_id listed twice gives two rows, each judged by its
own text; items without item_id hit words but are neither counted nor listed;
an item_id listed twice counts once; empty tables give no rows (documents) or
no hits (items); other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BETWEEN, CAPITALS, SMALL, beside, letter_words, stored
from .registry import query, table

#: Hashed documents that the third step filters postings by.
BUCKETS = 1 << 18
#: A term's place in the index that no word can have.
END = -1
#: Two 64-bit hashes of doc_id and text tell documents apart.
DOC = ["a", "b"]


def phrases_of(items: DataFrame, size: int) -> DataFrame:
    """item_id, words: the runs of `size` words of every item."""
    words = F.col("words")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1,
                                             F.lit(1)))
    return (items.select("item_id", letter_words(F.col("text"))
                         .alias("words"))
            .filter(F.size(words) > 0)
            .select("item_id", "words", F.explode(starts).alias("start"))
            .select("item_id", F.slice(words, F.col("start"), F.lit(size))
                    .alias("words")))


@dataclass(frozen=True)
class Index:
    """Postings of `docs` for the terms of `items`, both in shared storage."""
    postings: DataFrame
    terms: DataFrame
    items: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, items: DataFrame) -> Index:
        items = items.select("item_id", "text")
        terms = stored(
            items.select(F.explode(letter_words(F.col("text"))).alias("word"))
            .distinct().select("word", F.monotonically_increasing_id()
                               .alias("term")), "terms")
        known = terms.unionByName(docs.sparkSession.createDataFrame(
            [("", END)], "word string, term long"))
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64("doc_id", text).alias("a"),
            F.xxhash64(F.lit(1), "doc_id", text).alias("b"),
            F.array_append(letter_words(F.col("text")), "").alias("words"))
        found = (rows.select("doc_id", *DOC,
                             F.posexplode("words").alias("pos", "word"))
                 .join(beside(known), "word")
                 .select("term", *DOC, "pos", F.when(
                     F.col("term") == END, F.col("doc_id")).alias("doc_id")))
        return cls(stored(found.sortWithinPartitions("term"), "postings"),
                   terms, items)

    def documents(self) -> DataFrame:
        """a, b, doc_id, n_words; one row per row of the documents."""
        return self.postings.filter(F.col("term") == END).select(
            *DOC, "doc_id", F.col("pos").cast("long").alias("n_words"))

    def lists(self) -> DataFrame:
        return self.postings.filter(F.col("term") != END).drop("doc_id")

    def frequencies(self) -> DataFrame:
        """term, n: the lengths of the postings lists."""
        return self.lists().groupBy("term").agg(F.count("*").alias("n"))

    def phrases(self, size: int = 10) -> Occurrences:
        """Exact occurrences of the items' phrases."""
        runs = phrases_of(self.items, size)
        # the id is stored with its phrase, so it stays the same
        known = stored(runs.select("words").distinct().withColumn(
            "phrase", F.monotonically_increasing_id()), "phrases")
        owners = stored(runs.join(known, "words").select(
            "phrase", "item_id").distinct(), "owners")
        place = Window.partitionBy("phrase").orderBy("n", "offset")
        placed = stored(
            known.select("phrase", F.size("words").alias("size"),
                         F.posexplode("words").alias("offset", "word"))
            .join(beside(self.terms), "word")
            .join(beside(stored(self.frequencies(), "frequencies")), "term")
            .withColumn("rank", F.row_number().over(place))
            .withColumn("known", F.count("*").over(
                Window.partitionBy("phrase")))
            .filter("known = size").drop("word", "n", "known"), "placed")
        return Occurrences(self, owners, self.matched(placed))

    def matched(self, placed: DataFrame) -> DataFrame:
        """a, b, phrase, start, size of every place that has all terms."""
        at = [*DOC, "phrase", "start"]
        rare = placed.filter("rank <= 2").withColumn(
            "bit", F.col("rank"))
        both = stored(
            self.lists().join(beside(rare), "term")
            .withColumn("start", F.col("pos") - F.col("offset"))
            .filter("start >= 0").groupBy(*at)
            .agg(F.bit_or("bit").alias("bits"), F.max("size").alias("size"))
            .filter("bits = IF(size = 1, 1, 3)").drop("bits"), "intersected")
        bucket = F.pmod("a", F.lit(BUCKETS))
        # at most BUCKETS rows
        some = both.select(bucket.alias("bucket")).distinct()
        there = (self.lists().withColumn("bucket", bucket)
                 .join(F.broadcast(some), "bucket", "left_semi")
                 .select("term", *DOC, "pos").distinct())
        rest = placed.filter("rank > 2").drop("size")
        missing = (both.join(beside(rest), "phrase").select(
            *at, "size", "term",
            (F.col("start") + F.col("offset")).alias("pos")))
        whole = (missing.join(there, ["term", *DOC, "pos"])
                 .groupBy(*at, "size").agg(F.count("*").alias("n"))
                 .filter("n = size - 2").drop("n"))
        return stored(whole.unionByName(both.filter("size <= 2")),
                      "occurrences")

    def proximity(self, terms: int = 4, span: int = 20) -> DataFrame:
        """doc_id, item_id, start, end (exclusive): where the `terms` rarest
        terms of an item lie within `span` words, from its first such word.

        Items with a term that no document has among their rarest, or with no
        words, are near nothing; items of fewer terms need all they have.
        """
        numbered = stored(self.items.withColumn(
            "item", F.monotonically_increasing_id()), "items")
        used = (numbered.select("item", F.explode(F.array_distinct(
            letter_words(F.col("text")))).alias("word"))
            .join(beside(self.terms), "word")
            .join(beside(stored(self.frequencies(), "frequencies")), "term",
                  "left"))
        place = Window.partitionBy("item").orderBy(
            F.coalesce("n", F.lit(0)), "term")
        rare = (used.withColumn("slot", F.row_number().over(place) - 1)
                .filter(F.col("slot") < terms))
        rare = stored(rare.withColumn("need", F.count("*").over(
            Window.partitionBy("item"))).select("item", "term", "slot",
                                                "need"), "rare")
        ahead = Window.partitionBy(*DOC, "item").orderBy("pos").rangeBetween(
            0, span - 1)
        bit = F.expr("shiftleft(1L, slot)")
        near = (self.lists().distinct().join(beside(rare), "term")
                .withColumn("seen", F.bit_or(bit).over(ahead))
                .withColumn("last", F.max("pos").over(ahead))
                .filter("bit_count(seen) = need")
                .select(*DOC, "item", F.col("pos").alias("start"),
                        (F.col("last") + 1).alias("end")))
        return (near.join(numbered.select("item", "item_id"), "item")
                .join(self.documents(), DOC)
                .select("doc_id", "item_id", F.col("start").cast("long"),
                        F.col("end").cast("long")))


@dataclass(frozen=True)
class Occurrences:
    """places: a, b, phrase, start, size; owners: phrase, item_id."""
    index: Index
    owners: DataFrame
    places: DataFrame

    def spans(self) -> DataFrame:
        """doc_id, item_id, start, end (exclusive) of every occurrence."""
        return (self.places.join(beside(self.owners), "phrase")
                .join(self.index.documents(), DOC)
                .select("doc_id", "item_id", F.col("start").cast("long"),
                        (F.col("start") + F.col("size")).cast("long")
                        .alias("end")))

    def hits(self) -> DataFrame:
        """a, b, n_hit: words that some occurrence covers."""
        ends = self.places.groupBy(*DOC, "start").agg(
            F.max(F.col("start") + F.col("size")).alias("end"))
        earlier = (Window.partitionBy(*DOC).orderBy("start")
                   .rowsBetween(Window.unboundedPreceding, -1))
        reach = F.coalesce(F.max("end").over(earlier), F.lit(0))
        return (ends.withColumn("new", F.greatest(F.lit(0), F.col("end")
                - F.greatest("start", reach)))
                .groupBy(*DOC).agg(F.sum("new").alias("n_hit")))

    def found_items(self) -> DataFrame:
        """a, b, items: sorted texts of the ids whose phrases occur."""
        pairs = (self.places.select(*DOC, "phrase").distinct()
                 .join(beside(self.owners), "phrase")
                 .filter("item_id IS NOT NULL")
                 .select(*DOC, F.col("item_id").cast("string").alias("item"))
                 .distinct())
        return pairs.groupBy(*DOC).agg(F.array_sort(
            F.collect_list("item")).alias("items"))

    def report(self) -> DataFrame:
        """doc_id, n_words, n_hit, items (ids as sorted texts) per document."""
        hits = stored(self.hits().join(self.found_items(), DOC, "left"),
                      "hits")
        empty = F.array().cast("array<string>")
        return (self.index.documents().join(hits, DOC, "left")
                .select("doc_id", "n_words",
                        F.coalesce("n_hit", F.lit(0)).cast("long")
                        .alias("n_hit"),
                        F.coalesce("items", empty).alias("items")))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10
                   ) -> DataFrame:
    """doc_id, n_words, n_hit, items of every document."""
    return Index.build(docs, items).phrases(size).report()


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


ORACLE = rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r,
               list_filter(regexp_split_to_array(translate(
                   coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{BETWEEN}'),
                   lambda x: x <> '') AS w FROM documents),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(
              coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{BETWEEN}'),
              lambda x: x <> '') AS w FROM benchmark),
    p AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS phrase,
                 least(len(w), 10) AS size
          FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(s)
          WHERE len(w) > 0),
    o AS (SELECT r, s, size, item_id
          FROM (SELECT r, s, n.size, array_to_string(w[s:s + n.size - 1], ' ')
                       AS phrase
                FROM d, (SELECT DISTINCT size FROM p) AS n,
                     unnest(generate_series(1, len(w) - n.size + 1)) AS u(s))
          JOIN p USING (phrase, size)),
    h AS (SELECT r, count(DISTINCT x) AS n_hit
          FROM o, unnest(generate_series(s, s + size - 1)) AS u(x) GROUP BY r),
    k AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list_distinct(list(
                     CAST(item_id AS VARCHAR)))), ',') AS ids
          FROM o GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)"""


@query("op11_decontamination", sql=ORACLE)
def op11_decontamination(spark, sf_dir):
    rows = decontaminated(table(spark, sf_dir, "documents"),
                          table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit",
                       F.size("items").cast("long").alias("n_items"),
                       digest(F.col("items")).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))
