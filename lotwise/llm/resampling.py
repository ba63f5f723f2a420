"""Resampling of documents towards a target distribution.

Features are all runs of 1 to `longest` consecutive words (letters, digits and
non-ASCII characters, A-Z lowered), joined by one space; a feature's bucket is
the CRC-32 of its bytes modulo `buckets`. A bucket's gain is the scaled
log-ratio of its smoothed shares in the target and in the documents, a
document's weight the sum of its features' gains. Gumbel noise that depends on
the doc_id only turns the weights into a draw without replacement.

1. Head: Misra-Gries summaries of words, and of pairs if `longest` asks for
   them, are merged over all documents. Every word with more than 2n / (k + 1)
   of n occurrences is in the head, which holds k words and k pairs of at most
   LONGEST_KEY bytes at most, whatever the input. The exact CRC states of head
   words (after the word, and after the space behind it) and the buckets of
   head pairs are broadcast.
2. Tail: every other feature takes its CRC directly, from the state of its
   first word if that is in the head. The head saves work and decides nothing.
3. Both feed exact bucket totals: a vector per task, summed in Spark.
4. A second pass adds up the gains. Ranks come from sampled ranges
   (common.ordered), so no task sorts more than its range.

Defined cases: null and empty texts have no features, weight 0, and too few
words to be drawn; a document listed twice is drawn twice or once as its rows
are ranked; a row without doc_id has the noise of an empty id and comes after
equal scores; an empty target has equal shares; empty tables give no rows;
other columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN, CAPITALS, SMALL, byte_texts, ordered, stored
from .exact_dedup import summarise
from .registry import query, table

#: Words and pairs of the head, and the longest of them in bytes.
HEAD, LONGEST_KEY = 20_000, 64
SEED = 2024
#: Bytes of words as they are, A-Z lowered, all others a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122
               or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Words(dict):
    """CRC-32 of words: the head's are kept, others taken directly."""
    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Open(dict):
    """CRC-32 after a word and a space, as Words."""
    def __missing__(self, word: bytes) -> int:
        return crc32(b" ", crc32(word))


class Pairs(dict):
    """CRC-32 of pairs (u, v); a pair outside the head goes on from u's."""
    def __init__(self, pairs, opened: Open):
        super().__init__(pairs)
        self.opened = opened

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(pair[1], self.opened[pair[0]])


class Features:
    """Buckets of all features of a text, by head and tail."""
    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]],
                 buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.words = Words((w, crc32(w)) for w in words)
        opened = Open((w, crc32(b" ", crc32(w))) for w in words)
        self.pairs = Pairs(((p, crc32(p[1], opened[p[0]])) for p in pairs),
                           opened)

    def of(self, words: list[bytes]) -> np.ndarray:
        found = [np.fromiter(map(self.words.__getitem__, words), np.uint32,
                             len(words))]
        if self.longest > 1 and len(words) > 1:
            state = [self.pairs[p] for p in zip(words, words[1:])]
            found.append(np.array(state, np.uint32))
            for n in range(3, min(self.longest, len(words)) + 1):
                state = [crc32(w, crc32(b" ", s)) for s, w in
                         zip(state, words[n - 1:])]
                found.append(np.array(state, np.uint32))
        return np.concatenate(found) % np.uint32(self.buckets)


def frequent(docs: DataFrame, k: int, n: int) -> list[tuple[bytes, ...]]:
    """Runs of n words with more than 2 / (k + 1) of all occurrences.

    At most k of them, since a kept count may exceed 1 / (k + 1) of the
    whole for so many runs only.
    """
    def part(batches):
        kept: dict[bytes, int] = {}
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                more: Counter = Counter()
                for text in batch.column(1).slice(at, 500):
                    words = words_of(text.as_py())
                    more.update(words if n == 1 else map(b" ".join, zip(
                        *(words[i:] for i in range(n)))))
                total += more.total()
                kept = summarise(kept, more, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*kept, None], pa.binary()),
             pa.array([*kept.values(), total], pa.int64())],
            names=["run", "n"])

    counts = stored(byte_texts(docs).mapInArrow(part, "run binary, n long")
                    .groupBy("run").agg(F.sum("n").alias("n")), "frequent")
    total = counts.filter("run IS NULL").agg(
        F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.filter((F.length("run") <= LONGEST_KEY)
                          & (F.col("n") * (k + 1) > total))
    # at most k rows of LONGEST_KEY bytes
    return [tuple(bytes(r["run"]).split(b" ")) for r in
            often.select("run").collect()]


def head_of(docs: DataFrame, buckets: int, longest: int, k: int) -> Features:
    words = [w for w, in frequent(docs, k, 1)]
    return Features(words, frequent(docs, k, 2) if longest > 1 else [],
                    buckets, longest)


def totals(docs: DataFrame, head, buckets: int) -> DataFrame:
    """bucket, n: exact feature counts of all texts."""
    def part(batches):
        features, count = head.value, np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(1):
                count += np.bincount(features.of(words_of(text.as_py())),
                                     minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(count[some])],
            names=["bucket", "n"])

    return (byte_texts(docs).mapInArrow(part, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of every bucket."""
    both = (source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
            .unionByName(target.select("bucket", F.lit(0).alias("s"),
                                       F.col("n").alias("t")))
            .unionByName(source.sparkSession.range(buckets).select(
                F.col("id").alias("bucket"), F.lit(0).alias("s"),
                F.lit(0).alias("t")))
            .groupBy("bucket").agg(F.sum("s").alias("s"),
                                   F.sum("t").alias("t")))
    both = stored(both, "buckets")
    total = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    whole_s, whole_t = (F.lit(float(x + buckets)) for x in total)
    gain = F.floor(1000 * F.log((t + 1) * whole_s / ((s + 1) * whole_t)))
    # `buckets` rows
    rows = both.select("bucket", gain.alias("gain")).collect()
    found = np.zeros(buckets, np.int64)
    for r in rows:
        found[r["bucket"]] = r["gain"]
    return found


def weighed(docs: DataFrame, head, gain) -> DataFrame:
    """doc_id, n_words, n_features, weight; one row per row of docs."""
    def part(batches):
        features, by_bucket = head.value, gain.value
        for batch in batches:
            words, count, weight = [], [], []
            for text in batch.column(1):
                found = words_of(text.as_py())
                of = features.of(found)
                words.append(len(found))
                count.append(len(of))
                weight.append(int(by_bucket[of].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(weight, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"])

    return byte_texts(docs).mapInArrow(
        part, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x) of a Gumbel variable x that depends on the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"),
                                                  F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16,
               10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10,
              least_words: int = 20, buckets: int = 10_000, longest: int = 1,
              head_size: int = HEAD) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) per row.

    docs: doc_id, text. target: text. `percent` of the documents with at least
    `least_words` words are drawn, by score, ties to smaller doc_id.
    """
    spark = docs.sparkSession
    target = target.select(F.lit(0).alias("doc_id"), "text")
    head = spark.sparkContext.broadcast(
        head_of(docs, buckets, longest, head_size))
    gain = spark.sparkContext.broadcast(gains(
        totals(docs, head, buckets), totals(target, head, buckets), buckets))
    rows = stored(weighed(docs, head, gain)
                  .withColumn("score", F.col("weight")
                              + noise(F.col("doc_id")))
                  .withColumn("tie", F.monotonically_increasing_id()),
                  "weights")
    enough = F.col("n_words") >= least_words
    some = rows.filter(enough)
    drawn = some.count() * percent // 100
    place = ordered(some, [F.desc("score"), F.asc_nulls_last("doc_id"),
                           F.asc("tie")], "ranked")
    names = ["doc_id", "n_features", "weight", "score"]
    return (place.select(*names, F.when(F.col("pos") < drawn,
                                        F.col("pos") + 1).alias("rank"))
            .unionByName(rows.filter(~enough).select(
                *names, F.lit(None).cast("long").alias("rank"))))


#: CRC-32 of the UTF-8 bytes of f, bit by bit.
SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(generate_series(0, strlen(f) - 1),
        lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::UBIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x),
        [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1,
            3988292384::UBIGINT * (y & 1)))))"""

SQL_WORDS = f"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    '{CAPITALS}', '{SMALL}'), '{BETWEEN}'), lambda x: x <> '')"""

ORACLE = f"""
    WITH d AS (SELECT doc_id, {SQL_WORDS} AS w, row_number() OVER () AS r
               FROM documents),
    x AS (SELECT r, unnest(w) AS f FROM d),
    y AS (SELECT unnest({SQL_WORDS}) AS f FROM benchmark),
    k AS (SELECT f, {SQL_CRC} % 10000 AS b
          FROM (SELECT f FROM x UNION SELECT f FROM y)),
    s AS (SELECT b, count(*) AS s FROM x JOIN k USING (f) GROUP BY b),
    t AS (SELECT b, count(*) AS t FROM y JOIN k USING (f) GROUP BY b),
    g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE
                 * ((SELECT count(*) FROM x) + 10000)
                 / ((coalesce(s, 0) + 1)::DOUBLE
                    * ((SELECT count(*) FROM y) + 10000)))) AS BIGINT) AS gain
          FROM s FULL JOIN t USING (b)),
    v AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight
          FROM x JOIN k USING (f) JOIN g USING (b) GROUP BY r),
    e AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
                     ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT
                     + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score,
                 len(w) >= 20 AS enough
          FROM d LEFT JOIN v USING (r)),
    o AS (SELECT *, row_number() OVER (PARTITION BY enough
                 ORDER BY score DESC, doc_id) AS place,
                 count(*) OVER (PARTITION BY enough) AS n FROM e)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN enough AND place <= 10 * n // 100 THEN place END AS rank
    FROM o"""


@query("op13_importance_resampling", sql=ORACLE)
def op13_importance_resampling(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"),
                     table(spark, sf_dir, "benchmark"))
