"""Exact duplicates: heavy hitters leave map-side, the rest by one shuffle.

1. Every text becomes the SHA-256 of its normalised form; rows that repeat a
   document are summed by (digest, doc_id), a key that no group makes hot.
2. Each partition keeps a Misra-Gries summary of ``k`` counters. Summed over
   partitions a counter is at most ``n / (k + 1)`` below the true count, so
   every digest with more than ``2n / (k + 1)`` rows sums to more than
   ``n / (k + 1)``, and no more than ``k`` digests can: the frequent list is
   bounded by ``k`` whatever the input.
3. The winners of the frequent digests are counted exactly (map-side partial
   aggregates of ``k`` keys), broadcast, and settle their rows without a
   shuffle. All other digests are reduced and joined by ordinary shuffles;
   none of them holds more than ``2n / (k + 1)`` rows.

Defined cases: null text is the empty text; the smallest non-null doc_id of a
group stays; a document listed twice with equal text gives two rows, of which
one is kept; rows without doc_id are never kept unless the whole group has
none, when one of them is. Other columns are ignored.
"""
from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, expanded, stored, texts
from .registry import query, table

#: Counters of a Misra-Gries summary, and so the most broadcast digests.
COUNTERS = 1024


def text_digest(text="text"):
    """SHA-256 (binary) of a text with each white-space run as one space."""
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    return F.unhex(F.sha2(flat.cast("binary"), 256))


def summarise(kept: dict, more: dict, k: int) -> dict:
    """Misra-Gries merge: add the counts, then cut back to k counters.

    Subtracting the (k + 1)-th largest count lowers each kept count by at
    most 1 / (k + 1) of what the summary has seen.
    """
    for key, n in more.items():
        kept[key] = kept.get(key, 0) + n
    if len(kept) <= k:
        return kept
    cut = heapq.nlargest(k + 1, kept.values())[-1]
    return {key: n - cut for key, n in kept.items() if n > cut}


def frequent(counts: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Digests with more than 2n / (k + 1) of the n rows; at most k rows."""
    def part(batches):
        kept: dict[bytes, int] = {}
        for b in batches:
            # equal digests of a batch first meet in Arrow
            t = pa.Table.from_batches([b]).group_by("digest").aggregate(
                [("n", "sum")])
            kept = summarise(kept, dict(zip(
                t["digest"].to_pylist(), t["n_sum"].to_pylist(),
                strict=True)), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.binary()),
             pa.array(list(kept.values()), pa.int64())], names=["digest", "n"])

    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    rows = total.first()["rows"]
    return (counts.select("digest", "n")
            .mapInArrow(part, "digest binary, n long")
            .groupBy("digest").agg(F.sum("n").alias("n"))
            .filter(F.col("n") * (k + 1) > rows).select("digest"))


def exact_groups(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, n, keep_id, group_size) per distinct document."""
    counts = stored(
        texts(docs).select("doc_id", text_digest().alias("digest"))
        .groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
    hot = stored(frequent(counts, k).withColumn("hot", F.lit(True)), "hot")
    # at most k rows by construction, see step 2
    tagged = counts.join(F.broadcast(hot), "digest", "left")
    best = [F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")]
    winners = (counts.join(F.broadcast(hot.select("digest")), "digest",
                           "left_semi").groupBy("digest").agg(*best))
    hot_rows = (tagged.filter("hot").drop("hot")
                .join(F.broadcast(stored(winners, "winners")), "digest"))
    rest = tagged.filter("hot IS NULL").drop("hot")
    rest_rows = rest.join(rest.groupBy("digest").agg(*best), "digest")
    return hot_rows.unionByName(rest_rows)


def exact_dedup(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return (expanded(stored(exact_groups(docs, k), "groups"), "n", "copy")
            .select("doc_id", "keep_id", "group_size",
                    ((F.col("copy") == 0) & F.col("doc_id").eqNullSafe(
                        F.col("keep_id"))).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_copies(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept.

    Rows that repeat a document of the same id meet in a second, narrow step:
    only documents known to be listed twice are compared again.
    """
    names = docs.columns
    won = (exact_groups(docs, k)
           .filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
           .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"),
                   F.col("n").alias("_n")))
    rows = docs.withColumn("_digest", text_digest())
    found = rows.join(
        won,
        F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
        & (rows["_digest"] == won["_digest"])).drop(won["_digest"])
    once = found.filter("_n = 1").select(*names)
    twice = found.filter("_n > 1").dropDuplicates(["_id", "_digest"])
    return once.unionByName(twice.select(*names))


@query("op5_exact_dedup", sql=r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id,
           count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''),
                 '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    WINDOW g AS (PARTITION BY text_sha256)""")
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
