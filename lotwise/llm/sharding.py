"""Sharding by sampled splitters, DataFrame operations only.

Law ``bytes``: records lie in the order of (doc_id, text CRC), each shard is a
run of that order, and shards differ by about one record's size.

1. The narrow table (doc_id, size, crc, copies) is written once; records that
   agree in all three are one row with a count, so no key is hot.
2. A size-weighted sample (a record enters with probability proportional to
   its size, decided by a hash of it) gives quantile splitters of key ranges.
3. Exact bytes and records of each range are counted. Ranges with more than
   SLACK times their share are sampled anew and subdivided, up to ROUNDS
   times.
4. Prefix sums over ranges (one row each) and, by a window, inside each range
   give every record its exact byte position; the shard is the position's
   share of the total. Splitters steer only how work is dealt out: the result
   does not depend on the sample.

Ranges number ``rows / PER_RANGE``, within bounds that are proven small:
range tables of at most MOST_RANGES * (1 + ROUNDS) rows are broadcast.

Defined cases: null text has no bytes and CRC 0; records without doc_id come
first; repeated rows lie side by side, one slot each; an empty table gives no
rows; other columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expanded, stored
from .registry import query, table

PER_RANGE, LEAST_RANGES, MOST_RANGES = 20_000, 192, 16_384
#: Sampled records per range; how far a range may exceed its share.
OVERSAMPLE, SLACK, ROUNDS = 16, 4, 3
KEY = "decimal(32,0)"
LOWEST = -(1 << 63) - 1


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, n, key), one row per distinct record."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.octet_length(text) + F.lit(8)).cast("long")
                        .alias("size"), F.crc32(text).alias("text_crc32"))
            .groupBy("doc_id", "size", "text_crc32")
            .agg(F.count("*").alias("n")))
    key = (F.coalesce(F.col("doc_id").cast("decimal(20,0)"),
                      F.lit(str(LOWEST)).cast("decimal(20,0)"))
           * F.lit(1 << 32).cast("decimal(10,0)")
           + F.col("text_crc32").cast("decimal(10,0)")).cast(KEY)
    return rows.withColumn("key", key)


def chance(salt: int) -> Column:
    """A number in [0, 1) that depends on the record only."""
    return (F.pmod(F.xxhash64("key", "size", F.lit(salt)), F.lit(1 << 52))
            / F.lit(float(1 << 52)))


def array_of(values: list) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(
        f"array<{KEY}>")


def range_of(splitters: list) -> Column:
    """How many splitters are at or below the key, by a two-level search."""
    if not splitters:
        return F.lit(0)
    width = max(1, math.isqrt(len(splitters)))
    coarse, fine = array_of(splitters[::width]), array_of(splitters)
    block = F.size(F.filter(coarse, lambda b: b <= F.col("key")))
    first = F.greatest((block - 1) * width, F.lit(0))
    within = F.size(F.filter(F.slice(fine, first + 1, F.lit(width)),
                             lambda b: b <= F.col("key")))
    return F.when(block == 0, 0).otherwise(first + within).cast("int")


def splitters_of(sample: DataFrame, by: list[str]) -> list:
    """Keys where a sample's running weight enters another piece.

    sample: by, key, weight, and each row's share, the weight of a piece.
    """
    run = F.sum("weight").over(
        Window.partitionBy(*by).orderBy("key")
        .rowsBetween(Window.unboundedPreceding, -1))
    run = F.coalesce(run, F.lit(0.0))
    rows = sample.withColumn("piece", F.floor(run / F.col("share")))
    first = rows.groupBy(*by, "piece").agg(F.min("key").alias("key"))
    return [int(r["key"]) for r in first.filter("piece > 0").collect()]


def sampled(rows: DataFrame, share: Column, salt: int) -> DataFrame:
    """A record of `size` bytes enters with probability size * n / step."""
    step = share / OVERSAMPLE
    mass = F.col("size") * F.col("n")
    return (rows.withColumn("share", share.cast("double"))
            .filter(chance(salt) < mass / step)
            .withColumn("weight", F.greatest(mass, step).cast("double")))


def ranged(rows: DataFrame, total: int, count: int) -> tuple[DataFrame, list]:
    """rows with their range, and the sorted splitters."""
    n = min(MOST_RANGES, max(LEAST_RANGES, count // PER_RANGE))
    share = max(1.0, total / n)
    sample = sampled(rows, F.lit(share), 0).withColumn("all", F.lit(0))
    splitters = sorted(set(splitters_of(sample, ["all"])))
    for k in range(1, ROUNDS + 1):
        found = rows.withColumn("range", range_of(splitters))
        over = (found.groupBy("range").agg(
            F.sum(F.col("size") * F.col("n")).alias("bytes"),
            F.count("*").alias("rows")).filter(
                (F.col("rows") > 1)
                & ((F.col("bytes") > SLACK * share)
                   | (F.col("rows") > SLACK * max(1, count // n)))))
        # a range of many small records is cut by records, by bytes otherwise
        pieces = F.greatest(F.col("bytes") / share,
                            F.col("rows") / max(1, count // n))
        over = over.select("range", (F.col("bytes") / pieces).alias("part"))
        inside = found.join(F.broadcast(over), "range")
        more = splitters_of(sampled(inside, F.col("part"), k), ["range"])
        if not more:
            break
        splitters = sorted({*splitters, *more})
    return rows.withColumn("range", range_of(splitters)), splitters


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    rows = stored(records(docs), "records")
    mass = F.col("size") * F.col("n")
    sums = rows.agg(F.coalesce(F.sum(mass), F.lit(0)).alias("bytes"),
                    F.count("*").alias("rows")).first()
    total = max(1, sums["bytes"])
    found, splitters = ranged(rows, total, sums["rows"])
    # one row per range: bounded, so its prefix sums may use one task
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (found.groupBy("range").agg(F.sum(mass).alias("b"),
                                        F.sum("n").alias("c"))
             .select("range",
                     F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                     F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0")))
    inside = (Window.partitionBy("range").orderBy("key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (found.withColumn("b1", F.coalesce(F.sum(mass).over(inside),
                                                F.lit(0)))
              .withColumn("c1", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(F.broadcast(bases), "range")
              .select("doc_id", "size", "text_crc32", "n",
                      (F.col("b0") + F.col("b1")).alias("byte"),
                      (F.col("c0") + F.col("c1")).alias("row")))
    placed = (expanded(stored(placed, "positions"), "n", "copy")
              .withColumn("middle", 2 * (F.col("byte") + F.col("copy")
                                         * F.col("size")) + F.col("size"))
              .select("doc_id", "size", "text_crc32",
                      (F.col("row") + F.col("copy")).alias("row"),
                      F.least(F.lit(shards - 1), F.expr(
                          f"middle * {shards} div {2 * total}")).cast("int")
                      .alias("shard")))
    placed = stored(placed, "placed")
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32",
                    F.lit("bytes").alias("law"), "shard",
                    (F.col("row") - F.col("row0")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
