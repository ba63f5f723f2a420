"""Helpers shared by the corpus operators.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()``
cuts exactly there, and ``bytes.lower()`` lowers A-Z only.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: White space of the corpus contracts.
SPACE = r"[\x20\x09-\x0D]+"
#: Pattern of what lies between words of letters and digits, A-Z lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a table may have to be broadcast.
BROADCAST_ROWS = 1_000_000
#: Copies of a repeated row that one step of a task may make.
COPIES = 10_000
#: Entries that a worker's word cache holds before it starts afresh.
CACHE = 250_000
#: Rows that Arrow functions hand on in one batch.
OUT_ROWS = 200_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder and read again.

    Cuts the lineage: a lost executor costs no earlier work.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it has at most `rows` rows.

    Beyond that it is joined by a shuffle, whose hot partitions adaptive
    execution splits. The rows of small must be narrow.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows \
        else small


def lowered(text: Column) -> Column:
    """text (null: empty) with A-Z lowered and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)


def letter_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def ordered(rows: DataFrame, by: list[str | Column], label: str) -> DataFrame:
    """rows with their 0-based position (pos) in the order `by`.

    `by` must tell all rows of a stored table apart, so that no value fills a
    range. Ranges are dealt out by Spark's sampled splitters and written in
    order; the positions of a range start after the rows of those before it.
    """
    here = F.monotonically_increasing_id()
    dealt = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                   .withColumn("_part", F.shiftright(here, 33))
                   .withColumn("_row", here.bitwiseAND((1 << 33) - 1)), label)
    # one row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (dealt.groupBy("_part").agg(F.count("*").alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0))
                     .alias("_base")))
    return (dealt.join(F.broadcast(bases), "_part")
            .withColumn("pos", F.col("_base") + F.col("_row"))
            .drop("_part", "_row", "_base"))


def expanded(rows: DataFrame, n: str, copy: str) -> DataFrame:
    """Each row n times, its copies numbered from 0.

    rows must be stored. Rows of more than COPIES copies are cut into chunks
    that are dealt out, so neither an array nor a task holds them all.
    """
    few = rows.filter(F.col(n) <= COPIES).withColumn(copy, F.explode(
        F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    chunk = F.col("_chunk")
    many = (rows.filter(F.col(n) > COPIES)
            .withColumn("_chunk", F.explode(F.sequence(
                F.lit(0).cast("long"), F.expr(f"({n} - 1) div {COPIES}"))))
            .repartition("_chunk")
            .withColumn(copy, F.explode(F.sequence(
                chunk * COPIES, F.least((chunk + 1) * COPIES, F.col(n)) - 1)))
            .drop("_chunk"))
    return few.unionByName(many)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text (null: empty), whatever else docs carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))


def byte_texts(docs: DataFrame) -> DataFrame:
    """As texts(), the text as UTF-8 bytes for Arrow functions."""
    return texts(docs).withColumn("text", F.col("text").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (murmur3's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def in_batches(rows: dict[str, list], types: dict[str, pa.DataType]
               ) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[k], t) for k, t in types.items()], names=list(types))


def runs(batches: Iterator[pa.RecordBatch], key: list[str]
         ) -> Iterator[pa.Table]:
    """Batches sorted by key, recut so that no key spans two of them.

    Only the last, still open key of a batch is held back, so memory is
    bounded by one batch and the rows of one key.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(batch.schema.get_field_index(k)) for k in key]
        if held:
            last = held[-1]
            same = all(last.column(last.schema.get_field_index(k))[-1]
                       == x[-1] for k, x in zip(key, ids, strict=True))
            if same:
                held.append(batch)
                continue
        cut = np.zeros(batch.num_rows, bool)
        for x in ids:
            values = x.to_numpy(zero_copy_only=False)
            cut[1:] |= values[1:] != values[:-1]
        at = int(np.flatnonzero(cut)[-1]) if cut.any() else 0
        if held and not all(
                held[-1].column(held[-1].schema.get_field_index(k))[-1]
                == x[0] for k, x in zip(key, ids, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
