"""Repeated passages: Rabin-Karp hashes of all windows, counted in Spark.

A window is ``size`` consecutive words of one document. Words covered by a
window that also starts in a document with a smaller doc_id are removed; the
covering windows merge into maximal intervals.

1. One pass per text gives the digest of its words and its window minimisers:
   of the ``size // 2 + 1``-word hashes inside a window, the least. Equal
   windows have equal minimisers, and neighbours mostly share theirs, so a
   text has one minimiser for about thirteen windows.
2. Equal word sequences: only the smallest doc_id goes on; its copies are
   covered whole (every window of theirs starts in it).
3. Minimisers met in two documents are found by an aggregate. A window with
   any other minimiser cannot repeat, so only texts that hold a repeated one
   go on. This prunes; it decides nothing.
4. All windows with a repeated minimiser are hashed (Rabin-Karp, two moduli,
   96 bits) and the smallest doc_id of each hash is aggregated; windows of
   larger doc_ids are removed.

Counts are map-side partial aggregates, and joins are of the kind whose hot
partitions Spark splits: a window that a third of all documents share is
neither one task's rows nor any pair of them.

Defined cases: null and empty texts have no words; texts below ``size`` words
lose nothing; a doc_id listed twice is one document (its rows do not remove
each other's words); rows without doc_id neither remove nor lose words; other
columns are ignored.
"""
from __future__ import annotations

import hashlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, mixed, stored
from .registry import query, table

SIZE = 50
CHUNK_WORDS = 200_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@cache
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i to n."""
    def series(x):
        out = np.ones(n + 1, np.uint64)
        out[1:] = np.cumprod(np.full(n, np.uint64(x)))
        return out
    return series(base), series(pow(base, -1, 1 << 64))


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each run of `size` word hashes, modulo 2 ** 64."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(base, 1 << n.bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[:n - size + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def minimisers(words: np.ndarray, size: int) -> np.ndarray:
    """For each window, the least hash of its size // 2 + 1-word runs."""
    gram = size // 2 + 1
    if len(words) < size:
        return np.zeros(0, np.uint64)
    return sliding_min(window_hashes(words, gram, BASES[0]), size - gram + 1)


def chunks(batches):
    """Columns before the text, and word lists, of about CHUNK_WORDS words."""
    for batch in batches:
        rest = [c.to_pylist() for c in batch.columns[:-1]]
        a, held, count = 0, [], 0
        for i, text in enumerate(batch.columns[-1]):
            words = text.as_py().split()
            held.append(words)
            count += len(words)
            if count >= CHUNK_WORDS or i + 1 == batch.num_rows:
                yield [c[a:i + 1] for c in rest], held
                a, held, count = i + 1, [], 0


def starts_of(lists: list[list], size: int) -> tuple[np.ndarray, ...]:
    """Where each document begins among all words; for each window inside one
    document its start among all words, and its document's number."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    first = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - size + 1, 0)
    doc = np.repeat(np.arange(len(lists)), windows)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows,
                                             windows)
    return first, first[doc] + inside, doc


def word_digest(joined: bytes) -> tuple[bytes, int]:
    """128-bit digest, and a part of it that tells rows of one id apart."""
    value = xxhash.xxh3_128_digest(joined)
    return value, int.from_bytes(value[:8], "little", signed=True)


def read_texts(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, digest, tag, sha, minis: one row per input row."""
    def part(batches):
        hashes = WordHashes()
        for (ids,), lists in chunks(batches):
            joined = [b" ".join(w) for w in lists]
            digests = [word_digest(x) for x in joined]
            words = hashes.of(list(chain.from_iterable(lists)))
            _, at, doc = starts_of(lists, size)
            least = minimisers(words, size)[at] if len(at) else np.zeros(
                0, np.uint64)
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            counts = np.bincount(doc[new], minlength=len(lists))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([len(w) for w in lists], pa.int64()),
                pa.array([d for d, _ in digests], pa.binary()),
                pa.array([t for _, t in digests], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in joined]),
                pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(least[new].view(np.int64)))],
                names=["doc_id", "n_words", "digest", "tag", "sha", "minis"])

    return byte_texts(docs).mapInArrow(
        part, "doc_id long, n_words long, digest binary, tag long, "
              "sha string, minis array<long>")


def candidate_windows(found: DataFrame, size: int) -> DataFrame:
    """h1, h2, doc_id, tag, pos of all windows with a repeated minimiser."""
    def part(batches):
        hashes = WordHashes()
        for (ids, tags, repeated), lists in chunks(batches):
            words = hashes.of(list(chain.from_iterable(lists)))
            first, at, doc = starts_of(lists, size)
            least = minimisers(words, size)[at].view(np.int64)
            # a minimiser counts for the document it is listed with
            ends = np.searchsorted(doc, np.arange(len(lists) + 1))
            keep = np.concatenate([np.zeros(0, bool), *(
                np.isin(least[a:b], np.asarray(r, np.int64))
                for a, b, r in zip(ends, ends[1:], repeated, strict=False))])
            at, doc = at[keep], doc[keep]
            yield pa.RecordBatch.from_arrays([
                pa.array(window_hashes(words, size, BASES[0])[at]
                         .view(np.int64)),
                pa.array(window_hashes(words, size, BASES[1])[at]
                         .astype(np.uint32).view(np.int32)),
                pa.array(np.asarray(ids, np.int64)[doc]),
                pa.array(np.asarray(tags, np.int64)[doc]),
                pa.array((at - first[doc]).astype(np.int32))],
                names=["h1", "h2", "doc_id", "tag", "pos"])

    return found.select("doc_id", "tag", "repeated", "text").mapInArrow(
        part, "h1 long, h2 int, doc_id long, tag long, pos int")


def cut_out(rows: DataFrame, size: int) -> DataFrame:
    """rows (doc_id, tag, covered starts, text) with spans and what is left."""
    def part(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                starts = np.unique(np.asarray(batch.column(2)[i].as_py()))
                words = batch.column(3)[i].as_py().split()
                breaks = np.flatnonzero(starts[1:] > starts[:-1] + size) + 1
                a = starts[np.concatenate([[0], breaks])]
                b = starts[np.concatenate([breaks - 1, [-1]])] + size
                left, last = [], 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    left += words[last:x]
                    last = y
                left += words[last:]
                out.append((np.stack([a, b], 1).tolist(), len(words) - len(left),
                            hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([x[0] for x in out], pa.list_(pa.list_(pa.int64()))),
                 pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], pa.string())],
                names=["doc_id", "tag", "spans", "n_removed", "left_sha"])

    return rows.select("doc_id", "tag", "starts", "text").mapInArrow(
        part, "doc_id long, tag long, spans array<array<long>>, "
              "n_removed long, left_sha string")


def repeated_passages(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans ([start, end) word numbers,
    maximal), kept_sha256 of the words that stay."""
    rows = stored(read_texts(docs, size), "texts")
    leaders = stored(rows.filter((F.col("n_words") >= size) & F.col(
        "doc_id").isNotNull()).groupBy("digest")
        .agg(F.min("doc_id").alias("leader")), "leaders")
    rows = stored(rows.join(leaders, "digest", "left"), "led")
    single = rows.filter("doc_id = leader")
    minis = single.select("doc_id", "tag", F.explode("minis").alias("mini"))
    # aggregates are stored before they are joined: a join of two plain
    # exchanges is one whose hot partitions Spark splits
    repeated = stored(minis.groupBy("mini")
                      .agg(F.min("doc_id").alias("a"),
                           F.max("doc_id").alias("b"))
                      .filter("a < b").select("mini"), "minis")
    listed = (minis.join(repeated, "mini").groupBy("doc_id", "tag")
              .agg(F.collect_set("mini").alias("repeated")))
    # whole texts move once; only those with a repeated minimiser go on
    source = byte_texts(docs).withColumnRenamed("doc_id", "id")
    found = source.join(listed, F.col("id") == F.col("doc_id"))
    found = stored(with_tag(found.select("doc_id", "tag", "repeated", "text")),
                   "found")
    windows = candidate_windows(found, size)
    firsts = stored(windows.groupBy("h1", "h2")
                    .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                    .filter("a < b")
                    .select("h1", "h2", F.col("a").alias("first")), "firsts")
    starts = (windows.join(firsts, ["h1", "h2"]).filter("doc_id > first")
              .groupBy("doc_id", "tag")
              .agg(F.collect_set("pos").alias("starts")))
    cut = (cut_out(found.join(starts, ["doc_id", "tag"]), size)
           .dropDuplicates(["doc_id", "tag"]))
    copy = (F.col("n_words") >= size) & (F.col("doc_id") > F.col("leader"))
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    return (rows.drop("minis").join(cut, ["doc_id", "tag"], "left")
            .select("doc_id", "n_words",
                    F.when(copy, F.col("n_words")).otherwise(
                        F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(copy, whole).otherwise(F.coalesce(
                        "spans", F.array().cast("array<array<long>>")))
                    .alias("spans"),
                    F.when(copy, F.sha2(F.lit("").cast("binary"), 256))
                    .otherwise(F.coalesce("left_sha", "sha"))
                    .alias("kept_sha256")))


def with_tag(found: DataFrame) -> DataFrame:
    """Rows whose text is the one that their tag was listed for."""
    def part(batches):
        for batch in batches:
            same = [word_digest(b" ".join(x.as_py().split()))[1] == t
                    for x, t in zip(batch.column(3),
                                    batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    return found.mapInArrow(part, found.schema)


@query("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")
