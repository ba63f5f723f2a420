"""Near-duplicates over SetSketch registers.

A document is the set of its distinct 5-word shingles. Register i of a sketch
is ``floor(1 - log_b x_i)`` of the least of the exponential variables x_i(e)
over the set, truncated to [0, q + 1]: registers of a union are the larger of
both (merge), and equal registers mark similar sets.

1. Equal sets meet by their digest; the smallest doc_id stands for them.
2. Bands of register values give buckets. In each bucket one member, the hub
   (the one with the most company over all its buckets), is paired with the
   others: a group of g copies costs g pairs, not g squared.
3. Pairs pass a lossless size test and the joint maximum-likelihood estimate
   of their similarity from the registers (with 5 standard errors to spare),
   and are then confirmed on the full sets.
4. Components of the confirmed links. In buckets that still hold two
   components, members of different components are compared as well, in
   blocks of BLOCK rows: estimated, then confirmed on the full sets inside
   the task, which returns links only. No link that changes a component is
   left out for the sake of a large bucket, and no list of pairs is made.

A pair at the threshold shares no band with probability
(1 - t ** rows) ** bands: 2e-8 for the defaults at 0.85.

Defined cases: documents without words (null or empty texts) have an empty
set and are linked with nothing; rows without doc_id take no part (component
null, kept); a doc_id listed twice gives two rows, each judged by its own
text; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, mixed, runs, stored
from .components import components
from .registry import query, table
from .substring_dedup import BASES, window_hashes

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Base of the register scale, rate of the exponentials, largest register - 1.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
BLOCK = 256
ERRORS = 5.0


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of lower-cased words."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    found = window_hashes(hashes.of(words), size, BASES[0])
    if size < SHINGLE:
        found = mixed(found ^ np.uint64(size))
    return np.unique(found)


class SetSketch:
    def __init__(self, registers: int):
        draw = np.random.Generator(np.random.PCG64(7))
        self.a = draw.integers(0, 1 << 63, registers, np.uint64) * 2 + 1
        self.b = draw.integers(0, 1 << 63, registers, np.uint64)

    def of(self, elements: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max)
        for at in range(0, len(elements), 256):
            part = elements[at:at + 256, None] * self.a
            part += self.b
            np.minimum(least, part.min(0), out=least)
        x = -np.log1p(-(least + 0.5) / 2.0 ** 64 * (1 - 1e-16)) / RATE
        value = np.floor(1 - np.log(x) / np.log(BASE))
        return np.clip(value, 0, Q + 1).astype(np.uint16)


def likely(nu, nv, above, below, equal) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sketches.

    nu, nv: set sizes; above, below, equal: registers of the first that
    exceed, stay below and equal those of the second.
    """
    u, v = nu / (nu + nv), nv / (nu + nv)

    def p(x):
        x = np.clip(x, 0.0, 1.0)
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        over, under = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-300))       # noqa: E731
        return (above * log(over) + below * log(under)
                + equal * log(1 - over - under))

    low, high = np.zeros(len(u)), np.minimum(nu / nv, nv / nu)
    for _ in range(40):
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low = np.where(left, low + third, low)
        high = np.where(left, high, high - third)
    return (low + high) / 2


def promising(x: np.ndarray, y: np.ndarray, nx, ny, percent: int
              ) -> np.ndarray:
    """Which pairs of register rows may reach the threshold."""
    m, t = x.shape[1], percent / 100
    ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    at = np.flatnonzero(ok)
    x, y = x[at], y[at]
    equal = (x == y).sum(1)
    above = (x > y).sum(1)
    least = t - ERRORS * np.sqrt(t * (1 - t) / m)
    estimate = likely(nx[at].astype(float), ny[at].astype(float), above,
                      m - above - equal, equal)
    ok[at] = estimate >= least
    return ok


def sketched(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n, digest (null without words), sketch, keys of its bands."""
    def part(batches):
        hashes, maker = WordHashes(), SetSketch(bands * rows)
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                n, digest, sketch, keys = [], [], [], []
                for text in some.column(1):
                    found = shingles(text.as_py().lower().split(), hashes)
                    n.append(len(found))
                    if not len(found):
                        digest.append(None)
                        sketch.append(None)
                        keys.append([])
                        continue
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    values = maker.of(found)
                    sketch.append(values.tobytes())
                    key = salt.copy()
                    for r in values.reshape(bands, rows).T:
                        key = mixed(key ^ r)
                    keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()),
                     pa.array(digest, pa.binary()),
                     pa.array(sketch, pa.binary()),
                     pa.ListArray.from_arrays(
                         np.cumsum([0, *map(len, keys)]).astype(np.int32),
                         pa.array(np.fromiter(chain.from_iterable(keys),
                                              np.int64)))],
                    names=["doc_id", "n", "digest", "sketch", "keys"])

    return byte_texts(docs).mapInArrow(
        part, "doc_id long, n long, digest binary, sketch binary, "
              "keys array<long>")


def matrix(column) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, np.uint16).reshape(len(column), -1)


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids whose sketches may reach the threshold."""
    def part(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                some = batch.slice(at, 20_000)
                ok = promising(matrix(some.column(4)), matrix(some.column(5)),
                               some.column(2).to_numpy(),
                               some.column(3).to_numpy(), percent)
                yield some.filter(pa.array(ok)).select(["a", "b"])

    side = lambda c: nodes.select(                          # noqa: E731
        F.col("id").alias(c), F.col("n").alias(f"n{c}"),
        F.col("sketch").alias(f"s{c}"))
    rows = (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .select("a", "b", "na", "nb", "sa", "sb"))
    return rows.mapInArrow(part, "a long, b long").distinct()


def confirmed(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold on their full sets."""
    def part(batches):
        hashes, last, held = WordHashes(), None, None
        for batch in batches:
            ok = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2),
                               batch.column(3), strict=True):
                text = y.as_py()
                if (b, text) != last:     # pairs of one hub come together
                    last = b, text
                    held = shingles(text.lower().split(), hashes)
                other = shingles(x.as_py().lower().split(), hashes)
                ok.append(alike(held, other, percent))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    side = lambda c: found.select(F.col("id").alias(c),     # noqa: E731
                                  F.col("text").alias(f"t{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return (rows.select("a", "b", "ta", "tb").mapInArrow(
        part, "a long, b long").distinct())


def blocked(rows: DataFrame) -> DataFrame:
    """Rows of a bucket dealt into blocks of about BLOCK rows; each pair of
    blocks (i, j) holds the rows of both."""
    return (rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK)
                            .cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))
                        .cast("int"))
            .withColumn("other", F.explode(F.sequence(
                F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("own", "other"))
            .withColumn("j", F.greatest("own", "other"))
            .withColumn("second", F.col("own") > F.col("other"))
            .drop("blocks", "own", "other", "size"))


def open_pairs(t: pa.Table, percent: int, bands: int):
    """Row numbers (x, y) of the pairs of a sorted table of blocks that may
    link two components, a slice at a time. A pair counts in the first band
    that it shares, so in one bucket only."""
    key, i, j = (t[c].to_numpy() for c in ("key", "i", "j"))
    comp, n, band = (t[c].to_numpy() for c in ("component", "n", "band"))
    second = t["second"].to_numpy()
    sketch = matrix(t["sketch"].combine_chunks())
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(key))
    # each row meets the rows after it in its group
    later = np.repeat(end, end - first) - np.arange(len(key)) - 1
    sums = np.cumsum(later)
    at = 0
    while at < len(key):
        stop = int(np.searchsorted(sums, (sums[at - 1] if at else 0)
                                   + 20_000)) + 1
        stop = min(stop, len(key))
        some = later[at:stop]
        x = np.repeat(np.arange(at, stop), some)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
        at = stop
        # two blocks meet across only; a block alone meets itself
        keep = (comp[x] != comp[y]) & ((i[x] == j[x])
                                       | (second[x] != second[y]))
        x, y = x[keep], y[keep]
        same = (sketch[x] == sketch[y]).reshape(
            len(x), bands, sketch.shape[1] // bands).all(2)
        keep = same.argmax(1) == band[x]
        x, y = x[keep], y[keep]
        ok = promising(sketch[x], sketch[y], n[x], n[y], percent)
        yield x[ok], y[ok]


def block_links(rows: DataFrame, found: DataFrame, percent: int, bands: int
                ) -> DataFrame:
    """Confirmed links (a, b) between components that share a bucket.

    rows: key, band, id, component, size of the bucket, n, sketch. Rows that
    no estimate speaks for leave first; the others are compared on their full
    sets inside their block, where pairs that other links already connect are
    passed over. A block returns fewer links than it has rows, whatever
    number of pairs it had to look at.
    """
    place = ["key", "i", "j"]
    names = [*place, "band", "second", "id", "component", "n", "sketch"]

    def involved(batches):
        for t in runs(batches, place):
            used = np.zeros(t.num_rows, bool)
            for x, y in open_pairs(t, percent, bands):
                used[x] = used[y] = True
            yield from t.filter(pa.array(used)).to_batches()

    def links(batches):
        hashes = WordHashes()
        for t in runs(batches, place):
            ids, comp = t["id"].to_numpy(), t["component"].to_numpy()
            key, i, j = (t[c].to_numpy() for c in place)
            sets, out = {}, []
            parent: dict[tuple, tuple] = {}

            def root(node, parent=parent):
                while parent.setdefault(node, node) != node:
                    parent[node] = parent[parent[node]]
                    node = parent[node]
                return node

            def shingled(r, sets=sets, t=t):
                if r not in sets:
                    sets[r] = shingles(t["text"][r].as_py().lower().split(),
                                       hashes)
                return sets[r]

            for xs, ys in open_pairs(t, percent, bands):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    block = (key[x], i[x], j[x])
                    u, v = root((*block, comp[x])), root((*block, comp[y]))
                    if u != v and alike(shingled(x), shingled(y), percent):
                        parent[u] = v
                        out.append((int(ids[x]), int(ids[y])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()),
                 pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    def sorted_blocks(df):
        return df.repartition(*place).sortWithinPartitions(*place)

    kept = blocked(rows).select(*names)
    kept = sorted_blocks(kept).mapInArrow(involved, kept.schema)
    whole = kept.join(found, "id").select(*names, "text")
    return sorted_blocks(whole).mapInArrow(links, "a long, b long").distinct()


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x and y| >= percent * |x or y|; sorted distinct x, y."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[at] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def near_groups(docs: DataFrame, percent: int = 85, bands: int = BANDS,
                rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row."""
    base = stored(sketched(docs, bands, rows), "sketches")
    usable = base.filter("doc_id IS NOT NULL AND n > 0")
    nodes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("id")),
                   "heads")
    base = stored(base.join(nodes, "digest", "left"), "sets")
    nodes = (base.filter("doc_id = id").select("id", "n", "sketch", "keys")
             .dropDuplicates(["id", "n", "sketch"]))
    member = nodes.select("id", F.posexplode("keys").alias("band", "key"))
    # aggregates are stored before they are joined: a join of two plain
    # exchanges is one whose hot partitions Spark splits
    sizes = stored(member.groupBy("key").agg(F.count("*").alias("size"))
                   .filter("size > 1"), "sizes")
    member = stored(member.join(sizes, "key"), "members")
    company = member.groupBy("id").agg(F.sum("size").alias("company"))
    hubs = stored(member.join(company, "id").groupBy("key").agg(
        F.max_by("id", F.struct("company", -F.col("id"))).alias("b")), "hubs")
    pairs = (member.join(hubs, "key").select(F.col("id").alias("a"), "b")
             .filter("a <> b").distinct())
    involved = company.select("id")
    nodes = stored(nodes.select("id", "n", "sketch").join(
        involved, "id", "left_semi"), "nodes")
    found = stored(byte_texts(docs).withColumnRenamed("doc_id", "id").join(
        involved, "id", "left_semi"), "candidates")
    links = stored(confirmed(estimated(pairs, nodes, percent), found, percent),
                   "links")
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = stored(components(edges), "labels")

    rest = (member.join(label, "id", "left").withColumn(
        "component", F.coalesce("component", "id")))
    mixed_keys = stored(rest.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"))
        .filter("x < y").select("key"), "open")
    rest = rest.join(mixed_keys, "key").join(nodes, "id")
    more = stored(block_links(rest, found, percent, bands), "links")
    label = components(edges.unionByName(more.select(
        F.col("a").alias("u"), F.col("b").alias("v"))))
    # equal sets follow their representative
    own = F.coalesce("component", "id", "doc_id")
    return (base.select("doc_id", "n", "id").join(label, "id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), own)
                    .alias("component_id"))
            .withColumn("kept", F.coalesce(
                F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one document of each near-duplicate group, columns kept."""
    gone = (near_groups(docs, percent).groupBy("doc_id")
            .agg(F.max("kept").alias("kept")).filter("NOT kept")
            .select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"),
                     "left_anti")


@query("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))
