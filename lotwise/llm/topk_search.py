"""Exact top-k inner products over a pivot-distance index.

Vectors become integers floor(256 * x). Each is keyed by its nearest pivot and
its distance to it; distances fall into rings, so a cell (pivot, ring) is an
annulus. From a cell's least and largest distance and its largest norm follow
upper bounds of every inner product in it: with the triangle inequality
``d(q, x) >= |d(q, p) - d(x, p)|`` and ``q.x = (|q|^2 + |x|^2 - d^2) / 2``, and
``q.x <= q.p + |q| d(x, p)``.

1. Pivots (farthest first) and ring edges come from a bounded sample of
   SAMPLE expected rows; they steer work only. Every vector is indexed.
2. Queries, in blocks, visit the cells of their best bounds: the k-th score
   found is a floor.
3. They then visit all cells whose bound reaches their floor; all others are
   proven to hold nothing better. The result is exact: recall is 1.

Cells number PIVOTS * RINGS, so their statistics are a bounded table. A cell
of any size is held in packs of about PACK vectors, queries in blocks of about
BLOCK; a hot cell (equal vectors) is many packs, and no task holds more than
one pack and one block. Per pack and query k rows leave a task.

Defined cases: null vectors and those with null or non-finite components take
no part, nor do rows without vec_id; a row repeated with its vec_id counts
once, and rows of the query's vec_id are never its candidates; vectors of
different lengths are compared as if padded with zeros; components are exact up to
2^53 after scaling and clipped there, scores must fit 64 bits; ties go to the smaller vec_id; other columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .registry import query, table

SCALE = 256
#: Largest whole number up to which doubles hold all.
LARGEST = 2.0 ** 53
SAMPLE, PIVOTS, RINGS = 4096, 16, 8
PACK, BLOCK = 4096, 512


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and whole-number components of the vectors that take part."""
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)
                       | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(
        F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(
            x.cast("double") * SCALE).cast("double"))).cast("long"))
    return (vectors.filter(F.col("embedding").isNotNull()
                           & F.col("vec_id").isNotNull() & usable)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    whole.alias("x")).distinct())


def dense(lists, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


class Pivots:
    """Pivots and ring edges of a sample."""

    def __init__(self, sample: np.ndarray, pivots: int, rings: int):
        n = len(sample)
        chosen = [0] if n else []
        far = np.full(n, np.inf)
        while len(chosen) < min(pivots, n):
            far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
            if far.max() == 0:
                break
            chosen.append(int(far.argmax()))
        self.at = sample[chosen] if n else np.zeros((1, sample.shape[1]))
        self.rings = rings
        near, dist = self.nearest(sample)
        share = np.linspace(0, 1, rings + 1)[1:-1]
        self.edges = np.stack([
            np.quantile(dist[near == p], share) if (near == p).any()
            else np.zeros(rings - 1) for p in range(len(self.at))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = ((x ** 2).sum(1)[:, None] + (self.at ** 2).sum(1)
                  - 2 * x @ self.at.T)
        return np.sqrt(np.maximum(square, 0))

    def nearest(self, x: np.ndarray):
        d = self.distances(x)
        near = d.argmin(1)
        return near, d[np.arange(len(x)), near]

    def cells(self, x: np.ndarray):
        """Cell number and pivot distance of each vector."""
        near, dist = self.nearest(x)
        ring = (dist[:, None] >= self.edges[near]).sum(1)
        return near * self.rings + ring, dist


def bounds(q: np.ndarray, pivots: Pivots, cells: dict[str, np.ndarray]
           ) -> np.ndarray:
    """Upper bound of the inner product of each query with each cell."""
    p = cells["cell"] // pivots.rings
    d = pivots.distances(q)[:, p]
    norm = (q ** 2).sum(1)[:, None]
    gap = np.maximum(0, np.maximum(d - cells["most"], cells["least"] - d))
    annulus = (norm + cells["norm"] ** 2 - gap ** 2) / 2
    ball = (q @ pivots.at.T)[:, p] + np.sqrt(norm) * cells["most"]
    best = np.minimum(np.minimum(annulus, ball), np.sqrt(norm) * cells["norm"])
    # what rounding may take away is given back
    return best + 1e-9 * (norm + cells["norm"] ** 2) + 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
            * max(1, q.shape[1]))
    if most < 2.0 ** 53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best_of(pairs: DataFrame, packs: DataFrame, k: int, width: int
            ) -> DataFrame:
    """(query_id, vec_id, score): k best of each query and pack.

    pairs: cell, ids and vectors of a block of queries; packs: cell, xids, xs.
    """
    def part(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.asarray(batch.column(0)[i].as_py(), np.int64)
                q = dense(batch.column(1)[i].as_py(), width)
                xids = np.asarray(batch.column(2)[i].as_py(), np.int64)
                order = np.argsort(xids, kind="stable")
                x = dense(batch.column(3)[i].as_py(), width)[order]
                xids = xids[order]
                found = products(q, x)
                own = ids[:, None] == xids
                found[own] = np.iinfo(np.int64).min + 1     # last when negated
                # equal scores stay in the order of ids
                top = np.argsort(-found, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(ids)), top.shape[1])
                col = top.ravel()
                keep = ~own[row, col]
                row, col = row[keep], col[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(xids[col]),
                     pa.array(found[row, col])],
                    names=["query_id", "vec_id", "score"])

    rows = pairs.join(packs, "cell").select("ids", "qs", "xids", "xs")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.mapInArrow(part, "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))


def packed(rows: DataFrame, by: str, counts: list, size: int, names
           ) -> DataFrame:
    """Rows of a key in packs of about `size`: key, ids, vectors.

    counts: (key, n) rows; their number is bounded by the cells.
    """
    spark = rows.sparkSession
    parts = spark.createDataFrame(
        [(int(c), -(-int(n) // size)) for c, n in counts],
        f"{by} int, parts int")
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return (rows.join(F.broadcast(parts), by)
            .groupBy(by, chunk.alias("chunk"))
            .agg(F.collect_list(F.struct("vec_id", "x")).alias("all"))
            .select(by, "chunk", F.col("all.vec_id").alias(names[0]),
                    F.col("all.x").alias(names[1])))


def top_k(vectors: DataFrame, is_query, k: int = 5, sample: int = SAMPLE,
          pivots: int = PIVOTS, rings: int = RINGS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query.

    is_query: a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = stored(integers(vectors), "integers")
    about = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    width = about[1] or 0
    share = min(1.0, sample / max(1, about[0]))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(21)), F.lit(1 << 30))
                        < share * (1 << 30)).orderBy("vec_id").toPandas()
    index = Pivots(dense(list(drawn["x"]), width), pivots, rings)

    def key(batches):
        for batch in batches:
            x = dense(batch.column(1).to_pylist(), width)
            cell, dist = index.cells(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(dist),
                 pa.array(np.sqrt((x ** 2).sum(1)))],
                names=["vec_id", "x", "cell", "dist", "norm"])

    keyed = stored(rows.mapInArrow(
        key, "vec_id long, x array<long>, cell int, dist double, norm double"),
        "index")
    # at most pivots * rings rows
    stats = keyed.groupBy("cell").agg(
        F.min("dist").alias("least"), F.max("dist").alias("most"),
        F.max("norm").alias("norm"), F.count("*").alias("n"),
        F.count_if(is_query).alias("queries")).orderBy("cell").toPandas()
    cells = {c: stats[c].to_numpy() for c in ("cell", "least", "most", "norm")}
    packs = stored(packed(keyed.select("cell", "vec_id", "x"), "cell",
                          list(zip(stats["cell"], stats["n"], strict=True)),
                          PACK, ("xids", "xs")).drop("chunk"), "packs")
    asked = keyed.filter(is_query).select("cell", "vec_id", "x")
    blocks = stored(packed(asked, "cell", list(zip(
        stats["cell"], stats["queries"].clip(lower=1), strict=True)), BLOCK,
        ("ids", "qs")).withColumnRenamed("cell", "home"), "queries")

    def visits(batches, floors):
        """A block of queries once for each cell it has to visit."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].as_py()
                q = batch.column(1)[i].as_py()
                best = bounds(dense(q, width), index, cells)
                if floors:
                    floor = np.array([-np.inf if f is None else f
                                      for f in batch.column(2)[i].as_py()])
                    reach = (best >= floor[:, None]).any(0)
                    chosen = cells["cell"][reach]
                else:
                    chosen = cells["cell"][np.unique(best.argmax(1))]
                n = len(chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen, pa.int32()),
                     pa.array([ids] * n, pa.list_(pa.int64())),
                     pa.array([q] * n, pa.list_(pa.list_(pa.int64())))],
                    names=["cell", "ids", "qs"])

    form = "cell int, ids array<long>, qs array<array<long>>"
    first = best_of(blocks.select("ids", "qs").mapInArrow(
        lambda b: visits(b, False), form), packs, k, width)
    floor = (first.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("score").alias("floor"))
        .filter(F.col("n") == k).select("query_id", "floor"))
    each = blocks.select("home", "chunk", F.explode(
        F.arrays_zip("ids", "qs")).alias("one")).select(
        "home", "chunk", F.col("one.ids").alias("query_id"),
        F.col("one.qs").alias("x"))
    again = (each.join(floor, "query_id", "left").groupBy("home", "chunk")
             .agg(F.collect_list(F.struct("query_id", "x", "floor"))
                  .alias("all"))
             .select(F.col("all.query_id").alias("ids"),
                     F.col("all.x").alias("qs"),
                     F.col("all.floor").alias("floors")))
    pairs = stored(again.mapInArrow(lambda b: visits(b, True), form), "visits")
    return best_of(pairs, packs, k, width).select(
        "query_id", "rank", "vec_id", "score")


@query("op7_topk_search", sql="""
    WITH v AS (
      SELECT vec_id, list_transform(embedding,
             lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(
             embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id
             ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM (SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0))
    WHERE rank <= 5""")
def op7_topk_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
