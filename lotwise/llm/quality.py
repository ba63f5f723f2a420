"""Document quality by a factorisation machine.

A document's features are its hashed words (each present bucket, scaled to
unit length), structure statistics and one metadata value (n_chars), the last
two cut into quantile bins of the training sample. The score is the logistic
of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairwise term is
computed in linear time as half of ``|sum v_i x_i|^2 - sum |v_i x_i|^2``.

Labels come from rows whose crc32(doc_id) mod 3 is not 1. The machine is
fitted on a bounded sample of them, TRAIN_ROWS expected rows chosen by a hash
of the doc_id, whose features (not texts) come to the driver. Language,
source, doc_id and labels are no features.

Defined cases: null and empty texts are scored by their (empty) structure;
a null n_chars is a bin of its own; a doc_id with contradicting labels is not
learnt from; without usable labels every score is 0.5; every row is scored on
its own, repeated or not, with or without doc_id; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, held_out
from .registry import query, table

TRAIN_ROWS = 12_000
BUCKETS, RANK, BINS = 4096, 8, 12
STEPS, BATCH, RATE, DECAY = 600, 128, 0.02, 1e-5
STATS = ("words", "length", "upper", "digit", "symbol", "other", "distinct",
         "top", "adjacent", "lines", "line_words", "edge", "n_chars")

_KIND = np.zeros(256, np.int64)        # other
_KIND[[9, 10, 11, 12, 13, 32]] = 1     # space
_KIND[65:91] = 2                       # upper
_KIND[97:123] = 3                      # lower
_KIND[48:58] = 4                       # digit
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_SYMBOL = frozenset(i for i in range(33, 127) if not chr(i).isalnum()) - {
    *b".,;:!?'\"()-"}


def features(text: bytes, n_chars, hashes: WordHashes
             ) -> tuple[np.ndarray, np.ndarray]:
    """Present word buckets, and the structure statistics in STATS' order."""
    words = text.split()
    found, counts = np.unique(hashes.of(words), return_counts=True)
    n, size = len(words), max(1, len(text))
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    letters = max(1, int(kinds[2] + kinds[3] + kinds[0]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    stats = np.array([
        np.log1p(n), (len(text) - kinds[1]) / max(1, n), kinds[2] / letters,
        kinds[4] / size, kinds[5] / size, kinds[0] / size,
        len(found) / np.sqrt(max(1, n)), counts.max() / n if n else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        sum(w[-1] in _SYMBOL for w in words) / max(1, n),
        np.nan if n_chars is None or n_chars != n_chars
        else np.log1p(max(0.0, float(n_chars)))])
    return np.unique(found % np.uint64(BUCKETS)).astype(np.int32), stats


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    edges: np.ndarray        # of the bins of each statistic

    def rows(self, found: list[tuple[np.ndarray, np.ndarray]]):
        """Feature numbers, values and row starts of a batch."""
        stats = np.stack([s for _, s in found])
        bins = np.stack([np.where(np.isnan(stats[:, i]), len(e) + 1,
                                  np.searchsorted(e, stats[:, i], "right"))
                         for i, e in enumerate(self.edges)], 1)
        bins += BUCKETS + np.arange(len(self.edges)) * (BINS + 1)
        index = [np.concatenate([w, b]) for (w, _), b in zip(found, bins,
                                                             strict=True)]
        value = [np.concatenate([np.full(len(w), len(w) ** -0.5 if len(w)
                                         else 0.0), np.full(bins.shape[1],
                                         bins.shape[1] ** -0.5)])
                 for w, _ in found]
        starts = np.cumsum([0, *map(len, index)])[:-1]
        return np.concatenate(index), np.concatenate(value), starts

    def logit(self, index, value, starts) -> np.ndarray:
        total = np.add.reduceat(self.factor[index] * value[:, None], starts)
        square = np.add.reduceat((self.factor[index] * value[:, None]) ** 2,
                                 starts)
        return (self.bias + np.add.reduceat(self.weight[index] * value, starts)
                + 0.5 * (total ** 2 - square).sum(1))

    def score(self, found) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(*self.rows(found)), -35, 35)))


def fit(found: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray
        ) -> Machine:
    """Adam on the log loss, seeded; row order must be deterministic."""
    draw = np.random.Generator(np.random.PCG64(11))
    size = BUCKETS + len(STATS) * (BINS + 1)
    share = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.zeros((len(STATS), BINS - 1))
    if len(found):
        stats = np.stack([s for _, s in found])
        for i in range(len(STATS)):
            known = stats[:, i][~np.isnan(stats[:, i])]
            if len(known):
                edges[i] = np.quantile(known, share)
    made = Machine(0.0, np.zeros(size), draw.normal(0, 0.02, (size, RANK)),
                   edges)
    if len(np.unique(label)) < 2:
        if len(label):
            made.bias = 4.0 if label[0] else -4.0
        made.factor[:] = 0
        return made
    made.bias = float(np.log(label.mean() / (1 - label.mean())))
    params = {"weight": made.weight, "factor": made.factor}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    while step < STEPS:
        order = draw.permutation(len(found))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            index, value, starts = made.rows([found[i] for i in some])
            miss = (1 / (1 + np.exp(-np.clip(made.logit(index, value, starts),
                                             -35, 35))) - label[some])
            each = np.repeat(miss / len(some), np.diff(
                np.append(starts, len(index)))) * value
            v = made.factor[index]
            total = np.add.reduceat(v * value[:, None], starts)
            total = np.repeat(total, np.diff(np.append(starts, len(index))), 0)
            grad = {"weight": np.bincount(index, each, size),
                    "factor": np.stack([np.bincount(
                        index, each * (total[:, f] - v[:, f] * value), size)
                        for f in range(RANK)], 1)}
            rate = RATE * max(0.0, 1 - step / STEPS)
            made.bias -= rate * float(miss.mean())
            step += 1
            for k, p in params.items():
                g = grad[k] + DECAY * p
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p -= (rate * first[k] / (1 - 0.9 ** step)
                      / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8))
    return made


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS
          ) -> Machine:
    """A machine fitted on about `rows` labelled documents."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality")
             .filter(F.col("id").isNotNull() & F.col("quality").isin(0, 1)
                     & ~held_out(F.col("id")))
             .groupBy("id").agg(F.min("quality").alias("label"),
                                F.max("quality").alias("most"))
             .filter("label = most").drop("most"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
                          < share * (1 << 30))

    def part(batches):
        hashes = WordHashes()
        for b in batches:
            made = [features(t.as_py(), n, hashes) for t, n in zip(
                b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([w.tobytes() for w, _ in made], pa.binary()),
                 pa.array([s.tobytes() for _, s in made], pa.binary())],
                names=["id", "label", "words", "stats"])

    # about `rows` ids of 12 bytes, by the sampling above
    found = (docs.select(F.col("doc_id").cast("long").alias("id"),
                         F.coalesce("text", F.lit("")).cast("binary")
                         .alias("text"), F.col("n_chars").cast("double")
                         .alias("n_chars"))
             .join(F.broadcast(chosen), "id")
             .select("id", "label", "text", "n_chars")
             .mapInArrow(part, "id long, label int, words binary, stats binary")
             .toPandas().sort_values(["id", "stats", "words"]))
    return fit([(np.frombuffer(w, np.int32), np.frombuffer(s))
                for w, s in zip(found["words"], found["stats"], strict=True)],
               found["label"].to_numpy(float))


def score(machine: Machine, text: Column, n_chars: Column) -> Column:
    """The machine's score of whole texts, 0 to 1."""
    @F.pandas_udf("double")
    def scored(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        hashes, out = WordHashes(), []
        for a in range(0, len(text), 500):
            out.append(machine.score([
                features(bytes(t), n, hashes) for t, n in zip(
                    text.iloc[a:a + 500], n_chars.iloc[a:a + 500],
                    strict=True)]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return scored(F.coalesce(text, F.lit("")).cast("binary"),
                  n_chars.cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row."""
    machine = train(docs, labels)
    return docs.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id").cast("long")),
                             F.lit(False)).alias("held_out"),
        score(machine, F.col("text"), F.col("n_chars")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier scores 0.5 or more, columns kept."""
    machine = train(docs, labels)
    return docs.filter(score(machine, F.col("text"), F.col("n_chars")) >= 0.5)


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"),
                          table(spark, sf_dir, "labels"))
