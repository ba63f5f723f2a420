"""Secret scans: fixed patterns, and Markov models for strings they miss.

Three patterns give the base spans of a text (leftmost, non-overlapping per
kind; matches below the least length are dropped after matching). In addition
every run of CANDIDATE or more token characters that meets no base span is
scored by two first-order character Markov models, one of random strings and
one of ordinary identifiers; a log-likelihood ratio of at least
``THRESHOLD`` nats (and RATE per character) makes it a span of kind
``random``.

Both models are trained here on labelled strings from a bounded sample of
TRAIN_DOCS expected documents, chosen by a hash of the text: values of base
spans and seeded random draws are random, other tokens of six or more
characters are ordinary. Only their transition counts (at most
2 * STATES ** 2 rows) reach the driver.

Defined cases: null text is the empty text; empty texts have no spans and the
digest of the empty string; offsets are code points over the whole text, end
exclusive; rows are judged one by one, so repeated rows and null ids come
back as they are; other columns are ignored.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .registry import query, table

KINDS = ("assign", "access", "hex", "random")
TOKEN = "A-Za-z0-9+/_=-"
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
                    r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# a run of token characters that could hold a key, hex digits or a candidate;
# the other two base patterns lie inside such runs
RUN = re.compile(rf"(?<![{TOKEN}])[{TOKEN}]{{16,}}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}")
WORD = re.compile(rf"[{TOKEN}]{{6,}}")

TRAIN_DOCS, DRAWS = 4000, 3000
CANDIDATE, THRESHOLD, RATE, SMOOTH = 20, 12.0, 0.5, 0.5
ALPHABET = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
            "+/_=-.")
STATES = len(ALPHABET) + 1
_STATE = np.zeros(128, np.int64)
_STATE[[ord(c) for c in ALPHABET]] = np.arange(1, STATES)
PLACEHOLDER = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for run in RUN.finditer(text):
        a, b = run.span()
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)
                if m.end() - m.start() >= ACCESS_LEAST]
        if b - a >= HEX_LEAST:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(out)


def pairs(text: str) -> np.ndarray:
    """Transitions of a token, the first from the start state 0."""
    states = _STATE[np.frombuffer(text.encode("ascii"), np.uint8)]
    return np.concatenate([[0], states[:-1]]) * STATES + states


def random_draws() -> list[str]:
    """Seeded strings of the usual key alphabets."""
    draw = np.random.Generator(np.random.PCG64(17))
    sets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64],
            ALPHABET[26:62], ALPHABET[:26] + "0123456789")
    return ["".join(draw.choice(list(sets[i % len(sets)]),
                                draw.integers(20, 65)))
            for i in range(DRAWS)]


class Markov:
    """Log-likelihood ratio of random against ordinary, per transition."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        def logs(n):
            n = n.reshape(STATES, STATES) + SMOOTH
            return np.log(n / n.sum(1, keepdims=True))
        self.ratio = (logs(random) - logs(ordinary)).ravel()

    def of(self, token: str) -> float:
        return float(self.ratio[pairs(token)].sum())

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and those that the models add, by start and kind."""
        base = base_spans(text)
        added = []
        for run in RUN.finditer(text):
            a, b = run.span()
            if b - a < CANDIDATE or any(x < b and a < y for x, _, y in base):
                continue
            if self.of(text[a:b]) >= max(THRESHOLD, RATE * (b - a)):
                added.append((a, 3, b))
        return sorted(base + added)


def labelled_counts(docs: DataFrame) -> DataFrame:
    """(random, pair, n): transition counts of the labelled strings."""
    def part(batches):
        seen = Counter()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py()
                base = base_spans(text)
                found = [(1, text[a:b]) for a, k, b in base if k]
                found += [(1, m[2]) for m in ASSIGN.finditer(text)
                          if len(m[2]) >= CANDIDATE]
                found += [(0, m[0]) for m in WORD.finditer(text)
                          if not any(a < m.end() and m.start() < b
                                     for a, _, b in base)]
                for label, token in found:
                    for p in pairs(token).tolist():
                        seen[label, p] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.int64()),
             pa.array([k[1] for k in seen], pa.int64()),
             pa.array(list(seen.values()), pa.int64())],
            names=["random", "pair", "n"])

    return (docs.select("text").mapInArrow(part, "random long, pair long, "
                                                 "n long")
            .groupBy("random", "pair").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Markov:
    known = texts(docs)
    share = min(1.0, rows / max(1, docs.count()))
    draw = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 30))
    counts = np.zeros((2, STATES * STATES))
    for r in labelled_counts(known.filter(draw < share * (1 << 30))).collect():
        counts[r["random"], r["pair"]] = r["n"]
    for token in random_draws():
        np.add.at(counts[1], pairs(token), 1)
    return Markov(counts[1], counts[0])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """doc_id and found: an array of (kind, start, end), by start and kind."""
    model = model or train(docs)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(text: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b}
                           for a, k, b in model.spans(t)] for t in text])

    return texts(docs).select("doc_id", scan("text").alias("found"))


def redacted(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """docs with every span replaced; n_chars follows where a text changed."""
    model = model or train(docs)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None else cut(t, model.spans(t)))

    names, kind = docs.columns, docs.schema["n_chars"].dataType
    changed = ~F.col("text").eqNullSafe(F.col("_text"))
    # nothing but the cleaned text is computed in Python
    rows = docs.withColumnRenamed("text", "_text").withColumn(
        "text", clean("_text"))
    return rows.withColumn("n_chars", F.when(
        changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    ).select(*names)


def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans are replaced together."""
    out, last = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[last:a], PLACEHOLDER]
        last = b
    return "".join([*out, text[last:]])


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    found = secrets(table(spark, sf_dir, "documents"))
    text = F.transform("found", lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter(text, lambda s: ~s.startswith("random:"))
    count = lambda k: F.size(F.filter(                      # noqa: E731
        text, lambda s: s.startswith(k + ":"))).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.concat_ws(",", base).cast("binary"), 256)
        .alias("base_sha256"), F.concat_ws(",", text).alias("spans"))
