"""Decontamination, Merkle manifest, importance resampling."""
import zlib
from collections import Counter

import brute
import pytest
from conftest import COLUMNS
from pyspark.sql import functions as F

from lotwise.llm import decontamination as dc
from lotwise.llm import merkle, resampling
from lotwise.llm.registry import QUERIES, table

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, LONG), (2, "short Item"), (3, None), (4, " .,; "), (7, LONG),
            (5, "naïve漢字"), (None, "nameless words here"), (2, "again x2"),
            (6, "absent phrase nobody wrote"), (10, "a a a a a a a a a a a")]
    return rows, spark.createDataFrame(rows, "item_id long, text string") \
        .withColumn("term", F.lit("x")).withColumn("doc_id", F.lit(1))


def leaky(odd_rows):
    part = " ".join(LONG.split()[1:11])
    return odd_rows + [
        (20, f"x {LONG.upper()} y {LONG}"), (21, part.replace(" ", "-\n")),
        (22, " ".join(LONG.split()[:9])), (23, "a " * 25),
        (24, "SHORT item short ITEM"), (25, "again x2"), (26, "un naïve漢字"),
        (27, "nameless  words/here"), (None, part), (20, "short item"),
        (20, "short item"), (28, "beta alpha gamma"), (29, "again. X2!")]


def test_leaks(frame, odd_rows, items):
    docs = leaky(odd_rows)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"])
           for r in dc.decontaminated(frame(docs), items[1]).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])        # noqa: E731
    assert sorted(got, key=key) == sorted(brute.leaks(docs, items[0]),
                                          key=key)


@pytest.mark.parametrize("name,value", [("BROADCAST_ROWS", 0), ("BUCKETS", 1)])
def test_leaks_without_broadcasts(frame, odd_rows, items, name, value,
                                  monkeypatch):
    from lotwise.llm import common
    if name == "BUCKETS":
        monkeypatch.setattr(dc, name, value)
    else:
        monkeypatch.setattr(dc, "beside", lambda t: common.beside(t, value))
    docs = leaky(odd_rows)
    got = dc.decontaminated(frame(docs), items[1], 3).collect()
    assert Counter((r["doc_id"], r["n_hit"], tuple(r["items"]))
                   for r in got) == Counter(
        (i, h, tuple(k)) for i, _, h, k in brute.leaks(docs, items[0], 3))


def test_spans_are_whole_phrases(frame, items):
    docs = frame([(1, f"x {LONG} y"), (2, "beta")])
    spans = dc.Index.build(docs, items[1]).phrases(10).spans().collect()
    assert {tuple(r) for r in spans} == {
        (1, i, s, s + 10) for i in (1, 7) for s in (1, 2, 3)}


def test_leaks_of_nothing(frame, items):
    none = frame([(1, "x")]).limit(0)
    assert dc.decontaminated(none, items[1]).count() == 0
    left = dc.decontaminated(frame([(1, "x y")]), items[1].limit(0)).collect()
    assert [tuple(r) for r in left] == [(1, 2, 0, [])]


def test_proximity(frame, spark):
    items = [(1, "red green blue"), (2, "solo"), (3, "red missing"), (4, None)]
    docs = [(1, "red x green x x blue x x red"), (2, "blue red x x x x green"),
            (3, "solo x solo"), (4, None), (5, "red green"), (6, "green x")]
    index = dc.Index.build(frame(docs), spark.createDataFrame(
        items, "item_id long, text string"))
    for terms, span in [(3, 6), (3, 7), (9, 4)]:
        got = index.proximity(terms, span).collect()
        assert {tuple(r) for r in got} == brute.near_items(
            docs, items, terms, span)
        assert len(got) == len({tuple(r) for r in got})


def test_leaks_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select(
        "doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {r["doc_id"]: r for r in
           QUERIES["op11_decontamination"](spark, sf_dir).collect()}
    want = brute.leaks(docs, items)
    assert len(got) == len(want) and any(h for _, _, h, _ in want)
    for i, n, h, found in want:
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (
            n, h, len(found), h > 0)
        assert r["items_sha256"] == brute.sha(",".join(found).encode())


def third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def merkle_rows(spark, rows, fanout=8):
    df = spark.createDataFrame(rows, "doc_id long, source string, "
                               "lang string, n_chars long, text string")
    for c in ("key", "idx", "n", "node", "path", "root", "tie", "leaf"):
        df = df.withColumn(c, F.lit("x"))
    low = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
                 == 0, merkle.lowered(F.col("text")))
    return merkle.manifest(df, fanout=fanout, changed=F.when(
        F.col("text").isNotNull(), low)).select(
            "doc_id", "leaf", "subroot", "root",
            merkle.hashed(merkle.siblings(F.col("path"))).alias("proof"),
            merkle.folded(F.coalesce("other", "leaf"), F.col("path"))
            .alias("folded")).collect()


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest(spark, odd_rows, fanout):
    rows = [(i, None if k % 4 == 0 else f"s{k}", [None, "en", "de", ""][k % 4],
             None if t is None else len(t), t)
            for k, (i, t) in enumerate(odd_rows)]
    rows += [(100 + k, "hot", "en", k, f"Text {k % 5}") for k in range(150)]
    rows += [(900, "s", "one", 1, "A"), (901, "s", "é", None, None)]
    got = Counter(tuple(r) for r in merkle_rows(spark, rows, fanout))
    assert got == Counter(brute.manifest(rows, third, fanout))
    assert any(r[3] != r[5] for r in got) and any(r[3] == r[5] for r in got)


def test_small_manifests(spark):
    one = [(3, "s", "en", 1, "Ab")]
    two = [*one, (4, None, None, None, None)]
    for rows in (one, two, [*two, *two, *two]):
        assert Counter(tuple(r) for r in merkle_rows(spark, rows)) == Counter(
            brute.manifest(rows, third))
    empty = spark.createDataFrame([], COLUMNS).select(*merkle.FIELDS)
    assert merkle.manifest(empty).count() == 0


@pytest.mark.parametrize("longest,head", [(1, 20_000), (1, 2), (2, 3),
                                          (3, 100)])
def test_resampling(frame, odd_rows, spark, longest, head):
    seen, docs = set(), []
    for i, t in [*odd_rows, *((50 + k, " ".join(
            f"w{(k * j) % 37}" for j in range(15 + k))) for k in range(60)),
            (200, "Tie one. " * 30), (201, "tie-ONE " * 30)]:
        if i not in seen:
            docs.append((i, t))
            seen.add(i)
    target = ["w1 w2 tie", None, "", "w3 W3 w4 one two", "é naïve"]
    frames = frame(docs), spark.createDataFrame(
        [(t,) for t in target], "text string")
    got = resampling.resampled(*frames, percent=30, least_words=20,
                               buckets=101, longest=longest, head_size=head)
    key = lambda r: (r[0] is None, r[0] or 0)               # noqa: E731
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(
        brute.resampled(docs, target, 30, 20, 101, longest), key=key)


def test_resampling_of_repeated_rows_and_nothing(frame, spark):
    target = spark.createDataFrame([("a b",)], "text string")
    rows = [(1, "a b " * 20)] * 50 + [(None, "c " * 30)] * 50
    got = resampling.resampled(frame(rows), target, percent=50).collect()
    assert len(got) == 100
    ranks = [r["rank"] for r in got if r["rank"]]
    assert sorted(ranks) == list(range(1, 51))
    none = frame(rows).limit(0)
    assert resampling.resampled(none, target).count() == 0
    left = resampling.resampled(frame(rows), target.limit(0))
    assert left.filter("weight IS NULL").count() == 0


def test_head_holds_every_frequent_run(frame):
    docs = [(i, "hot " * 50 + f"cold{i} x{i} hot warm " * 3) for i in range(40)]
    words = {w for w, in resampling.frequent(frame(docs), 4, 1)}
    assert "hot".encode() in words and len(words) <= 4
    assert (b"hot", b"hot") in resampling.frequent(frame(docs), 4, 2)
