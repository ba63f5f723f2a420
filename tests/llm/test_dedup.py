"""Exact, near and substring dedup, packing, sharding."""
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest

from lotwise.llm import near_dedup, packing
from lotwise.llm.components import components
from lotwise.llm.exact_dedup import (
    COUNTERS,
    drop_copies,
    exact_dedup,
    summarise,
)
from lotwise.llm.near_dedup import drop_near_copies, near_groups
from lotwise.llm.packing import balanced, differencing, pack
from lotwise.llm.registry import table
from lotwise.llm.sharding import shard
from lotwise.llm.substring_dedup import repeated_passages

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, sf_dir):
    return [tuple(r) for r in table(spark, sf_dir, "documents").select(
        "doc_id", "text").collect()]


@pytest.mark.parametrize("k", [1, COUNTERS])
def test_exact(frame, odd_rows, k):
    got = [tuple(r) for r in exact_dedup(frame(odd_rows), k).collect()]
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[brute.flat(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best, left = min(known, default=None), True
        for i in ids:
            kept = left and i == best
            left = left and not kept
            want[i, best, len(ids), kept, brute.sha(text.encode())] += 1
    assert Counter(got) == want


def test_exact_keeps_rows_whole(frame, odd_rows):
    docs = frame(odd_rows)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    texts = [brute.flat(r["text"]) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len(
        {brute.flat(t) for _, t in odd_rows})


def test_summary_bound():
    draw = np.random.default_rng(1)
    true, kept, k = Counter(), {}, 10
    for _ in range(50):
        part = Counter(draw.zipf(1.3, 200).clip(max=500).tolist())
        true += part
        kept = summarise(kept, part, k)
        assert len(kept) <= k
    total = sum(true.values())
    for x, n in true.items():
        assert n - total / (k + 1) <= kept.get(x, 0) <= n


def test_passages(spark, sf_dir, frame, odd_rows):
    rows = docs_of(spark, sf_dir)
    got = repeated_passages(table(spark, sf_dir, "documents")).collect()
    want = brute.passages(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
            for r in got} == {i: v for (i, _), v in want.items()}
    assert any(r["n_removed"] for r in got)
    for r in got:
        assert r["n_removed"] == sum(b - a for a, b in r["spans"])
        assert all(x[1] < y[0] for x, y in zip(r["spans"], r["spans"][1:],
                                               strict=False))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"],
                   r["kept_sha256"])
                  for r in repeated_passages(frame(odd_rows)).collect())
    want = brute.passages(odd_rows)
    assert got == Counter((i, *want[i, t]) for i, t in odd_rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_near(spark, sf_dir, percent):
    rows = docs_of(spark, sf_dir)
    got = near_groups(table(spark, sf_dir, "documents"), percent).collect()
    want = brute.near(rows, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_odd(frame, odd_rows):
    got = near_groups(frame(odd_rows)).collect()
    known = {i: t for i, t in odd_rows if i is not None}
    want = brute.near(list(known.items()), 85)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"])
                   for r in got if r["doc_id"] is not None) == Counter(
        (i, *want[i]) for i, _ in odd_rows if i is not None)
    lost = [r for r in got if r["doc_id"] is None]
    assert len(lost) == 2 and all(
        r["kept"] and r["component_id"] is None for r in lost)
    docs = frame(odd_rows)
    assert drop_near_copies(docs).columns == docs.columns


def test_near_family_in_blocks(frame, monkeypatch):
    """Copies of copies: links hold between some members only."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    draw = np.random.default_rng(4)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in draw.choice(len(w), 3, replace=False):
            w[p] = f"new{i}-{p}"
        rows.append((100 - i, " ".join(w)))
        if i % 3 == 0:
            base = w
    got = near_groups(frame(rows)).collect()
    want = brute.near(rows, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 60


def test_sketches():
    """Merging is the larger register; the joint estimate is close."""
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 1 << 63, 4000, np.uint64) * 2 + 1
    maker = near_dedup.SetSketch(1024)
    x, y = pool[:2500], pool[1000:]
    a, b = maker.of(x), maker.of(y)
    assert (np.maximum(a, b) == maker.of(pool)).all()
    above, below = (a > b).sum(), (a < b).sum()
    equal = 1024 - above - below
    got = near_dedup.likely(np.array([2500.0]), np.array([3000.0]), above,
                            below, equal)[0]
    assert abs(got - 1500 / 4000) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)]
    got = components(spark.createDataFrame(chain, "u long, v long")).collect()
    found = {r["id"]: r["component"] for r in got}
    assert len(got) == len(found)
    assert {found[i] for i in [*range(41), 100]} == {0}
    assert found[201] == found[200] == 200


def test_packing(spark, sf_dir, frame, odd_rows):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(TOKENS)
    odd = [*odd_rows, (20, "<|endoftext|> IT'S 3.14€. Ḥamza <|StartOfText|>"),
           (21, "can't!'s don''t A̱ ẖ H̱. «x»,")]
    for docs in (table(spark, sf_dir, "documents"), frame(odd)):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        pieces = pack(docs, TOKENS).collect()
        fill, places = Counter(), defaultdict(list)
        for p in pieces:
            fill[p["sequence_id"]] += p["length"]
            places[p["sequence_id"]].append((p["offset"], p["length"]))
        assert max(fill.values()) <= 4096
        for some in places.values():
            at = 0
            for offset, length in sorted(some):
                assert offset == at
                at += length
        want = Counter()
        for i, t in texts:
            ids = np.array(model.encode(
                t or "", add_special_tokens=False).ids + [2], "<u4")
            want[i, len(ids)] += len(ids)
        got = Counter()
        for p in pieces:
            got[p["doc_id"], p["doc_tokens"]] += p["length"]
        assert got == want
        single = {i: t for i, t in texts if i is not None}
        for p in pieces:
            if p["doc_id"] in single and [i for i, _ in texts].count(
                    p["doc_id"]) == 1:
                ids = np.array(model.encode(
                    single[p["doc_id"]] or "",
                    add_special_tokens=False).ids + [2], "<u4")
                part = ids[p["start"]:p["start"] + p["length"]]
                assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
        if docs.count() > 100:
            assert sum(fill.values()) / (4096 * len(fill)) > 0.95


def test_word_parts_are_the_tokenizers():
    import pyarrow as pa
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(TOKENS)
    signs = [*map(chr, range(1, 9)), *map(chr, range(14, 48)), "\x7f"]
    letters = [*"abstmvlrdIZ09'", *"\u0130\u00c9\u03a3\u1e9e\u00df",
               *"\u0307\u0301\u0338\u093c\u05b4", "\u0958", "\ufb1d",
               "\u1100", "\u1161", "\u11a8", "\u212a", "\u1fbe", "\u0374",
               "\u00a0", "\u0085", "\u2028", "\u4e00", "\U0002ebf0",
               "\u1c89", "\u0660", "\u2160", "\u24b6"]
    draw = random.Random(5)
    words = ["a\x1cb", "GAZETES\u0130,", "\u0130'", "'", "\u0915\u0958."]
    for kind in (signs, letters, signs + letters):
        words += ["".join(draw.choices(kind, k=draw.randint(1, 6)))
                  + draw.choice(["", "", ",", "'", "<=", "''s"])
                  for _ in range(4000)]
    words += [f"x{chr(c)}," for c in range(0x80, 0x30000)
              if chr(c).isalpha() and c % 7 == 0]
    texts = [" ".join(words[i:i + 3]) for i in range(0, len(words), 3)]
    ids, ends = packing.WordIds(TOKENS).of(pa.array(texts))
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        want = model.encode(text, add_special_tokens=False).ids
        assert ids[start:end].tolist() == want, text
        start = end


def test_long_text_in_stretches(frame, monkeypatch):
    text = "alpha Beta, gamma\n" * 500
    whole = {r["start"]: r["ids_crc32"]
             for r in pack(frame([(1, text)]), TOKENS).collect()}
    monkeypatch.setattr(packing, "SEGMENT", 100)
    parts = list(packing.segments(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    coder = packing.word_ids(TOKENS)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])],
                                       names=["doc_id", "text"])
    (_, ids), = packing.encoded(batch, coder, 2)
    size = packing.PIECE
    assert len(ids) > size
    assert zlib.crc32(ids[:size].astype("<u4").tobytes()) == whole[0]


def test_differencing():
    draw = np.random.default_rng(3)
    for n, m in ((1, 1), (5, 2), (40, 7), (200, 30), (3, 9)):
        sizes = draw.integers(1, 1000, n)
        most, window = differencing(sizes, m)
        sums = np.bincount(window, sizes, m)
        assert sums.max() == most and len(window) == n
        if n >= 5 * m:
            assert most - sums.min() <= 0.1 * sums.mean()
    sizes = np.full(9, 3000)
    assert len(set(balanced(sizes).tolist())) == 9     # the count rises


def test_sharding(spark, sf_dir, frame, odd_rows):
    for docs in (table(spark, sf_dir, "documents"), frame(odd_rows)):
        texts = Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()),
                         len((r["text"] or "").encode()) + 8)
                        for r in docs.collect())
        got = shard(docs).collect()
        assert Counter((r["doc_id"], r["text_crc32"], r["size"])
                       for r in got) == texts
        assert {r["law"] for r in got} == {"bytes"}
        total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r)
        for k, rows in by.items():
            assert 0 <= k < 24
            assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
            assert abs(sum(r["size"] for r in rows) - total / 24) <= most
        order = [-1 if r["doc_id"] is None else r["doc_id"]
                 for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
        assert order == sorted(order)


def test_empty(frame):
    none = frame([])
    for f in (exact_dedup, drop_copies, near_groups, drop_near_copies,
              repeated_passages, shard, lambda d: pack(d, TOKENS)):
        assert f(none).count() == 0


def test_hot_repeated_rows_are_written_in_chunks(frame, monkeypatch):
    from lotwise.llm import common
    monkeypatch.setattr(common, "COPIES", 7)
    rows = [(1, "hot")] * 50 + [(2, "hot")] * 7 + [(3, "x")] + [(None, "y")] * 9
    got = Counter(tuple(r) for r in exact_dedup(frame(rows)).collect())
    keep = {t: min((i for i, u in rows if u == t and i), default=None)
            for t in ("hot", "x", "y")}
    assert sum(got.values()) == len(rows)
    assert Counter((r[0], r[1], r[2]) for r in got.elements()) == Counter(
        (i, keep[t], sum(u == t for _, u in rows)) for i, t in rows)
    assert sum(r[3] for r in got.elements()) == 3
    out = shard(frame(rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
