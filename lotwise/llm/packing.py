"""Packing: Karmarkar-Karp multiway differencing into near-equal windows.

A document is its token ids and a closing id. Its full windows are cut off
first (they need no padding); what is left is cut into pieces of at most
``piece`` ids. Pieces of about ``group`` windows are then partitioned by the
largest differencing method: two partial partitions with the largest spreads
merge, the fullest window of one meeting the emptiest of the other, until one
partition of ``m`` windows is left. ``m`` starts at the least possible number
and rises by one as long as a window exceeds its capacity.

Every partition of the input is packed where it is read: no shuffle, and a
task holds the sizes of one group, not its texts. A document of any length is
encoded in stretches of SEGMENT bytes. Sequence ids carry the partition
number, so a task that runs again returns the same rows. Each partition ends
with one smaller group; a group wastes less than one window beyond the
spread of its windows.

Defined cases: null and empty texts are the closing id alone; rows without
doc_id and repeated rows are packed like any other, each on its own; an empty
table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import in_batches, ragged, texts
from .registry import query, table

WINDOW = 4096
#: Largest piece of a document's rest; smaller ones balance better.
PIECE = 1024
#: Windows that are balanced together.
GROUP = 256
#: Bytes of text that are encoded together.
SEGMENT = 6 << 20
#: Words, and parts of words, that a worker remembers: about 150 MB.
WORDS, PARTS_KEPT = 600_000, 300_000
#: Parts of words that are encoded as one text.
JOINED = 2000
COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(),
           "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
           "sequence_id": pa.int64(), "offset": pa.int64()}
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


@cache
def stays_letter(c: str) -> bool:
    """Whether a character is one letter before and after NFC and lower-casing.

    In Unicode 3.2 and in Python's version, so in any that a tokenizer may
    have. Capital dotted I, for one, becomes a letter and a combining mark.
    """
    low = c.lower()
    return (len(low) == 1 and unicodedata.normalize("NFC", c) == c
            and all(x.category(y)[0] == "L" for y in (c, low)
                    for x in (unicodedata, unicodedata.ucd_3_2_0)))


class WordIds:
    """Token ids of words, encoding each part of a word once while remembered.

    White space never lies inside a token of a word-level vocabulary, so the
    ids of a text are those of its words in turn; and the tokenizer cuts words
    into letters, digits and signs before it merges, so those of a word are
    those of its parts. Only cuts that are sure to be the tokenizer's are made
    here; all other words are encoded whole.
    """

    #: The tokenizer's own cut of lower-case ASCII words (fixed value). White
    #: space is spelt out: Python's \s has U+001C to U+001F besides.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
    #: ASCII without space, or Latin letters that are one character each in
    #: any normal form C and case.
    PLAIN = re.compile(r"[!-~]+|[a-zA-Z\xC0-\xD6\xD8-\xDE\xE0-\xF6\xF8-\xFE]+")
    TAIL = re.compile(r"[!-/:-@\[-`{-~]+$")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.again = np.zeros(1 << 16, bool)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = 0

    def keep(self, here: np.ndarray, room: int) -> None:
        """Forget the words that no later texts held again.  Those of `here`
        stay anyway, alone if there is no room for more."""
        n = len(self.number)
        some = np.zeros(n, bool)
        some[here] = True
        more = some | self.again[:n]
        kept = np.flatnonzero(more if more.sum() <= room else some)
        names = list(self.number)       # in the order of their numbers
        self.number = {names[i]: j for j, i in enumerate(kept.tolist())}
        lengths = self.lengths[kept]
        flat = self.flat[ragged(self.starts[kept], lengths)]
        self.used = len(flat)
        self.flat[:self.used] = flat
        self.lengths[:len(kept)] = lengths
        self.starts[:len(kept)] = np.cumsum(lengths) - lengths
        self.again[:] = False

    def cut(self, word: str) -> list[str]:
        if "<|" in word:            # may be a special token
            return [word]
        if word.isascii():
            return self.PARTS.findall(word.lower())
        tail = self.TAIL.search(word)
        if tail and tail.start() and stays_letter(word[tail.start() - 1]):
            return [word[:tail.start()], tail[0]]
        return [word]

    def joined(self, parts: list[str]) -> bool:
        """Encode parts as one text; False if they aren't one word each.

        Each part is a run of letters, a digit or a run of signs and stands
        between spaces, so the tokenizer's words are the parts.
        """
        if not parts:
            return False
        text = self.model.encode(" ".join(parts), add_special_tokens=False)
        of = np.array(text.word_ids, np.int64)
        ends = np.searchsorted(of, np.arange(len(parts)), "right")
        if not len(of) or of[-1] != len(parts) - 1 or (
                np.diff(ends, prepend=0) <= 0).any():
            return False
        raw = np.array(text.ids, "<u4").tobytes()
        cuts = [0, *(4 * ends).tolist()]
        self.parts.update(zip(parts, map(
            raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        return True

    def learn(self, words: list[str]) -> None:
        cuts = [self.cut(w) for w in words]
        # two generations: what is still in use moves to the newer one
        if len(self.parts) > PARTS_KEPT // 2:
            self.older, self.parts = self.parts, {}
        new = set(chain.from_iterable(cuts)).difference(self.parts)
        moved = new.intersection(self.older)
        self.parts.update((x, self.older[x]) for x in moved)
        new = list(new.difference(moved))
        for at in range(0, len(new), JOINED):
            some = new[at:at + JOINED]
            plain = [x for x in some if self.PLAIN.fullmatch(x)
                     and "<|" not in x]
            if self.joined(plain):
                some = [x for x in some if x not in self.parts]
            self.parts.update(zip(some, (
                np.array(x.ids, "<u4").tobytes()
                for x in self.model.encode_batch_fast(
                    some, add_special_tokens=False)), strict=True))
        get = self.parts.__getitem__
        ids = [get(c[0]) if len(c) == 1 else b"".join(map(get, c))
               for c in cuts]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n, total = len(self.number), int(lengths.sum())
        for name, need in (("flat", self.used + total),
                           ("starts", n + len(ids)),
                           ("lengths", n + len(ids)),
                           ("again", n + len(ids))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate(
                    [old, np.zeros(max(need, len(old)), old.dtype)]))
        self.flat[self.used:self.used + total] = np.frombuffer(
            b"".join(ids), "<u4")
        self.lengths[n:n + len(ids)] = lengths
        self.starts[n:n + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.number.update(zip(words, range(n, n + len(ids)), strict=True))

    def of(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text's ids end."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.number.get, words, repeat(-1)),
                             np.int64, len(words))
        new = np.flatnonzero(number < 0)
        known = number[number >= 0]
        if len(self.number) + len(new) > WORDS:
            # half at most, so that it is rarely full
            self.keep(known, min(WORDS // 2, WORDS - len(new)))
            number = np.fromiter(map(self.number.get, words, repeat(-1)),
                                 np.int64, len(words))
        else:
            self.again[known] = True
        if len(new):
            number[new] = len(self.number) + np.arange(len(new))
            self.learn([words[i] for i in new.tolist()])
        at = number[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return (self.flat[ragged(self.starts[at], lengths)],
                sums[np.cumsum(counts)])


@cache
def word_ids(path: str) -> WordIds:
    """One per worker process: words stay known from task to task."""
    return WordIds(path)


def segments(text: str, size: int = SEGMENT):
    """A long text in stretches that end at white space."""
    at = 0
    while at < len(text):
        space = re.compile(r"[ \t\n\v\f\r]").search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def encoded(batch: pa.RecordBatch, coder: WordIds, closing: int):
    """(doc_id, ids with the closing id) of each row (doc_id, text)."""
    texts = batch.column(1)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    doc_ids = batch.column(0).to_pylist()
    last = np.uint32(closing)
    at = 0
    while at < len(sizes):
        if sizes[at] > SEGMENT:
            parts = [coder.of(pa.array([s]))[0]
                     for s in segments(texts[at].as_py())]
            yield doc_ids[at], np.append(np.concatenate(parts), last)
            at += 1
            continue
        sums = np.cumsum(sizes[at:at + 5000])
        n = max(1, int(np.searchsorted(sums, SEGMENT, "right")))
        ids, ends = coder.of(texts.slice(at, n))
        start = 0
        for doc_id, end in zip(doc_ids[at:at + n], ends.tolist(), strict=True):
            yield doc_id, np.append(ids[start:end], last)
            start = end
        at += n


def differencing(sizes: np.ndarray, m: int) -> tuple[int, np.ndarray]:
    """Largest sum, and the window of each item, of m-way differencing."""
    n = len(sizes)
    if m == 1:
        return int(sizes.sum()), np.zeros(n, np.int64)
    # a partial partition: descending sums, and an item that stands for each
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i]))
            for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joined: list[tuple[np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, i, sums, names = heapq.heappop(heap)
        other, others = heap[0][2:]
        free = m - len(other)
        if len(sums) <= free:
            sums = np.concatenate([sums, other])
            names = np.concatenate([names, others])
        else:
            shared = len(sums) - free
            turned, turned_names = other[::-1], others[::-1]
            joined.append((turned_names[:shared], names[free:]))
            both = np.concatenate([sums, turned[shared:]])
            both[free:free + shared] += turned[:shared]
            sums = both
            names = np.concatenate([names, turned_names[shared:]])
        order = np.argsort(-sums, kind="stable")
        sums, names = sums[order], names[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == m else 0))
        heapq.heapreplace(heap, (-spread, i, sums, names))
    window = np.full(n, -1)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    for kids, parents in reversed(joined):
        window[kids] = window[parents]
    return int(heap[0][2][0]), window


def balanced(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """The window of each item: near-equal windows within the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        most, window = differencing(sizes, m)
        if most <= capacity:
            return window
        m += 1


def pack(docs: DataFrame, tokenizer: str, closing: int = 2,
         capacity: int = WINDOW, piece: int = PIECE,
         group: int = GROUP) -> DataFrame:
    """One row per piece, see COLUMNS; tokenizer: a file of `tokenizers`."""
    def part(batches):
        coder = word_ids(tokenizer)
        number = TaskContext.get().partitionId() << 40
        out = {c: [] for c in COLUMNS}
        rest: list[tuple] = []
        waiting = 0

        def put(doc_id, start, length, crc, total, sequence, offset):
            for c, v in zip(out, (doc_id, start, length, crc, total,
                                  sequence, offset), strict=True):
                out[c].append(v)

        def settle():
            nonlocal number, rest, waiting
            sizes = np.array([x[2] for x in rest], np.int64)
            window = balanced(sizes, capacity)
            fill = [0] * (int(window.max()) + 1)
            for x, w in zip(rest, window.tolist(), strict=True):
                put(*x, number + w, fill[w])
                fill[w] += x[2]
            number += len(fill)
            rest, waiting = [], 0

        for batch in batches:
            for doc_id, ids in encoded(batch, coder, closing):
                n, at = len(ids), 0
                raw = memoryview(ids.astype("<u4").tobytes())
                while at < n:
                    whole = n - at >= capacity
                    size = capacity if whole else min(piece, n - at)
                    item = (doc_id, at, size,
                            zlib.crc32(raw[4 * at:4 * (at + size)]), n)
                    if whole:
                        put(*item, number, 0)
                        number += 1
                    else:
                        rest.append(item)
                        waiting += size
                    at += size
                if waiting >= group * capacity:
                    settle()
                if len(out["doc_id"]) >= 20_000:
                    yield in_batches(out, COLUMNS)
                    for c in out:
                        out[c] = []
        if rest:
            settle()
        yield in_batches(out, COLUMNS)

    return texts(docs).mapInArrow(part, SCHEMA)


@query("op1_packing")
def op1_packing(spark, sf_dir):
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"),
                public_tokenizers.path("word_bpe_49k.json"))
