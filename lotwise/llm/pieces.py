"""SentencePiece encoding and decoding by a batched Viterbi search.

A text becomes the sequence of pieces of the greatest total score among those
that the model allows; characters without a piece become their bytes. White
space is marked as SentencePiece marks it (U+2581 for a space, one in front of
the text).

In a unigram model every sequence is allowed. In a BPE model (scores are
ranks) two neighbours are allowed if merging their joint text ends in just
these two pieces; the sequence in which all neighbours are allowed is unique
and is what merging the whole text ends in, so the search returns the ids of
the library itself. Which pieces merge into which is worked out once per
worker from the ranks alone.

No piece holds a mark after another character, nor a line break, so a text is
cut there and each distinct chunk is segmented once while it is remembered.
Chunks of equal length advance together, one numpy step per end and piece
length: rolling substring hashes probe the sorted keys of the pieces of that
length, and a vectorised maximum stores score, piece and backpointer. Ties go
to the longer last piece. A chunk's pieces are compared with its characters
afterwards, so a colliding hash cannot pass.

Decoding joins the pieces and bytes and takes the marks back; it returns every
text as it was, except that a literal U+2581 comes back as a space, as it does
in SentencePiece.

No shuffle is used. Defined cases: null and empty texts have no ids and decode
to the empty text; rows are encoded one by one, so repeated rows and null ids
come back as they are; long texts are whole; other columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, ragged, texts
from .registry import query, table
from .substring_dedup import BASES, powers

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Distinct chunks that a worker remembers, and characters per batch.
REMEMBERED, BATCH_CHARS = 400_000, 2_000_000
BREAK = -1


class Merges:
    """Which neighbours a BPE model allows.

    rank: per piece, smaller merges earlier, equal ranks from the left.
    A piece of one character is there from the start; any other forms at its
    rank, from the one pair of pieces that its text comes down to.
    """

    def __init__(self, text: list[str], rank: list[int]):
        number = {t: i for i, t in enumerate(text)}
        self.size = len(text)
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.made = [len(t) == 1 for t in text]
        self.rank = rank
        self.joins: dict[tuple[int, int], int] = {}
        for i in sorted(range(self.size), key=lambda i: (rank[i], i)):
            t = text[i]
            pairs = [(number[t[:k]], number[t[k:]]) for k in range(1, len(t))
                     if t[:k] in number and t[k:] in number]
            pairs = [(x, y) for x, y in pairs if self.made[x] and self.made[y]]
            for x, y in pairs:
                if self.stay(x, y):
                    self.left[i], self.right[i] = x, y
                    self.made[i] = True
                    break
            if len(t) > 1 and self.made[i]:
                self.joins.update(dict.fromkeys(pairs, i))
        keys = np.array([x * self.size + y for x, y in self.joins], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.joined = np.append(np.array(list(self.joins.values()), np.int64)
                                [order], 0)
        self.lefts, self.rights = np.array(self.left), np.array(self.right)
        self.ranks = np.array(rank)

    def stay(self, x: int, y: int) -> bool:
        """Whether x and y, side by side, are what their text comes down to.

        Goes back in time: the later of the two pieces at the border is taken
        apart, and a join of the two then present must not have come before
        the join that followed on either side.
        """
        after_x = after_y = np.inf
        while True:
            z = self.joins.get((x, y))
            if z is not None and (self.rank[z] < after_x
                                  and self.rank[z] <= after_y):
                return False
            if self.left[x] < 0 and self.left[y] < 0:
                return True
            if self.left[y] < 0 or (self.left[x] >= 0
                                    and self.rank[x] > self.rank[y]):
                after_x, x = self.rank[x], self.right[x]
            else:
                after_y, y = self.rank[y], self.left[y]

    def allowed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """stay() of many pairs; negative x (nothing, or bytes) allows all."""
        ok = np.ones(len(x), bool)
        at = np.flatnonzero(x >= 0)
        x, y = x[at].astype(np.int64), y[at].astype(np.int64)
        top = np.iinfo(np.int64).max
        after_x, after_y = np.full(len(x), top), np.full(len(x), top)
        while len(at):
            key = x * self.size + y
            found = np.searchsorted(self.keys, key)
            rank = self.ranks[self.joined[found]]
            bad = ((self.keys[found] == key) & (rank < after_x)
                   & (rank <= after_y))
            ok[at[bad]] = False
            plain_x, plain_y = self.lefts[x] < 0, self.lefts[y] < 0
            go = ~bad & ~(plain_x & plain_y)
            undo = plain_y | (~plain_x & (self.ranks[x] > self.ranks[y]))
            after_x = np.where(undo, self.ranks[x], after_x)[go]
            after_y = np.where(undo, after_y, self.ranks[y])[go]
            x, y = (np.where(undo, self.rights[x], x)[go],
                    np.where(undo, y, self.lefts[y])[go])
            at = at[go]
        return ok


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1)
        plain = []
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)
                      or model.is_unused(i)):
                plain.append(i)
        scores = np.array([model.get_score(i) for i in plain], float)
        self.unknown = scores.min() - 10
        for i in plain:
            body = self.text[i].lstrip(MARK)
            assert MARK not in body and "\n" not in body, self.text[i]
        # ranks are whole numbers below zero, log-likelihoods are not
        self.merges = None
        self.runs: set[int] = set()
        if (scores == np.floor(scores)).all():
            # runs of marks of one common, last rank: see joined_marks()
            tied = Counter(scores.tolist())
            self.runs = {len(self.text[i]) for i, s in zip(
                plain, scores, strict=True)
                if tied[s] > 1 and len(self.text[i]) > 1}
            loose = [i for i, s in zip(plain, scores, strict=True)
                     if tied[s] > 1 and (self.text[i].strip(MARK)
                                         or s > scores.min())]
            if loose:
                raise ValueError(f"pieces of equal rank: {loose[:5]}")
            keep = np.array([tied[s] == 1 or len(self.text[i]) == 1
                             for i, s in zip(plain, scores, strict=True)])
            self.run_ids = {len(self.text[i]): i for i, k in zip(
                plain, keep, strict=True) if not k}
            plain = [i for i, k in zip(plain, keep, strict=True) if k]
            scores = scores[keep]
            self.run_ids[1] = self.text.index(MARK)
            rank = np.unique(-scores, return_inverse=True)[1]
            self.merges = Merges([self.text[i] for i in plain], rank.tolist())
        self.plain = np.array(plain)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        by: dict[int, list[int]] = {}
        for at, i in enumerate(plain):
            if self.merges is None or self.merges.made[at]:
                by.setdefault(len(self.text[i]), []).append(at)
        for size, some in sorted(by.items()):
            codes = np.array([[ord(c) for c in self.text[plain[a]]]
                              for a in some])
            keys = substrings(codes, size)[0][:, 0]
            order = np.argsort(keys)
            self.tables[size] = (keys[order], scores[some][order],
                                 np.array(some)[order])
        self.spell_len = np.array([len(self.text[i]) for i in plain])
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.spell = np.frombuffer("".join(
            self.text[i] for i in plain).encode("utf-32-le"), np.uint32)
        raw = [t.encode() for t in self.text]
        for value, i in enumerate(self.byte):
            if i >= 0:
                raw[i] = bytes([value])
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                raw[i] = b""
        self.raw = raw
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = 0

    def learn(self, keys: list[str]) -> None:
        """Remembers the ids of keys: a word stands for itself behind a mark,
        a line break is followed by what it stands before, and what starts
        with marks is as it is."""
        line = [k for k in keys if k[:1] == "\n"]
        rest = [k for k in keys if k[:1] != "\n"]
        self.keep(rest, *self.segment([k if k[:1] == MARK else MARK + k
                                       for k in rest]))
        if line:
            flat, lengths = self.segment([k[1:] for k in line])
            ends = np.cumsum(lengths)
            self.keep(line, np.insert(flat, ends - lengths, self.byte[10]),
                      lengths + 1)

    def keep(self, keys: list[str], flat: np.ndarray, lengths: np.ndarray
             ) -> None:
        n, total = len(self.number), len(flat)
        for name, need in (("flat", self.used + total),
                           ("starts", n + len(keys)),
                           ("lengths", n + len(keys))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate(
                    [old, np.zeros(max(need, len(old)), old.dtype)]))
        self.flat[self.used:self.used + total] = flat
        self.lengths[n:n + len(keys)] = lengths
        self.starts[n:n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.number.update(zip(keys, range(n, n + len(keys)), strict=True))

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks, and how many each has; equal lengths go
        through the search together."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            end = int(np.searchsorted(sizes[order], size, "right"))
            end = min(end, at + max(1, 250_000 // max(1, size)))
            ids, n = (self.viterbi([chunks[i] for i in order[at:end].tolist()],
                                   size) if size
                      else (np.zeros(0, np.int32), np.zeros(end - at, np.int64)))
            flat.append(ids)
            lengths.append(n)
            at = end
        flat, lengths = np.concatenate(flat), np.concatenate(lengths)
        starts = np.empty_like(lengths)
        starts[order] = np.cumsum(lengths) - lengths
        back = np.empty_like(lengths)
        back[order] = lengths
        return flat[ragged(starts, back)], back

    def viterbi(self, chunks: list[str], size: int
                ) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks of one length, and how many each has."""
        n = len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"),
                              np.uint32).reshape(n, size)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        start = np.zeros((size + 1, n), np.int32)
        piece = np.full((size + 1, n), BREAK, np.int32)
        lengths = sorted((s for s in self.tables if s <= size), reverse=True)
        keys = {s: k.T.copy() for s, k in zip(
            lengths, substrings(codes, *lengths), strict=True)}
        for end in range(1, size + 1):
            single = np.zeros(n, bool)
            for s in lengths:
                if s > end:
                    continue
                table_keys, scores, ids = self.tables[s]
                key = keys[s][end - s]
                at = np.minimum(np.searchsorted(table_keys, key),
                                len(table_keys) - 1)
                hit = table_keys[at] == key
                if s == 1:
                    single = hit
                hit = np.flatnonzero(hit)
                if self.merges:
                    # one sequence only: a prefix that has its end is done
                    hit = hit[best[end][hit] == -np.inf]
                    hit = hit[self.merges.allowed(piece[end - s][hit],
                                                  ids[at[hit]])]
                total = best[end - s][hit] + scores[at[hit]]
                better = total > best[end][hit]
                hit = hit[better]
                best[end][hit] = total[better]
                start[end][hit] = end - s
                piece[end][hit] = ids[at[hit]]
            total = best[end - 1] + np.where(single, -np.inf, self.unknown)
            better = total > best[end]
            best[end] = np.where(better, total, best[end])
            start[end] = np.where(better, end - 1, start[end])
            piece[end] = np.where(better, BREAK, piece[end])
        # all walks back advance together
        steps, where = [], np.full(n, size)
        rows = np.arange(n)
        while where.any():
            here = np.where(where > 0, piece[where, rows], BREAK - 1)
            steps.append((here, start[where, rows]))
            where = np.where(where > 0, start[where, rows], 0)
        path = np.stack([h for h, _ in steps][::-1], 1)
        froms = np.stack([f for _, f in steps][::-1], 1)
        used = path >= BREAK
        counts = used.sum(1)
        flat, froms = path[used], froms[used]
        owner = np.repeat(rows, counts)
        found = flat >= 0
        # what the pieces spell has to be what stands in the chunk
        held = flat[found]
        spell = ragged(self.spell_at[held], self.spell_len[held])
        there = ragged(owner[found] * size + froms[found],
                       self.spell_len[held])
        if (self.spell[spell] != codes.ravel()[there]).any():
            raise ValueError("pieces don't spell their text")
        ids = np.where(found, self.plain[flat], BREAK).astype(np.int32)
        special = np.zeros(n, bool)
        special[owner[~found]] = True
        if self.runs and size > 1:
            special |= (codes[:, 0] == ord(MARK)) & (codes[:, 1] == ord(MARK))
        if special.any():
            ends = np.cumsum(counts)
            parts = []
            for r in range(n):
                some = ids[ends[r] - counts[r]:ends[r]]
                if special[r]:
                    some = self.completed(some, chunks[r],
                                          froms[ends[r] - counts[r]:ends[r]])
                parts.append(some)
            counts = np.fromiter(map(len, parts), np.int64, n)
            ids = np.concatenate(parts)
        return ids, counts

    def completed(self, ids: np.ndarray, chunk: str, froms: np.ndarray
                  ) -> np.ndarray:
        """Bytes for characters without a piece, and runs of marks joined."""
        if (ids == BREAK).any():
            ids = np.array(list(chain.from_iterable(
                [i] if i >= 0 else self.byte[list(chunk[a].encode())].tolist()
                for i, a in zip(ids.tolist(), froms.tolist(), strict=True))),
                np.int32)
        if self.runs and chunk.startswith(2 * MARK):
            ids = self.joined_marks(ids)
        return ids.astype(np.int32)

    def joined_marks(self, ids: np.ndarray) -> np.ndarray:
        """Leading single marks, joined from the left into runs.

        All runs have one rank, below every other piece, so they join last
        and the leftmost pair that makes a run always comes first.
        """
        marks = int((np.append(ids, -1) != self.run_ids[1]).argmax())
        done: list[int] = []
        for _ in range(marks):
            done.append(1)
            while len(done) > 1 and done[-1] + done[-2] in self.runs:
                done[-2:] = [done[-1] + done[-2]]
        return np.concatenate([np.array([self.run_ids[n] for n in done],
                                        np.int64), ids[marks:]])

    def encode(self, some: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each text has."""
        odd = pc.match_substring_regex(some, f"^$|^ | $|  | \n|{MARK}")
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd):
            # white space that is not one space between words: cut here
            whole = some.to_pylist()
            lists = [t.replace("\n", " \n").split(" ") for t in whole]
            for i in odd.tolist():
                lists[i] = CHUNK.findall(
                    (MARK + whole[i]).replace(" ", MARK)) if whole[i] else []
            lists = pa.array(lists, pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(
                pc.replace_substring(some, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        get = self.number.get
        new = [k for k in keys if get(k) is None]
        if len(self.number) + len(new) > REMEMBERED:
            self.forget()
            new = keys
        if new:
            self.learn(new)
        number = np.fromiter(map(self.number.__getitem__, keys), np.int64,
                             len(keys))
        at = number[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(
            zero_copy_only=False))
        return (self.flat[ragged(self.starts[at], lengths)],
                np.diff(np.concatenate([[0], sums[ends]])))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode(
            errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def substrings(codes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Rabin-Karp hash of every substring of each size, by row and start."""
    n, length = codes.shape
    up, down = powers(BASES[0], 1 << length.bit_length())
    sums = np.zeros((n, length + 1), np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:length], 1,
              out=sums[:, 1:])
    return [mixed((sums[:, s:] - sums[:, :-s]) * down[:length - s + 1])
            for s in sizes]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process: chunks stay known from task to task."""
    return Vocabulary(path)


def encode(docs: DataFrame, model: str, checked: bool = False) -> DataFrame:
    """doc_id, text and ids; model: a file of `sentencepiece`.

    checked: also `ids_crc32`, the CRC-32 of the ids as little-endian unsigned
    32-bit numbers, and `decoded`, the text that decoding them gives, in the
    same pass.
    """
    names = ["doc_id", "text", "ids"] + ["ids_crc32", "decoded"] * checked

    def part(batches):
        words = vocabulary(model)
        for batch in batches:
            at = 0
            sizes = pc.binary_length(batch.column(1)).to_numpy(
                zero_copy_only=False)
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(
                    sizes[at:at + 2000]), BATCH_CHARS, "right")))
                some = batch.slice(at, n)
                at += n
                ids, counts = words.encode(some.column(1))
                ends = np.concatenate([[0], np.cumsum(counts)])
                made = [*some.columns, pa.ListArray.from_arrays(
                    pa.array(ends.astype(np.int32)), pa.array(ids))]
                if checked:
                    each = [ids[a:b] for a, b in zip(
                        ends.tolist(), ends[1:].tolist(), strict=False)]
                    made += [pa.array([zlib.crc32(x.astype("<u4").tobytes())
                                       for x in each], pa.int64()),
                             pa.array([words.decode(x.tolist())
                                       for x in each], pa.string())]
                yield pa.RecordBatch.from_arrays(made, names=names)

    more = ", ids_crc32 long, decoded string" * checked
    return texts(docs).mapInArrow(
        part, "doc_id long, text string, ids array<int>" + more)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of their ids (null ids: null)."""
    @F.pandas_udf("string")
    def joined(ids):
        words = vocabulary(model)
        return ids.map(lambda x: None if x is None else words.decode(
            x.tolist()))

    return rows.withColumn("decoded", joined(ids))


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    """Per document: number and CRC-32 of the ids (little-endian unsigned
    32-bit), SHA-256 of the decoded text, and whether it is the text."""
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")

    rows = encode(table(spark, sf_dir, "documents"), model, checked=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"),
        "ids_crc32",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("same"))
