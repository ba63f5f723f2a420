"""Plain-Python versions of the corpus operators, for small inputs."""
from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def flat(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def passages(rows, size=50):
    """{(doc_id, text): (n_words, n_removed, kept_sha256)}."""
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = {}
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p:p + size])] < i:
                gone[p:p + size] = [True] * size
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i, text] = (len(w), sum(gone), sha(b" ".join(left)))
    return out


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    n = min(5, len(w))
    return frozenset(tuple(w[p:p + n]) for p in range(len(w) - n + 1))


def near(rows, percent):
    """{doc_id: (set size, smallest doc_id reachable)}; ids are distinct."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]"
    r"|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text)
             if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access")
              for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex")
              for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def letter_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(docs, items, size=10):
    """[(doc_id, n_words, n_hit, sorted item texts)] of every document."""
    phrases = defaultdict(set)
    for item, text in items:
        w = letter_words(text)
        for p in range(max(1, len(w) - size + 1) if w else 0):
            phrases[tuple(w[p:p + size])].add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for i, text in docs:
        w, hit, found = letter_words(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                owners = phrases.get(tuple(w[p:p + n]))
                if owners:
                    hit |= set(range(p, p + n))
                    found |= owners
        out.append((i, len(w), len(hit),
                    sorted(str(x) for x in found if x is not None)))
    return out


def near_items(docs, items, terms, span):
    """{(doc_id, item_id, start, end)} of rarest terms within a span."""
    words = {i: letter_words(t) for i, t in docs}
    known = {x for _, t in items for x in letter_words(t)}
    count = defaultdict(int)
    for w in words.values():
        for x in w:
            count[x] += x in known
    out = set()
    for item, text in items:
        # callers see to it that frequencies are not tied at the cut
        own = sorted(set(letter_words(text)), key=lambda x: count[x])[:terms]
        for i, w in words.items():
            for p in range(len(w)):
                part = w[p:p + span]
                at = [p + q for q, x in enumerate(part) if x in own]
                if own and w[p] in own and set(own) <= set(part):
                    out.add((i, item, p, at[-1] + 1))
    return out


def leaf(row):
    def field(x):
        if x is None:
            return b"-"
        x = str(x).encode()
        return str(len(x)).encode() + b":" + x
    return sha(b"".join(map(field, row)))


def tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + fanout]).encode())
                       for i in range(0, len(last), fanout)])
    return levels


def proof(levels, i, fanout):
    """[(left, right)] from level 0 up."""
    out = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        run = level[first:first + fanout]
        out.append(("".join(run[:i - first]), "".join(run[i - first + 1:])))
        i //= fanout
    return out


def manifest(rows, lower, fanout=8):
    """[(doc_id, leaf, subroot, root, proof, folded root)]; rows: FIELDS."""
    groups = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(
            c.lower() if "A" <= c <= "Z" else c for c in r[4])
        other = leaf((*r[:4], low)) if lower(r[0]) else leaf(r)
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), other,
                             r[0]))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = []
    for k in keys:
        groups[k].sort()
        trees.append(tree([g[2] for g in groups[k]], fanout))
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for g, k in enumerate(keys):
        for i, (_, _, own, other, doc_id) in enumerate(groups[k]):
            path = proof(trees[g], i, fanout) + proof(top, g, fanout)
            acc = other
            for left, right in path:
                acc = sha((left + acc + right).encode())
            out.append((doc_id, own, trees[g][-1][0], top[-1][0],
                        sha("".join(a + b for a, b in path).encode()), acc))
    return out


def resampled(docs, target, percent, least, buckets, longest, seed=2024):
    """[(doc_id, n_features, weight, score, rank)]; ids are distinct."""
    import math
    import zlib

    def features(text):
        w = letter_words(text)
        return len(w), [zlib.crc32(" ".join(w[p:p + n]).encode()) % buckets
                        for n in range(1, longest + 1)
                        for p in range(len(w) - n + 1)]

    found = {i: features(t) for i, t in docs}
    s, t = [0] * buckets, [0] * buckets
    for _, f in found.values():
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets)
                                       / ((x + 1) * (sum(t) + buckets))))
            for x, y in zip(s, t, strict=True)]
    rows = {}
    for i, (n, f) in found.items():
        h = int(sha(f"{seed}:{'' if i is None else i}".encode())[:8], 16)
        weight = sum(gain[b] for b in f)
        rows[i] = n, len(f), weight, weight + math.floor(
            -1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    enough = sorted((i for i, r in rows.items() if r[0] >= least),
                    key=lambda i: (-rows[i][3], i is None, i or 0))
    rank = {i: k + 1 for k, i in enumerate(
        enough[:len(enough) * percent // 100])}
    return [(i, *r[1:], rank.get(i)) for i, r in rows.items()]
