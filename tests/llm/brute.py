"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def _covered(docs, length):
    count = Counter(tuple(d[i:i + length]) for d in docs for i in range(len(d) - length + 1))
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[tuple(d[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        yield d, gone


def word_repeats(rows, length):
    out = []
    for (doc_id, _), (d, gone) in zip(rows, _covered([words(t) for _, t in rows], length)):
        kept = " ".join(w for w, g in zip(d, gone) if not g)
        out.append((doc_id, len(d), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(d[i:i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, raw):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, length=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def tokens(text):
        return word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    windows = {}
    for item, text in items:
        t = tokens(text)
        size = min(length, len(t))
        for i in range(len(t) - size + 1 if size else 0):
            windows.setdefault(tuple(t[i:i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        t, hit, found = tokens(text), set(), set()
        for size in sizes:
            for i in range(len(t) - size + 1):
                if tuple(t[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(t[i:i + size])]
        out.append((doc_id, len(t), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit)))
    return out


def shingle_set(text, k):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1)))


def similar(rows, k, percent):
    """(doc_id, set size, smallest linked doc_id); distinct ids without nulls."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = Counter((a, b) for h in holders.values() for n, b in enumerate(h) for a in h[:n])
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), low[find(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def manifest(rows, fan=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    import zlib

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tampered(row):
        if row[0] is None or row[4] is None or zlib.crc32(str(row[0]).encode()) % 2:
            return row
        return (*row[:4], row[4].replace("\n", ""))

    def tree(nodes):
        """(root, siblings before and after by level for each leaf)."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, i in zip(ways, at):
                first = i // fan * fan
                way.append((nodes[first:i], nodes[i + 1:first + fan]))
            at = [i // fan for i in at]
            nodes = [h(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        return nodes[0], ways

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in groups[source]]))
    if not trees:
        return []
    root, top = tree([t[0] for t in trees])
    out = []
    for source, (subroot, ways), rest in zip(order, trees, top):
        for row, way in zip(groups[source], ways):
            fold = leaf(tampered(row))
            for before, after in way + rest:
                fold = h(*before, fold, *after)
            proof = h(*(s for before, after in way + rest for s in before + after))
            out.append((row[0], leaf(row), subroot, root, proof, fold, fold == root))
    return out


def hard_negatives(rows, every=100, keep=5):
    """Rows of (vec_id, embedding, label), vec_id not null."""
    import math

    known = []
    for place, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        known.append((vec_id, moved, [math.floor(256 * x) for x in vector], place))
    out = []
    for anchor in known:
        if anchor[0] is None or anchor[0] % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(anchor[2], r[2])), r) for r in known if r[3] != anchor[3]),
                        key=lambda x: (-x[0], x[1][0] is None, x[1][0] or 0, x[1][3]))
        for p, positive in [x for x in scored if x[1][1] == anchor[1]][:keep]:
            found = [x for x in scored if x[1][1] != anchor[1] and 80 * p <= 100 * x[0] <= 100 * p][:keep]
            out += [(anchor[0], positive[0], i + 1, r[0], p, n) for i, (n, r) in enumerate(found)]
    return out
