"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def lower_words(text):
    return ALNUM.findall((text or "").translate(_LOWER))


def by_id(row):
    return (row[0] is not None, row[0] or 0)


def later_windows(sequences, sizes_at):
    """``sequences`` in order; ``sizes_at(seq, p)`` lists window sizes at p. The covered places of later copies."""
    seen, gone = set(), [set() for _ in sequences]
    for k, seq in enumerate(sequences):
        for p in range(len(seq)):
            for n in sorted(set(sizes_at(seq, p))):
                window = tuple(seq[p : p + n])
                if window in seen:
                    gone[k].update(range(p, p + n))
                seen.add(window)
    return gone


def dedup_lines(rows, min_lines, min_chars):
    """(id, text) in order of id -> (n_lines, n_removed, kept text)."""
    lines = [t.split("\n") if t else [] for _, t in rows]

    def sizes(seq, p):
        short = [n for n in range(1, min_lines) if p + n <= len(seq) and sum(map(len, seq[p : p + n])) >= min_chars]
        return short + list(range(min_lines, len(seq) - p + 1))

    gone = later_windows(lines, sizes)
    return [
        (len(ls), len(g), "\n".join(x for i, x in enumerate(ls) if i not in g)) for ls, g in zip(lines, gone, strict=True)
    ]


def dedup_words(rows, size):
    words = [SPACE.findall(t or "") for _, t in rows]
    gone = later_windows(words, lambda seq, p: [size] if p + size <= len(seq) else [])
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone, strict=True)]


def shingle_weights(text, size=5):
    w = lower_words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def near_classes(rows, bound=0.8):
    """Class of each (id, text): the place of its first member in order of id, null last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    bags = [shingle_weights(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    rank = {i: k for k, i in enumerate(order)}
    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a or b:
                both = sum((a & b).values())
                alike = both >= bound * sum((a | b).values())
            else:
                alike = (rows[i][1] or "") == (rows[j][1] or "")
            if alike and find(i) != find(j):
                x, y = sorted((find(i), find(j)), key=rank.get)
                root[y] = x
    return [find(i) for i in range(len(rows))]


def leaks(text, items, size=10):
    """(n_words, n_hit, sorted item ids) for (item_id, text) items."""
    w = lower_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = lower_words(t)
        n = min(size, len(iw))
        windows = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
        for p in range(len(w) - n + 1) if n else []:
            if tuple(w[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(item)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


def fill(sizes, weights, most=3):
    """Targets by source: shares by weight, capped, the excess shared again."""
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - most * sum(sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and free * weights[s] > most * sizes[s] * w}
        if not more:
            return {s: most * sizes[s] if s in capped else free * weights[s] / w for s in sizes}
        capped |= more


def group(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
