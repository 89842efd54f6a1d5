"""Words of whole Arrow batches as numpy arrays, without a Python object for each word.

Texts are handled as UTF-8 bytes. Every set of word characters used here is a set of ASCII
characters plus, perhaps, all others, so a table of 256 entries decides each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a block of its own.
BLOCK = 1 << 20

_M = 0xFFFFFFFFFFFFFFFF
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20250229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Words are runs without white space: every byte but blank and TAB to CR.
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and where each begins and ends."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents that hold at most ``limit`` bytes, or one document."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def runs(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of members; a run ends where a document ends."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    cuts = bounds[:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = bounds[1:]
    after[ends[ends > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        cache[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are disjoint and in order."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, side="right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        total = _sums(codes[raw[a:b]] * _powers(_BASE, b - a))
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * _powers(_INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def lower_codes() -> np.ndarray:
    """Byte codes under which A-Z equal a-z."""
    return BYTE_CODES[LOWER]


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, i = np.empty(n, np.uint64), 0
    while i < n:
        j = min(i + BLOCK, n)
        part = words[i : j + size - 1]
        total = _sums(part * _powers(_BASE, len(part)))
        out[i:j] = mix((total[size:] - total[:-size]) * _powers(_INVERSE, j - i))
        i = j
    return out


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
