"""Five-word shingles of texts as 64-bit hashes, vectorised over batches of texts.

A word's hash is a polynomial in its UTF-8 bytes, taken from running sums over a whole
buffer; a shingle's is a polynomial in its words' hashes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
#: Bytes of text that are hashed at once; a longer text is cut at white space.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_tables: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _tables or _tables[0].size < n:
        size = max(n, 2 * SLICE)
        factors = np.full((2, size), 1, np.uint64)
        factors[:, 1:] = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        _tables[:] = list(np.cumprod(factors, axis=1, dtype=np.uint64))
    return _tables[0], _tables[1]


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer, and where they start."""
    buffer = np.frombuffer(data, np.uint8)
    space = np.ones(buffer.size + 2, bool)
    space[1:-1] = _SPACE[buffer]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[0::2], turns[1::2]
    up, down = _powers(buffer.size + 1)
    sums = np.zeros(buffer.size + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: buffer.size], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def _long(data: bytes) -> np.ndarray:
    """Hashes of the words of a long text, slice by slice."""
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out)


def _set(words: np.ndarray, shingles: np.ndarray | None) -> np.ndarray:
    if words.size < WORDS:
        return _shingles(words, words.size) if words.size else np.zeros(0, np.uint64)
    found = np.sort(shingles if shingles is not None else _shingles(words, WORDS))
    keep = np.ones(found.size, bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found[keep]


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    total = np.full(words.size - n + 1, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + words[k : words.size - n + 1 + k]
    return mixed(total)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's five-word shingles, A-Z in lower case.

    Fewer words than five are one shingle; no words, none.
    """
    waiting: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        words, starts = _hashes(b" ".join(waiting))
        shingles = _shingles(words, WORDS) if words.size >= WORDS else np.zeros(0, np.uint64)
        begins = np.cumsum([0, *[len(d) + 1 for d in waiting]])
        cuts = np.searchsorted(starts, begins).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield _set(words[a:b], shingles[a : b - WORDS + 1])

    for text in texts:
        data = text.encode("utf-8", "replace").lower() if text else b""
        if len(data) > SLICE:
            yield from flush()
            waiting, size = [], 0
            yield _set(_long(data), None)
            continue
        waiting.append(data)
        size += len(data) + 1
        if size > SLICE:
            yield from flush()
            waiting, size = [], 0
    yield from flush()


def shingle_set(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))
