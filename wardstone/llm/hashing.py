"""Words and word shingles of many texts at once as 64-bit hashes: numpy inside tasks, no Python loop per word."""

import re

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PIECE = 1 << 19


def _power_tables(n: int) -> list:
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_M, _INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers


def slices(batches, most: int = 8 << 20):
    """Record batches of at most about ``most`` bytes (or one row), so that a task's memory follows no batch size."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for i in range(0, max(1, batch.num_rows), step):
            yield batch.slice(i, step)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes that begin and end with a space."""
    b = np.frombuffer(buf, np.uint8)
    space = SPACES[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((LOWER[b].astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_M))


def _long(text: bytes):
    """A text over PIECE bytes, cut at spaces."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of UTF-8 texts in order, and where each text's words begin (n + 1 bounds)."""
    hashes, counts, i = [], np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        if len(texts[i]) > PIECE:
            for part in _long(texts[i]):
                _, h = _piece(b" " + part + b" ")
                hashes.append(h)
                counts[i] += len(h)
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and len(texts[j]) <= PIECE and total <= PIECE:
            total += len(texts[j]) + 1
            j += 1
        starts, h = _piece(b" " + b" ".join(texts[i:j]) + b" ")
        first = np.cumsum([1, *[len(t) + 1 for t in texts[i:j]]])
        counts[i:j] = np.diff(np.searchsorted(starts, first))
        hashes.append(h)
        i = j
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), bounds


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each text; fewer words are one shingle, none give an empty set."""
    words, bounds = hashed_words(texts)
    n = len(words)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled = mixed(rolled * np.uint64(_M) + words[j : n - k + 1 + j])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                h = mixed(h * np.uint64(_M) + words[j : j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
