"""Word shingles and minwise values, in numpy over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Minwise values of a document.
SIGNATURE = 64
_A = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word (maximal runs without white space, A-Z lower-cased)."""
    raw = np.frombuffer(data.lower(), np.uint8)
    word = ~_SPACE[raw]
    edges = np.diff(np.r_[False, word, False].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    power = np.ones(int(sizes.max()), np.uint64)
    power[1:] = np.uint64(_BASE)
    power = np.multiply.accumulate(power)
    inside = np.flatnonzero(word)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    offset = np.arange(len(inside)) - np.repeat(first, sizes)
    return starts, mixed(np.add.reduceat(_BYTE[raw[inside]] * power[offset], first) + sizes.astype(np.uint64))


def _slices(texts: list[bytes | None], most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in slices of bounded size, each with the place of its first text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size > most or i == len(texts) - 1:
            yield begin, [x or b"" for x in texts[begin : i + 1]]
            begin, size = i + 1, 0


def word_numbers(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: place of the first text, number of words of each, and the words' 64-bit hashes."""
    for first, own in _slices(texts):
        starts, words = _word_hashes(b"\n".join(own))
        yield first, np.diff(np.searchsorted(starts, np.r_[0, np.cumsum([len(t) + 1 for t in own])])), words


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct ``k``-word shingles of each text, hashed to 64 bits; fewer words are one shingle, none no shingle."""
    for _, sizes, words in word_numbers(texts):
        cut = np.r_[0, np.cumsum(sizes)]
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled = mixed(rolled * np.uint64(_BASE) + words[j : j + len(rolled)] + np.uint64(j + 1))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if y - x >= k:
                yield np.unique(rolled[x : y - k + 1])
            elif y > x:
                whole = np.array([y - x], np.uint64)
                for j in range(x, y):
                    whole = mixed(whole * np.uint64(_BASE) + words[j : j + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` minwise values of a set that isn't empty."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, ((shingles[at : at + 4096, None] * _A + _B) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets (sorted and distinct)."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (n + m - shared)


def shared(sets: list[np.ndarray], others: list[np.ndarray] | None = None, columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets with each other, or with others, as products of incidence matrices.

    Shingles of a single set can't be shared and are left out, so near copies need few columns.
    """
    both = sets + (others or [])
    values, place, count = np.unique(np.concatenate(both) if both else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    owner, number = owner[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    n = len(sets)
    out = np.zeros((n, len(others) if others is not None else n), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, (at, at + columns))
        m = np.zeros((len(both), columns), np.float32)
        m[owner[a:b], number[a:b] - at] = 1
        out += m[:n] @ (m[n:] if others is not None else m).T
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], percent: int, others: list[np.ndarray] | None = None) -> np.ndarray:
    """Which sets are alike (as :func:`alike`), all at once."""
    inter = shared(sets, others)
    a = np.array([len(x) for x in sets])
    b = a if others is None else np.array([len(x) for x in others])
    return 100 * inter >= percent * (a[:, None] + b[None, :] - inter)
