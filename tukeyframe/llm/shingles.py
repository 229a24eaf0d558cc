"""Sets of hashed word shingles, and circulant MinHash signatures of them, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

WIDTH = 5
#: Coordinates of a signature, in bands of ROWS; and bits of the universe that the second permutation permutes.
BANDS, ROWS, UNIVERSE_BITS = 32, 4, 22
COORDINATES = BANDS * ROWS

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    x = x + np.uint64(salt * _ODD & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            own = _powers[k]
            _powers[k] = np.concatenate([own, own * np.uint64(pow(base, len(own), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words: differences of running polynomial sums, scaled back to the word's start."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts], 1)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; the words are lower-cased in A-Z.

    A run of width words makes a shingle; fewer words make one of all of them, and no word makes none. Texts are hashed
    together up to a million bytes at a time (a longer text alone), which spares calls for short ones.
    """
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
        if part and size + len(data) > 1 << 20:
            out += _shingle_sets(part, width)
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    return out + (_shingle_sets(part, width) if part else [])


def _shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = _spans(data)
    words = _word_hashes(data, starts, ends)
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at = np.searchsorted(starts, firsts)  # the first word of each text
    runs = np.zeros(0, np.uint64)
    if len(words) >= width:
        runs = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            runs = mix(runs * np.uint64(_ODD) + words[k : len(words) - width + 1 + k])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix(one * np.uint64(_ODD) + words[k : k + 1])
            out.append(one)
        else:
            out.append(words[:0])
    return out


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return shingle_sets([text], width)[0]


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return b"".join(int(mix(shingles, salt).sum(dtype=np.uint64)).to_bytes(8, "big") for salt in (2, 3))


@cache
def _circle(bits: int, coordinates: int) -> np.ndarray:
    """The second permutation with its beginning repeated at the end, seen through every window of the signature's width."""
    order = np.random.Generator(np.random.PCG64(0xC14C)).permutation(1 << bits).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES, bits: int = UNIVERSE_BITS) -> np.ndarray:
    """Circulant MinHash of a set that isn't empty.

    The first permutation (a bijection of the hashes) scatters the set over a circle; coordinate k is the least value that
    the second permutation, shifted by k, has on the set. The shifted values of an element lie side by side, so an
    element costs one read of as many neighbours as there are coordinates.
    """
    windows = _circle(bits, coordinates)
    places = np.unique(mix(shingles, 4) >> np.uint64(64 - bits)).astype(np.int64)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(places), 1024):
        np.minimum(least, windows[places[start : start + 1024]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of a signature; the band's number is part of it."""
    parts = least.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(len(parts), dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(_ODD) + parts[:, k], 5)
    return keys.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    both = int((long[at] == short).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
