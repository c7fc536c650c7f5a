"""Sets of hashed word n-grams of whole texts, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
CHUNK_BYTES = 1_000_000
SPACES = bytes([32, *range(9, 14)])

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TURN = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def hashed_sets(texts: list) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `WORDS`-word shingles.

    A-Z are lower-cased and words are runs of anything but ASCII white space.
    A text with fewer words has its whole sequence as the one shingle; without
    words, or null, the set is empty. Equal shingles have equal hashes, others
    differ but by an accident of 64 bits.
    """
    waiting: list[bytes] = []
    held = 0
    for text in texts:
        waiting.append(text.encode("utf-8", "replace") if isinstance(text, str) else b"")
        held += len(waiting[-1]) + 1
        if held > CHUNK_BYTES:
            yield from _sets(waiting)
            waiting, held = [], 0
    yield from _sets(waiting)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    if not texts:
        return
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    word = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_VALUE[data] * powers(_BASE, len(data)), dtype=np.uint64)))
    words = mix((total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts])
    first = np.searchsorted(starts, np.concatenate(([0], stops)))
    grams = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        grams += words[k : k + len(grams)] * _TURN[k]
    grams = mix(grams)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _TURN[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
        else:
            yield np.zeros(0, dtype=np.uint64)
