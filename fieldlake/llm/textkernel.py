"""Hashes of the words, word windows and characters of many texts at once, in numpy.

Every function takes the joined bytes of a batch and works without a loop over words, so a task
costs a few passes over its bytes. Callers cut batches with `slices`, which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, near inputs unrelated ones."""
    x = x + _MUL
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    forth, back = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * forth[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


# a word is a run of ASCII letters and digits and of bytes of other characters
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def slices(texts: Iterable[str | None], chars: int = 4_000_000) -> Iterator[list[str]]:
    """Lists of whole texts (null as empty) with about `chars` characters."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t if isinstance(t, str) else "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and bytes of each lower-case word of all texts in order, offsets: text i has words offsets[i]:offsets[i+1])."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    is_word = _WORD[buf]
    edge = np.flatnonzero(np.diff(is_word, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return span_hashes(buf, starts, ends), ends - starts, offsets


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of `width` words; a shorter text with words is one run."""
    counts = np.diff(offsets)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(counts)), runs)
    first = np.repeat(offsets[:-1], runs) + (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs))
    left = np.repeat(offsets[1:], runs)
    value = np.zeros(len(text), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        at = first + k
        value = np.where(at < left, (value * _STEP + padded[at]), value)
    return text, mix(value)
