"""Words of many texts at once, as arrays of 64-bit numbers; no call is made per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
#: Kinds of characters: letters, figures, ``_`` and ``-``, what ends a link (space, quote, bracket), any other.
OTHER, LETTER, JOINT, STOP, DIGIT = range(5)
#: Characters read at a time.
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _D
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def pair_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of ordered pairs of numbers."""
    return mix(a * _C + b + _B)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, lower-case letter and number of each code point."""
    size = 0x110000
    kind = np.zeros(size, np.uint8)
    low = np.arange(size, dtype=np.uint64)
    kind[0x3400:0xA000] = kind[0xAC00:0xD7A4] = kind[0x20000:0x32000] = LETTER
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000)):
        for cp in range(a, b):
            c = chr(cp)
            if c.isalpha() or 0x300 <= cp < 0x370 or (0x900 <= cp < 0xE00 and not c.isalnum() and not c.isspace()):
                kind[cp] = LETTER
                small = c.lower()
                if len(small) == 1:
                    low[cp] = ord(small)
            elif c.isalnum():
                kind[cp] = DIGIT
            elif c in "_-":
                kind[cp] = JOINT
            elif c.isspace() or c in "\"'<>()[]":
                kind[cp] = STOP
    return kind, low, mix(low + _B)


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    return [np.ones(1, np.uint64)]


def _power(n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2**64."""
    held = _powers()
    if len(held[0]) < n:
        held[0] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 64), _B | np.uint64(1))])
    return held[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each followed by a line break, their kinds, and where each text begins."""
    kind, low, _ = _characters()
    joined = "\n".join(texts) + "\n"
    points = low[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])[:-1]
    return points, kind[points], begin


def run_numbers(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and number of each run of characters that are ``inside`` a word."""
    number = _characters()[2]
    at = np.flatnonzero(inside)
    head = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(np.r_[head, len(at)])
    if not len(head):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    off = np.arange(len(at)) - np.repeat(head, length)
    return at[head], length, mix(np.add.reduceat(number[points[at]] * _power(int(length.max()))[off], head))


def once(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where each number stands first in each text."""
    return np.unique(mix(h) + mix(docs.astype(np.uint64)), return_index=True)[1]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``SLICE`` characters, null as empty, with the number of the first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SLICE:
            yield start, [x or "" for x in texts[start:i]]
            start, size = i, 0
        size += len(t or "")
    if texts:
        yield start, [x or "" for x in texts[start:]]
