"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.isin(_ALL, [32, 9, 10, 11, 12, 13])
#: Everything in ASCII that is neither letter nor digit.
NOT_WORD = (_ALL < 128) & ~np.isin(_ALL, [*range(48, 58), *range(65, 91), *range(97, 123)])
#: A fixed random number for each byte value and a fixed odd multiplier.
_VALUE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of shifts and multiplications)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where each text begins, and the end
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the end


def split(texts: list[bytes], apart: np.ndarray = SPACE, lower: bool = True) -> Words:
    data = np.frombuffer(b"".join(texts), np.uint8)
    if lower:
        data = LOWER[data]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~apart[data]
    begins, stops = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    begins[edges] = word[1:-1][edges]
    stops[edges - 1] = word[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def hashes(w: Words, longest: int | None = None) -> np.ndarray:
    """64-bit hash of each word, or of its first ``longest`` bytes: equal bytes, equal hash wherever they stand."""
    ends = w.ends if longest is None else np.minimum(w.ends, w.starts + longest)
    n = len(w.data)
    up, down = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[w.data] * up, out=sums[1:])
    return mix((sums[ends] - sums[w.starts]) * down[w.starts]) if n else np.zeros(0, np.uint64)


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in pieces of about ``most`` bytes, whatever the batch holds; a longer text stands alone."""
    part, size = [], 0
    for text in texts.to_pylist():
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
