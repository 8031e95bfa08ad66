"""HyperMinHash sketches of word shingles.

A shingle is hashed once. The hash's leading bits choose a bucket; of the least remainder in
each bucket only the count of leading zeros and some mantissa bits are kept, 16 bits in all.
Empty buckets borrow from full ones in an order that depends on the bucket alone, so that
small sets can be banded too.
"""

from __future__ import annotations

import hashlib

import numpy as np

from knownwhen.llm import words

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Registers in a band. With 32 bands, large sets at a similarity of 0.8 share none with a chance of 5e-8. Small sets
#: borrow registers, which are not independent then; they are found by their rarest shingles besides.
BAND = 4
BANDS = BUCKETS // BAND
_PAIR = np.uint64(0xA0761D6478BD642F)
#: For each bucket its own order over all buckets, as ranks.
_ORDER = np.argsort(np.random.Generator(np.random.PCG64(5)).random((BUCKETS, BUCKETS)), axis=1).astype(np.int16)


class _Hashes(dict):
    """The 64-bit digest of each word met: different words don't share one, however alike they are built."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def shingle_sets(texts: list[bytes], width: int = 2) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles: runs of ``width`` words, or all words if fewer; A-Z lower-cased."""
    table, out = _Hashes(), []
    for text in texts:
        found = text.lower().split()  # of bytes: A-Z, and the six white-space characters
        n = min(width, len(found))
        h = np.fromiter(map(table.__getitem__, found), np.uint64, len(found))
        run = np.full(len(found) - n + 1 if found else 0, np.uint64(n))
        for j in range(n):
            run = words.mix(run * _PAIR + h[j : len(h) - n + 1 + j])
        out.append(np.unique(run))
    return out


_EDGES = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BUCKETS) registers of 16 bits; a row of an empty set is all ones."""
    least = np.full((len(sets), BUCKETS), np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        if len(s):
            # Sorted hashes: the first one at or after a bucket's edge is its least.
            at = np.searchsorted(s, _EDGES)
            inside = at < len(s)
            at[~inside] = 0
            value = s[at]
            filled[i] = inside & ((value >> np.uint64(64 - BUCKET_BITS)) == np.arange(BUCKETS, dtype=np.uint64))
            least[i] = value
    # The 53 bits after the bucket's, as an exact fraction 0.1xxx * 2^-zeros.
    rest = ((least << np.uint64(BUCKET_BITS)) >> np.uint64(11)).astype(np.float64)
    mantissa, exponent = np.frexp(rest)
    zeros = np.where(rest > 0, 53 - exponent, 53).astype(np.uint16)
    bits = np.where(rest > 0, (mantissa * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
    out = (zeros << np.uint16(MANTISSA_BITS)) | bits
    for i in np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1)):
        full = np.flatnonzero(filled[i])
        empty = np.flatnonzero(~filled[i])
        out[i, empty] = out[i, full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    out[~filled.any(axis=1)] = 0xFFFF
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys: each packs BAND compressed registers, without loss."""
    return np.ascontiguousarray(regs.astype("<u2")).view("<i8")


#: The chance that two different least values leave the same register: their zeros agree with a chance of about 1/3, and then the mantissas.
COLLISION = 1 / 3 / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets from their registers (rows), corrected for chance collisions."""
    same = (a == b).mean(axis=-1)
    return np.maximum(0.0, (same - COLLISION) / (1 - COLLISION))
