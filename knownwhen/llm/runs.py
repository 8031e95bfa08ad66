"""Periodic runs of words by string synchronising sets.

At a dyadic scale t, every window of t words has a name (a hash; twice the window is named from its
halves). A position is selected when the least name among the windows that begin up to t words after
it stands at one of the two ends; so whether it is selected hangs on its own 2t words alone, and equal
contexts are selected alike. Windows of a period of t/3 or less are never least: they lie in runs that
smaller scales have found. A run of smallest period q and at least 3q words, where t <= q/2 < 2t, holds
a selected position with the same context q words later: were there none, its first words would have a
period of t/3 or less, and so would the whole run. Pairs of selected positions of equal context
therefore propose all periods from 8 words on; smaller periods are read off word by word. Each proposal
is extended on the words themselves, so names decide nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knownwhen.llm import words
from knownwhen.llm.tables import doc_texts, prepare

#: Periods below this are found by shifting the words.
SHIFTED = 8
#: A run's least words, and its least words in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Runs of three periods are found as well: they tell the larger scales which windows are periodic.
FOUND_PERIODS = 3
_NEVER = np.uint64(2**64 - 1)
_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _reach(w: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    at, size = 0, 64
    while j + at < len(w):
        stop = min(size, len(w) - j - at)
        differ = w[i + at : i + at + stop] != w[j + at : j + at + stop]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, size = at + stop, 2 * size
    return at


def _shifted(w: np.ndarray, q: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, q) of all stretches of FOUND_PERIODS * q words or more in which words q apart are equal."""
    same = np.zeros(max(len(w) - q, 0) + 2, np.int8)
    same[1:-1] = w[:-q] == w[q:]
    change = np.diff(same)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + q
    long = ends - starts >= FOUND_PERIODS * q
    yield from zip(starts[long].tolist(), ends[long].tolist(), [q] * int(long.sum()), strict=True)


def _periodic(found: list[tuple[int, int, int]], t: int, n: int) -> np.ndarray:
    """Where the window of t words has a period of t/3 or less."""
    steps = np.zeros(n - t + 2, np.int64)
    for start, end, q in found:
        if 3 * q <= t <= end - start:
            steps[start] += 1
            steps[end - t + 1] -= 1
    return np.cumsum(steps[:-1]) > 0


def synchronising(names: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """The selected positions: the least name of the t + 1 windows from here on stands first or last."""
    ids = np.where(periodic, _NEVER, np.minimum(names, _NEVER - np.uint64(1)))
    least, width = ids, 1
    while width < t:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    n = len(ids) - t
    least = np.minimum(least[:n], ids[t:])
    return np.flatnonzero((least != _NEVER) & ((least == ids[:n]) | (least == ids[t:])))


def _proposals(names: np.ndarray, chosen: np.ndarray, t: int) -> Iterator[tuple[int, int]]:
    """(position, period) of selected positions of equal context that are 2t to 4t words apart."""
    context = names[chosen]
    order = np.lexsort((chosen, context))
    context, place = context[order], chosen[order]
    for step in range(1, len(place)):
        apart = place[step:] - place[:-step]
        near = (context[step:] == context[:-step]) & (apart < 4 * t)
        if not near.any():
            break
        picked = near & (apart >= 2 * t)
        yield from zip(place[:-step][picked].tolist(), apart[picked].tolist(), strict=True)


def stretches(w: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal stretches of FOUND_PERIODS periods or more; a period may be a multiple of the smallest.

    ``w`` may hold several texts with a number of its own between two; ``longest``: words of the longest.
    """
    found = [s for q in range(1, min(SHIFTED, longest // FOUND_PERIODS + 1)) for s in _shifted(w, q)]
    back = w[::-1]
    t, names = 1, words.mix(w.astype(np.uint64) * _LEFT + _RIGHT)
    while 2 * FOUND_PERIODS * t <= longest and 2 * t <= len(w):
        twice = words.mix(names[:-t] * _LEFT + names[t:] * _RIGHT)
        if 4 * t > SHIFTED:
            known: dict[int, list[tuple[int, int]]] = defaultdict(list)
            chosen = synchronising(names, _periodic(found, t, len(w)), t)
            for i, q in sorted(_proposals(twice, chosen, t)):
                last = known[q][-1:]
                if q >= SHIFTED and not (last and last[0][0] <= i and i + q <= last[0][1]):
                    start, end = i - _reach(back, len(w) - i - q, len(w) - i), i + q + _reach(w, i, i + q)
                    known[q].append((start, end))
            found += [(s, e, q) for q, spans in known.items() for s, e in spans if e - s >= FOUND_PERIODS * q]
        t, names = 2 * t, twice
    return found


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text (words as numbers from 0) its runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    classes = defaultdict(list)
    for i, w in enumerate(texts):
        if len(w) >= LEAST_WORDS:
            classes[len(w).bit_length()].append(i)
    for members in classes.values():
        # Texts of about one length are searched together: one number that stands nowhere else parts two of them.
        parts = [p for k, i in enumerate(members) for p in (texts[i], np.array([-1 - k], np.int64))]
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in members])])
        smallest: dict[tuple[int, int], int] = {}
        for start, end, q in stretches(np.concatenate(parts), max(len(texts[i]) for i in members)):
            smallest[start, end] = min(q, smallest.get((start, end), q))
        spans = sorted((s, e, q) for (s, e), q in smallest.items() if e - s >= max(LEAST_WORDS, LEAST_PERIODS * q))
        for (start, end, q), k in zip(spans, np.searchsorted(offsets, [s for s, _, _ in spans], "right") - 1, strict=True):
            out[members[k]].append((start - int(offsets[k]), end - start, q))
    return [sorted(r, key=lambda s: (s[0], s[2])) for r in out]


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place where the contract makes the end of a text periodic; None where it doesn't."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for each run's repeats, joined by one space."""
    steps = np.zeros(len(found) + 1, np.int64)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    return b" ".join([found[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, rewrite: bool = True) -> DataFrame:
    """Returns doc_id, n_runs, start, length, period, exponent_milli long, runs_sha256, collapsed_sha256 string, runs array.

    A run is a stretch of words with smallest period q, of at least 6 words and 4q, that no neighbour extends; the
    longest is named (ties: smallest start, then period). A row for each row of ``docs``, repeated rows too. A null
    text is an empty one; texts without words have no runs, null figures and the digests of nothing. ``rewrite``:
    first make the end of one text in ten periodic, as its id says; a text without an id is left as it is. A text is
    searched whole, in n log n steps and memory in proportion to it. Other columns are not looked at; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], batch.column("doc_id").to_pylist()
            at = 0
            for texts in words.pieces(batch.column("text")):
                numbers: dict[bytes, int] = {}
                lists, coded = [], []
                for doc_id, text in zip(ids[at : at + len(texts)], texts, strict=True):
                    found = text.split()  # of bytes: at exactly the six white-space characters
                    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in found), np.int64, len(found))
                    places = planted(len(found), doc_id) if rewrite else None
                    if places is not None:
                        w, found = w[places], [found[i] for i in places.tolist()]
                    lists.append(found)
                    coded.append(w)
                for doc_id, found, own in zip(ids[at : at + len(texts)], lists, runs_of(coded), strict=True):
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(found, own)).hexdigest()
                    s, n, q = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    rows.append((doc_id, len(own), s, n, q, 1000 * n // q if own else None, *digests, [dict(zip(("start", "length", "period"), r, strict=True)) for r in own]))
                at += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)

    return doc_texts(docs).selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(run, SCHEMA)


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))]
