"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from knownwhen.llm import runs


def naive(w):
    """(start, length, period) of all runs: every period's maximal stretches, the smallest period of each."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def naive_row(doc_id, text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(found)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
    own = naive(found)
    drop = {i for s, length, q in own for i in range(s + q, s + length)}
    first = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(own), *first, 1000 * first[1] // first[2] if own else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(" ".join(x for i, x in enumerate(found) if i not in drop)))


def made(rng):
    """Few different words, repeats of repeats, a period broken at the ends, all parted by noise."""
    w = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 40, 70]))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(2, 5) + [rng.randrange(50)]
        w += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
        w += [rng.randrange(60) for _ in range(rng.randrange(8))]
    return w


@pytest.mark.parametrize("seed", range(30))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(20)] + [[], [1], [1] * 5, [1] * 6, [0, 1] * 4, [0, 1] * 3]
    assert runs.runs_of([np.array(t, np.int64) for t in texts]) == [naive(t) for t in texts]


def test_binary_words():
    rng = random.Random(1)
    texts = [[rng.randrange(2) for _ in range(n)] for n in (50, 200, 700)] + [[int(b) for b in bin(x)[2:]] for x in range(1 << 11, 1 << 12)]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci) < 14:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts += [fibonacci[-1], fibonacci[9] * 6, [0] * 3000, ([0] * 90 + [1]) * 9]
    assert runs.runs_of([np.array(t, np.int64) for t in texts]) == [naive(t) for t in texts]


def test_equal_contexts_are_selected_alike():
    rng = np.random.default_rng(3)
    part = rng.integers(0, 9, 400)
    w = np.concatenate([rng.integers(0, 9, 100), part, rng.integers(0, 9, 57), part])
    names, t = runs.words.mix(w.astype(np.uint64)), 1
    while t < 16:
        names, t = runs.words.mix(names[:-t] * runs._LEFT + names[t:] * runs._RIGHT), 2 * t
    chosen = set(runs.synchronising(names, runs._periodic([], t, len(w)), t).tolist())
    assert {i - 100 for i in chosen if 100 <= i <= 500 - 2 * t} == {i - 557 for i in chosen if 557 <= i <= 957 - 2 * t}
    assert all(any(i + d in chosen for d in range(t)) for i in range(len(w) - 3 * t))


def test_query_on_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(7)
    more = spark.createDataFrame([(1000 + i, " \n".join(f"w{x}" for x in made(rng))) for i in range(150)], "doc_id long, text string")
    short = odd_docs.filter("length(text) < 100000 or text is null").select("doc_id", "text").unionByName(more)
    got = [tuple(r)[:8] for r in runs.periodic_runs(short).collect()]
    want = [naive_row(*r) for r in short.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(r[1] for r in want)
    whole = {r.doc_id: r for r in runs.periodic_runs(odd_docs).collect()}
    assert runs.periodic_runs(odd_docs).count() == odd_docs.count()
    assert (whole[7].n_runs, whole[7].length, whole[7].period) == (1, 30_000, 1)
    assert runs.periodic_runs(no_docs).collect() == []
