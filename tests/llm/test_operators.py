"""Each operator against a brute-force version, and on odd tables."""

import hashlib
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from knownwhen.llm import bpe, exact_dedup, licenses, mixing, near_dedup, pii, quality, sharding, top_k, toxicity, words
from knownwhen.llm import hyperminhash as H
from knownwhen.llm.labelled import sample
from knownwhen.llm.tables import keep_rows

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- sharding


def test_table_is_a_fair_permutation_fill():
    shards = [f"s{i}" for i in range(7)]
    owner = sharding.fill(shards, 101)
    assert sorted(sharding.preference("s3", 101)) == list(range(101))
    counts = Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1
    # Brute force: turns over sets of free slots.
    want, turn = {}, 0
    while len(want) < 101:
        s = shards[turn % 7]
        slot = next(int(x) for x in sharding.preference(s, 101) if int(x) not in want)
        want[slot] = turn % 7
        turn += 1
    assert owner == [want[i] for i in range(101)]
    assert sharding.moved(None, shards, shards[:-1], 101) < 60


@pytest.mark.parametrize(("shards", "slots"), [([], 7), (["a", "a"], 7), (["a"], 9), (["a", "b", "c", "d"], 3)])
def test_table_refuses(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_placement(odd_docs, no_docs):
    got = rows(sharding.place(odd_docs))
    owner = sharding.fill(sharding.SHARDS)
    assert len(got) == odd_docs.count()
    for doc_id, slot, shard in got:
        digest = hashlib.sha256(("" if doc_id is None else str(doc_id)).encode()).hexdigest()
        assert slot == int(digest[:15], 16) % sharding.SLOTS
        assert shard == sharding.SHARDS[owner[slot]]
    assert rows(sharding.place(no_docs)) == []


# --- exact dedup


@pytest.mark.parametrize("bucket_bytes", [exact_dedup.BUCKET_BYTES, 300])
def test_exact_dedup(spark, odd_docs, bucket_bytes):
    more = spark.createDataFrame([(100 + i, f"text {i % 400}") for i in range(900)] + [(2000 + i, "hot") for i in range(200)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    groups = {}
    for doc_id, text in rows(docs):
        groups.setdefault(text or "", []).append(doc_id)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = rows(exact_dedup.exact_dedup(docs, bucket_bytes))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_exact_dedup_odd(odd_docs, no_docs):
    assert exact_dedup.exact_dedup(odd_docs).count() == odd_docs.count()
    assert rows(exact_dedup.exact_dedup(no_docs)) == []


def test_buckets_split_again_until_they_fit(spark):
    contents = spark.range(2000).selectExpr("xxhash64(id) as hash", "100L as bytes")
    levels = exact_dedup.buckets(contents, 2, 5000)
    assert [bits for bits, _ in levels] == [2, 6][: len(levels)] and len(levels) >= 1


def test_open_table_tells_equal_hashes_apart():
    table = exact_dedup.OpenTable()
    for i in range(500):
        table.add(7, b"t%d" % (i % 100), i, 1)
    assert len(table.texts) == 100 and set(table.copies) == {5}
    assert table.largest[3] == 403


# --- near dedup


def shingles(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in re.split(r"[ \t-\r]+", text) if w]
    if not found:
        return frozenset()
    return frozenset(zip(*(found[j:] for j in range(width)))) if len(found) >= width else frozenset([tuple(found)])


def linked(docs, width, percent=80):
    """Brute force over all pairs."""
    sets = {i: shingles(t, width) for i, t in docs}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b) and comp[x] != comp[y]:
                low, high = sorted((comp[x], comp[y]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in ids)


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_against_all_pairs(spark, width):
    rng = random.Random(width)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 4, 9, 40, 150]))]
        for _ in range(rng.choice([1, 3, 25])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 8)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(60)}"
            docs.append((len(docs) * 3, " ".join(own).upper() if rng.random() < 0.3 else "\n".join(own)))
    docs += [(1000, ""), (1001, None), (1002, " \t ")]
    got = rows(near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), width))
    assert sorted(got) == linked(docs, width)


def test_near_dedup_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        own = [w if rng.random() > 0.06 else f"v{rng.randrange(9)}" for w in base]
        docs.append((i, " ".join(own)))
    got = rows(near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 2))
    assert sorted(got) == linked(docs, 2)


def test_near_dedup_odd(odd_docs, no_docs):
    got = rows(near_dedup.near_dedup(odd_docs, 2))
    assert len(got) == odd_docs.count()
    by_id = {r[0]: r for r in got}
    assert by_id[2][2] == 0 and by_id[1][2] == 0 and not by_id[2][3]
    assert by_id[3] == (3, 0, 3, True) and by_id[None][2:] == (None, True)
    assert rows(near_dedup.near_dedup(no_docs, 2)) == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert set(rows(near_dedup.components(links))) == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    for overlap in (200, 400, 480):
        pool = np.sort(rng.integers(0, 1 << 63, 1000 - overlap, dtype=np.uint64) * np.uint64(2))
        a, b = pool[:500] if overlap == 0 else np.sort(pool[:500]), np.sort(np.concatenate([pool[:overlap], pool[500:]]))
        regs = H.registers([a, b])
        assert abs(H.estimate(regs[0], regs[1]) - overlap / (1000 - overlap)) < 0.18
    same = H.registers([a, a])
    assert (same[0] == same[1]).all() and (H.registers([np.zeros(0, np.uint64)]) == 0xFFFF).all()


def test_word_hashes_do_not_depend_on_place():
    texts = [b"alpha beta", b"", b"  beta\talpha", b"ALPHA"]
    w = words.split(texts)
    h = words.hashes(w)
    assert w.first.tolist() == [0, 2, 2, 4, 5]
    assert h[0] == h[3] == h[4] and h[1] == h[2] and h[0] != h[1]


# --- BPE


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path(bpe.TOKENIZER), encoding="utf-8") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


def test_bpe_equals_the_library(encoder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(9)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b \n\n c", "don't we'll I'M", "a" * 2000, "----" * 60, "\x00\x1f\x85", "日本語123", "a՘x \U000187f8"]
    kinds = ["etaoin shrdlu", "aé ñ\n\t's123", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(30)), "ab   "]
    texts += ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(80))) for _ in range(800)]
    ids, counts = encoder.encode(texts)
    stops = np.cumsum(counts)
    for text, a, b, want in zip(texts, stops - counts, stops, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == want.ids, repr(text)
        assert encoder.decode(ids[a:b]).decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


def test_guesses_and_merges_agree(encoder):
    rng = random.Random(2)
    found = ["".join(rng.choice("thersanion gub") for _ in range(rng.randrange(1, 90))).encode() for _ in range(2000)]
    encoded, failing = encoder.vocabulary.encode_words(found)
    assert encoded == [encoder.vocabulary.exact(w) for w in found]
    assert 0 < failing < len(found)


def test_bpe_odd(odd_docs, no_docs):
    got = rows(bpe.encode(odd_docs, tokens=True))
    assert len(got) == odd_docs.count() and rows(bpe.encode(no_docs)) == []
    texts = Counter((r[0], r[1] or "") for r in rows(odd_docs.select("doc_id", "text")))
    assert Counter((r[0], r[5]) for r in got) == texts
    for _, n, ids_sha, decoded_sha, ids, decoded in got:
        assert n == len(ids) and ids_sha == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert decoded_sha == hashlib.sha256(decoded.encode()).hexdigest()


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_pii_base_spans(spark):
    rng = random.Random(4)
    texts = [None, "", "a@b.c@d.e", "a@b.c_x@d.e %@x.y.z..w@q.r", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 " + "9" * 30 + ".1.1.1", "+1 (499) 555-6503 +1+2", "4111 1111 1111 1111 4111-1111-1111-1112", "é😀 x@y.zz 😀 10.0.0.1", "1 " * 3000, "a@b.c " * 500, "7" * 5000]
    kinds = ["ab@.-_ ", "0123. ", "0123456789- ", "+0123456789 ().-", "aé@.1+ 😀0"]
    texts += ["".join(rng.choice(k) for _ in range(rng.randrange(60))) for k in kinds for _ in range(150)]
    got = rows(pii.pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert len(got) == len(texts)
    for doc_id, *counts, base, spans, added, _ in got:
        want = base_spans(texts[doc_id])
        assert counts == [sum(s.startswith(k) for s in want) for k in PATTERNS]
        assert base == hashlib.sha256(",".join(want).encode()).hexdigest()
        listed = spans.split(",") if spans else []
        assert set(want) <= set(listed) and len(listed) == len(want) + added


def test_pii_linear_on_long_runs(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "9" * 300_000), (3, "1 " * 100_000)], "doc_id long, text string")
    assert [r[1:5] for r in rows(pii.pii(docs))] == [(0, 0, 0, 0)] * 3


def test_pii_trees_split_what_differs():
    cell = lambda **x: {f: 0 for f in pii.FEATURES} | x
    cells = [cell(passes=1, n=90, hits=90), cell(passes=0, n=50, hits=0), cell(passes=1, context=1, n=5, hits=4), cell(passes=1, digits=2, n=0, hits=0)]
    assert pii.boost(cells)
    assert cells[0]["f"] > 2 and cells[1]["f"] < -2
    cut = pii.thresholds(cells)
    assert cut[0] <= pii._chance(cells[0]["f"]) and cut[1] > 1


def test_pii_adds_loose_forms(spark):
    """Of each loose form nine in ten are added, and of all that is added nineteen in twenty is personal data."""
    rng = random.Random(12)
    luhn = lambda: next(d for c in "0123456789" if passes("card", d := "4" + str(10**13 + seed) + c))
    forms, texts = {}, []
    for i in range(1200):
        seed = rng.randrange(10**13)
        name, host, n = f"u{i}", f"h{i % 90}.example", f"{rng.randrange(10**6, 10**7)}"
        card, ip = luhn(), [str(rng.randrange(256)) for _ in range(4)]
        plain = [f"{name}@{host}", ".".join(ip), card, f"+49 30 {n}"]
        loose = [f"{name} [at] {host.replace('.', ' [dot] ')}", " . ".join(ip), ".".join(card[j : j + 4] for j in range(0, 15, 4)), f"0049 30 {n}"]
        clean = [f"meet me @ home. Then {n} left", f"in 2019 {n} items of 123 456", f"order {rng.randrange(10**9)}", f"sections 1. 2. 3. 4 of {n}"]
        k = i % 4
        if i % 3 == 0:
            texts.append(f"please write to {plain[k]} today")
        elif i % 3 == 1:
            text = f"please write to {loose[k]} today"
            texts.append(text)
            forms[i] = f"{pii.KINDS[k]}:16:{len(text) - 6}"
        else:
            texts.append(f"we said {clean[k]} today")
    got = {r[0]: (set(r[6].split(",")) if r[6] else set(), r[7]) for r in rows(pii.pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    added = sum(n for _, n in got.values())
    caught = Counter(forms[i].split(":")[0] for i in forms if forms[i] in got[i][0])
    assert all(caught[k] >= 90 for k in pii.KINDS), caught
    assert sum(caught.values()) >= pii.PRECISION * added


def test_pii_odd(odd_docs, no_docs):
    assert pii.pii(odd_docs).count() == odd_docs.count()
    assert rows(pii.pii(no_docs)) == []


# --- top k


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vecs = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(900)]
    vecs += [(1000, [0.5, None] + [0.0] * 4), (1100, [float("nan")] * 6), (1200, [float("inf")] * 6), (1300, None), (None, [1.0] * 6), (3, [1.0] * 6), (100, [0.25] * 6), (1400, [1e5] * 6), (5, [])]
    table = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as block")
    own = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in own if i % 100 == 0}):
        asks = min(v for i, v in own if i == q)
        best = sorted((-sum(a * b for a, b in zip(asks, v)), i) for i, v in own if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = rows(top_k.top_k(table, F.col("vec_id") % 100 == 0))
    assert sorted(got) == want
    assert rows(top_k.top_k(table.filter("vec_id = -1"), F.col("vec_id") % 100 == 0)) == []


def test_blocks_are_left_out():
    blocks = [(np.arange(10) + 10 * b, np.full((10, 2), 100 - 30 * b)) for b in range(4)]
    found, scored = top_k.search(np.array([7]), np.array([[1, 1]]), blocks, 3)
    assert scored == 1 and [x[1] for x in found] == [0, 1, 2]


# --- licences


def test_license_forms(spark, odd_docs, no_docs):
    texts = {1: "RELEASED under the MIT licence", 2: "Copyright (c) 2020 A\n\n  released under the “MIT” License.\r\nAll rights reserved.", 3: "Licensed under the Apache License, v2.0", 4: "See: Licensed under the MIT License.", 5: "a\nLicensed under CC BY-NC 4.0.\nb\nreleased under the MIT license", 6: "", 7: None}
    got = {r[0]: r[2:] for r in rows(licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert got[1] == ("MIT", 1, "MIT") and got[2] == ("MIT", 1, "MIT") and got[3] == ("Apache-2.0", 1, "Apache-2.0")
    assert got[4] == (None, 0, "") and got[5] == (None, 2, "CC-BY-NC-4.0,MIT") and got[6] == got[7] == (None, 0, "")
    assert licenses.scan(odd_docs).count() == odd_docs.count() and rows(licenses.scan(no_docs)) == []
    own = spark.createDataFrame([("X-1", "Line one\nline two"), (None, None)], "license_id string, text string")
    assert rows(licenses.scan(spark.createDataFrame([(1, "LINE one.\nCopyright 1999 x\nline  two!")], "doc_id long, text string"), own))[0][2] == "X-1"


def _license_text(name):
    return (Path(licenses.__file__).parent / "known_licenses" / f"{name}.txt").read_text()


def test_whole_licenses_and_wrapped_notices(spark):
    mit, bsd, apache, gpl = map(_license_text, ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"))
    header = apache[apache.index("Licensed under the Apache License, Version 2.0 (the"):]
    texts = {
        1: "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + mit,
        2: "Some prose.\n" + "\n".join(textwrap.wrap(mit, 41)) + "\nmore prose",
        3: "a\nReleased under the\nMIT License.\nb",
        4: "Licensed under the Apache License, Version\n2.0.\nb",
        5: apache,
        6: "# x\n" + "".join(f"# {x.strip()}\n" for x in header.split("\n")) + "code = 1",
        7: "BSD 3-Clause License\nCopyright 1999 B\nAll rights reserved.\n" + "\n".join(textwrap.wrap(bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), 60)),
        8: gpl,
        9: mit + "\nReleased under the MIT License.\n" + mit,
        10: mit.replace("free of charge", "for a fee"),
        11: "we say " + mit,
    }
    got = {r[0]: r[2:] for r in rows(licenses.scan(spark.createDataFrame([*texts.items(), (9, texts[9])], "doc_id long, text string")))}
    assert got[1] == ("MIT", 1, "MIT") and got[2] == (None, 1, "MIT")
    assert got[3] == (None, 1, "MIT") and got[4] == (None, 1, "Apache-2.0")
    assert got[5] == ("Apache-2.0", 1, "Apache-2.0") and got[6] == (None, 1, "Apache-2.0")
    assert got[7] == ("BSD-3-Clause", 1, "BSD-3-Clause") and got[8] == ("GPL-3.0", 1, "GPL-3.0")
    assert got[9] == (None, 6, "MIT") and got[10] == got[11] == (None, 0, "")
    own = spark.createDataFrame([("X-1", "one\ntwo"), ("X-2", "one"), (None, "")], "license_id string, text string")
    assert rows(licenses.scan(spark.createDataFrame([(1, "a\none\ntwo\nb\none two\none")], "doc_id long, text string"), own))[0][2:] == (None, 3, "X-1,X-2")


# --- mixing


def test_mix_meets_the_targets(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, names = mixing.drawn(docs)
    total, shares = Counter(), {}
    for source, lang, n, weight in rows(out.select("source", "lang", names["n_tokens"], names["weight"])):
        total["all"] += n
        total["source", source] += n
        total["weighted", source] += n * weight
    raised = {k[1]: v**0.8 for k, v in total.items() if k[0] == "source"}
    shares = {s: v / sum(raised.values()) for s, v in raised.items()}
    for s, share in shares.items():
        assert total["weighted", s] / total["all"] == pytest.approx(share, rel=0.02)
    got = rows(mixing.mix(odd_docs))
    assert len(got) == odd_docs.count() and all(0 <= r[4] <= 1 for r in got) and any(r[5] for r in got)
    assert rows(mixing.mix(no_docs)) == []


# --- classifiers


def test_samples_hold_no_held_out_rows(spark, odd_docs, odd_labels):
    import zlib

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    drawn = rows(sample(docs, labels, "quality", 20).select("doc_id", "label"))
    assert Counter(r[1] for r in drawn)[1] == 20
    assert all(zlib.crc32(str(r[0]).encode()) % 3 != 1 for r in drawn)
    assert all(r[0] is not None for r in rows(sample(odd_docs, odd_labels, "toxic", 5).select("doc_id")))


def test_scores_do_not_depend_on_company():
    texts = [b"", b"fine words here", b"  ", b"some bad words " * 50, b"x" * 5000]
    y = np.array([0, 0, 0, 1, 0], float)
    tox = toxicity.train(texts, y, steps=30)
    assert np.allclose(tox.score(texts), np.concatenate([tox.score([t]) for t in texts]), atol=2e-6)
    assert tox.score([b"bad"])[0] > tox.score([b"fine"])[0]
    good = quality.train(quality.features(texts), 1 - y)
    assert np.array_equal(good.score(texts), np.concatenate([good.score([t]) for t in texts]))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_held_out_rows(spark, module):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    name, label = (("quality", "quality"), ("toxicity", "toxic"))[module is toxicity]
    out = getattr(module, name)(docs, labels).join(labels, "doc_id").filter("held_out")
    got = rows(out.select("predicted", label))
    assert np.mean([p == y for p, y in got]) > 0.97
    assert np.mean([p == y for p, y in got if y == 0]) > 0.93


def test_classifiers_odd(odd_docs, no_docs, odd_labels):
    for module, name in ((quality, "quality"), (toxicity, "toxicity")):
        run = getattr(module, name)
        got = rows(run(odd_docs, odd_labels))
        assert len(got) == odd_docs.count() and all(0 <= r[2] <= 1 for r in got)
        assert rows(run(no_docs, odd_labels)) == []
        none = odd_labels.filter("doc_id = -1")
        assert run(odd_docs, none).count() == odd_docs.count()


def test_kept_rows_have_all_columns(odd_docs):
    kept = odd_docs.filter("doc_id = 0 or doc_id is null").select("doc_id")
    assert keep_rows(odd_docs, kept).count() == 5
    one = keep_rows(odd_docs, kept, single=True)
    assert one.count() == 3 and one.columns == odd_docs.columns


def test_mix_keeps_rows_that_no_target_names(spark):
    docs = spark.createDataFrame([(i, "some words here", f"s{i % 3}", "en") for i in range(30)], "doc_id long, text string, source string, lang string")
    share = lambda rows: spark.createDataFrame(rows, "value string, share double")
    targets = {"source": share([("s0", 0.5), ("s1", 0.5)]).withColumnRenamed("value", "source"), "lang": share([("en", 1.0)]).withColumnRenamed("value", "lang"), "topic": share([("prose", 1.0)]).withColumnRenamed("value", "topic")}
    for budget in (mixing.BUDGET, None):
        got = {r[0]: r for r in rows(mixing.mix(docs, targets, budget=budget))}
        assert len(got) == 30
        assert all((got[i][4], got[i][5]) == (0.0, False) for i in range(2, 30, 3))
        assert all(got[i][4] > 0.9 for i in range(0, 30, 3))


def test_words_built_alike_differ(spark):
    """Alternating words and their mirror, which a polynomial hash modulo a power of two takes for equal."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    sets = H.shingle_sets([a.encode(), b.encode(), a.upper().encode()])
    assert sets[0][0] != sets[1][0] and sets[0][0] == sets[2][0]
    tail = " one two three four"
    docs = spark.createDataFrame([(1, a + tail), (2, b + tail)], "doc_id long, text string")
    assert [r[2] for r in sorted(rows(near_dedup.near_dedup(docs, 5)))] == [1, 2]


def test_small_sets_share_a_rare_shingle(spark):
    """Every linked pair of small sets meets by its rarest shingles alone, hot shingles or not."""
    rng = random.Random(8)
    sets = [rng.sample(range(200), rng.randrange(1, 65)) for _ in range(60)]
    sets += [[x for x in s if rng.random() > 0.08] or s for s in sets for _ in range(3)] + [[1, 2, 3, 4], [1, 2, 3, 4, 5], [0] + list(range(300, 340))]
    table = spark.createDataFrame([(i, len(set(s)), sorted(set(s))) for i, s in enumerate(sets)], "id long, n long, small array<long>")
    met = {}
    for i, _, shingle in rows(near_dedup.rarest(table, 80)):
        met.setdefault(shingle, set()).add(i)
    found = {(a, b) for ids in met.values() for a in ids for b in ids if a < b}
    links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert len(links) > 50 and links <= found


def test_blocks_are_moved_once(spark, monkeypatch):
    """Rows that meet in shards: each vector once, in blocks of bounded size, whatever the ids are like."""
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 16)
    vecs = [(i * 7919 if i % 3 else 100, [float(i % 7), 1.0]) for i in range(600)]
    held = top_k.integer_vectors(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"))
    found = rows(top_k.blocks(held, 5).select("shard", "ids", F.size("v")))
    assert sorted(i for _, ids, _ in found for i in ids) == sorted(i for i, _ in vecs)
    assert all(len(ids) <= 16 and size == 2 * len(ids) and 0 <= shard < 5 for shard, ids, size in found)
    assert len(found) <= 600 / 16 + 5 and len({s for s, *_ in found}) > 1


def test_license_cost_is_linear(spark):
    """A known form that begins on every line: twice the lines take about twice the time."""
    import time

    took = []
    for n in (4000, 4000, 16000):
        start = time.monotonic()
        docs = spark.createDataFrame([(1, "Everyone is permitted to copy\n" * n)], "doc_id long, text string")
        assert rows(licenses.scan(docs))[0][3] == 0
        took.append(time.monotonic() - start)
    assert took[2] < 4 * took[1] + 20
