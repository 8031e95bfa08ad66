"""Byte-level BPE by speculation: guess tokens greedily, verify neighbours, merge exactly where the guess fails.

A word's greedy longest-match tokens are its BPE encoding exactly if every two neighbours are
compatible, that is, if merging in rank order would never have joined pieces across their
border. All neighbouring pairs of a batch are checked at once on arrays; only words with a
failing pair go through the merges. Distinct words are encoded once per batch and kept in a
bounded store.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownwhen.llm.tables import doc_texts, prepare

#: The vocabulary that is read unless another path is given.
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: how byte-level vocabularies cut text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words kept by a worker; beyond it, or beyond eight times as many tokens, the store is emptied.
STORE_WORDS = 400_000


def byte_letters() -> dict[str, int]:
    """The letter a vocabulary file writes for each byte: itself where it prints, else one from 256 on."""
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a tokenizer file; a token of rank -1 is a single byte."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        letters = byte_letters()
        written = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*written.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * n
        for token, i in written.items():
            if token not in self.special:
                self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.rank = np.full(n, -1, np.int64)
        self.first, self.second = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = written[a], written[b], written[a + b]
            self.merges[a, b] = rank, made
            self.rank[made], self.first[made], self.second[made] = rank, a, b
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.by_byte = [-1] * 256
        for i, b in enumerate(self.bytes):
            if len(b) == 1 and i not in self.special.values():
                self.by_byte[b[0]] = i
        # A token is only guessed if its own bytes encode to it: both halves do, and nothing joins them differently before its rank.
        whole = self.rank >= 0
        fine = ~whole & np.array([len(b) == 1 for b in self.bytes])
        made = np.flatnonzero(whole)
        intact = np.zeros(n, bool)
        intact[made] = self.compatible(self.first[made], self.second[made], 2 * self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            fine[i] = intact[i] and fine[self.first[i]] and fine[self.second[i]]
        self.guess = {self.bytes[i]: int(i) for i in np.flatnonzero(fine)}
        self.longest = [1] * 256
        for b in self.guess:
            self.longest[b[0]] = max(self.longest[b[0]], len(b))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether no merge crosses its border.

        Time runs backwards: the later made of the two pieces at the border is taken apart, and the
        pieces then at the border were side by side until that moment. They would have merged if
        their rank is below the rank of that moment; at the same rank the one further left goes first.
        Moments count double, with 1 more where the piece on the right was the one that went.
        """
        x, y = left.astype(np.int64), right.astype(np.int64)
        until = np.full(len(x), np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64)
        fine, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            a, b = x[open_], y[open_]
            keys = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            crossing = (self.pair_keys[at] == keys) & (2 * self.pair_ranks[at] < until[open_])
            fine[open_[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~crossing & ((ra >= 0) | (rb >= 0))
            open_, a, b, ra, rb = open_[on], a[on], b[on], ra[on], rb[on]
            undo_left = ra > rb
            until[open_] = np.where(undo_left, 2 * ra, 2 * rb + 1)
            x[open_] = np.where(undo_left, self.second[a], a)
            y[open_] = np.where(undo_left, b, self.first[b])
        return fine

    def greedy(self, word: bytes) -> list[int]:
        guess, longest, out, at, n = self.guess, self.longest, [], 0, len(word)
        while at < n:
            end = min(n, at + longest[word[at]])
            while (token := guess.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first; long words take them from a heap of neighbouring pieces."""
        piece: list[int] = [self.by_byte[b] for b in word]
        if len(piece) <= 48:
            merges, none = self.merges, (len(self.bytes), -1)
            ranks = [merges.get(p, none) for p in zip(piece, piece[1:])]
            while ranks and (least := min(ranks)) is not none:
                i = ranks.index(least)
                piece[i : i + 2] = [least[1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = merges.get((piece[i - 1], least[1]), none)
                if i < len(ranks):
                    ranks[i] = merges.get((least[1], piece[i + 1]), none)
            return piece
        n = len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, i + 1, r[1]) for i in range(n - 1) if (r := self.merges.get((piece[i], piece[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, j, made = heapq.heappop(heap)
            if piece[i] < 0 or piece[j] < 0 or after[i] != j or self.merges.get((piece[i], piece[j]), (-1,))[0] != rank:
                continue
            piece[i], piece[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := self.merges.get((made, piece[after[i]])):
                    heapq.heappush(heap, (r[0], i, after[i], r[1]))
            if before[i] >= 0 and (r := self.merges.get((piece[before[i]], made))):
                heapq.heappush(heap, (r[0], before[i], i, r[1]))
        return [p for p in piece if p >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """The tokens of each word, and how many words needed the merges."""
        out = [self.greedy(w) for w in words]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        tokens = np.fromiter((t for w in out for t in w), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(out)), lengths)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tokens[border] << 32 | tokens[border + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failing = np.unique(owner[border[~fine]])
        for i in failing:
            out[i] = self.exact(words[i])
        return out, len(failing)


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.newer: regex.Pattern | None = None
        self._empty()

    def _empty(self) -> None:
        self.code: dict[str, int] = {t: i for i, t in enumerate(self.vocabulary.special)}
        self.chunks = [np.array(list(self.vocabulary.special.values()), np.int64)]
        self.counts = [1] * len(self.code)

    def _known_letters(self, text: str) -> str:
        """Letters and digits of Unicode versions after the tokenizer's count as neither: a stand-in of that class."""
        if self.newer is None:
            letter = regex.compile(r"[\p{L}\p{N}]")
            new = [c for c in map(chr, range(0x500, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and letter.match(c)]
            self.newer = regex.compile("[" + "".join(new) + "]") if new else regex.compile(r"(?!)")
        return self.newer.sub("", text)

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text)
        seen = self._known_letters(text) if max(text) >= "Ԁ" else text
        return self.words.findall(text) if seen == text else [text[m.start() : m.end()] for m in self.words.finditer(seen)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, one text after the other, and the number of tokens of each text."""
        words: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                for j, part in enumerate(self.special.split(text)):
                    words += [part] if j % 2 else self.split(part)
            else:
                words += self.split(text)
            ends[i + 1] = len(words)
        code = self.code
        codes = list(map(code.get, words))
        if None in codes:
            new = list(dict.fromkeys(w for w, c in zip(words, codes, strict=True) if c is None))
            encoded, _ = self.vocabulary.encode_words([w.encode() for w in new])
            for w, ids in zip(new, encoded, strict=True):
                code[w] = len(self.counts)
                self.counts.append(len(ids))
            self.chunks.append(np.array([t for ids in encoded for t in ids], np.int64))
            codes = list(map(code.__getitem__, words))
        flat, counts = np.concatenate(self.chunks), np.array(self.counts, np.int64)
        self.chunks = [flat]
        starts = np.cumsum(counts) - counts
        codes = np.array(codes, np.int64)
        ids = flat[ranges(starts[codes], counts[codes])]
        sums = np.concatenate([[0], np.cumsum(counts[codes])])
        if len(counts) > STORE_WORDS or len(flat) > 8 * STORE_WORDS:
            self._empty()
        return ids, np.diff(sums[ends])

    def decode(self, ids: np.ndarray) -> bytes:
        v = self.vocabulary
        return v.flat[ranges(v.starts[ids], v.lengths[ids])].tobytes()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of its lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def load(spark, path: str) -> str:
    """The file's text, read where the driver runs; executors get it by broadcast (a vocabulary of some 50,000 entries)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """One for each worker process and vocabulary."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(text))
    return _ENCODERS[key]


def _pieces(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of a batch in pieces of bounded text."""
    doc_ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        doc_ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= most:
            yield doc_ids, texts
            doc_ids, texts, size = [], [], 0
    if doc_ids:
        yield doc_ids, texts


def encode(docs: DataFrame, path: str | None = None, tokens: bool = False) -> DataFrame:
    """Returns doc_id, n_tokens long, ids_sha256, decoded_sha256 and, with ``tokens``, ids array<int> and decoded text.

    A row for each row of ``docs``, repeated rows and null ids too; null text is encoded as an empty one (no
    tokens). A special token's text in a document is that token. Bytes that are no UTF-8 count as U+FFFD.
    Other columns are not looked at; an empty table gives an empty result. No shuffle. ``path``: a tokenizer file,
    by default public_tokenizers.path("byte_bpe_50k.json").
    """
    path = path or public_tokenizers.path(TOKENIZER)
    spark = prepare(docs.sparkSession)
    vocabulary = spark.sparkContext.broadcast(load(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            for doc_ids, texts in _pieces(batch):
                ids, counts = encoder.encode([t.decode("utf-8", "replace") for t in texts])
                stops = np.cumsum(counts)
                each = [ids[a:b] for a, b in zip(stops - counts, stops, strict=True)]
                decoded = [encoder.decode(x) for x in each]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if tokens:
                    columns += [pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if tokens else "")
    return doc_texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
