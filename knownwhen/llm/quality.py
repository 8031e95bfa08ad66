"""Document quality by Bradley-Terry ranking.

A document's strength is linear in features of its text. From all pairs of labelled documents, one
preferred to the other, the weights are learnt by logistic loss on the difference of the two
feature vectors. A threshold at a quantile of the strengths of all labelled documents then turns
the ranking into a decision.

No row is drawn: labelled rows are grouped into cells of like strength, of which sums are taken in Spark, and
the loss of all pairs of rows follows from all pairs of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownwhen.llm import words
from knownwhen.llm.labelled import learnable
from knownwhen.llm.tables import held_out, prepare, written

#: Cells of strengths: for the loss of all pairs, and as cuts.
CELLS = 128
CUTS = 1 << 14
STEPS = 15
DECAY = 1e-3
#: Features are learnt from in steps of this size, so that sums are exact in any order.
GRAIN = 2.0**-10

_BYTES = np.arange(256)


def _among(*kinds) -> np.ndarray:
    return np.isin(_BYTES, [b for k in kinds for b in k]).astype(np.float64)


#: Classes of bytes whose share of a text is a feature.
CLASSES = {
    "upper": _among(range(65, 91)),
    "digit": _among(range(48, 58)),
    "line end": _among(b"\n"),
    "space": _among(b" \t"),
    "stop": _among(b".,;:"),
    "shout": _among(b"!?"),
    "bar": _among(b"|<>{}[]=_\\/~^"),
    "sign": _among(b"#$%&*@+"),
    "control": _among(range(9), range(14, 32), [127]),
    "beyond ASCII": _among(range(128, 256)),
}
NAMES = (*CLASSES, "words", "letters a word", "distinct words", "words repeated at once", "longest word", "capital words", "distinct lines", "plain words")
_TABLE = np.stack(list(CLASSES.values()), axis=1)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of numbers for each text; a text without words has zeros but for its bytes."""
    w = words.split(texts, lower=False)
    n, size = len(texts), np.diff(w.offsets)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    count = np.bincount(owner, minlength=n)
    some = np.maximum(count, 1)
    # Byte shares, from a histogram of bytes by text.
    where = np.repeat(np.arange(n, dtype=np.int64), size)
    histogram = np.bincount(where << 8 | w.data, minlength=n << 8).reshape(n, 256)[:, :256]
    shares = histogram @ _TABLE / np.maximum(size, 1)[:, None]
    lengths = w.ends - w.starts
    h = words.hashes(w)
    again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    by_owner = lambda x: np.bincount(owner, weights=x, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, lengths)
    capital = (w.data[w.starts] >= 65) & (w.data[w.starts] <= 90) if len(w.starts) else np.zeros(0, bool)
    # A word's last byte but one before a stop is a letter in plain prose.
    last = w.data[w.ends - 1] if len(w.starts) else np.zeros(0, np.uint8)
    plain = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | np.isin(last, list(b".,"))
    lines = words.split(texts, _BYTES == 10, lower=False)
    line_owner = np.repeat(np.arange(n), np.diff(lines.first))
    line_count = np.bincount(line_owner, minlength=n)
    distinct = np.bincount(np.unique(np.stack([line_owner.astype(np.uint64), words.hashes(lines)]), axis=1)[0].astype(np.int64), minlength=n) if len(line_owner) else np.zeros(n)
    rest = [
        np.log1p(count),
        by_owner(lengths) / some,
        np.bincount(owner[order][fresh], minlength=n) / some ** 0.7,
        np.bincount(owner[1:][again], minlength=n) / some,
        np.log1p(longest),
        by_owner(capital) / some,
        distinct / np.maximum(line_count, 1),
        by_owner(plain) / some,
    ]
    return np.concatenate([np.sqrt(shares), np.stack(rest, axis=1)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The chance to be preferred to a document that stands at the threshold."""
        return self.chance(features(texts))

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin = self.strength(x) - self.threshold
        return np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 6)


Part = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _cell(strength: np.ndarray, reach: float, cells: int) -> np.ndarray:
    """Cells of equal width from -reach to reach; the outer ones hold what is beyond."""
    return np.clip(np.floor((strength / reach + 1) * cells / 2), 0, cells - 1).astype(np.int64)


def _moments(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows of each class, sums and sums of squares of the features."""
    return np.concatenate([[(labels == 0).sum(), (labels == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)])


def _cell_sums(model: Model, reach: float) -> Part:
    """Of each class and cell: rows, sums of the features and of their products."""

    def part(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        z, width = model.standard(x), x.shape[1]
        out = np.zeros((2 * CELLS, 1 + width + width * width))
        where = labels.astype(np.int64) * CELLS + _cell(z @ model.weights, reach, CELLS)
        z = np.round(z / GRAIN) * GRAIN
        for k in np.unique(where):
            here = z[where == k]
            out[k] = np.concatenate([[len(here)], here.sum(axis=0), (here.T @ here).ravel()])
        return out

    return part


def _counts(model: Model, reach: float) -> Part:
    """Rows of each class by fine cells of strength."""

    def part(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return np.bincount(labels.astype(np.int64) * CUTS + _cell(model.strength(x), reach, CUTS), minlength=2 * CUTS).astype(np.float64)

    return part


def learn(total: Callable[[Part], np.ndarray], width: int = len(NAMES)) -> Model:
    """Newton's steps on the mean logistic loss of all pairs of a good and a bad row; ``total`` adds up a function of parts of the rows."""
    moments = total(_moments)
    bad, good = moments[:2]
    if not bad or not good:
        return Model(np.zeros(width), np.ones(width), np.zeros(width))
    rows = bad + good
    # Rounded, so that the order of adding does not show.
    mean = np.array([float(f"{v:.9g}") for v in moments[2 : 2 + width] / rows])
    spread = np.array([float(f"{v:.6g}") for v in np.sqrt(np.maximum(moments[2 + width :] / rows - mean * mean, 0))])
    model = Model(mean, np.where(spread > 1e-6, spread, 1.0), np.zeros(width))
    square, reach = None, 1.0
    for _ in range(STEPS):
        sums = total(_cell_sums(model, reach)).reshape(2, CELLS, -1)
        n, first, second = sums[:, :, 0], sums[:, :, 1 : 1 + width], sums[:, :, 1 + width :].reshape(2, CELLS, width, width)
        square = second.sum(axis=(0, 1)) / rows
        middle = first @ model.weights / np.maximum(n, 1)
        # Of each pair of cells, good by bad: the chance that the bad one is preferred.
        lost = 1 / (1 + np.exp(np.clip(middle[1][:, None] - middle[0][None], -30, 30)))
        bend = lost * (1 - lost)
        grad = DECAY * model.weights - ((lost @ n[0]) @ first[1] - (lost.T @ n[1]) @ first[0]) / (good * bad)
        cross = first[1].T @ bend @ first[0]
        curve = np.tensordot(bend @ n[0], second[1], 1) + np.tensordot(bend.T @ n[1], second[0], 1) - cross - cross.T
        step = np.linalg.solve(curve / (good * bad) + DECAY * np.eye(width), grad)
        model.weights = model.weights - step * min(1.0, 4 / max(np.linalg.norm(step), 1e-12))
        reach = max(6 * float(np.sqrt(model.weights @ square @ model.weights)), 1e-6)
        if np.linalg.norm(step) < 1e-2:
            break
    model.threshold = threshold(total(_counts(model, reach)).reshape(2, CUTS), reach)
    return model


def threshold(counts: np.ndarray, reach: float) -> float:
    """Of the borders of the cells the one whose cut has the highest balanced accuracy; of equals the middle one."""
    below = np.cumsum(counts, axis=1)[:, :-1] / counts.sum(axis=1, keepdims=True)
    accuracy = (1 - below[1] + below[0]) / 2
    best = np.flatnonzero(accuracy >= accuracy.max() - 1e-12)
    return float((2 * (best[len(best) // 2] + 1) / CUTS - 1) * reach)


def train(x: np.ndarray, labels: np.ndarray) -> Model:
    """The model of rows that are at hand."""
    x = x if x.size else np.zeros((0, len(NAMES)))
    return learn(lambda part: part(x, np.asarray(labels)), x.shape[1])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and features of the whole text of each row, written once: what is learnt from and what is scored."""

    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array([r for part in words.pieces(texts) for r in features(part)], pa.list_(pa.float64()))

    return written(docs.select("doc_id", numbers(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("x")))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(len(x), len(NAMES))


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labelled rows of ``counted`` that are not held out; only sums reach the driver."""
    rows = written(learnable(rows, labels, "quality").select("label", "x"))

    def total(part: Part) -> np.ndarray:
        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = sum(part(_matrix(b["x"]), b["label"].to_numpy()) for b in batches)
            if isinstance(out, np.ndarray):
                yield pa.RecordBatch.from_pydict({"sums": [out.ravel().tobytes()]})

        sums = rows.mapInArrow(added, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
        nothing = part(np.zeros((0, len(NAMES))), np.zeros(0, np.int64)).ravel()
        return sums.treeAggregate(nothing, np.add, np.add)

    return learn(total)


def scorer(spark: SparkSession, model: Model):
    """A vectorised function from features to the score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.chance(_matrix(x)), pa.float64())

    return quality


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Returns doc_id, held_out boolean, score double, predicted int (score >= 0.5, the quantile's cut).

    A row for each row of ``docs``, repeated rows and null ids too (those are not held out); null and empty
    texts have the score of a text without words. Without labelled rows of both kinds every score is 0.5.
    Columns other than doc_id and text are not looked at. Texts stay where they are: features, 18 numbers a
    row, meet the labels.
    """
    spark = prepare(docs.sparkSession)
    rows = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = rows.withColumn("score", scorer(spark, fit(rows, labels))("x"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
