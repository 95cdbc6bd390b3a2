"""Quality classifier: hashed word n-grams, logistic regression, FTRL.

A text's words give two sequences: the lower-cased words and their shapes
(runs of capitals, small letters, digits; other signs as they are; always of the
whole word, however long; a word equal to the one before has the shape "same"). Word 1- and 2-grams and shape 1- to
3-grams are hashed into ``2**BITS`` weights; each kind of n-gram counts with its
share of the text's n-grams of that kind, so long and short texts compare.

Training: follow-the-regularised-leader (proximal) updates over a bounded,
documented sample of labelled rows: the ``max_rows`` rows with the smallest
hash of their identifier. Features of the sample are made in parallel; the
bounded sample is then learnt in one task in hash order, so reruns agree. The
weights (a fixed 2**BITS floats) go to every executor; a score is one sparse
dot product per text. Scoring is row-wise: no shuffle.

Defined results: a null or empty text has no n-grams and scores by the bias
alone. Labels other than 0 and 1 and null identifiers or labels are not learnt
from; an identifier with both labels is not learnt from either. Without any
label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, append, text_slices, without

BITS = 18
SAMPLE_ROWS = 12_000
EPOCHS = 4
MEMO_WORDS = 100_000
PIECE_CHARS = 1 << 16
_SAME = np.uint64(0x9E3779B97F4A7C15)
_ODD = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def shape_parts(word: str) -> Iterator[str]:
    """The shape of the whole word, piece by piece."""
    before = ""
    for at in range(0, len(word), PIECE_CHARS):
        out = []
        for ch in word[at:at + PIECE_CHARS]:
            kind = "9" if ch.isdigit() else ("X" if ch.isupper() else "x") if ch.isalpha() else ch
            if kind != before:
                out.append(kind)
                before = kind
        yield "".join(out)


def shape(word: str) -> str:
    """Kinds of characters in order, repeats dropped; e.g. ``Abc!!`` is ``Xx!``."""
    return "".join(shape_parts(word))


class Featuriser:
    def __init__(self):
        self.memo: dict[bytes, tuple[int, int]] = {}

    def _hashes(self, word: bytes) -> tuple[int, int]:
        text = word.decode("utf-8", "replace")
        shapes = xxhash.xxh64(seed=2)
        for part in shape_parts(text):
            shapes.update(part.encode())
        return xxhash.xxh64_intdigest(text.lower().encode(), 1), shapes.intdigest()

    def sequences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode().split()
        memo = self.memo
        missing = set(words).difference(memo)
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = set(words)
        for w in missing:
            memo[w] = self._hashes(w)
        got = np.array([memo[w] for w in words], np.uint64).reshape(-1, 2)
        own, shapes = got[:, 0], got[:, 1].copy()
        shapes[1:][own[1:] == own[:-1]] = _SAME
        return own, shapes

    def features(self, text: str) -> list[np.ndarray]:
        """Hashed n-grams of each kind (repeats kept)."""
        own, shapes = self.sequences(text)
        down = np.uint64(64 - BITS)
        out = []
        for kind, (seq, n) in enumerate(((own, 1), (own, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
            if len(seq) < n:
                continue
            h = np.full(len(seq) - n + 1, kind + 1, np.uint64)
            for j in range(n):
                h = (h ^ seq[j:len(seq) - n + 1 + j]) * _ODD[j]
                h ^= h >> np.uint64(29)
            out.append(((h * _ODD[2]) >> down).astype(np.int64))
        return out

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values): shares summed where n-grams meet in one weight."""
        kinds = self.features(text)
        if not kinds:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.concatenate(kinds)
        share = np.concatenate([np.full(len(k), 1.0 / len(k)) for k in kinds])
        idx, inverse = np.unique(at, return_inverse=True)
        return idx, np.bincount(inverse, share)


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression with a bias."""

    def __init__(self, alpha=2.0, beta=0.1, l1=1e-4, l2=1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, idx: np.ndarray, val: np.ndarray, label: int) -> None:
        at, x = np.append(idx, 1 << BITS), np.append(val, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


def fit_quality(labelled: DataFrame, text_col: str = "text", label_col: str = "quality",
                order_col: str = "order", epochs: int = EPOCHS) -> np.ndarray:
    """Weights (2**BITS and the bias last) from rows (order, text, label); the
    caller bounds the number of rows."""
    rows = labelled.select(F.col(order_col).cast("long").alias("o"),
                           F.col(label_col).cast("int").alias("y"),
                           F.col(text_col).alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feat = Featuriser()
        for part in text_slices(batches, "text"):
            got = [feat.sparse(t or "") for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1),
                 pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())],
                ["o", "y", "idx", "val"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(o, y, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32))
                for b in batches for o, y, i, v in zip(*(c.to_pylist() for c in b.columns))]
        data.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = Ftrl()
        for _ in range(epochs):
            for _, y, i, v in data:
                model.learn(i, v.astype(float), y)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["w"])

    made = (rows.mapInArrow(featurise, "o long, y int, idx binary, val binary")
            .repartition(1).mapInArrow(learn, "w binary").first())
    return np.frombuffer(made["w"], np.float32).astype(float)


def score_quality(df: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    rows = without(df, {"score", "predicted"} - {text_col})
    shipped = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feat, w = Featuriser(), shipped.value
        for part in text_slices(batches, text_col):
            out = [sigmoid(w[-1] + sum(float(w[k].mean()) for k in feat.features(t or "")))
                   for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
            yield append(part, score=pa.array(out, pa.float64()),
                         predicted=pa.array([int(s >= 0.5) for s in out], pa.int32()))

    return rows.mapInArrow(run, added(rows, ("score", T.DoubleType()),
                                      ("predicted", T.IntegerType())))


def fold_of(id_col: str):
    """crc32 of the identifier as text, modulo 3; null stays null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_sample(documents: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS,
                    id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", held_out: int = 1) -> DataFrame:
    """(order, text, label) of at most ``max_rows`` labelled documents outside
    the held-out fold: those with the smallest hash of the identifier."""
    known = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y"))
             .filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1)
                     & (fold_of("__id") != held_out))
             .groupBy("__id").agg(F.min("__y").alias("quality"), F.max("__y").alias("__most"))
             .filter("quality = __most").drop("__most")
             .withColumn("order", F.xxhash64(F.lit(9), F.col("__id")))
             .orderBy("order", "__id").limit(max_rows))
    # at most max_rows rows: a proven bound
    return (documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
            .join(F.broadcast(known), "__id").select("order", "text", "quality"))


def quality_scores(documents: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels' sample, then score every whole document."""
    weights = fit_quality(training_sample(documents, labels, max_rows, id_col, text_col))
    return score_quality(documents, weights, text_col)
