"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Words are runs of letters (lower case), of digits, and of other symbols; a mark follows each word written in
capitals. Features are the words and the pairs of neighbours (a pair of equal words is one feature, whatever the
word), hashed to 2**bits places, counted over the whole text and scaled to length 1. A score is the logistic function of
a sparse dot product.

Training reads a bounded sample of the labelled rows: `train_rows` at most, half of each label, those whose ids hash
lowest. The sample is trained in one task whose size that bound limits; the weights (2**bits floats) are broadcast.
Everything is scored.

Null and empty texts have no feature but the bias, and get the bias's score. Rows whose label is null are
not trained on; several labels of one id count as their smallest. Without any labelled row every score is 0.5.
Very long texts are read whole. Repeated rows are scored alike; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, windows

_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Hashes of the marks: a word in capitals, a pair of equal words.
_CAPITALS, _SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Featuriser:
    """Texts to (places, values) of their hashed n-grams. Keeps the words of recent chunks, up to `keep`."""

    def __init__(self, bits: int, keep: int = 400_000):
        self.bits, self.keep, self.memo = bits, keep, {}

    def _words(self, chunk: bytes) -> np.ndarray:
        found = []
        for word in _WORD.findall(chunk.decode("utf-8", "replace")):
            found.append(xxhash.xxh64_intdigest(word.lower()))
            if len(word) > 1 and word.isalpha() and word.isupper():
                found.append(int(_CAPITALS))
        return np.array(found, np.uint64)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        memo = self.memo
        if len(memo) > self.keep:
            memo.clear()
        words = []
        for chunk in text.split():
            known = memo.get(chunk)
            if known is None:
                known = memo[chunk] = self._words(chunk)
            words.append(known)
        h = np.concatenate(words) if words else np.zeros(0, np.uint64)
        pairs = np.where(h[1:] == h[:-1], _SAME, (h[:-1] * _MIX) ^ (h[1:] + (h[:-1] >> np.uint64(7))))
        every = np.concatenate([h, pairs * _MIX])
        places, n = np.unique((every >> np.uint64(64 - self.bits)).astype(np.int64), return_counts=True)
        values = n / np.sqrt(np.dot(n, n)) if len(n) else n.astype(float)
        return places, values


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 5, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """The weights; the last one is the bias. Per-coordinate rates, L1 by lazy weights."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    bias = 1 << bits
    ready = [(np.append(p, bias), np.append(v, 1.0), y) for p, v, y in rows]
    for _ in range(epochs):
        for places, values, y in ready:
            w = weights(places)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - y) * values
            sigma = (np.sqrt(n[places] + g * g) - np.sqrt(n[places])) / alpha
            z[places] += g - sigma * w
            n[places] += g * g
    return weights(np.arange(bias + 1))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 18, train_rows: int = 8000) -> np.ndarray:
    """Weights from a bounded sample of the labelled rows."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    sampled = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2)
        sampled = part if sampled is None else sampled.union(part)
    texts = text_bytes(docs, text_col, F.col(id_col).alias("doc_id"))
    rows = texts.join(F.broadcast(sampled), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = Featuriser(bits), []
        for batch in windows(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                places, values = of(text)
                held.append((places.astype(np.int32), values.astype(np.float32), label))
        w = train_ftrl(held, bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["w"])

    found = rows.select("text", "label").mapInArrow(train, "w binary").collect()
    return np.frombuffer(bytes(found[0].w), np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row of docs."""
    bits = int(len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, w = Featuriser(bits), shared.value.astype(np.float64)
        for batch in windows(batches):
            z = []
            for text in batch.column("text").to_pylist():
                places, values = of(text)
                z.append(w[places] @ values + w[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -35, 35))), pa.float64())], ["doc_id", "score"])

    return text_bytes(docs, text_col, F.col(id_col).cast("long").alias("doc_id")).mapInArrow(score, "doc_id long, score double")
