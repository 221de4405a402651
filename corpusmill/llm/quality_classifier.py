"""Quality classifier: logistic regression on hashed word n-grams, learned by
follow-the-regularised-leader updates and scored as sparse dot products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.hashing import word_hashes
from corpusmill.llm.labelled import held_out, labelled_sample

BITS = 18


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of a text's word 1- and 2-grams and of its shape, with values.

    Values are log counts of unit length. Word hashes come from whole texts; an
    empty text has the shape features alone.
    """
    raw = (text or "").encode("utf-8", "replace")
    h = word_hashes(raw)
    grams = np.concatenate([h, _mix(h[1:] * np.uint64(3) + h[:-1])]) if len(h) else h
    at, n = np.unique((grams >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    value = np.log1p(n)
    value /= np.sqrt((value**2).sum()) or 1
    b = np.frombuffer(raw, np.uint8)
    size, count = max(len(b), 1), max(len(h), 1)
    upper = ((b >= 65) & (b <= 90)).sum() / size
    digit = ((b >= 48) & (b <= 57)).sum() / size
    other = ((b > 32) & (b < 127)).sum() / size - upper - digit - ((b >= 97) & (b <= 122)).sum() / size
    distinct = len(np.unique(h)) / count
    shape = np.minimum([1.0, upper * 2, digit * 4, other * 4, distinct, np.log1p(len(h)) / 10, len(b) / count / 20], 2.0)
    return np.concatenate([at + len(shape), np.arange(len(shape))]), np.concatenate([value, shape]).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x9E3779B97F4A7C15)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, passes: int = 3) -> np.ndarray:
    """Weights after ``passes`` over the rows in the given order.

    Each coordinate keeps the sum of its adjusted gradients and of their squares; its
    weight is the minimiser of the regularised sum, zero inside the l1 bound. Both labels
    weigh the same in total.
    """
    size = (1 << BITS) + 16
    z, n = np.zeros(size), np.zeros(size)
    ones = sum(y for *_, y in rows)
    weight = {1: len(rows) / (2 * max(ones, 1)), 0: len(rows) / (2 * max(len(rows) - ones, 1))}

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for at, value, label in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value * weight[label]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = 8000) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled documents outside the held-out fold.

    Documents become sparse vectors where they lie; only those, bounded by ``rows``,
    meet in one task, in the order of a hash of their ids. Without a labelled row all
    weights are zero, and every score is a half.
    """
    sample = labelled_sample(docs, labels, label, rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = zip(*(features(x) for x in batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("label"), pa.array([x.astype("<i4").tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())],
                names=["id", "label", "at", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x["at"], "<i4"), np.frombuffer(x["value"], "<f4"), x["label"]) for b in batches for x in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([learn(rows).tobytes()], pa.binary())], names=["weights"])

    sparse = sample.mapInArrow(vectors, "id string, label int, at binary, value binary")
    ordered = sparse.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(5), "id"), "id", "at")
    found = ordered.mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(found[0][0], "<f4") if found else np.zeros((1 << BITS) + 16, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted per row, from the text alone.

    The weights, 1 MB whatever the corpus, go to the tasks in the function. Null and
    empty texts get the score of the constant features; rows of null or repeated id are
    scored one by one, a null id counts as not held out.
    """
    kind = docs.schema[id_col].dataType

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                at, value = features(text.as_py())
                out[i] = 1 / (1 + np.exp(-np.clip(float(weights[at] @ value), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(out)], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(scored, f"id {kind.simpleString()}, held_out boolean, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
