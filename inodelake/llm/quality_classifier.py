"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line with a word gets features of its own and of its neighbours; two states (bad, good) with transition weights.
Forward-backward marginals, weighted by line length, are aggregated to the document and calibrated by a logistic
regression. Documents' labels are the lines' training labels. Fitted on at most ``MAX_DOCS`` labelled documents (those
of least hash, crc32(doc_id) mod 3 other than 1) and ``MAX_LINES`` of their lines in whole documents, each of up to ``DOC_LINES``.

Edge cases: null, empty and blank texts have no line and score 0; repeated rows score alike; null labels are not
learned from; with nothing to learn from (no label, or one class only) every score is 0.5 (0 without a line); an empty
table gives an empty result. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import Hasher, slices, utf8, words
from .spark_io import materialize

MAX_DOCS, MAX_LINES = 8000, 400_000
#: A document with more line ends is not learned from, so that one alone cannot use up the lines of all.
DOC_LINES = 4_000

_CLASS = {
    "symbol": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>@^~_={}[]\\+", np.uint8)),
    "digit": np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8)),
    "upper": np.isin(np.arange(256), np.arange(0x41, 0x5B)),
    "pipe": np.isin(np.arange(256), np.frombuffer(b"|<>{}", np.uint8)),
    "stop": np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8)),
    "comma": np.isin(np.arange(256), np.frombuffer(b",;:", np.uint8)),
}
N_OWN = 14
N_FEATURES = 3 * N_OWN + 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, N_FEATURES), row and length in bytes of every line that has a word."""
    data, offsets = utf8(texts)
    starts, ends, rows = words(data, offsets)
    if not len(starts):
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0)
    breaks = np.flatnonzero(data == 0x0A)
    key = np.searchsorted(breaks, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
    line = np.cumsum(new) - 1
    n = line[-1] + 1
    first = np.flatnonzero(new)
    row = rows[first]
    left, right = starts[first], ends[np.append(first[1:], len(starts)) - 1]
    size = (right - left).astype(float)
    count = np.bincount(line, minlength=n).astype(float)
    sums = {k: np.concatenate([[0], np.cumsum(c[data])]) for k, c in _CLASS.items()}
    share = {k: (s[right] - s[left]) / size for k, s in sums.items()}
    h = Hasher(data)(starts, ends)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    distinct = np.ones(len(h), bool)
    distinct[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    lengths = (ends - starts).astype(float)
    symbol_end = _CLASS["symbol"][data[ends - 1]].astype(float)
    mean = np.bincount(line, lengths, n) / count
    own = np.stack(
        [
            np.log1p(count) / 4, mean / 8, np.sqrt(np.maximum(np.bincount(line, lengths**2, n) / count - mean**2, 0)) / 4,
            share["symbol"] * 4, share["digit"] * 4, share["upper"] * 4, share["pipe"] * 8, share["stop"] * 8, share["comma"] * 8,
            np.bincount(line, again, n) / count * 2, np.bincount(line[order], distinct, n) / count, np.bincount(line, symbol_end, n) / count * 2,
            _CLASS["stop"][data[right - 1]].astype(float), _CLASS["upper"][data[left]].astype(float),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = row[1:] == row[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    starts_text, ends_text = np.ones(n), np.ones(n)
    starts_text[1:][same] = 0
    ends_text[:-1][same] = 0
    return np.hstack([own, before, after, np.ones((n, 1)), starts_text[:, None], ends_text[:, None]]), row, size


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(score: np.ndarray, row: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the expected transitions (2, 2) over all chains; ``score`` is the log-odds of good.
    All chains advance together, the longest first, so that step t works on the chains longer than t."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(row)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    open_ = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    unary = np.stack([np.zeros(len(score)), score], axis=1)
    ahead, back = unary.copy(), np.zeros_like(unary)
    for t in range(1, len(open_)):
        at = first[: open_[t]] + t
        ahead[at] += _log_sum(ahead[at - 1][:, :, None] + move[None], 1)
    total = np.zeros((2, 2))
    for t in range(len(open_) - 1, 0, -1):
        at = first[: open_[t]] + t
        onward = (unary[at] + back[at])[:, None, :] + move[None]
        back[at - 1] = _log_sum(onward, 2)
        joint = ahead[at - 1][:, :, None] + onward
        joint -= _log_sum(joint.reshape(len(at), 4), 1)[:, None, None]
        total += np.exp(joint).sum(axis=0)
    both = ahead + back
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), total


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def documents(self, x: np.ndarray, row: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Aggregates of every row (n, 4), and whether it has a line."""
        good, _ = marginals(x @ self.weights, row, self.move)
        total = np.bincount(row, size, n)
        mean = np.clip(np.bincount(row, size * good, n) / np.maximum(total, 1), 1e-4, 1 - 1e-4)
        worst = np.ones(n)
        np.minimum.at(worst, row, good)
        worst = np.clip(worst, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(n), np.log(mean / (1 - mean)), np.log(worst / (1 - worst)), np.log1p(total) / 8], axis=1), total > 0

    def scores(self, texts: pa.Array) -> np.ndarray:
        z, some = self.documents(*line_features(texts), len(texts))
        return np.where(some, 1 / (1 + np.exp(-np.clip(z @ self.calibration, -500, 500))), 0.0)


def _adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m = v = np.zeros_like(x)
    for step in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x


def fit(docs: DataFrame, labels: DataFrame, l2: float = 1e-4, steps: int = 150) -> Model:
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    few = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(MAX_DOCS).withColumnRenamed("doc_id", "label_id")
    labelled = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    # An id that many rows have counts once, with its least text.
    sample = materialize(labelled.groupBy("label_id", "quality").agg(F.min("text").alias("text")).select("label_id", "text", F.col("quality").cast("int").alias("quality")))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, row, size = line_features(batch.column("text"))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(first * N_FEATURES), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("quality"), flat, pa.ListArray.from_arrays(pa.array(first), pa.array(size))], names=["id", "y", "x", "size"])

    rows = sample.mapInArrow(lines, f"id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<float>, size array<double>")
    # Whole documents in order of hash up to the bound; a running sum over at most MAX_DOCS rows of two numbers.
    small = sample.select("label_id", F.regexp_count("text", F.lit("\n")).alias("k")).filter(F.col("k") < DOC_LINES)
    order = Window.orderBy(F.xxhash64("label_id", F.lit("quality")), "label_id")
    fits = small.withColumn("upto", F.sum(F.col("k") + 1).over(order)).filter(F.col("upto") <= MAX_LINES)
    rows = rows.join(F.broadcast(fits.select(F.col("label_id").alias("id"))), "id", "left_semi")
    got = rows.orderBy("id").toPandas()
    y = got["y"].to_numpy()
    got = got if len(np.unique(y)) == 2 else got.iloc[:0]
    if not len(got):
        return Model()
    size = np.concatenate(list(got["size"]))
    x = np.concatenate(list(got["x"])).reshape(-1, N_FEATURES).astype(np.float64)
    row = np.repeat(np.arange(len(got)), got["size"].map(len))
    truth = y[row]
    same = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:-1][same], truth[1:][same]), 1)
    def gradient(p: np.ndarray) -> np.ndarray:
        good, moves = marginals(x @ p[:-4], row, p[-4:].reshape(2, 2))
        return np.concatenate([x.T @ (good - truth), (moves - seen).ravel()]) / len(truth) + l2 * p

    p = _adam(gradient, np.zeros(N_FEATURES + 4), steps, 0.1)
    model = Model(p[:-4], p[-4:].reshape(2, 2))
    z, some = model.documents(x, row, size, len(got))
    z, t = z[some], y[some]

    def logistic(c: np.ndarray) -> np.ndarray:
        return z.T @ (1 / (1 + np.exp(-np.clip(z @ c, -500, 500))) - t) / len(t) + 1e-4 * c

    model.calibration = _adam(logistic, np.array([0.0, 1.0, 0.0, 0.0]), 400, 0.05)
    return model


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = sent.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
