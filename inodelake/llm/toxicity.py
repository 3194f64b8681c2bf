"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector w for all ordered thresholds theta_1 < theta_2 < ...;
the severity is the expected grade. Features are lower-cased words and their first 4 and 5 bytes (log of one plus the
count), chosen by their log-odds between toxic and other labelled documents, and number and density of strongly toxic words.

Labels are 0/1. Grade 0 is label 0; label 1 is graded 1..``GRADES`` by how many different strongly toxic words a text
has, which is no input of the model, cut at the quantiles of the labelled toxic documents. Labels that contradict each
other for one id are not learned from. The model is fitted on at most ``MAX_TOXIC`` + ``MAX_OTHER`` labelled
documents (those of least hash); features of that sample are counted on the executors, and the driver receives at most
``MAX_FEATURES`` features and the sample's counts of them.

Edge cases: null and empty texts have no features and grade 0; repeated rows are graded alike; null or missing labels
are not learned from; with no toxic label to learn from every grade is 0; an empty table gives an empty result; columns
other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, Hasher, mix, slices, utf8, words
from .spark_io import materialize

GRADES = 3
MAX_TOXIC, MAX_OTHER = 4000, 12000
MAX_FEATURES = 4096
#: A feature is in at least this share of the toxic sample (and in three documents).
MIN_SHARE = 0.005

_BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hash and row of every word and word start; whether it is a whole word; words of each row."""
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, rows = words(data, offsets, _BETWEEN)
    hasher = Hasher(data)
    parts, owners, whole = [hasher(starts, ends)], [rows], [np.ones(len(rows), bool)]
    for n in (4, 5):
        long = ends - starts > n
        parts.append(mix(hasher(starts[long], starts[long] + n) + U64(n)))
        owners.append(rows[long])
        whole.append(np.zeros(int(long.sum()), bool))
    return np.concatenate(parts), np.concatenate(owners), np.concatenate(whole), np.bincount(rows, minlength=len(texts))


@dataclass
class Model:
    """Sorted feature hashes with their weights, which of them are strong, two dense weights, and the thresholds."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    strong: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def __post_init__(self) -> None:
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.hashes & U64(0xFFFF)).astype(np.int64)] = True

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature number and value of the known features; the dense features of each row; its different strong words."""
        n, k = len(texts), len(self.hashes)
        h, r, whole, n_words = _features(texts)
        some = np.flatnonzero(self.first[(h & U64(0xFFFF)).astype(np.int64)]) if k else np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, h[some])
        fits = at < k
        fits[fits] = self.hashes[at[fits]] == h[some][fits]
        some, at = some[fits], at[fits]
        cells, count = np.unique(r[some] * max(k, 1) + at, return_counts=True)
        hits = np.bincount(r[some], self.strong[at] & whole[some], n)
        dense = np.stack([np.log1p(100 * hits / (n_words + 100)), np.log1p(hits)], axis=1)
        rows, own = cells // max(k, 1), cells % max(k, 1)
        return rows, own, np.log1p(count), dense, np.bincount(rows, self.strong[own], n) if k else np.zeros(n)

    def link(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * self.weights[at], len(dense)) + dense @ self.weights[len(self.hashes) :]

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 1, one row for each text."""
        return _sigmoid(self.link(*self.counts(texts)[:4])[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _ordinal(rows: np.ndarray, at: np.ndarray, values: np.ndarray, dense: np.ndarray, grades: np.ndarray, k: int, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the negative log likelihood; gaps between thresholds are exp(.)."""
    n, cuts = len(dense), GRADES
    params = np.zeros(k + dense.shape[1] + cuts)
    params[-cuts] = 1.0
    m = v = np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[: k + dense.shape[1]], np.exp(np.clip(params[len(params) - cuts + 1 :], -5, 5))
        theta = params[-cuts] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(rows, values * w[at], n) + dense @ w[k:]
        below = np.column_stack([np.zeros(n), _sigmoid(theta[None, :] - eta[:, None]), np.ones(n)])
        low, high = below[np.arange(n), grades], below[np.arange(n), grades + 1]
        p = np.maximum(high - low, 1e-9)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        g_eta = (slope_high - slope_low) / p / n
        g_theta = np.zeros(cuts + 2)
        np.add.at(g_theta, grades + 1, -slope_high / p / n)
        np.add.at(g_theta, grades, slope_low / p / n)
        g_theta = g_theta[1:-1]
        g = np.zeros_like(params)
        g[:k] = np.bincount(at, values * g_eta[rows], k)
        g[k : k + dense.shape[1]] = dense.T @ g_eta
        g[: k + dense.shape[1]] += l2 * w
        tails = np.cumsum(g_theta[::-1])[::-1]
        g[-cuts] = tails[0]
        g[len(params) - cuts + 1 :] = tails[1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(np.clip(params[len(params) - cuts + 1 :], -5, 5))
    return params[: k + dense.shape[1]], params[-cuts] + np.concatenate([[0.0], np.cumsum(gaps)])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts (text, toxic), bounded by class; the bounded ids are broadcast, the texts are not moved."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    parts = [known.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in ((1, MAX_TOXIC), (0, MAX_OTHER))]
    few = parts[0].union(parts[1]).withColumnRenamed("doc_id", "label_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    # An id that many rows have counts once, with its least text.
    return materialize(rows.groupBy("label_id", "toxic").agg(F.min("text").alias("text")).select("text", F.col("toxic").cast("int").alias("toxic")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = _sample(docs, labels)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            toxic = np.asarray(batch.column("toxic")).astype(bool)
            h, r, whole, _ = _features(batch.column("text"))
            pairs = np.unique(np.stack([h, r.astype(U64) * U64(2) + whole.astype(U64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), U64)
            owner = (pairs[:, 1] >> U64(1)).astype(np.int64)
            key, first, inverse = np.unique(pairs[:, 0], return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array((pairs[first, 1] & U64(1)).astype(bool)), pa.array(np.bincount(inverse, toxic[owner], len(key)).astype(np.int64)), pa.array(np.bincount(inverse, ~toxic[owner], len(key)).astype(np.int64))],
                names=["h", "whole", "n1", "n0"],
            )

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return Model()
    odds = F.log(((F.col("n1") + 0.5) / (sizes[1] + 1.0)) / ((F.col("n0") + 0.5) / (sizes.get(0, 0) + 1.0)))
    counted = sample.mapInArrow(present, "h long, whole boolean, n1 long, n0 long").groupBy("h").agg(F.max("whole").alias("whole"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    chosen = counted.withColumn("odds", odds).filter((F.col("n1") >= max(3, MIN_SHARE * sizes[1])) & (F.col("odds") > 1.5)).orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "h").limit(MAX_FEATURES).toPandas()
    hashes = chosen["h"].to_numpy(np.int64).view(U64)
    order = np.argsort(hashes)
    model = Model(hashes[order], (chosen["odds"].to_numpy() > 3)[order])
    blank = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            r, at, values, dense, different = blank.value.counts(batch.column("text"))
            first = np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in (at.astype(np.int32), values.astype(np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *lists, pa.array(dense[:, 0]), pa.array(dense[:, 1]), pa.array(different)], names=["toxic", "at", "value", "d0", "d1", "different"])

    rows = sample.mapInArrow(known, "toxic int, at array<int>, value array<double>, d0 double, d1 double, different double").toPandas()
    dense = rows[["d0", "d1"]].to_numpy()
    toxic = rows["toxic"].to_numpy() == 1
    different = rows["different"].to_numpy()
    cuts = np.quantile(different[toxic], np.arange(1, GRADES) / GRADES)
    grades = np.where(toxic, 1 + (different[:, None] > cuts[None, :]).sum(axis=1), 0)
    r = np.repeat(np.arange(len(rows)), rows["at"].map(len))
    at, values = (np.concatenate([*rows[c], np.zeros(0)]) for c in ("at", "value"))
    weights, thresholds = _ordinal(r, at.astype(np.int64), values, dense, grades, len(hashes))
    return Model(model.hashes, model.strong, weights, thresholds)


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (most fitting whole grade), toxic (1 if P(grade >= 1) >= 0.5, else 0),
    one row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            above = sent.value.above(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array((above[:, 0] >= 0.5).astype(np.int32))], names=["doc_id", "severity", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(grade, f"doc_id {kind}, severity double, grade int, toxic int")


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def civil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(sent.value.above(batch.column("text"))[:, 0] < 0.5))

    return docs.mapInArrow(civil, docs.schema)
