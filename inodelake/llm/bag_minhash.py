"""MinHash near-duplicates: BagMinHash over five-word shingles with their counts, banding, exact verification, classes.

Signature. A shingle of weight w (its count) owns Poisson processes of rate 1 per unit of weight over the weight axis,
cut hierarchically into the dyadic intervals [0,1), [1,2), [2,4), ...; a point of an interval counts if its weight
coordinate lies below w. Every point falls on one of ``M`` signature places, which keep their earliest arrival. Equal
places then have the probability of the weighted Jaccard similarity. Arrivals later than a document's horizon cannot
matter once all places are filled, so about M (ln M + 3) points are drawn whatever the document's length.

Links. Equal texts are one node (128-bit digest). Nodes that share a band of ``ROWS`` places are candidates, and each
link is verified on the multisets of shingles themselves: sum of least counts / sum of largest counts >= threshold.
Inside a bucket no pairs are listed at first: each node is verified against leaders of its buckets (``near_graph``).
Nodes that then still lie in different classes of one bucket are joined by an exact prefix filter on their rarest
shingles, so that a crowd of texts around one common passage is not paired with itself.

Edge cases: a text without words (null, empty) is in a class of its own node and is never a duplicate; a text of one
to four words has one shingle; repeated rows and exact copies share a class; an empty table gives an empty result;
null ids stay null and class_id is the least non-null id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_graph
from .arrow_text import U64, Hasher, mix, shingles, slices, unit, utf8, words
from .spark_io import materialize, packed, unpacked

M = 128
BANDS, ROWS = 21, 6
THRESHOLD = 0.8
#: Size of the shingle frequency table (8 MB, whatever the input).
CELLS = 1 << 20


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle hash and count of every distinct shingle of every row, sorted by row."""
    data, offsets = utf8(texts)
    starts, ends, rows = words(data, offsets)
    h, r = shingles(Hasher(data)(starts, ends), rows, len(texts))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    return r[first], h[first], np.diff(np.append(first, len(h)))


def signatures(rows: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """(n, m) earliest arrivals; rows without items keep infinity."""
    out = np.full(n * m, np.inf)
    parts = [(rows, items, np.ones(len(rows)), np.ones(len(rows)))]
    step = 1
    while (more := weights > step).any():
        rows_, items_, w = rows[more], items[more], weights[more]
        parts.append((rows_, mix(items_ ^ U64(0xA5A5 + step)), np.full(len(w), float(step)), np.minimum(w - step, step) / step))
        rows, items, weights = rows_, items_, w
        step *= 2
    r, seed, rate, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    total = np.bincount(r, rate * share, n)
    filled = total > 0
    horizon = np.where(filled, m * (np.log(m) + 3) / np.maximum(total, 1e-9), 0.0)
    k = np.zeros(len(r), U64)
    draw = mix(seed)
    at = -np.log(unit(draw)) / rate
    todo = np.flatnonzero(at <= horizon[r])
    while True:
        while len(todo):
            own = mix(draw[todo] + U64(0x51ED))
            counts = unit(mix(own)) <= share[todo]
            hit = todo[counts]
            np.minimum.at(out, r[hit] * m + (own[counts] % U64(m)).astype(np.int64), at[hit])
            k[todo] += U64(1)
            draw[todo] = mix(seed[todo] + k[todo] * U64(0x9E3779B97F4A7C15))
            at[todo] += -np.log(unit(draw[todo])) / rate[todo]
            todo = todo[at[todo] <= horizon[r[todo]]]
        short = filled & np.isinf(out.reshape(n, m)).any(axis=1)
        if not short.any():
            return out.reshape(n, m)
        horizon[short] *= 2
        todo = np.flatnonzero(short[r] & (at <= horizon[r]))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n = batch.num_rows
        r, h, c = _counted(batch.column("text"))
        bits = signatures(r, h, c, n).view(U64)
        some = np.bincount(r, minlength=n) > 0
        acc = np.arange(1, BANDS + 1, dtype=U64)[None, :] + np.zeros((n, 1), U64)
        for k in range(ROWS):
            acc = mix(acc ^ bits[:, k : BANDS * ROWS : ROWS])
        flat = pa.array(acc[some].view(np.int64).ravel())
        offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), flat)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), bands], names=["doc_id", "digest", "bands"])


def digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the multisets of shingles of two texts overlap enough."""
    n, out = len(a), []
    for at in range(0, n, 64):
        left, right = pa.array(a[at : at + 64], pa.large_string()), pa.array(b[at : at + 64], pa.large_string())
        r, h, c = _counted(pa.concat_arrays([left, right]))
        k = len(left)
        side, pair = r >= k, r % k
        order = np.lexsort((side, h, pair))
        h, pair, c = h[order], pair[order], c[order]
        same = np.flatnonzero((h[1:] == h[:-1]) & (pair[1:] == pair[:-1]))
        both = np.bincount(pair[same], np.minimum(c[same], c[same + 1]), k)
        every = np.bincount(pair, c, k) - both
        out.append((every > 0) & (both >= least.iloc[0] * every - 1e-9))
    return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of the nodes in ``wanted`` (id), each text from one document."""
    named = nodes.select("id", "digest", "doc_id").join(wanted, "id", "left_semi")
    named = named.select("id", F.col("digest").alias("n_digest"), F.col("doc_id").alias("n_doc"))
    own = docs.select(F.col("doc_id").alias("t_doc"), "text", digest().alias("t_digest"))
    texts = own.join(named, (own["t_digest"] == named["n_digest"]) & own["t_doc"].eqNullSafe(named["n_doc"]))
    return texts.dropDuplicates(["id"]).select("id", "text")


def _buckets(nodes: DataFrame) -> DataFrame:
    each = nodes.select("id", F.posexplode("bands").alias("band", "h"))
    return each.select(F.xxhash64("band", "h").alias("bucket"), "id")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many nodes hold a shingle of each cell of the frequency table."""
    for batch in slices(batches, "text"):
        _, h, _ = _counted(batch.column("text"))
        cells, n = np.unique((h & U64(CELLS - 1)).astype(np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "n"])


def _prefixes(frequency, threshold: float):
    """A function that sends each node's rarest shingles: those that any link must share one of."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        for batch in slices(batches, "text"):
            r, h, c = _counted(batch.column("text"))
            # The k-th occurrence of a shingle is a token of its own, so multisets become sets.
            first = np.cumsum(c) - c
            k = (np.arange(c.sum()) - np.repeat(first, c)).astype(U64)
            r, h = np.repeat(r, c), np.repeat(h, c)
            f = often[(h & U64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((k, h, f, r))
            r, token = r[order], mix(h[order] + mix(k[order] + U64(0xD1CE)))
            size = np.bincount(r, minlength=batch.num_rows)
            at = np.arange(len(r)) - (np.cumsum(size) - size)[r]
            n = size[r]
            # As the shorter text of a link, as the longer one.
            short = at <= n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-6)
            long = at <= n - np.ceil(threshold * n - 1e-6)
            ids = batch.column("id").to_numpy().astype(np.int64)[r]
            comps = batch.column("comp").to_numpy().astype(np.int64)[r]
            i, j = np.flatnonzero(short), np.flatnonzero(long)
            every = np.concatenate([i, j])
            key = token[every].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(every)) < len(i)), pa.array(ids[every]), pa.array(comps[every]), pa.array(at[every].astype(np.int64)), pa.array(n[every].astype(np.int64))], names=["key", "short", "id", "comp", "at", "n"])

    return send


def _across(rows: DataFrame, labels: DataFrame | None, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that may still be links, of all nodes in a bucket of several classes.

    A prefix filter finds them: shingles are ordered by how many of these nodes hold them (in a table of ``CELLS``
    counts, the one thing that is broadcast), and a link must share one of the rarest, about a ninth of the shorter
    text's and a fifth of the longer's, early enough for what follows to reach the threshold. So texts that have a
    common passage alone meet only if little else stands in one of them. No link is lost, whatever the counts are."""
    own = near_graph.placed(rows, labels)
    wanted = materialize(own.join(near_graph.mixed(own), "bucket", "left_semi").select("id", "comp").distinct())
    texts = materialize(_texts(wanted, nodes, docs).join(wanted, "id"))
    cells = texts.select("text").mapInArrow(_tallied, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CELLS, np.int64)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    frequency = docs.sparkSession.sparkContext.broadcast(table)
    sent = materialize(texts.mapInArrow(_prefixes(frequency, threshold), "key long, short boolean, id long, comp long, at long, n long"))
    short = sent.filter("short").select("key", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("at").alias("at_b"), F.col("n").alias("n_b"))
    long = sent.filter("NOT short").select(F.col("key").alias("key_"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("at").alias("at_a"), F.col("n").alias("n_a"))
    longer = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = short.join(long, (F.col("key") == F.col("key_")) & (F.col("ca") != F.col("cb")) & longer & reach)
    return met.select("a", "b").distinct()


def _linked(rows: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame | None:
    """id, comp of the nodes (of buckets ``rows``) that have a link."""

    def similar(pairs: DataFrame) -> DataFrame:
        texts = materialize(_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), nodes, docs))
        both = near_graph.with_text(near_graph.with_text(pairs, texts, "a"), texts, "b")
        return both.filter(_similar("text_a", "text_b", F.lit(threshold)))

    return near_graph.classes(rows, similar, lambda now: _across(rows, now, nodes, docs, threshold))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest, class_id, class_key, n_texts, has_words: one row for each row of ``docs``; n_texts counts the
    different texts of its class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select("doc_id", "text", digest().alias("digest")).mapInArrow(_signed, f"doc_id {kind}, digest binary, bands array<bigint>"))
    # Equal texts have equal bands. The digest of the empty text may be that of very many rows; they need no node.
    one = rows.filter(F.size("bands") > 0).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = materialize(one.withColumn("id", F.monotonically_increasing_id()))
    # Nodes that meet nobody are out from here on.
    comp = _linked(materialize(near_graph.popular(_buckets(nodes))), nodes, docs, threshold)
    wordy = F.size("bands") > 0
    if comp is None:
        placed = nodes.select("digest", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_key"), F.lit(1).cast("long").alias("n_texts"))
    else:
        own = near_graph.placed(nodes.select("id", "digest", "doc_id"), comp)
        heads = own.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min("digest").alias("class_key"), F.count(F.lit(1)).alias("n_texts"))
        placed = own.select("digest", "comp").join(heads, "comp").drop("comp")
    named = placed.withColumnRenamed("digest", "n_digest")
    bare = rows.filter(~wordy).select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_key"), F.lit(1).cast("long").alias("n_texts"), F.lit(False).alias("has_words"))
    found = rows.filter(wordy).join(named, F.col("digest") == F.col("n_digest")).select("doc_id", "digest", "class_id", "class_key", "n_texts", F.lit(True).alias("has_words"))
    return found.unionByName(bare)


def apply(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_texts, one row for each row of ``docs``."""
    return classes(docs, threshold).select("doc_id", "class_id", "n_texts")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class stays: that of least doc_id (of equal ids the least digest, of equal rows any one; a class
    of null ids keeps its least digest). Texts without words all stay."""
    placed = materialize(classes(docs, threshold))
    heads = placed.filter("has_words").filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = heads.groupBy("class_key").agg(F.min("digest").alias("k_digest"))
    keep = heads.join(first, (heads["class_key"] == first["class_key"]) & (heads["digest"] == first["k_digest"]))
    keep = keep.groupBy(F.col("doc_id").alias("k_doc"), "k_digest").agg(F.count(F.lit(1)).alias("k_n"))
    rows = packed(docs, own_doc=F.col("doc_id"), own_digest=digest())
    hit = rows.join(keep, rows["own_doc"].eqNullSafe(F.col("k_doc")) & (F.col("own_digest") == F.col("k_digest")))
    alone = unpacked(hit.filter("k_n = 1"), docs.columns)
    again = unpacked(hit.filter("k_n > 1").dropDuplicates(["k_doc", "k_digest"]), docs.columns)
    bare = docs.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return alone.unionByName(again).unionByName(bare)
