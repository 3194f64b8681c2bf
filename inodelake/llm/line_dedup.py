"""Line dedup: exact and near-equal lines over the whole corpus by a segment-partition edit join.

A line counts if it has a word; a word is a run of bytes other than white space. Two lines are near if at most
``allowed`` word edits (a word put in, left out or replaced) lie between them: none below 10 words of the longer line,
1 from 10, 2 from 30, 3 from 100 words on (``EDITS``). A passage of a longer line is not a line of its own.

Lines within k edits of each other agree on one of k + 1 segments at nearly the same place. So every line puts its
segments into an index by (k, length, segment number, hash) and probes those of its own length and of up to k words
less with the substrings that could match (multi-match-aware windows). A first pass drops lines that share no key: a task
sends one row for a key and batch, whatever the number of its lines, so a segment of very many lines makes few rows.
There, lines from ``LONG`` words on have fewer keys: their words fall into 2k + 1 classes by hash, of which k edits leave
one as it is, so each class's words are a key. Only lines that share a key of the pass are fetched; they form classes (``near_graph``): each line is verified by banded
bit-parallel edit distance against leaders of its keys, then every pair of lines of different classes that share a key
and whose sketches (parities of word classes, of which an edit changes two at most) allow it. A key of over ``SPLIT``
lines is cut by two of eight parts of the sketch, of which six changed bits leave two as they are. So no link is
lost and a crowd is not paired with itself.

A line stays if it is the first occurrence of its class: documents in order of id, then text hash; lines in order.
Documents keep their row even if no line is left. Exact copies are told by 128 bits of hash; near lines by their words.

Edge cases: null and empty texts have no lines and stay as they are; lines without words stay; rows of equal id and
text count as one document and keep the same lines; a null id comes last in the order; lines of any length are compared
whole; an empty table gives an empty result; other columns, whatever their names, pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_graph
from .arrow_text import U64, Hasher, mix, slices, utf8, words
from .spark_io import materialize, packed, unpacked

#: (words of the longer line, edits from there on), in order.
EDITS = ((10, 1), (30, 2), (100, 3))
MOST = EDITS[-1][1]
#: Words from which on the first pass takes a line's words by classes instead of segments. Shorter lines have classes of so
#: few words that many lines would share one.
LONG = 40
#: Lines of a key beyond which it is cut by parts of the sketch.
SPLIT = 4096
#: Parts of a sketch; two of them stay as they are under 2 * ``MOST`` changed bits.
PARTS = 2 * MOST + 2
FILTER_BUCKETS = 1 << 18
_BLANK = " \t\n\r\v\f"


# ---- edit distance ----


def allowed(n_words: int) -> int:
    """Edits that may lie between two lines, the longer one of ``n_words``."""
    return max([k for least, k in EDITS if n_words >= least], default=0)


def _allowed(n_words: Column) -> Column:
    out = F.lit(0)
    for least, k in EDITS:
        out = F.when(n_words >= least, k).otherwise(out)
    return out


def within(a: Sequence, b: Sequence, edits: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``edits`` edits apart. Only the diagonals within ``edits`` of the main one are
    kept, as bits of one number: vertical steps of +1 and -1 along the band."""
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    head, most = 0, len(b)
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) <= edits:
        return True
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    size = 2 * edits + 2
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance = full << (size - edits - 1) & full, 0, edits
    low, row = edits + 1 - size, top >> 1
    for j, c in enumerate(b):
        p = places.get(c, 0)
        match = (p >> low if low >= 0 else p << -low) & full
        low += 1
        diagonal = ((match & plus) + plus ^ plus | match | minus) & full
        rise, fall = minus | ~(diagonal | plus) & full, diagonal & plus
        if j < len(a) - edits:
            distance += not diagonal & top
        else:
            distance += bool(rise & row) - bool(fall & row)
            row >>= 1
        plus, minus = (fall | ~(diagonal >> 1 | rise)) & full, diagonal >> 1 & rise
    return distance <= edits


def near(a: str, b: str) -> bool:
    x, y = a.encode().split(), b.encode().split()
    return within(x, y, allowed(max(len(x), len(y))))


# ---- segments ----


class Lines:
    """The lines with words of a column of texts: row, first word and number of words; start, end and hash of words."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, offsets = utf8(texts)
        self.start, self.end, rows = words(self.data, offsets)
        breaks = np.union1d(np.flatnonzero(self.data == 10), offsets)
        at = np.searchsorted(breaks, self.start, "right")
        self.first = np.flatnonzero(np.diff(at, prepend=-1))
        self.row = rows[self.first]
        self.size = np.diff(np.append(self.first, len(at)))
        self.word = Hasher(self.data)(self.start, self.end) if len(self.data) else np.zeros(0, U64)

    def ids(self, which: np.ndarray) -> np.ndarray:
        """The lines' 64-bit hashes, as Spark has them."""
        raw, last = memoryview(self.data), self.first + self.size - 1
        cuts = zip(self.start[self.first[which]].tolist(), self.end[last[which]].tolist(), strict=True)
        return np.array([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in cuts], U64)


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` (from 0) of lines of ``length``: all alike, the last ones longer by one."""
    parts = edits + 1
    base, longer = length // parts, length % parts
    first_longer = parts - longer
    return i * base + np.maximum(i - first_longer, 0), base + (i >= first_longer)


def keys(word: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, key, whether the line is in the index under the key, and whether it probes it, of all lines."""
    hasher = Hasher(word)
    who, key, entry, probe = [], [], [], []

    def add(lines: np.ndarray, length: np.ndarray, i: int, shift: int, edits: int, is_entry: bool, is_probe: bool) -> None:
        at, own = segment(length, i, edits)
        fits = (at + shift >= 0) & (at + shift + own <= size[lines]) & (own > 0)
        begin = (first[lines] + at + shift)[fits]
        h = hasher(begin, begin + own[fits])
        who.append(lines[fits])
        key.append(mix(h ^ mix(length[fits].astype(U64) << U64(16) | U64(i << 8 | edits))))
        entry.append(np.full(len(begin), is_entry))
        probe.append(np.full(len(begin), is_probe))

    for (least, edits), after in zip(EDITS, [*[x for x, _ in EDITS[1:]], np.inf], strict=True):
        lines = np.flatnonzero((size >= least) & (size < after))
        for less in range(edits + 1):
            for i in range(edits + 1):
                for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                    add(lines, size[lines] - less, i, shift, edits, less == 0 and shift == 0, True)
        # Shorter lines that a line with so many edits may be near to.
        lines = np.flatnonzero((size >= least - edits) & (size < least))
        for i in range(edits + 1):
            add(lines, size[lines], i, 0, edits, True, False)
    return tuple(np.concatenate(x) if x else np.zeros(0, U64) for x in (who, key, entry, probe))


def class_keys(word: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of lines that may be near a line of ``LONG`` words or more. A replaced word changes two classes at most,
    a word put in or left out changes one, so lines within k edits share one of 2k + 1 keys, wherever the edits are. Lines of a few different words only may have an
    empty class and so share its key; they are fetched in vain."""
    who, key = [], []
    drawn = mix(word ^ U64(0xC1A55))
    for (least, edits), after in zip(EDITS, [*[x for x, _ in EDITS[1:]], np.inf], strict=True):
        lines = np.flatnonzero((size >= max(least, LONG) - edits) & (size < after))
        if after <= LONG or not len(lines):
            continue
        n, parts = size[lines], 2 * edits + 1
        line = np.repeat(np.arange(len(lines)), n)
        of = drawn[np.arange(len(line)) + np.repeat(first[lines] - (np.cumsum(n) - n), n)]
        sums = np.zeros(len(lines) * parts, U64)
        np.add.at(sums, line * parts + ((of >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64), of)
        who.append(np.repeat(lines, parts))
        key.append(mix(sums ^ np.tile(mix(1 << 32 | np.arange(parts, dtype=U64) << U64(8) | U64(edits)), len(lines))))
    return tuple(np.concatenate(x) if x else np.zeros(0, U64) for x in (who, key))


def sketches(word: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parities of the counts of words in 64 classes. An edit changes two bits at most."""
    if not len(first):
        return np.zeros(0, U64)
    ends = np.stack([first, first + size], axis=1).ravel()
    return np.bitwise_xor.reduceat(np.append(U64(1) << (mix(word ^ U64(0x5EED)) & U64(63)), U64(0)), ends)[::2]


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, line, state: one row for a key and batch (1 if several lines have it, else 0), and one for each line that is
    known to share a key (2), under a key of its own."""
    for batch in slices(batches, "text"):
        lines = Lines(batch.column("text"))
        some = np.flatnonzero(lines.size >= EDITS[0][0] - EDITS[0][1])
        if not len(some):
            continue
        first, size = lines.first[some], lines.size[some]
        short = np.flatnonzero(size < LONG)
        near_short, near_long = keys(lines.word, first[short], size[short])[:2], class_keys(lines.word, first, size)
        who = np.concatenate([short[near_short[0].astype(np.int64)], near_long[0].astype(np.int64)])
        key = np.concatenate([near_short[1], near_long[1]])
        ids = lines.ids(some)
        order = np.argsort(key, kind="stable")
        key, own = key[order], ids[who[order]]
        head = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        shared = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
        found = np.unique(own[np.repeat(shared, np.diff(np.append(head, len(key))))])
        columns = (np.concatenate([key[head], found]).view(np.int64), np.concatenate([own[head], found]).view(np.int64))
        state = np.concatenate([shared.astype(np.int8), np.full(len(found), 2, np.int8)])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(state)], names=["key", "line", "state"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, id, entry, probe, sketch, n of every key of every line (id, text)."""
    for batch in slices(batches, "text"):
        lines = Lines(batch.column("text"))
        who, key, entry, probe = keys(lines.word, lines.first, lines.size)
        ids = batch.column("id").to_numpy(zero_copy_only=False)[lines.row[who]]
        sketch = sketches(lines.word, lines.first, lines.size)[who]
        arrays = (key.view(np.int64), ids, entry, probe, sketch.view(np.int64), lines.size[who].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["bucket", "id", "entry", "probe", "sketch", "n"])


# ---- the join ----


def _trimmed(line: Column) -> Column:
    # Trimming at the right walks over the whole line; most lines end in a word.
    blank_end = reduce(or_, [F.endswith(line, F.lit(c)) for c in _BLANK])
    left = F.ltrim(line, F.lit(_BLANK))
    return F.when(blank_end, F.rtrim(left, F.lit(_BLANK))).otherwise(left)


def _worded(line: Column) -> Column:
    return F.ltrim(line, F.lit(_BLANK)) != ""


def _text_hash() -> Column:
    return F.xxhash64("text")


def firsts(docs: DataFrame) -> DataFrame:
    """h1, h2 and first place of every different line of ``docs``."""
    # The text is hashed before its lines are listed, else once for each of them.
    split = docs.select("doc_id", _text_hash().alias("text_hash"), F.split("text", "\n").alias("raws"))
    own = split.select("doc_id", "text_hash", F.posexplode("raws").alias("line_no", "raw")).filter(_worded(F.col("raw")))
    line = own.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "line_no").alias("place"), _trimmed(F.col("raw")).alias("line"))
    # The second hash starts from another state, so it is no function of the first.
    return line.groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")).agg(F.min("place").alias("place"))


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BUCKETS)).cast("int")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, text of ``nodes`` (id, place). Only documents of wanted hash buckets (a broadcast of at most
    ``FILTER_BUCKETS`` numbers) are split and moved."""
    places = nodes.select("id", F.col("place.doc_id").alias("p_doc"), F.col("place.text_hash").alias("p_hash"), F.col("place.line_no").alias("p_line"))
    wanted = F.broadcast(places.select(_bucket("p_doc", "p_hash").alias("some")).distinct())
    own = docs.select("doc_id", _text_hash().alias("text_hash"), "text").withColumn("some", _bucket("doc_id", "text_hash"))
    own = own.join(wanted, "some", "left_semi")
    lines = own.join(places, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("text_hash") == F.col("p_hash")))
    one = lines.select("id", F.get(F.split("text", "\n"), F.col("p_line")).alias("line"))
    return one.groupBy("id").agg(F.first("line").alias("text"))


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _across(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of lines of different classes that share a key, one as a probe, and whose sketches allow a link."""
    own = near_graph.placed(rows, labels)
    sizes = near_graph.mixed(own, F.count(F.lit(1)).alias("lines"))
    part = lambda k: F.shiftrightunsigned("sketch", 64 // PARTS * k).bitwiseAND((1 << 64 // PARTS) - 1)
    split = F.array(*[F.xxhash64("bucket", F.lit(i), F.lit(j), part(i), part(j)) for i, j in combinations(range(PARTS), 2)])
    dealt = own.join(sizes, "bucket").withColumn("key", F.explode(F.when(F.col("lines") > SPLIT, split).otherwise(F.array("bucket"))))
    dealt = materialize(dealt.select("key", "id", "comp", "entry", "probe", "sketch", "n"))
    probe = dealt.filter("probe").select("key", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    entry = dealt.filter("entry").select(F.col("key").alias("key_"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    met = probe.join(entry, (F.col("key") == F.col("key_")) & (F.col("ca") != F.col("cb")) & (F.col("na") >= F.col("nb")) & (apart <= 2 * _allowed(F.col("na"))))
    return met.select("a", "b").distinct()


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2, first: the lines (of ``lines``, as ``firsts`` has them) that are near an earlier one of their class, and
    the place of the class's first line."""
    probes = docs.select("text").mapInArrow(_probes, "key long, line long, state byte")
    of_key = Window.partitionBy("key")
    met = probes.withColumns({"low": F.min("line").over(of_key), "high": F.max("line").over(of_key), "known": F.max("state").over(of_key)})
    return _linked(docs, lines, materialize(met.filter("low <> high OR known > 0").select("line").distinct()))


def _linked(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    nodes = materialize(lines.join(wanted, lines["h1"] == wanted["line"], "left_semi").withColumn("id", F.monotonically_increasing_id()))
    texts = materialize(_texts(docs, nodes))
    keyed = materialize(texts.mapInArrow(_keyed, "bucket long, id long, entry boolean, probe boolean, sketch long, n int"))
    crowds = materialize(near_graph.popular(keyed.select("bucket", "id").distinct()))

    def similar(pairs: DataFrame) -> DataFrame:
        both = near_graph.with_text(near_graph.with_text(pairs, texts, "a"), texts, "b")
        return both.filter(_near("text_a", "text_b"))

    labels = near_graph.classes(crowds, similar, lambda now: _across(keyed, now))
    if labels is None:
        return lines.select("h1", "h2", F.col("place").alias("first")).limit(0)
    own = nodes.join(labels, "id")
    heads = own.groupBy("comp").agg(F.min("place").alias("first"))
    return own.join(heads, "comp").filter("place <> first").select("h1", "h2", "first")


def _decided(docs: DataFrame) -> DataFrame:
    """d_doc, d_hash, kept (numbers of the lines that stay), near (lines that are near another, with its place)."""
    lines = materialize(firsts(docs))
    gone = near_lines(docs, lines)
    own = lines.join(gone.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    link = F.struct(F.col("place.line_no").alias("line_no"), F.col("first.doc_id").alias("of_doc_id"), F.col("first.line_no").alias("of_line_no"))
    return own.groupBy(F.col("place.doc_id").alias("d_doc"), F.col("place.text_hash").alias("d_hash")).agg(
        F.collect_set(F.when(F.col("first").isNull(), F.col("place.line_no"))).alias("kept"), F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), link))).alias("near")
    )


def _cleaned(docs: DataFrame) -> DataFrame:
    """row, n_lines, n_removed, near, new_text of each row of ``docs``."""
    decided = _decided(docs)
    rows = packed(docs, own_doc=F.col("doc_id"), own_hash=_text_hash())
    both = rows.join(decided, F.col("own_doc").eqNullSafe(F.col("d_doc")) & (F.col("own_hash") == F.col("d_hash")), "left")
    # Documents without a first occurrence of any line keep none of theirs.
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    cut = both.select("row", "near", kept.alias("kept"), F.split("row.text", "\n").alias("lines"))
    worded = F.filter(F.transform("lines", lambda x, i: F.when(_worded(x), i)), lambda i: i.isNotNull())
    cut = cut.withColumn("worded", worded).withColumn("drop", F.array_except("worded", "kept"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return cut.select("row", F.coalesce(F.size("worded"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"), "near", F.when(F.size("drop") > 0, text).otherwise(F.col("row.text")).alias("new_text"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts less the lines that go; n_chars, if there is one, follows the text."""
    changed = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return unpacked(_cleaned(docs), docs.columns, **changed)


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, near and text (without the lines that go), one row for each row of ``docs``.
    ``near`` lists the first occurrences in a document that go for being near another line: their number, and document
    and number of the first line of the class. n_near counts them; the other lines removed are exact copies."""
    out = _cleaned(docs.select("doc_id", "text"))
    links = F.coalesce("near", F.array().cast(out.schema["near"].dataType))
    return out.select("row.doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.size(links).cast("long").alias("n_near"), links.alias("near"), F.col("new_text").alias("text"))
