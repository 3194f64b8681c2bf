"""Cross-tokenizer alignment by diagonal run skipping.

A text is encoded by two vocabularies, each with a space in front, and both token sequences are cut into groups where
tokens of both end at the same byte. Equal stretches are jumped: while the next ends of one side equal those of the other
at the current shift of indexes, the probe doubles, and at a difference it halves down to the place; the irregular group
there is resolved token by token, and its sizes change the shift.

Two tokens are linked where their byte ranges end together, once in each group: its last tokens. Of two linked tokens the
shorter one's bytes end the longer one's, so the number of different pairs has a bound that the two vocabularies set
(``most_pairs``, about 250,000 here) whatever the corpus is. Their corpus-wide counts are therefore broadcast. Documents
are encoded once; each one's links are written to the shared folder as distinct pairs with their number.

Texts are encoded in chunks that begin with spaces: the byte-level pattern always parts there, and the second vocabulary
has no piece with a space after another character (checked when it is loaded), so no token crosses a cut.

Edge cases: null and empty texts have no tokens: zeros and an empty ``groups_sha256``; so have texts whose tokens' bytes
differ from a space and the text (a U+2581 in the text reads as a space); strings of special tokens are plain text;
repeated rows are kept and counted each; an empty table gives an empty result; columns other than ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices
from .bpe import byte_characters
from .spark_io import materialize

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHORT = 40
REMEMBERED = 600_000
TOKENS = 4_000_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(FIRST), public_tokenizers.path(SECOND)


class Bytes:
    """The byte-level vocabulary: ids of a text, and each id's bytes. Its merges are in the order of its ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        table = byte_characters()
        special = {t["content"] for t in vocabulary.get("added_tokens", [])}
        ranks = {bytes(table[c] for c in piece): i for piece, i in vocabulary["model"]["vocab"].items() if piece not in special}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.encode, texts))


class Pieces:
    """The piece vocabulary. It puts a space in front by itself, so a text is given without its first one."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(name[1:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        if any(re.search("[^▁]▁", name) for name in names):
            raise ValueError(f"{path} has pieces that go on over a space, so texts can't be cut at spaces")
        self.space = [names.index("▁")]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        every = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids if t != " " else self.space for t, ids in zip(texts, every, strict=True)]


#: A text (with a space in front) cut before every run of white space that begins with a space and follows another character.
CHUNKS = re.compile(r"\s*\S+(?:(?! )\s+\S*)*|\s+").findall


class Encoder:
    """Ids of both vocabularies for whole texts. Neither merges over a cut, so each chunk is encoded for itself, and its ids are
    kept in two flat arrays by the chunk's number; chunks of up to ``SHORT`` characters keep their number until there are
    ``REMEMBERED`` of them or ``TOKENS`` ids, then all begins anew."""

    def __init__(self, first: str, second: str) -> None:
        self.first, self.second = Bytes(first), Pieces(second)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = array("i"), array("i")
        self.starts = array("q", [0]), array("q", [0])
        self.fine = bytearray()

    def _add(self, chunks: list[str]) -> None:
        """Encode chunks and number them; ``fine`` tells whether the bytes of both sides' tokens are the chunk's."""
        raw = [chunk.encode() for chunk in chunks]
        whole, lengths, fine = b"".join(raw), list(map(len, raw)), True
        for vocabulary, flat, starts in zip((self.first, self.second), self.ids, self.starts, strict=True):
            every = vocabulary.encode_all(chunks)
            new = list(chain.from_iterable(every))
            pieces = list(map(vocabulary.pieces.__getitem__, new))
            ends = np.cumsum(list(map(len, every)))
            sizes = np.concatenate([[0], np.cumsum(list(map(len, pieces)))])[ends]
            if not (b"".join(pieces) == whole and (sizes == np.cumsum(lengths)).all()):
                fine = False
            starts.extend((ends + len(flat)).tolist())
            flat.extend(new)
        first = len(self.fine)
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.fine.extend(b"\x01" * len(chunks) if fine else bytes(self._is_fine(first + i, r) for i, r in enumerate(raw)))

    def _is_fine(self, number: int, raw: bytes) -> bool:
        sides = zip((self.first, self.second), self.ids, self.starts, strict=True)
        return all(b"".join(map(v.pieces.__getitem__, ids[starts[number] : starts[number + 1]])) == raw for v, ids, starts in sides)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, one text after another, and where each text begins among them (and the end). A text has none
        if it is null or empty, or a chunk of it is not fine."""
        if len(self.known) > REMEMBERED or len(self.ids[0]) > TOKENS:
            self.clear()
        parts = [CHUNKS(" " + t) if t else [] for t in texts]
        flat = [chunk for own in parts for chunk in own]
        numbers = list(map(self.known.get, flat))
        new = list(dict.fromkeys(chunk for chunk, number in zip(flat, numbers, strict=True) if number is None))
        if new:
            self._add(new)
            numbers = list(map(self.known.__getitem__, flat))
            for chunk in new:
                if len(chunk) > SHORT:
                    del self.known[chunk]
        n = np.array(numbers, np.int64)
        of_text = np.repeat(np.arange(len(texts)), list(map(len, parts)))
        bad = np.zeros(len(texts), bool)
        bad[of_text[np.frombuffer(self.fine, np.uint8)[n] == 0]] = True
        n, of_text = n[~bad[of_text]], of_text[~bad[of_text]]
        out = []
        for ids, starts in zip(self.ids, self.starts, strict=True):
            at = np.frombuffer(starts, np.int64)
            sizes = at[n + 1] - at[n]
            where = np.repeat(at[n] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out += [np.frombuffer(ids, np.int32)[where].astype(np.int64) if len(where) else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(np.bincount(of_text, sizes, len(texts)))]).astype(np.int64)]
        return out[0], out[2], out[1], out[3]


@lru_cache(maxsize=2)
def encoder(first: str, second: str) -> Encoder:
    return Encoder(first, second)


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of different bytes can end together: one ends the other."""
    known_a, known_b = set(a) - {b""}, set(b) - {b""}
    ends = lambda of, known: sum(x[i:] in known for x in of for i in range(len(x)))
    return ends(known_a, known_b) + ends(known_b, known_a) - len(known_a & known_b)


def runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Groups of the ascending ends ``a`` and ``b`` of two token sequences over the same bytes, as runs (i, j, n): ``n`` groups whose
    last tokens are i, i + 1 ... on the one side and j, j + 1 ... on the other. A run is a one-to-one stretch, or one irregular group."""
    out: list[tuple[int, int, int]] = []
    a, b = [*a, -1], [*b, -2]  # unlike ends, at which every probe stops
    i = j = 0
    n = len(a) - 1
    while i < n:
        if a[i] == b[j]:
            start, i, j, step = i, i + 1, j + 1, 1
            while a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, 2 * step
            while step > 1:
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
            out.append((start, j - i + start, i - start))
            if i == n:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        out.append((i, j, 1))
        i, j = i + 1, j + 1
    return out


def last_tokens(found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each group on both sides."""
    i, j, n = np.array(found, np.int64).reshape(-1, 3).T
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(i, n) + within, np.repeat(j, n) + within


class Aligner:
    """Both vocabularies with their tokens' lengths, and each id as text with what may follow it."""

    def __init__(self, first: str, second: str) -> None:
        self.encode = encoder(first, second)
        self.pieces = self.encode.first.pieces, self.encode.second.pieces
        self.sizes = [np.array([len(p) for p in pieces], np.int64) for pieces in self.pieces]
        most = max(map(len, self.pieces))
        self.most = most
        self.shown = [b"%d%s" % (i, after) for after in (b",", b"|", b";") for i in range(most)]

    def align(self, texts: list[str | None]) -> Aligned:
        """All texts as one sequence: at a text's end, tokens of both sides end."""
        a, b, a_starts, b_starts = self.encode(texts)
        last = last_tokens(runs(np.cumsum(self.sizes[0][a]).tolist(), np.cumsum(self.sizes[1][b]).tolist()))
        return Aligned(a, b, *last, a_starts, b_starts, np.searchsorted(last[0], a_starts))

    def written(self, x: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: a token's place is after all of its own side and those of the other side's
        groups before."""
        after_a, after_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        after_a[x.a_last], after_b[x.b_last] = 1, 2
        of_a, of_b = np.cumsum(after_a) - after_a, (np.cumsum(after_b) - after_b) // 2  # each token's group
        out = np.empty(len(x.a) + len(x.b), np.int64)
        b_before, a_upto = np.concatenate([[0], x.b_last + 1]), x.a_last + 1
        out[np.arange(len(x.a)) + b_before[of_a]] = x.a + self.most * after_a
        out[np.arange(len(x.b)) + a_upto[of_b]] = x.b + self.most * after_b
        shown, at = list(map(self.shown.__getitem__, out.tolist())), (x.a_starts + x.b_starts).tolist()
        return [b"".join(shown[i:j])[:-1] for i, j in pairwise(at)]


@dataclass(frozen=True)
class Aligned:
    """Several texts' ids on both sides, the last token of each group, and where each text's tokens and groups begin (and the end)."""

    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    starts: np.ndarray


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_last, b_last (the index of each group's last token) of each row of ``docs``."""
    own = paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*(own or default_paths()))
        for batch in slices(batches, "text"):
            x = aligner.align(batch.column("text").to_pylist())
            lists = lambda values, starts: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))
            of = np.repeat(np.arange(batch.num_rows), np.diff(x.starts))
            columns = [lists(x.a, x.a_starts), lists(x.b, x.b_starts), lists(x.a_last - x.a_starts[of], x.starts), lists(x.b_last - x.b_starts[of], x.starts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "a_ids", "b_ids", "a_last", "b_last"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


def _documents(docs: DataFrame, paths: tuple[str, str] | None) -> DataFrame:
    """Each row's digest columns with its links: distinct pairs (a * 2^32 + b) and the number of each."""
    own = paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*(own or default_paths()))
        for batch in slices(batches, "text"):
            x = aligner.align(batch.column("text").to_pylist())
            linked = [np.unique(own, return_counts=True) for own in np.split((x.a[x.a_last] << 32) + x.b[x.b_last], x.starts[1:-1])]
            digests = [hashlib.sha256(s).hexdigest() if s else "" for s in aligner.written(x)]
            columns = [*map(np.diff, (x.a_starts, x.b_starts, x.starts)), digests, [p for p, _ in linked], [n for _, n in linked]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "number"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pair array<bigint>, number array<int>")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, total (links that hold it), best (whether no pair of its second id has more) from rows of pair and number."""
    totals = links.groupBy("pair").agg(F.sum("number").alias("total"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = totals.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))
    return totals.join(highest, b == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def apply(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``."""
    made = materialize(_documents(docs, paths))
    each = lambda df: df.select("*", F.inline(F.arrays_zip("pair", "number").cast("array<struct<one_pair:bigint,one_number:int>>")))
    links = each(made.select("pair", "number")).select(F.col("one_pair").alias("pair"), F.col("one_number").alias("number"))
    counts = materialize(pair_counts(links).coalesce(8)).withColumnRenamed("pair", "known")
    keys = ["row_no", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    rows = made.withColumn("row_no", F.monotonically_increasing_id())
    some = each(rows.filter("n_groups > 0")).drop("pair", "number")
    scored = some.join(F.broadcast(counts), F.col("one_pair") == F.col("known")).groupBy(*keys).agg(
        F.sum("one_number").alias("n_links"), F.sum(F.when(F.col("best"), F.col("one_number")).otherwise(0)).alias("n_best"), F.sum(F.col("one_number") * F.col("total")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    empty = rows.filter("n_groups = 0").select(*keys, zero.alias("n_links"), zero.alias("n_best"), zero.alias("count_sum"))
    return scored.unionByName(empty).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
