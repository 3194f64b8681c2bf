"""Byte-level BPE over Arrow batches with the tokenizers library: encode, offsets, and decode through the byte table.

The vocabulary file maps bytes to printable characters; ids are decoded by mapping each piece's characters back to
bytes and joining, so characters split over several tokens come out whole. The vocabulary's path is a parameter, opened
where the texts are; nothing is trained. Text that looks like a special token is encoded as ordinary text.

Every match of the pattern is encoded for itself, so a worker keeps the ids of the short matches it has met (``REMEMBERED`` of
up to ``LONGEST`` characters; then it starts anew) and gives the library only the new ones, a batch at a time.

Edge cases: null counts as the empty text (no ids, empty bytes); long texts are encoded whole; repeated rows give equal
values; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import slices

VOCABULARY = "byte_bpe_50k.json"
#: Matches whose ids a worker keeps, and the longest of them (characters); longer ones are encoded anew each time.
REMEMBERED = 200_000
LONGEST = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache
def byte_characters() -> dict[str, int]:
    """Character to byte: printable Latin-1 stands for itself, the other bytes in order for U+0100 and up."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    table = {chr(b): b for b in shown}
    table.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return table


class Codec:
    """One vocabulary: ids and byte offsets of texts, and bytes of ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        table = byte_characters()
        self.pieces = [b""] * self.tokenizer.get_vocab_size()
        for piece, i in self.tokenizer.get_vocab().items():
            self.pieces[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.shown = [b"%d" % i for i in range(len(self.pieces))]
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (32-bit)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = [self.matches(t) for t in texts]
        new = list({p for own in parts for p in own if p not in self.known})
        if new:
            fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            self.known.update((p, np.array(e.ids, np.int32).tobytes()) for p, e in zip(new, fast(new, add_special_tokens=False), strict=True))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32) for own in parts]
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets at which each token starts, and the length of the whole."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def text_of(self, ids: np.ndarray) -> bytes:
        """Decimal ids with one space between them."""
        return b" ".join(map(self.shown.__getitem__, ids.tolist()))


def split_characters(raw: bytes, offsets: np.ndarray) -> int:
    """How many tokens start inside a character: at a continuation byte of UTF-8."""
    return int((np.frombuffer(raw, np.uint8)[offsets[:-1]] & 0xC0 == 0x80).sum())


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path or default_path())


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, offsets (bytes into the UTF-8 text) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, "text"):
            ids = c.encode(batch.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.offsets(x) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids", "offsets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<bigint>")


def apply(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, n_split (tokens that start inside a character) for each row
    of ``docs``: encoded, then decoded again."""
    digest = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, "text"):
            every = c.encode(batch.column("text").fill_null("").to_pylist())
            raw = [c.decode(ids) for ids in every]
            columns = [
                pa.array([len(x) for x in every], pa.int64()), pa.array([digest(c.text_of(x)) for x in every], pa.string()), pa.array(map(digest, raw), pa.string()),
                pa.array(map(len, raw), pa.int64()), pa.array([split_characters(r, c.offsets(x)) for r, x in zip(raw, every, strict=True)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "n_split"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_split long")
