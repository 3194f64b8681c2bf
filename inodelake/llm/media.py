"""Media columns: payloads stored as lossless WebP images and read back as pixel arrays, with features.

A payload is a text's UTF-8 bytes with zeros up to a positive multiple of 64, four bytes to an ARGB pixel (lowest byte
first: blue, green, red, alpha). An image is 16 pixels wide and at most ``webp.SIDE`` high; a longer payload takes
several images, one file after another (each file states its length).

Edge cases: null counts as the empty text (one row of zero pixels); texts of any length are stored whole; equal texts
give equal values; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .arrow_text import slices

UNIT = 64
WIDTH = UNIT // 4


def store(payload: bytes) -> bytes:
    """The payload (a multiple of 64 bytes) as one or more WebP files."""
    step = UNIT * webp.SIDE
    images = [np.frombuffer(payload[i : i + step], "<u4").reshape(-1, WIDTH) for i in range(0, len(payload), step)]
    return b"".join(webp.encode(image, webp.tools_for(image)) for image in images)


def load(media: bytes) -> bytes:
    """The payload read back from its files."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(webp.decode(media[at:end]).astype("<u4").tobytes())
        at = end
    return b"".join(out)


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def feature(payload: bytes) -> str:
    """An average hash: 64 equal parts of the payload, one bit each, set where the part's mean is above the whole's."""
    parts = np.frombuffer(payload, np.uint8).reshape(UNIT, -1).mean(axis=1)
    return np.packbits(parts > parts.mean()).tobytes().hex()


def images(docs: DataFrame) -> DataFrame:
    """doc_id, media (WebP files), pixels (ARGB, row by row) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            media = [store(pad(t.encode())) for t in batch.column("text").fill_null("").to_pylist()]
            pixels = [np.frombuffer(load(m), "<u4").astype(np.int64) for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary()), pa.array(pixels, pa.list_(pa.int64()))], names=["doc_id", "media", "pixels"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary, pixels array<bigint>")


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for each row."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").fill_null("").to_pylist():
                raw = text.encode()
                media = store(pad(raw))
                back = load(media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
