"""Bounds that hold whatever a table contains: many long matches, one very long document, deep nesting."""

from __future__ import annotations

import base64
import time
import zlib

import public_tokenizers
import pyarrow as pa

from inodelake.llm import bpe, html_extract
from inodelake.llm import quality_classifier as Q


def test_long_matches_are_not_kept():
    c = bpe.Codec(bpe.default_path())
    texts = ["".join(chr(97 + (i * k + i // 7) % 26) for i in range(20_000)) for k in range(1, 40)]
    ids = c.encode([*texts, "short words stay"])
    assert max(map(len, c.known)) <= bpe.LONGEST and len(c.known) == 3
    assert [c.decode(x).decode() for x in ids[:-1]] == texts
    assert all((a == b).all() for a, b in zip(ids, c.encode([*texts, "short words stay"]), strict=True))


def test_the_vocabulary_is_that_of_the_ranks():
    c = bpe.codec()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert {piece: i for i, piece in enumerate(c.pieces) if i in set(ranks.values())} == ranks


GOOD = "The council met on Tuesday to discuss the new bridge over the river.\nMembers asked for a second opinion, and the vote was postponed.\n"
BAD = "### $$$ ||| &&& ***\n<<< >>> {} %%% 00 11 22\n"


def test_one_very_long_document_changes_no_other_score(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:80]
    rows = [(i, (GOOD if n % 2 else BAD) * (1 + n % 4)) for n, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, n % 2, 0) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string"
    plain = Q.fit(spark.createDataFrame(rows, schema), labels)
    for at in (0, 40):
        long = [(i, text if n != at else "\n" * 400_001) for n, (i, text) in enumerate(rows)]
        other = Q.fit(spark.createDataFrame(long, schema), labels)
        texts = pa.array([GOOD, BAD])
        assert abs(plain.scores(texts) - other.scores(texts)).max() < 0.05 and other.scores(texts)[0] > 0.9


def test_deep_nesting_is_read_in_linear_time():
    for html in ("<div>" * 100_000, "<p>" + "<table><td>" * 30_000 + "<div>" * 50_000, "<ul>" + "<li><span>" * 50_000):
        began = time.process_time()
        html_extract.parse(html)
        assert time.process_time() - began < 10
