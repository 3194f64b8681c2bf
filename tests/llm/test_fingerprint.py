"""Document fingerprints: order, insertion and deletion, likeness against exact counts, edge cases, ranges."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inodelake.llm import fingerprint as P

SCHEMA = "doc_id long, text string, vector string, place int"


def exact(text: str | None) -> list[int]:
    """The vector of a text, one paragraph and pair after another."""
    out = [0] * (P.IDENTITY + P.SIGNS)
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        digest = hashlib.sha256(line.encode()).hexdigest()
        for k in range(P.IDENTITY):
            out[k] += int(digest[8 * k : 8 * k + 8], 16)
        for w, follower in zip(words, [*words[1:], ""], strict=True):
            c = zlib.crc32(f"{w} {follower}".encode())
            for half, m in enumerate(P.MULTIPLIERS):
                for s in range(P.APART):
                    out[P.IDENTITY + half * P.APART + s] += 1 if c * m >> P.DROPPED + s & 1 else -1
    return [x % m for x, m in zip(out, P.MODULI, strict=True)]


def shown(vector: list[int]) -> str:
    return "".join(f"{x:0{n}x}" for x, n in zip(vector, P.DIGITS, strict=True))


def brute(rows: list[tuple[int, str | None]]) -> list[tuple]:
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for n, (i, text) in enumerate(rows):
        after, q = rows[(n + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(exact(text)), shown(exact(edited))))
    return out


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_equals_brute_force_whatever_the_ranges(spark, parts):
    texts = [None, "", " \n\t", "one", "é漢 字 é漢\n\nthe same\nthe same", "a b\nc d\n" * 40, "x" * 3000, "tab\there #1\r\nline"]
    rows = [(n, texts[n % len(texts)] if n % 3 else f"{texts[n % len(texts)]} {n}\nmore {n * n}") for n in range(90)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    found = P.apply(docs, parts).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint").collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_likeness_follows_the_exact_share(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[: 400 - k] + [f"other{i}" for i in range(k)])) for k in (0, 40, 100, 200, 400)]
    made = P.vectors(spark.createDataFrame(rows, "doc_id long, text string"))
    first = made.filter("doc_id = 0").select(F.col("vector").alias("first"))
    found = dict(made.join(F.broadcast(first)).select("doc_id", P.likeness(F.col("first"), F.col("vector"))).collect())
    pairs = lambda t: Counter(zip(t.split(), [*t.split()[1:], ""], strict=True))
    for k, text in rows:
        a, b = pairs(rows[0][1]), pairs(text)
        share = 2 * sum(a[p] * b[p] for p in a) / (sum(x * x for x in a.values()) + sum(x * x for x in b.values()))
        assert abs(found[k] - share) < 0.3
    assert found[0] == 1.0 and found[40] > found[200] > found[400]


def test_order_insertion_and_deletion(spark):
    rows = [(0, "one two\nthree four\nfive"), (1, "five\n\none two\nthree four"), (2, "one two\nthree four"), (3, "five"), (4, "five\none two three four")]
    v = {r["doc_id"]: r["vector"] for r in P.vectors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert v[0] == v[1] != v[4]
    both = spark.createDataFrame([(v[0], v[2], v[3])], "a array<long>, b array<long>, c array<long>")
    got = both.select(P.add(F.col("b"), F.col("c")).alias("plus"), P.subtract(F.col("a"), F.col("c")).alias("minus"), P.decode(P.encode(F.col("a"))).alias("back")).first()
    assert got["plus"] == v[0] and got["minus"] == v[2] and got["back"] == v[0]


def test_parts_of_a_text_add_up(spark):
    whole = spark.createDataFrame([(0, "a b\nc d\ne")], "doc_id long, text string")
    parts = spark.createDataFrame([(0, "e"), (0, "c d\na b")], "doc_id long, text string")
    assert P.vectors(whole).first()["vector"] == P.vectors(parts).first()["vector"]


def test_edge_cases(spark):
    assert P.apply(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = P.apply(spark.createDataFrame([(5, "a b c d e f g h", "x", 1)], SCHEMA)).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 15
    rows = [(None, "null id"), (1, "same"), (1, "same"), (1, "other"), (2, None), (3, "")]
    got = P.apply(spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA), 2).collect()
    assert len(got) == 6 and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 2
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["near_next"] == 1.0 and by_id[2]["near_edited"] == 1.0 and by_id[3]["near_next"] == 0.0


def test_a_very_long_text(spark):
    long = "word " * 400_000 + "\n" + "x" * 500_000
    got = P.apply(spark.createDataFrame([(0, long), (1, "short one")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["fingerprint"] == shown(exact(long)) and got[0]["n_chars"] == len(long)
