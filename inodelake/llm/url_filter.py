"""URL filters: host and path rules, then exact membership in a list of hosts by a Bloom filter cascade.

The cascade's levels alternate: level 1 encodes the listed keys, level 2 the unlisted keys of the corpus that level 1
takes for listed, level 3 the listed keys that level 2 takes for those, and so on until a level makes no mistake on
the corpus's keys. A key's answer is the parity of the first level that does not hold it, which is exact for every key
of the universe the cascade was built over (all hosts of the table), with no join at query time.

The list is a table of keys. Keys are dealt by hash over as many cascades as keep each one's filters, which are broadcast,
within about ``SHARD_BYTES``; a row is probed in the cascade of its key's part. The registered query's list holds the
hosts of the table with a listed word in their name.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is on no list (allow);
repeated urls are judged alike, one output row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import U64, mix
from .spark_io import materialize

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Words in a host name that put the host on the block list (between dots or hyphens).
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez")

#: Filters of one cascade that are broadcast, at about ten bits a listed key for its first and all further levels.
SHARD_BYTES = 64 << 20
BITS_A_KEY = 16
#: Levels halve the keys at least in the mean; more of them than this means that two keys have one hash.
MOST_LEVELS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    step = mix(h2 + U64(level)) | U64(1)
    base = mix(h1 ^ U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (base[:, None] + np.arange(hashes, dtype=U64)[None, :] * step[:, None]) % U64(bits)


def _holds(words: np.ndarray, hashes: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = _positions(h1, h2, level, len(words) * 64, hashes)
    return ((words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).all(axis=1)


def _probe(levels: list[tuple[np.ndarray, int]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that does not hold it decides."""
    listed, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for level, (words, hashes) in enumerate(levels):
        held = _holds(words, hashes, level, h1[open_], h2[open_])
        listed[open_[~held]] = level % 2 == 1
        open_ = open_[held]
    listed[open_] = len(levels) % 2 == 1
    return listed


def _bloom(keys: DataFrame, n: int, level: int, rate: float) -> tuple[np.ndarray, int]:
    """A Bloom filter over (h1, h2): every task sends only the 64-bit words that it sets, which are or-ed by word."""
    words = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(i)).astype(np.int64).view(U64) for i in (0, 1))
            at = np.unique(_positions(h1, h2, level, words * 64, hashes).ravel())
            if len(at):
                word, first = np.unique((at >> U64(6)).astype(np.int64), return_index=True)
                value = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = keys.select("h1", "h2").mapInArrow(bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    filled = np.zeros(words, U64)
    filled[rows["word"].to_numpy()] = rows["value"].to_numpy().view(U64)
    return filled, hashes


def _held(sent: Broadcast, level: int):
    @F.pandas_udf(T.BooleanType())
    def held(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(_holds(*sent.value, level, h1.to_numpy().view(U64), h2.to_numpy().view(U64)))

    return held


def _hashes(key: Column) -> list[Column]:
    """Two hashes from different states: the second is no function of the first."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class Cascade:
    """``listed`` and ``universe`` have a string column ``key``; listed keys outside the universe do not count."""

    def __init__(self, universe: DataFrame, listed: DataFrame, rate: float = 0.01, shard_bytes: int = SHARD_BYTES) -> None:
        on_list = listed.select(F.col("key").alias("listed_key")).distinct()
        marked = universe.select("key").distinct().join(on_list, F.col("key") == F.col("listed_key"), "left")
        keys = materialize(marked.select(*_hashes(F.col("key")), F.col("listed_key").isNotNull().alias("listed")))
        self.spark = universe.sparkSession
        self.parts = max(1, math.ceil(keys.filter("listed").count() * BITS_A_KEY / 8 / shard_bytes))
        self.shards = [self._levels(keys.filter(self._part(F.col("h1")) == i), rate) for i in range(self.parts)]

    def _part(self, h1: Column) -> Column:
        return F.pmod(F.shiftright(h1, 20), F.lit(self.parts))

    def _levels(self, keys: DataFrame, rate: float) -> list[tuple[np.ndarray, int]]:
        mine, others = keys.filter("listed"), keys.filter("NOT listed")
        levels: list[tuple[np.ndarray, int]] = []
        while n := mine.count():
            if len(levels) == MOST_LEVELS:
                raise ValueError("two keys have the same hashes")
            levels.append(_bloom(mine, n, len(levels), rate if not levels else 0.5))
            sent = self.spark.sparkContext.broadcast(levels[-1])
            mine, others = materialize(others.filter(_held(sent, len(levels) - 1)("h1", "h2"))), mine
        return levels

    def mark(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """``df`` with a boolean column ``out``: whether its ``key`` is listed. Rows of each part of the keys are probed
        in one scan with that part's filters alone."""
        marked = []
        for i, levels in enumerate(self.shards):
            own = df if self.parts == 1 else df.filter(self._part(F.xxhash64(key)) == i)
            marked.append(own.withColumn(out, _listed(self.spark.sparkContext.broadcast(levels))(*_hashes(F.col(key)))))
        return reduce(DataFrame.unionAll, marked)


def _listed(sent: Broadcast):
    @F.pandas_udf(T.BooleanType())
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(_probe(sent.value, h1.to_numpy().view(U64), h2.to_numpy().view(U64)))

    return listed


def listed_host(key: Column, words: Sequence[str] = LISTED_WORDS) -> Column:
    return key.rlike(r"(^|[.-])(" + "|".join(words) + r")($|[.-])")


def listed_hosts(pages: DataFrame, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """key: the different hosts of ``pages`` with a listed word in their name."""
    return pages.select(host_of(F.col("url")).alias("key")).filter(listed_host(F.col("key"), words)).distinct()


def apply(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (whether the host is a ``key`` of ``listed``), one row for each row
    of ``pages``."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cascade = Cascade(parsed.select(F.col("host").alias("key")), listed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = cascade.mark(parsed, "host", "listed")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, words: Sequence[str] = LISTED_WORDS) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    listed = f"regexp_matches(host, '(^|[.-])({'|'.join(words)})($|[.-])')"
    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {verdict} END, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict, {listed} AS listed FROM p"""
