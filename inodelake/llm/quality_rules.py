"""Quality rules: a threshold table compiled into one Spark projection (native functions only).

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: a null or empty text has no words, all counts 0, and fails the base
rules; repeated rows are judged alike, one output row each; an empty table gives an empty result; columns of the input
other than ``doc_id`` and ``text`` are ignored, whatever their names.

Five-word windows are compared by 64-bit hashes within one document (for n windows a false match has a chance of
about n^2 / 2^65).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import let

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not at this are from or an "
    "der die das und in zu den im von mit auf für ist nicht ein eine als auch dem sich "
    "le la les de des du et en un une est que pour dans par au sur pas il qui "
    "el los las del y por con para se no lo su al"
).split()

#: (rule, measure, least, most, fewest words at which the rule applies); None leaves a side open.
RULES: tuple[tuple[str, str, float | None, float | None, int], ...] = (
    ("word_length", "mean_word_chars", 2.0, 15.0, 10),
    ("symbols", "symbol_ratio", None, 0.1, 10),
    ("repeated_lines", "dup_line_ratio", None, 0.5, 10),
    ("stop_words", "stop_word_ratio", 0.02, None, 50),
)

_WORD = r"[^\x20\x09-\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found at least twice: sort (hash, position), keep equal neighbours, and add
    up the union of their spans. n log n in the number of words."""

    def of_hashes(h: Column) -> Column:
        return F.transform(
            F.when(F.size(h) >= 5, F.sequence(F.lit(0), F.size(h) - 5)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(5)]).alias("h"), i.alias("p")),
        )

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"])

    def covered(p: Column) -> Column:
        spans = F.transform(p, lambda at, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - at, F.lit(5))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, b: a + b)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, lambda h: F.sort_array(of_hashes(h))), lambda s: let(F.sort_array(twice(s)), covered))


def apply(docs: DataFrame, rules: Sequence[tuple] = RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """doc_id, the counts, each rule's verdict, base_failed and kept, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        "doc_id",
        let(
            F.regexp_extract_all(text, F.lit(_WORD), 0),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("of_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(
            F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
        ).alias("of_lines"),
    )
    counts = measured.select("doc_id", "of_words.n_words", "word_chars", "n_symbols", "of_lines.n_dup_lines", "of_words.n_repeat_words", "of_words.n_stop", "of_lines.n_lines")
    n = F.greatest(F.col("n_words"), F.lit(1))
    measures = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "stop_word_ratio": F.col("n_stop") / n,
    }
    verdicts = {}
    for name, measure, least, most, from_words in rules:
        fine = F.lit(True)
        if least is not None:
            fine &= measures[measure] >= least
        if most is not None:
            fine &= measures[measure] <= most
        verdicts[name] = fine | (F.col("n_words") < from_words)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~failed
    for verdict in verdicts.values():
        kept &= verdict
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"), "n_lines", "n_stop",
        *[v.alias(f"ok_{k}") for k, v in verdicts.items()],
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``apply`` with the production rules over ``documents``."""
    stop = ",".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, p, w[p:p+4] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM base WHERE len(w) >= 5)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
spans AS (
  SELECT rid, sum(least(5, coalesce(lead_p - p, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS lead_p FROM twice) GROUP BY rid),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop
  FROM base LEFT JOIN spans USING (rid)),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (n_words < 10 OR (word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 15.0)) AS ok_word_length,
    (n_words < 10 OR n_symbols / greatest(n_words, 1) <= 0.1) AS ok_symbols,
    (n_words < 10 OR n_dup_lines / greatest(n_lines, 1) <= 0.5) AS ok_repeated_lines,
    (n_words < 50 OR n_stop / greatest(n_words, 1) >= 0.02) AS ok_stop_words
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND ok_word_length AND ok_symbols AND ok_repeated_lines AND ok_stop_words) AS kept,
  n_lines, n_stop, ok_word_length, ok_symbols, ok_repeated_lines, ok_stop_words
FROM judged"""
