"""Mixing sources to target weights by nested hash-threshold histograms (native functions only).

Each source gets a target number of words. A document is taken floor(target / source size) times, and once more when
its hash lies under the source's threshold. The threshold is found without sorting: words are summed by source and
hash bucket (1,024 of them at each level, the most rows that a source has in one task; the sources themselves, one row
each, are put in order in one task), the bucket in which the running sum passes the budget is the boundary, and only the boundary is split
again by the next bits of the hash, until a bucket is one hash value; that last one goes to the nearer side.

Edge cases: a null text has size 0 and is never taken; null is a source of its own, last in order; documents of equal
hash (repeated rows) share one decision; an empty table gives an empty result; other columns are ignored. Sources
whose documents are all empty have target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import materialize, packed, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEVELS, BITS = 6, 10


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), one row each.

    Water-filling in closed form: in order of cap / weight the first k sources stop at their cap (``most`` times their
    size) and the others share the rest by weight; k is the first at which no further source passes its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select(
        "source", "source_size",
        F.get(listed, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).alias("weight"),
    )
    ranked = ranked.withColumn("level", most * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    run = ranked.select(
        "*",
        (share * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(most * F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    ).withColumn("unit", (F.col("budget") - F.col("capped")) / F.col("open"))
    free = F.min(F.when(F.col("level") >= F.col("unit"), F.struct("level", "unit"))).over(everything)
    return run.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("weight") * free["unit"], (most * F.col("source_size")).cast("double")), (most * F.col("source_size")).cast("double")).alias("target"),
    )


def _bucket(level: int) -> Column:
    return F.shiftright(F.col("h"), BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def _hash() -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def limits(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """mix_source, source_size, target, whole, threshold: one row for each source of ``sized`` (source, size, h). A
    document is taken ``whole`` times, and once more if its hash is below ``threshold``."""
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    aims = materialize(
        aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "mix_source")
    )
    # One boundary row for each source: the hash prefix of the boundary bucket, the words before it, and its own.
    edge = aims.select("mix_source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("inside"))
    for level in range(LEVELS):
        known = edge.drop("inside")
        own = sized["source"].eqNullSafe(known["mix_source"])
        inside = sized.join(known, own & (F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix")))
        sums = inside.groupBy("mix_source", "budget", "prefix", "before", _bucket(level).alias("b")).agg(F.sum("size").alias("inside"))
        running = Window.partitionBy("mix_source").orderBy("b")
        over = sums.withColumn("upto", F.col("before") + F.sum("inside").over(running)).filter(F.col("upto") > F.col("budget"))
        first = over.groupBy("mix_source").agg(F.min(F.struct("b", "budget", "prefix", "upto", "inside")).alias("x"))
        edge = materialize(
            first.select(
                "mix_source", "x.budget",
                (F.shiftleft("x.prefix", BITS) + F.col("x.b")).alias("prefix"),
                (F.col("x.upto") - F.col("x.inside")).alias("before"), "x.inside",
            )
        )
    nearer = F.col("before") + F.col("inside") - F.col("budget") <= F.col("budget") - F.col("before")
    ends = edge.select(F.col("mix_source").alias("edge_source"), F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))
    # A source without a boundary holds no words beyond its budget.
    return aims.join(ends, aims["mix_source"].eqNullSafe(ends["edge_source"]), "left").select(
        "mix_source", "source_size", "target", "whole", F.coalesce("threshold", F.when(F.col("budget") > 0, F.lit(1 << 60)).otherwise(0)).alias("threshold")
    )


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return materialize(docs.select("doc_id", "source", size.alias("size"), _hash().alias("h")))


def apply(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row for each row of ``docs``."""
    sized = _sized(docs)
    ends = limits(sized, **how)
    taken = (F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")) * F.col("size")
    return sized.join(ends, sized["source"].eqNullSafe(ends["mix_source"])).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken (documents of no words stay out). Texts are
    joined with one row for each source, so they are not shuffled while that table is small."""
    ends = limits(_sized(docs), **how).select("mix_source", "whole", "threshold")
    some = packed(docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")), source=F.col("source"), h=_hash())
    copies = F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")
    joined = some.join(ends, some["source"].eqNullSafe(ends["mix_source"])).select("row", copies.alias("copies")).filter("copies > 0")
    return unpacked(joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
lv AS (SELECT *, 2 * source_size / weight AS level FROM src),
run AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(2 * sum(source_size) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM lv),
un AS (SELECT *, ((budget - capped) / open)::DOUBLE AS unit FROM run),
aim AS (
  SELECT source, source_size,
    coalesce(least(weight * (SELECT min_by(unit, level) FROM un WHERE level >= unit), (2 * source_size)::DOUBLE), (2 * source_size)::DOUBLE) AS target
  FROM un),
bud AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS budget FROM aim),
g AS (SELECT source, h, sum(size) AS s FROM sized GROUP BY source, h),
c AS (SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (
  SELECT c.source, h, CASE WHEN upto <= budget AND budget > 0 THEN 1
      WHEN upto - s <= budget AND upto - budget <= budget - (upto - s) AND upto > budget
           AND h = (SELECT min(h) FROM c c2 WHERE c2.source IS NOT DISTINCT FROM c.source AND c2.upto > budget) THEN 1 ELSE 0 END AS extra
  FROM c JOIN bud ON c.source IS NOT DISTINCT FROM bud.source)
SELECT doc_id, size, source_size, target, ((whole + extra) * size)::BIGINT AS taken
FROM sized JOIN bud ON sized.source IS NOT DISTINCT FROM bud.source
JOIN e ON e.source IS NOT DISTINCT FROM sized.source AND e.h = sized.h"""
