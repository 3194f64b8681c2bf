"""Classes of similar nodes, without listing the pairs of a crowd.

Nodes meet in buckets. Inside a bucket no pairs are listed at first: ``TURNS`` times, each node is verified against one
leader of its buckets that lies in another class (the node that meets most others, as an original meets its variants).
Then a caller's own exact search names the pairs that may still be links between different classes. Verified links are
contracted at once, so later turns see classes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import counted, materialize

TURNS = 2
#: Pairs of a node for each of the keys that its pairs are dealt over when texts are fetched.
PAIRS_EVERY = 64


def components(edges: DataFrame) -> DataFrame:
    """id, comp for every end of ``edges`` (a, b): comp is the least id reachable. Alternates large-star and small-star
    steps, which keep the graph's size, until nothing changes; each round is written out."""
    mark = F.bit_xor(F.xxhash64("a", "b")).alias("mark")
    edges, before = counted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), mark)
    while before["n"]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["v"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select("a", F.col("m").alias("b")))
        edges, now = counted(small.filter("a <> b").distinct(), mark)
        if now == before:
            break
        before = now
    # At rest every edge leads to the root of its star.
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, comp of all nodes linked so far, after ``links`` (a, b) have joined classes. Nodes not listed are alone."""
    if labels is None:
        return materialize(components(links))
    ends = links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    roots = materialize(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    moved = labels.join(roots.toDF("comp", "root"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    return materialize(moved.union(roots.join(labels, "id", "left_anti").select("id", "comp")))


def placed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` (id, ...) with the class of each id in ``comp``."""
    if labels is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def mixed(rows: DataFrame, *measures: Column) -> DataFrame:
    """bucket and ``measures`` of the buckets of ``rows`` (bucket, comp) that hold nodes of several classes."""
    ends = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *measures)
    return ends.filter("low <> high").drop("low", "high")


def popular(rows: DataFrame) -> DataFrame:
    """bucket, id and how many nodes the id meets in its buckets, of the buckets of several nodes."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(sizes, "bucket")
    return met.join(met.groupBy("id").agg(F.sum("n").alias("popular")), "id").select("bucket", "id", "popular")


def offers(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): every node with the most popular one of another class that leads one of its buckets. A bucket has
    two leaders, the most popular node of all and that of the other classes, so this makes one pair a node at most."""
    best = F.struct(F.col("popular").alias("p"), (-F.col("id")).alias("o"), F.col("id").alias("lead"), F.col("comp").alias("lead_comp"))
    first = mixed(rows, F.max(best).alias("x")).select("bucket", F.col("x.lead").alias("l1"), F.col("x.lead_comp").alias("c1"), F.col("x.p").alias("p1"))
    led = rows.join(first, "bucket")
    second = led.filter("comp <> c1").groupBy("bucket").agg(F.max(best).alias("y")).select("bucket", F.col("y.lead").alias("l2"), F.col("y.p").alias("p2"))
    led = led.join(second, "bucket")
    own = F.col("comp") == F.col("c1")
    pairs = led.select(F.col("id").alias("a"), F.when(own, F.col("l2")).otherwise(F.col("l1")).alias("b"), F.when(own, F.col("p2")).otherwise(F.col("p1")).alias("p"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("p", "b")).alias("b"))


def with_text(pairs: DataFrame, texts: DataFrame, end: str) -> DataFrame:
    """``pairs`` with the text of the node in column ``end``. A node of many pairs is dealt over several keys, one for
    about ``PAIRS_EVERY`` of them, so that no task gets all pairs of a popular node. How many keys a node has reaches
    its pairs by a join that is dealt over ``PAIRS_EVERY`` parts as well."""
    parts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS_EVERY)
    parts, known = counted(parts.select(end, F.ceil(F.col("n") / PAIRS_EVERY).cast("int").alias("parts")))
    own = texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}"))
    if not known["n"]:
        return pairs.join(own, end)
    spread = parts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(PAIRS_EVERY - 1))))
    draw = F.xxhash64("a", "b")
    dealt = pairs.withColumn("deal", F.pmod(draw, F.lit(PAIRS_EVERY)).cast("int")).join(spread, [end, "deal"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.shiftright(draw, 8), F.coalesce("parts", F.lit(1))).cast("int")).drop("deal", "parts")
    copies = own.join(parts, end, "left")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [end, "part"]).drop("part")


def classes(rows: DataFrame, similar: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame | None], DataFrame], turns: int = TURNS) -> DataFrame | None:
    """id, comp of the nodes that have a link (None if there is no link at all).

    ``rows`` has bucket, id, popular; ``similar`` keeps the pairs (a, b) that are links; ``across`` gets the classes so
    far and returns every pair that may be a link between two of them."""
    labels = tried = None
    for turn in range(turns + 1):
        found = offers(placed(rows, labels)) if turn < turns else across(labels)
        if tried is not None:
            found = found.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti")
        pairs, new = counted(found.select("a", "b"))
        if not new["n"]:
            continue
        tried = pairs if tried is None else tried.union(pairs)
        links, good = counted(similar(pairs).select("a", "b"))
        if good["n"]:
            labels = merged(labels, links)
    return labels
