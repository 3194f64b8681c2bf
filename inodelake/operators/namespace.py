"""The namespace as a graph of (parent, name) edges: paths, children, directory aggregates, subtrees, find and du."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mean
from ..storage import materialize


def _climb(start: DataFrame, edges: DataFrame, root: str, rounds: int | None) -> DataFrame:
    """Pointer jumping: every row holds a node above it and the path from there; each round joins the rows with the
    table of what that node has reached so far, so depth d takes about log2 d rounds. Without ``rounds`` it goes on until
    no node has anything above it; each round is then written out. A ring of directories ends after as many rounds as
    a chain of all of them would take."""
    reach = edges.select(F.col("id").alias("node"), F.col("parent_id").alias("up"), F.col("name").alias("way"))
    if rounds is None:
        reach = materialize(reach)
    most = reach.count().bit_length() if rounds is None else rounds
    for _ in range(most):
        if rounds is None and reach.join(reach.select(F.col("node").alias("up")), "up", "left_semi").isEmpty():
            break
        above = reach.select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("way").alias("way2"))
        reach = reach.join(above, reach["up"] == above["n2"], "left").select("node", F.coalesce("up2", "up").alias("up"), F.when(F.col("way2").isNotNull(), F.concat("way2", F.lit("/"), "way")).otherwise(F.col("way")).alias("way"))
        if rounds is None:
            reach = materialize(reach)
    top = reach.select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("way").alias("way2"))
    done = start.join(top, start["parent_id"] == top["n2"], "left")
    end = F.coalesce("up2", "parent_id")
    rest = F.when(F.col("way2").isNotNull(), F.concat("way2", F.lit("/"), "name")).otherwise(F.col("name"))
    return done.select("id", "parent_id", "name", F.when(end == root, F.concat(F.lit("/"), rest)).otherwise(F.concat(end, F.lit("/"), rest)).alias("path"))


def all_paths(names: DataFrame, root: str, rounds: int | None = None, directories: DataFrame | None = None) -> DataFrame:
    """Every path of every id, one row for each name. Only ids that are somebody's parent are climbed through; a chain
    that ends at an unknown parent keeps that parent's id in front. All levels of
    directories are resolved, or 2 ** ``rounds`` of them."""
    parents = names.select(F.col("parent_id").alias("id")).distinct() if directories is None else directories.select("id")
    edges = names.join(parents, "id", "left_semi").groupBy("id").agg(F.min(F.struct("parent_id", "name")).alias("x")).select("id", "x.parent_id", "x.name")
    return _climb(names, edges, root, rounds)


def paths_of(some: DataFrame, names: DataFrame, root: str, rounds: int | None = None) -> DataFrame:
    """``all_paths`` of some names (id, parent_id, name) only."""
    parents = names.select(F.col("parent_id").alias("id")).distinct()
    edges = names.join(parents, "id", "left_semi").groupBy("id").agg(F.min(F.struct("parent_id", "name")).alias("x")).select("id", "x.parent_id", "x.name")
    return _climb(some, edges, root, rounds)


def one_path(names: DataFrame, root: str, rounds: int | None = None) -> DataFrame:
    return all_paths(names, root, rounds).groupBy("id").agg(F.min("path").alias("path"))


def children(names: DataFrame, parents: DataFrame, entries: DataFrame) -> DataFrame:
    """Names below a set of parents with their entries' attributes."""
    return names.join(parents, "parent_id", "left_semi").join(entries, "id", "left")


def directory_totals(names: DataFrame, entries: DataFrame) -> DataFrame:
    """dircount of every directory and the rounded average size of the files in it."""
    e = entries.select("id", "type", "size")
    return names.join(e, "id", "left").groupBy("parent_id").agg(F.count(F.lit(1)).alias("dircount"), mean(F.when(F.col("type") == "file", F.col("size"))).alias("avgsize"))


def empty_directories(names: DataFrame, entries: DataFrame) -> DataFrame:
    parents = names.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"))
    return entries.filter("type = 'dir'").join(parents, "id", "left_anti")


def without_name(names: DataFrame, entries: DataFrame) -> DataFrame:
    return entries.join(names.select("id"), "id", "left_anti")


def subtree_ids(names: DataFrame, roots: DataFrame, levels: int | None = None) -> DataFrame:
    """Breadth first: the ids below ``roots`` (id) by level, down to the last one or to ``levels``. Each round joins the
    frontier only and is written out; visited ids stay out."""
    frontier = materialize(roots.select("id").distinct())
    seen = frontier.withColumn("level", F.lit(0))
    level = 0
    while level != levels and not frontier.isEmpty():
        level += 1
        below = names.join(frontier.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        frontier = materialize(below.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("level", F.lit(level)))
    return seen


def du(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Per root and type: count, blocks and size of the root and all below it. ``paths`` has path, type, blocks, size."""
    marks = F.filter(F.array(*[F.when((F.col("path") == r) | F.col("path").startswith(r.rstrip("/") + "/"), F.lit(r)) for r in roots]), lambda x: x.isNotNull())
    return paths.withColumn("root", F.explode(marks)).groupBy("root", "type").agg(F.count(F.lit(1)).alias("count"), F.sum("blocks").alias("blocks"), F.sum("size").alias("size"), (F.sum("blocks") * 512).alias("used"))


def rename_ids(names: DataFrame, id_map: DataFrame) -> DataFrame:
    """Children of a replaced id move to the new one. ``id_map`` is (old_id, new_id)."""
    return names.join(id_map, names["parent_id"] == id_map["old_id"], "left").select("id", F.coalesce("new_id", "parent_id").alias("parent_id"), "name")
