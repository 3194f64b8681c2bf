"""Find and du over roots: everything at once where a root is the file system's own, else only what lies below the roots.

Roots are few and named by their paths. Below them names are walked level by level, each level a join of the directories
found last, so the work follows the size of the subtrees; paths come with the walk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import matched
from ..storage import materialize
from . import namespace as N


def resolve(names: DataFrame, paths: Sequence[str], root: str) -> dict[str, str]:
    """The id of each path that is there: one lookup of (parent, name) pairs for each level of all paths together."""
    at = {p: (root, [x for x in p.split("/") if x]) for p in paths}
    while any(way for _, way in at.values()):
        wanted = {(parent, way[0]) for parent, way in at.values() if way}
        condition = F.struct("parent_id", "name").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(wanted)])
        found = {(r["parent_id"], r["name"]): r["id"] for r in names.filter(F.col("parent_id").isin(*{a for a, _ in wanted}) & condition).select("parent_id", "name", "id").limit(len(wanted)).collect()}
        at = {p: (found[parent, way[0]], way[1:]) if way else (parent, way) for p, (parent, way) in at.items() if not way or (parent, way[0]) in found}
    return {p: parent for p, (parent, _) in at.items()}


def walk(names: DataFrame, starts: DataFrame) -> DataFrame:
    """Ids and paths of ``starts`` (id, path) and of every name below them. A directory is entered once, so rings end."""
    edges = names.select(F.col("id").alias("child"), F.col("parent_id").alias("parent"), "name")
    level = materialize(starts.select("id", "path"))
    found, entered = level, level.select(F.col("id").alias("entered"))
    while True:
        below = edges.join(level, F.col("parent") == F.col("id")).select(F.col("child").alias("id"), F.concat(F.rtrim("path", F.lit("/")), F.lit("/"), "name").alias("path"))
        level = materialize(below)
        if level.isEmpty():
            return found
        found = found.unionByName(level)
        level = level.join(entered, F.col("id") == F.col("entered"), "left_anti")
        entered = entered.unionByName(level.select(F.col("id").alias("entered")))


def listed(entries: DataFrame, names: DataFrame, root: str, roots: Sequence[str] = ("/",), root_entry: dict | None = None) -> DataFrame:
    """Entries with ``path`` and ``root``, one row for each name at or below ``roots``. The file system's root has no
    name: its row is made of ``root_entry``, or is left out. A root that isn't there gives nothing."""
    parts = []
    if "/" in roots:
        paths = N.all_paths(names, root).select(F.col("id").alias("path_id"), "path")
        bulk = entries.join(paths, F.col("id") == F.col("path_id")).select(*entries.columns, "path", F.lit("/").alias("root"))
        parts.append(bulk)
        if root_entry is not None:
            known = entries.schema
            row = entries.sparkSession.createDataFrame([tuple(root_entry.get(c, root if c == "id" else None) for c in known.names)], known)
            parts.append(row.select("*", F.lit("/").alias("path"), F.lit("/").alias("root")))
    for path, own in resolve(names, [r for r in roots if r != "/"], root).items():
        start = entries.sparkSession.createDataFrame([(own, path)], "id string, path string")
        below = walk(names, start).select(F.col("id").alias("path_id"), "path")
        parts.append(entries.join(below, F.col("id") == F.col("path_id")).select(*entries.columns, "path", F.lit(path).alias("root")))
    if not parts:
        return entries.limit(0).select("*", F.lit("").alias("path"), F.lit("").alias("root"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def find(entries: DataFrame, names: DataFrame, root: str, roots: Sequence[str] = ("/",), test: Column | None = None, kinds: str = "all", root_entry: dict | None = None) -> DataFrame:
    """What matches ``test`` at or below the roots; ``kinds`` is all, dirs or no_dirs. An entry below two roots comes twice."""
    rows = listed(entries, names, root, roots, root_entry)
    if kinds != "all":
        is_dir = F.coalesce(F.col("type") == "dir", F.lit(False))
        rows = rows.filter(is_dir if kinds == "dirs" else ~is_dir)
    return rows if test is None else rows.filter(matched(test))


def du(entries: DataFrame, names: DataFrame, root: str, roots: Sequence[str], test: Column | None = None, total: bool = False) -> DataFrame:
    """count, blocks, size and used (bytes of blocks) of each root by type, or (``total``) of all roots together, of the
    entries that match ``test``. An entry with several names below one root counts once there."""
    rows = find(entries, names, root, roots, test).groupBy("root", "id").agg(F.first("type").alias("type"), F.first("blocks").alias("blocks"), F.first("size").alias("size"))
    sums = [F.count(F.lit(1)).alias("count"), F.sum("blocks").alias("blocks"), F.sum("size").alias("size"), (F.sum("blocks") * 512).alias("used")]
    return rows.agg(*sums) if total else rows.groupBy("root", "type").agg(*sums)
