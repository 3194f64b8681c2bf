"""Stored paths of directories after some of them moved: only what lies below a moved one is worked out anew.

``paths`` is the stored table (id, path), one row for each directory; ``moves`` has id, parent_id and name of the new
places. A path takes the new path of its deepest moved ancestor and keeps the rest. Moved directories may lie below one
another, before and after: their own new paths come from pointer jumping over the moved ones alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import namespace as N

#: Up to so many moved directories, their paths come to the driver, and a filter on path parts what lies below them from the rest
#: before anything is joined; beyond it a join on the paths' ancestors does.
FILTERED = 100


def ancestors(path: Column) -> Column:
    """The path itself and all directories above it, the root left out, the longest last."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))


def _deepest(rows: DataFrame, moved: DataFrame, path: str) -> DataFrame:
    """``rows`` (with ``path``) with the deepest moved directory on their way: anchor (its id) and rest (what follows its
    old path); null where there is none."""
    keyed = rows.withColumn("row_key", F.struct(*rows.columns))
    each = keyed.select("row_key", F.explode(ancestors(F.col(path))).alias("above"))
    hits = each.join(moved, F.col("above") == F.col("old_path")).groupBy("row_key").agg(F.max_by("moved_id", F.length("old_path")).alias("anchor"), F.max(F.length("old_path")).alias("known"))
    found = hits.select(F.col("row_key").alias("hit_key"), "anchor", "known")
    joined = keyed.join(found, F.col("row_key") == F.col("hit_key"), "left")
    return joined.select(*rows.columns, "anchor", F.expr(f"substring({path}, known + 1)").alias("rest"))


def after_moves(paths: DataFrame, moves: DataFrame, root: str) -> DataFrame:
    """The stored table after the moves. A directory that moves below itself, or to a parent that isn't known, keeps
    its new parent's id in front of its path, as in a rebuild."""
    places = moves.select(F.col("id").alias("moved_id"), F.col("parent_id").alias("to_id"), F.col("name").alias("to_name"))
    moved = materialize(places.join(paths.select("id", F.col("path").alias("old_path")), F.col("moved_id") == F.col("id")).select("moved_id", "to_id", "to_name", "old_path"))
    parents = moved.join(paths.select(F.col("id").alias("parent"), F.col("path").alias("parent_path")), F.col("to_id") == F.col("parent"), "left")
    known = _deepest(parents.filter("parent_path IS NOT NULL").select("moved_id", "to_name", "parent_path"), moved.select(F.col("moved_id"), "old_path"), "parent_path")
    free = lambda c: F.concat(F.substring(c, 2, 1 << 30), F.lit("/"), F.col("to_name"))
    edges = known.select(
        F.col("moved_id").alias("id"), F.coalesce("anchor", F.lit(root)).alias("parent_id"),
        F.when(F.col("anchor").isNull(), free("parent_path")).when(F.col("rest") == "", F.col("to_name")).otherwise(free("rest")).alias("name"),
    )
    others = parents.filter("parent_path IS NULL").select(F.col("moved_id").alias("id"), F.col("to_id").alias("parent_id"), F.col("to_name").alias("name"))
    edges = materialize(edges.unionByName(others))
    new = materialize(moved.join(N.paths_of(edges, edges, root).select("id", F.col("path").alias("new_path")), F.col("moved_id") == F.col("id")).select("moved_id", "old_path", "new_path"))
    some = [r["old_path"] for r in new.select("old_path").limit(FILTERED + 1).collect()]
    inside, outside = paths, None
    if len(some) <= FILTERED:
        below = reduce(lambda a, b: a | b, [(F.col("path") == p) | F.col("path").startswith(p + "/") for p in some], F.lit(False))
        inside, outside = paths.filter(below), paths.filter(~below)
    placed = _deepest(inside.select("id", "path"), new.select("moved_id", "old_path"), "path")
    ends = new.select(F.col("moved_id").alias("end_id"), "new_path")
    changed = placed.join(ends, F.col("anchor") == F.col("end_id"), "left").select("id", F.when(F.col("anchor").isNull(), F.col("path")).otherwise(F.concat("new_path", "rest")).alias("path"))
    return changed if outside is None else changed.unionByName(outside.select("id", "path"))
