"""What a finished scan has not seen goes: entries, names, and tombstones with the path that an entry had.

After a full scan, entries and names older than the scan go. After a scan of one directory only names below it can be
missing: they go, and an entry goes with them if it has no other name, which one aggregation over its names tells; an
entry without any name goes too. Only names older than the scan need a path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import namespace as N


@dataclass(frozen=True)
class Collected:
    """The catalog that is left, and the tombstones (attributes, path, rm_time) of what went."""

    entries: DataFrame
    names: DataFrame
    tombstones: DataFrame


def collect(entries: DataFrame, names: DataFrame, scan_start: int, at: int, root: str, within: str | None = None) -> Collected:
    """``entries`` has id and md_update, ``names`` id, parent_id, name and path_update; a null date was never seen.
    ``within`` is the scanned directory's path; without it the scan was a full one. ``at`` is the time of removal."""
    old = lambda c: F.coalesce(F.col(c) < scan_start, F.lit(True))
    unseen = names.filter(old("path_update"))
    paths = N.paths_of(unseen.select("id", "parent_id", "name"), names.select("id", "parent_id", "name"), root)
    if within is not None:
        paths = paths.filter(F.col("path").startswith(within.rstrip("/") + "/"))
    lost = paths.groupBy("id").agg(F.count(F.lit(1)).alias("n_lost"), F.min("path").alias("path"))
    counts = names.groupBy("id").agg(F.count(F.lit(1)).alias("n_names"))
    about = counts.join(lost, "id", "left").select(F.col("id").alias("about_id"), "n_names", F.coalesce("n_lost", F.lit(0)).alias("n_lost"), "path")
    stale = entries.filter(old("md_update")).join(about, F.col("id") == F.col("about_id"), "left")
    if within is not None:
        stale = stale.filter(F.col("n_names").isNull() | (F.col("n_lost") == F.col("n_names")))
    tombstones = stale.select(*entries.columns, "path", F.lit(at).cast("long").alias("rm_time"))
    gone_names = paths.select("id", "parent_id", "name")
    return Collected(entries.join(tombstones.select("id"), "id", "left_anti"), names.join(gone_names, ["id", "parent_id", "name"], "left_anti").select(*names.columns), tombstones)


def add_tombstones(known: DataFrame, new: DataFrame) -> DataFrame:
    """Both, one row for each id: a tombstone that is there stays, but takes a path that it lacked or that is newer."""
    fresh = new.withColumnsRenamed({c: f"new_{c}" for c in new.columns})
    both = known.join(fresh, F.col("id") == F.col("new_id"), "full_outer")
    of = lambda c: (F.coalesce("new_path", "path") if c == "path" else F.when(F.col("id").isNotNull(), F.col(c)).otherwise(F.col(f"new_{c}"))).alias(c)
    return both.select(*[of(c) for c in known.columns])
