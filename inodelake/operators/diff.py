"""Catalog changes: merge, update, remove, tombstones, garbage collection and snapshot diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(catalog: DataFrame, batch: DataFrame, key: str = "id", fill_only: bool = False) -> DataFrame:
    """A new snapshot: known attributes of ``batch`` overwrite (or only fill), rows unknown so far are added."""
    new = batch.withColumnsRenamed({c: f"new_{c}" for c in batch.columns})
    joined = catalog.join(new, catalog[key] == new[f"new_{key}"], "full_outer")

    def pick(c: str):
        if f"new_{c}" not in new.columns:
            return F.col(c)
        order = (c, f"new_{c}") if fill_only or c == key else (f"new_{c}", c)
        return F.coalesce(*order).alias(c)

    return joined.select(*[pick(c) for c in catalog.columns])


def replaced(catalog: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The catalog with whole rows of ``batch`` in place of those of the same id."""
    new = batch.select(*catalog.columns)
    return new.unionByName(remove(catalog, new, key))


def remove(catalog: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return catalog.join(ids.select(key), key, "left_anti")


def soft_remove(catalog: DataFrame, ids: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """The rest of the catalog and the tombstones of what went."""
    return remove(catalog, ids), catalog.join(ids.select("id"), "id", "left_semi").withColumn("rm_time", F.lit(at))


def stale(entries: DataFrame, scan_start: int, seen: str = "md_update", within: str | None = None) -> DataFrame:
    """What a finished scan has not seen; for a partial scan only below its directory."""
    old = entries.filter(F.col(seen) < scan_start)
    return old if within is None else old.filter((F.col("path") == within) | F.col("path").startswith(within.rstrip("/") + "/"))


def untagged(ids: DataFrame, seen: DataFrame) -> DataFrame:
    return ids.join(seen, "id", "left_anti")


def diff(old: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """One row for each difference: ``++`` new, ``--`` gone, and for a changed attribute its name with both values.
    Attributes unknown on either side are not compared."""
    o = old.select(F.col(key).alias("old_id"), *[F.col(c).cast("string").alias(f"old_{c}") for c in columns])
    n = new.select(F.col(key).alias("new_id"), *[F.col(c).cast("string").alias(f"new_{c}") for c in columns])
    both = o.join(n, F.col("old_id") == F.col("new_id"), "full_outer")
    side = F.when(F.col("old_id").isNull(), "++").when(F.col("new_id").isNull(), "--")
    each = [F.when(F.col(f"old_{c}") != F.col(f"new_{c}"), F.struct(F.lit("-+").alias("op"), F.lit(c).alias("attribute"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new"))) for c in columns]
    whole = F.when(side.isNotNull(), F.struct(side.alias("op"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    rows = both.select(F.coalesce("old_id", "new_id").alias(key), F.explode(F.filter(F.array(whole, *each), lambda x: x.isNotNull())).alias("d"))
    return rows.select(key, "d.op", "d.attribute", "d.old", "d.new")


def reversed_diff(rows: DataFrame) -> DataFrame:
    """A diff as what has to be done to the other side: what is new there is to be removed, what is gone to be made."""
    op = F.when(F.col("op") == "++", "--").when(F.col("op") == "--", "++").otherwise(F.col("op"))
    return rows.withColumns({"op": op, "old": F.col("new"), "new": F.col("old")})


def backup_status(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Copy status by path: new, archiving, modified or synchro. ``listing`` has path, b_type, b_mtime, b_size, busy."""
    j = catalog.join(listing.withColumnRenamed("path", "b_path"), F.col("path") == F.col("b_path"), "left")
    state = F.when(F.col("b_path").isNull() | (F.col("b_type") != F.col("type")), "new").when(F.col("busy"), "archiving").when((F.col("b_mtime") != F.col("last_mod")) | (F.col("b_size") != F.col("size")), "modified").otherwise("synchro")
    return j.select("id", "path", state.alias("copy_status"))


def recovery_state(entries: DataFrame) -> DataFrame:
    """What a recovery could do, counted: non-files, empty files, intact, outdated and missing copies."""
    state = F.when(F.col("type") != "file", "NON_FILE").when(F.col("size") == 0, "EMPTY").when(F.col("status").isin("synchro", "released"), "OK").when(F.col("status") == "modified", "DELTA").otherwise("NOBACKUP")
    return entries.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size"))


def remove_names(names: DataFrame, entries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the names in ``gone`` (id, parent_id, name). An entry goes with its last name; one that never had a name stays."""
    rest = names.join(gone, ["id", "parent_id", "name"], "left_anti")
    lost = gone.select("id").join(rest, "id", "left_anti")
    return rest, remove(entries, lost)


def due_tombstones(tombstones: DataFrame, now: int, delay: int) -> DataFrame:
    """Soft-removed entries whose deletion was ``delay`` seconds ago or earlier."""
    return tombstones.filter(F.col("rm_time") <= now - delay)


# Attributes of the groups that a diff may be restricted to.
GROUPS = {"posix": ("uid", "gid", "type", "mode", "nlink", "size", "last_access", "last_mod"), "status": ("status",), "stripe": ("ost_pool",), "path": ("parent_id", "name")}
TIMES = ("creation_time", "last_access", "last_mod")


def diff_columns(groups: Sequence[str], columns: Sequence[str]) -> list[str]:
    """The columns to compare: those of the groups named (``all``: every one), less times (``notimes``, ``noatime``)."""
    wanted = set(columns) if "all" in groups else {c for g in groups for c in GROUPS.get(g, ())}
    less = set(TIMES) if "notimes" in groups else {"last_access"} if "noatime" in groups else set()
    return [c for c in columns if c in wanted - less]


def apply_diff(catalog: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """The catalog after a diff against what was seen is applied: changed and new rows taken over, gone ones removed."""
    return upsert(catalog.join(seen.select(key), key, "left_semi"), seen, key)


def softrm_action(kind: Column, status: Column) -> Column:
    """What the deletion of an entry does: one that was never copied, or no file, leaves no tombstone."""
    return F.when((kind != "file") | (F.coalesce(status, F.lit("new")) == "new"), "remove").otherwise("soft_remove")


def undelete_listing(tombstones: DataFrame, pattern: str | None = None, ids: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Tombstones by a regex on their path, or by id; first deleted first."""
    wanted = F.lit(True) if pattern is None else F.col(path).rlike(pattern)
    return tombstones.filter(wanted & F.col("id").isin(*ids) if ids else wanted).orderBy("rm_time", "id")


def recovery_table(entries: DataFrame) -> DataFrame:
    """id, size, recov_state: everything is still to do."""
    return entries.select("id", "size", F.lit("todo").alias("recov_state"))


def set_recovery_state(table: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` has id and ok: done or failed; the others stay as they are."""
    now = results.select(F.col("id").alias("r_id"), F.when(F.col("ok"), "done").otherwise("failed").alias("r_state"))
    return table.join(now, F.col("id") == F.col("r_id"), "left").select("id", "size", F.coalesce("r_state", "recov_state").alias("recov_state"))


def complete_recovery(table: DataFrame) -> None:
    if not table.filter("recov_state = 'todo'").isEmpty():
        raise ValueError("entries are still to be recovered")
