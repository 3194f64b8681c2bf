"""Checks of entries' content over time, running actions that went stale, and the presets of a copy's life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTPUT = 255


def check(outputs: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """The state of checks after a run. ``outputs`` has id and output (null where the check could not run), ``state``
    id, check_status, output, last_check, last_success of earlier runs. A check fails where it could not run or its
    output differs from the last good one; then output and last_success stay. ``outcome`` tells first, same, changed or error;
    entries that this run did not check (outcome null) keep their state."""
    run = outputs.select(F.col("id").alias("run_id"), F.left(F.col("output"), F.lit(OUTPUT)).alias("run_output"))
    both = state.join(run, F.col("id") == F.col("run_id"), "full_outer")
    ran = F.col("run_id").isNotNull()
    outcome = F.when(ran & F.col("run_output").isNull(), "error").when(ran & F.col("output").isNull(), "first").when(ran & (F.col("run_output") == F.col("output")), "same").when(ran, "changed")
    good = outcome.isin("first", "same")
    return both.select(
        F.coalesce("id", "run_id").alias("id"), F.when(good, "ok").when(ran, "failed").otherwise(F.col("check_status")).alias("check_status"), F.when(good, F.col("run_output")).otherwise(F.col("output")).alias("output"),
        F.when(ran, now).otherwise(F.col("last_check")).cast("long").alias("last_check"), F.when(good, now).otherwise(F.col("last_success")).cast("long").alias("last_success"), outcome.alias("outcome"),
    )


def stale_actions(entries: DataFrame, fresh: DataFrame, current: str, now: int, timeout: int) -> DataFrame:
    """Entries whose action (status ``current``) has not been heard of for ``timeout`` seconds, or never, with their status
    in ``fresh`` (id, status): ``reset`` where that is another one, ``gone`` where there is none, else ``running``."""
    silent = F.coalesce(F.col("md_update") <= now - timeout, F.lit(True))
    old = entries.filter((F.col("status") == current) & silent & ~F.coalesce(F.col("invalid"), F.lit(False)))
    newer = fresh.select(F.col("id").alias("fresh_id"), F.col("status").alias("fresh_status"))
    state = F.when(F.col("fresh_id").isNull(), "gone").when(F.col("fresh_status").eqNullSafe(F.lit(current)), "running").otherwise("reset")
    return old.join(newer, F.col("id") == F.col("fresh_id"), "left").select("id", "fresh_status", state.alias("state"))


def lifecycle(entries: DataFrame, tombstones: DataFrame, now: int, delay: int, no_archive: Column | None = None) -> DataFrame:
    """id and action of everything that a copy's life asks for: archive what is new or modified (unless ``no_archive``),
    release what is in step, remove the copies of entries deleted ``delay`` seconds ago."""
    kept = F.coalesce(no_archive, F.lit(False)) if no_archive is not None else F.lit(False)
    action = F.when(F.col("status").isin("new", "modified") & ~kept, "archive").when(F.col("status") == "synchro", "release")
    files = entries.filter((F.col("type") == "file") & ~F.coalesce(F.col("invalid"), F.lit(False))).select("id", action.alias("action")).filter("action IS NOT NULL")
    return files.unionByName(tombstones.filter((F.col("type") == "file") & (F.col("rm_time") <= now - delay)).select("id", F.lit("remove").alias("action")))
