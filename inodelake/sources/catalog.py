"""Catalog tables (entries, names, stripes, changelog, capacity) as DataFrames.

``from_listing`` derives entries and names from any listing of stat rows. The views below derive a catalog from the
star-schema tables; each has the same derivation as SQL, so that queries can be held against another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which ages are computed in registered queries.
NOW = 1_000_000_000
ROOT = "0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    """Epoch seconds of a timestamp with or without time zone, read as UTC wall clock in the latter case."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def from_listing(listing: DataFrame, access_is_atime_only: bool = False) -> DataFrame:
    """Stat rows (path, ino, uid, gid, size, blocks, atime, mtime, ctime, type, st_mode, nlink) to entry attributes:
    last access is the later of atime and mtime unless only atime counts, mode keeps the 12 permission bits."""
    access = F.col("atime") if access_is_atime_only else F.greatest("atime", "mtime")
    return listing.select(
        F.col("ino").cast("string").alias("id"), "uid", "gid", "size", "blocks", F.least("ctime", "mtime").alias("creation_time"), access.alias("last_access"),
        F.col("mtime").alias("last_mod"), F.col("ctime").alias("last_mdchange"), "type", F.col("st_mode").bitwiseAND(0o7777).alias("mode"), "nlink", F.col("path").alias("fullpath"),
    )


def scan_filter(listing: DataFrame, ignore: list[Column]) -> DataFrame:
    """Keep rows that every ignore expression clearly does not match: a match drops a row, and so does an unknown."""
    for rule in ignore:
        listing = listing.filter(~rule)
    return listing


def subtree(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Partial scan: the directory itself and all below it."""
    return df.filter((F.col(path) == root) | F.col(path).startswith(root.rstrip("/") + "/"))


def evolve(df: DataFrame, schema: dict[str, str], renamed: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Schema evolution by projection: renames honoured, missing columns added with defaults, types cast, others dropped."""
    df = df.withColumnsRenamed(renamed or {})
    have, defaults = set(df.columns), defaults or {}
    return df.select(*[(F.col(c) if c in have else F.lit(defaults.get(c))).cast(t).alias(c) for c, t in schema.items()])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 20 == 0, "dir").when(k % 20 == 1, "symlink").otherwise("file")
    scale = F.when(k % 4 == 0, 1).when(k % 4 == 1, 1024).when(k % 4 == 2, 1048576).otherwise(33554432).cast("long")
    size = F.when(k % 20 == 0, 4096).when(k % 13 == 0, 0).otherwise(F.floor("o_totalprice").cast("long") * scale).cast("long")
    mod = epoch("o_orderdate")
    base = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), k.alias("num"), F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("uid"), F.concat(F.lit("g"), F.col("o_custkey") % 7).alias("gid"),
        (F.col("o_custkey") % 5).alias("projid"), kind.alias("type"), size.alias("size"), mod.alias("last_mod"), (mod + (k % 400) * 86400).alias("last_access"),
        (mod - (k % 30) * 86400).alias("creation_time"), F.when(k % 3 == 0, 420).when(k % 3 == 1, 493).otherwise(511).cast("int").alias("mode"), (1 + k % 2).cast("int").alias("nlink"),
        F.when(F.col("o_orderpriority").startswith("1"), "new").when(F.col("o_orderpriority").startswith("2"), "modified").when(F.col("o_orderpriority").startswith("3"), "synchro").when(F.col("o_orderpriority").startswith("5"), "released").alias("status"),
        (k % 97 == 0).alias("invalid"), F.when(k % 11 == 0, "pool_a").when(k % 11 < 6, "pool_b").alias("ost_pool"),
    )
    return base.withColumn("blocks", F.floor((F.col("size") + 511) / 512).cast("long"))


ENTRIES = """entries AS (
  SELECT *, ((size + 511) // 512)::BIGINT AS blocks FROM (
  SELECT o_orderkey::VARCHAR AS id, o_orderkey AS num, 'u' || (o_custkey % 50) AS uid, 'g' || (o_custkey % 7) AS gid, o_custkey % 5 AS projid,
    CASE WHEN o_orderkey % 20 = 0 THEN 'dir' WHEN o_orderkey % 20 = 1 THEN 'symlink' ELSE 'file' END AS type,
    (CASE WHEN o_orderkey % 20 = 0 THEN 4096 WHEN o_orderkey % 13 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT *
      (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 33554432 END)::BIGINT END)::BIGINT AS size,
    epoch(o_orderdate)::BIGINT AS last_mod, epoch(o_orderdate)::BIGINT + (o_orderkey % 400) * 86400 AS last_access,
    epoch(o_orderdate)::BIGINT - (o_orderkey % 30) * 86400 AS creation_time,
    (CASE o_orderkey % 3 WHEN 0 THEN 420 WHEN 1 THEN 493 ELSE 511 END)::INTEGER AS mode, (1 + o_orderkey % 2)::INTEGER AS nlink,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'new' WHEN '2' THEN 'modified' WHEN '3' THEN 'synchro' WHEN '5' THEN 'released' END AS status,
    o_orderkey % 97 = 0 AS invalid, CASE WHEN o_orderkey % 11 = 0 THEN 'pool_a' WHEN o_orderkey % 11 < 6 THEN 'pool_b' END AS ost_pool
  FROM orders))"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of directories (every 20th id) and a second name for some files (hard links)."""
    e = entries(spark, sf_dir).filter("num > 0")
    name = F.concat(F.when(F.col("type") == "dir", "d").otherwise("f"), F.col("num"))
    first = e.select("id", (F.floor(F.col("num") / 400).cast("long") * 20).cast("string").alias("parent_id"), name.alias("name"))
    second = e.filter("num % 20 = 7").select("id", (F.floor(F.col("num") / 800).cast("long") * 20).cast("string").alias("parent_id"), F.concat(name, F.lit("_link")).alias("name"))
    return first.unionAll(second)


NAMES = """names AS (
  SELECT id, ((num // 400) * 20)::BIGINT::VARCHAR AS parent_id, (CASE type WHEN 'dir' THEN 'd' ELSE 'f' END) || num AS name FROM entries WHERE num > 0
  UNION ALL
  SELECT id, ((num // 800) * 20)::BIGINT::VARCHAR, (CASE type WHEN 'dir' THEN 'd' ELSE 'f' END) || num || '_link' FROM entries WHERE num > 0 AND num % 20 = 7)"""


def stripe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), (F.col("l_linenumber") - 1).cast("int").alias("stripe_index"), (F.col("l_suppkey") % 16).cast("int").alias("ostidx")).distinct()


def striping(stripes: DataFrame) -> DataFrame:
    """id and its OSTs in the order of its stripes, of which a file has few."""
    items = F.array_sort(F.collect_list(F.struct("stripe_index", "ostidx")))
    return stripes.groupBy("id").agg(F.transform(items, lambda x: x["ostidx"]).alias("osts"))


STRIPES = "stripe_items AS (SELECT DISTINCT l_orderkey::VARCHAR AS id, (l_linenumber - 1)::INTEGER AS stripe_index, (l_suppkey % 16)::INTEGER AS ostidx FROM lineitem)"


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "CREATE").when(kind == "view", "CLOSE").when(kind == "click", "MTIME").when(kind == "purchase", "SETATTR").otherwise("UNLINK")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), epoch("ts").alias("time"), op.alias("type"), (F.col("user_id") % 4).alias("mdt"), F.col("user_id").cast("string").alias("tfid"))


CHANGELOG = """changelog AS (
  SELECT event_id AS idx, epoch(ts)::BIGINT AS time, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'CLOSE' WHEN 'click' THEN 'MTIME'
    WHEN 'purchase' THEN 'SETATTR' ELSE 'UNLINK' END AS type, user_id % 4 AS mdt, user_id::VARCHAR AS tfid FROM events)"""


def sql(body: str, *views: str) -> str:
    """``body`` over the given derived views."""
    return f"WITH RECURSIVE {', '.join(views or (ENTRIES,))} {body}"
