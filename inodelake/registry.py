"""All registered queries of the catalog engine, each with the SQL that it is held against (None where SQL has none).

"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import criteria as B
from .functions import expr as X
from .functions import ruletext as T
from .functions import scalar as S
from .operators import checks as H
from .operators import diff as D
from .operators import find as I
from .operators import garbage as Q
from .operators import moves as M
from .operators import namespace as N
from .operators import policy as P
from .operators import report as R
from .operators import targets as G
from .operators.ruleset import RuleSet
from .plans import cube as C
from .plans import route as W
from .plans.kept import KeptCube, KeptLatest
from .sources import catalog as K
from .sources import records as U
from .sources import sinks as O
from .sources.catalog import CHANGELOG, ENTRIES, NAMES, NOW, STRIPES, sql
from .storage import fitted, materialize, shared_dir
from .streaming import changelog as L
from .streaming import keyed as Y
from .streaming import progress as V

FLAGSHIP = "g03_top_users"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PROFILE_SQL = ", ".join(
    f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)::BIGINT AS {n}"
    for n, c in zip(
        R.PROFILE,
        ["size = 0", *[f"size >= {1 << 5 * k} AND size < {1 << 5 * (k + 1)}" for k in range(8)], f"size >= {1 << 40}"],
        strict=True,
    )
)
PATHS = """paths AS (
  SELECT n.id, n.parent_id, n.name, n.parent_id AS up, n.name AS way FROM names n
  UNION ALL
  SELECT p.id, p.parent_id, p.name, e.parent_id, e.name || '/' || p.way FROM paths p
  JOIN (SELECT id, min(parent_id) AS parent_id, arg_min(name, parent_id) AS name FROM names WHERE name NOT LIKE '%link' GROUP BY id) e ON p.up = e.id WHERE p.up <> '0'),
full_paths AS (SELECT id, parent_id, name, CASE WHEN up = '0' THEN '/' || way ELSE up || '/' || way END AS path FROM paths p
  WHERE up = '0' OR NOT EXISTS (SELECT 1 FROM names x WHERE x.id = p.up))"""


RECORDS_SQL = CHANGELOG.replace("epoch(ts)::BIGINT", "(epoch_us(ts) // 1000000)::BIGINT")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def on_entries(name: str, body: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """A query of the entries view alone."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        return query(name, sql(body))(lambda spark, sf_dir: f(K.entries(spark, sf_dir)))

    return add


# ---- sources and listings ----


@on_entries("a08_filtered_listing", "SELECT id, uid, size FROM entries WHERE type = 'file' AND size > 1000000 AND uid = 'u7'")
def _(e: DataFrame) -> DataFrame:
    return e.filter((F.col("type") == "file") & (F.col("size") > 1_000_000) & (F.col("uid") == "u7")).select("id", "uid", "size")


@query("a09_children", sql("SELECT n.parent_id, n.id, n.name, e.type, e.size FROM names n LEFT JOIN entries e ON n.id = e.id WHERE n.parent_id IN (SELECT id FROM entries WHERE type = 'dir')", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    parents = e.filter("type = 'dir'").select(F.col("id").alias("parent_id"))
    return N.children(K.names(spark, sf), parents, e.select("id", "type", "size")).select("parent_id", "id", "name", "type", "size")


@query("a06_exists_by_name", sql("SELECT DISTINCT e.id FROM entries e WHERE EXISTS (SELECT 1 FROM names n WHERE n.id = e.id AND n.name LIKE '%\\_link' ESCAPE '\\')", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.entries(spark, sf).join(K.names(spark, sf).filter(F.col("name").endswith("_link")), "id", "left_semi").select("id")


@on_entries("a12_entry_count", "SELECT count(*)::BIGINT AS count FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.agg(F.count(F.lit(1)).alias("count"))


@on_entries("a01_scan_derivation", "SELECT id, greatest(last_access, last_mod) AS last_access, mode & 4095 AS mode FROM entries WHERE NOT (type = 'symlink') AND NOT (size = 0)")
def _(e: DataFrame) -> DataFrame:
    kept = K.scan_filter(e, [F.col("type") == "symlink", F.col("size") == 0])
    return kept.select("id", F.greatest("last_access", "last_mod").alias("last_access"), F.col("mode").bitwiseAND(0o7777).alias("mode"))


@on_entries("a17_schema_evolution", "SELECT id::BIGINT AS entry, uid AS owner, size::DOUBLE AS size, 'none' AS tag FROM entries")
def _(e: DataFrame) -> DataFrame:
    return K.evolve(e, {"entry": "bigint", "owner": "string", "size": "double", "tag": "string"}, {"id": "entry", "uid": "owner"}, {"tag": "none"})


# ---- predicates ----


@on_entries("b08_ordered_three_valued", "SELECT id, CASE WHEN status IS NULL THEN NULL WHEN status = 'new' THEN TRUE ELSE size > 1000000 END AS any_of, CASE WHEN status IS NULL THEN NULL WHEN status <> 'new' THEN FALSE ELSE size > 1000000 END AS all_of FROM entries")
def _(e: DataFrame) -> DataFrame:
    a, b = F.col("status") == "new", F.col("size") > 1_000_000
    return e.select("id", X.or_(a, b).alias("any_of"), X.and_(a, b).alias("all_of"))


@on_entries("b10_allow_null", "SELECT id, status FROM entries WHERE status <> 'new' OR status IS NULL")
def _(e: DataFrame) -> DataFrame:
    return e.filter(X.allow_null(F.col("status"), "!=", "new", text=True)).select("id", "status")


@query("b12_name_globs", sql("SELECT id, name, regexp_full_match(name, 'f.*1.') AS plain, regexp_full_match(name, '[^f].*') AS other, lower(name) LIKE 'f%7\\_link' ESCAPE '\\' AS nocase FROM names", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return K.names(spark, sf).select("id", "name", X.like_glob(n, "f*1?").alias("plain"), X.like_glob(n, "[!f]*").alias("other"), X.like_glob(n, "F*7_LINK", ignore_case=True).alias("nocase"))


@query("b13_path_globs", sql("SELECT id, path, regexp_full_match(path, '/d[^/]*/f[^/]*') AS one_level, regexp_full_match(path, '/d20/.*') OR path = '/d20' AS tree FROM full_paths", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = N.all_paths(K.names(spark, sf), K.ROOT)
    return p.select("id", "path", X.like_glob(F.col("path"), "/d*/f*", path=True).alias("one_level"), X.in_tree(F.col("path"), "/d20").alias("tree"))


@on_entries("b16_integer_sets", "SELECT id, projid FROM entries WHERE projid IN (1, 3, 4)")
def _(e: DataFrame) -> DataFrame:
    return e.filter(F.col("projid").isin(X.int_set("1,3-4"))).select("id", "projid")


@on_entries("b18_maintenance_ages", f"SELECT id FROM entries WHERE last_mod < {NOW} - 5184000 AND last_access <= {NOW} - 86400")
def _(e: DataFrame) -> DataFrame:
    age = X.time_modify(X.parse_duration("120d"), 0.5, X.parse_duration("10d"))
    return e.filter(X.age(F.col("last_mod"), ">", age, NOW) & X.age(F.col("last_access"), ">=", X.parse_duration("1d"), NOW)).select("id")


@on_entries("b26_criteria", f"""SELECT id, size >= 1048576 AS big, uid LIKE 'u1%' AS owner, {NOW} - last_mod > 103680000 AS old, coalesce(status, '') = '' AS no_status,
  CASE WHEN type <> 'file' THEN FALSE ELSE ost_pool LIKE 'pool%' END AS pool, projid <> 2 AS project FROM entries""")
def _(e: DataFrame) -> DataFrame:
    return e.select(
        "id", (F.col("size") >= X.parse_size("1M")).alias("big"), X.like_glob(F.col("uid"), "u1*").alias("owner"), X.age(F.col("last_mod"), ">", X.parse_duration("1200d"), NOW).alias("old"),
        X.status(F.col("status"), "").alias("no_status"), X.ost_pool(F.col("type"), F.col("ost_pool"), "pool*").alias("pool"), X.compare(F.col("projid"), "!=", 2).alias("project"),
    )


@query("b32_ost_index", sql("SELECT e.id, coalesce(bool_or(s.ostidx = 3), FALSE) AS on_three FROM entries e LEFT JOIN stripe_items s ON e.id = s.id GROUP BY e.id", ENTRIES, STRIPES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    osts = K.stripe_items(spark, sf).groupBy("id").agg(F.collect_set("ostidx").alias("osts"))
    return K.entries(spark, sf).join(osts, "id", "left").select("id", X.ost_index(F.col("osts"), 3).alias("on_three"))


@on_entries("b36_find", f"SELECT id, uid, size FROM entries WHERE uid LIKE 'u2%' AND type = 'file' AND size > 10485760 AND NOT ({NOW} - last_mod < 864000) AND nlink = 1")
def _(e: DataFrame) -> DataFrame:
    tests = X.all_of(X.like_glob(F.col("uid"), "u2*"), F.col("type") == "file", X.find_size(F.col("size"), "+10M"), X.find_time(F.col("last_mod"), "-10", NOW, negate=True), F.col("nlink") == 1)
    return e.filter(tests).select("id", "uid", "size")


@on_entries("b42_rest_filters", "SELECT id, uid FROM entries WHERE uid LIKE 'u%3' AND gid NOT LIKE 'g6' AND size > 5000 AND projid > 2")
def _(e: DataFrame) -> DataFrame:
    return e.filter(F.col("uid").like("u%3") & ~F.col("gid").like("g6") & (F.col("size") > 5000) & (F.col("projid") > 2)).select("id", "uid")


@on_entries("b44_row_access", "SELECT id, uid, gid FROM entries WHERE uid IN ('u1', 'u2') OR gid IN ('g3')")
def _(e: DataFrame) -> DataFrame:
    return e.filter(X.row_access(["u1", "u2"], ["g3"])).select("id", "uid", "gid")


@on_entries("b44_name_access", "SELECT id, uid, mode FROM entries WHERE uid IN ('u1', 'u2') OR gid IN ('g3') OR mode & 3 > 0")
def _(e: DataFrame) -> DataFrame:
    return e.filter(X.row_access(["u1", "u2"], ["g3"], names=True)).select("id", "uid", "mode")


@on_entries("b47_find_printf", "SELECT id, printf('%s %s %o %d %s', id, CASE type WHEN 'file' THEN 'f' WHEN 'dir' THEN 'd' ELSE 'l' END, mode, size, uid) AS line FROM entries")
def _(e: DataFrame) -> DataFrame:
    values = {"Rf": F.col("id"), "y": S.type_letter(F.col("type")), "m": S.octal(F.col("mode")), "s": F.col("size"), "u": F.col("uid")}
    return e.select("id", S.printed("%Rf %y %m %s %u", values).alias("line"))


@on_entries("b47_printf_widths", r"""SELECT id, printf('%-12s|%16d|%08d|', id, size, num) || strftime(make_timestamp(last_mod * 1000000), '%Y-%m-%d %H:%M') || '|' || strftime(make_timestamp(creation_time * 1000000), '%Y/%m/%d %H:%M:%S') || chr(9) || 'A%' AS line FROM entries""")
def _(e: DataFrame) -> DataFrame:
    values = {"Rf": F.col("id"), "s": F.col("size"), "n": F.col("num"), "T": F.col("last_mod"), "RC": F.col("creation_time")}
    return e.select("id", S.printed(r"%-12Rf|%16s|%08n|%T{%F %H:%M}|%RC\t\x41%%", values).alias("line"))


@on_entries("b46_find_ls", """SELECT id, printf('[%s] %-4s %s %3d  %-10s %-10s %15d %20s  %-15s ', id, type, CASE mode WHEN 420 THEN 'rw-r--r--' WHEN 493 THEN 'rwxr-xr-x' ELSE 'rwxrwxrwx' END, nlink, uid, gid, size, strftime(make_timestamp(last_mod * 1000000), '%Y/%m/%d %H:%M:%S'), coalesce(status, '')) || '/' || id AS line FROM entries""")
def _(e: DataFrame) -> DataFrame:
    values = {c: F.col(c) for c in ("id", "type", "mode", "nlink", "uid", "gid", "size", "last_mod")}
    return e.select("id", S.listed(values | {"path": F.concat(F.lit("/"), "id")}, F.col("status")).alias("line"))


# ---- scalars ----


@on_entries("c01_size_ranges", "SELECT id, CASE WHEN size = 0 THEN -1 ELSE ((length(bin(size)) - 1) // 5)::INTEGER END AS sz_range, size_label FROM (SELECT *, ['0','1~31','32~1K-','1K~31K','32K~1M-','1M~31M','32M~1G-','1G~31G','32G~1T-','+1T'][2 + CASE WHEN size = 0 THEN -1 ELSE least((length(bin(size)) - 1) // 5, 8) END] AS size_label FROM entries)")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", S.sz_range(F.col("size")).alias("sz_range"), S.size_label(F.col("size")).alias("size_label"))


@on_entries("c04_du_sizes", "SELECT id, ceil(size / 1024)::BIGINT::VARCHAR AS kb, ceil(size / 1048576)::BIGINT::VARCHAR AS mb FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", S.du_size(F.col("size"), "k").alias("kb"), S.du_size(F.col("size"), "m").alias("mb"))


@on_entries("c07_modes", """SELECT id, (CASE WHEN mode & 256 <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 128 <> 0 THEN 'w' ELSE '-' END || CASE WHEN mode & 64 <> 0 THEN 'x' ELSE '-' END ||
  CASE WHEN mode & 32 <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 16 <> 0 THEN 'w' ELSE '-' END || CASE WHEN mode & 8 <> 0 THEN 'x' ELSE '-' END ||
  CASE WHEN mode & 4 <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 2 <> 0 THEN 'w' ELSE '-' END || CASE WHEN mode & 1 <> 0 THEN 'x' ELSE '-' END) AS mode_string,
  CASE WHEN mode & 256 = 256 AND mode & 2 = 0 THEN 'ok' ELSE 'invalid' END AS guard, (mode | 256) & 4093 AS fixed FROM entries""")
def _(e: DataFrame) -> DataFrame:
    m = F.col("mode")
    return e.select("id", S.mode_string(m).alias("mode_string"), S.mode_guard(m, 0o400, 0o002).alias("guard"), S.fixed_mode(m, 0o400, 0o002).alias("fixed"))


@query("c09_paths", sql("SELECT path, len(string_split(path, '/')) - 2 AS depth, regexp_replace(path, '/[^/]*$', '') AS parent, substr(path, 2) AS relative FROM full_paths", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return N.all_paths(K.names(spark, sf), K.ROOT).select("path", S.depth(p).cast("long").alias("depth"), S.parent_dir(p).alias("parent"), S.relative(p, "/").alias("relative"))


@on_entries("c14_labels", "SELECT DISTINCT uid, '#' || substr(md5(uid), 1, 6) AS colour FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("uid", S.colour(F.col("uid")).alias("colour")).distinct()


@on_entries("c15_time_buckets", "SELECT (last_mod // 86400 * 86400)::BIGINT AS day, (last_mod // 2628000 * 2628000)::BIGINT AS month, count(*) AS count FROM entries GROUP BY 1, 2")
def _(e: DataFrame) -> DataFrame:
    return e.groupBy(S.time_bucket(F.col("last_mod"), "day").alias("day"), S.time_bucket(F.col("last_mod"), "month").alias("month")).agg(F.count(F.lit(1)).alias("count"))


# ---- joins and namespace ----


@query("d02_stripe_semi_join", sql("SELECT id, size FROM entries WHERE id IN (SELECT id FROM stripe_items WHERE ostidx IN (2, 5))", ENTRIES, STRIPES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.entries(spark, sf).join(K.stripe_items(spark, sf).filter(F.col("ostidx").isin(2, 5)), "id", "left_semi").select("id", "size")


@query("d03_report_semi_join", sql("SELECT uid, count(*) AS count, sum(size)::BIGINT AS size FROM entries WHERE id IN (SELECT id FROM names WHERE name LIKE 'f1%') GROUP BY uid", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    named = K.names(spark, sf).filter(X.like_glob(F.col("name"), "f1*"))
    return K.entries(spark, sf).join(named, "id", "left_semi").groupBy("uid").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size"))


@query("d04_empty_directories", sql("SELECT id FROM entries WHERE type = 'dir' AND id NOT IN (SELECT parent_id FROM names)", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return N.empty_directories(K.names(spark, sf), K.entries(spark, sf)).select("id")


@query("d05_entries_without_name", sql("SELECT id FROM entries WHERE id NOT IN (SELECT id FROM names WHERE length(name) <> 5)", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return N.without_name(K.names(spark, sf).filter(F.length("name") != 5), K.entries(spark, sf)).select("id")


@query("d08_all_paths", sql("SELECT id, path FROM full_paths", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return N.all_paths(K.names(spark, sf), K.ROOT).select("id", "path")


@query("d07_one_path", sql("SELECT id, min(path) AS path FROM full_paths GROUP BY id", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return N.one_path(K.names(spark, sf), K.ROOT)


@query("d10_subtree", sql("SELECT id, min(level) AS level FROM walk GROUP BY id", ENTRIES, NAMES, "walk AS (SELECT '20' AS id, 0 AS level UNION SELECT n.id, w.level + 1 FROM walk w JOIN names n ON n.parent_id = w.id)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    names = K.names(spark, sf)
    return N.subtree_ids(names, names.filter("id = '20'").select("id"))


@query("d14_replace_ids", sql("SELECT id, CASE WHEN parent_id LIKE '%40' THEN 'x' || parent_id ELSE parent_id END AS parent_id, name FROM names", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    moved = K.entries(spark, sf).filter(F.col("id").endswith("40")).select(F.col("id").alias("old_id"), F.concat(F.lit("x"), "id").alias("new_id"))
    return N.rename_ids(K.names(spark, sf), moved)


@query("e11_directory_totals", sql("SELECT parent_id, count(*) AS dircount, round(avg(CASE WHEN e.type = 'file' THEN e.size END))::BIGINT AS avgsize FROM names n LEFT JOIN entries e ON n.id = e.id GROUP BY parent_id", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return N.directory_totals(K.names(spark, sf), K.entries(spark, sf))


@query("e13_du", sql("SELECT r.root, e.type, count(*) AS count, sum(e.blocks)::BIGINT AS blocks, sum(e.size)::BIGINT AS size, (sum(e.blocks) * 512)::BIGINT AS used FROM full_paths p JOIN entries e ON p.id = e.id JOIN (VALUES ('/d20'), ('/d40'), ('/d60')) r(root) ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY 1, 2", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    paths = N.all_paths(K.names(spark, sf), K.ROOT).join(K.entries(spark, sf).select("id", "type", "blocks", "size"), "id")
    return N.du(paths, ["/d20", "/d40", "/d60"])


@query("d13_backup_status", sql("""SELECT id, path, CASE WHEN b IS NULL THEN 'new' WHEN busy THEN 'archiving' WHEN b <> size THEN 'modified' ELSE 'synchro' END AS copy_status
  FROM (SELECT e.id, p.path, e.size, CASE WHEN num % 5 = 0 THEN NULL WHEN num % 7 = 0 THEN size + 1 ELSE size END AS b, num % 3 = 0 AS busy FROM entries e JOIN full_paths p ON p.id = e.id)""", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    paths = N.all_paths(K.names(spark, sf), K.ROOT).select("id", "path").join(K.entries(spark, sf), "id")
    copies = paths.filter("num % 5 <> 0").select("path", F.col("type").alias("b_type"), F.col("last_mod").alias("b_mtime"), F.when(F.col("num") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("b_size"), (F.col("num") % 3 == 0).alias("busy"))
    return D.backup_status(paths, copies)


# ---- reports ----

USAGE_SQL = "count(*) AS count, sum(size)::BIGINT AS size, sum(blocks)::BIGINT AS blocks, min(size) AS min_size, max(size) AS max_size, round(avg(size))::BIGINT AS avg_size"


@on_entries("e01_generic_report", f"SELECT uid, type, {USAGE_SQL}, count(DISTINCT gid) AS groups FROM entries WHERE NOT invalid GROUP BY uid, type HAVING count(*) >= 5")
def _(e: DataFrame) -> DataFrame:
    return fitted(R.report(e, ["uid", "type"], [*R.usage(), F.count_distinct("gid").alias("groups")], where=~F.col("invalid"), having=F.col("count") >= 5))


@on_entries("e02_cube_roll_up", f"SELECT uid, sum(size)::BIGINT AS size, sum(blocks)::BIGINT AS blocks, count(*) AS count, {PROFILE_SQL}, round(sum(size) / count(*))::BIGINT AS avg_size, NULL::BIGINT AS min_size, NULL::BIGINT AS max_size FROM entries GROUP BY uid")
def _(e: DataFrame) -> DataFrame:
    return C.roll_up(C.build(e), ["uid"])


@on_entries("e03_cube_build", f"SELECT uid, gid, type, status, sum(size)::BIGINT AS size, sum(blocks)::BIGINT AS blocks, count(*) AS count, {PROFILE_SQL} FROM entries GROUP BY uid, gid, type, status")
def _(e: DataFrame) -> DataFrame:
    return C.build(e)


@on_entries("e04_cube_deltas", f"SELECT uid, gid, type, status, sum(size)::BIGINT AS size, sum(blocks)::BIGINT AS blocks, count(*) AS count, {PROFILE_SQL} FROM (SELECT CASE WHEN num % 9 = 0 THEN 'u0' ELSE uid END AS uid, gid, type, status, size, blocks FROM entries WHERE num % 10 <> 3) GROUP BY uid, gid, type, status")
def _(e: DataFrame) -> DataFrame:
    old = e.filter("num % 10 <> 4")
    change_old = old.filter("num % 9 = 0 OR num % 10 = 3")
    change_new = e.filter("(num % 9 = 0 OR num % 10 = 4) AND num % 10 <> 3").withColumn("uid", F.when(F.col("num") % 9 == 0, "u0").otherwise(F.col("uid")))
    return C.merge(C.build(old), C.deltas(change_old, change_new))


@on_entries("e05_size_profile", f"SELECT gid, {PROFILE_SQL} FROM entries WHERE type = 'file' GROUP BY gid")
def _(e: DataFrame) -> DataFrame:
    return e.filter("type = 'file'").groupBy("gid").agg(*R.profile_columns(F.col("size")))


@on_entries("e06_size_ratio", "SELECT uid, sum(CASE WHEN size >= 1048576 AND size < 1073741824 THEN 1 ELSE 0 END) / count(*) AS ratio FROM entries GROUP BY uid")
def _(e: DataFrame) -> DataFrame:
    return R.size_ratio(e, ["uid"], "1M..1G")


@on_entries("e07_fs_info", f"SELECT type, {USAGE_SQL} FROM entries GROUP BY type")
def _(e: DataFrame) -> DataFrame:
    return fitted(R.report(e, ["type"], R.usage()))


@on_entries("e08_user_info_with_total", "SELECT uid, gid, count(*) AS count, sum(size)::BIGINT AS size, grouping(uid, gid) > 0 AS is_total FROM entries GROUP BY GROUPING SETS ((uid, gid), ())")
def _(e: DataFrame) -> DataFrame:
    return fitted(R.with_total(e, ["uid", "gid"], [F.count(F.lit(1)).alias("count"), S.total("size").alias("size")]))


def _classes() -> dict[str, Column]:
    return {"big": F.col("size") >= 1 << 30, "small": F.col("size") < 1 << 10, "fresh": F.col("status") == "new", "old": X.age(F.col("last_mod"), ">", X.parse_duration("1000d"), NOW)}


CLASSES_SQL = f"list_filter([CASE WHEN size >= 1073741824 THEN 'big' END, CASE WHEN size < 1024 THEN 'small' END, CASE WHEN status = 'new' THEN 'fresh' END, CASE WHEN {NOW} - last_mod > 86400000 THEN 'old' END], lambda x: x IS NOT NULL)"


@on_entries("e09_class_info", f"SELECT array_to_string({CLASSES_SQL}, '+') AS classes, count(*) AS count, sum(size)::BIGINT AS size FROM entries GROUP BY 1")
def _(e: DataFrame) -> DataFrame:
    return fitted(e.groupBy(F.array_join(P.classes(_classes()), "+").alias("classes")).agg(F.count(F.lit(1)).alias("count"), S.total("size").alias("size")))


@on_entries("e10_status_info", "SELECT coalesce(nullif(status, ''), 'None') AS status, type, count(*) AS count, sum(size)::BIGINT AS size FROM entries GROUP BY 1, 2")
def _(e: DataFrame) -> DataFrame:
    return fitted(e.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("None")).alias("status"), "type").agg(F.count(F.lit(1)).alias("count"), S.total("size").alias("size")))


@on_entries("e15_native_builder", "SELECT uid, gid, sum(size)::BIGINT AS sum_size, count(*) AS count, array_to_string(list_sort(list(DISTINCT type)), ',') AS concat_type FROM entries WHERE gid NOT LIKE 'g0' GROUP BY uid, gid HAVING sum(size) > 1000000")
def _(e: DataFrame) -> DataFrame:
    return R.native(e, {"uid": "group", "gid": "group", "size": "sum", "*": "count", "type": "concat"}, [("gid", "nfilter", "g0"), ("sum_size", "bigger", 1_000_000)])


@on_entries("e16_log2_groups", "SELECT (length(bin(size)) - 1)::BIGINT AS bucket, count(*) AS count FROM entries WHERE size > 0 GROUP BY 1")
def _(e: DataFrame) -> DataFrame:
    return e.filter("size > 0").groupBy(S.log2_bucket(F.col("size")).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


@on_entries("e18_size_bars", "SELECT label, count(*)::BIGINT AS files FROM (SELECT ['sz0','sz1','sz32','sz1K','sz32K','sz1M','sz32M','sz1G','sz32G','sz1T'][CASE WHEN size = 0 THEN 1 ELSE 2 + least((length(bin(size)) - 1) // 5, 8) END] AS label FROM entries) GROUP BY label")
def _(e: DataFrame) -> DataFrame:
    bars = e.agg(*R.profile_columns(F.col("size")))
    return bars.unpivot([], list(R.PROFILE), "label", "files").filter("files > 0")


@query("e20_changelog_counters", sql("SELECT mdt, type, count(*) AS count, max(idx) AS last_idx FROM changelog GROUP BY mdt, type", CHANGELOG))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.counters(K.changelog(spark, sf))


@on_entries("e22_recovery_forecast", "SELECT CASE WHEN type <> 'file' THEN 'NON_FILE' WHEN size = 0 THEN 'EMPTY' WHEN status IN ('synchro', 'released') THEN 'OK' WHEN status = 'modified' THEN 'DELTA' ELSE 'NOBACKUP' END AS state, count(*) AS count, sum(size)::BIGINT AS size FROM entries GROUP BY 1")
def _(e: DataFrame) -> DataFrame:
    return D.recovery_state(e)


# ---- top lists ----


def _top(name: str, order: str, column: str, where: str) -> None:
    down = "DESC" in order

    @on_entries(name, f"SELECT id, {column}, row_number() OVER (ORDER BY {order}, id) AS rank FROM entries WHERE {where} ORDER BY {order}, id LIMIT 20")
    def _(e: DataFrame) -> DataFrame:
        return R.ranked(e.filter(where).select("id", column), [F.desc(column) if down else F.asc(column), F.asc("id")])


_top("g02_top_size", "size DESC", "size", "type = 'file'")
_top("g04_oldest_files", "last_access", "last_access", "type = 'file' AND NOT invalid")


@on_entries(FLAGSHIP, "SELECT *, row_number() OVER (ORDER BY size DESC, uid) AS rank FROM (SELECT uid, count(*) AS count, sum(size)::BIGINT AS size, min(size) AS min_size, max(size) AS max_size, round(avg(size))::BIGINT AS avg_size FROM entries WHERE type = 'file' GROUP BY uid) ORDER BY size DESC, uid LIMIT 20")
def _(e: DataFrame) -> DataFrame:
    users = fitted(R.report(e, ["uid"], R.usage(blocks=None), where=F.col("type") == "file"))
    return R.ranked(users, [F.desc("size"), F.asc("uid")])


@query("g01_top_dirs", sql("SELECT *, row_number() OVER (ORDER BY dircount DESC, parent_id) AS rank FROM (SELECT parent_id, count(*) AS dircount FROM names GROUP BY parent_id) ORDER BY dircount DESC, parent_id LIMIT 20", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(K.names(spark, sf).groupBy("parent_id").agg(F.count(F.lit(1)).alias("dircount")), [F.desc("dircount"), F.asc("parent_id")])


@query("g05_oldest_empty_dirs", sql("SELECT id, last_mod, row_number() OVER (ORDER BY last_mod, id) AS rank FROM entries WHERE type = 'dir' AND id NOT IN (SELECT parent_id FROM names) ORDER BY last_mod, id LIMIT 20", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(N.empty_directories(K.names(spark, sf), K.entries(spark, sf)).select("id", "last_mod"), [F.asc("last_mod"), F.asc("id")])


@on_entries("g08_top_and_others", "SELECT label AS uid, sum(size)::BIGINT AS size FROM (SELECT CASE WHEN row_number() OVER (ORDER BY size DESC, uid) <= 5 THEN uid ELSE 'Others' END AS label, size FROM (SELECT uid, sum(size) AS size FROM entries GROUP BY uid)) GROUP BY label")
def _(e: DataFrame) -> DataFrame:
    return fitted(R.with_others(e.groupBy("uid").agg(S.total("size").alias("size")), "uid", "size", 5))


# ---- ordered selection ----


@on_entries("f02_run_until_limit", "SELECT id, size FROM (SELECT id, size, coalesce(sum(size) OVER (ORDER BY last_access, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entries WHERE type = 'file') WHERE before < 100000000000")
def _(e: DataFrame) -> DataFrame:
    return P.until_limit(e.filter("type = 'file'").select("id", "size", "last_access"), ["last_access", "id"], {"size": 100_000_000_000}).select("id", "size")


@on_entries("f06_token_periods", "SELECT id, ((row_number() OVER (PARTITION BY uid ORDER BY last_mod, id) - 1) // 10)::BIGINT AS period FROM entries")
def _(e: DataFrame) -> DataFrame:
    return P.token_periods(e, ["last_mod", "id"], per_period=10, by=["uid"]).select("id", "period")


@on_entries("f07_progress", "SELECT status, count(*) AS count, sum(size)::BIGINT AS size FROM entries GROUP BY status")
def _(e: DataFrame) -> DataFrame:
    return fitted(e.groupBy("status").agg(F.count(F.lit(1)).alias("count"), S.total("size").alias("size")))


# ---- catalog changes ----


def _later(e: DataFrame) -> DataFrame:
    """A second snapshot: some gone, some grown, some new ids."""
    return e.filter("num % 17 <> 0").select(F.when(F.col("num") % 19 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")).alias("id"), "uid", F.when(F.col("num") % 6 == 0, F.col("size") + 10).otherwise(F.col("size")).alias("size"), F.when(F.col("num") % 8 != 0, F.col("status")).alias("status"))


LATER = "later AS (SELECT CASE WHEN num % 19 = 0 THEN 'n' || id ELSE id END AS id, uid, CASE WHEN num % 6 = 0 THEN size + 10 ELSE size END AS size, CASE WHEN num % 8 <> 0 THEN status END AS status FROM entries WHERE num % 17 <> 0)"


@query("h01_upsert", sql("SELECT coalesce(l.id, e.id) AS id, coalesce(l.uid, e.uid) AS uid, coalesce(l.size, e.size) AS size, coalesce(l.status, e.status) AS status FROM entries e FULL JOIN later l ON e.id = l.id", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.upsert(e.select("id", "uid", "size", "status"), _later(e))


@query("h05_soft_remove", sql(f"SELECT id, size, {NOW} AS rm_time FROM entries WHERE size = 0", ENTRIES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.soft_remove(e, e.filter("size = 0"), NOW)[1].select("id", "size", "rm_time")


@on_entries("h07_garbage_after_scan", "SELECT id FROM entries WHERE last_mod < 900000000")
def _(e: DataFrame) -> DataFrame:
    return D.stale(e, 900_000_000, "last_mod").select("id")


@query("h08_snapshot_diff", sql("""SELECT coalesce(e.id, l.id) AS id, CASE WHEN e.id IS NULL THEN '++' ELSE '--' END AS op, NULL::VARCHAR AS attribute, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM entries e FULL JOIN later l ON e.id = l.id WHERE e.id IS NULL OR l.id IS NULL
  UNION ALL SELECT e.id, '-+', 'size', e.size::VARCHAR, l.size::VARCHAR FROM entries e JOIN later l ON e.id = l.id WHERE e.size <> l.size
  UNION ALL SELECT e.id, '-+', 'status', e.status, l.status FROM entries e JOIN later l ON e.id = l.id WHERE e.status <> l.status""", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.diff(e, _later(e), ["size", "status"])


@query("h11_untagged", sql("SELECT id FROM entries WHERE id NOT IN (SELECT id FROM later)", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.untagged(e.select("id"), _later(e).select("id"))


# ---- change records ----


@query("i02_compaction")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.compact(K.changelog(spark, sf))


@query("i06_rename_expansion", sql("""SELECT idx, sub, op, fid, parent, entry FROM (
  SELECT idx, 0 AS sub, 'UNLINK' AS op, tfid AS fid, 'p2' AS parent, 'new' AS entry FROM changelog WHERE type = 'SETATTR' AND tfid <> '3'
  UNION ALL SELECT idx, 1, 'RM_NAME', '3', 'p1', 'old' FROM changelog WHERE type = 'SETATTR' UNION ALL SELECT idx, 2, 'ADD_NAME', '3', 'p2', 'new' FROM changelog WHERE type = 'SETATTR'
  UNION ALL SELECT idx, 0, type, tfid, 'p2', 'new' FROM changelog WHERE type <> 'SETATTR')""", CHANGELOG))
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = K.changelog(spark, sf).withColumn("type", F.when(F.col("type") == "SETATTR", "RENAME").otherwise(F.col("type")))
    return L.expand_renames(c.select("*", F.lit("p2").alias("pfid"), F.lit("new").alias("name"), F.lit("3").alias("sfid"), F.lit("p1").alias("spfid"), F.lit("old").alias("sname")))


@query("i07_catalog_operations", sql("SELECT c.idx, c.type, c.tfid, CASE WHEN c.type = 'UNLINK' AND e.id IS NULL THEN 'IGNORE' WHEN c.type = 'UNLINK' AND coalesce(e.nlink, 1) <= 1 THEN 'REMOVE' WHEN c.type = 'UNLINK' THEN 'RM_NAME' WHEN e.id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS op FROM changelog c LEFT JOIN entries e ON c.tfid = e.id", ENTRIES, CHANGELOG))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.catalog_operation(K.changelog(spark, sf).select("idx", "type", "tfid"), K.entries(spark, sf))


@on_entries("i12_refresh_policy", f"SELECT id, CASE WHEN last_mod IS NULL THEN TRUE ELSE (status = 'modified' AND {NOW} - last_mod >= 3600) OR {NOW} - last_mod >= 8640000 END AS due FROM entries WHERE status IS NOT NULL")
def _(e: DataFrame) -> DataFrame:
    return e.filter("status IS NOT NULL").select("id", L.needs_refresh(F.col("last_mod"), NOW, "on_event_periodic", 3600, 8_640_000, F.col("status") == "modified").alias("due"))


# ---- policies ----


def _policy() -> P.Policy:
    big, fresh = F.col("size") >= 1 << 30, F.col("status") == "new"
    return P.Policy(
        "migrate", scope=F.col("type") == "file", ignore=[F.col("uid") == "u3"],
        rules=[P.Rule("big_files", X.age(F.col("last_mod"), ">", 86400 * 100, NOW), big), P.Rule("fresh_files", F.col("size") > 0, fresh)],
        default=P.Rule("default", F.col("size") > 1 << 20),
    )


RULE_SQL = f"CASE WHEN type <> 'file' OR uid = 'u3' THEN NULL WHEN size >= 1073741824 THEN CASE WHEN {NOW} - last_mod > 8640000 THEN 'big_files' END WHEN status = 'new' THEN CASE WHEN size > 0 THEN 'fresh_files' END WHEN size > 1048576 THEN 'default' END"


@on_entries("j01_class_assignment", f"SELECT id, array_to_string({CLASSES_SQL}, '+') AS classes FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", F.array_join(P.classes(_classes()), "+").alias("classes"))


@on_entries("j06_matching_rule", f"SELECT id, {RULE_SQL} AS rule FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", P.matching_rule(_policy()).alias("rule"))


@on_entries("j08_candidates", f"SELECT id, rule, size FROM (SELECT id, rule, size, row_number() OVER (ORDER BY last_access, id) - 1 AS before FROM (SELECT *, {RULE_SQL} AS rule FROM entries WHERE NOT invalid) WHERE rule IS NOT NULL) WHERE before < 500")
def _(e: DataFrame) -> DataFrame:
    some = P.candidates(e, _policy()).withColumn("one", F.lit(1)).select("id", "rule", "size", "last_access", "one")
    return P.until_limit(some, ["last_access", "id"], {"one": 500}).select("id", "rule", "size")


@query("j15_capacity_trigger", sql("SELECT ost, f_blocks, f_bfree, f_bavail, used_pct, greatest(0, (f_blocks - f_bfree) - floor((f_blocks + f_bavail - f_bfree) * 40 / 100))::BIGINT AS amount FROM (SELECT *, 100 * (f_blocks - f_bfree) / (f_blocks + f_bavail - f_bfree) AS used_pct FROM (SELECT ostidx AS ost, 10000000 AS f_blocks, 10000000 - count(*) * 1000 AS f_bfree, 10000000 - count(*) * 1000 - 100 AS f_bavail FROM stripe_items GROUP BY ostidx)) WHERE used_pct >= 30", STRIPES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    used = K.stripe_items(spark, sf).groupBy(F.col("ostidx").alias("ost")).agg(F.count(F.lit(1)).alias("n"))
    capacity = used.select("ost", F.lit(10_000_000).alias("f_blocks"), (10_000_000 - F.col("n") * 1000).alias("f_bfree"), (10_000_000 - F.col("n") * 1000 - 100).alias("f_bavail"))
    return P.capacity_trigger(capacity, 30, 40)


@on_entries("j17_user_quota", "SELECT uid, sum(blocks)::BIGINT AS value, (sum(blocks) - 1000000)::BIGINT AS amount FROM entries GROUP BY uid HAVING sum(blocks) > 1000000")
def _(e: DataFrame) -> DataFrame:
    return P.quota_trigger(e, "uid", 1_000_000, 1_000_000)


@query("j22_content_check", "SELECT doc_id, sha256(coalesce(text, '')) AS output, CASE WHEN text IS NULL THEN 'failed' ELSE 'ok' END AS check_status FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = K.table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("output"), F.when(F.col("text").isNull(), "failed").otherwise("ok").alias("check_status"))


@on_entries("j28_alert_digest", "SELECT title, count(*) AS count, array_to_string(list_sort(list(id))[1:5], ',') AS entries FROM (SELECT id, uid AS title FROM entries WHERE size >= 1073741824) GROUP BY title")
def _(e: DataFrame) -> DataFrame:
    alerts = e.filter(F.col("size") >= 1 << 30).select("id", F.col("uid").alias("title"))
    return P.alert_digest(alerts, 5).select("title", "count", F.array_join("entries", ",").alias("entries"))


# ---- lookups, name joins, selection parameters, action outcomes ----


@query("a05_lookup_all_attributes", sql("SELECT e.id, e.type, e.size, n.name, s.stripes FROM entries e LEFT JOIN names n ON e.id = n.id LEFT JOIN (SELECT id, count(*) AS stripes FROM stripe_items GROUP BY id) s ON e.id = s.id WHERE e.id IN ('7', '27', '640')", ENTRIES, NAMES, STRIPES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.col("id").isin("7", "27", "640")
    stripes = K.stripe_items(spark, sf).filter(wanted).groupBy("id").agg(F.count(F.lit(1)).alias("stripes"))
    e = K.entries(spark, sf).filter(wanted).select("id", "type", "size")
    return e.join(K.names(spark, sf).filter(wanted).select("id", "name"), "id", "left").join(stripes, "id", "left").select("id", "type", "size", "name", "stripes")


@query("a07_ids_by_parent_and_name", sql("SELECT w.parent_id, w.name, n.id FROM (SELECT parent_id, 'f' || (parent_id::BIGINT * 20 + 7) AS name FROM (SELECT DISTINCT parent_id FROM names)) w JOIN names n ON n.parent_id = w.parent_id AND n.name = w.name", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = K.names(spark, sf)
    wanted = n.select("parent_id").distinct().withColumn("name", F.concat(F.lit("f"), F.col("parent_id").cast("bigint") * 20 + 7))
    return wanted.join(n, ["parent_id", "name"]).select("parent_id", "name", "id")


@on_entries("b20_report_filters", "SELECT uid, count(*)::BIGINT AS count FROM entries WHERE projid = 2 AND ost_pool LIKE 'pool\\_%' ESCAPE '\\' GROUP BY uid HAVING count(*) >= 5")
def _(e: DataFrame) -> DataFrame:
    where = (F.col("projid") == 2) & X.like_glob(F.col("ost_pool"), "pool_*")
    return e.filter(where).groupBy("uid").agg(F.count(F.lit(1)).alias("count")).filter("count >= 5")


@on_entries("b48_attribute_rows", "SELECT id, 'uid' AS attribute, uid AS value FROM entries UNION ALL SELECT id, 'size', size::VARCHAR FROM entries UNION ALL SELECT id, 'type', type FROM entries UNION ALL SELECT id, 'status', status FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", "uid", F.col("size").cast("string").alias("size"), "type", "status").unpivot("id", ["uid", "size", "type", "status"], "attribute", "value")


@query("b49_action_placeholders", sql("SELECT id, name, 'cp ' || name || ' /backup/' || parent_id || '/' || id AS command FROM names", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    values = {"name": F.col("name"), "fid": F.col("id"), "parent_fid": F.col("parent_id")}
    return K.names(spark, sf).select("id", "name", S.placeholders("cp {name} /backup/{parent_fid}/{fid}", values).alias("command"))


@query("d06_directories_by_average_size", sql("SELECT e.id, count(*)::BIGINT AS dircount, (sum(c.size) // count(*))::BIGINT AS avgsize FROM entries e JOIN names n ON n.parent_id = e.id JOIN entries c ON c.id = n.id WHERE e.type = 'dir' GROUP BY e.id HAVING count(*) >= 3 AND sum(c.size) // count(*) > 1000000", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, n = K.entries(spark, sf), K.names(spark, sf)
    sums = n.join(e.select("id", "size"), "id").groupBy("parent_id").agg(F.count(F.lit(1)).alias("dircount"), F.expr("sum(size) div count(1)").alias("avgsize"))
    return e.filter("type = 'dir'").select("id").join(sums.filter("dircount >= 3 AND avgsize > 1000000"), F.col("id") == F.col("parent_id")).select("id", "dircount", "avgsize")


@query("d09_all_paths_of_an_id", sql("SELECT id, array_to_string(list_sort(list(path)), '|') AS paths FROM full_paths GROUP BY id", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = N.all_paths(K.names(spark, sf), K.ROOT)
    return p.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"))


@query("d12_entries_left_join_names", sql("SELECT e.id, e.uid, n.name FROM entries e LEFT JOIN names n ON e.id = n.id WHERE e.uid = 'u3'", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.entries(spark, sf).filter("uid = 'u3'").select("id", "uid").join(K.names(spark, sf).select("id", "name"), "id", "left")


@on_entries("e14_report_total", "SELECT count(*)::BIGINT AS count, sum(size)::BIGINT AS volume, (sum(blocks) * 512)::BIGINT AS space_used FROM entries WHERE type = 'file'")
def _(e: DataFrame) -> DataFrame:
    return fitted(e.filter("type = 'file'").agg(F.count(F.lit(1)).alias("count"), S.total("size").alias("volume"), (S.total("blocks") * 512).alias("space_used")))


@on_entries("h04_mass_remove", "SELECT id, size FROM entries WHERE NOT (status = 'released' AND type = 'file') OR status IS NULL")
def _(e: DataFrame) -> DataFrame:
    return D.remove(e, e.filter("status = 'released' AND type = 'file'").select("id")).select("id", "size")


@query("h02_update_attributes", sql("SELECT id, size, status FROM later UNION ALL SELECT id, size, status FROM entries e WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.id = e.id)", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.replaced(e.select("id", "size", "status"), _later(e))


@on_entries("j02_class_algebra", "SELECT id, (size >= 1048576 OR uid = 'u1') AND NOT coalesce(status = 'new', false) AS chosen FROM entries")
def _(e: DataFrame) -> DataFrame:
    own = {"big": F.col("size") >= 1 << 20, "owned": F.col("uid") == "u1", "fresh": X.matched(F.col("status") == "new")}
    return e.select("id", P.algebra(own, ("inter", ("union", "big", "owned"), ("not", "fresh"))).alias("chosen"))


@on_entries("j10_amounts", "SELECT id, 1::BIGINT AS count, (blocks * 512)::BIGINT AS volume, blocks FROM entries WHERE type = 'file'")
def _(e: DataFrame) -> DataFrame:
    return e.filter("type = 'file'").select("id", F.lit(1).cast("bigint").alias("count"), (F.col("blocks") * 512).alias("volume"), "blocks")


@query("j13_stale_before_action", sql("SELECT e.id, CASE WHEN l.id IS NULL THEN 'gone' WHEN l.size <> e.size THEN 'accessed' ELSE 'ok' END AS outcome FROM entries e LEFT JOIN later l ON e.id = l.id", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return P.outcome(e, _later(e)).select("id", "outcome")


@query("j14_outcome_counts", sql("SELECT outcome, count(*)::BIGINT AS count FROM (SELECT CASE WHEN l.id IS NULL THEN 'gone' WHEN l.size <> e.size THEN 'accessed' ELSE 'ok' END AS outcome FROM entries e LEFT JOIN later l ON e.id = l.id) GROUP BY outcome", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return P.outcome(e, _later(e)).groupBy("outcome").agg(F.count(F.lit(1)).alias("count"))


@on_entries("j24_lifecycle_candidates", "SELECT id, CASE WHEN status IN ('new', 'modified') THEN 'archive' ELSE 'release' END AS action FROM entries WHERE type = 'file' AND NOT invalid AND status IN ('new', 'modified', 'synchro')")
def _(e: DataFrame) -> DataFrame:
    files = e.filter((F.col("type") == "file") & ~F.col("invalid") & F.col("status").isin("new", "modified", "synchro"))
    return files.select("id", F.when(F.col("status") == "synchro", "release").otherwise("archive").alias("action"))


@on_entries("j29_stale_actions", f"SELECT count(*)::BIGINT AS count FROM entries WHERE status = 'modified' AND NOT invalid AND last_access <= {NOW} - 86400")
def _(e: DataFrame) -> DataFrame:
    return e.filter((F.col("status") == "modified") & ~F.col("invalid") & X.age(F.col("last_access"), ">=", 86400, NOW)).agg(F.count(F.lit(1)).alias("count"))


@query("b19_path_filter", sql("SELECT id, path FROM full_paths WHERE regexp_full_match(path, '/d2.*')", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return N.all_paths(K.names(spark, sf), K.ROOT).filter(X.path_filter(F.col("path"), "d2*")).select("id", "path")


@query("d11_names_page", sql("SELECT e.id, e.size, n.name FROM entries e LEFT JOIN names n ON e.id = n.id ORDER BY e.id, n.name NULLS FIRST LIMIT 50 OFFSET 100", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = K.entries(spark, sf).join(K.names(spark, sf).select("id", "name"), "id", "left")
    return both.select("id", "size", "name").orderBy("id", F.asc_nulls_first("name")).offset(100).limit(50)


@on_entries("e17_owner_shares", "SELECT uid, sum(size)::BIGINT AS size, count(*) AS count FROM entries GROUP BY uid HAVING count(*) BETWEEN 5 AND 300")
def _(e: DataFrame) -> DataFrame:
    return C.roll_up(C.build(e), ["uid"]).filter(F.col("count").between(5, 300)).select("uid", "size", "count")


@on_entries("g06_due_tombstones", f"SELECT id, size, {NOW} - num % 100 AS rm_time FROM entries WHERE status = 'released' AND num % 100 >= 60")
def _(e: DataFrame) -> DataFrame:
    gone = D.soft_remove(e, e.filter("status = 'released'"), NOW)[1].withColumn("rm_time", NOW - F.col("num") % 100)
    return D.due_tombstones(gone, NOW, 60).select("id", "size", "rm_time")


@query("h03_remove_names", sql("SELECT id FROM entries WHERE id NOT IN (SELECT id FROM names WHERE name LIKE 'f1%' GROUP BY id HAVING bool_and(name NOT LIKE '%link') AND id NOT IN (SELECT id FROM names WHERE name LIKE '%link'))", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    names = K.names(spark, sf)
    gone = names.filter(F.col("name").like("f1%") & ~F.col("name").endswith("link"))
    return D.remove_names(names, K.entries(spark, sf), gone)[1].select("id")


@on_entries("j09_targets", "SELECT id, uid LIKE 'u1%' AS of_user, gid = 'g3' AS of_group, ost_pool LIKE 'pool%' AS of_pool, projid = 2 AS of_project FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", P.on_target("user", "u1*").alias("of_user"), P.on_target("group", "g3").alias("of_group"), P.on_target("pool", "pool*").alias("of_pool"), P.on_target("project", 2).alias("of_project"))


@on_entries("j12_actions", "SELECT id, rule, CASE rule WHEN 'big' THEN 'compress' ELSE 'purge' END AS action FROM (SELECT id, CASE WHEN size >= 1048576 THEN 'big' ELSE 'rest' END AS rule FROM entries WHERE NOT invalid AND type = 'file')")
def _(e: DataFrame) -> DataFrame:
    big = F.col("size") >= 1 << 20
    policy = P.Policy("purge", F.col("type") == "file", [P.Rule("big", F.lit(True), big, {"action": "compress"})], default=P.Rule("rest", F.lit(True)))
    return P.candidates(e, policy).select("id", "rule", P.action(policy, "purge").alias("action"))


@query("j16_inode_trigger", sql("SELECT ost, used AS used_inodes, (used - floor(f_files * 0.5))::BIGINT AS amount FROM (SELECT ostidx AS ost, count(*) AS used, 2 * max(stripe_index) + count(*) + count(*) % 7 * 20 AS f_files FROM stripe_items GROUP BY 1) WHERE used >= 0.8 * f_files", ENTRIES, STRIPES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    used = K.stripe_items(spark, sf).groupBy(F.col("ostidx").alias("ost")).agg(F.count(F.lit(1)).alias("n"), F.max("stripe_index").alias("top"))
    capacity = used.withColumn("f_files", 2 * F.col("top") + F.col("n") + F.col("n") % 7 * 20).withColumn("f_ffree", F.col("f_files") - F.col("n"))
    return P.inode_trigger(capacity, 80, 50, percent=True).select("ost", "used_inodes", "amount")


# ---- limits of a run, triggers, alerts ----


@on_entries("f03_max_per_run", "SELECT id, size FROM (SELECT id, size, row_number() OVER w - 1 AS n, coalesce(sum(size) OVER (ORDER BY last_access DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entries WHERE type = 'file' WINDOW w AS (ORDER BY last_access DESC, id)) WHERE n < 700 AND before < 30000000000000")
def _(e: DataFrame) -> DataFrame:
    return P.max_per_run(e.filter("type = 'file'"), ["-last_access", "id"], 700, 30_000_000_000_000).select("id", "size")


@on_entries("f05_error_suspension", "SELECT id FROM (SELECT id, n, min(CASE WHEN errors >= 20 AND 100 * errors >= 25 * n THEN n END) OVER () AS stop FROM (SELECT id, row_number() OVER w AS n, sum(CASE WHEN num % 3 = 0 AND last_mod > 800000000 THEN 1 ELSE 0 END) OVER w AS errors FROM entries WINDOW w AS (ORDER BY last_mod, id))) WHERE stop IS NULL OR n <= stop")
def _(e: DataFrame) -> DataFrame:
    failed = (F.col("num") % 3 == 0) & (F.col("last_mod") > 800_000_000)
    return P.until_suspended(e, ["last_mod", "id"], failed, 20, 25).select("id")


@on_entries("f06_both_token_limits", "SELECT id, greatest((row_number() OVER w - 1) // 50, coalesce(sum(size) OVER (ORDER BY last_mod, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000000000000)::BIGINT AS period FROM entries WHERE type = 'file' WINDOW w AS (ORDER BY last_mod, id)")
def _(e: DataFrame) -> DataFrame:
    return P.token_periods(e.filter("type = 'file'"), ["last_mod", "id"], 50, 1_000_000_000_000).select("id", "period")


@on_entries("j07_rule_by_class", f"SELECT id, CASE WHEN list_contains(c, 'old') THEN NULL WHEN list_contains(c, 'fresh') THEN 'fresh_files' WHEN list_contains(c, 'big') THEN 'big_files' ELSE 'default' END AS rule FROM (SELECT id, {CLASSES_SQL} AS c FROM entries)")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", P.class_rule(_policy(), F.coalesce(P.classes(_classes()), F.array().cast("array<string>")), {"fresh": "fresh_files", "big": "big_files"}, ["old"]).alias("rule"))


@on_entries("j11_parameters", "SELECT id, 'copy --level=3 --to=/a/' || uid AS command FROM entries WHERE type = 'file'")
def _(e: DataFrame) -> DataFrame:
    merged = P.parameters({"level": "1", "to": "/p/"}, {"to": "/t/"}, {"level": "3"}, {"to": "/a/"})
    return e.filter("type = 'file'").select("id", S.placeholders(f"copy --level={merged['level']} --to={merged['to']}{{user}}", {"user": F.col("uid")}).alias("command"))


CAPACITY_SQL = "capacity AS (SELECT ostidx AS ost, 10000000 AS f_blocks, 10000000 - count(*) * 1000 AS f_bfree, 10000000 - count(*) * 1000 - 100 AS f_bavail FROM stripe_items GROUP BY ostidx)"


def _capacity(spark: SparkSession, sf: str) -> DataFrame:
    used = K.stripe_items(spark, sf).groupBy(F.col("ostidx").alias("ost")).agg(F.count(F.lit(1)).alias("n"))
    return used.select("ost", F.lit(10_000_000).alias("f_blocks"), (10_000_000 - F.col("n") * 1000).alias("f_bfree"), (10_000_000 - F.col("n") * 1000 - 100).alias("f_bavail"))


@query("j18_pool_usage", sql("SELECT 'pool' || ost % 3 AS target, sum(f_blocks - f_bfree)::BIGINT AS used, sum(f_blocks + f_bavail - f_bfree)::BIGINT AS total, 100 * sum(f_blocks - f_bfree) / sum(f_blocks + f_bavail - f_bfree) AS used_pct FROM capacity GROUP BY 1", STRIPES, CAPACITY_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    capacity = _capacity(spark, sf)
    return P.target_usage(capacity, capacity.select("ost", F.concat(F.lit("pool"), F.col("ost") % 3).alias("pool")))


@on_entries("j19_due_triggers", f"SELECT id AS name, CASE WHEN num % 7 = 0 THEN last_mod ELSE {NOW} END AS next_check FROM entries WHERE {NOW} - last_mod >= num % 4 * 50000000")
def _(e: DataFrame) -> DataFrame:
    triggers = e.select(F.col("id").alias("name"), F.col("last_mod").alias("last_check"), (F.col("num") % 4 * 50_000_000).alias("check_interval"), (F.col("num") % 7 == 0).alias("failed"))
    return P.due_triggers(triggers, NOW).select("name", "next_check")


@on_entries("j21_alerts", f"SELECT id, CASE WHEN size >= 1073741824 THEN 'big' WHEN status = 'new' THEN 'fresh' END AS title, CASE WHEN size >= 1073741824 OR coalesce(status = 'new', FALSE) THEN 'alert' ELSE 'clear' END AS alert_status, {NOW} AS last_check, CASE WHEN size >= 1073741824 OR coalesce(status = 'new', FALSE) THEN {NOW} END AS last_alert FROM entries WHERE NOT invalid")
def _(e: DataFrame) -> DataFrame:
    return P.alerts(e, {"big": F.col("size") >= 1 << 30, "fresh": F.col("status") == "new"}, NOW)


@query("j25_removable_directories", sql(f"SELECT id FROM entries WHERE type = 'dir' AND {NOW} - last_mod > 172800000 AND id NOT IN (SELECT parent_id FROM names)", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.removable_directories(K.names(spark, sf), K.entries(spark, sf), X.age(F.col("last_mod"), ">", X.parse_duration("2000 days"), NOW)).select("id")


@query("j26_run_summary", sql(f"SELECT 'migrate' AS policy, 'manual' AS trigger_kind, {NOW} AS run_start, {NOW} + 60 AS run_end, count(*) FILTER (o = 'ok')::BIGINT AS ok, (sum(size) FILTER (o = 'ok'))::BIGINT AS volume, count(*) FILTER (o = 'gone')::BIGINT AS gone, count(*) FILTER (o = 'accessed')::BIGINT AS accessed FROM (SELECT e.size, CASE WHEN l.id IS NULL THEN 'gone' WHEN l.size <> e.size THEN 'accessed' ELSE 'ok' END AS o FROM entries e LEFT JOIN later l ON e.id = l.id)", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return P.run_summary(P.outcome(e, _later(e)), "migrate", NOW, NOW + 60, "manual")


@query("j30_match_sources", sql("SELECT e.id, coalesce(e.status, l.status) AS status, coalesce(l.size, e.size) AS size FROM entries e LEFT JOIN later l ON e.id = l.id", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return P.match_source(e.select("id", "status", "size"), _later(e), "auto", ["size"])


@query("j31_manual_run", sql("SELECT id FROM (SELECT e.id, coalesce(sum(e.blocks) OVER (ORDER BY last_access, e.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entries e WHERE type = 'file') WHERE before < (SELECT coalesce(max(greatest(0, (f_blocks - f_bfree) - floor((f_blocks + f_bavail - f_bfree) * 1 / 100))), 0) FROM capacity WHERE ost = 3 AND 100 * (f_blocks - f_bfree) / (f_blocks + f_bavail - f_bfree) >= 1)", ENTRIES, STRIPES, CAPACITY_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = K.entries(spark, sf).filter("type = 'file'")
    return P.manual_run(files, ["last_access", "id"], _capacity(spark, sf).filter("ost = 3"), 1).select("id")


# ---- tombstones, diffs, recovery ----

TOMBS = f"tombs AS (SELECT id, size, type, '/t/' || uid || '/f' || num AS path, status, {NOW} - num % 100 AS rm_time FROM entries WHERE num % 4 = 0)"


def _tombs(e: DataFrame) -> DataFrame:
    gone = D.soft_remove(e, e.filter("num % 4 = 0"), NOW)[1]
    return gone.select("id", "size", "type", F.concat(F.lit("/t/"), "uid", F.lit("/f"), "num").alias("path"), "status", (NOW - F.col("num") % 100).alias("rm_time"))


@query("a10_tombstone_listing", sql("SELECT id, path, rm_time FROM tombs WHERE size > 5000 ORDER BY rm_time, id LIMIT 400", ENTRIES, TOMBS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.undelete_listing(_tombs(K.entries(spark, sf)).filter("size > 5000")).select("id", "path", "rm_time").limit(400)


@query("b29_removal_time", sql(f"SELECT id FROM tombs WHERE {NOW} - rm_time > 40", ENTRIES, TOMBS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _tombs(K.entries(spark, sf)).filter(X.age(F.col("rm_time"), ">", X.parse_duration("40s"), NOW)).select("id")


@query("h06_discard_tombstones", sql("SELECT id, rm_time FROM tombs WHERE id NOT IN (SELECT id FROM entries WHERE size = 0)", ENTRIES, TOMBS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.remove(_tombs(e), e.filter("size = 0")).select("id", "rm_time")


@query("h09_diff_by_groups", sql("SELECT e.id, '-+' AS op, 'size' AS attribute, e.size::VARCHAR AS old, l.size::VARCHAR AS new FROM entries e JOIN later l ON e.id = l.id WHERE e.size <> l.size UNION ALL SELECT coalesce(e.id, l.id), CASE WHEN e.id IS NULL THEN '++' ELSE '--' END, NULL, NULL, NULL FROM entries e FULL JOIN later l ON e.id = l.id WHERE e.id IS NULL OR l.id IS NULL", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.diff(e, _later(e), D.diff_columns(["posix", "notimes"], ["uid", "size", "status"]))


@query("h10_apply_diff", sql("SELECT l.id, coalesce(l.uid, e.uid) AS uid, coalesce(l.size, e.size) AS size, coalesce(l.status, e.status) AS status FROM later l LEFT JOIN entries e ON e.id = l.id", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.apply_diff(e.select("id", "uid", "size", "status"), _later(e))


@on_entries("h13_recovery_states", "SELECT CASE WHEN num % 3 = 0 THEN 'failed' WHEN num % 3 = 1 THEN 'done' ELSE 'todo' END AS recov_state, count(*)::BIGINT AS count, sum(size)::BIGINT AS size FROM entries WHERE type = 'file' GROUP BY 1")
def _(e: DataFrame) -> DataFrame:
    files = e.filter("type = 'file'")
    done = D.set_recovery_state(D.recovery_table(files), files.filter("num % 3 < 2").select("id", (F.col("num") % 3 == 1).alias("ok")))
    return fitted(done.groupBy("recov_state").agg(F.count(F.lit(1)).alias("count"), S.total("size").alias("size")))


@query("h14_undelete_listing", sql("SELECT id, path FROM tombs WHERE regexp_matches(path, '^/t/u1[0-9]?/')", ENTRIES, TOMBS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.undelete_listing(_tombs(K.entries(spark, sf)), "^/t/u1[0-9]?/").select("id", "path")


@on_entries("h15_tombstone_decision", "SELECT id, CASE WHEN type <> 'file' OR coalesce(status, 'new') = 'new' THEN 'remove' ELSE 'soft_remove' END AS own, CASE WHEN num % 5 = 0 OR NOT (type <> 'file' OR coalesce(status, 'new') = 'new') THEN 'soft_remove' ELSE 'remove' END AS strongest FROM entries")
def _(e: DataFrame) -> DataFrame:
    own = D.softrm_action(F.col("type"), F.col("status"))
    return e.select("id", own.alias("own"), L.strongest(own, F.when(F.col("num") % 5 == 0, "soft_remove")).alias("strongest"))


@query("i10_inferred_attributes", sql("SELECT c.idx, CASE WHEN c.type = 'CREATE' THEN 'file' END AS kind, (CASE c.type WHEN 'CREATE' THEN 1 WHEN 'HLINK' THEN e.nlink + 1 END)::INTEGER AS nlink, CASE WHEN c.type = 'CREATE' AND e.id IS NULL THEN c.time END AS creation_time FROM (SELECT idx, time, tfid, CASE type WHEN 'CLOSE' THEN 'HLINK' ELSE type END AS type FROM changelog) c LEFT JOIN (SELECT * FROM entries WHERE num % 3 > 0) e ON c.tfid = e.id", ENTRIES, RECORDS_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    records = K.changelog(spark, sf).withColumn("type", F.when(F.col("type") == "CLOSE", "HLINK").otherwise(F.col("type")))
    return L.inferred(records, K.entries(spark, sf).filter("num % 3 > 0")).select("idx", "kind", "nlink", "creation_time")


@query("i11_effective_updates", sql("SELECT l.id FROM later l LEFT JOIN entries e ON e.id = l.id WHERE e.id IS NULL OR (l.size IS NOT NULL AND l.size IS DISTINCT FROM e.size) OR (l.status IS NOT NULL AND l.status IS DISTINCT FROM e.status)", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return L.effective(_later(e), e, ["size", "status"]).select("id")


@on_entries("i15_archive_events", "SELECT id, CASE num % 5 WHEN 0 THEN CASE WHEN num % 3 <> 0 THEN 'refresh' WHEN num % 2 = 0 THEN 'modified' END WHEN 1 THEN CASE WHEN num % 3 = 0 THEN 'released' ELSE 'synchro' END WHEN 2 THEN CASE WHEN num % 3 <> 0 THEN 'released' END WHEN 3 THEN 'modified' ELSE CASE WHEN status IS NULL THEN 'new' END END AS next_status FROM entries")
def _(e: DataFrame) -> DataFrame:
    events = F.get(F.array(*map(F.lit, ("archive", "restore", "release", "dirty", "create"))), (F.col("num") % 5).cast("int"))
    return e.select("id", L.hsm_status(events, F.col("num") % 3 == 0, F.col("num") % 2 == 0, F.col("status")).alias("next_status"))


# ---- further criteria, scalars and report options ----


@on_entries("b11_more_criteria", f"SELECT id, type = 'dir' AND nlink > 0 AS links, coalesce(list_contains({CLASSES_SQL}, 'big') OR list_contains({CLASSES_SQL}, 'fresh'), FALSE) AS tagged, coalesce(last_access, 0) <> 0 AND {NOW} - last_access > 86400 AS since, type = 'file' AND size > 4096 AND projid = 1 AS all_three FROM entries")
def _(e: DataFrame) -> DataFrame:
    tagged = X.has_class(P.classes(_classes()), "[bf]*")
    return e.select("id", X.dircount(F.col("type"), F.col("nlink"), ">", 0).alias("links"), tagged.alias("tagged"), X.duration_info(F.col("last_access"), ">", 86400, NOW).alias("since"), X.all_of(F.col("type") == "file", F.col("size") > 4096, F.col("projid") == 1).alias("all_three"))


@on_entries("b43_simple_filters", "SELECT uid, count(*)::BIGINT AS count, sum(size)::BIGINT AS size FROM entries WHERE gid LIKE 'g%' AND projid > 1 GROUP BY uid HAVING sum(size) < 590000000000000")
def _(e: DataFrame) -> DataFrame:
    before, after = R.simple_filters({"gid": "g*", "minprojid": 1, "maxsize": 590_000_000_000_000}, ["size"])
    return e.filter(before).groupBy("uid").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size")).filter(after)


@on_entries("c03_printed_values", "SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576) WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824) ELSE printf('%.2f TB', size / 1099511627776) END AS human, printf('%dd %02dh %02dmin %02ds', last_mod // 86400, last_mod // 3600 % 24, last_mod // 60 % 60, last_mod % 60) AS age, CASE type WHEN 'file' THEN 'f' WHEN 'dir' THEN 'd' ELSE 'l' END AS letter, printf('%o', mode) AS octal FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", S.human_size(F.col("size")).alias("human"), S.duration(F.col("last_mod")).alias("age"), S.type_letter(F.col("type")).alias("letter"), S.octal(F.col("mode")).alias("octal"))


@on_entries("e06_sorted_by_ratio", "SELECT uid, ratio, row_number() OVER (ORDER BY ratio DESC, uid) AS rank FROM (SELECT uid, sum(CASE WHEN size >= 1048576 AND size < 1073741824 THEN 1 ELSE 0 END) / count(*) AS ratio FROM entries GROUP BY uid) ORDER BY ratio DESC, uid LIMIT 20")
def _(e: DataFrame) -> DataFrame:
    return R.by_size_ratio(e, "uid", "1M~1G-")


SOUNDS_SQL = "upper(substr(t, 1, 1)) || substr(" + "".join("regexp_replace(" for _ in range(6)) + "substr(c, 1, 1) || replace(substr(c, 2), '0', '')" + "".join(f", '{i}+', '{i}', 'g')" for i in range(1, 7)) + ", 2)"


@query("b42_sounds_like", f"SELECT id, word, sound, sound = 'R323' AS alike FROM (SELECT id, word, CASE WHEN length(s) < 4 THEN rpad(s, 4, '0') ELSE s END AS sound FROM (SELECT *, {SOUNDS_SQL} AS s FROM (SELECT p_partkey AS id, p_name AS word, replace(p_name, ' ', '') AS t, translate(upper(replace(p_name, ' ', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS c FROM part)))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    word = F.col("p_name")
    return K.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), word.alias("word"), S.sounds(word).alias("sound"), X.sounds_like(word, "rad wedgit").alias("alike"))


@query("b14_any_depth_globs", sql("SELECT id, path, starts_with(path, '/d20/') AND regexp_full_match(path, '/.*/f[^/][^/][^/][^/]') AS below, regexp_full_match(path, '/.*/f[^/][^/][^/]') AS short_names FROM full_paths", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    below = X.in_tree(p, "/d20") & X.like_glob(p, "/**/f????", path=True)
    return N.all_paths(K.names(spark, sf), K.ROOT).select("id", "path", below.alias("below"), X.like_glob(p, "/**/f???", path=True).alias("short_names"))


@on_entries("b34_attributes", "SELECT id, num % 3 = 0 AND projid BETWEEN 1 AND 3 AS tagged, num % 3 <> 0 AS without FROM entries")
def _(e: DataFrame) -> DataFrame:
    attrs = F.when(F.col("num") % 3 == 0, F.create_map(F.lit("user.project"), F.concat(F.lit("p"), "projid")))
    return e.select("id", X.xattr(attrs, "user.project", "p[1-3]").alias("tagged"), X.xattr(attrs, "user.project", "").alias("without"))


@query("a03_subtree_scan", sql("SELECT id, path FROM full_paths WHERE path = '/d20' OR starts_with(path, '/d20/')", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.subtree(N.all_paths(K.names(spark, sf), K.ROOT), "/d20").select("id", "path")


@query("a11_variables", sql("SELECT name, value FROM (SELECT tfid AS name, CASE WHEN type <> 'UNLINK' THEN type END AS value, row_number() OVER (PARTITION BY tfid ORDER BY idx DESC) AS n FROM changelog) WHERE n = 1 AND value IS NOT NULL", CHANGELOG))
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = K.changelog(spark, sf)
    return O.latest(c.select(F.col("tfid").alias("name"), F.when(F.col("type") != "UNLINK", F.col("type")).alias("value"), F.col("idx").alias("at")))


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"


@on_entries("a13_csv_report", "SELECT row_number() OVER (ORDER BY size DESC, uid) AS rank, uid, count, size FROM (SELECT uid, count(*)::BIGINT AS count, sum(size)::BIGINT AS size FROM entries GROUP BY uid)")
def _(e: DataFrame) -> DataFrame:
    path = _new_path(e.sparkSession)
    O.write_report(e.groupBy("uid").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size")), path, order=["-size", "uid"])
    return O.read_report(e.sparkSession, path, "rank bigint, uid string, count bigint, size bigint")


@on_entries("a15_csv_export", "SELECT uid, sum(size)::BIGINT AS sum_size, count(*)::BIGINT AS count FROM entries WHERE gid LIKE 'g1%' GROUP BY uid")
def _(e: DataFrame) -> DataFrame:
    path = _new_path(e.sparkSession)
    O.write_report(R.native(e, {"uid": "group", "size": "sum", "*": "count"}, [("gid", "filter", "g1*")]), path)
    return O.read_report(e.sparkSession, path, "uid string, sum_size bigint, count bigint")


ONE_PATH = "one_paths AS (SELECT id, min(path) AS path FROM full_paths GROUP BY id)"


def _with_path(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with one path of theirs, null where they have no name."""
    paths = N.one_path(K.names(spark, sf), K.ROOT).select(F.col("id").alias("path_id"), "path")
    e = K.entries(spark, sf)
    return e.join(paths, F.col("id") == F.col("path_id"), "left").select(*e.columns, "path")


@query("a14_dump_user", sql("SELECT e.id, type, status, size, uid, gid, path FROM entries e LEFT JOIN one_paths p ON e.id = p.id WHERE uid = 'u7'", ENTRIES, NAMES, PATHS, ONE_PATH))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return O.dump(_with_path(spark, sf), "user", "u7")


@query("a14_dump_status", sql("SELECT e.id, type, status, size, uid, gid, path FROM entries e LEFT JOIN one_paths p ON e.id = p.id WHERE coalesce(status, '') = ''", ENTRIES, NAMES, PATHS, ONE_PATH))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return O.dump(_with_path(spark, sf), "status", "")


STRIPE_COUNTS = "own AS (SELECT s.id, s.place, s.ostidx, s.n, (e.blocks * 512) // 1048576 AS whole, (e.blocks * 512) % 1048576 AS rest, e.type, e.size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stripe_index, ostidx) - 1 AS place, count(*) OVER (PARTITION BY id) AS n FROM stripe_items) s JOIN entries e ON e.id = s.id), on_ost AS (SELECT *, (CASE WHEN whole > place THEN (whole - place + n - 1) // n ELSE 0 END * 2048 + CASE WHEN whole % n = place THEN (rest + 511) // 512 ELSE 0 END)::BIGINT AS blocks FROM own)"


@query("a14_dump_ost", sql("SELECT o.id, any_value(type) AS type, any_value(size) AS size, any_value(path) AS path, any_value(n)::INTEGER AS stripe_count, bool_or(blocks > 0) AS data_on_ost FROM on_ost o LEFT JOIN one_paths p ON o.id = p.id WHERE ostidx IN (3, 5) GROUP BY o.id", ENTRIES, STRIPES, STRIPE_COUNTS, NAMES, PATHS, ONE_PATH))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return O.dump_osts(_with_path(spark, sf), K.stripe_items(spark, sf), [3, 5], 1 << 20)


@query("c13_blocks_on_ost", sql("SELECT id, place::INTEGER AS place, ostidx, blocks FROM on_ost", ENTRIES, STRIPES, STRIPE_COUNTS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks_by_stripe(spark, sf).select("id", "place", "ostidx", "blocks")


def _blocks_by_stripe(spark: SparkSession, sf: str) -> DataFrame:
    striped = K.entries(spark, sf).select("id", F.col("blocks").alias("all_blocks")).join(K.striping(K.stripe_items(spark, sf)), "id")
    each = striped.select("id", "all_blocks", F.size("osts").alias("n"), F.posexplode("osts").alias("place", "ostidx"))
    return each.withColumn("blocks", S.blocks_on_ost(F.col("all_blocks") * 512, F.lit(1 << 20), F.col("n"), F.col("place")))


@query("j10_ost_amounts", sql("SELECT ostidx, sum(blocks)::BIGINT AS blocks, count(DISTINCT id)::BIGINT AS files FROM on_ost GROUP BY ostidx", ENTRIES, STRIPES, STRIPE_COUNTS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks_by_stripe(spark, sf).groupBy("ostidx").agg(F.sum("blocks").alias("blocks"), F.count_distinct("id").alias("files"))


@on_entries("c06_dates", "SELECT id, last_mod AS full_date, last_mod // 60 * 60 AS minutes FROM entries")
def _(e: DataFrame) -> DataFrame:
    full = S.utc_text(F.col("last_mod"), "%Y%m%d%H%M%S")
    return e.select("id", S.parse_date(full).alias("full_date"), S.parse_date(F.substring(full, 1, 12)).alias("minutes"))


@on_entries("c12_lists", f"SELECT id, CASE WHEN len(c) > 0 THEN '+' || array_to_string(c, '+') || '+' ELSE '' END AS encoded, len(c)::INTEGER AS count FROM (SELECT id, {CLASSES_SQL} AS c FROM entries WHERE status IS NOT NULL)")
def _(e: DataFrame) -> DataFrame:
    encoded = S.encode_list(P.classes(_classes()))
    return e.filter("status IS NOT NULL").select("id", encoded.alias("encoded"), F.size(S.decode_list(encoded)).alias("count"))


@on_entries("c18_escaped_names", r"SELECT id, 'f' || num || '\012\134\303\274' || uid AS shown FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", S.printable(F.concat(F.lit("f"), "num", F.lit("\n\\ü"), "uid")).alias("shown"))


@on_entries("e21_scan_activity", "SELECT (max(last_access) - min(creation_time))::BIGINT AS duration, count(*)::BIGINT AS entries, count(*) FILTER (invalid)::BIGINT AS errors, 4::BIGINT AS threads, 1000 / (1 + count(*) % 7)::DOUBLE * 4 AS speed FROM entries")
def _(e: DataFrame) -> DataFrame:
    one = e.agg(
        F.min("creation_time").alias("scan_start"), F.max("last_access").alias("scan_end"), F.count(F.lit(1)).alias("entries_scanned"), F.count_if("invalid").alias("scan_errors"),
        F.lit(4).alias("scan_threads"), (1 + F.count(F.lit(1)) % 7).alias("avg_ms_per_entry"),
    )
    return R.scan_activity(one.select(*[F.col(c).cast("string") for c in one.columns]).unpivot([], one.columns, "name", "value"))


@on_entries("e24_saved_chart", "SELECT uid AS x, sum(size)::BIGINT AS y, type AS series FROM entries WHERE projid = 2 GROUP BY uid, type")
def _(e: DataFrame) -> DataFrame:
    chart = R.Chart("usage", "bar", {"uid": "group", "type": "group", "size": "sum"}, "uid", "sum_size", "type", (("projid", "equal", 2),))
    return R.Chart.loaded(chart.saved()).rows(e)


@on_entries("f04_effective_limits", "SELECT id, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS max_count FROM (SELECT id, num % 3 * 10 AS a, projid * 7 AS b FROM entries)")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", P.effective_limits(F.col("num") % 3 * 10, F.col("projid") * 7).alias("max_count"))


TOKENS_SQL = """q AS (SELECT id, uid, size, row_number() OVER (PARTITION BY uid ORDER BY last_access, id) AS n FROM entries WHERE type = 'file'), plan AS (
  SELECT id, uid, n, 0::BIGINT AS period, 2::BIGINT AS tokens, 2000000000000 - size AS volume, FALSE AS forced FROM q WHERE n = 1
  UNION ALL
  SELECT id, uid, n, period + waits, CASE WHEN waits > 0 THEN 3 ELSE tokens END - 1, CASE WHEN waits > 0 THEN least(volume + waits * 2000000000000, 2000000000000) ELSE volume END - size, need > waits FROM (
    SELECT *, least(need, 3) AS waits FROM (
      SELECT q.id, q.uid, q.n, q.size, p.period, p.tokens, p.volume, greatest(CASE WHEN p.tokens <= 0 THEN 1 ELSE 0 END, CASE WHEN p.volume <= 0 THEN -p.volume // 2000000000000 + 1 ELSE 0 END)::BIGINT AS need
      FROM plan p JOIN q ON q.uid = p.uid AND q.n = p.n + 1)))"""


@query("f06_token_plan", sql("SELECT id, period, forced FROM plan", ENTRIES, TOKENS_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = K.entries(spark, sf).filter("type = 'file'").select("id", "uid", "size", "last_access")
    return P.token_plan(files, "uid", ["last_access", "id"], 3, 2_000_000_000_000, 3).select("id", "period", "forced")


@query("h12_merged_attributes", sql("SELECT coalesce(e.id, l.id) AS id, coalesce(e.status, l.status) AS filled, coalesce(l.status, e.status) AS updated FROM entries e FULL JOIN later l ON e.id = l.id", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf).select("id", "status")
    new = _later(K.entries(spark, sf)).select("id", "status")
    filled = D.upsert(e, new, fill_only=True).withColumnRenamed("status", "filled")
    return filled.join(D.upsert(e, new).withColumnRenamed("status", "updated"), "id")


#: Change records with seconds cut off, as ``catalog.changelog`` does; CHANGELOG rounds them.


@query("i04_archive_records", sql("SELECT idx, tfid, is_state FROM (SELECT *, type IN ('CLOSE', 'MTIME') AS is_state, lead(time) OVER (PARTITION BY mdt, tfid ORDER BY idx) - time AS gap FROM changelog) WHERE NOT is_state OR gap IS NULL OR gap > 86400", RECORDS_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = K.changelog(spark, sf).withColumn("is_state", F.col("type").isin("CLOSE", "MTIME"))
    return L.without_old_states(c, 86400).select("idx", "tfid", "is_state")


@query("i17_reader_speed", sql("SELECT mdt, report_time, rec_id, rec_time, (rec_id - lag(rec_id) OVER w) / (report_time - lag(report_time) OVER w) AS speed, (rec_time - lag(rec_time) OVER w) / (report_time - lag(report_time) OVER w) AS ratio, report_time - rec_time AS behind FROM (SELECT mdt, time // 86400 * 86400 + 86400 AS report_time, max(idx) AS rec_id, max(time) AS rec_time FROM changelog GROUP BY 1, 2) WINDOW w AS (PARTITION BY mdt ORDER BY report_time)", RECORDS_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    day = (S.time_bucket(F.col("time"), "day") + 86400).alias("report_time")
    return L.speeds(K.changelog(spark, sf).groupBy("mdt", day).agg(F.max("idx").alias("rec_id"), F.max("time").alias("rec_time")))


@on_entries("j03_scope", "SELECT id FROM entries WHERE type = 'file' AND ost_pool = 'pool_a'")
def _(e: DataFrame) -> DataFrame:
    return e.filter(X.matched(X.and_(F.col("type") == "file", F.col("ost_pool") == "pool_a"))).select("id")


@on_entries("j04_ignored", "SELECT id, CASE WHEN uid = 'u3' OR status = 'new' OR size = 0 THEN TRUE WHEN status IS NULL THEN NULL ELSE FALSE END AS ignored FROM entries")
def _(e: DataFrame) -> DataFrame:
    return e.select("id", P.whitelisted([F.col("uid") == "u3", F.col("status") == "new", F.col("size") == 0]).alias("ignored"))


@query("j09_class_and_ost_targets", sql(f"SELECT e.id, coalesce(list_contains({CLASSES_SQL}, 'big'), FALSE) AS of_class, EXISTS (SELECT 1 FROM stripe_items s WHERE s.id = e.id AND s.ostidx = 5) AS of_ost FROM entries e", ENTRIES, STRIPES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    osts = K.stripe_items(spark, sf).groupBy("id").agg(F.collect_set("ostidx").alias("osts"))
    rows = K.entries(spark, sf).withColumn("fileclass", P.classes(_classes())).join(osts, "id", "left")
    return rows.select("id", P.on_target("class", "b*g").alias("of_class"), P.on_target("ost", 5).alias("of_ost"))


@on_entries("j20_before_maintenance", f"SELECT id FROM entries WHERE last_mod < {NOW} - 2592000")
def _(e: DataFrame) -> DataFrame:
    factor = P.maintenance_factor(NOW, NOW + 2 * 86400, 8 * 86400)
    return e.filter(X.age(F.col("last_mod"), ">", X.time_modify(X.parse_duration("120d"), factor, X.parse_duration("10d")), NOW)).select("id")


@query("j27_scan_intervals", sql("SELECT ost, (600 + (100 - pct) / 100 * (86400 - 600))::DOUBLE AS seconds FROM (SELECT ost, 100 * (f_blocks - f_bfree) / (f_blocks + f_bavail - f_bfree) AS pct FROM capacity)", STRIPES, CAPACITY_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    usage = P.target_usage(_capacity(spark, sf))
    return usage.select(F.col("target").alias("ost"), P.adaptive_interval(F.col("used_pct"), 600, 86400).alias("seconds"))


# ---- rules read from text ----

RULES = """
# long-lived data first; what users of the first pool own stays
define_policy cleanup {
    scope { type != directory and status != released }
    status_manager = basic;
    default_action = unlink;
    default_lru_sort_attr = last_access;
}
FileClass big { definition { size >= 100MB } }
FileClass small_new { definition { size < 1MB and last_mod < 3000d } cleanup_action_params { level = 5; note = "{fileclass} by {rule}"; } }
FileClass owned { definition { owner == "u1*" or group == g3 } report = no; }
FileClass big_owned { definition { big inter owned } }
FileClass other { definition { not big union small_new } }
FileClass second { definition { type == file and projid != 1 and ost_pool == "pool_[b-z]" } }

cleanup_rules {
    ignore { owner == u7 or ost_pool == pool_a }
    ignore { size == 0 }
    rule owned_data { target_fileclass = big_owned; condition { last_access > 2200d and not nlink == 2 } action = archive; }
    rule young { target_fileclass = small_new; condition = true; action_params { level = 3; } }
    rule second { target_fileclass = second; condition { last_mod > 8y or projid == 2 and size > 1GB } }
    rule default { condition { creation > 3000d or size > 40GB } }
}
cleanup_parameters { lru_sort_attr = last_mod(desc); max_action_count = 500; action_params { level = 1; by = policy; } }
cleanup_trigger { trigger_on = user_usage(u1, u2); high_threshold_pct = 20%; low_threshold_pct = 15%; check_interval = 5min; action_params { by = trigger; } }
"""
RULE_CONTEXT = B.Context(now=NOW, statuses=("new", "modified", "synchro", "released"), stored=frozenset({"uid", "gid", "projid", "size", "type", "last_mod", "last_access", "creation_time", "nlink", "status", "ost_pool"}))
_BIG, _SMALL, _OWNED = "size >= 104857600", f"(size < 1048576 AND {NOW} - last_mod < 259200000)", "(uid LIKE 'u1%' OR gid = 'g3')"
RULES_SQL = f"""rules AS (
  SELECT *, {_BIG} AS big, {_SMALL} AS small_new, {_BIG} AND {_OWNED} AS big_owned, NOT ({_BIG} OR {_SMALL}) AS other,
    CASE WHEN type = 'file' AND projid <> 1 THEN regexp_full_match(ost_pool, 'pool_[b-z]') ELSE FALSE END AS second,
    CASE WHEN uid = 'u7' THEN TRUE WHEN type <> 'file' THEN FALSE ELSE ost_pool = 'pool_a' END AS kept
  FROM entries),
acted AS (
  SELECT *, CASE WHEN big_owned THEN CASE WHEN {NOW} - last_access > 190080000 AND nlink <> 2 THEN 'owned_data' END
    WHEN small_new THEN 'young'
    WHEN coalesce(second, FALSE) THEN CASE WHEN {NOW} - last_mod > 252288000 OR (projid = 2 AND size > 1073741824) THEN 'second' END
    WHEN {NOW} - creation_time > 259200000 OR size > 42949672960 THEN 'default' END AS rule
  FROM rules WHERE NOT invalid AND type <> 'dir' AND coalesce(status, '') <> 'released' AND kept = FALSE AND size <> 0)"""


@query("j32_rules_from_text", sql("SELECT id, rule, CASE rule WHEN 'owned_data' THEN 'archive' ELSE 'unlink' END AS action FROM acted WHERE rule IS NOT NULL", ENTRIES, RULES_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rules = RuleSet.read(RULES)
    policy = rules.policy("cleanup", RULE_CONTEXT)
    return P.candidates(K.entries(spark, sf), policy).select("id", "rule", P.action(policy, rules.policies["cleanup"].action).alias("action"))


@query("j02_classes_from_text", sql("SELECT id, array_to_string(list_filter([CASE WHEN big THEN 'big' END, CASE WHEN small_new THEN 'small_new' END, CASE WHEN big_owned THEN 'big_owned' END, CASE WHEN other THEN 'other' END, CASE WHEN second THEN 'second' END], lambda x: x IS NOT NULL), '+') AS classes FROM rules", ENTRIES, RULES_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.entries(spark, sf).select("id", F.array_join(P.classes(RuleSet.read(RULES).class_columns(RULE_CONTEXT)), "+").alias("classes"))


@query("b09_prefiltered_candidates", sql("SELECT rule, count(*)::BIGINT AS count, sum(size)::BIGINT AS size FROM acted WHERE rule IS NOT NULL GROUP BY rule", ENTRIES, RULES_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = RuleSet.read(RULES).candidates(K.entries(spark, sf), "cleanup", RULE_CONTEXT)
    return fitted(found.groupBy("rule").agg(F.count(F.lit(1)).alias("count"), S.total("size").alias("size")))


# ---- reports by cube or base ----

_OWNERS = W.Report(("uid", "type"), ("count", "sum_size", "avg_size", "sum_blocks", "profile"), T.condition("(group == g3 or group == 'g[56]') and not status == released"), (("count", ">=", 3),), ("-sum_size", "uid", "type"), 60)
_LARGE = W.Report(("gid",), ("count", "sum_size", "avg_size", "min_size", "max_size", "distinct_uid"), T.condition("size > 1MB and type == file"))


@query("e02_report_from_cube", sql(f"SELECT uid, type, count(*)::BIGINT AS count, sum(size)::BIGINT AS sum_size, round(sum(size) / count(size))::BIGINT AS avg_size, sum(blocks)::BIGINT AS sum_blocks, {PROFILE_SQL} FROM entries WHERE gid IN ('g3', 'g5', 'g6') AND coalesce(status, '') <> 'released' GROUP BY uid, type HAVING count(*) >= 3 ORDER BY sum_size DESC, uid, type LIMIT 60"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return W.run(_OWNERS, e, materialize(W.build(e)), RULE_CONTEXT)


@query("e02_report_from_entries", sql("SELECT gid, count(*)::BIGINT AS count, sum(size)::BIGINT AS sum_size, round(sum(size) / count(size))::BIGINT AS avg_size, min(size)::BIGINT AS min_size, max(size)::BIGINT AS max_size, count(DISTINCT uid)::BIGINT AS distinct_uid FROM entries WHERE size > 1048576 AND type = 'file' GROUP BY gid"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return W.run(_LARGE, e, W.build(e), RULE_CONTEXT)


# ---- runs for many targets ----

QUOTA_RULES = """
define_policy purge { scope { type == file } default_action = unlink; default_lru_sort_attr = last_access; }
purge_rules { ignore { status == new } rule default { condition { size > 0 } } }
purge_trigger { trigger_on = user_usage; high_threshold_pct = 2.2%; low_threshold_pct = 2%; check_interval = 1h; }
purge_trigger { trigger_on = group_count(g1, g2, g4); high_threshold_cnt = 100; low_threshold_cnt = 90; check_interval = 1h; }
purge_trigger { trigger_on = pool_usage; high_threshold_pct = 2%; low_threshold_pct = 1.9%; check_interval = 1h; }
"""


def _purge(spark: SparkSession, sf: str, number: int):
    rules, e = RuleSet.read(QUOTA_RULES), K.entries(spark, sf)
    policy = rules.policies["purge"]
    return e, policy, policy.triggers[number], rules.candidates(e, "purge", RULE_CONTEXT).drop("rule")


def _before(target: str, amount: str) -> str:
    return f"coalesce(sum({amount}) OVER (PARTITION BY {target} ORDER BY last_access, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


_PURGED = "purged AS (SELECT * FROM entries WHERE NOT invalid AND type = 'file' AND coalesce(status, '') <> 'new' AND size > 0)"


@query("f02_user_limits", sql(f"SELECT p.uid, p.id, p.blocks FROM (SELECT p.*, {_before('p.uid', 'blocks')} AS before FROM purged p) p JOIN users u ON p.uid = u.target WHERE before < u.blocks", ENTRIES, _PURGED, """
users AS (SELECT uid AS target, (sum(blocks) - floor((SELECT sum(blocks) FROM entries) * 2.0::DOUBLE / 100))::BIGINT AS blocks FROM entries GROUP BY uid HAVING sum(blocks) > (SELECT sum(blocks) FROM entries) * 2.2::DOUBLE / 100)"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, policy, trigger, candidates = _purge(spark, sf, 0)
    total = e.agg(F.sum("blocks")).first()[0]
    limits = G.triggered(e, trigger, total=total).withColumnRenamed("blocks", "amount").withColumn("blocks", F.col("amount"))
    return G.run_plan(candidates, policy, limits, "uid", "blocks").select("uid", "id", "blocks")


@query("f02_group_counts", sql(f"SELECT gid, count(*)::BIGINT AS files, max(last_access)::BIGINT AS newest FROM (SELECT p.*, {_before('gid', '1')} AS before FROM purged p WHERE gid IN ('g1', 'g2', 'g4')) p JOIN (SELECT gid AS target, count(*) - 90 AS most FROM entries GROUP BY gid HAVING count(*) > 100) u ON p.gid = u.target WHERE before < u.most GROUP BY gid", ENTRIES, _PURGED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, policy, trigger, candidates = _purge(spark, sf, 1)
    plan = G.run_plan(candidates, policy, G.triggered(e, trigger), "gid", "count")
    return plan.groupBy("gid").agg(F.count(F.lit(1)).alias("files"), F.max("last_access").alias("newest"))


POOLS_SQL = """usages AS (SELECT 'ost' || ost AS target, (f_blocks - f_bfree)::BIGINT AS used, (f_blocks + f_bavail - f_bfree)::BIGINT AS total FROM capacity),
full_osts AS (SELECT target, greatest(0, used - floor(total * 3.4::DOUBLE / 100))::BIGINT * 1000 AS blocks, row_number() OVER (ORDER BY 100 * used / total DESC, target) AS rank FROM usages WHERE 100 * used / total >= 3.5),
placed AS (SELECT p.*, 'ost' || s.ostidx AS target FROM purged p JOIN (SELECT DISTINCT id, ostidx FROM stripe_items) s ON p.id = s.id),
assigned AS (SELECT a.*, o.blocks AS most FROM placed a JOIN full_osts o USING (target) WHERE o.rank = (SELECT min(x.rank) FROM placed y JOIN full_osts x USING (target) WHERE y.id = a.id))"""


@query("j18_ost_runs", sql(f"SELECT target, id, blocks FROM (SELECT *, {_before('target', 'blocks')} AS before FROM assigned) WHERE before < most", ENTRIES, STRIPES, CAPACITY_SQL, _PURGED, POOLS_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, policy, _, candidates = _purge(spark, sf, 0)
    usage = P.target_usage(_capacity(spark, sf)).withColumn("target", F.concat(F.lit("ost"), "target"))
    full = materialize(G.usage_targets(usage, 3.5, 3.4).withColumn("blocks", F.col("blocks") * 1000))
    osts = K.stripe_items(spark, sf).select("id", F.concat(F.lit("ost"), "ostidx").alias("target")).distinct()
    return G.run_plan(G.once(candidates.join(osts, "id"), "id", full), policy, full, "target", "blocks").select("target", "id", "blocks")


# ---- what a scan has not seen, moved directories ----

SCAN = 860_000_000
SCANNED = f"""seen AS (SELECT *, last_mod AS md_update FROM entries),
dated AS (SELECT n.*, CASE WHEN n.name LIKE '%link' THEN s.last_mod + 40000000 ELSE s.last_mod END AS path_update FROM names n LEFT JOIN seen s ON n.id = s.id),
named AS (SELECT d.*, p.path, d.path_update < {SCAN} AS old FROM dated d JOIN full_paths p ON d.id = p.id AND d.parent_id = p.parent_id AND d.name = p.name)"""


def _scanned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Entries and names with the dates at which a scan saw them; second names were seen later than first ones."""
    e = K.entries(spark, sf).withColumn("md_update", F.col("last_mod"))
    names = K.names(spark, sf).join(e.select("id", "md_update"), "id", "left")
    return e, names.select("id", "parent_id", "name", F.when(F.col("name").endswith("link"), F.col("md_update") + 40_000_000).otherwise(F.col("md_update")).alias("path_update"))


@query("h05_partial_scan_tombstones", sql(f"""SELECT s.id, s.size, n.path, {NOW}::BIGINT AS rm_time FROM seen s LEFT JOIN (
  SELECT id, count(*) AS n_names, count(CASE WHEN old AND starts_with(path, '/d20/') THEN 1 END) AS n_lost, min(CASE WHEN old AND starts_with(path, '/d20/') THEN path END) AS path FROM named GROUP BY id) n ON s.id = n.id
  WHERE s.md_update < {SCAN} AND (n.id IS NULL OR n_lost = n_names)""", ENTRIES, NAMES, PATHS, SCANNED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, names = _scanned(spark, sf)
    return Q.collect(e, names, SCAN, NOW, K.ROOT, "/d20").tombstones.select("id", "size", "path", "rm_time")


@query("h07_partial_scan_names", sql("SELECT id, parent_id, name FROM named WHERE NOT (old AND starts_with(path, '/d20/'))", ENTRIES, NAMES, PATHS, SCANNED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, names = _scanned(spark, sf)
    return Q.collect(e, names, SCAN, NOW, K.ROOT, "/d20").names.select("id", "parent_id", "name")


@query("h07_full_scan_tombstones", sql(f"SELECT s.id, s.size, min(CASE WHEN n.old THEN n.path END) AS path, {NOW}::BIGINT AS rm_time FROM seen s LEFT JOIN named n ON s.id = n.id WHERE s.md_update < {SCAN} GROUP BY s.id, s.size", ENTRIES, NAMES, PATHS, SCANNED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, names = _scanned(spark, sf)
    return Q.collect(e, names, SCAN, NOW, K.ROOT).tombstones.select("id", "size", "path", "rm_time")


MOVED = """moved(id, parent_id, name) AS (VALUES ('40', '80', 'inner'), ('80', '0', 'outer'), ('420', '40', 'd420'), ('60', '0', 'sixty')),
dirs AS (SELECT n.id, coalesce(m.parent_id, n.parent_id) AS parent_id, coalesce(m.name, n.name) AS name FROM names n JOIN entries e ON n.id = e.id LEFT JOIN moved m ON n.id = m.id WHERE e.type = 'dir'),
ways AS (SELECT id, parent_id AS up, name AS way FROM dirs UNION ALL SELECT w.id, d.parent_id, d.name || '/' || w.way FROM ways w JOIN dirs d ON w.up = d.id)"""


@query("d07_paths_after_moves", sql("SELECT id, '/' || way AS path FROM ways WHERE up = '0'", ENTRIES, NAMES, MOVED))
def _(spark: SparkSession, sf: str) -> DataFrame:
    kinds = K.entries(spark, sf).filter("type = 'dir'").select("id")
    stored = materialize(N.all_paths(K.names(spark, sf).join(kinds, "id", "left_semi"), K.ROOT).select("id", "path"))
    moves = spark.createDataFrame([("40", "80", "inner"), ("80", "0", "outer"), ("420", "40", "d420"), ("60", "0", "sixty")], "id string, parent_id string, name string")
    return M.after_moves(stored, moves, K.ROOT)


# ---- change records with keyed state ----

_AGE = 86_400
WALK = f"""recs AS (SELECT *, row_number() OVER (PARTITION BY mdt, tfid ORDER BY idx) AS n FROM changelog WHERE type NOT IN ('MARK', 'IOCTL')),
walk AS (
  SELECT mdt, tfid, 0::BIGINT AS n, []::STRUCT(idx BIGINT, time BIGINT, type VARCHAR)[] AS waiting, []::STRUCT(idx BIGINT, time BIGINT, type VARCHAR)[] AS gone FROM (SELECT DISTINCT mdt, tfid FROM recs)
  UNION ALL
  SELECT mdt, tfid, n,
    CASE WHEN list_has_any(list_transform(live, lambda x: x.type), hiders) THEN live
      WHEN len(live) > 0 AND type = 'UNLINK' AND live[-1].type IN ('CREATE', 'MKNOD') THEN live[:-2]
      ELSE list_append(live, {{'idx': idx, 'time': time, 'type': type}}) END, over
  FROM (SELECT w.mdt, w.tfid, r.n, r.idx, r.time, r.type, list_filter(w.waiting, lambda x: x.time > r.time - {_AGE}) AS live, list_filter(w.waiting, lambda x: x.time <= r.time - {_AGE}) AS over,
      CASE WHEN r.type IN ('CLOSE', 'TRUNC') THEN ['TRUNC', 'CLOSE', 'MTIME', 'CREATE'] WHEN r.type = 'MTIME' THEN ['TRUNC', 'CLOSE', 'MTIME', 'CREATE', 'MKNOD', 'MKDIR']
        WHEN r.type IN ('SETATTR', 'CTIME') THEN ['CTIME', 'SETATTR', 'CREATE', 'MKNOD', 'MKDIR'] ELSE []::VARCHAR[] END AS hiders
    FROM walk w JOIN recs r ON r.mdt = w.mdt AND r.tfid = w.tfid AND r.n = w.n + 1)),
stays AS (
  SELECT mdt, tfid, unnest(gone, recursive := true) FROM walk
  UNION ALL SELECT w.mdt, w.tfid, unnest(w.waiting, recursive := true) FROM walk w JOIN (SELECT mdt, tfid, max(n) AS n FROM recs GROUP BY ALL) m ON w.mdt = m.mdt AND w.tfid = m.tfid AND w.n = m.n)"""


@query("i02_keyed_compaction", sql("SELECT mdt, tfid, idx, time, type FROM stays", RECORDS_SQL, WALK))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return Y.compact(K.changelog(spark, sf), _AGE).select("mdt", "tfid", "idx", "time", "type")


@query("i05_stream_compaction", sql("SELECT mdt, tfid, idx, time, type FROM stays", RECORDS_SQL, WALK))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The log comes in three parts, each followed by a run that goes on from the checkpoint of the one before; a last
    record far in the future lets all go that still waits."""
    at, log, store = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", K.changelog(spark, sf), "spark.sql.streaming.stateStore.providerClass"
    first, last = log.agg(F.min("idx"), F.max("idx")).first()
    if first is None:
        return log.select("mdt", "tfid", "idx", "time", "type")
    ends = [first + (last - first) * k // 3 for k in (1, 2)]
    parts = [log.filter(F.col("idx") <= ends[0]), log.filter((F.col("idx") > ends[0]) & (F.col("idx") <= ends[1])), log.filter(F.col("idx") > ends[1])]
    final = log.select("mdt").distinct().select(F.lit(1 << 60).alias("idx"), F.lit(NOW * 100).alias("time"), F.lit("CREATE").alias("type"), "mdt", F.lit("end").alias("tfid")).select(*log.columns)
    before = spark.conf.get(store, None)
    try:
        Y.use_state_store(spark)
        for part in (*parts, final):
            part.write.mode("append").parquet(f"{at}/in")
            stream = Y.compact_stream(spark.readStream.schema(log.schema).parquet(f"{at}/in"), _AGE, "30 days")
            stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return spark.read.schema(log.schema).parquet(f"{at}/out").filter("tfid <> 'end'").select("mdt", "tfid", "idx", "time", "type")


@query("e20_counter_differences", sql("""SELECT day, mdt, type, total, (total - coalesce(lag(total) OVER w, 0))::BIGINT AS gained, ((total - coalesce(lag(total) OVER w, 0)) / nullif(day - lag(day) OVER w, 0))::DOUBLE AS speed
  FROM (SELECT day, mdt, type, sum(n) OVER (PARTITION BY mdt, type ORDER BY day)::BIGINT AS total FROM (SELECT (time // 86400 + 1) * 86400 AS day, mdt, type, count(*) AS n FROM changelog GROUP BY ALL)) WINDOW w AS (PARTITION BY mdt, type ORDER BY day)""", RECORDS_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    day = ((F.floor(F.col("time") / 86_400) + 1) * 86_400).cast("long")
    daily = K.changelog(spark, sf).groupBy(day.alias("day"), "mdt", "type").agg(F.count(F.lit(1)).alias("n"))
    totals = daily.select("day", "mdt", "type", F.sum("n").over(Window.partitionBy("mdt", "type").orderBy("day")).alias("total"))
    return V.differences(totals, "day").select("day", "mdt", "type", "total", "gained", "speed")


# ---- find and du over roots, checks, lifecycle ----

def _named_find(spark: SparkSession, sf: str, test, roots, **more) -> DataFrame:
    e, names = K.entries(spark, sf), K.names(spark, sf)
    return I.find(e, names, K.ROOT, roots, None, **more).withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(X.matched(B.compiled(test, RULE_CONTEXT)))


@query("b40_find_below_roots", sql("SELECT r.root, p.id, p.path FROM full_paths p JOIN entries e ON p.id = e.id JOIN (VALUES ('/d20'), ('/d60/d1200')) r(root) ON p.path = r.root OR starts_with(p.path, r.root || '/') WHERE e.type = 'dir' OR e.size > 1048576", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _named_find(spark, sf, T.condition("type == directory or size > 1MB"), ["/d20", "/d60/d1200", "/not/there"]).select("root", "id", "path")


@query("b40_find_everything", sql("SELECT p.id, p.path FROM full_paths p JOIN entries e ON p.id = e.id WHERE e.type <> 'dir' AND ((e.type = 'file' AND e.size > 1048576) OR (lower(p.name) LIKE 'f%link' AND e.uid LIKE 'u2%'))", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _named_find(spark, sf, T.condition("(type == file and size > 1MB) or iname == 'F*LINK' and owner == 'u2*'"), ["/"], kinds="no_dirs").select("id", "path")


@query("b40_find_root_row", sql("SELECT p.id, p.path FROM full_paths p JOIN entries e ON p.id = e.id WHERE e.type = 'dir' AND e.nlink < 2 AND e.mode = 420 UNION ALL SELECT '0', '/'", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, names = K.entries(spark, sf), K.names(spark, sf)
    return I.find(e, names, K.ROOT, ["/"], (F.col("nlink") < 2) & (F.col("mode") == 420), "dirs", {"type": "dir", "nlink": 1, "mode": 420}).select("id", "path")


_DU_SQL = "SELECT DISTINCT r.root, e.id, e.type, e.blocks, e.size FROM full_paths p JOIN entries e ON p.id = e.id JOIN (VALUES ('/d20'), ('/d40'), ('/d60')) r(root) ON p.path = r.root OR starts_with(p.path, r.root || '/') WHERE e.uid LIKE 'u1%' AND coalesce(e.status, '') <> 'released'"
_DU_TEST = T.condition("owner == 'u1*' and status != released")


@query("e13_du_filtered", sql(f"SELECT root, type, count(*) AS count, sum(blocks)::BIGINT AS blocks, sum(size)::BIGINT AS size, (sum(blocks) * 512)::BIGINT AS used FROM ({_DU_SQL}) GROUP BY 1, 2", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return I.du(K.entries(spark, sf), K.names(spark, sf), K.ROOT, ["/d20", "/d40", "/d60"], B.compiled(_DU_TEST, RULE_CONTEXT))


@query("e13_du_sum", sql(f"SELECT count(*) AS count, sum(blocks)::BIGINT AS blocks, sum(size)::BIGINT AS size, (sum(blocks) * 512)::BIGINT AS used FROM ({_DU_SQL})", ENTRIES, NAMES, PATHS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return I.du(K.entries(spark, sf), K.names(spark, sf), K.ROOT, ["/d20", "/d40", "/d60"], B.compiled(_DU_TEST, RULE_CONTEXT), total=True)


@on_entries("b11_filter_blocks", "SELECT id FROM entries WHERE (size > 1048576 OR size IS NULL) AND (status = 'new' OR (projid <= 2 OR projid IS NULL) OR (type = 'dir' AND nlink = 1)) AND (gid <> 'g2' OR gid IS NULL)")
def _(e: DataFrame) -> DataFrame:
    f = X.Filters().add("size", ">", 5).add("gid", "==", "g1", text=True).replace("size", ">", 1 << 20).add_if_absent("size", "<", 3)
    either = f.block(any_of=True).add("status", "==", "new", text=True).add("projid", "<=", 2)
    either.block().add("type", "==", "dir", text=True).add("nlink", "==", 1)
    f.block()
    return e.filter(f.replace("gid", "!=", "g2", text=True).column()).select("id")


@query("b27_dircount", sql("SELECT e.id, CASE WHEN type <> 'dir' THEN FALSE ELSE coalesce(n, 0) > 19 END AS many, CASE WHEN type <> 'dir' THEN FALSE ELSE coalesce(n, 0) = 0 END AS none FROM entries e LEFT JOIN (SELECT parent_id, count(*) AS n FROM names GROUP BY 1) c ON e.id = c.parent_id", ENTRIES, NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    counts = N.directory_totals(K.names(spark, sf), e).select(F.col("parent_id").alias("dir_id"), "dircount")
    rows = e.join(counts, F.col("id") == F.col("dir_id"), "left").withColumn("dircount", F.coalesce("dircount", F.lit(0)))
    test = lambda text: B.compiled(T.condition(text), RULE_CONTEXT)
    return rows.select("id", test("dircount > 19").alias("many"), test("dircount == 0").alias("none"))


LISTING = """listing AS (SELECT '/l/' || num AS path, num AS ino, uid, gid, size, blocks, CASE WHEN num % 3 = 0 THEN last_mod - 500 ELSE last_access END AS atime, last_mod AS mtime, CASE WHEN num % 5 = 0 THEN last_mod - 9 ELSE last_mod + 9 END AS ctime,
  type, mode + 32768 AS st_mode, nlink FROM entries)"""


@query("a01_listing", sql("SELECT ino::VARCHAR AS id, path AS fullpath, greatest(atime, mtime)::BIGINT AS last_access, mtime::BIGINT AS last_mod, least(ctime, mtime)::BIGINT AS creation_time, (st_mode & 4095)::INTEGER AS mode, size FROM listing WHERE type <> 'symlink' AND NOT (size = 0 AND uid LIKE 'u1%')", ENTRIES, LISTING))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    listing = e.select(
        F.concat(F.lit("/l/"), "num").alias("path"), F.col("num").alias("ino"), "uid", "gid", "size", "blocks", F.when(F.col("num") % 3 == 0, F.col("last_mod") - 500).otherwise(F.col("last_access")).alias("atime"), F.col("last_mod").alias("mtime"),
        F.when(F.col("num") % 5 == 0, F.col("last_mod") - 9).otherwise(F.col("last_mod") + 9).alias("ctime"), "type", (F.col("mode") + 32768).alias("st_mode"), "nlink",
    )
    ignored = [B.compiled(T.condition(c), RULE_CONTEXT) for c in ("type == symlink", "size == 0 and owner == 'u1*'")]
    return K.from_listing(K.scan_filter(listing, ignored)).select("id", "fullpath", "last_access", "last_mod", "creation_time", "mode", "size")


CHECKS = f"""checked AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(coalesce(text, '')) END AS out FROM documents WHERE doc_id % 10 <> 3),
before AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'failed' ELSE 'ok' END AS check_status, CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 5 = 0 THEN sha256(coalesce(text, '') || '!') ELSE sha256(coalesce(text, '')) END AS output,
  {NOW} - 86400 AS last_check, CASE WHEN doc_id % 4 <> 1 THEN {NOW} - 86400 END AS last_success FROM documents WHERE doc_id % 3 > 0)"""


@query("j22_check_against_previous", f"""WITH {CHECKS}, both_ AS (SELECT coalesce(b.id, c.id) AS id, b.check_status AS old_status, b.output AS old, b.last_check AS old_check, b.last_success AS old_success, c.id IS NOT NULL AS ran, c.out AS out FROM before b FULL JOIN checked c ON b.id = c.id),
judged AS (SELECT *, CASE WHEN NOT ran THEN NULL WHEN out IS NULL THEN 'error' WHEN old IS NULL THEN 'first' WHEN out = old THEN 'same' ELSE 'changed' END AS outcome FROM both_)
SELECT id, CASE WHEN outcome IN ('first', 'same') THEN 'ok' WHEN ran THEN 'failed' ELSE old_status END AS check_status, CASE WHEN outcome IN ('first', 'same') THEN out ELSE old END AS output,
  (CASE WHEN ran THEN {NOW} ELSE old_check END)::BIGINT AS last_check, (CASE WHEN outcome IN ('first', 'same') THEN {NOW} ELSE old_success END)::BIGINT AS last_success, outcome FROM judged""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs, i = K.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), F.col("id")
    outputs = docs.filter(i % 10 != 3).select("id", F.when(i % 7 != 0, F.sha2("text", 256)).alias("output"))
    failed = i % 4 == 1
    state = docs.filter(i % 3 > 0).select(
        "id", F.when(failed, "failed").otherwise("ok").alias("check_status"), F.when(~failed, F.when(i % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))).alias("output"),
        F.lit(NOW - 86_400).alias("last_check"), F.when(~failed, NOW - 86_400).alias("last_success"),
    )
    return H.check(outputs, state, NOW)


@query("j29_stale_by_state", sql(f"""SELECT CASE WHEN l.id IS NULL THEN 'gone' WHEN l.status = 'modified' THEN 'running' ELSE 'reset' END AS state, count(*)::BIGINT AS count
  FROM (SELECT *, CASE WHEN num % 9 > 0 THEN last_mod END AS md_update FROM entries) e LEFT JOIN later l ON e.id = l.id WHERE e.status = 'modified' AND NOT e.invalid AND (md_update <= 850000000 OR md_update IS NULL) GROUP BY 1""", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf).withColumn("md_update", F.when(F.col("num") % 9 > 0, F.col("last_mod")))
    return H.stale_actions(e, _later(e), "modified", NOW, NOW - 850_000_000).groupBy("state").agg(F.count(F.lit(1)).alias("count"))


@query("j24_lifecycle", sql(f"SELECT id, CASE WHEN status = 'synchro' THEN 'release' ELSE 'archive' END AS action FROM entries WHERE type = 'file' AND NOT invalid AND (status = 'synchro' OR (status IN ('new', 'modified') AND uid NOT LIKE 'u1%')) UNION ALL SELECT id, 'remove' FROM tombs WHERE type = 'file' AND rm_time <= {NOW} - 50", ENTRIES, TOMBS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return H.lifecycle(e, _tombs(e), NOW, 50, X.like_glob(F.col("uid"), "u1*"))


@query("h10_reversed_diff", sql("""SELECT coalesce(e.id, l.id) AS id, CASE WHEN e.id IS NULL THEN '--' ELSE '++' END AS op, NULL::VARCHAR AS attribute, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM entries e FULL JOIN later l ON e.id = l.id WHERE e.id IS NULL OR l.id IS NULL
  UNION ALL SELECT e.id, '-+', 'size', l.size::VARCHAR, e.size::VARCHAR FROM entries e JOIN later l ON e.id = l.id WHERE e.size <> l.size
  UNION ALL SELECT e.id, '-+', 'status', l.status, e.status FROM entries e JOIN later l ON e.id = l.id WHERE e.status <> l.status""", ENTRIES, LATER))
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = K.entries(spark, sf)
    return D.reversed_diff(D.diff(e, _later(e), ["size", "status"]))


@query("b46_find_lsost", sql("""SELECT id, printf('[%s] %-4s %15d %s', id, type, size, '/' || id) || CASE WHEN osts IS NULL THEN '' ELSE '  ' || osts END AS line
  FROM entries e LEFT JOIN (SELECT id AS sid, string_agg('ost#' || ostidx || ':' || (id::BIGINT * 10 + stripe_index), ', ' ORDER BY stripe_index, ostidx) AS osts FROM stripe_items GROUP BY id) s ON e.id = s.sid""", ENTRIES, STRIPES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    each = F.struct("stripe_index", "ostidx", (F.col("id").cast("long") * 10 + F.col("stripe_index")).alias("objid"))
    striped = K.stripe_items(spark, sf).groupBy(F.col("id").alias("sid")).agg(F.array_sort(F.collect_list(each)).alias("stripes"))
    rows = K.entries(spark, sf).join(striped, F.col("id") == F.col("sid"), "left")
    return rows.select("id", S.listed_briefly({"id": F.col("id"), "type": F.col("type"), "size": F.col("size"), "path": F.concat(F.lit("/"), "id")}, stripes=F.col("stripes")).alias("line"))


@on_entries("b47_printf_modules", "SELECT id, printf('%s %6s|%-9s|%d', id, coalesce(status, ''), CASE WHEN num % 2 = 0 THEN 'a' || (num % 7) ELSE '' END, projid) AS line FROM entries")
def _(e: DataFrame) -> DataFrame:
    values = {"Rf": F.col("id"), "Rm{copy.status}": F.col("status"), "Rm{copy.archive_id}": F.when(F.col("num") % 2 == 0, F.concat(F.lit("a"), F.col("num") % 7)), "RP": F.col("projid")}
    return e.select("id", S.printed("%Rf %6Rm{copy.status}|%-9Rm{copy.archive_id}|%RP", values).alias("line"))


@query("a04_change_records", sql("SELECT idx, time, type, mdt::VARCHAR AS mdt, tfid FROM changelog", RECORDS_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The log as segments of 500 indexes a reader; a first run reads some readers, another one goes on to the end. A log
    of over 100,000 indexes has longer segments, not more of them: files of a hundred records cost more than the records."""
    at, log = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", K.changelog(spark, sf)
    length = 500 * max(1, -(-((log.agg(F.max("idx")).first()[0] or 0) + 1) // 100_000))
    span = F.col("idx") - F.col("idx") % length
    parts = log.withColumn("span", F.concat(span.cast("string"), F.lit("-"), (span + length - 1).cast("string"))).repartition("mdt", "span")
    schema = "idx long, time long, type string, mdt string, tfid string"
    U.register(spark)
    for some in ("mdt < 2", "mdt >= 2"):
        parts.filter(some).write.mode("append").partitionBy("mdt", "span").parquet(f"{at}/log")
        stream = spark.readStream.format(U.NAME).option("path", f"{at}/log").option("schema", schema).option("range", 4 * length).option("tasks", 2 * spark.sparkContext.defaultParallelism).load()
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


@on_entries("b35_own_attributes", f"""SELECT id, coalesce(status, '') = '' AS untagged, coalesce(status, '') LIKE '%o%' AS tagged, CASE WHEN num % 3 > 0 THEN projid >= 2 END AS copies, CASE WHEN num % 5 > 0 THEN invalid = FALSE END AS fine,
  coalesce(CASE WHEN num % 7 = 0 THEN 0 WHEN num % 7 < 5 THEN last_access END, 0) = 0 AS never, coalesce(CASE WHEN num % 7 = 0 THEN 0 WHEN num % 7 < 5 THEN last_access END, 0) <> 0 AND {NOW} - last_access > 86400000 AS long_ago FROM entries""")
def _(e: DataFrame) -> DataFrame:
    n = F.col("num")
    rows = e.withColumns({"copies": F.when(n % 3 > 0, F.col("projid")), "hidden": F.when(n % 5 > 0, F.col("invalid")), "archived": F.when(n % 7 == 0, 0).when(n % 7 < 5, F.col("last_access"))})
    context = B.Context(now=NOW, infos={"tag": B.Info("status", "text"), "copies": B.Info("copies", "number"), "hidden": B.Info("hidden", "boolean"), "last_archive": B.Info("archived", "moment")})
    test = lambda text: B.compiled(T.condition(text), context)
    return rows.select(
        "id", test("tag == ''").alias("untagged"), test("tag == '*o*'").alias("tagged"), test("copies >= 2").alias("copies"), test("hidden == no").alias("fine"), test("last_archive == 0").alias("never"),
        test("last_archive > 1000d").alias("long_ago"),
    )


@query("e04_cube_from_stream", sql(f"""SELECT uid, gid, type, status, sum(size)::BIGINT AS size, sum(blocks)::BIGINT AS blocks, count(*)::BIGINT AS count, {PROFILE_SQL}
  FROM (SELECT * REPLACE (size + CASE WHEN num % 6 = 0 THEN 10 ELSE 0 END AS size, ((size + CASE WHEN num % 6 = 0 THEN 10 ELSE 0 END + 511) // 512)::BIGINT AS blocks) FROM entries WHERE num % 17 > 0) GROUP BY uid, gid, type, status"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All entries come in a first run; in a second one some grow and some go. The cube is what both runs leave."""
    at, e = f"{shared_dir(spark)}/cube-{uuid.uuid4().hex}", K.entries(spark, sf)
    attributes = ["uid", "gid", "type", "status", "size", "blocks"]
    first = e.select("id", F.col("num").alias("idx"), F.lit(False).alias("removed"), *attributes)
    grown = (F.col("size") + 10).cast("long")
    second = e.filter("num % 6 = 0 OR num % 17 = 0").select("id", (F.col("num") + (1 << 40)).alias("idx"), (F.col("num") % 17 == 0).alias("removed"), *attributes[:4], grown.alias("size"), F.floor((grown + 511) / 512).cast("long").alias("blocks"))
    kept, latest = KeptCube(spark, f"{at}/cube"), KeptLatest(spark, f"{at}/latest", attributes)
    for part in (first, second):
        part.write.mode("append").parquet(f"{at}/in")
        kept.follow_updates(spark.readStream.schema(first.schema).parquet(f"{at}/in"), latest, f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    cube = kept.latest()
    return C.build(e.limit(0)) if cube is None else cube.select(*C.KEYS, *C.MEASURES)


@query("i17_stream_rates", sql("""SELECT batch, report, mdt, type, (sum(n) OVER w)::BIGINT AS total, n AS gained, (report - lag(report) OVER w)::BIGINT AS seconds, (n / nullif(report - lag(report) OVER w, 0))::DOUBLE AS speed,
    ((last_time - lag(last_time) OVER w) / nullif(report - lag(report) OVER w, 0))::DOUBLE AS ratio, (report - last_time)::BIGINT AS behind
  FROM (SELECT batch, mdt::VARCHAR AS mdt, type, count(*)::BIGINT AS n, max(time) AS last_time FROM batches GROUP BY ALL) JOIN (SELECT batch, max(time) + 45 AS report FROM batches GROUP BY 1) USING (batch) WINDOW w AS (PARTITION BY mdt, type ORDER BY batch)""", RECORDS_SQL, "batches AS (SELECT *, time // 259200 AS batch FROM changelog)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Reports as a stream stores them: a batch for every three days of the log, told of 45 seconds after its last record."""
    log = K.changelog(spark, sf).withColumn("batch", F.floor(F.col("time") / 259_200).cast("long"))
    counts = log.groupBy("batch", F.col("mdt").cast("string").alias("mdt"), "type").agg(F.count(F.lit(1)).alias("count"), F.max("idx").alias("last_idx"), F.max("time").alias("last_time"))
    progress = log.groupBy("batch").agg((F.max("time") + 45).alias("at"))
    return V.rates(counts, progress).withColumnRenamed("at", "report")


@query("j11_parameters_from_text", sql("""SELECT id, CASE rule WHEN 'owned_data' THEN 'big_owned' WHEN 'default' THEN NULL WHEN 'young' THEN 'small_new' ELSE rule END AS class,
  CASE rule WHEN 'young' THEN 'by=trigger;level=5;note=small_new by young' ELSE 'by=trigger;level=1' END AS parameters FROM acted WHERE rule IS NOT NULL""", ENTRIES, RULES_SQL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rules = RuleSet.read(RULES)
    found, merged = rules.candidates(K.entries(spark, sf), "cleanup", RULE_CONTEXT), rules.parameters("cleanup", RULE_CONTEXT, rules.policies["cleanup"].triggers[0])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("id", rules.target_class("cleanup", RULE_CONTEXT).alias("class"), shown.alias("parameters"))
