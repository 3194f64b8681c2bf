"""Sums beyond 64 bits, averages beyond a double's 53 bits, and running sums over both."""

import pytest
from pyspark.sql import functions as F

from inodelake import registry
from inodelake.operators import policy as P
from inodelake.operators import report as R
from inodelake.sources import catalog as K
from inodelake.storage import fitted

HUGE = (1 << 62) + 1
ATTRIBUTES = "id string, uid string, gid string, type string, status string, num long, size long, blocks long, last_access long, last_mod long"


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(str(i), f"u{i}", "g", "file", "new", i, HUGE, HUGE, i, i) for i in range(8)], ATTRIBUTES)


def run(spark, monkeypatch, name, entries):
    monkeypatch.setattr(K, "entries", lambda *_: entries)
    return [r.asDict() for r in registry.queries()[name](spark, "").collect()]


def test_usage_of_a_type(spark, monkeypatch, files):  # F2
    (row,) = run(spark, monkeypatch, "e07_fs_info", files)
    assert row["size"] == row["blocks"] == 8 * HUGE and row["count"] == 8


def test_report_total(spark, monkeypatch, files):  # F3
    (row,) = run(spark, monkeypatch, "e14_report_total", files)
    assert row["volume"] == 8 * HUGE and row["space_used"] == 8 * HUGE * 512


def test_total_line(spark, monkeypatch, files):  # F4
    rows = run(spark, monkeypatch, "e08_user_info_with_total", files)
    assert [r["size"] for r in rows if r["is_total"]] == [8 * HUGE] and len(rows) == 9


def test_all_others(spark, monkeypatch, files):  # F6
    assert {r["uid"]: r["size"] for r in run(spark, monkeypatch, "g08_top_and_others", files)}["Others"] == 3 * HUGE


def test_volume_of_a_run(files):  # F9
    assert P.run_summary(P.outcome(files, files), "p", 1, 2, "manual").first()["volume"] == 8 * HUGE


@pytest.mark.parametrize("parts", [1, 3])
def test_until_limit(files, parts):  # F5
    assert {r["id"] for r in P.until_limit(files, ["last_access", "id"], {"size": HUGE + 1}, parts).collect()} == {"0", "1"}


def test_max_per_run(files):  # F8
    assert {r["id"] for r in P.max_per_run(files, ["-last_access", "id"], 700, HUGE + 1).collect()} == {"7", "6"}


@pytest.mark.parametrize("by", [[], ["gid"]])
def test_token_periods(spark, files, by):  # F7
    got = {r["id"]: r["period"] for r in P.token_periods(files, ["last_mod", "id"], 3, 1 << 60, by=by).collect()}
    assert got == {str(i): max(i // 3, i * HUGE // (1 << 60)) for i in range(8)}
    # A period that one byte more would begin: as doubles the quotient is whole.
    near = spark.createDataFrame([("a", 0, (1 << 62) - 1), ("b", 1, 1)], "id string, last_mod long, size long")
    assert {r["id"]: r["period"] for r in P.token_periods(near, ["last_mod"], bytes_per_period=1 << 20).collect()} == {"a": 0, "b": (1 << 42) - 1}


def test_average_beyond_doubles(spark):  # F10
    # The doubles' sum drops every 1 that is added to 2^53, so its average is short by nearly one half.
    rows = spark.createDataFrame([("u", (1 << 53))] + [("u", 1)] * 9999 + [("v", None)], "uid string, size long").coalesce(1)
    got = {r["uid"]: r for r in fitted(R.report(rows, ["uid"], R.usage(blocks=None))).collect()}
    assert got["u"]["avg_size"] == ((1 << 53) + 9999 + 5000) // 10000 and got["v"]["avg_size"] is None and got["v"]["size"] is None


def test_sums_are_longs_where_they_fit(spark):
    rows = spark.createDataFrame([("a", (1 << 63) - 1), ("b", 1)], "uid string, size long")
    sums = lambda df: fitted(df.groupBy("uid").agg(R.total("size").alias("size")))
    assert sums(rows).schema["size"].dataType.simpleString() == "bigint"
    assert sums(rows.withColumn("uid", F.lit("c"))).schema["size"].dataType.simpleString() == "decimal(38,0)"
    assert sums(rows.limit(0)).schema["size"].dataType.simpleString() == "bigint"
