"""Alerts by timers equal the batch sessions in any order of files, and late rows are told."""

import pytest

from conftest import rows
from fieldnote.streaming import alerts as A
from fieldnote.streaming import streams as X

DAYS = {"a": ["2024-01-01", "2024-01-20", "2024-04-19", "2024-07-18"], "b": ["2024-01-05", "2024-06-01"], "c": ["2024-03-01"], "z": ["2024-12-31"]}
PARTS = [[("a", 0), ("b", 1), ("z", 0)], [("a", 3), ("b", 0), ("c", 0)], [("a", 1), ("a", 2)]]


def put(spark, root, parts):
    for part in parts:
        df = spark.createDataFrame([(c, DAYS[c][i]) for c, i in part], "contact_id string, d string")
        df.selectExpr("contact_id", "CAST(d AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(root)


def drain(spark, root, path, per_trigger=1):
    source = X.read_stream(spark, root, spark.read.parquet(root).schema, per_trigger)
    return A.drain_alerts(source, 90, "0 seconds", f"{path}/o", f"{path}/c")


WANT = [
    ("a", "2024-01-01 00:00:00", "2024-04-19 00:00:00", 2), ("a", "2024-04-19 00:00:00", "2024-07-18 00:00:00", 1), ("a", "2024-07-18 00:00:00", "2024-10-16 00:00:00", 1),
    ("b", "2024-01-05 00:00:00", "2024-04-04 00:00:00", 1), ("b", "2024-06-01 00:00:00", "2024-08-30 00:00:00", 1), ("c", "2024-03-01 00:00:00", "2024-05-30 00:00:00", 1),
]


def shown(df):
    return rows(df.selectExpr("contact_id", "CAST(began AS STRING)", "CAST(alert_at AS STRING)", "touches"))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_alerts_in_any_order_of_files(spark, tmp_path, order):
    put(spark, str(tmp_path / "in"), [PARTS[i] for i in order])
    alerts, late = drain(spark, str(tmp_path / "in"), tmp_path)
    assert shown(alerts) == WANT
    behind, mark = [], ""
    for i in order:
        behind += [(c, f"{DAYS[c][k]} 00:00:00") for c, k in PARTS[i] if DAYS[c][k] < mark]
        mark = max([mark, *[DAYS[c][k] for c, k in PARTS[i]]])
    assert rows(late.selectExpr("contact_id", "CAST(ts AS STRING)")) == sorted(behind, key=repr) and behind


def test_a_late_touch_reopens_and_a_resumed_run_goes_on(spark, tmp_path):
    root = str(tmp_path / "in")
    put(spark, root, [[("a", 0), ("z", 0)]])
    alerts, late = drain(spark, root, tmp_path)
    assert shown(alerts) == [("a", "2024-01-01 00:00:00", "2024-03-31 00:00:00", 1)] and late.count() == 0
    put(spark, root, [[("a", 1)]])
    alerts, late = drain(spark, root, tmp_path)
    assert shown(alerts) == [("a", "2024-01-01 00:00:00", "2024-04-19 00:00:00", 2)]
    assert rows(late.selectExpr("contact_id", "CAST(ts AS STRING)")) == [("a", "2024-01-20 00:00:00")]


def test_a_bridge_joins_two_sessions(spark, tmp_path):
    root = str(tmp_path / "in")
    df = lambda *d: spark.createDataFrame([(c, t) for c, t in d], "contact_id string, d string").selectExpr("contact_id", "CAST(d AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(root)
    df(("a", "2024-01-01"), ("a", "2024-05-01"), ("z", "2025-01-01"))
    assert drain(spark, root, tmp_path)[0].count() == 2
    df(("a", "2024-03-01"))
    assert shown(drain(spark, root, tmp_path)[0]) == [("a", "2024-01-01 00:00:00", "2024-07-30 00:00:00", 3)]


def test_no_touches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = X.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "contact_id string, ts timestamp").schema)
    alerts, late = A.drain_alerts(source, 90, "0 seconds", str(tmp_path / "o"), str(tmp_path / "c"))
    assert alerts.count() == 0 and late.count() == 0


def test_contacts_share_the_state_and_timer_of_their_bucket(spark, tmp_path):
    """200 contacts in 4 buckets: state and timers are kept by bucket, not by contact and session."""
    root, before = str(tmp_path / "in"), spark.conf.get(A.PROVIDER)
    touch = "CAST(DATE '2024-01-01' + CAST({} AS INT) AS TIMESTAMP) AS ts"
    who = "IF(id = 0, NULL, CAST(id AS STRING)) AS contact_id"
    for day in ("200", "IF(id < 100, 0, 300)", "IF(id = 7, NULL, 120)"):  # the last comes behind the watermark
        spark.range(0, 200, 1, 1).selectExpr(who, touch.format(day)).write.mode("append").parquet(root)
    changes = A.quiet_changes(X.read_stream(spark, root, spark.read.parquet(root).schema, 1), 90, "0 seconds", buckets=4)
    spark.conf.set(A.PROVIDER, A.ROCKS)
    try:
        out, said = str(tmp_path / "o"), f"{tmp_path}/c"
        query = changes.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", said).trigger(availableNow=True).start()
        query.awaitTermination()
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4
    finally:
        spark.conf.set(A.PROVIDER, before)
    counts = {r["kind"]: r["count"] for r in spark.read.parquet(out).groupBy("kind").count().collect()}
    # Late: days 0 (100) and 120 (199, without the touch that has no time).  Alerts by day 300: day 0 + 90 (100), and days 120 to 200 + 90,
    # or 200 + 90 alone (200).
    assert counts["late"] == 299 and counts["alert"] - counts.get("reopened", 0) == 300
