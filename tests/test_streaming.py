"""Streams over several files equal the batch operators over all rows."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldnote.operators import contacts as C
from fieldnote.operators import grading as G
from fieldnote.session import local_table
from fieldnote.streaming import streams as X

COLS = "contact_id string, touch_id int, date string, status string"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Touches in three files, later files holding later dates."""
    root = str(tmp_path_factory.mktemp("touches"))
    parts = [
        [("a", 1, "2024-01-01", "contacted"), ("b", 2, "2024-01-01", "research")],
        [("a", 3, "2024-01-20", "responded"), ("b", 4, "2024-03-31", "contacted")],
        [("a", 5, "2024-12-01", "research"), ("c", 6, "2024-12-31", "contacted")],
    ]
    for p in parts:
        df = spark.createDataFrame(p, COLS).selectExpr("contact_id", "touch_id", "CAST(date AS DATE) AS date", "status", "CAST(date AS TIMESTAMP) AS ts")
        df.coalesce(1).write.mode("append").parquet(root)
    return root


def stream(spark, root):
    return X.read_stream(spark, root, spark.read.parquet(root).schema, per_trigger=1)


def test_touch_state_equals_batch(spark, landed, tmp_path):
    got = X.drain_updates(X.touch_state(stream(spark, landed)), str(tmp_path / "o"), str(tmp_path / "c"), ["contact_id"])
    assert rows(got) == rows(C.contact_state(spark.read.parquet(landed)))


def test_quiet_alert(spark, landed, tmp_path):
    got = X.drain_append(X.quiet_alert(stream(spark, landed), 90, "0 seconds"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(got.selectExpr("contact_id", "CAST(alert_at AS STRING)", "touches")) == [
        ("a", "2024-04-19 00:00:00", 2), ("b", "2024-03-31 00:00:00", 1), ("b", "2024-06-29 00:00:00", 1),
    ]


def test_exchanges_equal_batch_for_closed_ones(spark, landed, tmp_path):
    got = X.drain_append(X.exchanges(stream(spark, landed), 30, "1 day"), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = C.exchanges(spark.read.parquet(landed), 30).filter("last_touch < DATE'2024-12-01'")
    assert rows(got.selectExpr("contact_id", "CAST(opened AS DATE) AS opened", "touches")) == rows(batch.select("contact_id", "opened", "touches"))


def test_resumed_stream_continues(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "o"), str(tmp_path / "c")

    def land(*r):
        df = spark.createDataFrame(list(r), COLS).selectExpr("contact_id", "touch_id", "CAST(date AS DATE) AS date", "status")
        df.coalesce(1).write.mode("append").parquet(src)

    land(("a", 1, "2024-01-01", "contacted"), ("b", 2, "2024-01-01", "contacted"))
    X.drain_updates(X.touch_state(stream(spark, src)), out, state, ["contact_id"])
    land(("a", 3, "2024-01-05", "responded"))
    got = X.drain_updates(X.touch_state(stream(spark, src)), out, state, ["contact_id"])
    assert rows(got.select("contact_id", "touch_count", "status")) == [("a", 2, "responded"), ("b", 1, "contacted")]


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """A table in six part files in no order of dates."""
    root = str(tmp_path_factory.mktemp("shuffled"))
    days = ["2024-03-10", "2024-01-09", "2024-02-01", "2024-04-20", "2024-01-10", "2024-04-19"]
    for n, day in enumerate(days):
        rows = [("a", n, day, "call"), ("b" if n % 2 else "c", 10 + n, day, "mail")]
        df = spark.createDataFrame(rows, "contact_id string, touch_id int, d string, type string")
        df.selectExpr("contact_id", "touch_id", "CAST(d AS DATE) AS date", "type", "CAST(d AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(root)
    return root


def daily(df):
    return X.daily_touches(df, "24 hours")


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_emitted_and_late_rows_are_all_rows(spark, shuffled, tmp_path, per_trigger):
    batch = spark.read.parquet(shuffled)
    source = lambda: X.read_stream(spark, shuffled, batch.schema, per_trigger)
    got = X.drain_append(daily(source()), str(tmp_path / "o"), str(tmp_path / "c"))
    ends = F.window("ts", "1 day")["end"]
    late = X.drain_late(source(), ends, "24 hours", str(tmp_path / "l"), str(tmp_path / "k"))
    closed = "day_start < TIMESTAMP'2024-04-19'"  # two days before the last are still open
    both = got.unionByName(daily(late)).groupBy("day_start", "type").agg(F.sum("touches").alias("touches")).filter(closed)
    assert rows(both) == rows(daily(batch).filter(closed))
    assert (late.count() > 0) == (per_trigger == 1)


def test_a_backlog_is_whole_in_any_number_of_files(spark, shuffled, tmp_path):
    batch = spark.read.parquet(shuffled)
    one = str(tmp_path / "one.parquet")
    batch.coalesce(1).write.parquet(one)
    file = next(p for p in (tmp_path / "one.parquet").iterdir() if p.name.startswith("part-"))
    got = []
    for n, path in enumerate((shuffled, one, str(file))):
        source = X.read_stream(spark, path, batch.schema)
        got.append(rows(X.drain_append(X.quiet_alert(source, 20, "0 seconds"), str(tmp_path / f"o{n}"), str(tmp_path / f"c{n}"))))
    assert got[0] == got[1] == got[2] and len(got[0]) > 3


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    schema = "contact_id string, touch_id int, date date, status string"
    (tmp_path / "none").mkdir()
    source = X.read_stream(spark, str(tmp_path / "none"), spark.createDataFrame([], schema).schema)
    got = X.drain_updates(X.touch_state(source), str(tmp_path / "o"), str(tmp_path / "c"), ["contact_id"])
    assert got.count() == 0 and "touch_count" in got.columns


def test_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    for likes in (1, 2):
        spark.createDataFrame([("p", "2024-01-01", likes), ("q", f"2024-01-0{likes}", likes)], "post_id string, scraped_at string, likes int").withColumn("ts", F.col("scraped_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    got = X.drain_append(X.dedup(stream(spark, src), ["post_id", "scraped_at"], "7 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(got.select("post_id", "scraped_at")) == [("p", "2024-01-01"), ("q", "2024-01-01"), ("q", "2024-01-02")]


def test_grade_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    cols = "skill string, iteration int, eval string, mode string, run_id string, text string"
    for i in range(3):
        spark.createDataFrame([("s", 1, "e", "baseline", f"r{i}", "a film" if i else "a b")], cols).coalesce(1).write.mode("append").parquet(src)
    rules = local_table(
        spark,
        [("s", "f", "F", "programmatic", "regex_absent", ["film"], None, None, None, None), ("s", "q", "Q", "qualitative", None, None, None, None, None, None)],
        "skill string, assertion_id string, assertion string, check string, rule string, patterns array<string>, min int, max int, quote_aware boolean, eval string",
    )
    prior = spark.createDataFrame([("r1", "q", True, "good", 1)], "run_id string, assertion_id string, passed boolean, evidence string, seq int")
    got = X.grade_stream(stream(spark, src), rules, str(tmp_path / "o"), str(tmp_path / "c"), lambda: prior)
    want = G.grade(spark.read.parquet(src), rules, prior)
    assert rows(got.select(*want.columns)) == rows(want)
