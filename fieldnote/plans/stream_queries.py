"""Streaming queries, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.plans import shapes as S
from fieldnote.plans.registry import query
from fieldnote.session import scratch_path
from fieldnote.streaming import alerts as A
from fieldnote.streaming import streams as X


def _stream(spark, sf, name):
    path = f"{sf}/{name}.parquet"
    return X.read_stream(spark, path, spark.read.parquet(path).schema)


def _touches(spark, sf):
    t = S._project(_stream(spark, sf, "orders"), S._TOUCH)
    return t.withColumn("ts", F.col("date").cast("timestamp"))


def _signals(spark, sf):
    s = S._project(_stream(spark, sf, "events"), S._SIGNAL)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_touch_state",
    """
SELECT contact_id, count(*) AS touch_count, max(date) AS last_contact, (list(status ORDER BY date DESC, touch_id DESC))[1] AS status,
       (list(CASE WHEN status = 'contacted' THEN date + 3 END ORDER BY date DESC, touch_id DESC) FILTER (status <> 'research'))[1] AS next_followup
FROM touches GROUP BY contact_id
""",
    shapes="touches",
    dates="last_contact next_followup",
)
def touch_state(spark, sf):
    return X.drain_updates(X.touch_state(_touches(spark, sf)), *X.fresh_paths(spark, "touch-state"), ["contact_id"])


@query(
    "stream_quiet_alert",
    """
WITH m AS (SELECT *, CASE WHEN date - lag(date) OVER w < 90 THEN 0 ELSE 1 END AS o FROM touches WINDOW w AS (PARTITION BY contact_id ORDER BY date, touch_id)),
n AS (SELECT *, sum(o) OVER (PARTITION BY contact_id ORDER BY date, touch_id) AS s FROM m)
SELECT contact_id, CAST(min(date) AS TIMESTAMP) AS began, CAST(max(date) + 90 AS TIMESTAMP) AS alert_at, count(*) AS touches FROM n GROUP BY contact_id, s
HAVING max(date) + 90 <= (SELECT max(date) FROM touches)
""",
    shapes="touches",
    times="began alert_at",
)
def quiet_alert(spark, sf):
    return X.drain_append(X.quiet_alert(_touches(spark, sf), 90, "0 seconds"), *X.fresh_paths(spark, "quiet"))


@query(
    "stream_daily_touches",
    "SELECT CAST(date AS TIMESTAMP) AS day_start, type, count(*) AS touches FROM touches WHERE date + 1 <= (SELECT max(date) - 1 FROM touches) GROUP BY 1, 2",
    shapes="touches",
    times="day_start",
)
def daily_touches(spark, sf):
    return X.drain_append(X.daily_touches(_touches(spark, sf), "24 hours"), *X.fresh_paths(spark, "daily"))


@query(
    "stream_weekly_totals",
    "SELECT date_trunc('week', ts) AS window_start, kind, count(*) AS n, CAST(sum(likes) AS BIGINT) AS likes FROM signals GROUP BY 1, 2",
    shapes="signals",
    times="window_start",
)
def weekly_totals(spark, sf):
    totals = X.tumbling(_signals(spark, sf), ["kind"], [F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes")], "1 day")
    return X.drain_updates(totals, *X.fresh_paths(spark, "weekly"), ["window_start", "kind"])


@query(
    "stream_topic_trend",
    "SELECT CAST(CAST(ts AS DATE) - CAST(i AS INTEGER) AS TIMESTAMP) AS window_start, topic, count(*) AS n FROM signals, range(0, 10) r(i) GROUP BY 1, 2",
    shapes="signals",
    times="window_start",
)
def topic_trend(spark, sf):
    trend = X.sliding(_signals(spark, sf), "10 days", "1 day", ["topic"], [F.count(F.lit(1)).alias("n")], "1 day")
    return X.drain_updates(trend, *X.fresh_paths(spark, "trend"), ["window_start", "topic"])


@query(
    "stream_rolling_feel",
    "SELECT date_trunc('week', ts) - to_days(CAST(i * 7 AS INTEGER)) AS window_start, feel, count(*) AS n FROM signals, range(0, 4) r(i) GROUP BY 1, 2",
    shapes="signals",
    times="window_start",
)
def rolling_feel(spark, sf):
    feel = X.sliding(_signals(spark, sf), "28 days", "7 days", ["feel"], [F.count(F.lit(1)).alias("n")], "1 day", origin="4 days")
    return X.drain_updates(feel, *X.fresh_paths(spark, "feel"), ["window_start", "feel"])


@query(
    "stream_top_post",
    """
WITH w AS (SELECT date_trunc('week', ts) - to_days(CAST(i * 7 AS INTEGER)) AS window_start, event_id, engagements FROM signals, range(0, 4) r(i))
SELECT window_start, event_id, engagements FROM w QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY engagements DESC, event_id) = 1
""",
    shapes="signals",
    times="window_start",
)
def top_post(spark, sf):
    best = F.max(F.struct("engagements", (-F.col("event_id")).alias("minus_id"))).alias("p")
    top = X.sliding(_signals(spark, sf), "28 days", "7 days", [], [best], "1 day", origin="4 days")
    top = top.select("window_start", (-F.col("p.minus_id")).alias("event_id"), F.col("p.engagements").alias("engagements"))
    return X.drain_updates(top, *X.fresh_paths(spark, "top"), ["window_start"])


@query(
    "stream_exchanges",
    """
WITH m AS (SELECT *, CASE WHEN date - lag(date) OVER w < 30 THEN 0 ELSE 1 END AS o FROM touches WINDOW w AS (PARTITION BY contact_id ORDER BY date, touch_id)),
n AS (SELECT *, sum(o) OVER (PARTITION BY contact_id ORDER BY date, touch_id) AS s FROM m)
SELECT contact_id, CAST(min(date) AS TIMESTAMP) AS opened, count(*) AS touches FROM n GROUP BY contact_id, s
HAVING max(date) + 30 <= (SELECT max(date) - 1 FROM touches)
""",
    shapes="touches",
    times="opened",
)
def exchanges(spark, sf):
    return X.drain_append(X.exchanges(_touches(spark, sf), 30, "1 day"), *X.fresh_paths(spark, "exchanges"))


@query(
    "stream_grades",
    "SELECT run_id, assertion_id, passed, evidence FROM expectations",
    shapes="expectations",
)
def grades(spark, sf):
    docs = _stream(spark, sf, "documents")
    runs = S.runs_of(docs)
    out = X.grade_stream(runs, S.assertions(spark), *X.fresh_paths(spark, "grades"), prior=lambda: S.priors(spark, sf))
    return out.select("run_id", "assertion_id", "passed", "evidence")


@query(
    "stream_dedup",
    "SELECT account AS post_id, CAST(ts AS DATE) AS scraped_on, count(*) AS copies_seen FROM (SELECT DISTINCT account, CAST(ts AS DATE) AS ts FROM signals) GROUP BY 1, 2",
    shapes="signals",
    dates="scraped_on",
)
def dedup(spark, sf):
    posts = _signals(spark, sf).selectExpr("account AS post_id", "CAST(ts AS DATE) AS scraped_on", "ts")
    once = X.dedup(posts, ["post_id", "scraped_on"], "7 days").select("post_id", "scraped_on")
    back = X.drain_append(once, *X.fresh_paths(spark, "dedup"))
    return back.groupBy("post_id", "scraped_on").agg(F.count(F.lit(1)).alias("copies_seen"))


@query(
    "stream_alert_timers",
    """
WITH m AS (SELECT *, CASE WHEN date - lag(date) OVER w < 90 THEN 0 ELSE 1 END AS o FROM touches WINDOW w AS (PARTITION BY contact_id ORDER BY date, touch_id)),
n AS (SELECT *, sum(o) OVER (PARTITION BY contact_id ORDER BY date, touch_id) AS s FROM m)
SELECT contact_id, CAST(min(date) AS TIMESTAMP) AS began, CAST(max(date) + 90 AS TIMESTAMP) AS alert_at, count(*) AS touches FROM n GROUP BY contact_id, s
HAVING max(date) + 90 <= (SELECT max(date) FROM touches)
""",
    shapes="touches",
    times="began alert_at",
)
def alert_timers(spark, sf):
    """The touches land in three files in no order of dates, one for each micro-batch; alerts that a late touch makes untrue are taken back."""
    folder = scratch_path(spark, "touches")
    S.touches(spark, sf).repartition(3, F.xxhash64("touch_id")).write.parquet(folder)
    source = X.read_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=1).withColumn("ts", F.col("date").cast("timestamp"))
    alerts, _ = A.drain_alerts(source, 90, "0 seconds", *X.fresh_paths(spark, "alerts"))
    return alerts.withColumn("contact_id", F.col("contact_id").cast("bigint"))
