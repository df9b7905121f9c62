"""Post, signal and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.operators import signals as G
from fieldnote.plans import shapes as S
from fieldnote.plans.registry import query


@query(
    "engagement",
    "SELECT account, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS posts, "
    "round_even(CAST(sum(likes + comments) AS DOUBLE) / CAST(sum(views) AS DOUBLE), 6) AS engagement_rate FROM signals GROUP BY 1, 2",
    shapes="signals",
    dates="month",
)
def engagement(spark, sf):
    return G.engagement(S.signals(spark, sf), ["account"])


@query(
    "topic_trend",
    """
WITH w AS (SELECT topic, account, CAST(ts AS DATE) - CAST(i AS INTEGER) AS window_start FROM signals, range(0, 10) r(i))
SELECT topic, window_start, count(DISTINCT account) AS accounts, count(*) AS signals,
       count(DISTINCT account) FILTER (account IN (SELECT id FROM prospects WHERE status IN ('contacted', 'responded'))) AS prospects
FROM w GROUP BY 1, 2
""",
    shapes="signals prospects",
    dates="window_start",
)
def topic_trend(spark, sf):
    known = S.prospects(spark, sf).filter("status IN ('contacted', 'responded')").selectExpr("id AS account")
    return G.topic_trend(S.signals(spark, sf), 10, known)


@query(
    "weekly_activity",
    "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, type, count(*) AS activities FROM signals GROUP BY 1, 2",
    shapes="signals",
    dates="week",
)
def weekly_activity(spark, sf):
    return G.weekly_activity(S.signals(spark, sf))


_SOFT = ["error", "signup", "view"]
_SOFT_SQL = (
    "SELECT account, CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT kind) AS kinds FROM signals "
    "WHERE kind IN ('error', 'signup', 'view') GROUP BY 1, 2 HAVING count(DISTINCT kind) >= 2"
)


@query("soft_signals", _SOFT_SQL, shapes="signals", dates="week")
def soft_signals(spark, sf):
    return G.soft_signals(S.signals(spark, sf), _SOFT)


@query(
    "held_weeks",
    f"""
WITH w AS ({_SOFT_SQL}), r AS (SELECT *, (week - DATE'1970-01-05') // 7 - row_number() OVER (PARTITION BY account ORDER BY week) AS run FROM w)
SELECT account, min(week) AS from_week, max(week) AS to_week, count(*) AS weeks FROM r GROUP BY account, run HAVING count(*) >= 3
""",
    shapes="signals",
    dates="from_week to_week",
)
def held_weeks(spark, sf):
    return G.held_weeks(G.soft_signals(S.signals(spark, sf), _SOFT), F.col("kinds") >= 2, 3, ["account"])


@query(
    "signal_context",
    "SELECT event_id, account, kind, status AS contact_status FROM signals LEFT JOIN prospects ON id = account",
    shapes="signals prospects",
)
def signal_context(spark, sf):
    return G.signal_context(S.signals(spark, sf), S.prospects(spark, sf)).select("event_id", "account", "kind", "contact_status")


@query(
    "engaged_prospects",
    "SELECT id, slug, status FROM prospects WHERE id IN (SELECT account FROM signals WHERE kind = 'purchase')",
    shapes="signals prospects",
)
def engaged_prospects(spark, sf):
    bought = S.signals(spark, sf).filter("kind = 'purchase'")
    return G.engaged_prospects(S.prospects(spark, sf), bought).select("id", "slug", "status")


@query(
    "weekly_corr",
    """
WITH x AS (SELECT date_trunc('week', ts) AS w, count(*) AS x FROM signals WHERE feel = 'heavy' GROUP BY 1),
y AS (SELECT date_trunc('week', ts) AS w, count(*) AS y FROM signals WHERE kind = 'view' GROUP BY 1)
SELECT count(*) AS weeks, round(corr(x, y), 6) AS corr FROM x JOIN y USING (w)
""",
    shapes="signals",
)
def weekly_corr(spark, sf):
    s = S.signals(spark, sf)
    return G.weekly_corr(s.filter("feel = 'heavy'"), s.filter("kind = 'view'"))


@query(
    "streaks",
    """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS a,
                  row_number() OVER (PARTITION BY account, feel ORDER BY ts, event_id) AS b FROM signals)
SELECT account, min(ts) AS began, max(ts) AS ended, count(*) AS length FROM n WHERE feel = 'heavy' GROUP BY account, a - b HAVING count(*) >= 4
""",
    shapes="signals",
    times="began ended",
)
def streaks(spark, sf):
    return G.streaks(S.signals(spark, sf), "heavy", 4)


_FEELS = ["heavy", "neutral", "light", "flow"]


@query(
    "rolling_feel",
    "WITH d AS (SELECT kind, CAST(ts AS DATE) AS day, "
    + ", ".join(f"count_if(feel = '{f}') AS {f}" for f in _FEELS)
    + " FROM signals GROUP BY 1, 2), r AS (SELECT kind, day, "
    + ", ".join(f"CAST(sum({f}) OVER w AS BIGINT) AS {f}" for f in _FEELS)
    + " FROM d WINDOW w AS (PARTITION BY kind ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW)) SELECT kind, day, "
    + ", ".join(f"round_even(CAST({f} AS DOUBLE) / CAST(heavy + neutral + light + flow AS DOUBLE), 6) AS {f}_share" for f in _FEELS)
    + " FROM r",
    shapes="signals",
    dates="day",
)
def rolling_feel(spark, sf):
    return G.rolling_feel(S.signals(spark, sf), _FEELS)


@query(
    "top_performer",
    """
WITH w AS (SELECT event_id, account, engagements, CAST(date_trunc('week', ts) AS DATE) - CAST(i * 7 AS INTEGER) AS window_start FROM signals, range(0, 4) r(i))
SELECT window_start, event_id, account, engagements FROM w QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY engagements DESC, event_id) = 1
""",
    shapes="signals",
    dates="window_start",
)
def top_performer(spark, sf):
    return G.top_performer(S.signals(spark, sf))


@query(
    "vs_own_avg",
    """
WITH a AS (SELECT event_id, account, engagements, CAST(sum(engagements) OVER w AS DOUBLE) / count(*) OVER w AS before FROM signals
           WINDOW w AS (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, account, engagements, CASE WHEN before <> 0 THEN round_even(engagements / before, 4) END AS multiple FROM a WHERE engagements >= 1.8 * before
""",
    shapes="signals",
)
def vs_own_avg(spark, sf):
    return G.vs_own_avg(S.signals(spark, sf), 1.8).select("event_id", "account", "engagements", "multiple")


@query(
    "signal_window",
    "WITH a AS (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3600000000.0::DOUBLE) AS BIGINT) AS age_hours FROM signals) "
    "SELECT *, CASE WHEN age_hours < 72 THEN 'reaction' ELSE 'learning' END AS use FROM a",
    shapes="signals",
)
def signal_window(spark, sf):
    return G.signal_window(S.signals(spark, sf), S.EVENTS_AS_OF, 72).select("event_id", "age_hours", "use")


@query(
    "weekly_mode",
    "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, topic, count(*) AS times FROM signals GROUP BY 1, 2 "
    "QUALIFY row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, topic) = 1",
    shapes="signals",
    dates="week",
)
def weekly_mode(spark, sf):
    return G.weekly_mode(S.signals(spark, sf), "topic")
