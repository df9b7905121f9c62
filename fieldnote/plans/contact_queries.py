"""Prospect, funder, contact and touch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.operators import contacts as C
from fieldnote.plans import shapes as S
from fieldnote.plans.registry import query
from fieldnote.plans.shapes import AS_OF

_NOW = f"DATE'{AS_OF}'"


@query(
    "list_by_status",
    "SELECT slug, org, contact, status, touch_count, coalesce(CAST(last_contact AS VARCHAR), '--') AS last_contact "
    "FROM prospects WHERE status IN ('research', 'ready', 'contacted', 'responded')",
    shapes="prospects",
)
def list_by_status(spark, sf):
    shown = C.list_by_status(S.prospects(spark, sf))
    last = F.coalesce(F.col("last_contact").cast("string"), F.lit("--")).alias("last_contact")
    return shown.select("slug", "org", "contact", "status", "touch_count", last)


@query(
    "list_funders_by_status",
    "SELECT slug, funder, status, grant_range, coalesce(deadline_raw, '--') AS deadline, angle FROM funders WHERE status = 'submitted'",
    shapes="funders",
)
def list_funders(spark, sf):
    shown = C.list_by_status(S.funders(spark, sf), "submitted", C.FUNDER_STATUSES)
    return shown.select(
        "slug", "funder", "status", "grant_range", F.coalesce("deadline_raw", F.lit("--")).alias("deadline"), "angle"
    )


@query(
    "active_prospects",
    "SELECT slug, status, contact, angle, last_contact, next_followup FROM prospects "
    "WHERE coalesce(status, '') NOT IN ('closed', 'passed')",
    shapes="prospects",
    dates="last_contact next_followup",
)
def active_prospects(spark, sf):
    return C.active_prospects(S.prospects(spark, sf)).select(
        "slug", "status", "contact", "angle", "last_contact", "next_followup"
    )


@query(
    "active_funders",
    "SELECT slug, status, funder, grant_range, deadline, next_action FROM funders "
    "WHERE coalesce(status, '') NOT IN ('declined', 'passed')",
    shapes="funders",
    dates="deadline",
)
def active_funders(spark, sf):
    return C.active_funders(S.funders(spark, sf)).select(
        "slug", "status", "funder", "grant_range", "deadline", "next_action"
    )


@query(
    "followups_due",
    f"SELECT slug, org, contact, status, next_followup, touch_count FROM prospects WHERE next_followup <= {_NOW}",
    shapes="prospects",
    dates="next_followup",
)
def followups_due(spark, sf):
    return C.followups_due(S.prospects(spark, sf), AS_OF).select(
        "slug", "org", "contact", "status", "next_followup", "touch_count"
    )


@query(
    "stale_contacted",
    "SELECT slug, org, last_contact FROM prospects WHERE status = 'contacted' AND next_followup IS NULL",
    shapes="prospects",
    dates="last_contact",
)
def stale_contacted(spark, sf):
    return C.stale_contacted(S.prospects(spark, sf)).select("slug", "org", "last_contact")


@query(
    "awaiting_response",
    "SELECT slug, org, contact, last_contact, touch_count FROM prospects WHERE status = 'contacted'",
    shapes="prospects",
    dates="last_contact",
)
def awaiting(spark, sf):
    return C.awaiting(S.prospects(spark, sf)).select("slug", "org", "contact", "last_contact", "touch_count")


@query(
    "deadlines_within",
    f"SELECT slug, funder, deadline, status, next_action FROM funders WHERE deadline <= {_NOW} + 60",
    shapes="funders",
    dates="deadline",
)
def deadlines_within(spark, sf):
    return C.deadlines_within(S.funders(spark, sf), AS_OF).select("slug", "funder", "deadline", "status", "next_action")


@query(
    "deadlines",
    "SELECT deadline_raw, funder, status, next_action FROM funders WHERE deadline_raw IS NOT NULL",
    shapes="funders",
)
def deadlines(spark, sf):
    return C.deadlines(S.funders(spark, sf)).select("deadline_raw", "funder", "status", "next_action")


@query("funders_by_angle", "SELECT funder, angle, grant_range, status FROM funders", shapes="funders")
def by_angle(spark, sf):
    return C.by_angle(S.funders(spark, sf)).select("funder", "angle", "grant_range", "status")


@query(
    "overdue_actions",
    'SELECT id, t.date AS "date", t.type AS "type", t.nextAction AS "nextAction", t.nextActionDue AS "nextActionDue" '
    f"FROM (SELECT id, unnest(touches) AS t FROM nested) WHERE t.nextActionDue < {_NOW}",
    shapes="nested",
    dates="date nextActionDue",
)
def overdue_actions(spark, sf):
    return C.overdue_actions(S.nested(spark, sf), AS_OF)


@query(
    "touches_in_quarter",
    "SELECT id, t.date AS \"date\", t.note AS note FROM (SELECT id, unnest(touches) AS t FROM nested) "
    "WHERE t.type = 'stewardship-touch' AND t.date BETWEEN DATE'2001-04-01' AND DATE'2001-06-30'",
    shapes="nested",
    dates="date",
)
def touches_in(spark, sf):
    return C.touches_in(S.nested(spark, sf), "stewardship-touch", "2001-04-01", "2001-06-30")


@query(
    "stale_items",
    f"SELECT slug, status, last_contact, CAST({_NOW} - last_contact AS BIGINT) AS idle_days FROM prospects "
    f"WHERE status IN ('research', 'ready') AND {_NOW} - last_contact > 30",
    shapes="prospects",
    dates="last_contact",
)
def stale_items(spark, sf):
    moving = F.col("status").isin("research", "ready")
    return C.stale_items(S.prospects(spark, sf), AS_OF, 30, "last_contact", moving).select(
        "slug", "status", "last_contact", "idle_days"
    )


@query(
    "silent_after_proposal",
    f"SELECT slug, last_contact, CAST({_NOW} - last_contact AS BIGINT) AS idle_days FROM prospects "
    f"WHERE status = 'contacted' AND {_NOW} - last_contact > 14",
    shapes="prospects",
    dates="last_contact",
)
def silent(spark, sf):
    return C.silent(S.prospects(spark, sf), AS_OF, 14).select("slug", "last_contact", "idle_days")


_TARGETS = [("call", "hours", 48), ("email-sent", "hours", 24), ("meeting", "day", 0), ("proposal-sent", "business_days", 3)]


@query(
    "response_time_breaches",
    """
WITH m AS (
  SELECT touch_id, type AS context, date + to_hours(touch_id % 24) AS received_at,
         date + to_hours(touch_id % 24) + to_minutes(touch_id * 37 % 9000) AS answered_at FROM touches),
d AS (SELECT *, CAST(received_at AS DATE) AS s, CAST(answered_at AS DATE) AS e FROM m),
b AS (SELECT *, CAST((SELECT count(*) FROM range(0, 8) r(i) WHERE s + CAST(i AS INTEGER) < e AND isodow(s + CAST(i AS INTEGER)) <= 5) AS BIGINT) AS business_days,
             CAST(datediff('minute', received_at, answered_at) AS BIGINT) AS waited_minutes FROM d)
SELECT touch_id, context, waited_minutes, business_days FROM b
WHERE (context = 'call' AND waited_minutes > 48 * 60) OR (context = 'email-sent' AND waited_minutes > 24 * 60)
   OR (context = 'meeting' AND e > s) OR (context = 'proposal-sent' AND business_days > 3)
""",
    shapes="touches",
)
def sla_breaches(spark, sf):
    m = S.touches(spark, sf).selectExpr(
        "touch_id",
        "type AS context",
        "CAST(date AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(touch_id % 24 AS INT)) AS received_at",
        "CAST(date AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(touch_id % 24 AS INT), CAST(touch_id * 37 % 9000 AS INT)) AS answered_at",
    )
    return C.sla_breaches(m, _TARGETS).select("touch_id", "context", "waited_minutes", "business_days")


@query(
    "list_entity",
    "SELECT slug, segment, angle FROM prospects WHERE status = 'ready' AND angle = 'media'",
    shapes="prospects",
)
def list_entity(spark, sf):
    return C.list_entity(S.prospects(spark, sf), status="ready", angle="media").select("slug", "segment", "angle")


@query(
    "new_records",
    """
WITH batch AS (SELECT 'customer' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS slug, count(*) AS orders FROM orders GROUP BY 1)
SELECT slug, orders, slug NOT IN (SELECT slug FROM prospects) AS accepted FROM batch
""",
    shapes="prospects",
)
def new_records(spark, sf):
    batch = (
        S.table(spark, sf, "orders")
        .groupBy(F.expr("'customer' || lpad(CAST(o_custkey * 2 AS STRING), 9, '0')").alias("slug"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    accepted, rejected = C.new_only(batch, S.prospects(spark, sf))
    return accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))


@query(
    "introductions",
    "SELECT regexp_extract(c.source, '^referral-from-(.+)$', 1) AS introducer, c.id AS introduced, c.created, "
    "p.status AS introducer_status FROM prospects c JOIN prospects p "
    "ON CAST(p.id AS VARCHAR) = regexp_extract(c.source, '^referral-from-(.+)$', 1)",
    shapes="prospects",
    dates="created",
)
def introductions(spark, sf):
    return C.introductions(S.prospects(spark, sf))


@query(
    "introductions_per_quarter",
    "SELECT CAST(date_trunc('quarter', c.created) AS DATE) AS quarter, count(*) AS introductions, "
    "count(DISTINCT c.source) AS introducers FROM prospects c JOIN prospects p "
    "ON CAST(p.id AS VARCHAR) = regexp_extract(c.source, '^referral-from-(.+)$', 1) GROUP BY 1",
    shapes="prospects",
    dates="quarter",
)
def intro_counts(spark, sf):
    return C.intro_counts(S.prospects(spark, sf))


@query(
    "content_project_links",
    """
WITH a AS (SELECT p_partkey AS content_id, unnest([p_partkey % 1000, p_partkey * 7 % 1000]) AS project_id FROM part),
b AS (SELECT unnest([c_custkey, c_custkey * 3 % 2000]) AS content_id, c_custkey AS project_id FROM customer)
SELECT coalesce(a.content_id, b.content_id) AS content_id, coalesce(a.project_id, b.project_id) AS project_id,
       a.content_id IS NOT NULL AS in_content, b.content_id IS NOT NULL AS in_project
FROM (SELECT DISTINCT * FROM a) a FULL JOIN (SELECT DISTINCT * FROM b) b
  ON a.content_id = b.content_id AND a.project_id = b.project_id
""",
)
def links(spark, sf):
    content = S.table(spark, sf, "part").selectExpr(
        "p_partkey AS content_id", "array(p_partkey % 1000, p_partkey * 7 % 1000) AS project_ids"
    )
    projects = S.table(spark, sf, "customer").selectExpr(
        "c_custkey AS project_id", "array(c_custkey, c_custkey * 3 % 2000) AS content_ids"
    )
    return C.links(content, projects)


@query(
    "orphans",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def orphans(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", "source")
    return C.orphans(docs, S.table(spark, sf, "labels"), "doc_id")


@query(
    "followup_cadence",
    'SELECT slug, last_contact, step, last_contact + step AS due FROM prospects, (VALUES (3), (7), (14)) AS s(step) WHERE status = \'contacted\'',
    shapes="prospects",
    dates="last_contact due",
)
def cadence(spark, sf):
    waiting = C.list_entity(S.prospects(spark, sf), status="contacted").select("slug", "last_contact")
    return C.cadence(waiting, "last_contact", [3, 7, 14])


@query(
    "retainer_cadence",
    "SELECT touch_id, date AS started, step, CAST(date + to_months(step) AS DATE) AS due "
    "FROM touches, (VALUES (1), (3), (6), (10), (12)) AS s(step) WHERE type = 'meeting'",
    shapes="touches",
    dates="started due",
)
def retainer_cadence(spark, sf):
    starts = C.list_entity(S.touches(spark, sf), type="meeting").selectExpr("touch_id", "date AS started")
    return C.cadence(starts, "started", [1, 3, 6, 10, 12], "months")


@query(
    "status_counts",
    "SELECT status, count(*) AS records, CAST(list_position(['research', 'ready', 'contacted', 'responded', 'passed', 'closed'], status) AS BIGINT) AS place "
    "FROM prospects GROUP BY status",
    shapes="prospects",
)
def status_counts(spark, sf):
    return C.status_counts(S.prospects(spark, sf))


@query(
    "stage_counts",
    """
SELECT CASE WHEN source LIKE 'referral%' THEN 'referral' ELSE source END AS source, count(*) AS contacts,
       round_even(CAST(count_if(status = 'responded') AS DOUBLE) / count(*), 4) AS paid_rate,
       round_even(CAST(count_if(status = 'passed') AS DOUBLE) / count(*), 4) AS qualify_out_rate
FROM prospects GROUP BY 1
""",
    shapes="prospects",
)
def stage_counts(spark, sf):
    p = S.prospects(spark, sf).withColumn(
        "source", F.when(F.col("source").startswith("referral"), "referral").otherwise(F.col("source"))
    )
    return C.stage_counts(p, "source", F.col("status") == "responded", F.col("status") == "passed")


@query(
    "last_touch",
    "SELECT contact_id, date, type, status, touch_id FROM touches "
    "QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY date DESC, touch_id DESC) = 1",
    shapes="touches",
    dates="date",
)
def last_touch(spark, sf):
    return C.last_touch(S.touches(spark, sf))


@query(
    "quiet_contacts",
    f"""
SELECT p.id AS contact_id, last_touch, CAST({_NOW} - last_touch AS BIGINT) AS quiet_days
FROM prospects p LEFT JOIN (SELECT contact_id, max(date) AS last_touch FROM touches GROUP BY 1) t ON t.contact_id = p.id
WHERE last_touch IS NULL OR {_NOW} - last_touch >= 90
""",
    shapes="prospects touches",
    dates="last_touch",
)
def quiet(spark, sf):
    return C.quiet(S.touches(spark, sf), AS_OF, 90, S.prospects(spark, sf))


@query(
    "replay_touches",
    """
WITH n AS (SELECT *, row_number() OVER w AS touch_number,
                  count(CASE WHEN status <> 'research' THEN 1 END) OVER w AS grp FROM touches WINDOW w AS (PARTITION BY contact_id ORDER BY date, touch_id))
SELECT touch_id, contact_id, date, status, touch_number,
       max(CASE WHEN status = 'contacted' THEN date + 3 END) OVER (PARTITION BY contact_id, grp) AS next_followup FROM n
""",
    shapes="touches",
    dates="date next_followup",
)
def replay_touches(spark, sf):
    return C.replay_touches(S.touches(spark, sf)).select(
        "touch_id", "contact_id", "date", "status", "touch_number", "next_followup"
    )


@query(
    "contact_state",
    """
SELECT contact_id, count(*) AS touch_count, max(date) AS last_contact,
       (list(status ORDER BY date DESC, touch_id DESC))[1] AS status,
       (list(CASE WHEN status = 'contacted' THEN date + 3 END ORDER BY date DESC, touch_id DESC) FILTER (status <> 'research'))[1] AS next_followup
FROM touches GROUP BY contact_id
""",
    shapes="touches",
    dates="last_contact next_followup",
)
def contact_state(spark, sf):
    return C.contact_state(S.touches(spark, sf))


@query(
    "stage_durations",
    """
WITH s AS (SELECT status, CAST(lead(date) OVER (PARTITION BY contact_id ORDER BY date, touch_id) - date AS BIGINT) AS days FROM touches)
SELECT status, count(days) AS closed_stages, count_if(days IS NULL) AS open_stages,
       CAST(sum(days) AS DOUBLE) / count(days) AS mean_days, max(days) AS longest FROM s GROUP BY status
""",
    shapes="touches",
)
def stage_durations(spark, sf):
    return C.stage_durations(S.touches(spark, sf))


@query(
    "asof_touch",
    """
WITH e AS (SELECT * FROM touches WHERE type = 'proposal-sent'), t AS (SELECT * FROM touches WHERE type <> 'proposal-sent')
SELECT e.contact_id, e.touch_id AS event_id, e.date AS event_date, b.touch_id, b.date AS touch_date, CAST(e.date - b.date AS BIGINT) AS latency_days
FROM e LEFT JOIN LATERAL (SELECT t.touch_id, t.date FROM t WHERE t.contact_id = e.contact_id AND t.date <= e.date
                          ORDER BY t.date DESC, t.touch_id DESC LIMIT 1) b ON true
""",
    shapes="touches",
    dates="event_date touch_date",
)
def asof_touch(spark, sf):
    t = S.touches(spark, sf)
    sent = F.col("type") == "proposal-sent"
    return C.asof_touch(t.filter(sent), t.filter(~sent))


@query(
    "exchanges",
    """
WITH m AS (SELECT *, CASE WHEN date - lag(date) OVER w < 30 THEN 0 ELSE 1 END AS o FROM touches WINDOW w AS (PARTITION BY contact_id ORDER BY date, touch_id)),
n AS (SELECT *, CAST(sum(o) OVER (PARTITION BY contact_id ORDER BY date, touch_id) AS BIGINT) AS exchange FROM m)
SELECT contact_id, exchange, min(date) AS opened, max(date) AS last_touch, count(*) AS touches FROM n GROUP BY 1, 2
""",
    shapes="touches",
    dates="opened last_touch",
)
def exchanges(spark, sf):
    return C.exchanges(S.touches(spark, sf), 30)


@query(
    "top_prospects",
    f"SELECT slug, next_followup, touch_count FROM prospects WHERE next_followup <= {_NOW} ORDER BY next_followup, slug LIMIT 5",
    shapes="prospects",
    dates="next_followup",
)
def top_prospects(spark, sf):
    due = C.followups_due(S.prospects(spark, sf), AS_OF)
    return C.top_k(due, 5, F.col("next_followup"), F.col("slug")).select("slug", "next_followup", "touch_count")
