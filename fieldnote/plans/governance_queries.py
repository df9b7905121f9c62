"""Validation, sanitising, secret, consent and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.operators import contacts as C
from fieldnote.operators import erasure as X
from fieldnote.operators import governance as Q
from fieldnote.plans import shapes as S
from fieldnote.plans.registry import query
from fieldnote.session import scratch_path, spread


@query(
    "validate_touches",
    """
SELECT touch_id, r.rule FROM touches, LATERAL (SELECT unnest([
  CASE WHEN NOT type IN ('call', 'email-sent', 'stewardship-touch', 'proposal-sent') THEN 'known type' END,
  CASE WHEN NOT date >= DATE'1995-06-01' THEN 'date in range' END,
  CASE WHEN NOT coalesce(length(nullif(note, 'order ' || (touch_id % 50))) > 0, false) THEN 'note present' END]) AS rule) r WHERE r.rule IS NOT NULL
""",
    shapes="touches",
)
def validate(spark, sf):
    t = S.touches(spark, sf).withColumn("note", F.nullif("note", F.expr("'order ' || (touch_id % 50)")))
    rules = {
        "known type": Q.one_of("type", [x for x in Q.TOUCH_TYPES if x != "meeting"]),
        "date in range": F.col("date") >= F.lit("1995-06-01").cast("date"),
        "note present": F.length("note") > 0,
    }
    return Q.validate(t, rules, "touch_id")


@query("sanitize_projects", "SELECT project AS id, status FROM projects", shapes="projects")
def sanitize(spark, sf):
    p = S.projects(spark, sf).selectExpr("project AS id", "status", "value AS contractValue", "hours AS hoursLogged")
    return Q.sanitize(p, "projects", "companion")


_FAMILIES = ", ".join(
    f"list_transform(regexp_extract_all(text, '{p}'), lambda m: {{'family': '{n}', 'secret': m}})"
    for n, p in Q.SECRET_PATTERNS.items()
)


@query(
    "secret_hits",
    f"""
WITH h AS (SELECT doc_id, unnest(flatten([{_FAMILIES}])) AS s FROM documents)
SELECT doc_id, s.family AS family, s.secret AS secret FROM h WHERE NOT regexp_matches(s.secret, '{Q.PLACEHOLDER}')
""",
)
def secret_hits(spark, sf):
    return Q.secret_hits(spread(S.table(spark, sf, "documents").select("doc_id", "text")), "doc_id")


_EDGES = [("research", "contacted"), ("contacted", "responded")]


@query(
    "bad_transitions",
    """
WITH s AS (SELECT touch_id, contact_id, status, lag(status) OVER (PARTITION BY contact_id ORDER BY date, touch_id) AS from_status FROM touches)
SELECT * FROM s WHERE from_status <> status AND NOT (from_status = 'research' AND status = 'contacted') AND NOT (from_status = 'contacted' AND status = 'responded')
""",
    shapes="touches",
)
def bad_transitions(spark, sf):
    return Q.bad_transitions(S.touches(spark, sf), _EDGES).select("touch_id", "contact_id", "status", "from_status")


@query(
    "append_only_breaches",
    """
WITH o AS (SELECT touch_id, contact_id, date, CASE WHEN touch_id % 7 = 0 THEN 'old note' ELSE note END AS note FROM touches),
n AS (SELECT touch_id, contact_id, date, note FROM touches WHERE type <> 'call')
SELECT o.touch_id, CASE WHEN n.touch_id IS NULL THEN 'removed' ELSE 'changed' END AS breach FROM o LEFT JOIN n ON n.touch_id = o.touch_id
WHERE n.touch_id IS NULL OR o.note IS DISTINCT FROM n.note
""",
    shapes="touches",
)
def append_only_breaches(spark, sf):
    t = S.touches(spark, sf)
    cols = ["touch_id", "contact_id", "date", "note"]
    note = F.when(F.col("touch_id") % 7 == 0, "old note").otherwise(F.col("note"))
    return Q.append_only_breaches(t.withColumn("note", note).select(*cols), t.filter("type <> 'call'").select(*cols), "touch_id")


@query(
    "late_log",
    "SELECT touch_id, touch_id * 37 % 4000 AS minutes_late FROM touches WHERE touch_id * 37 % 4000 > 24 * 60",
    shapes="touches",
)
def late_log(spark, sf):
    t = S.touches(spark, sf).selectExpr(
        "touch_id",
        "CAST(date AS TIMESTAMP) AS happened_at",
        "CAST(date AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, CAST(touch_id * 37 % 4000 AS INT)) AS logged_at",
    )
    return Q.late_log(t).select("touch_id", "minutes_late")


@query("releasable", "SELECT project, project % 3 + 1 AS consent_tier FROM projects WHERE project % 3 + 1 >= 3", shapes="projects")
def releasable(spark, sf):
    p = S.projects(spark, sf).select("project", (F.col("project") % 3 + 1).alias("consent_tier"))
    return Q.releasable(p, "identified")


@query(
    "expired",
    f"SELECT project, ended FROM projects WHERE ended + 90 <= DATE'{S.AS_OF}'",
    shapes="projects",
    dates="ended",
)
def expired(spark, sf):
    return Q.expired(S.projects(spark, sf).select("project", "ended"), S.AS_OF, 90, "ended")


@query(
    "anonymized",
    "SELECT sha256(CAST(client AS VARCHAR)) AS client, tier, count(*) AS projects FROM projects WHERE project % 3 + 1 >= 2 GROUP BY 1, 2",
    shapes="projects",
)
def anonymized(spark, sf):
    p = S.projects(spark, sf).withColumn("consent_tier", F.col("project") % 3 + 1).select("project", "client", "tier", "consent_tier")
    return Q.anonymized(p, ["project", "consent_tier"], "client").groupBy("client", "tier").agg(F.count(F.lit(1)).alias("projects"))


@query(
    "forget",
    "SELECT touch_id, contact_id FROM touches WHERE contact_id NOT IN (SELECT id FROM prospects WHERE status = 'passed')",
    shapes="touches prospects",
)
def forget(spark, sf):
    gone = C.list_entity(S.prospects(spark, sf), status="passed").selectExpr("id AS contact_id")
    return Q.forget(S.touches(spark, sf), gone, "contact_id").select("touch_id", "contact_id")


def _stored(spark, sf):
    """Touches by type and prospects as stored tables, and both without the prospects that passed."""
    paths = {n: scratch_path(spark, n) for n in ("touches", "prospects")}
    S.touches(spark, sf).repartitionByRange(24, "contact_id").write.partitionBy("type").parquet(paths["touches"])
    S.prospects(spark, sf).repartitionByRange(8, "id").write.parquet(paths["prospects"])
    gone = C.list_entity(S.prospects(spark, sf), status="passed").selectExpr("id")
    audit = X.erase(spark, {"touches": (paths["touches"], "contact_id"), "prospects": (paths["prospects"], "id")}, gone, "id", "request-1", scratch_path(spark, "audit"))
    return paths, audit


@query(
    "erase_stored",
    "SELECT touch_id, contact_id, type FROM touches WHERE contact_id NOT IN (SELECT id FROM prospects WHERE status = 'passed')",
    shapes="touches prospects",
)
def erase_stored(spark, sf):
    paths, _ = _stored(spark, sf)
    return spark.read.parquet(paths["touches"]).select("touch_id", "contact_id", "type")


@query(
    "erasure_audit",
    """
SELECT 'touches' AS name, count(*) AS rows_erased FROM touches WHERE contact_id IN (SELECT id FROM prospects WHERE status = 'passed')
UNION ALL SELECT 'prospects', count(*) FROM prospects WHERE status = 'passed'
""",
    shapes="touches prospects",
)
def erasure_audit(spark, sf):
    return _stored(spark, sf)[1].select("name", "rows_erased")
