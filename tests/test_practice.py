"""Contacts, finance, survey, signals, pairs and governance on inline rows."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldnote.functions.stats import band
from fieldnote.operators import contacts as C
from fieldnote.operators import finance as M
from fieldnote.operators import governance as Q
from fieldnote.operators import pairs as P
from fieldnote.operators import signals as S
from fieldnote.operators import snapshots as N
from fieldnote.operators import survey as V
from fieldnote.session import local_table


def dated(spark, data, schema, *dates):
    df = spark.createDataFrame(data, schema)
    return df.withColumns({d: F.col(d).cast("date") for d in dates})


# --- contacts ---------------------------------------------------------------------------
TOUCHES = [
    ("a", 1, "2024-01-01", "contacted", "call"), ("a", 2, "2024-01-03", "research", "call"),
    ("a", 3, "2024-06-01", "responded", "call"), ("a", 4, "2025-01-01", "ready", "call"),
    ("b", 5, "2024-01-01", "research", "call"), ("b", 6, "2024-01-01", "contacted", "call"),
]


@pytest.fixture(scope="module")
def touches(spark):
    return dated(spark, TOUCHES, "contact_id string, touch_id int, date string, status string, type string", "date")


def test_replay_keeps_followup_unless_told(touches):
    got = C.replay_touches(touches).selectExpr("touch_id", "touch_number", "CAST(next_followup AS STRING)")
    assert rows(got) == [(1, 1, "2024-01-04"), (2, 2, "2024-01-04"), (3, 3, None), (4, 4, None), (5, 1, None), (6, 2, "2024-01-04")]


def test_state_is_the_last_replayed_row(touches):
    got = C.contact_state(touches).selectExpr("contact_id", "touch_count", "status", "CAST(next_followup AS STRING)")
    assert rows(got) == [("a", 4, "ready", None), ("b", 2, "contacted", "2024-01-04")]


def test_status_counts_sum_to_rows(spark):
    df = spark.createDataFrame([("ready",), ("ready",), ("closed",), ("nonsense",)], "status string")
    got = C.status_counts(df).collect()
    assert [(r.status, r.records) for r in got] == [("ready", 2), ("closed", 1)]


def test_due_boundary_and_null_status(spark):
    df = dated(spark, [("a", None, "2024-05-05"), ("b", "ready", "2024-05-06"), ("c", "passed", None)], "slug string, status string, next_followup string", "next_followup")
    assert [r.slug for r in C.followups_due(df, "2024-05-05").collect()] == ["a"]
    assert [r.slug for r in C.active_prospects(df).collect()] == ["a", "b"]


def test_quiet_reports_never_touched(spark, touches):
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = C.quiet(touches, "2024-03-31", 90, people).select("contact_id", "quiet_days")
    assert rows(got) == [("b", 90), ("c", None)]


def test_asof_takes_same_day_touch(spark, touches):
    ev = dated(spark, [("a", 90, "2024-01-03"), ("a", 91, "2023-12-31"), ("z", 92, "2024-01-01")], "contact_id string, touch_id int, date string", "date")
    got = C.asof_touch(ev, touches).select("event_id", "touch_id", "latency_days")
    assert rows(got) == [(90, 2, 0), (91, None, None), (92, None, None)]


def test_exchanges(touches):
    got = C.exchanges(touches, 30).select("contact_id", "exchange", "touches")
    assert rows(got) == [("a", 1, 2), ("a", 2, 1), ("a", 3, 1), ("b", 1, 2)]


def test_sla_business_days(spark):
    data = [("proposal", "2024-05-03 10:00", "2024-05-08 09:00"), ("proposal", "2024-05-03 10:00", "2024-05-09 09:00"),
            ("urgent", "2024-05-03 23:00", "2024-05-04 00:10"), ("client", "2024-05-03 10:00", "2024-05-04 10:01")]
    df = spark.createDataFrame(data, "context string, received_at string, answered_at string").withColumns(
        {c: F.col(c).cast("timestamp") for c in ("received_at", "answered_at")}
    )
    got = C.sla_breaches(df, [("proposal", "business_days", 3), ("urgent", "day", 0), ("client", "hours", 24)])
    assert rows(got.select("context", "business_days")) == [("client", 1), ("proposal", 4), ("urgent", 1)]


def test_links_show_one_sided(spark):
    content = spark.createDataFrame([("c1", ["p1", "p1"])], "content_id string, project_ids array<string>")
    projects = spark.createDataFrame([("p1", ["c1", "c2"])], "project_id string, content_ids array<string>")
    assert rows(C.links(content, projects)) == [("c1", "p1", True, True), ("c2", "p1", False, True)]


# --- finance ----------------------------------------------------------------------------
LEDGER = "date string, kind string, scope string, category string, amount decimal(18,2), tier int, client string"


def test_burn_of_the_worked_month(spark):
    data = [("2024-03-02", "income", "business", "fees", D(6800), 1, "c"), ("2024-03-05", "expense", "business", "software", D(180), 1, "c"),
            ("2024-03-06", "expense", "business", "meals", D(85), 1, "c"), ("2024-03-07", "expense", "business", "software", D(75), 1, "c"),
            ("2024-03-08", "income", "personal", "draw", D(2900), 1, "c"), ("2024-03-09", "expense", "personal", "rent", D(1800), 1, "c"),
            ("2024-03-10", "expense", "personal", "food", D(620), 1, "c"), ("2024-03-11", "expense", "personal", "misc", D(480), 1, "c")]
    df = dated(spark, data, LEDGER, "date")
    r = M.burn(df, "800").first()
    assert (r.business_net, r.personal_net, r.savings_hit) == (D(6460), D(0), False)


def test_pace_of_the_worked_quarter(spark):
    df = dated(spark, [("2024-04-04", "income", "business", "fees", D(4500), 1, "c")], LEDGER, "date")
    r = M.pace(df, "35000", "2024-04-01", "2024-04-05", "2024-06-30", "client").first()
    assert (r.progress_pct, r.remaining, r.weeks_left) == (12.9, D(30500), 13)


def test_budget_and_running_total(spark):
    lines = spark.createDataFrame([("p", i, D(h), D(150), D(0)) for i, h in enumerate([25, 22, 203])], "project string, line int, hours decimal(18,2), rate decimal(5,0), travel decimal(5,0)")
    total = M.budget(lines).filter("level = 3").first()
    assert (total.hours, total.cost) == (D(250), D(37500))
    cost = lines.withColumn("cost", F.col("hours") * F.col("rate"))
    got = M.running_total(cost, ["project"], ["line"], "cost", F.col("line"))
    assert [int(r.running_total) for r in got.orderBy("line").collect()] == [3750, 7050, 37500]


def test_project_ids_pad_and_grow(spark):
    df = spark.range(1200).selectExpr("id", "date_add(DATE'2024-01-01', CAST(id % 300 AS INT)) AS d")
    got = M.assign_project_id(df, "d", "id", "PRJ")
    assert got.select("project_id").distinct().count() == 1200
    ids = {r.project_id for r in got.filter("id IN (0, 1199)").collect()}
    assert "PRJ-2024-001" in ids and "PRJ-2024-1200" in ids


def test_buffer_sees_a_long_earlier_project(spark):
    data = [("c", 1, "2024-01-01", "2024-03-01"), ("c", 2, "2024-01-05", "2024-01-10"), ("c", 3, "2024-02-20", "2024-02-25"), ("c", 4, "2024-03-08", "2024-03-09")]
    df = dated(spark, data, "client string, project int, started string, ended string", "started", "ended")
    assert rows(M.buffer_conflicts(df, 7).select("project", "gap_days")) == [(2, -56), (3, -10)]


def test_quote(spark):
    lines = spark.createDataFrame([("p", D(2), D(1000), True, False, 50), ("p", D(1), D(501), True, False, 50)], "proposal string, quantity decimal(18,2), rate decimal(6,0), rush boolean, aligned boolean, discount_pct int")
    r = M.quote(lines).first()
    assert (r.gross, r.granted_pct, r.total, r.deposit, r.balance) == (D("3001.20"), 20, D("2400.96"), D("1200.48"), D("1200.48"))


def test_tier_sequence(spark):
    data = [("a", 2, "completed", "2024-01-01", "2024-02-01"), ("a", 3, "active", "2024-03-01", "2024-04-01"),
            ("b", 1, "completed", "2024-01-01", "2024-02-01"), ("b", 3, "active", "2024-03-01", "2024-04-01"),
            ("c", 2, "active", "2024-01-01", "2024-02-01"), ("c", 3, "active", "2024-03-01", "2024-04-01")]
    df = dated(spark, data, "client string, tier int, status string, started string, ended string", "started", "ended")
    assert rows(M.tier_sequence(df).select("client", "skipped")) == [("b", True), ("c", False)]


def test_triage_order_of_rules(spark):
    qs, ys = [f"q{i}" for i in range(6)], [f"y{i}" for i in range(3)]
    data = [(1, 5, 6, 0), (2, 6, 6, 3), (3, 6, 5, 2), (4, 6, 4, 0), (5, 6, 2, 0)]
    cols = [(i, e, *[n < yes for n in range(6)], *[n < yel for n in range(3)]) for i, e, yes, yel in data]
    df = spark.createDataFrame(cols, ["id", "energy", *qs, *ys])
    assert [r.decision for r in M.triage(df, qs, ys).orderBy("id").collect()] == ["no new commitments", "defer", "take", "conditions", "decline"]


def test_aging_edges(spark):
    data = [("c", D(1), "2024-05-31", False), ("c", D(2), "2024-05-17", False), ("c", D(4), "2024-05-16", False),
            ("c", D(8), "2024-05-01", False), ("c", D(16), "2024-01-01", False), ("c", D(32), "2024-01-01", True)]
    df = dated(spark, data, "client string, amount decimal(18,2), due_on string, paid boolean", "due_on")
    r = M.aging(df, "2024-05-31").first()
    assert [int(x) for x in r[1:]] == [1, 2, 4, 8, 16]


def test_band_is_half_open(spark):
    bands = [(5, "mid"), (7, "strong"), (9, "top")]
    df = spark.createDataFrame([(4.9,), (5.0,), (8.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(band(F.col("x"), bands)).collect()] == [None, "mid", "strong", "top", None]


# --- survey -----------------------------------------------------------------------------
def test_variance_and_consistency(spark):
    df = spark.createDataFrame([("p", "staff", "q1", 4), ("p", "staff", "q2", 6), ("p", "board", "q1", 9), ("r", "staff", "q1", 7)], "project string, stakeholder string, question string, score int")
    assert rows(V.stakeholder_variance(df)) == [("p", 2, 8.0, 4.0), ("r", 1, None, 0.0)]
    assert rows(V.consistency(df)) == [("board", 9.0, None, None, 9.0), ("staff", 5.5, 6.0, None, 5.6667)]


def test_cooccurrence_from_sets(spark):
    data = [("c", 1, 1, "x"), ("c", 1, 1, "y"), ("c", 1, 1, "x"), ("c", 1, 2, "y"), ("c", 1, 2, "x"), ("c", 1, 2, "z")]
    df = spark.createDataFrame(data, "client string, session int, segment int, code string")
    assert rows(V.code_cooccurrence(df)) == [("x", "y", 2), ("x", "z", 1), ("y", "z", 1)]


def test_fear_arc(spark):
    data = [("a", "fear-surface", 1), ("a", "fear-root", 3), ("a", "fear-surface", 9), ("b", "fear-root", 1), ("b", "fear-surface", 2)]
    df = spark.createDataFrame(data, "client string, code string, pos int")
    assert rows(V.fear_arc(df).select("client", "furthest", "in_order")) == [("a", 3, True), ("b", 3, False)]


def test_outstanding(spark):
    a = spark.createDataFrame([("k1", "e1"), ("k1", "e2")], "kit string, engagement string")
    b = spark.createDataFrame([("k1", "e1")], "kit string, engagement string")
    assert rows(V.outstanding(a, b)) == [("k1", "e2")]


# --- signals ----------------------------------------------------------------------------
def test_streak_needs_more_than_three(spark):
    feels = "hhhnhhhhn"
    df = spark.createDataFrame([("a", i, f"2024-01-0{1 + i // 3} 00:00:0{i}", f) for i, f in enumerate(feels)], "account string, event_id int, ts string, feel string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.length for r in S.streaks(df, "h", 4).collect()] == [4]


def test_vs_own_avg(spark):
    df = spark.createDataFrame([("a", i, f"2024-01-0{i}", n) for i, n in enumerate([10, 20, 45, 46], 1)], "account string, event_id int, ts string, engagements int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(S.vs_own_avg(df, 3.0).select("event_id", "multiple")) == [(3, 3.0)]


def test_topic_window_counts_each_account_once(spark):
    df = spark.createDataFrame([("t", "a", "2024-01-01"), ("t", "a", "2024-01-02"), ("t", "b", "2024-01-02")], "topic string, account string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.topic_trend(df, 2).selectExpr("CAST(window_start AS STRING)", "accounts", "signals")
    assert rows(got) == [("2023-12-31", 1, 1), ("2024-01-01", 2, 3), ("2024-01-02", 2, 2)]


# --- pairs ------------------------------------------------------------------------------
def test_pairs_schedule_and_untested(spark):
    nodes = spark.range(19).selectExpr("concat('n', id) AS node")
    pairs = P.all_pairs(nodes, "node").cache()
    assert pairs.distinct().count() == 171 and pairs.filter("a >= b").count() == 0
    plan = P.schedule(pairs, 42, 8)
    sizes = sorted(r["count"] for r in plan.groupBy("batch").count().collect())
    assert sizes == [3] + [8] * 21
    again = P.schedule(pairs.repartition(7), 42, 8)
    assert plan.exceptAll(again).count() == 0
    done = pairs.limit(15).selectExpr("b AS a", "a AS b", "1 AS score_a", "2 AS score_b")
    left = P.untested(pairs, done)
    assert left.count() == 156


def test_one_node_has_no_pairs(spark):
    assert P.all_pairs(spark.range(1).selectExpr("id AS node"), "node").count() == 0


def test_reach_ends_in_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 1, "x"), (2, 4, "y"), (4, 5, "x")], "src bigint, dst bigint, type string")
    root = spark.createDataFrame([(1,)], "node bigint")
    assert rows(P.reach(edges, root).select("node", "depth")) == [(1, 0), (2, 1), (3, 2), (4, 2), (5, 3)]
    assert rows(P.reach(edges, root, ["x"]).select("node", "depth")) == [(1, 0), (2, 1), (3, 2)]


def test_lineage_both_ways(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "parent string, child string")
    assert rows(P.lineage(edges, "a")) == [("a", 0), ("c", 1), ("d", 2)]
    assert rows(P.lineage(edges, "d", "ancestors")) == [("a", 2), ("b", 2), ("c", 1), ("d", 0)]


def test_arms(spark):
    cols = "a string, b string, lead double"
    x = spark.createDataFrame([("a", "b", 2.0), ("a", "c", -1.0), ("b", "c", 1.0)], cols)
    y = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0)], cols)
    assert rows(P.convergent(x, y).select("a", "b")) == [("a", "b")]
    assert rows(P.divergent(x, y, 1.0).select("a", "b", "difference")) == [("a", "c", 2.0)]
    assert rows(P.emergent(x, y)) == [("b", "c")]


def test_quota(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'warm' WHEN id % 10 = 8 THEN 'cold' ELSE 'past' END AS kind")
    got = P.quota_sample(df, {"warm": 0.6, "cold": 0.3, "past": 0.1}, 10, "kind", "id")
    assert rows(got.groupBy("kind").count()) == [("cold", 3), ("past", 1), ("warm", 6)]
    assert P.quota_sample(df, {"warm": 0.6, "cold": 0.3, "past": 0.1}, 14, "kind", "id").count() == 14


# --- governance -------------------------------------------------------------------------


def test_secret_families(spark):
    secrets = ["sk-ant-" + "abc_1-x", "sk-" + "a" * 40, "apify_api_" + "Zz9", "AKIA" + "A" * 16, "gho_" + "b" * 24, "-----BEGIN RSA " + "PRIVATE KEY-----", "DB_PASSWORD = hunter2"]
    texts = [(i, f"before {s} after") for i, s in enumerate(secrets)] + [(90, "token=your-token"), (91, "nothing, a task-list")]
    got = Q.secret_hits(spark.createDataFrame(texts, "id int, text string"), "id")
    assert [(r.id, r.family) for r in got.orderBy("id").collect()] == list(enumerate(Q.SECRET_PATTERNS))


def test_sanitize_policy(spark):
    c = spark.createDataFrame([(1, "e", "p", "n", "keep")], "id int, email string, phone string, notes string, status string")
    assert Q.sanitize(c, "contacts", "any").columns == ["id", "status"]
    p = spark.createDataFrame([(1, 2, 3)], "id int, contractValue int, hoursLogged int")
    assert Q.sanitize(p, "projects", "other").columns == ["id"]
    assert Q.sanitize(p, "projects", Q.METRICS).columns == p.columns
    assert Q.sanitize(p, "financials", Q.METRICS).columns == p.columns
    with pytest.raises(PermissionError):
        Q.sanitize(p, "financials", "other")


def test_breaches_and_transitions(spark, touches):
    old = touches.select("touch_id", "status")
    new = old.filter("touch_id <> 1").withColumn("status", F.when(F.col("touch_id") == 2, "x").otherwise(F.col("status")))
    assert rows(Q.append_only_breaches(old, new, "touch_id")) == [(1, "removed"), (2, "changed")]
    assert Q.append_only_breaches(old, old, "touch_id").count() == 0
    got = Q.bad_transitions(touches, [("contacted", "research"), ("research", "contacted")])
    assert rows(got.select("touch_id", "from_status")) == [(3, "research"), (4, "responded")]


def test_validate_null_is_broken(spark):
    df = spark.createDataFrame([(1, "call"), (2, None), (3, "fax")], "id int, type string")
    assert rows(Q.validate(df, {"type": Q.one_of("type", Q.TOUCH_TYPES)}, "id")) == [(2, "type"), (3, "type")]


def test_snapshot_diff_ignores_the_sync_date(spark):
    head = "> **Canonical source:** `x` - last synced {}. Edit there.\n\nbody {}"
    old = spark.createDataFrame([("a", head.format("2024-01-01", 1)), ("b", head.format("2024-01-01", 1)), ("gone", "x")], "path string, text string")
    new = spark.createDataFrame([("a", head.format("2024-02-02", 1)), ("b", head.format("2024-02-02", 2)), ("new", "x")], "path string, text string")
    assert rows(N.snapshot_diff(old, new)) == [("a", "unchanged"), ("b", "updated"), ("gone", "missing"), ("new", "added")]
    assert rows(N.snapshot_diff(old, old).select("change").distinct()) == [("unchanged",)]


def test_local_table_types(spark):
    t = local_table(spark, [(1, "1.50", None)], "a int, b decimal(18,2), c array<string>")
    assert t.dtypes == [("a", "int"), ("b", "decimal(18,2)"), ("c", "array<string>")]
    assert t.first().b == D("1.50")


def test_response_targets_with_business_hours_and_a_lower_bound(spark):
    df = spark.createDataFrame(
        [(1, "news", "2024-01-05 12:00:00", "2024-01-08 13:00:00"), (2, "news", "2024-01-05 12:00:00", "2024-01-08 11:00:00"),
         (3, "ask", "2024-01-01 09:00:00", "2024-01-05 09:00:00"), (4, "ask", "2024-01-01 09:00:00", "2024-01-06 08:00:00")],
        "id int, context string, opened string, closed string",
    ).selectExpr("id", "context", "CAST(opened AS TIMESTAMP) AS received_at", "CAST(closed AS TIMESTAMP) AS answered_at")
    got = C.sla_breaches(df, [("news", "business_hours", 24), ("ask", "not_before_days", 5)])
    assert sorted(r.id for r in got.collect()) == [1, 3]


def test_forget_everywhere(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    notes = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "note int, person int")
    left = Q.forget_everywhere({"people": (people, "id"), "notes": (notes, "person")}, people.filter("id = 1"), "id")
    assert rows(left["people"]) == [(2, "b")] and rows(left["notes"]) == [(11, 2), (12, None)]


def test_budget_deals_lines_to_as_many_tasks_as_they_need(spark):
    """No task of the plan's only large shuffle gets more rows because the table has more; all levels are the plain rollup's."""
    lines = spark.range(0, 3000, 1, 3).selectExpr(
        "IF(id % 50 = 0, NULL, id % 97) AS project", "CAST(id % 7 AS INT) AS line", "CAST(id % 13 AS DECIMAL(18,2)) AS hours",
        "CAST(150 AS DECIMAL(5,0)) AS rate", "CAST(id % 3 AS DECIMAL(5,0)) AS travel",
    )
    found = M.budget(lines, rows_per_task=100)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() and ", 30)" in found._jdf.queryExecution().toString()
    plain = lines.rollup("project", "line").agg(
        F.sum("hours").cast("decimal(18,2)").alias("hours"),
        F.sum(F.col("hours") * F.col("rate") + F.col("travel")).cast("decimal(18,2)").alias("cost"),
        F.grouping_id().cast("bigint").alias("level"),
    )
    shown = lambda df: rows(df.select("project", "line", *[F.col(c).cast("decimal(18,2)") for c in ("hours", "cost")], "level"))
    assert shown(found) == shown(plain) and found.columns == plain.columns
