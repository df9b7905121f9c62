"""Pricing, ledger, invoice, capacity and project queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.functions.stats import band
from fieldnote.operators import finance as M
from fieldnote.plans import shapes as S
from fieldnote.plans.registry import query
from fieldnote.plans.shapes import AS_OF
from fieldnote.session import local_table
from fieldnote.sources.catalog import DATED_SCHEMA, RULES, RuleBook, tiers
from fieldnote.sources.sinks import append_ledger as append
from fieldnote.session import scratch_path

_NOW = f"DATE'{AS_OF}'"
_M = "CAST({} AS DECIMAL(18,2))"
_T = "CAST({} AS DECIMAL(38,2))"


@query(
    "assign_project_id",
    """
WITH n AS (SELECT project, started, row_number() OVER (PARTITION BY year(started) ORDER BY started, project) AS n FROM projects)
SELECT project, 'PRJ-' || year(started) || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS project_id FROM n
""",
    shapes="projects",
)
def assign_project_id(spark, sf):
    return M.assign_project_id(S.projects(spark, sf), "started", "project", "PRJ").select("project", "project_id")


@query(
    "price_check",
    "SELECT project, tier, key, price, price BETWEEN floor AND ceiling AS fits FROM projects LEFT JOIN tiers USING (tier)",
    shapes="projects tiers",
)
def price_check(spark, sf):
    opps = S.projects(spark, sf).select("project", "tier", "price")
    return M.price_check(opps, tiers(spark)).select("project", "tier", "key", "price", "fits")


@query(
    "below_floor",
    "SELECT project, tier, price, floor, CASE WHEN floor IS NULL THEN 'unknown_tier' ELSE 'below_floor' END AS reason FROM projects LEFT JOIN tiers USING (tier) WHERE (floor IS NULL OR price < floor) AND NOT coalesce(override, false)",
    shapes="projects tiers",
)
def below_floor(spark, sf):
    return M.below_floor(S.projects(spark, sf), tiers(spark)).select("project", "tier", "price", "floor", "reason")


@query(
    "disqualified",
    "SELECT project, tier, price, CASE WHEN floor IS NULL THEN 'unknown_tier' ELSE 'low_budget' END AS reason FROM projects LEFT JOIN tiers USING (tier) WHERE (floor IS NULL OR price < floor * 0.7) AND NOT coalesce(flexible, false)",
    shapes="projects tiers",
)
def disqualified(spark, sf):
    return M.disqualified(S.projects(spark, sf), tiers(spark)).select("project", "tier", "price", "reason")


@query(
    "segment_match",
    "SELECT project, segment FROM projects WHERE segment IN (SELECT segment FROM tiers) OR coalesce(override, false)",
    shapes="projects tiers",
)
def segment_match(spark, sf):
    return M.segment_match(S.projects(spark, sf), tiers(spark)).select("project", "segment")


@query(
    "expense_flags",
    "SELECT project, line, date, amount, logged_on - date > 7 AS logged_late, amount > 25 AND receipt IS NULL AS no_receipt FROM ledger "
    "WHERE kind = 'expense' AND (logged_on - date > 7 OR (amount > 25 AND receipt IS NULL))",
    shapes="ledger",
    dates="date",
)
def expense_flags(spark, sf):
    return M.expense_flags(S.ledger(spark, sf)).select("project", "line", "date", "amount", "logged_late", "no_receipt")


@query(
    "buffer_conflicts",
    """
WITH s AS (SELECT project, client, started, max(ended) OVER (PARTITION BY client ORDER BY started, project ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM projects)
SELECT project, client, busy_until, CAST(started - busy_until AS BIGINT) AS gap_days FROM s WHERE started - busy_until < 7
""",
    shapes="projects",
    dates="busy_until",
)
def buffer_conflicts(spark, sf):
    return M.buffer_conflicts(S.projects(spark, sf)).select("project", "client", "busy_until", "gap_days")


@query(
    "pause_breaches",
    """
WITH s AS (SELECT project, max(CASE WHEN line <= 2 THEN date END) AS filmed, min(CASE WHEN line > 2 THEN date END) AS edited FROM ledger GROUP BY project)
SELECT project, filmed, edited, CAST(edited - filmed AS BIGINT) AS pause FROM s WHERE edited - filmed < 5
""",
    shapes="ledger",
    dates="filmed edited",
)
def pause_breaches(spark, sf):
    stage = F.when(F.col("line") <= 2, "film").when(F.col("line") <= 5, "edit").otherwise("deliver")
    return M.pause_breaches(S.ledger(spark, sf).withColumn("stage", stage))


@query(
    "repeat_rate",
    f"""
WITH c AS (SELECT client, count(*) AS n, min(tier) AS first_tier FROM projects GROUP BY 1),
p AS (SELECT client, sum(amount) AS paid FROM ledger GROUP BY 1)
SELECT first_tier, count(*) AS clients, count_if(n > 1) AS repeat_clients, round_even(CAST(count_if(n > 1) AS DOUBLE) / count(*), 4) AS repeat_rate,
       {_M.format("coalesce(sum(paid) FILTER (n > 1), 0)")} AS repeat_paid
FROM c LEFT JOIN p USING (client) GROUP BY first_tier
""",
    shapes="projects ledger",
)
def repeat_rate(spark, sf):
    return M.repeat_rate(S.projects(spark, sf), S.ledger(spark, sf))


@query(
    "tier_sequence",
    """
SELECT p.project, p.client, EXISTS (SELECT 1 FROM projects l WHERE l.client = p.client AND l.tier = 1 AND l.started < p.started) AS skipped
FROM projects p WHERE tier = 3 AND NOT EXISTS (SELECT 1 FROM projects d WHERE d.client = p.client AND d.tier = 2 AND d.status = 'completed' AND d.ended <= p.started)
""",
    shapes="projects",
)
def tier_sequence(spark, sf):
    return M.tier_sequence(S.projects(spark, sf)).select("project", "client", "skipped")


_FIT = [f"f{i}" for i in range(1, 7)]


@query(
    "go_no_go",
    """
WITH o AS (SELECT p_partkey AS opp, p_size % 4 AS org, p_size % 6 AS f1, p_partkey % 6 AS f2, p_partkey % 5 AS f3, p_size % 5 AS f4, p_partkey % 4 AS f5, p_size % 3 AS f6 FROM part),
d AS (SELECT s_nationkey % 4 AS org, CASE s_suppkey % 3 WHEN 0 THEN 'statement' WHEN 1 THEN 'cases' ELSE 'tax-form' END AS deliverable FROM supplier
      WHERE NOT (s_nationkey % 4 = 1 AND s_suppkey % 3 = 2)),
r AS (SELECT org, count(DISTINCT deliverable) AS n FROM d GROUP BY 1)
SELECT opp, CAST(f1 + f2 + f3 + f4 + f5 + f6 AS DOUBLE) AS fit,
       CASE WHEN f1 + f2 + f3 + f4 + f5 + f6 >= 14 AND coalesce(n, 0) = 3 THEN 'GO' WHEN f1 + f2 + f3 + f4 + f5 + f6 >= 9 THEN 'MAYBE' ELSE 'NO-GO' END AS verdict
FROM o LEFT JOIN r USING (org)
""",
)
def go_no_go(spark, sf):
    opps = S.table(spark, sf, "part").selectExpr(
        "p_partkey AS opp", "p_size % 4 AS org", "p_size % 6 AS f1", "p_partkey % 6 AS f2",
        "p_partkey % 5 AS f3", "p_size % 5 AS f4", "p_partkey % 4 AS f5", "p_size % 3 AS f6",
    )
    delivered = S.table(spark, sf, "supplier").selectExpr(
        "s_nationkey % 4 AS org",
        "CASE s_suppkey % 3 WHEN 0 THEN 'statement' WHEN 1 THEN 'cases' ELSE 'tax-form' END AS deliverable",
    ).filter("NOT (org = 1 AND deliverable = 'tax-form')")
    return M.go_no_go(opps, _FIT, 14, 9, delivered, ["statement", "cases", "tax-form"]).select("opp", "fit", "verdict")


_KPI = """
SELECT CAST(date_trunc('month', started) AS DATE) AS month, count(*) AS sent, count_if(status <> 'proposed') AS accepted,
       round_even(CAST(count_if(status <> 'proposed') AS DOUBLE) / count(*), 4) AS conversion, count(DISTINCT client) AS clients,
       round_even(CAST(sum(value) FILTER (status <> 'proposed') AS DOUBLE) / count_if(status <> 'proposed'), 2) AS mean_value,
       round_even(CAST(sum(value) FILTER (status <> 'proposed') AS DOUBLE) / CAST(sum(hours) FILTER (status <> 'proposed') AS DOUBLE), 2) AS hourly
FROM projects GROUP BY 1
"""


@query("practice_kpis", _KPI, shapes="projects", dates="month")
def practice_kpis(spark, sf):
    return M.practice_kpis(S.projects(spark, sf), F.trunc("started", "month"))


@query(
    "vs_target",
    f"""
WITH k AS ({_KPI}), l AS (SELECT month, 'conversion' AS kpi, conversion AS value, 0.40::DOUBLE AS target, 0.68::DOUBLE AS mature FROM k
  UNION ALL SELECT month, 'hourly', hourly, 2000, 2300 FROM k)
SELECT *, CASE WHEN value >= mature THEN 'mature' WHEN value >= target THEN 'on target' WHEN value IS NULL THEN 'no data' ELSE 'below' END AS status FROM l
""",
    shapes="projects",
    dates="month",
)
def vs_target(spark, sf):
    kpis = M.practice_kpis(S.projects(spark, sf), F.trunc("started", "month"))
    return M.vs_target(kpis, [("conversion", 0.40, 0.68), ("hourly", 2000.0, 2300.0)], "month")


@query(
    "revenue",
    f"""
WITH r AS (SELECT tier, CAST(date_trunc('quarter', date) AS DATE) AS quarter, {_T.format("sum(amount)")} AS amount,
                  CAST(grouping_id(tier, CAST(date_trunc('quarter', date) AS DATE)) AS BIGINT) AS level
           FROM ledger WHERE kind = 'income' GROUP BY ROLLUP (tier, CAST(date_trunc('quarter', date) AS DATE)))
SELECT r.tier, quarter, level, amount, CASE WHEN level = 0 THEN {_T.format("amount - CASE r.tier WHEN 1 THEN 1000000 WHEN 2 THEN 2000000 ELSE 3000000 END")} END AS over_target FROM r
""",
    shapes="ledger",
    dates="quarter",
)
def revenue(spark, sf):
    return M.revenue(S.ledger(spark, sf), [(1, "1000000"), (2, "2000000"), (3, "3000000")])


@query(
    "tax_reserve",
    f"""
WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, {_M.format("coalesce(sum(amount) FILTER (kind = 'income'), 0)")} AS received,
                  {_M.format("coalesce(sum(amount) FILTER (kind = 'expense'), 0)")} AS spent FROM ledger GROUP BY 1)
SELECT *, {_M.format("received * 0.30")} AS reserve, {_M.format("received - CAST(received * 0.30 AS DECIMAL(18,2)) - spent")} AS net FROM m
""",
    shapes="ledger",
    dates="month",
)
def reserve(spark, sf):
    return M.reserve(S.ledger(spark, sf))


@query(
    "monthly_burn",
    f"""
WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month,
  {_M.format("coalesce(sum(CASE WHEN kind = 'income' THEN amount ELSE -amount END) FILTER (scope = 'business'), 0)")} AS business_net,
  {_M.format("coalesce(sum(CASE WHEN kind = 'income' THEN amount ELSE -amount END) FILTER (scope = 'personal'), 0)")} AS personal_net FROM ledger GROUP BY 1)
SELECT *, personal_net >= 800 AS savings_hit FROM m
""",
    shapes="ledger",
    dates="month",
)
def burn(spark, sf):
    return M.burn(S.ledger(spark, sf), "800")


@query(
    "category_delta",
    f"""
SELECT CAST(date_trunc('month', date) AS DATE) AS month, category, {_M.format("sum(amount)")} AS spent,
       {_M.format("sum(amount) - CASE category WHEN 'software' THEN 50000 WHEN 'travel' THEN 75000 END")} AS delta
FROM ledger WHERE kind = 'expense' GROUP BY 1, 2
""",
    shapes="ledger",
    dates="month",
)
def category_delta(spark, sf):
    return M.category_delta(S.ledger(spark, sf), [("software", "50000"), ("travel", "75000")])


@query(
    "target_pace",
    f"""
WITH g AS (SELECT client, {_M.format("sum(amount)")} AS received FROM ledger WHERE kind = 'income' AND date BETWEEN DATE'2000-07-01' AND DATE'2000-08-10' GROUP BY 1)
SELECT client, received, round_even(100 * CAST(received AS DOUBLE) / 350000, 1) AS progress_pct, {_M.format("greatest(350000 - received, 0)")} AS remaining,
       CAST(8 AS BIGINT) AS weeks_left, round_even(CAST(greatest(350000 - received, 0) * 100 AS DOUBLE) / 8, 0) / 100 AS needed_per_week FROM g
""",
    shapes="ledger",
)
def pace(spark, sf):
    return M.pace(S.ledger(spark, sf), "350000", "2000-07-01", "2000-08-10", "2000-09-30", "client")


def _aged(cond):
    return _M.format(f"coalesce(sum(amount) FILTER ({cond}), 0)")


@query(
    "invoice_aging",
    f"""
WITH i AS (SELECT client, value AS amount, {_NOW} - due_on AS late FROM projects WHERE NOT paid)
SELECT client, {_aged("late <= 0")} AS not_due, {_aged("late > 0 AND late < 15")} AS late, {_aged("late >= 15 AND late < 30")} AS first_followup,
       {_aged("late >= 30 AND late < 45")} AS second_followup, {_aged("late >= 45")} AS escalate FROM i GROUP BY client
""",
    shapes="projects",
)
def aging(spark, sf):
    return M.aging(S.projects(spark, sf).withColumnRenamed("value", "amount"), AS_OF)


@query(
    "discounts",
    """
WITH q AS (SELECT CAST(date_trunc('quarter', started) AS DATE) AS quarter, count(*) AS engagements,
  round_even(CAST(count_if(discount_pct > 0) AS DOUBLE) / count(*), 4) AS discount_share, count_if(value < floor) AS below_floor, count_if(floor IS NULL) AS unknown_tier
  FROM projects LEFT JOIN tiers USING (tier) GROUP BY 1)
SELECT *, discount_share > 0.16 AS alarm FROM q
""",
    shapes="projects tiers",
    dates="quarter",
)
def discounts(spark, sf):
    return M.discounts(S.projects(spark, sf), tiers(spark), 0.16)


@query(
    "capacity",
    f"""
WITH c AS (SELECT count_if(tier = 3 AND {_NOW} BETWEEN started AND ended) AS e,
  count_if(tier = 2 AND started <= DATE'2001-09-30' AND ended >= DATE'2001-07-01') AS p, count_if(tier = 1 AND date_trunc('month', started) = date_trunc('month', {_NOW})) AS s
  FROM projects WHERE status <> 'proposed')
SELECT 'embeddings' AS limit_on, e AS load, 2::BIGINT AS allowed, e > 2 AS over FROM c UNION ALL
SELECT 'programs', p, 2, p > 2 FROM c UNION ALL SELECT 'stories', s, 4, s > 4 FROM c
""",
    shapes="projects",
)
def capacity(spark, sf):
    return M.capacity(S.projects(spark, sf), {"embeddings": 2, "programs": 2, "stories": 4}, AS_OF)


_QUESTIONS = {f"q{i}": f"project % {i + 2} <> 0" for i in range(1, 7)}
_YELLOW = {f"y{i}": f"project % {i + 3} = 0" for i in range(1, 7)}


@query(
    "triage",
    "WITH s AS (SELECT project, energy, CAST("
    + " + ".join(f"CAST({e} AS INT)" for e in _QUESTIONS.values())
    + " AS BIGINT) AS yes, CAST("
    + " + ".join(f"CAST({e} AS INT)" for e in _YELLOW.values())
    + " AS BIGINT) AS yellow_flags FROM projects) SELECT project, yes, yellow_flags, CASE WHEN energy < 6 THEN 'no new commitments' "
    "WHEN yellow_flags >= 3 THEN 'defer' WHEN yes >= 5 THEN 'take' WHEN yes >= 3 THEN 'conditions' ELSE 'decline' END AS decision FROM s",
    shapes="projects",
)
def triage(spark, sf):
    answers = {**_QUESTIONS, **_YELLOW}
    opps = S.projects(spark, sf).selectExpr("project", "energy", *[f"{e} AS {n}" for n, e in answers.items()])
    return M.triage(opps, list(_QUESTIONS), list(_YELLOW)).select("project", "yes", "yellow_flags", "decision")


@query(
    "budget_lines",
    f"""
SELECT l_orderkey AS project, l_linenumber AS line, {_T.format("sum(CAST(l_quantity AS DECIMAL(18,2)))")} AS hours,
       {_T.format("sum(CAST(l_quantity AS DECIMAL(18,2)) * 150 + l_linenumber * 10)")} AS cost, CAST(grouping_id(l_orderkey, l_linenumber) AS BIGINT) AS level
FROM lineitem GROUP BY ROLLUP (l_orderkey, l_linenumber)
""",
)
def budget(spark, sf):
    lines = S.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS project",
        "l_linenumber AS line",
        "CAST(l_quantity AS DECIMAL(18,2)) AS hours",
        "CAST(150 AS DECIMAL(5,0)) AS rate",
        "CAST(l_linenumber * 10 AS DECIMAL(5,0)) AS travel",
    )
    return M.budget(lines)


@query(
    "mission_drift",
    """
WITH d AS (SELECT CAST(date_trunc('quarter', started) AS DATE) AS quarter, round_even(CAST(count_if(mission = false) AS DOUBLE) / count(mission), 4) AS share,
  round_even(CAST(sum(CASE WHEN mission = false THEN hours ELSE 0 END) AS DOUBLE) / CAST(sum(hours) AS DOUBLE), 4) AS hours_share FROM projects GROUP BY 1)
SELECT *, hours_share > 0.20 AS drift FROM d
""",
    shapes="projects",
    dates="quarter",
)
def mission_drift(spark, sf):
    quarter = F.date_trunc("quarter", "started").cast("date")
    return M.mission_drift(S.projects(spark, sf), quarter, "quarter", 0.20)


@query(
    "quote_totals",
    f"""
WITH s AS (SELECT l_orderkey AS proposal, sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_linenumber * 100 AS DECIMAL(6,0))) AS subtotal,
             max(l_returnflag = 'R') AS rush, max(l_linestatus = 'O') AS aligned, max(CAST(l_quantity AS INTEGER)) AS d FROM lineitem GROUP BY 1),
g AS (SELECT proposal, {_M.format("CASE WHEN rush THEN subtotal * 1.20 ELSE subtotal END")} AS gross, CAST(least(d, CASE WHEN aligned THEN 30 ELSE 20 END) AS INTEGER) AS granted_pct FROM s),
t AS (SELECT *, {_M.format("gross * (100 - granted_pct)::DECIMAL(5,2) * 0.01")} AS total FROM g)
SELECT *, {_M.format("total * 0.5")} AS deposit, {_M.format("total - CAST(total * 0.5 AS DECIMAL(18,2))")} AS balance FROM t
""",
)
def quote(spark, sf):
    lines = S.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS proposal",
        "CAST(l_quantity AS DECIMAL(18,2)) AS quantity",
        "CAST(l_linenumber * 100 AS DECIMAL(6,0)) AS rate",
        "l_returnflag = 'R' AS rush",
        "l_linestatus = 'O' AS aligned",
        "CAST(l_quantity AS INT) AS discount_pct",
    )
    return M.quote(lines)


@query(
    "effective_rate",
    "SELECT tier, round_even(CAST(sum(value) AS DOUBLE) / CAST(sum(hours) AS DOUBLE), 2) AS hourly, count(*) AS projects, "
    "round_even(CAST(sum(value) AS DOUBLE) / CAST(sum(hours) AS DOUBLE), 2) < 2110 AS below_floor FROM projects GROUP BY tier",
    shapes="projects",
)
def effective_rate(spark, sf):
    return M.effective_rate(S.projects(spark, sf), 2110)


@query(
    "running_total",
    f"SELECT project, client, {_M.format('sum(value) OVER (PARTITION BY client ORDER BY started, project)')} AS running_total FROM projects",
    shapes="projects",
)
def running_total(spark, sf):
    p = M.running_total(S.projects(spark, sf), ["client"], ["started", "project"], "value", F.col("started"))
    return p.select("project", "client", F.col("running_total").cast("decimal(18,2)").alias("running_total"))


@query(
    "cumulative_by_month",
    f"""
WITH m AS (SELECT client, CAST(date_trunc('month', date) AS DATE) AS month, {_M.format("sum(amount)")} AS amount FROM ledger WHERE kind = 'income' GROUP BY 1, 2)
SELECT *, {_M.format("sum(amount) OVER (PARTITION BY client ORDER BY month)")} AS running_total FROM m
""",
    shapes="ledger",
    dates="month",
)
def cumulative_by_month(spark, sf):
    return M.cumulative_by_month(S.ledger(spark, sf), "client")


@query(
    "period_change",
    f"""
WITH m AS (SELECT category, CAST(date_trunc('month', date) AS DATE) AS period, {_M.format("sum(amount)")} AS amount FROM ledger WHERE kind = 'expense' GROUP BY 1, 2),
p AS (SELECT *, lag(amount) OVER (PARTITION BY category ORDER BY period) AS b FROM m)
SELECT category, period, amount, {_M.format("amount - b")} AS change, round_even(100 * (CAST(CAST(amount - b AS DECIMAL(18,2)) AS DOUBLE) / CAST(b AS DOUBLE)), 1) AS change_pct FROM p
""",
    shapes="ledger",
    dates="period",
)
def period_change(spark, sf):
    spent = S.ledger(spark, sf).filter("kind = 'expense'")
    return M.period_change(spent, "category", F.trunc("date", "month"), F.col("amount"))


@query(
    "append_ledger",
    "SELECT strftime(date, '%Y-%m') AS month, count(*) AS entries, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM ledger GROUP BY 1",
    shapes="ledger",
)
def append_ledger(spark, sf):
    path = scratch_path(spark, "ledger")
    entries = S.ledger(spark, sf)
    append(entries.filter("kind = 'income'"), path)
    append(entries.filter("kind = 'expense'"), path)
    back = spark.read.parquet(path)
    return back.groupBy("month").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("amount").cast("decimal(18,2)").alias("amount")
    )


# Lower bounds of the score bands.
READINESS = [(0, "may not be ready"), (10, "significant work"), (15, "moderate"), (20, "high")]
CONSISTENCY = [(1, "incoherent"), (3, "low"), (5, "moderate"), (7, "strong"), (9, "exceptional")]
ILLNESS = [(1, "minor"), (3, "moderate"), (8, "significant"), (22, "serious")]
DEADLINE = [(0, "within 2 weeks"), (15, "2 to 6 weeks"), (43, "later")]
ENERGY = [(1, "low"), (6, "steady"), (8, "high")]


def _case(expr, bands):
    return "CASE " + " ".join(f"WHEN {expr} >= {lo} THEN '{n}'" for lo, n in sorted(bands, reverse=True)) + " END"


@query(
    "score_bands",
    f"SELECT project, {_case('project % 26', READINESS)} AS readiness, {_case('(project % 19 + 2) / 2.0', CONSISTENCY)} AS consistency, "
    f"{_case('project % 40', ILLNESS)} AS illness, {_case('project % 90 - 5', DEADLINE)} AS deadline, {_case('energy', ENERGY)} AS energy FROM projects",
    shapes="projects",
)
def score_bands(spark, sf):
    p = F.col("project")
    return S.projects(spark, sf).select(
        "project",
        band(p % 26, READINESS).alias("readiness"),
        band((p % 19 + 2) / 2.0, CONSISTENCY).alias("consistency"),
        band(p % 40, ILLNESS).alias("illness"),
        band(p % 90 - 5, DEADLINE).alias("deadline"),
        band(F.col("energy"), ENERGY).alias("energy"),
    )


# Rules that change on a day, as rows.
_CHANGES = [
    ("reserve_rate", "0.35", "1997-03-15"), ("floor_tolerance", "0.85", "1997-01-01"), ("pause_days", "9", "1996-06-01"),
    ("pause_days", "3", "1998-01-01"), ("hourly_floor", "2110", "1996-01-01"), ("hourly_floor", "2200", "1998-07-01"),
]
_BOOK_SQL = (
    "b(rule, amount, valid_from) AS (SELECT rule, CAST(amount AS DECIMAL(18,4)), CAST(day AS DATE) FROM (VALUES "
    + ", ".join(f"('{r}', '{a}', '{d}')" for r, a, d in [*[(r, a, "0001-01-01") for r, a in RULES], *_CHANGES])
    + ") AS v(rule, amount, day))"
)


def _in_force(rule: str, on: str) -> str:
    return f"(SELECT arg_max(b.amount, b.valid_from) FROM b WHERE b.rule = '{rule}' AND b.valid_from <= {on})"


def _book(spark):
    rows = [*[(r, a, None) for r, a in RULES], *_CHANGES]
    return RuleBook.of(local_table(spark, rows, DATED_SCHEMA))


@query(
    "dated_disqualified",
    f"""
WITH {_BOOK_SQL}
SELECT project, tier, price, CASE WHEN floor IS NULL THEN 'unknown_tier' ELSE 'low_budget' END AS reason FROM projects p LEFT JOIN tiers USING (tier)
WHERE (floor IS NULL OR price < floor * {_in_force("floor_tolerance", "p.started")}) AND NOT coalesce(flexible, false)
""",
    shapes="projects tiers",
)
def dated_disqualified(spark, sf):
    tolerance = _book(spark).amount("floor_tolerance", F.col("started"))
    return M.disqualified(S.projects(spark, sf), tiers(spark), tolerance).select("project", "tier", "price", "reason")


@query(
    "dated_pause_breaches",
    f"""
WITH {_BOOK_SQL},
s AS (SELECT project, max(CASE WHEN line <= 2 THEN date END) AS filmed, min(CASE WHEN line > 2 THEN date END) AS edited FROM ledger GROUP BY project)
SELECT project, filmed, edited, CAST(edited - filmed AS BIGINT) AS pause FROM s WHERE edited - filmed < {_in_force("pause_days", "s.filmed")}
""",
    shapes="ledger",
    dates="filmed edited",
)
def dated_pause_breaches(spark, sf):
    stage = F.when(F.col("line") <= 2, "film").when(F.col("line") <= 5, "edit").otherwise("deliver")
    return M.pause_breaches(S.ledger(spark, sf).withColumn("stage", stage), _book(spark).amount("pause_days", F.col("filmed")))


@query(
    "dated_tax_reserve",
    f"""
WITH {_BOOK_SQL},
l AS (SELECT *, {_in_force("reserve_rate", "ledger.date")} AS rate FROM ledger),
m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, {_M.format("coalesce(sum(amount) FILTER (kind = 'income'), 0)")} AS received,
        {_M.format("coalesce(sum(amount) FILTER (kind = 'expense'), 0)")} AS spent,
        {_M.format("coalesce(sum(CAST(amount * rate AS DECIMAL(38,6))) FILTER (kind = 'income'), 0)")} AS reserve FROM l GROUP BY 1)
SELECT month, received, spent, reserve, {_M.format("received - reserve - spent")} AS net FROM m
""",
    shapes="ledger",
    dates="month",
)
def dated_reserve(spark, sf):
    return M.reserve(S.ledger(spark, sf), _book(spark).amount("reserve_rate", F.col("date")))


@query(
    "dated_effective_rate",
    f"""
WITH {_BOOK_SQL},
p AS (SELECT *, {_in_force("hourly_floor", "projects.started")} AS floor FROM projects),
r AS (SELECT tier, floor, round_even(CAST(sum(value) AS DOUBLE) / CAST(sum(hours) AS DOUBLE), 2) AS hourly, count(*) AS projects FROM p GROUP BY 1, 2)
SELECT *, hourly < floor AS below_floor FROM r
""",
    shapes="projects",
)
def dated_effective_rate(spark, sf):
    return M.effective_rate(S.projects(spark, sf), _book(spark).amount("hourly_floor", F.col("started")))
