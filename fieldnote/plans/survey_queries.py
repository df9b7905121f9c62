"""Survey, participation and coded-transcript queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.operators import survey as V
from fieldnote.plans import shapes as S
from fieldnote.plans.registry import query
from fieldnote.session import scratch_path

_MEAN = "round_even(CAST(sum({0}) AS DOUBLE) / count({0}), {1})"
_SCORE = _MEAN.format("score", 4)


def codes(spark, sf):
    return V.apply_codes(S.turns(spark, sf), S.CODES)


@query(
    "likert",
    f"SELECT coalesce(point, '*') AS point, coalesce(question, '*') AS question, {_SCORE} AS mean, count(score) AS answers FROM responses GROUP BY CUBE (point, question)",
    shapes="responses",
)
def likert(spark, sf):
    return V.likert(S.responses(spark, sf))


@query(
    "nps",
    f"WITH r AS (SELECT program, score % 11 AS score FROM responses) SELECT program, {_MEAN.format('score', 2)} AS mean_score, "
    "round_even(100 * (CAST(count_if(score >= 9) - count_if(score <= 6) AS DOUBLE) / count(score)), 1) AS net, count(score) AS answers FROM r GROUP BY program",
    shapes="responses",
)
def nps(spark, sf):
    return V.nps(S.responses(spark, sf).withColumn("score", F.col("score") % 11), "program")


@query(
    "consistency",
    "SELECT stakeholder, "
    + ", ".join(
        f"round_even(CAST(sum(score) FILTER (question = '{q}') AS DOUBLE) / count_if(question = '{q}'), 4) AS {q}" for q in ("q1", "q2", "q3")
    )
    + f", {_SCORE} AS overall FROM responses GROUP BY stakeholder",
    shapes="responses",
)
def consistency(spark, sf):
    return V.consistency(S.responses(spark, sf))


@query(
    "stakeholder_variance",
    "WITH m AS (SELECT project, stakeholder, CAST(sum(score) AS DOUBLE) / count(score) AS mean FROM responses GROUP BY 1, 2) "
    "SELECT project, count(*) AS groups, round(var_samp(mean), 6) AS variance, round(max(mean) - min(mean), 6) AS spread FROM m GROUP BY project",
    shapes="responses",
)
def stakeholder_variance(spark, sf):
    return V.stakeholder_variance(S.responses(spark, sf))


@query(
    "register_corr",
    "WITH m AS (SELECT project, CAST(sum(score) AS DOUBLE) / count(score) AS mean FROM responses GROUP BY 1) "
    "SELECT tier, round(corr(mean, CAST(value AS DOUBLE)), 6) AS corr, count(*) AS projects FROM m JOIN projects USING (project) GROUP BY tier",
    shapes="responses projects",
)
def register_corr(spark, sf):
    metrics = S.projects(spark, sf).select("project", "tier", F.col("value").cast("double").alias("metric"))
    return V.register_corr(S.responses(spark, sf), metrics, "tier")


@query(
    "readiness",
    "WITH t AS (SELECT project, CAST(sum(score % 5 + 1) AS BIGINT) AS total, count(DISTINCT item) AS answered FROM responses WHERE item IN ('i1','i2','i3','i4','i5') GROUP BY 1) "
    "SELECT *, CASE WHEN total >= 20 THEN 'high' WHEN total >= 15 THEN 'moderate' WHEN total >= 10 THEN 'significant work' WHEN total >= 0 THEN 'may not be ready' END AS band FROM t",
    shapes="responses",
)
def readiness(spark, sf):
    r = S.responses(spark, sf).withColumn("score", F.col("score") % 5 + 1)
    return V.readiness(r, [f"i{n}" for n in range(1, 6)])


@query(
    "reach",
    """
WITH p AS (SELECT program, participant, count(*) AS sessions, sum(artifacts) AS artifacts FROM responses GROUP BY 1, 2),
a AS (SELECT program, count(*) AS participants, round_even(CAST(sum(sessions) AS DOUBLE) / count(*), 4) AS sessions_each,
  round_even(100 * (CAST(count_if(sessions > 1) AS DOUBLE) / count(*)), 1) AS retention_pct, CAST(sum(artifacts) AS BIGINT) AS artifacts FROM p GROUP BY 1)
SELECT * FROM a JOIN (SELECT program, count(DISTINCT org) AS orgs, count(DISTINCT region) AS regions FROM responses GROUP BY 1) USING (program)
""",
    shapes="responses",
)
def reach(spark, sf):
    return V.reach(S.responses(spark, sf), "program")


@query(
    "reach_estimate_error",
    "SELECT l_suppkey AS program, count(DISTINCT l_partkey) AS exact, true AS inside FROM lineitem GROUP BY 1",
)
def reach_estimate(spark, sf):
    """Sketches per program and month, stored and merged, against the exact number of participants."""
    visits = S.table(spark, sf, "lineitem").selectExpr("l_suppkey AS program", "l_partkey AS participant", "l_shipdate AS day")
    path = scratch_path(spark, "sketches")
    V.reach_sketches(visits, "program", F.date_trunc("month", "day")).write.parquet(path)
    exact = visits.groupBy("program").agg(F.count_distinct("participant").alias("exact"))
    both = V.reach_merged(spark.read.parquet(path), "program").join(exact, "program")
    return both.select("program", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("inside"))


@query(
    "unit_costs",
    "SELECT l_suppkey AS program, round_even(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT l_partkey), 2) AS cost_per_participant, "
    "round_even(CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) / CAST(count(*) * 60 AS DOUBLE), 4) AS utilisation FROM lineitem GROUP BY 1",
)
def unit_costs(spark, sf):
    costs = S.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS program",
        "l_partkey AS participant",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS cost",
        "CAST(l_quantity AS INT) AS days_used",
        "60 AS days_available",
    )
    return V.unit_costs(costs, "program")


@query(
    "asset_use",
    "SELECT l_linenumber AS asset_type, round_even(CAST(count_if(l_returnflag = 'A') AS DOUBLE) / count(*), 4) AS still_used, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS uses FROM lineitem GROUP BY 1",
)
def asset_use(spark, sf):
    assets = S.table(spark, sf, "lineitem").selectExpr(
        "l_linenumber AS asset_type", "l_returnflag = 'A' AS in_use", "CAST(l_quantity AS INT) AS uses"
    )
    return V.asset_use(assets, "asset_type")


@query(
    "register_matrix",
    "SELECT CASE WHEN royal >= 7 AND nomadic >= 6 THEN 'convergence' WHEN royal >= 7 THEN 'royal only' WHEN nomadic >= 6 THEN 'nomadic only' ELSE 'both low' END AS reading, "
    f"count(*) AS projects, {_MEAN.format('royal', 3)} AS mean_royal, {_MEAN.format('nomadic', 3)} AS mean_nomadic FROM responses GROUP BY 1",
    shapes="responses",
)
def register_matrix(spark, sf):
    return V.register_matrix(S.responses(spark, sf), 7, 6)


@query(
    "pre_post",
    """
WITH b AS (SELECT project, question, CAST(sum(score) FILTER (point = 'baseline') AS DOUBLE) / count_if(point = 'baseline') AS pre,
                  CAST(sum(score) FILTER (point = 'final') AS DOUBLE) / count_if(point = 'final') AS post FROM responses GROUP BY 1, 2
           HAVING count_if(point = 'baseline') > 0 AND count_if(point = 'final') > 0)
SELECT *, round_even(post - pre, 4) AS change FROM b
""",
    shapes="responses",
)
def pre_post(spark, sf):
    return V.pre_post(S.responses(spark, sf), "baseline", "final")


@query(
    "kits_outstanding",
    "SELECT l_partkey AS kit, l_orderkey AS engagement, l_suppkey AS program FROM lineitem s WHERE l_returnflag <> 'R' "
    "AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = s.l_partkey AND r.l_orderkey = s.l_orderkey)",
)
def outstanding(spark, sf):
    kits = S.table(spark, sf, "lineitem").selectExpr("l_partkey AS kit", "l_orderkey AS engagement", "l_suppkey AS program", "l_returnflag")
    back = F.col("l_returnflag") == "R"
    return V.outstanding(kits.filter(~back), kits.filter(back)).select("kit", "engagement", "program")


@query(
    "kit_return_rate",
    "WITH r AS (SELECT DISTINCT l_partkey, l_orderkey, 1 AS b FROM lineitem WHERE l_returnflag = 'R') "
    "SELECT l_suppkey AS program, count(*) AS shipped, count(b) AS returned, round_even(CAST(count(b) AS DOUBLE) / count(*), 4) AS return_rate "
    "FROM lineitem LEFT JOIN r USING (l_partkey, l_orderkey) GROUP BY 1",
)
def return_rate(spark, sf):
    kits = S.table(spark, sf, "lineitem").selectExpr("l_partkey AS kit", "l_orderkey AS engagement", "l_suppkey AS program", "l_returnflag")
    return V.return_rate(kits, kits.filter("l_returnflag = 'R'"), "program")


@query("apply_codes", "SELECT session, segment, code FROM codes", shapes="codes")
def apply_codes(spark, sf):
    return codes(spark, sf).select("session", "segment", "code")


@query("code_freq", "SELECT client, code, count(*) AS segments, count(DISTINCT session) AS sessions FROM codes GROUP BY 1, 2", shapes="codes")
def code_freq(spark, sf):
    return V.code_freq(codes(spark, sf))


@query(
    "shared_codes",
    "SELECT code, count(DISTINCT client) AS clients, count(*) AS segments FROM codes GROUP BY 1 HAVING count(DISTINCT client) >= 2",
    shapes="codes",
)
def shared_codes(spark, sf):
    return V.shared_codes(codes(spark, sf))


@query(
    "code_cooccurrence",
    "WITH d AS (SELECT DISTINCT client, session, segment, code FROM codes) SELECT a.code AS code_a, b.code AS code_b, count(*) AS segments "
    "FROM d a JOIN d b ON a.client = b.client AND a.session = b.session AND a.segment = b.segment AND a.code < b.code GROUP BY 1, 2",
    shapes="codes",
)
def code_cooccurrence(spark, sf):
    return V.code_cooccurrence(codes(spark, sf))


@query(
    "code_by_approach",
    "WITH s AS (SELECT session, min(CASE session % 3 WHEN 0 THEN 'mirror' WHEN 1 THEN 'map' ELSE 'walk' END) AS approach FROM turns GROUP BY 1), "
    "n AS (SELECT session, count(*) AS n FROM codes WHERE code = 'line-of-flight' GROUP BY 1) "
    "SELECT approach, count(*) AS sessions, CAST(sum(coalesce(n, 0)) AS BIGINT) AS occurrences, round_even(CAST(sum(coalesce(n, 0)) AS DOUBLE) / count(*), 4) AS per_session "
    "FROM s LEFT JOIN n USING (session) GROUP BY approach",
    shapes="codes",
)
def code_by_approach(spark, sf):
    sessions = S.turns(spark, sf).groupBy("session").agg(
        F.min(F.expr("CASE session % 3 WHEN 0 THEN 'mirror' WHEN 1 THEN 'map' ELSE 'walk' END")).alias("approach")
    )
    return V.code_by_approach(codes(spark, sf), sessions, "line-of-flight")


_CLASSES = {"first": "the", "plural": "and|with", "third": "th[a-z]+"}


@query(
    "texture",
    "WITH t AS (SELECT session, len(regexp_extract_all(text, '\\S+')) AS words, "
    + ", ".join(f"len(regexp_extract_all(text, '(?i){p}')) AS {n}" for n, p in _CLASSES.items())
    + " FROM turns), s AS (SELECT session, "
    + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in ["words", *_CLASSES])
    + " FROM t GROUP BY session) SELECT *, "
    + ", ".join(f"round_even(CAST(100 * {n} AS DOUBLE) / words, 4) AS {n}_rate" for n in _CLASSES)
    + " FROM s",
    shapes="turns",
)
def texture(spark, sf):
    return V.texture(S.turns(spark, sf), _CLASSES)


@query(
    "fear_arc",
    """
WITH f AS (SELECT client, min(pos) FILTER (code = 'fear-surface') AS at_1, min(pos) FILTER (code = 'fear-underlying') AS at_2,
                  min(pos) FILTER (code = 'fear-root') AS at_3, min(pos) FILTER (code = 'fear-transformation') AS at_4
           FROM codes WHERE code LIKE 'fear-%' GROUP BY 1),
r AS (SELECT *, list_filter([at_1, at_2, at_3, at_4], lambda x: x IS NOT NULL) AS l FROM f)
SELECT client, at_1, at_2, at_3, at_4, CAST(CASE WHEN at_4 IS NOT NULL THEN 4 WHEN at_3 IS NOT NULL THEN 3 WHEN at_2 IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS furthest,
       l = list_sort(l) AS in_order FROM r
""",
    shapes="codes",
)
def fear_arc(spark, sf):
    return V.fear_arc(codes(spark, sf))


@query(
    "session_shift",
    """
WITH s AS (SELECT client, session, CAST(sum(len(regexp_extract_all(text, '(?i)the'))) AS BIGINT) AS own, CAST(sum(len(regexp_extract_all(text, '(?i)with'))) AS BIGINT) AS shared FROM turns GROUP BY 1, 2)
SELECT client, arg_min(own, session) AS first_own, arg_min(shared, session) AS first_shared, arg_max(own, session) AS last_own, arg_max(shared, session) AS last_shared,
       arg_max(own, session) - arg_min(own, session) AS shift_own, arg_max(shared, session) - arg_min(shared, session) AS shift_shared
FROM s GROUP BY client
""",
    shapes="turns",
)
def session_shift(spark, sf):
    per_session = S.turns(spark, sf).groupBy("client", "session").agg(
        F.sum(F.regexp_count("text", F.lit("(?i)the"))).alias("own"),
        F.sum(F.regexp_count("text", F.lit("(?i)with"))).alias("shared"),
    )
    return V.shift(per_session, "client", F.col("session"), ["own", "shared"])
