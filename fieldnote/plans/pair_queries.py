"""Pairwise, graph and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.operators import pairs as P
from fieldnote.plans import shapes as S
from fieldnote.plans.registry import query

_PAIRS = (
    "WITH n AS (SELECT DISTINCT 'nation-' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS node FROM supplier "
    "UNION SELECT DISTINCT 'nation-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') FROM customer), "
    "pairs AS (SELECT x.node AS a, y.node AS b FROM n x JOIN n y ON x.node < y.node) "
)


def _pairs(spark, sf):
    named = "'nation-' || lpad(CAST({} AS STRING), 2, '0') AS node"
    nodes = S.table(spark, sf, "supplier").selectExpr(named.format("s_nationkey")).unionByName(
        S.table(spark, sf, "customer").selectExpr(named.format("c_nationkey"))
    )
    return P.all_pairs(nodes, "node")


def _arms(spark, sf):
    b = S.bouts(spark, sf)
    return P.findings(b.filter("phase = 'P2c'")), P.findings(b.filter("phase = 'P3b'"))


_ARMS = (
    "WITH x AS (SELECT a, b, round_even(CAST(sum(score_a - score_b) AS DOUBLE) / count(*), 4) AS lead FROM duels WHERE phase = 'P2c' GROUP BY 1, 2), "
    "y AS (SELECT a, b, round_even(CAST(sum(score_a - score_b) AS DOUBLE) / count(*), 4) AS lead FROM duels WHERE phase = 'P3b' GROUP BY 1, 2) "
)


@query("all_pairs", _PAIRS + "SELECT a, b FROM pairs")
def all_pairs(spark, sf):
    return _pairs(spark, sf)


@query(
    "pair_schedule",
    _PAIRS + ", p AS (SELECT a, b, row_number() OVER (ORDER BY md5('42|' || a || '|' || b), a, b) AS place FROM pairs) "
    "SELECT *, CAST(ceil(place / 8.0) AS BIGINT) AS batch FROM p",
)
def pair_schedule(spark, sf):
    return P.schedule(_pairs(spark, sf), 42, 8)


@query(
    "schedule_trades",
    "WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), r AS (SELECT a, b, row_number() OVER (ORDER BY md5('7|' || a || '|' || b), a, b) AS place FROM p) "
    "SELECT *, CAST(ceil(place / 8.0) AS BIGINT) AS batch FROM r",
)
def schedule_trades(spark, sf):
    trades = S.table(spark, sf, "lineitem").selectExpr("l_partkey AS a", "l_suppkey AS b").distinct()
    return P.schedule(trades, 7, 8)


@query(
    "quota_sample",
    """
WITH r AS (SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY md5('42|' || id), id) AS pick FROM prospects WHERE status IN ('contacted', 'responded', 'ready'))
SELECT * FROM r WHERE pick <= CASE status WHEN 'contacted' THEN 6 WHEN 'responded' THEN 3 ELSE 1 END
""",
    shapes="prospects",
)
def quota_sample(spark, sf):
    mix = {"contacted": 0.6, "responded": 0.3, "ready": 0.1}
    return P.quota_sample(S.prospects(spark, sf).select("id", "status"), mix, 10, "status", "id")


@query(
    "untested_pairs",
    _PAIRS + "SELECT a, b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM bouts d WHERE least(d.a, d.b) = p.a AND greatest(d.a, d.b) = p.b AND d.phase = 'P2c' AND d.killed AND len(d.criteria) = 3)",
    shapes="bouts",
)
def untested(spark, sf):
    """Pairs that no round-robin bout has settled by all three criteria."""
    return P.untested(_pairs(spark, sf), S.bouts(spark, sf).filter("phase = 'P2c' AND killed AND size(criteria) = 3"))


@query(
    "pair_findings",
    "SELECT a, b, round_even(CAST(sum(score_a - score_b) AS DOUBLE) / count(*), 4) AS lead, count(*) AS bouts FROM duels GROUP BY 1, 2",
    shapes="duels",
)
def findings(spark, sf):
    return P.findings(S.bouts(spark, sf))


@query(
    "convergent_findings",
    _ARMS + "SELECT a, b, x.lead, y.lead AS other_lead FROM x JOIN y USING (a, b) WHERE sign(x.lead) = sign(y.lead)",
    shapes="duels",
)
def convergent(spark, sf):
    return P.convergent(*_arms(spark, sf))


@query(
    "divergent_findings",
    _ARMS + "SELECT a, b, x.lead, y.lead AS other_lead, round_even(abs(coalesce(x.lead, 0) - coalesce(y.lead, 0)), 4) AS difference "
    "FROM x FULL JOIN y USING (a, b) WHERE round_even(abs(coalesce(x.lead, 0) - coalesce(y.lead, 0)), 4) > 0.5",
    shapes="duels",
)
def divergent(spark, sf):
    return P.divergent(*_arms(spark, sf), 0.5)


@query(
    "emergent_findings",
    "SELECT least(a, b) AS a, greatest(a, b) AS b FROM bouts WHERE phase = 'P2c' AND killed "
    "EXCEPT SELECT least(a, b), greatest(a, b) FROM bouts WHERE phase = 'P3b' AND killed AND len(criteria) = 3",
    shapes="bouts",
)
def emergent(spark, sf):
    b = S.bouts(spark, sf)
    robin = P.findings(b.filter("phase = 'P2c' AND killed"))
    return P.emergent(robin, P.findings(b.filter("phase = 'P3b' AND killed AND size(criteria) = 3")))


@query(
    "kill_stats",
    "SELECT coalesce(phase, '*') AS phase, count(*) AS bouts, count_if(killed) AS kills, round_even(CAST(count_if(killed) AS DOUBLE) / count(*), 4) AS kill_rate FROM bouts GROUP BY ROLLUP (phase)",
    shapes="bouts",
)
def kill_stats(spark, sf):
    return P.kill_stats(S.bouts(spark, sf))


@query(
    "criteria_hits",
    "WITH c AS (SELECT killed, unnest(criteria) AS criterion FROM bouts) SELECT criterion, count(*) AS triggered, count_if(killed) AS stuck FROM c GROUP BY 1",
    shapes="bouts",
)
def criteria_hits(spark, sf):
    return P.criteria_hits(S.bouts(spark, sf))


@query(
    "score_long",
    "SELECT claim, against, round_even(CAST(sum(score) AS DOUBLE) / count(score), 4) AS score FROM sides GROUP BY 1, 2",
    shapes="sides",
)
def score_long(spark, sf):
    return P.score_long(S.bouts(spark, sf))


_NODES = [f"nation-{i:02d}" for i in range(25)]


@query(
    "score_matrix",
    "WITH s AS (SELECT claim, against, round_even(CAST(sum(score) AS DOUBLE) / count(score), 4) AS score FROM sides GROUP BY 1, 2) SELECT claim, "
    + ", ".join(f"max(score) FILTER (against = '{n}') AS \"{n}\"" for n in _NODES)
    + " FROM s GROUP BY claim",
    shapes="sides",
)
def score_matrix(spark, sf):
    return P.score_matrix(S.bouts(spark, sf), _NODES)


@query(
    "connector_profile",
    """
SELECT claim, count(*) AS scores, round_even(CAST(sum(score) AS DOUBLE) / count(*), 4) AS mean,
       round(sqrt(CAST(count(*) * sum(score * score) - sum(score) * sum(score) AS DOUBLE) / CAST(count(*) * (count(*) - 1) AS DOUBLE)), 6) AS spread,
       quantile_cont(CAST(score AS DOUBLE), 0.5) AS median, round_even(CAST(count_if(score >= 8) AS DOUBLE) / count(*), 4) AS share_high
FROM sides GROUP BY claim
""",
    shapes="sides",
)
def connector_profile(spark, sf):
    return P.connector_profile(S.bouts(spark, sf), 8)


@query(
    "trajectory",
    """
WITH q AS (SELECT claim, CAST(date_trunc('quarter', date) AS DATE) AS period, round_even(CAST(sum(score) AS DOUBLE) / count(score), 4) AS score FROM sides GROUP BY 1, 2)
SELECT *, round_even(score - lag(score) OVER w, 4) AS change, max(score) OVER (PARTITION BY claim) AS peak,
       last_value(score) OVER (PARTITION BY claim ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
FROM q WINDOW w AS (PARTITION BY claim ORDER BY period)
""",
    shapes="sides",
    dates="period",
)
def trajectory(spark, sf):
    scores = P.both_sides(S.bouts(spark, sf))
    return P.trajectory(scores, "claim", F.date_trunc("quarter", "date").cast("date"))


@query(
    "absorption",
    """
WITH k AS (SELECT CASE WHEN score_a >= score_b THEN a ELSE b END AS absorber, CASE WHEN score_a >= score_b THEN b ELSE a END AS lost FROM bouts WHERE killed)
SELECT absorber, count(*) AS absorbed, count(DISTINCT lost) AS claims FROM k GROUP BY 1 ORDER BY absorbed DESC, absorber LIMIT 10
""",
    shapes="bouts",
)
def absorption(spark, sf):
    wins = F.col("score_a") >= F.col("score_b")
    kills = S.bouts(spark, sf).filter("killed").select(
        F.when(wins, F.col("a")).otherwise(F.col("b")).alias("absorber"),
        F.when(wins, F.col("b")).otherwise(F.col("a")).alias("lost"),
    )
    return P.absorption(kills, 10)


def _relations(spark, sf):
    return S.edges(spark, sf).selectExpr("parent AS src", "child AS dst", "type")


@query(
    "degrees",
    "WITH e AS (SELECT parent AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT child, 0, 1 FROM edges) "
    "SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM e GROUP BY 1",
    shapes="edges",
)
def degrees(spark, sf):
    return P.degrees(_relations(spark, sf))


@query(
    "relation_types",
    "SELECT type, count(*) AS relations, count(DISTINCT parent) AS sources, count(DISTINCT child) AS targets FROM edges GROUP BY 1",
    shapes="edges",
)
def relation_types(spark, sf):
    return P.relation_types(_relations(spark, sf))


@query(
    "density",
    "WITH l AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM bouts), n AS (SELECT a FROM l UNION SELECT b FROM l) "
    "SELECT count(*) AS linked, (SELECT count(*) FROM n) AS nodes, round_even(CAST(2 * count(*) AS DOUBLE) / CAST((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1) AS DOUBLE), 6) AS density FROM l",
    shapes="bouts",
)
def density(spark, sf):
    return P.density(S.bouts(spark, sf).selectExpr("a AS src", "b AS dst"))


_REC = "WITH RECURSIVE r(node, depth) AS (SELECT {root}, 0::BIGINT UNION SELECT e.{to}, r.depth + 1 FROM r JOIN e ON e.{frm} = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node"


def _recursive(root, frm, to, types=""):
    edges = S.SHAPE_SQL["edges"]
    e = f"e AS (SELECT * FROM ({edges}) AS x {types})"
    return _REC.format(root=root, frm=frm, to=to).replace("WITH RECURSIVE ", f"WITH RECURSIVE {e}, ", 1)


@query("lineage_descendants", _recursive("3::BIGINT", "parent", "child"))
def descendants(spark, sf):
    return P.lineage(S.edges(spark, sf), 3)


@query("lineage_ancestors", _recursive("(SELECT max(s_suppkey) FROM supplier)", "child", "parent"))
def ancestors(spark, sf):
    steps = S.edges(spark, sf).selectExpr("child AS src", "parent AS dst")
    youngest = S.table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("node"))
    return P.reach(steps, youngest).select("node", "depth")


@query(
    "typed_reach",
    _recursive("1::BIGINT", "parent", "child", "WHERE type IN ('causal', 'precondition', 'complement')"),
)
def typed_reach(spark, sf):
    root = S.table(spark, sf, "supplier").filter("s_suppkey = 1").selectExpr("s_suppkey AS node")
    return P.reach(_relations(spark, sf), root, ["causal", "precondition", "complement"]).select("node", "depth")


@query(
    "parent_death",
    "SELECT e.parent, e.child, e.born, s.s_suppkey % 37 AS died FROM edges e JOIN supplier s ON s.s_suppkey = e.parent WHERE s.s_suppkey % 37 > e.born",
    shapes="edges",
)
def parent_death(spark, sf):
    deaths = S.table(spark, sf, "supplier").selectExpr("s_suppkey AS node", "s_suppkey % 37 AS died")
    return P.parent_death(S.edges(spark, sf), deaths)
