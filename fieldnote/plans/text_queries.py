"""Grading, scorecard and text-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldnote.functions import text as T
from fieldnote.operators import grading as G
from fieldnote.plans import shapes as S
from fieldnote import schemas
from fieldnote.operators import snapshots as N
from fieldnote.plans.registry import query
from fieldnote.session import cut_lineage, scratch_path, spread
from fieldnote.sources import landing as L
from fieldnote.sources import records as R
from fieldnote.sources import sinks as K
from fieldnote.sources.keyed import KeyedTable


def expectations(spark, sf):
    return G.grade(S.runs(spark, sf), S.assertions(spark), S.priors(spark, sf))


def scores(spark, sf):
    return G.run_scores(expectations(spark, sf))


@query(
    "ab_delta",
    """
WITH sides AS (
  SELECT skill,
    coalesce(max(prog_pct) FILTER (mode = 'with_skill'), 0) AS a_prog_pct, coalesce(max(qual_pct) FILTER (mode = 'with_skill'), 0) AS a_qual_pct,
    coalesce(max(words) FILTER (mode = 'with_skill'), 0) AS a_words, coalesce(max(prog_pct) FILTER (mode = 'baseline'), 0) AS b_prog_pct,
    coalesce(max(qual_pct) FILTER (mode = 'baseline'), 0) AS b_qual_pct, coalesce(max(words) FILTER (mode = 'baseline'), 0) AS b_words
  FROM shown GROUP BY skill)
SELECT *, round_even(a_prog_pct - b_prog_pct, 1) AS prog_delta, round_even(a_qual_pct - b_qual_pct, 1) AS qual_delta,
       a_words - b_words AS words_delta,
       CASE WHEN b_words = 0 THEN 0.0::DOUBLE ELSE round_even(100 * (a_words - b_words) / b_words, 0) END AS words_pct
FROM sides
""",
    shapes="shown",
)
def ab_delta(spark, sf):
    return G.ab_delta(G.mode_totals(scores(spark, sf)))


_KEYS = 'skill, iteration, eval, mode, run_id'


def _rule_query(name, rule, legacy=False):
    """Grades of the assertions that use one rule."""
    passed = "words BETWEEN coalesce(\"min\", 0) AND coalesce(\"max\", 10000)"
    sql = f"SELECT f.run_id, f.assertion_id, f.passed, f.evidence FROM fresh f JOIN (SELECT DISTINCT assertion_id, rule FROM assertions) a USING (assertion_id) WHERE rule = '{rule}'"
    if legacy:
        sql = (
            f"SELECT run_id, assertion_id, {passed} AS passed, words || ' words (' || CASE WHEN {passed} THEN 'range ' ELSE 'outside range ' END "
            f"|| coalesce(\"min\", 0) || '-' || coalesce(\"max\", 10000) || ')' AS evidence FROM checked WHERE rule = '{rule}'"
        )

    @query(name, sql, shapes="checked" if legacy else "fresh")
    def run(spark, sf):
        rules = S.assertions(spark).filter(F.col("rule") == rule)
        graded = G.grade(S.runs(spark, sf), rules, legacy=legacy)
        return graded.select("run_id", "assertion_id", "passed", "evidence")


for _rule in ("regex_absent", "regex_present", "word_count", "word_count_max", "line_count"):
    _rule_query(f"check_{_rule}", _rule)
_rule_query("check_unknown_rule", "tone")
_rule_query("check_word_count_body_unknown", "word_count_body")
_rule_query("check_word_count_body", "word_count_body", legacy=True)


@query("text_metrics", "SELECT run_id, words, lines, md5(body) AS body, md5(unquoted) AS unquoted FROM measured", shapes="measured")
def text_metrics(spark, sf):
    m = G.text_metrics(S.runs(spark, sf))
    return m.select("run_id", "words", "lines", F.md5("body").alias("body"), F.md5("unquoted").alias("unquoted"))


@query("extract_body", "SELECT run_id, md5(body) AS body, length(body) AS chars FROM bodies", shapes="bodies")
def extract_body(spark, sf):
    return S.runs(spark, sf).withColumn("body", T.extract_body(F.col("text"))).select(
        "run_id", F.md5("body").alias("body"), F.length("body").cast("bigint").alias("chars")
    )


@query(
    "strip_quotes",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '"[^"]*"', ' ', 'g'), '''[^'']*''', ' ', 'g'), '“[^”]*”', ' ', 'g'), '‘[^’]*’', ' ', 'g')) AS clean FROM documents""",
)
def strip_quotes(spark, sf):
    return spread(S.table(spark, sf, "documents")).select("doc_id", F.md5(T.strip_quotes(F.col("text"))).alias("clean"))


@query(
    "expand_assertions",
    "SELECT r.run_id, a.assertion_id, a.\"check\", a.rule FROM runs r JOIN assertions a ON a.skill = r.skill AND (a.eval IS NULL OR a.eval = r.eval)",
    shapes="runs assertions",
)
def expand(spark, sf):
    return G.expand(S.runs(spark, sf), S.assertions(spark)).select("run_id", "assertion_id", "check", "rule")


@query(
    "assertion_union",
    "SELECT source, count(*) AS definitions, count(DISTINCT assertion_id) AS ids FROM ("
    "SELECT d.source, a.assertion_id FROM documents d JOIN assertions a ON a.skill = d.lang AND a.eval IS NULL UNION ALL "
    "SELECT d.source, a.assertion_id FROM documents d JOIN assertions a ON a.skill = d.lang AND a.eval = d.source) GROUP BY source",
    shapes="assertions",
)
def assertion_union(spark, sf):
    docs = S.table(spark, sf, "documents").selectExpr("lang AS skill", "source")
    rules = S.assertions(spark)
    universal = docs.join(rules.filter("eval IS NULL"), "skill").select("source", "assertion_id")
    fixture = docs.join(rules.withColumnRenamed("eval", "source"), ["skill", "source"]).select("source", "assertion_id")
    both = G.assertion_union(universal, fixture)
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("definitions"), F.count_distinct("assertion_id").alias("ids")
    )


@query("carry_forward", "SELECT run_id, assertion_id, passed, evidence FROM expectations WHERE \"check\" = 'qualitative'", shapes="expectations")
def carry_forward(spark, sf):
    rules = S.assertions(spark).filter("check = 'qualitative'")
    return G.grade(S.runs(spark, sf), rules, S.priors(spark, sf)).select("run_id", "assertion_id", "passed", "evidence")


@query(
    "classify",
    "SELECT eval, assertion_id, \"check\", count(*) AS expectations, count(passed) AS graded FROM expectations GROUP BY ALL",
    shapes="expectations",
)
def classify(spark, sf):
    found = G.classify(expectations(spark, sf), S.assertions(spark))
    return found.groupBy("eval", "assertion_id", "check").agg(
        F.count(F.lit(1)).alias("expectations"), F.count("passed").alias("graded")
    )


@query("run_scores", "SELECT * FROM scores", shapes="scores")
def run_scores(spark, sf):
    return scores(spark, sf)


@query(
    "programmatic_summary",
    f"SELECT {_KEYS}, count_if(coalesce(passed, false)) AS prog_passed, count(passed) AS prog_total, max(body_words) AS body_words FROM expectations GROUP BY ALL",
    shapes="expectations",
)
def programmatic_summary(spark, sf):
    return G.programmatic_summary(expectations(spark, sf))


@query("mode_totals", "SELECT * FROM totals", shapes="totals")
def mode_totals(spark, sf):
    return G.mode_totals(scores(spark, sf))


@query("mode_percentages", "SELECT * FROM shown", shapes="shown")
def mode_percentages(spark, sf):
    return G.with_percentages(G.mode_totals(scores(spark, sf)))


@query(
    "ab_pairs",
    "SELECT skill, eval, CAST(sum(prog_passed) FILTER (mode = 'with_skill') AS BIGINT) AS with_skill, "
    "CAST(sum(prog_passed) FILTER (mode = 'baseline') AS BIGINT) AS baseline FROM scores GROUP BY ALL",
    shapes="scores",
)
def ab_pairs(spark, sf):
    return G.ab_pairs(scores(spark, sf), F.sum("prog_passed"))


@query(
    "failure_modes",
    "SELECT assertion_id, count_if(mode = 'with_skill') AS with_skill_fails, count_if(mode = 'baseline') AS baseline_fails, "
    "substr(text, 1, 70) AS label FROM expectations WHERE NOT passed GROUP BY assertion_id, text",
    shapes="expectations",
)
def failure_modes(spark, sf):
    return G.failure_modes(expectations(spark, sf))


@query(
    "cross_skill",
    """
SELECT coalesce(skill, '*') AS skill, coalesce(mode, '*') AS mode, count(*) AS runs, count(DISTINCT eval) AS evals,
       CASE WHEN sum(prog_total) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * sum(prog_passed) / sum(prog_total), 1) END AS prog_pct,
       CASE WHEN sum(qual_total) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * sum(qual_passed) / sum(qual_total), 1) END AS qual_pct
FROM scores GROUP BY ROLLUP (skill, mode)
""",
    shapes="scores",
)
def cross_skill(spark, sf):
    return G.cross_skill(scores(spark, sf))


def _latest(compat):
    rank = "iteration" if compat == "numeric" else "iteration_name"

    @query(
        f"latest_iteration_{compat}",
        f"SELECT run_id, skill, iteration FROM runs QUALIFY {rank} = max({rank}) OVER (PARTITION BY skill)",
        shapes="runs",
    )
    def run(spark, sf):
        return G.latest_iteration(S.runs(spark, sf), compat=compat).select("run_id", "skill", "iteration")


_latest("numeric")
_latest("lexical")


@query(
    "missing_outputs",
    """
WITH grid AS (SELECT i.skill, i.iteration, e.eval, m.mode FROM (SELECT DISTINCT skill, iteration FROM runs) i
  JOIN (SELECT DISTINCT skill, eval FROM runs) e ON e.skill = i.skill CROSS JOIN (VALUES ('with_skill'), ('baseline')) m(mode))
SELECT g.*, 'output missing: ' || g.skill || '/iteration-' || g.iteration || '/' || g.eval || '/' || g.mode AS error
FROM grid g WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.skill = g.skill AND r.iteration = g.iteration AND r.eval = g.eval AND r.mode = g.mode)
""",
    shapes="runs",
)
def missing_outputs(spark, sf):
    r = S.runs(spark, sf).drop("iteration_name")
    grid = G.expected_grid(r.select("skill", "eval"), r)
    return G.with_missing(r, grid).filter("error IS NOT NULL").select("skill", "iteration", "eval", "mode", "error")


# --- records, specs and gradings, rendered from the tables and read back ----------------
@query(
    "scan_records",
    "SELECT slug, org, contact, status, touch_count, created, last_contact, next_followup, CAST(next_followup AS VARCHAR) AS next_followup_raw, source, angle FROM prospects",
    shapes="prospects",
    dates="created last_contact next_followup",
)
def scan_records(spark, sf):
    p = S.prospects(spark, sf)
    names = [c for c, _ in schemas.PROSPECT if c in p.columns]
    files = p.select(F.concat(F.lit("prospects/"), "slug", F.lit(".md")).alias("path"), R.render_record(names).alias("text"))
    return R.parse_records(files, schemas.PROSPECT).select("slug", *names[:7], "next_followup_raw", *names[7:]).select(
        "slug", "org", "contact", "status", "touch_count", "created", "last_contact", "next_followup",
        "next_followup_raw", "source", "angle",
    )


@query(
    "scan_funder_records",
    "SELECT slug, funder, type, grant_range, deadline, deadline_raw, status, next_action, angle, ['a ' || slug, 'b'] AS focus_areas FROM funders",
    shapes="funders",
    dates="deadline",
)
def scan_funder_records(spark, sf):
    f = S.funders(spark, sf).withColumn("deadline", F.col("deadline_raw"))
    names = ["funder", "type", "grant_range", "deadline", "status", "next_action", "angle"]
    focus = F.concat(F.lit("---\nfocus_areas: [a "), "slug", F.lit(', "b"]\n'))
    text = F.concat(focus, F.substring_index(R.render_record(names), "---\n", -2))
    files = f.select(F.concat(F.lit("funders/"), "slug", F.lit(".md")).alias("path"), text.alias("text"))
    return R.parse_records(files, schemas.FUNDER).select(
        "slug", "funder", "type", "grant_range", "deadline", "deadline_raw", "status", "next_action", "angle", "focus_areas"
    )


@query(
    "fm_field",
    "SELECT doc_id, source, CAST(n_chars AS VARCHAR) AS chars, CAST(NULL AS VARCHAR) AS absent FROM documents",
)
def fm_field(spark, sf):
    page = F.concat(F.lit('---\nsource: "'), "source", F.lit('"\nchars: '), F.col("n_chars").cast("string"), F.lit("\n---\n"), "text")
    docs = S.table(spark, sf, "documents").withColumn("page", page)
    return docs.select(
        "doc_id",
        T.fm_field(F.col("page"), "source").alias("source"),
        T.fm_field(F.col("page"), "chars").alias("chars"),
        T.fm_field(F.col("page"), "no_such_key").alias("absent"),
    )


@query("slugify", "SELECT c_custkey, regexp_replace(replace(lower(c_name), ' ', '-'), '[^a-z0-9-]', '', 'g') AS slug, "
       "regexp_replace(replace(lower(c_mktsegment || ' & Sons (' || c_custkey || ')'), ' ', '-'), '[^a-z0-9-]', '', 'g') AS firm FROM customer")
def slugify(spark, sf):
    firm = F.concat("c_mktsegment", F.lit(" & Sons ("), F.col("c_custkey").cast("string"), F.lit(")"))
    return S.table(spark, sf, "customer").select(
        "c_custkey", T.slugify(F.col("c_name")).alias("slug"), T.slugify(firm).alias("firm")
    )


@query("or_dash", "SELECT slug, coalesce(nullif(angle, ''), '--') AS angle FROM prospects", shapes="prospects")
def or_dash(spark, sf):
    return S.prospects(spark, sf).select("slug", T.or_dash(F.col("angle")).alias("angle"))


_NOTE_SQL = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'title: note' || chr(10) || '---' || chr(10) ||
       '> **Canonical:** here' || chr(10) || chr(10) || t ELSE t END AS note
FROM (SELECT doc_id, replace(replace(text, ' and ', ' [[note|and]] '), ' of ', ' [[of]] ') AS t FROM documents)
"""


def _notes(spark, sf):
    t = F.replace(F.replace("text", F.lit(" and "), F.lit(" [[note|and]] ")), F.lit(" of "), F.lit(" [[of]] "))
    head = F.lit("---\ntitle: note\n---\n> **Canonical:** here\n\n")
    return spread(S.table(spark, sf, "documents")).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(head, t)).otherwise(t).alias("note")
    )


_LINKS = r"regexp_replace(regexp_replace({}, '\[\[([^\]|]+)\|([^\]]+)\]\]', '\2', 'g'), '\[\[([^\]]+)\]\]', '\1', 'g')"
_BODY = "CASE WHEN doc_id % 2 = 0 THEN regexp_replace(substr(note, length('---' || chr(10) || 'title: note' || chr(10) || '---' || chr(10) || '> **Canonical:** here' || chr(10)) + 1), '^[\\s]*\\n', '') ELSE note END"


@query("strip_front_matter", f"WITH n AS ({_NOTE_SQL}) SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN substr(note, 21) ELSE note END) AS body FROM n")
def strip_front_matter(spark, sf):
    return _notes(spark, sf).select("doc_id", F.md5(T.strip_front_matter(F.col("note"))).alias("body"))


@query("strip_canonical", f"WITH n AS ({_NOTE_SQL}) SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN replace(note, '> **Canonical:** here' || chr(10), '') ELSE note END) AS body FROM n")
def strip_canonical(spark, sf):
    return _notes(spark, sf).select("doc_id", F.md5(T.strip_canonical(F.col("note"))).alias("body"))


@query("strip_wikilinks", f"WITH n AS ({_NOTE_SQL}) SELECT doc_id, md5({_LINKS.format('note')}) AS body FROM n")
def strip_wikilinks(spark, sf):
    return _notes(spark, sf).select("doc_id", F.md5(T.strip_wikilinks(F.col("note"))).alias("body"))


@query("snapshot_body", f"WITH n AS ({_NOTE_SQL}) SELECT doc_id, md5({_LINKS.format(_BODY)}) AS body FROM n")
def snapshot_body(spark, sf):
    return _notes(spark, sf).select("doc_id", F.md5(T.snapshot_body(F.col("note"))).alias("body"))


@query(
    "sync_header",
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '> **Canonical source:** kept, last synced {S.AS_OF} by hand' "
    f"ELSE '> **Canonical source:** `' || source || '/' || doc_id || '` - last synced {S.AS_OF}. Edit there; this file is a snapshot.' END AS header FROM documents",
)
def sync_header(spark, sf):
    old = F.when(F.col("doc_id") % 2 == 0, "> **Canonical source:** kept, last synced 1999-12-31 by hand").otherwise("# title")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return S.table(spark, sf, "documents").select("doc_id", T.sync_header(old, path, S.AS_OF).alias("header"))


@query(
    "snapshot_diff",
    """
WITH old AS (SELECT lang || '/' || doc_id AS path, CASE WHEN n_chars > 2000 THEN lower(text) ELSE text END AS body FROM documents WHERE lang <> 'fr'),
new AS (SELECT lang || '/' || doc_id AS path, text AS body FROM documents WHERE lang <> 'de')
SELECT coalesce(old.path, new.path) AS path,
       CASE WHEN new.path IS NULL THEN 'missing' WHEN old.path IS NULL THEN 'added' WHEN old.body = new.body THEN 'unchanged' ELSE 'updated' END AS change
FROM old FULL JOIN new ON old.path = new.path
""",
)
def snapshot_diff(spark, sf):
    docs = spread(S.table(spark, sf, "documents")).withColumn("path", F.concat_ws("/", "lang", F.col("doc_id").cast("string")))
    header = F.lit("> **Canonical source:** x - last synced ")
    body = F.when(F.col("n_chars") > 2000, F.lower("text")).otherwise(F.col("text"))
    old = docs.filter("lang <> 'fr'").select("path", F.concat(header, F.lit("1999-12-31\n\n"), body).alias("text"))
    new = docs.filter("lang <> 'de'").select("path", F.concat(header, F.lit("2001-08-01\n\n"), F.col("text")).alias("text"))
    return N.snapshot_diff(old, new)


@query("label", "SELECT doc_id, substr(text, 1, 70) AS label FROM documents")
def label(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.label(F.col("text")).alias("label"))


@query(
    "take_parts",
    "SELECT o_orderkey, 'C' || o_custkey AS client, CAST(o_orderdate AS DATE) AS shot_on, 'P' || (o_orderkey % 9) AS participant, CAST(o_orderkey % 30 AS INTEGER) AS take FROM orders",
    dates="shot_on",
)
def take_parts(spark, sf):
    name = F.expr("concat('C', o_custkey, '_', CAST(CAST(o_orderdate AS DATE) AS STRING), '_P', o_orderkey % 9, '_Take', o_orderkey % 30)")
    return S.table(spark, sf, "orders").select("o_orderkey", T.take_parts(name).alias("t")).select("o_orderkey", "t.*")


@query(
    "daily_parts",
    "SELECT event_id, CAST(ts AS DATE) AS day, event_type AS body, 'user ' || user_id AS state, props AS residue FROM events",
    dates="day",
)
def daily_parts(spark, sf):
    line = F.concat_ws(" | ", F.to_date("ts").cast("string"), "event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")), "props")
    return S.table(spark, sf, "events").select("event_id", T.daily_parts(line).alias("d")).select("event_id", "d.*")


@query(
    "range_parts",
    "SELECT p_partkey, CAST((p_size % 9 + 1) * 1000 AS DECIMAL(18,2)) AS low, CAST((p_size % 9 + 1) * 10000 AS DECIMAL(18,2)) AS high, "
    "CAST(1000 + p_size AS DECIMAL(18,2)) AS single FROM part",
)
def range_parts(spark, sf):
    text = F.expr("concat('$', p_size % 9 + 1, 'K-', (p_size % 9 + 1) * 10, 'K')")
    single = F.expr("concat('$1,0', lpad(p_size, 2, '0'))")
    return S.table(spark, sf, "part").select(
        "p_partkey", T.range_parts(text).alias("r"), T.range_parts(single).getField("low").alias("single")
    ).select("p_partkey", "r.low", "r.high", "single")


@query(
    "log_line",
    "SELECT touch_id, '- **' || CAST(date AS VARCHAR) || '** | ' || status || ' | ' || note AS line FROM touches",
    shapes="touches",
)
def log_line(spark, sf):
    return S.touches(spark, sf).select("touch_id", T.log_line(F.col("date"), F.col("status"), F.col("note")).alias("line"))


_TERMS = [("the of", "a"), ("tion.", "ting."), ("was on", "is on")]


@query(
    "replace_retired",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)the of')) + len(regexp_extract_all(text, '(?i)tion[.]')) + len(regexp_extract_all(text, '(?i)was on')) AS BIGINT) AS hits, "
    "md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)the of', 'a', 'g'), '(?i)tion[.]', 'ting.', 'g'), '(?i)was on', 'is on', 'g')) AS fixed FROM documents",
)
def replace_retired(spark, sf):
    return spread(S.table(spark, sf, "documents")).select(
        "doc_id",
        T.term_hits(F.col("text"), _TERMS).alias("hits"),
        F.md5(T.replace_terms(F.col("text"), _TERMS)).alias("fixed"),
    )


_BANNED = ["the of the", "[a-z]+tion of"]


@query(
    "voice_leaks",
    "SELECT doc_id, source, list_transform(list_filter(['the of the', '[a-z]+tion of'], lambda p: regexp_matches(text, p, 'i')), "
    "lambda p: regexp_extract(text, p, 0, 'i')) AS hits FROM documents WHERE regexp_matches(text, 'the of the', 'i') OR regexp_matches(text, '[a-z]+tion of', 'i')",
)
def voice_leaks(spark, sf):
    docs = spread(S.table(spark, sf, "documents"))
    return N.voice_leaks(docs, _BANNED).select("doc_id", "source", "hits")


@query(
    "review_digest",
    "WITH l AS (SELECT l_orderkey, l_suppkey AS product, l_returnflag AS bucket, CAST(l_quantity AS INTEGER) % 5 + 1 AS score, l_linenumber FROM lineitem) "
    "SELECT product, bucket, count(*) AS reviews, CAST(sum(score) AS DOUBLE) / count(*) AS mean_score FROM l WHERE score > 1 GROUP BY ALL",
)
def review_digest(spark, sf):
    labelled = S.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS product", "l_returnflag AS bucket", "CAST(l_quantity AS INT) % 5 + 1 AS score", "'q' AS quote"
    )
    return N.review_digest(labelled)[0]


@query(
    "review_quotes",
    "SELECT d.lang AS product, d.source AS bucket, d.doc_id, d.text AS quote FROM documents d JOIN labels l USING (doc_id) WHERE l.quality + 1 > 1",
)
def review_quotes(spark, sf):
    docs = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id")
    labelled = docs.selectExpr("doc_id", "lang AS product", "source AS bucket", "quality + 1 AS score", "text AS quote")
    return N.review_digest(labelled)[1].select("product", "bucket", "doc_id", "quote")


@query(
    "scan_specs",
    """
SELECT 'part-' || p_partkey AS skill, NULL AS eval, 'u' AS assertion_id, 'programmatic' AS "check", 'regex_absent' AS rule, p_name AS pattern, CAST(NULL AS INTEGER) AS "max" FROM part
UNION ALL SELECT 'part-' || p_partkey, p_brand, 'f' || p_size, 'programmatic', 'word_count_max', NULL, p_size FROM part
UNION ALL SELECT 'part-' || p_partkey, p_brand, 'q', 'qualitative', NULL, NULL, NULL FROM part
""",
)
def scan_specs(spark, sf):
    a = "named_struct('id', {}, 'text', 't', 'check', '{}', 'rule', {}, 'patterns', {}, 'max', {})"
    universal = a.format("'u'", "programmatic", "'regex_absent'", "array(p_name)", "CAST(NULL AS INT)")
    fixture = a.format("concat('f', p_size)", "programmatic", "'word_count_max'", "CAST(NULL AS ARRAY<STRING>)", "p_size")
    judged = a.format("'q'", "qualitative", "CAST(NULL AS STRING)", "CAST(NULL AS ARRAY<STRING>)", "CAST(NULL AS INT)")
    path = scratch_path(spark, "specs")
    S.table(spark, sf, "part").selectExpr(
        "concat('part-', p_partkey) AS skill_name",
        f"array({universal}) AS universal_assertions",
        f"array(named_struct('id', 1, 'name', p_brand, 'fixture_assertions', array({fixture}, {judged}))) AS evals",
    ).write.json(path)
    specs = spark.read.schema(schemas.SPEC).json(path)
    flat = R.flatten_specs(specs)
    return flat.select("skill", "eval", "assertion_id", "check", "rule", F.get("patterns", F.lit(0)).alias("pattern"), "max")


@query(
    "scan_runs",
    "SELECT run_id, skill, iteration, eval, mode, md5(text) AS text FROM (SELECT skill || '/' || iteration_name || '/' || eval || '-' || run_id || '/' || mode AS run_id, "
    "skill, iteration, eval || '-' || run_id AS eval, mode, text FROM runs)",
    shapes="runs",
)
def scan_runs(spark, sf):
    path = F.concat_ws("/", F.lit("evals"), "skill", "iteration_name", F.concat_ws("-", "eval", F.col("run_id").cast("string")), "mode", F.lit("output.md"))
    files = S.runs(spark, sf).select(path.alias("path"), "text")
    return R.parse_runs(files).select("run_id", "skill", "iteration", "eval", "mode", F.md5("text").alias("text"))


@query(
    "scan_gradings",
    "SELECT CAST(doc_id AS VARCHAR) AS run_id, CAST(0 AS INTEGER) AS seq, 'reads_well' AS assertion_id, quality = 1 AS passed, 'read' AS evidence FROM labels WHERE toxic = 0 "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'is_civil', NULL, 'pending_llm_grade' FROM labels WHERE toxic = 0",
)
def scan_gradings(spark, sf):
    whole = (
        "to_json(named_struct('body_word_count', 5, 'expectations', array("
        "named_struct('text', 't', 'assertion_id', 'reads_well', 'passed', quality = 1, 'evidence', 'read'), "
        "named_struct('text', 't', 'assertion_id', 'is_civil', 'passed', CAST(NULL AS BOOLEAN), 'evidence', 'pending_llm_grade'))))"
    )
    files = S.table(spark, sf, "labels").selectExpr(
        "CAST(doc_id AS STRING) AS run_id", f"CASE WHEN toxic = 0 THEN {whole} ELSE left({whole}, 60) END AS text"
    )
    return R.parse_gradings(files)


@query(
    "scan_entity",
    'SELECT id, t.date AS "date", t.type AS "type", t.nextActionDue AS "nextActionDue" FROM (SELECT id, unnest(touches) AS t FROM nested)',
    shapes="nested",
    dates="date nextActionDue",
)
def scan_entity(spark, sf):
    path = scratch_path(spark, "contacts")
    S.nested(spark, sf).write.json(path)
    contacts = R.scan_entity(spark, "contacts", path)
    return contacts.select("id", F.explode("touches").alias("t")).select("id", "t.date", "t.type", "t.nextActionDue")


@query("write_gradings", "SELECT run_id, assertion_id, passed, evidence, skill, iteration, mode FROM expectations", shapes="expectations")
def write_gradings(spark, sf):
    path = scratch_path(spark, "gradings")
    K.write_gradings(expectations(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("run_id", "assertion_id", "passed", "evidence", "skill", F.col("iteration").cast("int").alias("iteration"), "mode")


@query(
    "write_summary",
    "SELECT run_id, count_if(coalesce(passed, false)) AS prog_passed, count(passed) AS prog_total, max(body_words) AS body_words FROM expectations GROUP BY ALL",
    shapes="expectations",
)
def write_summary(spark, sf):
    path = scratch_path(spark, "summary")
    K.write_summary(expectations(spark, sf), path)
    back = spark.read.schema("run_id bigint, prog_passed bigint, prog_total bigint, body_words bigint").json(path)
    return back


@query(
    "write_scorecard",
    f"SELECT run_id, prog_passed, prog_total, qual_passed, qual_total, pending, words FROM scores",
    shapes="scores",
)
def write_scorecard(spark, sf):
    path = scratch_path(spark, "graded")
    K.write_gradings(expectations(spark, sf), path)
    paths = K.write_scorecard(spark.read.parquet(path), scratch_path(spark, "scorecard"))
    return spark.read.parquet(paths["per_eval"]).select(
        "run_id", "prog_passed", "prog_total", "qual_passed", "qual_total", "pending", "words"
    )


@query(
    "archive_delta",
    "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages WHERE NOT contains(url, 'example.com')",
)
def archive_delta(spark, sf):
    pages = S.table(spark, sf, "pages")
    manifest = pages.filter(F.contains("url", F.lit("example.com"))).select("page_id")
    return K.archive_delta(pages, manifest, "page_id", F.col("html"))


@query(
    "upsert_metrics",
    """
WITH t AS (SELECT user_id, count(*) AS posts, max(ts) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
b AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE count(*) END AS posts, max(ts) AS seen FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT coalesce(t.user_id, b.user_id) AS user_id, coalesce(b.posts, t.posts) AS posts, coalesce(b.seen, t.seen) AS seen
FROM t FULL JOIN b ON t.user_id = b.user_id
""",
    times="seen",
)
def upsert_metrics(spark, sf):
    e = S.table(spark, sf, "events")
    old, new = e.filter("ts < TIMESTAMP '2024-01-15'"), e.filter("ts >= TIMESTAMP '2024-01-15'")
    agg = [F.count(F.lit(1)).alias("posts"), F.max("ts").alias("seen")]
    batch = new.groupBy("user_id").agg(*agg).withColumn("posts", F.when(F.col("user_id") % 3 != 0, F.col("posts")))
    return K.upsert_metrics(old.groupBy("user_id").agg(*agg), batch, "user_id")


@query(
    "upsert_metrics_table",
    """
WITH b AS (SELECT user_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS n FROM events),
g AS (SELECT user_id, n, CASE WHEN user_id % 3 <> n THEN count(*) END AS posts, max(ts) AS seen FROM b GROUP BY 1, 2)
SELECT user_id, arg_max(posts, n) FILTER (posts IS NOT NULL) AS posts, max(seen) AS seen FROM g GROUP BY 1
""",
    times="seen",
)
def upsert_metrics_table(spark, sf):
    """Three batches of scraped figures merged into a keyed table; what a later one lacks stays."""
    e = S.table(spark, sf, "events")
    part = F.when(F.col("ts") < "2024-01-10", 0).when(F.col("ts") < "2024-01-20", 1).otherwise(2)
    figures = e.groupBy("user_id", part.alias("n")).agg(F.count(F.lit(1)).alias("posts"), F.max("ts").alias("seen"))
    figures = figures.withColumn("posts", F.when(F.col("user_id") % 3 != F.col("n"), F.col("posts")))
    held = KeyedTable(spark, scratch_path(spark, "metrics"), ["user_id"], figures.drop("n").schema)
    for n in range(3):
        held.upsert(figures.filter(F.col("n") == n).drop("n"), n, fill=True, unique=True)
    return held.read()


@query(
    "landed_records",
    "SELECT slug, org, status, touch_count + CASE WHEN status = 'responded' THEN 100 ELSE 0 END AS touch_count, created FROM prospects",
    shapes="prospects",
    dates="created",
)
def landed_records(spark, sf):
    """A folder with a note per prospect is landed, some notes are rewritten, and what changed is landed again."""
    notes, at = scratch_path(spark, "notes"), scratch_path(spark, "landed")
    p = S.prospects(spark, sf)
    names = [c for c, _ in schemas.PROSPECT if c in p.columns]

    def put(rows):
        text = rows.select("slug", R.render_record(names).alias("text"))
        K.write_files(text, "slug", notes, "overwrite")
        return L.land(spark, notes, at, "*.txt")

    put(p)
    put(p.filter("status = 'responded'").withColumn("touch_count", F.col("touch_count") + 100))
    slug = F.concat(F.regexp_extract("path", "slug=([^/]+)/", 1), F.lit(".md"))
    return R.parse_records(L.landed(spark, at).withColumn("path", slug), schemas.PROSPECT).select("slug", "org", "status", "touch_count", "created")


@query(
    "archive_media",
    "SELECT page_id, CAST(octet_length(encode(html)) + 1 AS BIGINT) AS bytes, sha256(html || chr(10)) AS sha256, CAST(CASE WHEN contains(url, 'example.com') THEN 1 ELSE 2 END AS INTEGER) AS run FROM pages",
)
def archive_media(spark, sf):
    """Files of pages arrive in two parts; the second run opens the second part alone."""
    media, at = scratch_path(spark, "media"), scratch_path(spark, "manifest")
    pages = S.table(spark, sf, "pages")
    first = F.contains("url", F.lit("example.com"))
    runs = []
    for part in (first, ~first):
        K.write_files(pages.filter(part).select("page_id", "html"), "page_id", media)
        K.archive_media(spark, media, at, "*.txt")
        runs.append(cut_lineage(L.table(spark, at, texts=False).read().select("path")).withColumn("run", F.lit(len(runs) + 1)))
    held = L.table(spark, at, texts=False).read()
    seen = runs[0].unionByName(runs[1]).groupBy("path").agg(F.min("run").alias("run"))
    page = F.regexp_extract("path", "page_id=([0-9]+)/", 1).cast("bigint").alias("page_id")
    return held.join(seen, "path").select(page, F.col("size").alias("bytes"), "sha256", "run")
