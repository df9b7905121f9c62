"""Stand-ins: the given tables seen as runs, contacts, touches, ledgers, signals and bouts.

Every shape exists twice, as a DataFrame and as SQL text, from the same arithmetic on the
same columns.  All of them are narrow projections; joins are left to the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote.session import local_table, spread

AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31"

SHAPE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _shift(base: str, days: str) -> str:
    return f"CAST(date_add(DATE'{base}', CAST({days} AS INTEGER)) AS DATE)"


# --- text runs -------------------------------------------------------------------------
SHAPE_SQL["runs"] = """
SELECT doc_id AS run_id, lang AS skill, CAST(doc_id % 12 + 1 AS INTEGER) AS iteration,
       'iteration-' || (doc_id % 12 + 1) AS iteration_name, source AS eval,
       CASE WHEN (doc_id // 20) % 2 = 0 THEN 'with_skill' ELSE 'baseline' END AS mode,
       CASE WHEN doc_id % 3 = 0
            THEN 'Subject: note ' || doc_id || chr(10) || 'To: someone' || chr(10) || chr(10) || text
                 || chr(10) || chr(10) || 'Best,' || chr(10) || 'A. Signer'
            ELSE text END AS text
FROM documents
"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs_of(spread(table(spark, sf, "documents")))


def runs_of(documents: DataFrame) -> DataFrame:
    mail = "concat('Subject: note ', doc_id, '\\nTo: someone\\n\\n', text, '\\n\\nBest,\\nA. Signer')"
    return documents.selectExpr(
        "doc_id AS run_id",
        "lang AS skill",
        "CAST(doc_id % 12 + 1 AS INT) AS iteration",
        "concat('iteration-', doc_id % 12 + 1) AS iteration_name",
        "source AS eval",
        "CASE WHEN (doc_id DIV 20) % 2 = 0 THEN 'with_skill' ELSE 'baseline' END AS mode",
        f"CASE WHEN doc_id % 3 = 0 THEN {mail} ELSE text END AS text",
    )


# Assertion definitions: id, text, check, rule, patterns, min, max, quote_aware, eval.
ASSERTIONS = [
    ("no_stock_words", "Avoids the stock phrases and anything that looks like a pasted key or token line",
     "programmatic", "regex_absent", ["of the of", "token[ ]*=", "was[a-z]* on"], None, None, None, None),
    ("names_subject", "Names a subject", "programmatic", "regex_present",
     ["with the [a-z]+", "on [a-z]+tion"], None, None, None, None),
    ("length_ok", "Body has a sensible length", "programmatic", "word_count", None, 20, 200, None, None),
    ("reads_well", "Reads well", "qualitative", None, None, None, None, None, None),
    ("is_civil", "Stays civil", "qualitative", None, None, None, None, None, None),
    ("layout_ok", "Keeps to a few lines", "programmatic", "line_count", None, 1, 12, None, None),
    ("is_brief", "Stays brief", "programmatic", "word_count_max", None, None, 120, None, None),
    ("body_length", "Body has the older length", "programmatic", "word_count_body", None, 60, 150, None, None),
    ("has_tone", "Has the right tone", "programmatic", "tone", None, None, None, None, None),
    ("no_numbers", "Has no long numbers, quoted or not", "programmatic", "regex_absent",
     ["[0-9][0-9][0-9]", "[0-9]+%"], None, None, False, "src5"),
    ("is_fresh", "Says something new", "qualitative", None, None, None, None, None, "src6"),
]
SKILLS = ["de", "en", "es", "fr"]
ASSERTION_SCHEMA = (
    "skill string, assertion_id string, assertion string, check string, rule string, "
    "patterns array<string>, min int, max int, quote_aware boolean, eval string"
)


def assertions(spark: SparkSession, sf: str = "") -> DataFrame:
    rows = [(s, *a) for s in SKILLS for a in ASSERTIONS]
    return local_table(spark, rows, ASSERTION_SCHEMA)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, list):
        return "[" + ", ".join(_lit(x) for x in v) + "]"
    return "'" + v.replace("'", "''") + "'"


SHAPE_SQL["assertions"] = (
    "SELECT s.skill, a.* FROM (VALUES "
    + ", ".join("(" + ", ".join(_lit(v) for v in a) + ")" for a in ASSERTIONS)
    + ") AS a(assertion_id, assertion, \"check\", rule, patterns, \"min\", \"max\", quote_aware, eval)"
    + " CROSS JOIN (VALUES "
    + ", ".join(f"('{s}')" for s in SKILLS)
    + ") AS s(skill)"
)

SHAPE_SQL["priors"] = """
SELECT doc_id AS run_id, 'reads_well' AS assertion_id, quality = 1 AS passed, 'read' AS evidence, 1 AS seq FROM labels
UNION ALL
SELECT doc_id, 'is_civil', CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 0 END, 'checked', 1 FROM labels
UNION ALL
SELECT doc_id, 'is_civil', toxic = 0, 'checked again', 2 FROM labels WHERE doc_id % 7 = 0
"""


def priors(spark: SparkSession, sf: str) -> DataFrame:
    row = "struct({} AS assertion_id, {} AS passed, {} AS evidence, {} AS seq)"
    items = ", ".join(
        [
            row.format("'reads_well'", "quality = 1", "'read'", "1"),
            row.format("'is_civil'", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 0 END", "'checked'", "1"),
            row.format("IF(doc_id % 7 = 0, 'is_civil', NULL)", "toxic = 0", "'checked again'", "2"),
        ]
    )
    return (
        table(spark, sf, "labels")
        .selectExpr("doc_id AS run_id", f"inline(array({items}))")
        .filter("assertion_id IS NOT NULL")
    )


# Grading in SQL: the mail body, then every rule, then the earlier grades.
SHAPE_SQL["bodies"] = """
SELECT * EXCLUDE (lines, kept, is_mail, stop),
       CASE WHEN is_mail THEN trim(array_to_string(CASE WHEN stop > 0 THEN kept[1:stop-1] ELSE kept END, chr(10)), chr(10) || chr(13) || chr(9) || ' ')
            ELSE trim(text, chr(10) || chr(13) || chr(9) || ' ') END AS body
FROM (
  SELECT *, coalesce(list_position(list_transform(kept, lambda x: regexp_matches(lower(trim(x)),
            '^([-—]+\\s*$|(best,|warmly,|thanks,|sincerely,|regards,|best regards,)$)')), true), 0) AS stop
  FROM (
    SELECT *, len(list_filter(lines[1:8], lambda x: regexp_matches(lower(trim(x)), '^(to:|subject:|from:)'))) > 0 AS is_mail,
           list_filter(lines, lambda x: NOT regexp_matches(lower(trim(x)), '^(to:|subject:|cc:|bcc:|from:)')) AS kept
    FROM (SELECT *, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS lines FROM runs)))
"""
SHAPE_SQL["measured"] = """
SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '"[^"]*"', ' ', 'g'),
            '''[^'']*''', ' ', 'g'), '“[^”]*”', ' ', 'g'), '‘[^’]*’', ' ', 'g') AS unquoted,
       CAST(len(regexp_extract_all(body, '\\S+')) AS BIGINT) AS words,
       CAST(len(list_filter(regexp_split_to_array(body, '\\r\\n|\\n|\\r'), lambda x: trim(x) <> '')) AS BIGINT) AS lines
FROM bodies
"""
SHAPE_SQL["checked"] = """
SELECT m.*, a.* EXCLUDE (skill, eval),
       CASE WHEN a.rule = 'regex_absent' THEN list_transform(list_filter(a.patterns, lambda p:
                 regexp_matches(CASE WHEN coalesce(a.quote_aware, true) THEN m.unquoted ELSE m.body END, p, 'i')),
                 lambda p: '''' || regexp_extract(CASE WHEN coalesce(a.quote_aware, true) THEN m.unquoted ELSE m.body END, p, 0, 'i') || '''')
            WHEN a.rule = 'regex_present' THEN list_transform(list_filter(a.patterns, lambda p: regexp_matches(m.body, p, 'i')),
                 lambda p: regexp_extract(m.body, p, 0, 'i')) END AS hits
FROM measured m LEFT JOIN assertions a ON a.skill = m.skill AND (a.eval IS NULL OR a.eval = m.eval)
"""
SHAPE_SQL["fresh"] = """
SELECT skill, iteration, eval, mode, run_id, assertion_id, assertion AS text, "check",
       CASE WHEN "check" = 'qualitative' OR assertion_id IS NULL THEN NULL
            WHEN rule = 'regex_absent' THEN len(hits) = 0 WHEN rule = 'regex_present' THEN len(hits) > 0
            WHEN rule = 'word_count' THEN words BETWEEN coalesce("min", 0) AND coalesce("max", 10000)
            WHEN rule = 'line_count' THEN lines BETWEEN coalesce("min", 0) AND coalesce("max", 10000)
            WHEN rule = 'word_count_max' THEN words <= "max" ELSE false END AS passed,
       CASE WHEN assertion_id IS NULL THEN NULL WHEN "check" = 'qualitative' THEN 'pending_llm_grade'
            WHEN rule = 'regex_absent' THEN CASE WHEN len(hits) = 0 THEN 'none of the banned patterns appeared'
                 ELSE 'found: ' || array_to_string(hits, ', ') END
            WHEN rule = 'regex_present' THEN CASE WHEN len(hits) > 0 THEN 'matched: ' || hits[1]
                 ELSE 'none of the required patterns matched' END
            WHEN rule = 'word_count' THEN words || ' words (' || CASE WHEN words BETWEEN coalesce("min", 0) AND coalesce("max", 10000)
                 THEN 'range ' ELSE 'outside range ' END || coalesce("min", 0) || '-' || coalesce("max", 10000) || ')'
            WHEN rule = 'line_count' THEN lines || ' lines (' || CASE WHEN lines BETWEEN coalesce("min", 0) AND coalesce("max", 10000)
                 THEN 'range ' ELSE 'outside range ' END || coalesce("min", 0) || '-' || coalesce("max", 10000) || ')'
            WHEN rule = 'word_count_max' THEN words || ' words (' || CASE WHEN words <= "max" THEN '<= ' ELSE '> ' END || "max" || ')'
            ELSE 'unknown rule: ' || rule END AS evidence,
       words AS body_words, lines AS body_lines
FROM checked
"""
SHAPE_SQL["expectations"] = """
SELECT f.* REPLACE (CASE WHEN f."check" = 'qualitative' AND p.run_id IS NOT NULL THEN p.passed ELSE f.passed END AS passed,
                    CASE WHEN f."check" = 'qualitative' AND p.run_id IS NOT NULL THEN p.evidence ELSE f.evidence END AS evidence)
FROM fresh f LEFT JOIN (
  SELECT * FROM priors WHERE passed IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id, assertion_id ORDER BY seq DESC) = 1) p
  ON p.run_id = f.run_id AND p.assertion_id = f.assertion_id
"""
SHAPE_SQL["scores"] = """
SELECT skill, iteration, eval, mode, run_id,
       count_if("check" = 'programmatic' AND coalesce(passed, false)) AS prog_passed, count_if("check" = 'programmatic') AS prog_total,
       count_if("check" = 'qualitative' AND coalesce(passed, false)) AS qual_passed, count_if("check" = 'qualitative') AS qual_total,
       count_if(passed IS NULL AND assertion_id IS NOT NULL) AS pending, max(body_words) AS words
FROM expectations GROUP BY ALL
"""
SHAPE_SQL["totals"] = """
SELECT skill, mode, count(*) AS runs, CAST(sum(prog_passed) AS BIGINT) AS prog_passed, CAST(sum(prog_total) AS BIGINT) AS prog_total,
       CAST(sum(qual_passed) AS BIGINT) AS qual_passed, CAST(sum(qual_total) AS BIGINT) AS qual_total,
       CAST(sum(words) AS DOUBLE) / count(words) AS mean_words
FROM scores GROUP BY ALL
"""
SHAPE_SQL["shown"] = """
SELECT skill, mode, runs, prog_passed, prog_total, qual_passed, qual_total,
       CASE WHEN prog_total = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * prog_passed / prog_total, 1) END AS prog_pct,
       CASE WHEN qual_total = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * qual_passed / qual_total, 1) END AS qual_pct,
       coalesce(round_even(mean_words, 0), 0.0::DOUBLE) AS words
FROM totals
"""


# --- contacts and touches ---------------------------------------------------------------
# Each pair below is the same list of expressions in both dialects; they differ only in the
# spelling of array literals and integer division.
_PROSPECT = {
    "id": "c_custkey",
    "slug": "'customer' || right(c_name, 9)",
    "org": "c_name",
    "contact": "'Contact ' || c_custkey",
    "status": "CASE c_mktsegment WHEN 'BUILDING' THEN 'research' WHEN 'AUTOMOBILE' THEN 'ready' "
    "WHEN 'HOUSEHOLD' THEN 'contacted' WHEN 'MACHINERY' THEN 'responded' "
    "ELSE CASE WHEN c_acctbal < 0 THEN 'passed' ELSE 'closed' END END",
    "touch_count": "CAST(c_custkey % 7 AS INTEGER)",
    "created": _shift("1995-01-01", "c_custkey % 1000"),
    "last_contact": f"CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_shift('1997-01-01', 'c_custkey * 13 % 1700')} END",
    "next_followup": "CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_custkey % 3 <> 0 "
    f"THEN {_shift('1997-01-04', 'c_custkey * 13 % 1700')} "
    f"WHEN c_mktsegment = 'AUTOMOBILE' THEN {_shift('2000-06-01', 'c_custkey % 600')} END",
    "source": "CASE WHEN c_custkey % 4 = 0 THEN 'referral-from-' || CAST(c_custkey / 4 AS BIGINT) ELSE 'research' END",
    "angle": "CASE c_nationkey % 5 WHEN 0 THEN 'health' WHEN 1 THEN 'media' WHEN 2 THEN 'metabolism' "
    "WHEN 3 THEN 'equity' END",
    "segment": "CASE c_nationkey % 4 WHEN 0 THEN 'rebuilder' WHEN 1 THEN 'container-builder' "
    "WHEN 2 THEN 'emergent-practitioner' ELSE 'undocumented' END",
}
_FUNDER = {
    "slug": "'supplier' || right(s_name, 9)",
    "funder": "s_name",
    "type": "CASE s_nationkey % 3 WHEN 0 THEN 'foundation' WHEN 1 THEN 'government' ELSE 'corporate' END",
    "grant_range": "'$' || (s_suppkey % 9 + 1) || 'K-' || ((s_suppkey % 9 + 1) * 10) || 'K'",
    "deadline_raw": "CASE s_suppkey % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL "
    f"ELSE CAST({_shift('2001-05-01', 's_suppkey * 7 % 300')} AS VARCHAR(10)) END",
    "deadline": f"CASE WHEN s_suppkey % 10 > 1 THEN {_shift('2001-05-01', 's_suppkey * 7 % 300')} END",
    "status": "CASE s_nationkey % 6 WHEN 0 THEN 'research' WHEN 1 THEN 'loi-prep' WHEN 2 THEN 'submitted' "
    "WHEN 3 THEN 'reviewed' WHEN 4 THEN 'awarded' ELSE 'declined' END",
    "next_action": "'step ' || (s_suppkey % 4)",
    "angle": "CASE s_nationkey % 4 WHEN 0 THEN 'health' WHEN 1 THEN 'media' WHEN 2 THEN 'metabolism' ELSE 'equity' END",
}
_TOUCH = {
    "touch_id": "o_orderkey",
    "contact_id": "o_custkey",
    "date": "CAST(o_orderdate AS DATE)",
    "type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'call' WHEN '2-HIGH' THEN 'meeting' "
    "WHEN '3-MEDIUM' THEN 'email-sent' WHEN '4-NOT SPECIFIED' THEN 'stewardship-touch' ELSE 'proposal-sent' END",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'contacted' WHEN 'F' THEN 'responded' ELSE 'research' END",
    "note": "'order ' || o_orderkey",
}


def _columns(spec: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{c}"' for c, e in spec.items())


def _project(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS `{c}`" for c, e in spec.items()])


SHAPE_SQL["prospects"] = f"SELECT {_columns(_PROSPECT)} FROM customer"
SHAPE_SQL["funders"] = f"SELECT {_columns(_FUNDER)} FROM supplier"
SHAPE_SQL["touches"] = f"SELECT {_columns(_TOUCH)} FROM orders"


def prospects(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "customer"), _PROSPECT)


def funders(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "supplier"), _FUNDER)


def touches(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "orders"), _TOUCH)


# Contacts with their touches nested: two per contact, from arithmetic on the key.
SHAPE_SQL["nested"] = f"""
SELECT c_custkey AS id, [
  {{'date': {_shift('2001-03-01', 'c_custkey % 150')}, 'type': CASE WHEN c_nationkey % 3 = 0 THEN 'stewardship-touch' ELSE 'call' END,
   'note': 'first', 'nextAction': 'write', 'nextActionDue': CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_shift('2001-06-01', 'c_custkey % 120')} END}},
  {{'date': {_shift('2001-04-01', 'c_custkey % 120')}, 'type': 'stewardship-touch',
   'note': 'second', 'nextAction': NULL, 'nextActionDue': NULL}}] AS touches
FROM customer
"""


def nested(spark: SparkSession, sf: str) -> DataFrame:
    first = (
        f"named_struct('date', {_shift('2001-03-01', 'c_custkey % 150')}, 'type', "
        "CASE WHEN c_nationkey % 3 = 0 THEN 'stewardship-touch' ELSE 'call' END, 'note', 'first', 'nextAction', 'write', "
        f"'nextActionDue', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_shift('2001-06-01', 'c_custkey % 120')} END)"
    )
    second = (
        f"named_struct('date', {_shift('2001-04-01', 'c_custkey % 120')}, 'type', 'stewardship-touch', "
        "'note', 'second', 'nextAction', CAST(NULL AS STRING), 'nextActionDue', CAST(NULL AS DATE))"
    )
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", f"array({first}, {second}) AS touches")


# --- ledger, projects, invoices -------------------------------------------------------------
_LEDGER = {
    "project": "l_orderkey",
    "client": "l_suppkey",
    "line": "l_linenumber",
    "date": "CAST(l_shipdate AS DATE)",
    "kind": "CASE l_linestatus WHEN 'O' THEN 'income' ELSE 'expense' END",
    "scope": "CASE l_returnflag WHEN 'N' THEN 'personal' ELSE 'business' END",
    "category": "CASE l_linenumber % 5 WHEN 0 THEN 'software' WHEN 1 THEN 'travel' WHEN 2 THEN 'meals' "
    "WHEN 3 THEN 'equipment' ELSE 'shipping' END",
    "tier": "CAST(l_partkey % 3 + 1 AS INTEGER)",
    "amount": "CAST(l_extendedprice AS DECIMAL(18,2))",
    "logged_on": "CAST(date_add(CAST(l_shipdate AS DATE), CAST(l_quantity AS INTEGER) % 12) AS DATE)",
    "receipt": "CASE WHEN l_discount > 0.05 THEN NULL ELSE 'r' END",
}
_PROJECT = {
    "project": "o_orderkey",
    "client": "o_custkey",
    "tier": "CAST(o_orderkey % 3 + 1 AS INTEGER)",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'proposed' END",
    "started": "CAST(o_orderdate AS DATE)",
    "ended": "CAST(date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 45 + 5 AS INTEGER)) AS DATE)",
    "value": "CAST(o_totalprice AS DECIMAL(18,2))",
    "hours": "CAST(o_orderkey % 200 + 20 AS DECIMAL(18,2))",
    "mission": "CASE o_orderpriority WHEN '5-LOW' THEN false WHEN '3-MEDIUM' THEN NULL ELSE true END",
    "discount_pct": "CAST(CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 35 ELSE 0 END AS INTEGER)",
    "price": "CAST(o_orderkey % 9000 AS DECIMAL(18,2))",
    "segment": "CASE o_orderkey % 4 WHEN 0 THEN 'rebuilder' WHEN 1 THEN 'container-builder' "
    "WHEN 2 THEN 'emergent-practitioner' ELSE 'undocumented' END",
    "override": "CASE o_orderkey % 10 WHEN 0 THEN true WHEN 1 THEN false END",
    "flexible": "o_orderkey % 7 = 0",
    "energy": "CAST(o_orderkey % 10 + 1 AS INTEGER)",
    "due_on": "CAST(date_add(CAST(o_orderdate AS DATE), 30) AS DATE)",
    "paid": "o_orderstatus = 'F'",
}
SHAPE_SQL["ledger"] = f"SELECT {_columns(_LEDGER)} FROM lineitem"
SHAPE_SQL["projects"] = f"SELECT {_columns(_PROJECT)} FROM orders"
SHAPE_SQL["tiers"] = (
    "SELECT * FROM (VALUES (1, 'story', 'rebuilder', 1500::DECIMAL(18,2), 2500::DECIMAL(18,2)), "
    "(2, 'program', 'container-builder', 3000, 8000), (3, 'embedding', 'emergent-practitioner', 4000, 8000)) "
    "AS t(tier, key, segment, floor, ceiling)"
)


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "lineitem"), _LEDGER)


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "orders"), _PROJECT)


# --- survey, coded turns, signals -----------------------------------------------------------
_RESPONSE = {
    "project": "l_orderkey",
    "point": "CASE l_linestatus WHEN 'F' THEN 'baseline' ELSE 'final' END",
    "stakeholder": "CASE l_returnflag WHEN 'A' THEN 'leadership' WHEN 'N' THEN 'staff' ELSE 'funders' END",
    "question": "'q' || (l_linenumber % 3 + 1)",
    "item": "'i' || l_linenumber",
    "score": "CAST(l_quantity AS INTEGER) % 10 + 1",
    "participant": "l_partkey",
    "org": "l_partkey % 97",
    "region": "l_suppkey % 5",
    "program": "l_suppkey",
    "artifacts": "CAST(l_tax * 100 AS INTEGER)",
    "kit": "l_partkey",
    "engagement": "l_orderkey",
    "royal": "CAST(l_quantity AS INTEGER) % 10",
    "nomadic": "CAST(floor(l_extendedprice) AS BIGINT) % 10",
}
SHAPE_SQL["responses"] = f"SELECT {_columns(_RESPONSE)} FROM lineitem"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "lineitem"), _RESPONSE)


# Codes by pattern over the conversation turns.
CODES = {
    "fear-surface": "the of",
    "fear-underlying": "tion the",
    "fear-root": "ing [a-z]+ed",
    "fear-transformation": "and [a-z]+ion",
    "line-of-flight": "was",
    "self-correction": "that[, ]",
    "pause": "[.] [a-z]+[.]",
}
_TURN = {
    "client": "CAST(floor(conv_id / 10) AS BIGINT)",
    "session": "conv_id",
    "segment": "turn",
    "pos": "conv_id * 4294967296 + turn",
    "role": "role",
    "text": "text",
}
SHAPE_SQL["turns"] = f"SELECT {_columns(_TURN)} FROM conversations"
SHAPE_SQL["codes"] = " UNION ALL ".join(
    f"SELECT client, session, segment, pos, role, '{c}' AS code FROM turns WHERE regexp_matches(text, '{p}', 'i')"
    for c, p in CODES.items()
)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "conversations"), _TURN)


_SIGNAL = {
    "event_id": "event_id",
    "account": "user_id",
    "ts": "ts",
    "kind": "event_type",
    "type": "event_type",
    "topic": "'topic-' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 6)",
    "likes": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)",
    "comments": "event_id % 7",
    "views": "CAST(floor(value * 10) AS BIGINT) + 100",
    "engagements": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) + event_id % 7",
    "feel": "CASE WHEN value < 8 THEN 'heavy' WHEN value < 20 THEN 'neutral' WHEN value < 40 THEN 'light' ELSE 'flow' END",
}
SHAPE_SQL["signals"] = f"SELECT {_columns(_SIGNAL)} FROM events"


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "events"), _SIGNAL)


# --- bouts between the nations of supplier and customer; supplier tree -----------------------
_PHASES = ["P1", "P2", "P2c", "P2d", "P3", "P3b", "P1"]
_BOUT = {
    "a": "'nation-' || lpad(CAST(s_nationkey AS VARCHAR(3)), 2, '0')",
    "b": "'nation-' || lpad(CAST(c_nationkey AS VARCHAR(3)), 2, '0')",
    "phase": "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHASES, 1)) + " END",
    "date": "CAST(l_shipdate AS DATE)",
    "score_a": "CAST(l_quantity AS INTEGER) % 11",
    "score_b": "CAST(l_partkey % 11 AS INTEGER)",
    "killed": "l_returnflag = 'R'",
}
_BOUT_JOIN = (
    "lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey "
    "JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey"
)
SHAPE_SQL["bouts"] = (
    f"SELECT {_columns(_BOUT)}, list_filter([CASE WHEN l_partkey % 2 = 0 THEN 'K1' END, CASE WHEN l_partkey % 3 = 0 THEN 'K2' END, "
    f"CASE WHEN l_suppkey % 5 = 0 THEN 'K3' END], lambda x: x IS NOT NULL) AS criteria FROM {_BOUT_JOIN}"
)
SHAPE_SQL["duels"] = """
SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b THEN score_b ELSE score_a END AS score_a,
       CASE WHEN a > b THEN score_a ELSE score_b END AS score_b, phase, killed, date FROM bouts
"""
SHAPE_SQL["sides"] = """
SELECT a AS claim, b AS against, score_a AS score, phase, killed, date FROM bouts
UNION ALL SELECT b, a, score_b, phase, killed, date FROM bouts
"""
SHAPE_SQL["edges"] = (
    "SELECT CAST(floor(s_suppkey / 2) AS BIGINT) AS parent, s_suppkey AS child, CAST(s_suppkey % 50 AS BIGINT) AS born, "
    "CASE s_nationkey % 4 WHEN 0 THEN 'causal' WHEN 1 THEN 'precondition' WHEN 2 THEN 'complement' ELSE 'meta' END AS type "
    "FROM supplier WHERE s_suppkey > 1"
)


def bouts(spark: SparkSession, sf: str) -> DataFrame:
    joined = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .filter("s_nationkey <> c_nationkey")
    )
    criteria = (
        "array_compact(array(IF(l_partkey % 2 = 0, 'K1', NULL), IF(l_partkey % 3 = 0, 'K2', NULL), "
        "IF(l_suppkey % 5 = 0, 'K3', NULL))) AS criteria"
    )
    return joined.selectExpr(*[f"{e} AS `{c}`" for c, e in _BOUT.items()], criteria)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").filter("s_suppkey > 1").selectExpr(
        "CAST(floor(s_suppkey / 2) AS BIGINT) AS parent",
        "s_suppkey AS child",
        "CAST(s_suppkey % 50 AS BIGINT) AS born",
        "CASE s_nationkey % 4 WHEN 0 THEN 'causal' WHEN 1 THEN 'precondition' WHEN 2 THEN 'complement' ELSE 'meta' END AS type",
    )
