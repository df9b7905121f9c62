"""Rules, three-valued grades and scorecards on inline rows."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldnote.functions import rules as R
from fieldnote.operators import grading as G
from fieldnote.session import local_table

A = (
    "skill string, assertion_id string, assertion string, check string, rule string, "
    "patterns array<string>, min int, max int, quote_aware boolean, eval string"
)
RUN = "skill string, iteration int, eval string, mode string, run_id string, text string"


def rule(name, patterns=None, low=None, high=None, aware=None, id="a", check="programmatic", eval=None):
    return ("s", id, f"text of {id}", check, name, patterns, low, high, aware, eval)


def grade(spark, texts, *assertions, **kw):
    runs = spark.createDataFrame([("s", 1, "e", "baseline", f"r{i}", t) for i, t in enumerate(texts)], RUN)
    out = G.grade(runs, local_table(spark, list(assertions), A), **kw)
    return [(r.passed, r.evidence) for r in out.orderBy("run_id", "assertion_id").collect()]


def test_regex_absent(spark):
    got = grade(spark, ["A FILM here", 'only "film" quoted', "none", "Synergy and film"], rule("regex_absent", ["film(making)?", r"\bsynergy\b"]))
    clean = (True, "none of the banned patterns appeared")
    assert got == [(False, "found: 'FILM'"), clean, clean, (False, "found: 'film', 'Synergy'")]


def test_regex_absent_not_quote_aware(spark):
    assert grade(spark, ['only "film" quoted'], rule("regex_absent", ["film"], aware=False)) == [(False, "found: 'film'")]


def test_regex_present_reads_quotes(spark):
    got = grade(spark, ['say "film"', "nothing", ""], rule("regex_present", ["nope", "film"]))
    missing = (False, "none of the required patterns matched")
    assert got == [(True, "matched: film"), missing, missing]


def test_empty_match_passes(spark):
    assert grade(spark, ["abc"], rule("regex_present", ["x*"])) == [(True, "matched: ")]


def test_case_and_accents(spark):
    assert grade(spark, ["ÉPIC tale"], rule("regex_present", ["épic"])) == [(True, "matched: ÉPIC")]
    assert grade(spark, ["épic"], rule("regex_present", [r"\bpic\b"]))[0][0] is False


def test_counts(spark):
    assert grade(spark, ["a b c"], rule("word_count", low=2, high=3)) == [(True, "3 words (range 2-3)")]
    assert grade(spark, ["a b c"], rule("word_count")) == [(True, "3 words (range 0-10000)")]
    assert grade(spark, ["a b c"], rule("word_count", low=4)) == [(False, "3 words (outside range 4-10000)")]
    assert grade(spark, ["a b c"], rule("word_count_max", high=2)) == [(False, "3 words (> 2)")]
    assert grade(spark, ["", "a\n\n b"], rule("line_count", low=1, high=2)) == [
        (False, "0 lines (outside range 1-2)"), (True, "2 lines (range 1-2)"),
    ]


def test_unknown_and_legacy_rule(spark):
    assert grade(spark, ["a b"], rule("word_count_body", low=1, high=5)) == [(False, "unknown rule: word_count_body")]
    assert grade(spark, ["a b"], rule("word_count_body", low=1, high=5), legacy=True) == [(True, "2 words (range 1-5)")]


def test_own_rule(spark):
    R.register_rule("starts_upper", lambda: R.verdict(F.col("body").rlike("^[A-Z]"), F.lit("checked")))
    try:
        assert grade(spark, ["Abc", "abc"], rule("starts_upper")) == [(True, "checked"), (False, "checked")]
    finally:
        del R.RULES["starts_upper"]


def test_fixture_assertions_stay_with_their_eval(spark):
    assert len(grade(spark, ["a"], rule("word_count", id="u"), rule("word_count", id="f", eval="other"))) == 1


PRIOR = "run_id string, assertion_id string, passed boolean, evidence string, seq int"


def test_carry_forward_is_idempotent(spark):
    qual = rule(None, id="q", check="qualitative")
    prior = spark.createDataFrame(
        [("r0", "q", False, "old", 1), ("r0", "q", True, "newer", 2), ("r1", "q", None, G.PENDING, 1)], PRIOR
    )
    once = grade(spark, ["x", "y"], qual, prior=prior)
    assert once == [(True, "newer"), (None, G.PENDING)]
    again = spark.createDataFrame([("r0", "q", *once[0], 1), ("r1", "q", *once[1], 1)], PRIOR)
    assert grade(spark, ["x", "y"], qual, prior=again) == once


EXP = (
    "skill string, iteration int, eval string, mode string, run_id string, assertion_id string, "
    "text string, check string, passed boolean, evidence string, body_words bigint, body_lines bigint"
)


def exp(run, aid, check, passed, mode="with_skill", words=10):
    return ("s", 1, "e", mode, run, aid, f"text {aid}", check, passed, "x", words, 1)


def test_pending_stays_in_one_denominator_only(spark):
    df = spark.createDataFrame(
        [exp("r", "p", "programmatic", True), exp("r", "q", "qualitative", None), exp("r", "q2", "qualitative", True)], EXP
    )
    s = G.run_scores(df).first()
    assert (s.prog_passed, s.prog_total, s.qual_passed, s.qual_total, s.pending) == (1, 1, 1, 2, 1)
    p = G.programmatic_summary(df).first()
    assert (p.prog_passed, p.prog_total) == (2, 2)


def test_half_even_and_rounded_delta(spark):
    a = [exp(f"a{i}", "p", "programmatic", i < 13, "with_skill", 3) for i in range(16)]
    b = [exp(f"b{i}", "p", "programmatic", i < 11, "baseline", 2) for i in range(16)]
    totals = G.mode_totals(G.run_scores(spark.createDataFrame(a + b, EXP)))
    d = G.ab_delta(totals).first()
    assert (d.a_prog_pct, d.b_prog_pct, d.prog_delta) == (81.2, 68.8, 12.4)
    assert (d.a_qual_pct, d.qual_delta, d.words_delta, d.words_pct) == (0.0, 0.0, 1.0, 50.0)


def test_classify_counts_every_row_per_class(spark):
    df = spark.createDataFrame([exp("r", "x", None, True), exp("r", "x", None, True), exp("r", "gone", None, True)], EXP)
    rules = local_table(
        spark,
        [rule("word_count", id="x"), rule("word_count", id="x", eval="e"), rule(None, id="x", check="qualitative", eval="e")],
        A,
    )
    got = G.classify(df, rules).groupBy("check").count()
    assert rows(got) == [("programmatic", 2), ("qualitative", 2)]


def test_missing_mode_and_failures(spark):
    df = spark.createDataFrame([exp("r", "p", "programmatic", False), exp("r", "q", "qualitative", None)], EXP)
    pair = G.ab_pairs(G.run_scores(df), F.sum("prog_total")).first()
    assert (pair.with_skill, pair.baseline) == (1, None)
    f = G.failure_modes(df).first()
    assert (f.assertion_id, f.with_skill_fails, f.baseline_fails) == ("p", 1, 0)


@pytest.mark.parametrize("compat,want", [("numeric", 10), ("lexical", 2)])
def test_latest_iteration(spark, compat, want):
    df = spark.createDataFrame([("s", "iteration-2", 2), ("s", "iteration-10", 10)], "skill string, iteration_name string, n int")
    assert [r.n for r in G.latest_iteration(df, compat=compat).collect()] == [want]


def test_runs_without_assertions_and_missing_outputs_stay_in_summaries(spark):
    runs = spark.createDataFrame([("s", 1, "e", "baseline", "r1", "a film"), ("other", 1, "e", "baseline", "r2", "three words here")], RUN)
    missing = runs.limit(0).withColumn("error", F.lit("x")).unionByName(
        spark.createDataFrame([("s", 1, "e", "with_skill", "r3", None, "output missing: s/iteration-1/e/with_skill")], RUN + ", error string")
    )
    everything = runs.withColumn("error", F.lit(None).cast("string")).unionByName(missing)
    graded = G.grade(everything, local_table(spark, [rule("regex_absent", ["film"])], A))
    scores = {r.run_id: (r.prog_passed, r.prog_total, r.pending, r.words) for r in G.run_scores(graded).collect()}
    assert scores == {"r1": (0, 1, 0, 2), "r2": (0, 0, 0, 3), "r3": (0, 0, 0, None)}
    summary = {r.run_id: (r.prog_passed, r.prog_total, r.body_words) for r in G.programmatic_summary(graded).collect()}
    assert summary == {"r1": (0, 1, 2), "r2": (0, 0, 3), "r3": (0, 0, 0)}
