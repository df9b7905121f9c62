"""Required runs are sure, and the index finds what every pattern finds alone."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from fieldnote.functions import patterns as P
from fieldnote.operators import grading as G
from fieldnote.plans import shapes as S
from fieldnote.session import local_table


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("of the of", ("of the of",)), ("token[ ]*=", ("token",)), ("was[a-z]* on", ("was",)), ("[0-9][0-9]", None), ("[0-9]+%", None),
        ("colou?r", ("colo",)), ("ab+cd", ("ab",)), ("abc{2,3}de", ("ab",)), (r"\bgame[- ]changer\b", ("changer",)), ("cat|doge", ("cat", "doge")), ("cat|d", None),
        ("(?:in|on) time", (" time",)), ("(?i)abc", None), (r"abc\Qx.y\E", None), ("a(?=bcd)", None), ("straße", ("stra",)), (r"1\.5 kg", ("1.5 kg",)), ("ab*?cd", ("cd",)),
        ("x++yz", ("yz",)), ("[]a]bc", None), ("", None), (r"ab\p{L}cd", None), ("ab\\", None), ("K{2}", None), (r"a\|b", ("a|b",)), ("^Dear all$", ("dear all",)),
    ],
)
def test_required_runs(pattern, want):
    assert P.required(pattern) == want


_piece = st.sampled_from(["ab", "c", "de ", "x?", "y*", "z+", "[ab]", "[^c]", "(?:fg|h)", "(ij)?", ".", r"\d", r"\.", "k{0,2}", "l|m", "no|pq"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_piece, min_size=1, max_size=5), st.text(alphabet="abcdefghijklmnopqxyz .12", max_size=30))
def test_every_match_holds_a_required_run(pieces, text):
    pattern = "".join(pieces)
    runs = P.required(pattern)
    hit = re.search(pattern, text, re.I)
    if runs and hit:
        assert any(r in text.lower() for r in runs)


PATTERNS = ["film", "colou?r", "[0-9]{3}", "was[a-z]* on", "strasse|straße", "kiss", "i\\.t", "É", "the (?:end|start)", "^dear"]
TEXTS = ["A FILM in colour", 'He said "film" on 123', "waſ on", "STRASSE", "straße", "Kiſs", "I.T", "İ.T", "ı.t", "é", "The End of", "dear all\nfilm", "", "nothing", "\u212aiss", None, "x" * 50_000 + " film"]


def test_the_index_equals_each_pattern_alone(spark):
    """Against the pattern searched by itself, case ignored in all scripts; quoted spans count for bans that look at quotes."""
    rows = [("s", f"a{i}", "A", "programmatic", rule, [p], None, None, q, None) for i, p in enumerate(PATTERNS) for rule, q in (("regex_absent", False), ("regex_present", None))]
    rows += [("s", "all", "A", "programmatic", "regex_absent", PATTERNS + [None], None, None, True, None), ("s", "other", "A", "programmatic", "regex_absent", ["film"], None, None, False, "e2")]
    rules = local_table(spark, rows, S.ASSERTION_SCHEMA)
    runs = spark.createDataFrame([("s", 1, f"e{i % 3}", "baseline", i, t) for i, t in enumerate(TEXTS)], "skill string, iteration int, eval string, mode string, run_id int, text string")
    got = {}
    for r in G.grade(runs, rules).collect():
        got.setdefault((r["run_id"], r["assertion_id"]), []).append((r["passed"], r["evidence"]))
    body = G.text_metrics(runs)
    for i, p in enumerate(PATTERNS):
        alone = body.select("run_id", F.when(F.col("body").rlike(f"(?iU:{p})"), F.regexp_extract("body", f"(?iU:{p})", 0)).alias("hit"), F.col("body").isNull().alias("none"))
        for r in alone.collect():
            if r["none"]:
                continue
            absent = (r["hit"] is None, "none of the banned patterns appeared" if r["hit"] is None else f"found: '{r['hit']}'")
            present = (r["hit"] is not None, "none of the required patterns matched" if r["hit"] is None else f"matched: {r['hit']}")
            assert sorted(got[r["run_id"], f"a{i}"]) == sorted([absent, present]), (p, TEXTS[r["run_id"]])
    assert got[1, "all"] == [(False, "found: '123'")]  # the quoted film does not count
    assert got[11, "all"] == [(False, "found: 'film', 'dear'")]
    assert {k[0] for k in got if k[1] == "other"} == {i for i in range(len(TEXTS)) if i % 3 == 2}


def test_no_pattern_is_compiled_per_row(spark):
    plan = G.run_scores(G.grade(S.runs(spark, SF), S.assertions(spark), S.priors(spark, SF)))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and not re.search(r"RLIKE\([^()]*, (?!\(\?|[a-z])", plan) and "regexp_like" not in plan.lower()


def test_one_class_per_definition(spark):
    rows = [("s", "a", "A", c, None, None, None, None, None, e) for c, e in (("programmatic", None), ("programmatic", "e1"), ("qualitative", "e1"), ("qualitative", "e2"))]
    rules = local_table(spark, rows, S.ASSERTION_SCHEMA)
    exp = spark.createDataFrame([("s", "e1", "a", 1), ("s", "e3", "a", 2), ("s", "e1", "b", 3)], "skill string, eval string, assertion_id string, run_id int")
    assert sorted((r["run_id"], r["check"]) for r in G.classify(exp, rules).collect()) == [(1, "programmatic"), (1, "qualitative"), (2, "programmatic")]
