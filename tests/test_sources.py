"""Readers and writers on small folders."""

import json

from conftest import rows
from fieldnote import schemas
from fieldnote.operators import grading as G
from fieldnote.operators.contacts import deadlines, status_counts
from fieldnote.sources import records as R
from fieldnote.sources import sinks as K
from fieldnote.sources.catalog import rules, tiers

PROSPECT = '---\norg: "Acme"\nstatus: contacted\ntouch_count: {}\nlast_contact: "{}"\nnext_followup: ""\n---\n\n# Acme\nstatus: closed\n'


def test_scan_records(spark, tmp_path):
    (tmp_path / "acme.md").write_text(PROSPECT.format(3, "2024-01-02"))
    (tmp_path / "odd-one.md").write_text(PROSPECT.format("many", "unknown"))
    (tmp_path / "bare.md").write_text("no front matter\nstatus: ready\n")
    df = R.scan_records(spark, str(tmp_path))
    got = {r.slug: r for r in df.collect()}
    assert set(got) == {"acme", "odd-one", "bare"}
    a, b, c = got["acme"], got["odd-one"], got["bare"]
    assert (a.org, a.status, a.touch_count, str(a.last_contact), a.next_followup) == ("Acme", "contacted", 3, "2024-01-02", None)
    assert (b.touch_count, b.last_contact, b.last_contact_raw) == (None, None, "unknown")
    assert (c.org, c.status) == (None, None)
    assert rows(status_counts(df).select("status", "records")) == [("contacted", 2)]


def test_scan_funders(spark, tmp_path):
    text = '---\nfunder: "{}"\nfocus_areas: [health, "media"]\ndeadline: "{}"\nstatus: research\n---\n'
    for i, d in enumerate(["unknown", "2024-05-01", "2024-01-01", ""]):
        (tmp_path / f"f{i}.md").write_text(text.format(f"F{i}", d))
    df = R.scan_records(spark, str(tmp_path), schemas.FUNDER)
    assert df.filter("slug = 'f0'").first().focus_areas == ["health", "media"]
    assert [r.funder for r in deadlines(df).collect()] == ["F2", "F1", "F0"]


SPEC = {
    "skill_name": "mail",
    "universal_assertions": [{"id": "u", "text": "U", "check": "programmatic", "rule": "regex_absent", "patterns": ["film"]}],
    "evals": [
        {"id": 1, "name": "cold", "fixture_assertions": [{"id": "f", "text": "F", "check": "programmatic", "rule": "word_count", "min": 2, "max": 9},
                                                         {"id": "q", "text": "Q", "check": "qualitative"}]},
        {"id": 2, "name": "warm", "fixture_assertions": []},
    ],
}


def write_harness(root):
    skill = root / "mail"
    skill.mkdir(parents=True)
    (skill / "evals.json").write_text(json.dumps(SPEC))
    for it, ev, mode, text in [(2, "cold", "baseline", "old"), (10, "cold", "with_skill", "a film note"), (10, "cold", "baseline", "Subject: x\n\nthree short words"), (10, "warm", "baseline", "x")]:
        d = skill / f"iteration-{it}" / ev / mode
        d.mkdir(parents=True)
        (d / "output.md").write_text(text)
    base = skill / "iteration-10" / "cold"
    (base / "baseline" / "grading.json").write_text(
        json.dumps({"expectations": [{"text": "Q", "assertion_id": "q", "passed": True, "evidence": "fine"}]}, indent=2)
    )
    (base / "with_skill" / "grading.json").write_text('{"expectations": [')
    return skill


def test_harness_end_to_end(spark, tmp_path):
    skill = write_harness(tmp_path)
    specs = spark.read.schema(schemas.SPEC).json(str(skill / "evals.json"), multiLine=True)
    rules_ = R.scan_specs(spark, str(skill / "evals.json"))
    assert rows(rules_.select("eval", "assertion_id", "check")) == [
        ("cold", "f", "programmatic"), ("cold", "q", "qualitative"), (None, "u", "programmatic"),
    ]
    runs = R.scan_runs(spark, str(skill / "iteration-*" / "*" / "*" / "output.md"))
    latest = G.latest_iteration(runs)
    assert {r.iteration for r in latest.collect()} == {10}
    full = G.with_missing(latest, G.expected_grid(R.spec_evals(specs), latest))
    assert rows(full.filter("error IS NOT NULL").select("eval", "mode", "error")) == [
        ("warm", "with_skill", "output missing: mail/iteration-10/warm/with_skill")
    ]
    prior = R.scan_gradings(spark, str(skill / "iteration-*" / "*" / "*" / "grading.json"))
    assert prior.count() == 1
    graded = G.grade(latest, rules_, prior)
    got = {(r.eval, r.mode, r.assertion_id): (r.passed, r.evidence) for r in graded.collect()}
    assert got[("cold", "with_skill", "u")] == (False, "found: 'film'")
    assert got[("cold", "baseline", "q")] == (True, "fine")
    assert got[("cold", "with_skill", "q")] == (None, G.PENDING)
    assert got[("cold", "baseline", "f")] == (True, "3 words (range 2-9)")
    assert len(got) == 7

    out = str(tmp_path / "graded")
    K.write_gradings(graded, out)
    K.write_gradings(graded, out)
    assert spark.read.parquet(out).count() == 7
    K.write_summary(graded, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 3
    paths = K.write_scorecard(graded, str(tmp_path / "card"))
    assert set(paths) == {"aggregate", "per_eval", "failures", "cross_skill"}
    assert spark.read.parquet(paths["per_eval"]).count() == 3


def test_gradings_overwrite_only_their_partition(spark, tmp_path):
    cols = "skill string, iteration int, mode string, run_id string, assertion_id string, passed boolean"
    a = spark.createDataFrame([("s", 1, "baseline", "r", "x", True), ("s", 2, "baseline", "r", "x", True)], cols)
    b = spark.createDataFrame([("s", 2, "baseline", "r", "x", False)], cols)
    K.write_gradings(a, str(tmp_path / "g"))
    K.write_gradings(b, str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g")).select("iteration", "passed")) == [(1, True), (2, False)]


def test_scan_entity(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "touches": [{"date": "2024-01-02", "type": "call"}]}, {"id": 2}]))
    df = R.scan_entity(spark, "contacts", str(tmp_path / "c.json"), multi_line=True)
    assert rows(df.selectExpr("id", "size(touches)", "CAST(touches[0].date AS STRING)")) == [(1, 1, "2024-01-02"), (2, None, None)]


def test_ledger_and_archive(spark, tmp_path):
    cols = "date string, amount int"
    for part in ([("2024-01-05", 1), ("2024-02-01", 2)], [("2024-01-31", 3)]):
        K.append_ledger(spark.createDataFrame(part, cols).selectExpr("CAST(date AS DATE) AS date", "amount"), str(tmp_path / "l"))
    assert rows(spark.read.parquet(str(tmp_path / "l")).groupBy("month").sum("amount")) == [("2024-01", 4), ("2024-02", 2)]

    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.bin")).selectExpr("split_part(path, '/', -1) AS post_id", "content")
    known = spark.createDataFrame([("b.bin",)], "post_id string")
    got = K.archive_delta(files, known, "post_id", files.content).collect()
    assert [(r.post_id, r.bytes, r.sha256[:8]) for r in got] == [("a.bin", 3, "ba7816bf")]


def test_upsert_keeps_known_values(spark):
    t = spark.createDataFrame([(1, 5, 7), (2, 6, 8)], "id int, likes int, views int")
    b = spark.createDataFrame([(2, None, 9), (3, 1, 1)], "id int, likes int, views int")
    assert rows(K.upsert_metrics(t, b, "id")) == [(1, 5, 7), (2, 6, 9), (3, 1, 1)]


def test_catalog(spark):
    assert rows(tiers(spark).selectExpr("key", "CAST(floor AS INT)", "offered")) == [
        ("embedding", 4000, False), ("program", 3000, True), ("story", 1500, True),
    ]
    assert rules(spark).filter("rule = 'pause_days'").first().amount == 5
