"""Text expressions on small inline rows, against a plain reading of their rules."""

import re

import pytest
from pyspark.sql import functions as F

from fieldnote.functions import text as T

MAILS = [
    "Subject: Hello\nTo: you\n\nDear you,\nsome text\n\nBest,\nMe",
    "  to: you\r\n\r\nfirst\r\nCC: other\r\nsecond\r\n-- \r\nrest",
    "no header here\nThanks,\nstays",
    "a\nb\nc\nd\ne\nf\ng\nfrom: eighth line\nbody\nRegards,\nx",
    "a\nb\nc\nd\ne\nf\ng\nh\nfrom: ninth line\nbody\nRegards,\nx",
    "From: x\n\n\n---\nafter",
    "From: x\nhello\n— Ada\nafter",
    "From: x\nhello - not a signature\n- item\nend",
    "From: x\nhello world, with spaces first\nBEST REGARDS,\nafter",
    "line with spaces\nanother one\nSubject: third\nkept",
    "",
    "   \n\t ",
    "To: only",
    " Subject: nbsp first\nbody Warmly,\ngone",
]


# What stays of each sample, written out by hand.
BODIES = [
    "Dear you,\nsome text",
    "first\nsecond",
    "no header here\nThanks,\nstays",
    "a\nb\nc\nd\ne\nf\ng\nbody",
    "a\nb\nc\nd\ne\nf\ng\nh\nfrom: ninth line\nbody\nRegards,\nx",
    "",
    "hello",
    "hello - not a signature\n- item\nend",
    "hello world, with spaces first",
    "line with spaces\nanother one\nkept",
    "",
    "",
    "",
    "body",
]


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}")
    return [r[1] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_extract_body(spark):
    assert one(spark, MAILS, lambda c: T.extract_body(c, ["Ada"])) == BODIES


def test_whole_text_beyond_the_first_lines(spark):
    long = "Subject: x\n" + "\n".join(f"line {i}" for i in range(5000)) + "\nBest,\nMe"
    assert one(spark, [long], T.extract_body)[0].endswith("line 4999")


def test_words_and_lines(spark):
    texts = ["", "  ", "one", "a b c", "a\x1cb", "a\n\n \nb\r\nc\x85d", "　x y"]
    assert one(spark, texts, T.word_total) == [0, 0, 1, 3, 2, 4, 2]
    assert one(spark, texts, T.line_total) == [0, 0, 1, 1, 2, 4, 1]


def test_strip_quotes(spark):
    texts = ['say "film" now', "don't say 'film' isn't", "“film” and ‘film’", 'open " only', "it's a 'b' c's"]

    stripped = ["say   now", "don film t", "  and  ", 'open " only', "it b s"]
    assert one(spark, texts, T.strip_quotes) == stripped


def test_front_matter_and_links(spark):
    note = '---\ntitle: x\nstatus: ready\n---\n> **Canonical:** here\n\n\nSee [[A|the b]] and [[C]].\n'
    assert one(spark, [note], T.strip_front_matter) == ["> **Canonical:** here\n\n\nSee [[A|the b]] and [[C]].\n"]
    assert one(spark, [note], T.snapshot_body) == ["See the b and C.\n"]
    plain = "text\n---\nnot: matter\n---\n> **Canonical:** kept\n"
    assert one(spark, [plain], T.snapshot_body) == [plain]
    assert one(spark, ["---\n---\nbody"], T.strip_front_matter) == ["body"]


def test_fields_and_labels(spark):
    text = 'org: "Acme & Co"\nstatus: ready\nempty: ""\n'
    assert one(spark, [text], lambda c: T.fm_field(c, "org")) == ["Acme & Co"]
    assert one(spark, [text], lambda c: T.fm_field(c, "empty")) == [None]
    assert one(spark, [text], lambda c: T.fm_field(c, "tatus")) == [None]
    assert one(spark, ["Acme & Co. (North)"], T.slugify) == ["acme--co-north"]
    assert one(spark, ["", None, "x"], T.or_dash) == ["--", "--", "x"]


@pytest.mark.parametrize(
    "text,low,high",
    [("$5K-50K", 5000, 50000), ("$1,500", 1500, 1500), ("2.5k to 1M", 2500, 1000000), ("unknown", None, None), ("", None, None)],
)
def test_range_parts(spark, text, low, high):
    r = one(spark, [text], T.range_parts)[0]
    assert (r.low, r.high) == (low, high)


def test_sync_header(spark):
    old = "> **Canonical source:** mine, last synced 2020-01-02 daily"
    assert one(spark, [old], lambda c: T.sync_header(c, F.lit("p"), "2024-05-06")) == [old.replace("2020-01-02", "2024-05-06")]
    assert one(spark, ["# x"], lambda c: T.sync_header(c, F.lit("p"), "2024-05-06"))[0].startswith("> **Canonical source:** `p`")


def test_take_and_daily(spark):
    t = one(spark, ["Acme_2024-03-04_P7_Take12", "odd"], T.take_parts)
    assert (t[0].client, str(t[0].shot_on), t[0].participant, t[0].take) == ("Acme", "2024-03-04", "P7", 12)
    assert (t[1].client, t[1].shot_on, t[1].take) == ("odd", None, None)
    d = one(spark, ["2026-04-04 | held breath | calm | a | b"], T.daily_parts)[0]
    assert (str(d.day), d.body, d.state, d.residue) == ("2026-04-04", "held breath", "calm", "a | b")


def test_replace_terms(spark):
    terms = [("Old Name", "new $name"), ("name", "label")]
    assert one(spark, ["OLD NAME, old name"], lambda c: T.replace_terms(c, terms)) == ["new $label, new $label"]
    assert one(spark, ["OLD NAME, old name"], lambda c: T.term_hits(c, terms)) == [4]
