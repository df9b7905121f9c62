"""Bucketed running values against a plain loop, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from fieldnote.functions import ordered as O
from fieldnote.operators.signals import held_weeks


def make(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None])
        ts = None if rnd.random() < 0.03 else rnd.randrange(60)
        out.append((key, ts, i, None if rnd.random() < 0.4 else rnd.randrange(-9, 9)))
    return out


def loop(data):
    """Expected columns per id; nulls sort first, as in Spark."""
    groups, out = {}, {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total, top, last, prev = None, None, None, None
        for n, r in enumerate(rs, 1):
            v = r[3]
            before = (top, last)
            if v is not None:
                total, last = (total or 0) + v, v
                top = v if top is None else max(top, v)
            after = rs[n][3] if n < len(rs) else None
            out[r[2]] = (n, total, before[0], top, last, before[1], prev, after)
            prev = v
    return out


@pytest.mark.parametrize("heavy", [10**6, 150, 0])
@pytest.mark.parametrize("seed,width", [(1, 7), (2, 1), (3, 1000)])
def test_running_equals_loop(spark, monkeypatch, seed, width, heavy):
    """No heavy key, only the hot one, or all of them."""
    monkeypatch.setattr(O, "HEAVY_ROWS", heavy)
    data = make(seed)
    v = F.col("v")
    df = spark.createDataFrame(data, "k string, ts int, id int, v int").repartition(5)
    got = O.running(
        df, ["k"], ["ts", "id"], F.floor(F.col("ts") / width),
        [O.RowNumber("n"), O.RunningSum("s", v), O.RunningMax("m", v), O.RunningMax("mi", v, inclusive=True),
         O.LastValue("l", v), O.LastValue("lx", v, inclusive=False), O.Previous("p", v), O.Following("f", v)],
    ).collect()
    assert {r.id: (r.n, r.s, r.m, r.mi, r.l, r.lx, r.p, r.f) for r in got} == loop(data)


def test_heavy_keys_are_exact(spark, monkeypatch):
    df = spark.createDataFrame(make(1), "k string, ts int, id int, v int")
    assert O.heavy_keys(df, ["k"]) is None
    monkeypatch.setattr(O, "HEAVY_ROWS", 150)
    assert [r.k for r in O.heavy_keys(df, ["k"]).collect()] == ["hot"]
    monkeypatch.setattr(O, "HEAVY_ROWS", 0)
    assert O.heavy_keys(df, ["k"]).count() == df.select("k").distinct().count()


def test_both_paths_have_the_same_types(spark):
    df = spark.createDataFrame(make(1), "k string, ts int, id int, v int").withColumn("d", F.col("v").cast("decimal(18,2)"))
    plain, cut = (O.running(df, ["k"], ["ts", "id"], F.col("ts"), [O.RunningSum("s", F.col("d"))], split=x) for x in (False, True))
    assert plain.schema == cut.schema and dict(plain.dtypes)["s"] == "decimal(38,2)"


def test_running_without_key(spark):
    df = spark.range(1000).repartition(7)
    got = O.running(df, [], ["id"], F.floor(F.col("id") / 50), [O.RowNumber("n")])
    assert got.filter("n <> id + 1").count() == 0 and got.count() == 1000


def test_islands(spark):
    feel = "hhhnhhhhhnnh"
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(feel)], "k string, i int, f string")
    got = O.islands(df, ["k"], ["i"], F.floor(F.col("i") / 2), F.col("f") == "h", "run").groupBy("run").count()
    assert sorted(r["count"] for r in got.collect()) == [1, 3, 5]


def test_held_weeks_breaks_on_a_missing_week(spark):
    weeks = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-29", "2024-02-05"]
    df = spark.createDataFrame([("a", w, 2) for w in weeks], "k string, w string, n int").selectExpr("k", "CAST(w AS DATE) AS week", "n")
    got = held_weeks(df, F.col("n") >= 2, 3, ["k"]).collect()
    assert [(str(r.from_week), str(r.to_week), r.weeks) for r in got] == [("2024-01-01", "2024-01-15", 3)]
