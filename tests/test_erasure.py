"""Erasure rewrites the files that hold a person and no others."""

import os
from pathlib import Path

import pytest

from conftest import rows
from fieldnote.operators import erasure as E
from fieldnote.sources.files import Folder


@pytest.fixture
def table(spark, tmp_path):
    """Partitioned by day; the ids of a file are a run, so that few files hold one id."""
    path = str(tmp_path / "t")
    df = spark.range(200).selectExpr("id AS person", "concat('note ', id) AS note", "CAST(id % 2 AS STRING) AS `the day`", "CAST(id DIV 50 AS INT) AS part")
    for i in range(4):
        df.filter(f"part = {i}").drop("part").coalesce(1).write.mode("append").partitionBy("the day").parquet(path)
    return path


def stamps(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet") if "_erasure" not in str(p)}


def people(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "person long")


def test_only_files_with_the_person_change(spark, table, tmp_path):
    before, whole = stamps(table), rows(spark.read.parquet(table))
    audit = E.erase(spark, {"notes": (table, "person")}, people(spark, 3, 5, 120, 999, None), "person", "r1", str(tmp_path / "audit"))
    assert rows(audit.drop("request")) == [("notes", 8, 2, 3)]
    after = stamps(table)
    same = [p for p in before if after.get(p) == before[p]]
    assert len(same) == 6 and len(after) == 8
    assert rows(spark.read.parquet(table)) == [r for r in whole if r[0] not in (3, 5, 120)]
    again = E.erase(spark, {"notes": (table, "person")}, people(spark, 3), "person", "r2", str(tmp_path / "audit"))
    assert rows(again.drop("request")) == [("notes", 8, 0, 0)] and stamps(table) == after
    assert E.audit_table(spark, str(tmp_path / "audit")).read().count() == 2
    assert not os.listdir(f"{table}/_erasure") or all(n.startswith(".") for n in os.listdir(f"{table}/_erasure"))


def test_a_file_that_holds_nobody_else_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "person long, note string").coalesce(1).write.parquet(path)
    spark.createDataFrame([(2, "b"), (None, "c")], "person long, note string").coalesce(1).write.mode("append").parquet(path)
    audit = E.erase(spark, {"t": (path, "person")}, people(spark, 1), "person", "r", str(tmp_path / "audit"))
    assert rows(audit.drop("request", "name")) == [(2, 1, 1)] and rows(spark.read.parquet(path)) == [(2, "b"), (None, "c")]


@pytest.mark.parametrize("step", ["write", "move", "delete"])
def test_a_run_that_was_cut_off_is_finished(spark, table, tmp_path, monkeypatch, step):
    whole, args = rows(spark.read.parquet(table)), ({"notes": (table, "person")}, people(spark, 3, 120), "person")
    real, calls = getattr(Folder, step), []

    def fail(self, *a):
        if "_erasure" in str(a) or step == "delete":
            calls.append(a)
            if len(calls) == (2 if step != "write" else 1):
                raise OSError("cut off")
        return real(self, *a)

    with monkeypatch.context() as m:
        m.setattr(Folder, step, fail)
        with pytest.raises(OSError):
            E.erase(spark, *args, "r1", str(tmp_path / "audit"))
    E.erase(spark, *args, "r2", str(tmp_path / "audit"))
    assert rows(spark.read.parquet(table)) == [r for r in whole if r[0] not in (3, 120)]
