"""Dated rules: what holds on a day."""

import pytest
from pyspark.sql import functions as F

from fieldnote.operators import finance as M
from fieldnote.session import local_table
from fieldnote.sources.catalog import DATED_SCHEMA, RuleBook


def on(spark, book, rule, *days):
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    return [None if r[0] is None else float(r[0]) for r in df.select(book.amount(rule, F.col("d"))).collect()]


def test_the_row_in_force(spark):
    rows = [("r", "2", "2024-03-01"), ("r", "1", "2024-01-01"), ("r", "3", "2024-03-01"), ("s", "5", None), ("s", "6", "2024-02-01")]
    book = RuleBook.of(local_table(spark, rows, DATED_SCHEMA))
    assert on(spark, book, "r", "2023-12-31", "2024-01-01", "2024-02-29", "2024-03-01", "2030-01-01", None) == [None, 1, 1, 3, 3, None]
    assert on(spark, book, "s", "1900-01-01", "2024-02-01", None) == [5, 6, 5]
    with pytest.raises(KeyError):
        book.amount("none", F.col("d"))


def test_a_changed_row_counts_from_its_day_on(spark):
    ledger = spark.createDataFrame(
        [("2024-01-10", "income", 100), ("2024-02-10", "income", 100), ("2024-02-20", "income", 100), ("2024-02-25", "expense", 10)], "d string, kind string, a int"
    ).selectExpr("CAST(d AS DATE) AS date", "kind", "CAST(a AS DECIMAL(18,2)) AS amount")
    held = lambda book: [float(r["reserve"]) for r in M.reserve(ledger, book.amount("reserve_rate", F.col("date"))).orderBy("month").collect()]
    assert held(RuleBook.fixed()) == [30.0, 60.0] == [float(r["reserve"]) for r in M.reserve(ledger).orderBy("month").collect()]
    assert held(RuleBook.fixed([("reserve_rate", "0.40", "2024-02-15")])) == [30.0, 70.0]
