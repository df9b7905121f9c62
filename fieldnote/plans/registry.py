"""Named queries over the bound tables, each with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from fieldnote.plans.shapes import SHAPE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Dates and instants as ISO text, so that result sets compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, shapes: str = "", dates: str = "", times: str = ""):
    """Register ``name``.  ``shapes`` lists the stand-in tables the SQL text reads;
    ``dates`` and ``times`` list result columns shown as ISO text."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: present(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = compose(sql, shapes, dates, times)
        return fn

    return wrap


def compose(sql: str, shapes: str, dates: str = "", times: str = "") -> str:
    ctes = [f"{s} AS ({SHAPE_SQL[s].strip()})" for s in _closure(shapes.split())]
    swaps = [f"CAST({d} AS VARCHAR) AS {d}" for d in dates.split()]
    swaps += [f"strftime({t}, '%Y-%m-%d %H:%M:%S') AS {t}" for t in times.split()]
    body = sql.strip()
    if ctes and body.upper().startswith("WITH "):
        ctes.append(body[5:].strip())
        text = "WITH " + ",\n".join(ctes)
    else:
        text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
    if swaps:
        text = f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{text}\n) AS shown"
    return text


# Which stand-in tables a stand-in table reads.
_NEEDS = {
    "bodies": ["runs"],
    "measured": ["bodies"],
    "checked": ["measured", "assertions"],
    "fresh": ["checked"],
    "expectations": ["fresh", "priors"],
    "scores": ["expectations"],
    "totals": ["scores"],
    "shown": ["totals"],
    "codes": ["turns"],
    "duels": ["bouts"],
    "sides": ["bouts"],
}


def _closure(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in _NEEDS.get(n, []):
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


MODULES = ["text_queries", "contact_queries", "finance_queries", "survey_queries", "signal_queries", "pair_queries", "governance_queries", "stream_queries"]
