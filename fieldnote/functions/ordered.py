"""Running values per key that do not send a heavy key to one task.

A plain window sorts all rows of a key in one task, which breaks when one contact holds a
third of the data.  So the keys are counted first (one pass over the key columns, combined
per task).  Without heavy keys a plain window is all it takes.  Otherwise the rows of the
heavy keys, and only those, are cut into consecutive buckets: any expression that never
decreases along the order, such as the day of the event.  Windows then run inside a
(key, bucket) pair, and one pre-aggregated row per pair carries the state across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from fieldnote.session import cut_lineage, small

# A key is heavy above this many rows, whatever the size of the table.
HEAVY_ROWS = 1_000_000


@dataclass
class RowNumber:
    """1, 2, 3 ... along the order."""

    out: str


@dataclass
class RunningSum:
    """Sum up to and including the row."""

    out: str
    value: Column


@dataclass
class RunningMax:
    """Largest value of the rows before this one, or up to it when ``inclusive``."""

    out: str
    value: Column
    inclusive: bool = False


@dataclass
class LastValue:
    """Latest non-null value up to the row (``inclusive``) or before it."""

    out: str
    value: Column
    inclusive: bool = True


@dataclass
class Previous:
    """Value of the row before."""

    out: str
    value: Column


@dataclass
class Following:
    """Value of the row after."""

    out: str
    value: Column


# Any value will do: a separate flag tells it from a real one.
_STAND_IN = {"date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}


def _pair_keys(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Plain non-null columns that identify a (key, bucket) pair, nulls included.

    Grouping, join and window then ask for the same hash partitioning, so the rows are
    shuffled once.  A null-safe join condition would ask for another one.
    """
    kinds = dict(df.dtypes)
    cols = {f"_p{i}": F.coalesce(F.col(n), F.lit(_STAND_IN.get(kinds[n], "0")).cast(kinds[n])) for i, n in enumerate(names)}
    flags = sum((F.when(F.col(n).isNull(), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    return df.withColumns({**cols, "_nulls": flags}), [*cols, "_nulls"]


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with too many rows for one task; None if none.  They stay a table: nothing is collected."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = cut_lineage(counts.filter(F.col("_n") > HEAVY_ROWS).select(*keys))
    return None if found.isEmpty() else found


def _mark_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    """Flag the rows of heavy keys; a short list is broadcast, a long one joined by shuffling."""
    listed = small(heavy).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.lit(True).alias("_heavy"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return df.join(listed, same, "left").drop(*[f"_h{i}" for i in range(len(keys))])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    specs: Sequence,
    split: bool | None = None,
) -> DataFrame:
    """Add the columns named by ``specs``; ``order`` must be total within a key.

    ``split`` forces (True) or rules out (False) the cut into buckets for all keys; without
    keys the cut is always made.
    """
    cols = df.columns
    for i, s in enumerate(specs):
        if not isinstance(s, RowNumber):
            df = df.withColumn(f"_v{i}", s.value)
    if not keys or split:
        df = df.withColumn("_b", bucket).withColumn("_heavy", F.lit(True))
    else:
        heavy = heavy_keys(df, keys) if split is None else None
        if heavy is None:
            return _same_types(df, df.select(*cols, *_outputs(specs, list(keys), order, [F.lit(None)] * len(specs))), specs)
        df = _mark_heavy(df, keys, heavy)
        df = df.withColumn("_b", F.when(F.col("_heavy"), bucket))
    df, pair = _pair_keys(df, [*keys, "_b"])
    pairs = _carried(df.filter("_heavy"), len(keys), pair, order, specs)
    joined = df.join(pairs, pair, "left")
    out = joined.select(*cols, *_outputs(specs, pair, order, [F.col(f"_c{i}") for i in range(len(specs))]))
    return _same_types(df, out, specs)


def _same_types(df: DataFrame, out: DataFrame, specs: Sequence) -> DataFrame:
    """Decimal sums as wide as decimals get, on the split and on the plain path."""
    for i, s in enumerate(specs):
        kind = df.schema[f"_v{i}"].dataType if isinstance(s, RunningSum) else None
        if isinstance(kind, DecimalType):
            out = out.withColumn(s.out, F.col(s.out).cast(DecimalType(38, kind.scale)))
    return out


def _carried(df: DataFrame, width: int, pair: Sequence[str], order: Sequence[str], specs: Sequence) -> DataFrame:
    """Per (key, bucket) pair, the state that the earlier buckets of the key hand over."""
    key_cols, bucket_col = pair[:width], pair[width]
    rank = F.struct(*[F.col(c) for c in order])

    # A null bucket sorts first, as null order values do.
    owner = [*key_cols, F.col("_nulls").bitwiseAND((1 << width) - 1)]
    across = W.partitionBy(*owner).orderBy(F.col("_nulls").desc(), bucket_col)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    sums, carried = [], []
    for i, s in enumerate(specs):
        v = f"_v{i}"
        match s:
            case RowNumber():
                sums.append(F.count(F.lit(1)).alias(f"_s{i}"))
                carried.append(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)))
            case RunningSum():
                sums.append(F.sum(v).alias(f"_s{i}"))
                carried.append(F.sum(f"_s{i}").over(before))
            case RunningMax():
                sums.append(F.max(v).alias(f"_s{i}"))
                carried.append(F.max(f"_s{i}").over(before))
            case LastValue():
                kept = F.when(F.col(v).isNotNull(), rank)
                sums.append(F.max_by(F.col(v), kept).alias(f"_s{i}"))
                carried.append(F.last(f"_s{i}", ignorenulls=True).over(before))
            case Previous():
                sums.append(F.max_by(F.col(v), rank).alias(f"_s{i}"))
                carried.append(F.lag(f"_s{i}").over(across))
            case Following():
                sums.append(F.min_by(F.col(v), rank).alias(f"_s{i}"))
                carried.append(F.lead(f"_s{i}").over(across))
    pairs = df.groupBy(*pair).agg(*sums)
    return pairs.select(*pair, *[c.alias(f"_c{i}") for i, c in enumerate(carried)])


def _outputs(specs: Sequence, part: Sequence[str], order: Sequence[str], carried: Sequence[Column]) -> list[Column]:
    """Window expressions inside a partition, combined with what was carried into it."""
    inside = W.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    prior = inside.rowsBetween(W.unboundedPreceding, -1)
    first, last = F.row_number().over(inside) == 1, F.lead(F.lit(1)).over(inside).isNull()
    outs = []
    for i, (s, c) in enumerate(zip(specs, carried)):
        v = F.col(f"_v{i}")
        match s:
            case RowNumber():
                e = (F.coalesce(c, F.lit(0)) + F.row_number().over(inside)).cast("bigint")
            case RunningSum():
                e = F.sum(v).over(upto)
                e = F.when(c.isNull(), e).when(e.isNull(), c).otherwise(c + e)
            case RunningMax():
                e = F.greatest(c, F.max(v).over(upto if s.inclusive else prior))
            case LastValue():
                e = F.coalesce(F.last(v, ignorenulls=True).over(upto if s.inclusive else prior), c)
            case Previous():
                e = F.when(first, c).otherwise(F.lag(v).over(inside))
            case Following():
                e = F.when(last, c).otherwise(F.lead(v).over(inside))
        outs.append(e.alias(s.out))
    return outs


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, inside: Column, out: str
) -> DataFrame:
    """Number the unbroken stretches where ``inside`` holds; rows outside are dropped."""
    marked = df.withColumn("_in", F.when(inside, 1).otherwise(0).cast("bigint"))
    counted = running(
        marked, keys, order, bucket, [RowNumber("_n"), RunningSum("_m", F.col("_in"))]
    )
    return counted.filter("_in = 1").withColumn(out, F.col("_n") - F.col("_m")).drop("_in", "_n", "_m")
