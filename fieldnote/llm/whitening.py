"""Whitening of embeddings by their leading principal components.

Entries become whole numbers x = floor(scale * c) + shift, so that sums are exact.  Two passes of
partial sums give the mean and the covariance (divisor n, centred before multiplying: n*x - S is exact and is
divided by n once).  The covariance, a table of dimension x dimension numbers, is brought to tridiagonal
form by Householder reflections at the driver; bisection on Sturm counts finds the leading
eigenvalues, inverse iteration their vectors, made orthogonal within clusters of close eigenvalues;
the reflections turn these back.  The components are broadcast and every vector is projected.

Scale: a task adds up its rows in numpy and passes on one row per dimension, whatever it has read;
these are summed in slices first and then by dimension.  No row is shuffled, so no key can be hot.  The driver, a task and the
broadcast hold dimension^2 doubles (2 MB for 512 dimensions); work at the driver is its cube.  The
projected rows are written to the shared folder once, and their covariance is measured there.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those of
another length than most rows have (ties: the longer) and those with an entry beyond 2^52 / scale, whose x no
double holds; a null or repeated id is kept as it is; a component without variance (its eigenvalue not above
rounding, 1e-13 of the largest) has a null ``whitened`` and is left out of ``identity_error``; fewer dimensions than ``components`` give as many
as there are; an empty table gives an empty result; other columns are ignored, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.workers import ready
from fieldnote.session import scratch_path

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
LARGEST = 1 << 52
# Entries of a piece of a batch that is worked on at once; slices into which partial sums go first.
PIECE, SLICES = 1 << 20, 32
# Eigenvalues closer than this share of the norm are one cluster; below ROUNDING of the largest there is no variance.
CLOSE, ROUNDING = 1e-3, 1e-13


# ---- eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that bring ``a`` to that form."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.sqrt((x**2).sum())
        u = x.copy()
        u[0] += size if x[0] >= 0 else -size
        norm = np.sqrt((u**2).sum())
        u = u / norm if norm > 0 else np.zeros_like(u)
        mirrors.append(u)
        p = a[k + 1 :, k + 1 :] @ u
        q = p - (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1 :, k] -= 2 * u * (u @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return a.diagonal().copy(), a.diagonal(-1).copy(), mirrors


def counts_below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each number."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    out = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < least, -least, q)
        out += q < 0
    return out


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of all of them at once."""
    n = len(d)
    reach = np.zeros(n)
    reach[1:] += np.abs(e)
    reach[:-1] += np.abs(e)
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    wide = 1e-3 * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - wide, high + wide
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    for _ in range(120):
        middle = (low + high) / 2
        above = counts_below(d, e, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        if ((high - low) <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """y of (T - shift) y = b by elimination with row exchanges; a pivot is ``floor`` at least."""
    n = len(d)
    u, v, w, b = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    low = e.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(u[i]):
            u[i], v[i], w[i], low[i], u[i + 1], v[i + 1] = low[i], u[i + 1], v[i + 1], u[i], v[i], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(u[i]) < floor:
            u[i] = floor
        ratio = low[i] / u[i]
        u[i + 1] -= ratio * v[i]
        v[i + 1] -= ratio * w[i]
        b[i + 1] -= ratio * b[i]
    if abs(u[-1]) < floor:
        u[-1] = floor
    for i in range(n - 1, -1, -1):
        rest = b[i] - (v[i] * b[i + 1] if i + 1 < n else 0) - (w[i] * b[i + 2] if i + 2 < n else 0)
        b[i] = rest / u[i]
        big = np.abs(b[i:]).max()
        if big > 1e150:  # the direction is all that counts
            b /= big
    return b


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors (as columns) by inverse iteration, orthogonal within clusters of close values."""
    n = len(d)
    norm = max(np.abs(d).max() + (2 * np.abs(e).max() if len(e) else 0), np.finfo(float).tiny)
    floor = np.finfo(float).eps * norm
    out, first = np.zeros((n, len(values))), 0
    rng = np.random.default_rng(11)
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            first = j
        shift = value if j == first else min(value, shift - 10 * floor)  # equal shifts give equal vectors
        y = rng.standard_normal(n)
        for _ in range(6):
            y = _solve(d, e, shift, y / np.sqrt((y**2).sum()), floor)
            for _ in range(2):
                for i in range(first, j):
                    y -= (out[:, i] @ y) * out[:, i]
        out[:, j] = y / np.sqrt((y**2).sum())
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``a``, falling, and their unit eigenvectors as columns; of
    each the entry of largest size is positive."""
    k = min(k, len(a))
    if not a.any():
        return np.zeros(k), np.eye(len(a))[:, :k]
    d, e, mirrors = tridiagonal(a)
    values = leading(d, e, k)
    z = vectors(d, e, values)
    for i in range(len(mirrors) - 1, -1, -1):
        u = mirrors[i]
        z[i + 1 :] -= 2 * np.outer(u, u @ z[i + 1 :])
    z /= np.sqrt((z**2).sum(0))
    sign = np.sign(z[np.abs(z).argmax(0), np.arange(k)])
    return values, z * np.where(sign == 0, 1, sign)


# ---- distributed sums


def usable(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and v of the rows whose vector is whole."""
    v = F.col(f"`{vector}`")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST / scale)) & (F.size(v) > 0)
    return table.select(F.col(f"`{key}`").alias("id"), v.alias("v")).filter(F.coalesce(sound, F.lit(False)))


def _whole(column: pa.Array, scale: int, shift: int) -> Iterator[np.ndarray]:
    """x of the vectors of a batch, in pieces of rows."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    step = max(1, PIECE // flat.shape[1])
    for i in range(0, len(flat), step):
        yield np.floor(scale * flat[i : i + step]).astype(np.int64) + shift


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: as whole numbers of 64 bits where they fit, else of any size."""
    top = max(map(abs, sums), default=0)
    if int(np.abs(x).max(initial=0)) * n + top < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _total(partial: DataFrame, dims: int) -> DataFrame:
    """place, sums: the rows (task, place, sums array<double>) added up by place, in the order of the tasks."""
    kind = "slice int, task int, place int, sums array<double>"

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        rows = np.asarray(table["sums"].combine_chunks().flatten(), np.float64).reshape(len(table), -1)
        return pa.table([table["slice"][:1], table["task"][:1], table["place"][:1], pa.array([rows.sum(0)])], names=["slice", "task", "place", "sums"])

    sliced = partial.select((F.col("task") % SLICES).alias("slice"), "task", "place", "sums")
    once = sliced.groupBy("slice", "place").applyInArrow(add, kind)
    return once.groupBy("place").applyInArrow(add, kind).select("place", "sums")


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of x of every dimension (two halves of x are summed, so that nothing overflows)."""

    def run(batches):
        n, high, low = 0, 0, 0
        for b in batches:
            for x in _whole(b.column("v"), scale, shift):
                n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([high]), pa.array([low])], names=["n", "high", "low"])

    partial = rows.select("v").mapInArrow(run, "n long, high array<long>, low array<long>")
    each = partial.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("place", "x"))
    wide = "decimal(38,0)"
    found = each.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("x.high").cast(wide)).alias("high"), F.sum(F.col("x.low").cast(wide)).alias("low"))
    got = found.orderBy("place").collect()  # one row per dimension
    return (int(got[0]["n"]), [(int(r["high"]) << 26) + int(r["low"]) for r in got]) if got else (0, [])


def products(rows: DataFrame, of, dims: int) -> np.ndarray:
    """Sum over all rows of the products of the centred entries; ``of`` yields them from a batch."""

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            for c in of(b):
                total += c.T @ c
        yield pa.RecordBatch.from_arrays(
            [pa.array([_task()] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            names=["task", "place", "sums"],
        )

    partial = rows.mapInArrow(run, "task int, place int, sums array<double>")
    out = np.zeros((dims, dims))
    for r in _total(partial, dims).collect():  # one row per dimension
        out[r["place"]] = r["sums"]
    return (out + out.T) / 2


# ---- whitening


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> dict:
    """n, sums, eigenvalues, components (as columns) and trace of ``usable`` rows."""
    n, s = sums(rows, scale, shift)
    if not n:
        return {"n": 0, "sums": [], "values": np.zeros(0), "vectors": np.zeros((0, 0)), "trace": 0.0}

    def of(batch):
        for x in _whole(batch.column("v"), scale, shift):
            yield (_centred(x, n, s) / n).astype(np.float64)

    v = products(rows.select("v"), of, len(s)) / n
    values, found = eigen(v, components)
    return {"n": n, "sums": s, "values": values, "vectors": found, "trace": float(np.trace(v))}


def project(rows: DataFrame, model: dict, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, deviation and w (null where a component has no variance) of every row."""
    n, s, values = model["n"], model["sums"], model["values"]
    some = values > ROUNDING * max(values.max(initial=0), 0)
    spread = rows.sparkSession.sparkContext.broadcast(model["vectors"] / np.sqrt(np.where(some, values, 1)))

    def run(batches):
        for b in batches:
            at = 0
            for x in _whole(b.column("v"), scale, shift):
                c = _centred(x, n, s)
                w = (c / n).astype(np.float64) @ spread.value
                top = float(np.abs(c).max(initial=0))
                square = c**2 if top * top * max(1, x.shape[1]) < 2.0**62 else c.astype(object) ** 2
                deviation = pa.array([str(d) for d in square.sum(1).tolist()])
                flat = pa.array(w.ravel(), mask=np.tile(~some, len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * len(some), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(w)), deviation, lists], names=["id", "deviation", "w"])
                at += len(w)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation string, w array<double>")


def identity_error(projected: DataFrame, n: int, values: np.ndarray) -> float:
    """The largest entry of the covariance of w, centred before multiplying, less the identity."""
    some = np.flatnonzero(values > ROUNDING * max(values.max(initial=0), 0))
    if not len(some):
        return 0.0
    held = projected.select(F.array(*[F.get("w", F.lit(int(i))) for i in some]).alias("w"))
    row = held.agg(*[F.avg(F.get("w", F.lit(i))) for i in range(len(some))]).first()
    mean = np.array(row)

    def of(batch):
        yield np.asarray(batch.column("w").flatten(), np.float64).reshape(batch.num_rows, -1) - mean

    return float(np.abs(products(held, of, len(some)) / n - np.eye(len(some))).max())


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``key``, component (from 1), n, deviation (decimal), whitened, explained and identity_error of every row that takes part."""
    spark = table.sparkSession
    rows = usable(ready(table), key, vector, scale)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("v") == (usual[0]["d"] if usual else 0))
    model = fit(rows, components, scale, shift)
    path = scratch_path(spark, "whitened")
    project(rows, model, scale, shift).write.parquet(path)
    done = spark.read.parquet(path)
    error = identity_error(done, model["n"], model["values"])
    trace = model["trace"]
    explained = F.array(*[F.lit(float(v / trace) if trace else 0.0) for v in model["values"]]).cast("array<double>")
    each = done.select(F.col("id").alias(key), F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return each.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
