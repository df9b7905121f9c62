"""Python workers: how they find this package where it is installed at the driver's path, and what they give back."""

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

ROOT = str(Path(__file__).resolve().parents[2])


def ready(df: DataFrame) -> DataFrame:
    """``df``, for a Python step to follow.  A package shipped with --py-files is found as well."""
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, *paths]))
    return df


def give_back() -> None:
    """Returns what freed arrays and columns held to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back what it freed: workers wait for later tasks, also of other steps."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
