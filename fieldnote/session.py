"""Session settings and the shared scratch folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators were planned for.  Skewed join keys are split by AQE even when
# that costs one more exchange, because a hot contact may hold a third of all rows.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A task per named file is too many when thousands of small files are opened by name.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cpus: int | str = "*", app: str = "fieldnote", **extra: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    shuffles = "8" if cpus == "*" else str(cpus)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": shuffles, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_fieldnote_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._fieldnote_dir = path
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet, inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint of ``df`` in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A short list of definitions as a table the optimizer knows to be small.

    It travels as one literal, which keeps building the plan cheap.
    """
    fields = [f.strip().rsplit(" ", 1) for f in re.split(r",(?![^(]*\))", schema)]
    kind = "array<struct<" + ", ".join(f"`{n}`: {t}" for n, t in fields) + ">>"
    text = json.dumps([dict(zip((n for n, _ in fields), row)) for row in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), kind)))


# Texts that a few files hold are dealt to all cores below this size; larger ones stay where they are read.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on expensive per-row work over a small input, which may be one unsplittable file.

    An input beyond ``SPREAD_BYTES`` (by the planner's size) is never moved.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


# Rows and bytes a definition table may have and still be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast once its rows and bytes were counted and found few; a larger table is
    returned as it is and joined by shuffling, where AQE splits skewed keys."""
    head = df.limit(BROADCAST_ROWS + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = head.agg(F.count(F.lit(1)), F.sum("n")).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df
