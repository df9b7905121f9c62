"""Streams over the same schemas as the batch operators, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote.operators.contacts import contact_state
from fieldnote.operators.grading import grade, settled
from fieldnote.session import scratch_path
from fieldnote.sources.files import Folder
from fieldnote.sources.keyed import KeyedTable


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of part files, and what lands in it; the schema is given, never inferred.

    Without ``per_trigger`` all that is there makes up the first micro-batch, so that a backlog
    gives the same result in however many files and in whatever order it lies.  With a limit, or for
    what lands later, rows behind the watermark do not count; ``drain_late`` keeps them.
    """
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    at = Folder(spark, path)
    if at.is_file():  # a stream reads folders: this file of its folder
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


# --- running a stream over what is there ------------------------------------------------
def drain_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run to the end of the input with the exactly-once file sink and read the result."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Merge the changed rows of each micro-batch into a keyed table and read that.

    A batch reads and rewrites the buckets that its keys fall into, however many batches there were; one that is run
    again changes nothing.
    """
    table = KeyedTable(stream.sparkSession, path, keys, stream.schema)

    def save(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, writer=checkpoint, unique=True)

    query = (
        stream.writeStream.foreachBatch(save)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()


def drain_late(touches: DataFrame, ends: Column, lateness: str, path: str, checkpoint: str) -> DataFrame:
    """Side table: the rows of ``touches`` (with ``ts``) that an operator with that lateness leaves
    out, because the window or session that a row would open, which ends at ``ends``, was closed
    when the row came.

    The latest ``ts`` of all batches so far is written beside the rows of each.  A batch is held against the
    watermark that closed windows at the end of the batch before it, which is made of the batches up to the one
    before that: of one earlier mark.
    """
    spark = touches.sparkSession
    marks = Folder(spark, f"{path}/marks")
    late = touches.withColumn("_ends", ends)

    def save(batch: DataFrame, number: int) -> None:
        def mark(n: int) -> DataFrame | None:
            return spark.read.schema("ts timestamp").parquet(f"{path}/marks/batch={n}") if marks.exists(f"batch={n}") else None

        rows = batch.withColumn("_mark", F.lit(None).cast("timestamp"))
        if closed := mark(number - 2):
            top = closed.agg(F.max("ts").alias("_top"))
            rows = batch.join(F.broadcast(top.select((F.col("_top") - F.expr(f"INTERVAL {lateness}")).alias("_mark"))))
        rows.filter(F.col("_ends") <= F.col("_mark")).drop("_mark", "_ends").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        seen, before = batch.select("ts"), mark(number - 1)
        seen = seen.unionByName(before) if before else seen
        seen.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    late.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(touches.schema).parquet(f"{path}/rows") if Folder(spark, f"{path}/rows").names() else spark.createDataFrame([], touches.schema)


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Output and checkpoint folders for a run that starts from the beginning."""
    return scratch_path(spark, name), scratch_path(spark, f"{name}-state")


# --- operators --------------------------------------------------------------------------
def touch_state(touches: DataFrame) -> DataFrame:
    """Current state of every contact; the batch aggregate runs on the stream unchanged."""
    return contact_state(touches)


def _just_under(days: int) -> str:
    """A session takes in a row exactly at its end, so the gap is one microsecond short:
    silence of ``days`` to the day already ends it, as in the batch twin."""
    return f"{days - 1} days 23 hours 59 minutes 59 seconds 999999 microseconds"


def quiet_alert(touches: DataFrame, days: int, lateness: str) -> DataFrame:
    """A row once a contact has been silent for ``days``.

    A touch opens or extends a session with that gap; the watermark passing its end is the
    alert.
    """
    return (
        touches.withWatermark("ts", lateness)
        .groupBy("contact_id", F.session_window("ts", _just_under(days)).alias("w"))
        .agg(F.count(F.lit(1)).alias("touches"))
        .select(
            "contact_id",
            F.col("w.start").alias("began"),
            (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("alert_at"),
            "touches",
        )
    )


def daily_touches(touches: DataFrame, lateness: str) -> DataFrame:
    """Touches per day and type, accepting rows up to the logging rule's 24 hours late."""
    return (
        touches.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), "type")
        .agg(F.count(F.lit(1)).alias("touches"))
        .select(F.col("w.start").alias("day_start"), "type", "touches")
    )


def tumbling(events: DataFrame, by: Sequence[str], aggs: Sequence[Column], lateness: str) -> DataFrame:
    """Weekly totals, weeks starting on Monday (window origins count from a Thursday)."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), *by)
        .agg(*aggs)
        .withColumn("window_start", F.col("w.start"))
        .drop("w")
    )


def sliding(
    events: DataFrame, length: str, step: str, by: Sequence[str], aggs: Sequence[Column], lateness: str, origin: str = "0 days"
) -> DataFrame:
    """Counts over overlapping windows: topic trends, feel shares, best posts."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", length, step, startTime=origin).alias("w"), *by)
        .agg(*aggs)
        .withColumn("window_start", F.col("w.start"))
        .drop("w")
    )


def exchanges(touches: DataFrame, gap_days: int, lateness: str) -> DataFrame:
    """One row per exchange: touches less than ``gap_days`` apart."""
    return (
        touches.withWatermark("ts", lateness)
        .groupBy("contact_id", F.session_window("ts", _just_under(gap_days)).alias("w"))
        .agg(F.count(F.lit(1)).alias("touches"))
        .select("contact_id", F.col("w.start").alias("opened"), "touches")
    )


def dedup(posts: DataFrame, keys: Sequence[str], lateness: str) -> DataFrame:
    """First row of each key; a copy within the lateness is dropped and its state expires."""
    return posts.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def grade_stream(
    runs: DataFrame,
    assertions: DataFrame,
    path: str,
    checkpoint: str,
    prior: Callable[[], DataFrame | None] = lambda: None,
) -> DataFrame:
    """Grade outputs as they land.  The newest grade of a (run, assertion) wins; grading the
    same output again gives the same rows, and ``prior`` keeps qualitative grades.

    Earlier grades are dealt by run once, so that a micro-batch reads those of its buckets, and the
    grades go to a keyed table of which it rewrites the buckets that its runs fall into.
    """
    spark = runs.sparkSession
    given = prior()
    old = None
    if given is not None:
        kept = settled(given).select("run_id", "assertion_id", "_old.*").withColumn("seq", F.lit(0))
        old = KeyedTable(spark, f"{path}-prior", ["run_id", "assertion_id"], kept.schema, deal_by=["run_id"])
        old.upsert(kept, unique=True)

    def graded(batch: DataFrame) -> DataFrame:
        return grade(batch, assertions, None if old is None else old.near(batch))

    none = spark.createDataFrame([], runs.schema)
    table = KeyedTable(spark, path, ["run_id", "assertion_id"], grade(none, assertions).schema, deal_by=["run_id"])

    def save(batch: DataFrame, number: int) -> None:
        table.upsert(graded(batch), number, writer=checkpoint)

    query = (
        runs.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()
