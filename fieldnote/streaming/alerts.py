"""Quiet alerts with event-time timers, one state and timer per bucket of contacts.

A contact's touches form sessions: two touches less than ``days`` apart lie in one.  An alert goes out when the
watermark passes a session's end.  Session windows drop what comes behind the watermark, whereas here such a touch still
counts: it extends or bridges sessions, an alert that it makes untrue is taken back (``reopened``) and the joined
session waits anew.  Each row that came behind the watermark also leaves as ``late``, in the same run.
The alerts that stand are thus the same in whatever order the touches come.

Every call to the state costs a round trip between Python and the store.  The contacts of a bucket (a hash of
contact_id) hence share one value, their sessions as an Arrow table, and one timer, at the next end of any of them: four calls per
bucket and micro-batch, however many touches it has.  State is some 40 bytes per session, at most one for every ``days`` of a
contact's history, and is kept so that a touch of any age finds its session; a micro-batch rewrites the buckets
that it meets.  ``buckets`` is fixed by the first run: take so many that the sessions of one fit a task with ease.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldnote.sources.files import Folder
from fieldnote.sources.keyed import KeyedTable

SCHEMA = "contact_id string, kind string, began long, ended long, touches long"
ALERTS = "contact_id string, began timestamp, alert_at timestamp, touches bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


BUCKETS = 4096


def _processor(gap: int):
    """The class lives in here so that workers get it by value."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.streaming import StatefulProcessor

    columns = ["contact_id", "began", "last", "touches", "alerted"]
    schema = pa.schema([("contact_id", pa.string()), ("began", pa.int64()), ("last", pa.int64()), ("touches", pa.int64()), ("alerted", pa.bool_())])

    def rows(found, kind, ended):
        return pd.DataFrame({"contact_id": found["contact_id"], "kind": kind, "began": found["began"], "ended": ended, "touches": found["touches"]})

    def merged(held, at):
        """The sessions after the touches ``at``, and those taken back."""
        new = pd.DataFrame({"contact_id": at["contact_id"], "began": at["at"], "last": at["at"], "touches": 1, "alerted": False})
        both = pd.concat([held, new], ignore_index=True) if len(held) else new
        came = np.arange(len(both)) >= len(held)
        contact = pd.factorize(both["contact_id"], use_na_sentinel=False)[0]
        order = np.lexsort((both["began"].to_numpy(), contact))
        both, came, contact = both.iloc[order].reset_index(drop=True), came[order], contact[order]
        last = both["last"].groupby(contact).cummax().to_numpy()
        first = np.ones(len(both), bool)
        first[1:] = (contact[1:] != contact[:-1]) | (both["began"].to_numpy()[1:] - last[:-1] >= gap)
        begin = np.flatnonzero(first)
        changed = np.logical_or.reduceat(came, begin)
        alerted = both["alerted"].to_numpy(bool)
        back = both[alerted & np.repeat(changed, np.diff(np.append(begin, len(both))))]
        out = both.iloc[begin].assign(
            last=np.maximum.reduceat(last, begin), touches=np.add.reduceat(both["touches"].to_numpy(), begin), alerted=alerted[begin] & ~changed
        )
        return out.reset_index(drop=True), back

    class Quiet(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("sessions", "held binary, timer long")

        def _held(self):
            found = self.state.get()
            if found is None:
                return pd.DataFrame(columns=columns), None
            return pa.ipc.open_stream(bytes(found[0])).read_all().to_pandas(), found[1]

        def _keep(self, held, mark, before):
            """Sends the alerts that are due, sets the timer to the next one and keeps the sessions."""
            due = ~held["alerted"].to_numpy(bool) & (held["last"].to_numpy() + gap <= mark)
            out = rows(held[due], "alert", held["last"][due] + gap)
            held["alerted"] |= due
            open_ones = held["last"][~held["alerted"]]
            timer = int(-(-(open_ones.min() + gap) // 1000)) if len(open_ones) else None
            if timer != before:
                if before is not None:
                    self.handle.deleteTimer(before)
                if timer is not None:
                    self.handle.registerTimer(timer)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
                stream.write_table(pa.Table.from_pandas(held[columns], schema, preserve_index=False))
            self.state.update((sink.getvalue().to_pybytes(), timer))
            return out

        def handleInputRows(self, key, parts, timerValues):
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            at = pd.concat(list(parts), ignore_index=True)
            late = at[at["at"] < mark]
            held, before = self._held()
            sessions, back = merged(held, at)
            yield rows(late.assign(began=late["at"], touches=1), "late", late["at"])
            yield rows(back, "reopened", back["last"] + gap)
            yield self._keep(sessions, mark, before)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held, before = self._held()
            # The timer that went off is gone already.
            yield self._keep(held, timerValues.getCurrentWatermarkInMs() * 1000, None if before == expiredTimerInfo.getExpiryTimeInMs() else before)

        def close(self):
            pass

    return Quiet()


def quiet_changes(touches: DataFrame, days: int, lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``alert``, ``reopened`` and ``late`` of a stream with contact_id and ts; touches without a time count nowhere."""
    marked = touches.withWatermark("ts", lateness).filter(F.col("ts").isNotNull()).select(
        F.col("contact_id").cast("string").alias("contact_id"), F.unix_micros("ts").alias("at")
    )
    gap = int(timedelta(days=days) / timedelta(microseconds=1))
    dealt = marked.withColumn("bucket", F.pmod(F.xxhash64("contact_id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(_processor(gap), SCHEMA, "update", "eventTime")


def drain_alerts(touches: DataFrame, days: int, lateness: str, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Runs to the end of the input: the alerts that stand, and the rows that came late (contact_id, ts).

    The alerts are a keyed table that takes back what was reopened; a batch that is run again changes nothing.
    """
    spark = touches.sparkSession
    table = KeyedTable(spark, f"{path}/alerts", ["contact_id", "began"], StructType.fromDDL(ALERTS), deal_by=["contact_id"])
    before = spark.conf.get(PROVIDER)

    def save(batch: DataFrame, number: int) -> None:
        changes = f"{path}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(changes)  # the state is computed once
        rows = spark.read.schema(SCHEMA).parquet(changes)
        time = lambda c: F.timestamp_micros(c)
        turned = rows.filter("kind <> 'late'").select("contact_id", time("began").alias("began"), time("ended").alias("alert_at"), "touches", "kind")
        if not turned.isEmpty():
            # Within a batch an alert follows the reopening of the session that it replaces.
            stands = turned.groupBy("contact_id", "began").agg(F.max_by(F.struct("alert_at", "touches", "kind"), (F.col("kind") == "alert").cast("int")).alias("r"))
            table.upsert(stands.select("contact_id", "began", "r.*"), number, writer=checkpoint, unique=True, gone=F.col("kind") == "reopened")

    spark.conf.set(PROVIDER, ROCKS)
    try:
        changes = quiet_changes(touches, days, lateness)
        query = changes.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    some = Folder(spark, f"{path}/changes").names()
    said = spark.read.schema(SCHEMA).parquet(*[f"{path}/changes/{n}" for n in some]) if some else spark.createDataFrame([], SCHEMA)
    return table.read(), said.filter("kind = 'late'").select("contact_id", F.timestamp_micros("began").alias("ts"))
