"""Prospects, funders, contacts and their touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.functions.ordered import Following, LastValue, Previous, RowNumber, RunningSum, running
from fieldnote.functions.stats import day, days_between, minutes_between, ratio
from fieldnote.session import local_table

# The status ladders, in display order.
PROSPECT_STATUSES = ("research", "ready", "contacted", "responded", "passed", "closed")
SHOWN_PROSPECT_STATUSES = ("research", "ready", "contacted", "responded")
FUNDER_STATUSES = ("research", "loi-prep", "submitted", "reviewed", "awarded", "declined")
# Days until the follow-up after contact; a reply clears it.
FOLLOWUP_DAYS = 3


def list_by_status(df: DataFrame, status: str = "all", shown: Sequence[str] = SHOWN_PROSPECT_STATUSES) -> DataFrame:
    """Records in display order; ``all`` means every shown status."""
    wanted = [s for s in shown if status in ("all", s)]
    place = F.array_position(F.array(*[F.lit(s) for s in shown]), F.col("status"))
    return df.filter(F.col("status").isin(wanted)).orderBy(place, "slug")


def _without(df: DataFrame, closed: Sequence[str]) -> DataFrame:
    return df.filter(~F.coalesce(F.col("status"), F.lit("")).isin(list(closed)))


def active_prospects(df: DataFrame) -> DataFrame:
    """Neither closed nor passed; a record without status is active."""
    return _without(df, ("closed", "passed")).orderBy(F.col("status").asc_nulls_first(), "slug")


def active_funders(df: DataFrame) -> DataFrame:
    return _without(df, ("declined", "passed")).orderBy(F.col("deadline").asc_nulls_last(), "slug")


def followups_due(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(F.col("next_followup") <= day(as_of)).orderBy("next_followup", "slug")


def stale_contacted(df: DataFrame) -> DataFrame:
    """Contacted, but no follow-up is scheduled."""
    return df.filter((F.col("status") == "contacted") & F.col("next_followup").isNull())


def awaiting(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "contacted").orderBy(F.col("last_contact").asc_nulls_first(), "slug")


def deadlines_within(df: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Deadlines up to ``days`` ahead; past ones stay in the list."""
    return df.filter(F.col("deadline") <= F.date_add(day(as_of), days)).orderBy("deadline", "slug")


def deadlines(df: DataFrame) -> DataFrame:
    """All non-empty deadlines by date, then funder; ``unknown`` comes last."""
    return df.filter(F.col("deadline_raw").isNotNull()).orderBy(F.col("deadline").asc_nulls_last(), "funder")


def by_angle(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("angle").asc_nulls_last(), "slug")


def overdue_actions(contacts: DataFrame, as_of: str) -> DataFrame:
    """Nested touches whose next action is past due."""
    return (
        contacts.filter(F.exists("touches", lambda t: t.nextActionDue < day(as_of)))
        .select("id", F.explode("touches").alias("t"))
        .filter(F.col("t.nextActionDue") < day(as_of))
        .select("id", "t.date", "t.type", "t.nextAction", "t.nextActionDue")
    )


def touches_in(contacts: DataFrame, kind: str, first: str, last: str) -> DataFrame:
    """Nested touches of one type between two dates, both included."""
    return (
        contacts.select("id", F.explode("touches").alias("t"))
        .filter((F.col("t.type") == kind) & F.col("t.date").between(day(first), day(last)))
        .select("id", "t.date", "t.note")
    )


def stale_items(df: DataFrame, as_of: str, days: int, last: str, active: Column) -> DataFrame:
    """Should be moving, but untouched for more than ``days``."""
    idle = days_between(as_of, F.col(last))
    return df.filter(active & (idle > days)).withColumn("idle_days", idle)


def silent(df: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return stale_items(df, as_of, days, "last_contact", F.col("status") == "contacted")


def list_entity(df: DataFrame, **eq) -> DataFrame:
    """Rows whose columns equal the given values."""
    for column, value in eq.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def sla_breaches(
    messages: DataFrame, targets: Sequence[tuple[str, str, int]], opened: str = "received_at", closed: str = "answered_at"
) -> DataFrame:
    """Answers that miss the target of their context.

    ``targets`` is (context, unit, amount); units are ``hours``, ``day`` (the same calendar
    day), ``business_hours`` (hours of Monday to Friday) and ``business_days`` (Monday to Friday,
    whole days) at most, and ``not_before_days`` at least.  A context may have several.
    """
    goal = local_table(messages.sparkSession, list(targets), "context string, unit string, amount int")
    start, end = F.to_date(opened), F.to_date(closed)
    waited = minutes_between(F.col(closed), F.col(opened))

    def weekdays_before(d: Column) -> Column:
        # Working days from a fixed Monday up to, not including, d.
        n = F.datediff(d, day("1970-01-05"))
        rest = F.pmod(n, F.lit(7))
        return (F.floor((n - rest) / 7) * 5 + F.least(rest, F.lit(5))).cast("bigint")

    def weekday_minutes(ts: str) -> Column:
        d = F.to_date(ts)
        weekday = F.pmod(F.datediff(d, day("1970-01-05")), F.lit(7)) < 5
        return weekdays_before(d) * 1440 + F.when(weekday, minutes_between(F.col(ts), d)).otherwise(0)

    business = weekdays_before(end) - weekdays_before(start)
    late = (
        F.when(F.col("unit") == "hours", waited > F.col("amount") * 60)
        .when(F.col("unit") == "day", end > start)
        .when(F.col("unit") == "business_hours", weekday_minutes(closed) - weekday_minutes(opened) > F.col("amount") * 60)
        .when(F.col("unit") == "business_days", business > F.col("amount"))
        .when(F.col("unit") == "not_before_days", F.datediff(end, start) < F.col("amount"))
    )
    return (
        messages.join(goal, "context")
        .withColumns({"waited_minutes": waited, "business_days": business})
        .filter(late)
        .drop("unit", "amount")
    )


def new_only(batch: DataFrame, existing: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a batch; a known key is rejected."""
    known = existing.select(key)
    return batch.join(known, key, "left_anti"), batch.join(known, key, "left_semi")


def introductions(contacts: DataFrame) -> DataFrame:
    """Who introduced whom, from ``source = referral-from-<id>``."""
    came = contacts.select(
        F.col("id").alias("introduced"),
        "created",
        F.regexp_extract("source", "^referral-from-(.+)$", 1).alias("introducer"),
    ).filter("introducer <> ''")
    known = contacts.select(F.col("id").cast("string").alias("introducer"), F.col("status").alias("introducer_status"))
    return came.join(known, "introducer")


def intro_counts(contacts: DataFrame) -> DataFrame:
    """Introductions received per quarter."""
    return (
        introductions(contacts)
        .groupBy(F.date_trunc("quarter", "created").cast("date").alias("quarter"))
        .agg(F.count(F.lit(1)).alias("introductions"), F.count_distinct("introducer").alias("introducers"))
    )


def links(content: DataFrame, projects: DataFrame) -> DataFrame:
    """Content-project links from both sides, with the sides that state them."""
    a = content.select("content_id", F.explode("project_ids").alias("project_id"), F.lit(1).alias("s"), F.lit(0).alias("t"))
    b = projects.select(F.explode("content_ids").alias("content_id"), "project_id", F.lit(0).alias("s"), F.lit(1).alias("t"))
    return (
        a.unionByName(b)
        .groupBy("content_id", "project_id")
        .agg((F.max("s") == 1).alias("in_content"), (F.max("t") == 1).alias("in_project"))
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key names no parent; a null key refers to nothing."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def cadence(df: DataFrame, start: str, offsets: Sequence[int], unit: str = "days") -> DataFrame:
    """Due dates at fixed offsets from a start date."""
    step = F.explode(F.array(*[F.lit(o) for o in offsets]))
    due = F.add_months(start, F.col("step")) if unit == "months" else F.date_add(start, F.col("step"))
    return df.withColumn("step", step).withColumn("due", due)


def status_counts(df: DataFrame, statuses: Sequence[str] = PROSPECT_STATUSES) -> DataFrame:
    """Records per known status in ladder order; empty statuses do not show."""
    place = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    counts = df.groupBy("status").agg(F.count(F.lit(1)).alias("records"))
    return counts.withColumn("place", place.cast("bigint")).filter("place > 0").orderBy("place")


def stage_counts(contacts: DataFrame, by: str, paid: Column, out: Column) -> DataFrame:
    """Contacts, paid conversion and qualify-out rate per stage or source."""
    return contacts.groupBy(by).agg(
        F.count(F.lit(1)).alias("contacts"),
        ratio(F.count_if(paid), F.count(F.lit(1)), 4).alias("paid_rate"),
        ratio(F.count_if(out), F.count(F.lit(1)), 4).alias("qualify_out_rate"),
    )


TOUCH_ORDER = ("date", "touch_id")


def last_touch(touches: DataFrame) -> DataFrame:
    """Latest touch per contact as an aggregate: no sort, and partial per task."""
    newest = F.max_by(F.struct("date", "type", "status", "touch_id"), F.struct(*TOUCH_ORDER))
    return touches.groupBy("contact_id").agg(newest.alias("t")).select("contact_id", "t.*")


def quiet(touches: DataFrame, as_of: str, days: int = 90, contacts: DataFrame | None = None) -> DataFrame:
    """Contacts without a touch for ``days`` or more; never touched shows as null."""
    last = touches.groupBy("contact_id").agg(F.max("date").alias("last_touch"))
    idle = days_between(as_of, F.col("last_touch"))
    if contacts is not None:
        last = contacts.select(F.col("id").alias("contact_id")).join(last, "contact_id", "left")
    return last.withColumn("quiet_days", idle).filter((idle >= days) | F.col("last_touch").isNull())


def followup_mark(status: Column, date: Column) -> Column:
    """What a status change does to the follow-up date; null leaves it alone."""
    return F.when(status == "contacted", F.struct(F.date_add(date, FOLLOWUP_DAYS).alias("due"))).when(
        status == "responded", F.struct(F.lit(None).cast("date").alias("due"))
    )


def replay_touches(touches: DataFrame) -> DataFrame:
    """Touch number and follow-up date after every status change.

    Only ``contacted`` and ``responded`` move the follow-up date; other changes keep it.
    """
    mark = followup_mark(F.col("status"), F.col("date"))
    return (
        running(
            touches,
            ["contact_id"],
            list(TOUCH_ORDER),
            F.col("date"),
            [RowNumber("touch_number"), LastValue("_mark", mark)],
        )
        .withColumn("next_followup", F.col("_mark.due"))
        .drop("_mark")
    )


def contact_state(touches: DataFrame) -> DataFrame:
    """Where each contact stands after its last touch; one pass, no window."""
    order = F.struct(*TOUCH_ORDER)
    mark = followup_mark(F.col("status"), F.col("date"))
    return touches.groupBy("contact_id").agg(
        F.count(F.lit(1)).alias("touch_count"),
        F.max("date").alias("last_contact"),
        F.max_by("status", order).alias("status"),
        F.max_by(mark, F.when(mark.isNotNull(), order)).getField("due").alias("next_followup"),
    )


def stage_spans(history: DataFrame) -> DataFrame:
    """How long every stage of a contact lasted; the open stage has no length."""
    spans = running(
        history, ["contact_id"], list(TOUCH_ORDER), F.col("date"), [Following("until", F.col("date"))]
    )
    return spans.withColumn("days", days_between(F.col("until"), F.col("date")))


def stage_durations(history: DataFrame) -> DataFrame:
    return (
        stage_spans(history)
        .groupBy("status")
        .agg(
            F.count("days").alias("closed_stages"),
            F.count_if(F.col("days").isNull()).alias("open_stages"),
            ratio(F.sum("days"), F.count("days")).alias("mean_days"),
            F.max("days").alias("longest"),
        )
    )


def asof_touch(events: DataFrame, touches: DataFrame) -> DataFrame:
    """Latest touch at or before each event, per contact.

    Both inputs carry contact_id, date and touch_id.  They are merged into one sequence and
    the last touch is carried along, so nothing is paired up and filtered afterwards.
    """
    cols = ["contact_id", "date", "touch_id"]
    merged = touches.select(*cols, F.lit(0).alias("kind")).unionByName(events.select(*cols, F.lit(1).alias("kind")))
    seen = F.when(F.col("kind") == 0, F.struct("date", "touch_id"))
    out = running(
        merged, ["contact_id"], ["date", "kind", "touch_id"], F.col("date"), [LastValue("_t", seen)]
    ).filter("kind = 1")
    return out.select(
        "contact_id",
        F.col("touch_id").alias("event_id"),
        F.col("date").alias("event_date"),
        F.col("_t.touch_id").alias("touch_id"),
        F.col("_t.date").alias("touch_date"),
        days_between(F.col("date"), F.col("_t.date")).alias("latency_days"),
    )


def exchanges(touches: DataFrame, gap_days: int) -> DataFrame:
    """One exchange per run of touches less than ``gap_days`` apart."""
    marked = running(
        touches, ["contact_id"], list(TOUCH_ORDER), F.col("date"), [Previous("_p", F.col("date"))]
    )
    opens = F.col("_p").isNull() | (days_between(F.col("date"), F.col("_p")) >= gap_days)
    numbered = running(
        marked.withColumn("_open", F.when(opens, 1).otherwise(0).cast("bigint")),
        ["contact_id"],
        list(TOUCH_ORDER),
        F.col("date"),
        [RunningSum("exchange", F.col("_open"))],
    )
    return numbered.groupBy("contact_id", "exchange").agg(
        F.min("date").alias("opened"), F.max("date").alias("last_touch"), F.count(F.lit(1)).alias("touches")
    )


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows overall: each task keeps k rows, no full sort."""
    return df.orderBy(*order).limit(k)
