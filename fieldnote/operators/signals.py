"""Posts, signals and activities over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote.functions.ordered import RowNumber, RunningSum, islands, running
from fieldnote.functions.stats import ratio

SECONDS_PER_DAY = 86400


def engagement(posts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Engagement rate and posts per month."""
    month = F.date_trunc("month", "ts").cast("date").alias("month")
    return posts.groupBy(*by, month).agg(
        F.count(F.lit(1)).alias("posts"),
        ratio(F.sum(F.col("likes") + F.col("comments")), F.sum("views"), 6).alias("engagement_rate"),
    )


def topic_trend(signals: DataFrame, days: int = 10, prospects: DataFrame | None = None) -> DataFrame:
    """Distinct accounts per topic in every ``days``-day window, one window per day.

    Signals shrink to one row per topic, day and account before they are copied into the
    windows they belong to.
    """
    daily = signals.groupBy("topic", F.to_date("ts").alias("day"), "account").agg(F.count(F.lit(1)).alias("n"))
    if prospects is not None:
        known = prospects.select("account").distinct().withColumn("_p", F.lit(1))
        daily = daily.join(known, "account", "left")
    else:
        daily = daily.withColumn("_p", F.lit(None).cast("int"))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_sub("day", i)))
    per_account = (
        daily.select("topic", "account", "_p", "n", starts.alias("window_start"))
        .groupBy("topic", "window_start", "account")
        .agg(F.sum("n").alias("n"), F.max("_p").alias("_p"))
    )
    return per_account.groupBy("topic", "window_start").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("n").alias("signals"), F.count("_p").alias("prospects")
    )


def weekly_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "type").agg(
        F.count(F.lit(1)).alias("activities")
    )


def soft_signals(df: DataFrame, kinds: Sequence[str], least: int = 2, key: str = "account") -> DataFrame:
    """Weeks with at least ``least`` different soft signals."""
    weekly = df.filter(F.col("kind").isin(list(kinds))).groupBy(
        key, F.date_trunc("week", "ts").cast("date").alias("week")
    )
    return weekly.agg(F.count_distinct("kind").alias("kinds")).filter(F.col("kinds") >= least)


def signal_context(signals: DataFrame, contacts: DataFrame) -> DataFrame:
    """Signals with the status of the contact behind the account, if there is one."""
    return signals.join(contacts.select(F.col("id").alias("account"), F.col("status").alias("contact_status")), "account", "left")


def engaged_prospects(contacts: DataFrame, signals: DataFrame) -> DataFrame:
    """Contacts who sent any signal."""
    return contacts.join(signals.select(F.col("account").alias("id")), "id", "left_semi")


def weekly_corr(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation of two weekly counts over the weeks both sources cover."""
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    x = a.groupBy(week).agg(F.count(F.lit(1)).alias("x"))
    y = b.groupBy(week).agg(F.count(F.lit(1)).alias("y"))
    return x.join(y, "week").agg(F.count(F.lit(1)).alias("weeks"), F.round(F.corr("x", "y"), 6).alias("corr"))


def streaks(df: DataFrame, feel: str, least: int, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Unbroken runs of one feel with at least ``least`` activities."""
    runs = islands(df, list(keys), ["ts", "event_id"], F.date_trunc("hour", "ts"), F.col("feel") == feel, "run")
    return (
        runs.groupBy(*keys, "run")
        .agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("length"))
        .filter(F.col("length") >= least)
        .drop("run")
    )


def held_weeks(weekly: DataFrame, holds: Column, least: int, keys: Sequence[str]) -> DataFrame:
    """Stretches of at least ``least`` consecutive weeks in which a condition holds.

    ``weekly`` has one row per key and week; a missing week breaks the stretch.
    """
    number = F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7)
    place = F.row_number().over(W.partitionBy(*keys).orderBy("week"))
    marked = weekly.filter(holds).withColumn("_run", number - place)
    return (
        marked.groupBy(*keys, "_run")
        .agg(F.min("week").alias("from_week"), F.max("week").alias("to_week"), F.count(F.lit(1)).alias("weeks"))
        .filter(F.col("weeks") >= least)
        .drop("_run")
    )


def rolling_feel(df: DataFrame, feels: Sequence[str], days: int = 28, key: str = "kind") -> DataFrame:
    """Share of each feel over the last ``days`` days, per day with activity.

    Activities are counted per key and day first; the window runs over those few rows.
    """
    daily = df.groupBy(key, F.to_date("ts").alias("day")).agg(
        *[F.count_if(F.col("feel") == f).alias(f) for f in feels]
    )
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(key).orderBy("_n").rangeBetween(-(days - 1), 0)
    rolled = daily.withColumn("_n", number).select(key, "day", *[F.sum(f).over(w).alias(f) for f in feels])
    total = sum((F.col(f) for f in feels), F.lit(0))
    return rolled.select(key, "day", *[ratio(F.col(f), total, 6).alias(f"{f}_share") for f in feels])


def top_performer(posts: DataFrame, weeks: int = 4) -> DataFrame:
    """Best post of every ``weeks``-week window, windows starting each Monday.

    The best post of each week is found first and then copied into its windows.
    """
    rank = F.struct("engagements", (-F.col("event_id")).alias("first"))
    post = F.struct("event_id", "account", "engagements")
    week = F.date_trunc("week", "ts").cast("date")
    weekly = posts.groupBy(week.alias("week")).agg(F.max_by(post, rank).alias("p"))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda i: F.date_sub("week", i * 7)))
    spread = weekly.select(starts.alias("window_start"), "p.*")
    return spread.groupBy("window_start").agg(F.max_by(post, rank).alias("p")).select("window_start", "p.*")


def vs_own_avg(posts: DataFrame, times: float, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Posts that reach ``times`` the account's average over its earlier posts."""
    seen = running(
        posts,
        list(keys),
        ["ts", "event_id"],
        F.date_trunc("hour", "ts"),
        [RowNumber("_n"), RunningSum("_s", F.col("engagements"))],
    )
    earlier, n = F.col("_s") - F.col("engagements"), F.col("_n") - 1
    return (
        seen.withColumn("multiple", ratio(F.col("engagements") * n, earlier, 4))
        .filter(F.col("engagements") >= times * ratio(earlier, n))
        .drop("_n", "_s")
    )


def signal_window(df: DataFrame, as_of: str, hours: int) -> DataFrame:
    """React while a signal is younger than ``hours``; learn from it afterwards."""
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3600000000).cast("bigint")
    return df.withColumn("age_hours", age).withColumn(
        "use", F.when(F.col("age_hours") < hours, "reaction").otherwise("learning")
    )


def weekly_mode(daily: DataFrame, word: str) -> DataFrame:
    """Most frequent word of each week; the alphabetically first one on a tie."""
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    counts = daily.groupBy(week, word).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("most"), F.col(word))
    return counts.groupBy("week").agg(F.min_by(word, order).alias(word), F.max("n").alias("times"))
