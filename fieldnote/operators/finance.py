"""Pricing, ledger, invoices, capacity and project rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote.functions.ordered import RowNumber, RunningMax, RunningSum, running
from fieldnote.functions.stats import day, days_between, flag, money, pct, ratio, total
from fieldnote.session import local_table

# Thresholds of the practice rules; each is also a parameter below.
RESERVE_RATE = "0.30"
RUSH_RATE = "1.20"
DISCOUNT_CAPS = {"aligned": 30, "other": 20}


def _dec(value: str, kind: str = "decimal(4,2)") -> Column:
    return F.lit(value).cast(kind)


def assign_project_id(df: DataFrame, start: str, tie: str, prefix: str) -> DataFrame:
    """PREFIX-YYYY-### numbered within the year of the start date.

    A year is numbered day by day, with the counts of the earlier days added.
    """
    yearly = df.withColumn("_year", F.year(start))
    numbered = running(yearly, ["_year"], [start, tie], F.col(start), [RowNumber("_n")])
    n = F.col("_n").cast("string")
    padded = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    code = F.concat_ws("-", F.lit(prefix), F.col("_year").cast("string"), padded)
    return numbered.withColumn("project_id", code).drop("_n", "_year")


def price_check(opps: DataFrame, tiers: DataFrame) -> DataFrame:
    """Opportunities with their tier and whether the price lies inside its range."""
    inside = F.col("price").between(F.col("floor"), F.col("ceiling"))
    return opps.join(tiers.select("tier", "key", "floor", "ceiling"), "tier", "left").withColumn(
        "fits", F.coalesce(inside, F.lit(False))
    )


def below_floor(quotes: DataFrame, floors: DataFrame) -> DataFrame:
    """Quotes under the floor of their service without an override, and those of an unknown service."""
    joined = quotes.join(floors.select("tier", "floor"), "tier", "left").withColumn("reason", _why("below_floor"))
    low = F.col("floor").isNull() | (F.col("price") < F.col("floor"))
    return joined.filter(low & ~F.coalesce(F.col("override"), F.lit(False)))


def _why(known: str) -> Column:
    return F.when(F.col("floor").isNull(), "unknown_tier").otherwise(known)


def disqualified(opps: DataFrame, tiers: DataFrame, tolerance: str | Column = "0.70") -> DataFrame:
    """Budget more than 30 percent below the floor and not flexible; an unknown tier is told apart.

    Here and below a threshold may be a column: that of a rule book as of the row's date.
    """
    joined = opps.join(tiers.select("tier", "floor"), "tier", "left").withColumn("reason", _why("low_budget"))
    low = F.col("floor").isNull() | (F.col("price") < F.col("floor") * (tolerance if isinstance(tolerance, Column) else _dec(tolerance)))
    return joined.filter(low & ~F.coalesce(F.col("flexible"), F.lit(False)))


def segment_match(opps: DataFrame, tiers: DataFrame) -> DataFrame:
    """Opportunities in a documented segment, or overridden."""
    known = tiers.select(F.col("segment").alias("_s")).distinct().withColumn("_known", F.lit(True))
    joined = opps.join(known, F.col("segment") == F.col("_s"), "left")
    return joined.filter(F.col("_known").isNotNull() | F.coalesce(F.col("override"), F.lit(False))).drop("_s", "_known")


def expense_flags(ledger: DataFrame, days: int = 7, receipt_above: int = 25) -> DataFrame:
    """Expenses logged late or missing a required receipt."""
    late = days_between(F.col("logged_on"), F.col("date")) > days
    bare = (F.col("amount") > receipt_above) & F.col("receipt").isNull()
    flagged = ledger.filter(F.col("kind") == "expense").withColumns({"logged_late": late, "no_receipt": bare})
    return flagged.filter(F.col("logged_late") | F.col("no_receipt"))


def buffer_conflicts(projects: DataFrame, days: int = 7, keys: Sequence[str] = ("client",)) -> DataFrame:
    """Projects that start less than ``days`` after an earlier one ended, or overlap it.

    The latest end so far is carried along the start order, so no pairs are formed.
    """
    seen = running(
        projects,
        list(keys),
        ["started", "project"],
        F.col("started"),
        [RunningMax("busy_until", F.col("ended"))],
    )
    gap = days_between(F.col("started"), F.col("busy_until"))
    return seen.withColumn("gap_days", gap).filter(F.col("gap_days") < days)


def pause_breaches(events: DataFrame, days: int | Column = 5) -> DataFrame:
    """Projects edited or delivered less than ``days`` (a column of ``filmed``) after the last filming."""
    film = F.col("stage") == "film"
    spans = events.groupBy("project").agg(
        F.max(F.when(film, F.col("date"))).alias("filmed"),
        F.min(F.when(F.col("stage").isin("edit", "deliver"), F.col("date"))).alias("edited"),
    )
    return spans.withColumn("pause", days_between(F.col("edited"), F.col("filmed"))).filter(F.col("pause") < days)


def repeat_rate(projects: DataFrame, financials: DataFrame) -> DataFrame:
    """Repeat clients and what they pay, by tier of the client's first tier.

    Payments are summed per client before the join, so a busy client is one row on each side.
    """
    per_client = projects.groupBy("client").agg(
        F.count(F.lit(1)).alias("projects"), F.min("tier").alias("first_tier")
    )
    paid = financials.groupBy("client").agg(F.sum("amount").alias("paid"))
    both = per_client.join(paid, "client", "left")
    repeat = F.col("projects") > 1
    return both.groupBy("first_tier").agg(
        F.count(F.lit(1)).alias("clients"),
        F.count_if(repeat).alias("repeat_clients"),
        ratio(F.count_if(repeat), F.count(F.lit(1)), 4).alias("repeat_rate"),
        money(F.coalesce(F.sum(F.when(repeat, F.col("paid"))), F.lit(0))).alias("repeat_paid"),
    )


def tier_sequence(engagements: DataFrame, top: int = 3, needs: int = 2) -> DataFrame:
    """Top-tier engagements without an earlier completed one of the tier below.

    ``skipped`` marks a client who came straight from the first tier.
    """
    done = engagements.filter((F.col("tier") == needs) & (F.col("status") == "completed"))
    first_done = done.groupBy("client").agg(F.min("ended").alias("first_done"))
    firsts = engagements.filter(F.col("tier") < needs).groupBy("client").agg(F.min("started").alias("first_low"))
    high = engagements.filter(F.col("tier") == top)
    joined = high.join(first_done, "client", "left").join(firsts, "client", "left")
    ready = F.coalesce(F.col("first_done") <= F.col("started"), F.lit(False))
    return joined.filter(~ready).withColumn(
        "skipped", F.coalesce(F.col("first_low") < F.col("started"), F.lit(False))
    )


def go_no_go(
    opps: DataFrame,
    scores: Sequence[str],
    go: float,
    maybe: float,
    delivered: DataFrame,
    required: Sequence[str],
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """GO, MAYBE or NO-GO from fit scores; a missing deliverable turns GO into MAYBE.

    ``delivered`` lists (org, deliverable).  Weights and cut-offs are the caller's.
    """
    weights = weights or [1.0] * len(scores)
    fit = sum((F.col(c) * w for c, w in zip(scores, weights)), F.lit(0.0))
    present = (
        delivered.filter(F.col("deliverable").isin(list(required)))
        .groupBy("org")
        .agg(F.count_distinct("deliverable").alias("present"))
    )
    joined = opps.join(present, "org", "left").withColumn("fit", fit)
    ready = F.coalesce(F.col("present"), F.lit(0)) == len(required)
    verdict = (
        F.when((F.col("fit") >= go) & ready, "GO").when(F.col("fit") >= maybe, "MAYBE").otherwise("NO-GO")
    )
    return joined.withColumn("verdict", verdict)


# --- ledger -----------------------------------------------------------------------------
def practice_kpis(projects: DataFrame, by: Column, name: str = "month") -> DataFrame:
    """Conversion, repeat share, mean value and effective hourly rate per period."""
    accepted = F.col("status") != "proposed"
    won = F.when(accepted, F.col("value"))
    return projects.groupBy(by.alias(name)).agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(accepted).alias("accepted"),
        ratio(F.count_if(accepted), F.count(F.lit(1)), 4).alias("conversion"),
        F.count_distinct("client").alias("clients"),
        ratio(F.sum(won), F.count_if(accepted), 2).alias("mean_value"),
        ratio(F.sum(won), F.sum(F.when(accepted, F.col("hours"))), 2).alias("hourly"),
    )


def vs_target(kpis: DataFrame, targets: Sequence[tuple[str, float, float]], key: str) -> DataFrame:
    """Long-form KPIs against a first and a mature target."""
    names = [t[0] for t in targets]
    pairs = F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(n).cast("double").alias("value")) for n in names])
    goals = local_table(kpis.sparkSession, list(targets), "kpi string, target double, mature double")
    long = kpis.select(key, F.inline(pairs)).join(goals, "kpi")
    status = (
        F.when(F.col("value") >= F.col("mature"), "mature")
        .when(F.col("value") >= F.col("target"), "on target")
        .when(F.col("value").isNull(), "no data")
        .otherwise("below")
    )
    return long.withColumn("status", status)


def revenue(ledger: DataFrame, targets: Sequence[tuple[int, str]]) -> DataFrame:
    """Income by tier and quarter with totals, against the quarterly target of the tier."""
    goals = local_table(ledger.sparkSession, list(targets), "tier int, target decimal(18,2)")
    income = ledger.filter(F.col("kind") == "income")
    rolled = (
        income.groupBy("tier", F.date_trunc("quarter", "date").cast("date").alias("quarter"))
        .agg(F.sum("amount").alias("amount"))
        .rollup("tier", "quarter")
        .agg(total(F.sum("amount")).alias("amount"), F.grouping_id().cast("bigint").alias("level"))
    )
    both = rolled.join(goals, "tier", "left")
    short = F.when(F.col("level") == 0, F.col("amount") - F.col("target"))
    return both.select("tier", "quarter", "level", "amount", total(short).alias("over_target"))


def reserve(ledger: DataFrame, rate: str | Column = RESERVE_RATE) -> DataFrame:
    """Tax reserve on payments received and what is left after expenses, per month.  A rate that is a column
    holds for each payment by itself."""
    income, spent = (money(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0))) for k in ("income", "expense"))
    dated = isinstance(rate, Column)
    each = F.sum(F.when(F.col("kind") == "income", F.col("amount") * rate)) if dated else F.lit(None)
    monthly = ledger.groupBy(F.trunc("date", "month").alias("month")).agg(
        income.alias("received"), spent.alias("spent"), money(F.coalesce(each, F.lit(0))).alias("reserve")
    )
    held = F.col("reserve") if dated else money(F.col("received") * _dec(rate))
    return monthly.withColumn("reserve", held).withColumn(
        "net", money(F.col("received") - F.col("reserve") - F.col("spent"))
    )


def burn(ledger: DataFrame, savings_target: str) -> DataFrame:
    """Monthly business net and personal net, and whether the personal net met the target."""
    signed = F.when(F.col("kind") == "income", F.col("amount")).otherwise(-F.col("amount"))
    net = {
        s: money(F.coalesce(F.sum(F.when(F.col("scope") == s, signed)), F.lit(0))) for s in ("business", "personal")
    }
    monthly = ledger.groupBy(F.trunc("date", "month").alias("month")).agg(
        net["business"].alias("business_net"), net["personal"].alias("personal_net")
    )
    return monthly.withColumn("savings_hit", F.col("personal_net") >= _dec(savings_target, "decimal(18,2)"))


def category_delta(ledger: DataFrame, targets: Sequence[tuple[str, str]]) -> DataFrame:
    """Spending per month and category against its target; without a target the delta is null."""
    goals = local_table(ledger.sparkSession, list(targets), "category string, target decimal(18,2)")
    spent = (
        ledger.filter(F.col("kind") == "expense")
        .groupBy(F.trunc("date", "month").alias("month"), "category")
        .agg(money(F.sum("amount")).alias("spent"))
    )
    return spent.join(goals, "category", "left").withColumn("delta", money(F.col("spent") - F.col("target"))).drop("target")


def pace(ledger: DataFrame, target: str, first: str, as_of: str, last: str, by: str) -> DataFrame:
    """Progress to a target, what remains and what each remaining week must bring."""
    so_far = ledger.filter((F.col("kind") == "income") & F.col("date").between(day(first), day(as_of)))
    goal = _dec(target, "decimal(18,2)")
    weeks = F.greatest(F.ceil(days_between(last, as_of) / 7), F.lit(0)).cast("bigint")
    got = so_far.groupBy(by).agg(money(F.sum("amount")).alias("received"))
    left = got.withColumn("remaining", money(F.greatest(goal - F.col("received"), F.lit(0))))
    return left.select(
        by,
        "received",
        pct(F.col("received"), goal).alias("progress_pct"),
        "remaining",
        weeks.alias("weeks_left"),
        ratio(F.col("remaining"), weeks, 2).alias("needed_per_week"),
    )


def aging(invoices: DataFrame, as_of: str, steps: Sequence[int] = (15, 30, 45)) -> DataFrame:
    """Open amounts per client by how long they are overdue."""
    late = days_between(as_of, F.col("due_on"))
    first, second, last = steps
    step = (
        F.when(late <= 0, "not_due")
        .when(late < first, "late")
        .when(late < second, "first_followup")
        .when(late < last, "second_followup")
        .otherwise("escalate")
    )
    names = ["not_due", "late", "first_followup", "second_followup", "escalate"]
    open_ = invoices.filter(~F.col("paid")).withColumn("_step", step)
    return open_.groupBy("client").agg(
        *[money(F.coalesce(F.sum(F.when(F.col("_step") == n, F.col("amount"))), F.lit(0))).alias(n) for n in names]
    )


def discounts(engagements: DataFrame, floors: DataFrame, alarm: float = 0.20) -> DataFrame:
    """Discount share per quarter, its alarm, the deals under their floor and those of an unknown tier."""
    joined = engagements.join(floors.select("tier", "floor"), "tier", "left")
    given = F.col("discount_pct") > 0
    share = ratio(F.count_if(given), F.count(F.lit(1)), 4)
    return (
        joined.groupBy(F.date_trunc("quarter", "started").cast("date").alias("quarter"))
        .agg(
            F.count(F.lit(1)).alias("engagements"),
            share.alias("discount_share"),
            F.count_if(F.col("value") < F.col("floor")).alias("below_floor"),
            F.count_if(F.col("floor").isNull()).alias("unknown_tier"),
        )
        .withColumn("alarm", F.col("discount_share") > alarm)
    )


def capacity(projects: DataFrame, limits: dict[str, int], as_of: str) -> DataFrame:
    """Load against the limits: running embeddings, programs this quarter, stories this month."""
    now = day(as_of)
    running_now = now.between(F.col("started"), F.col("ended"))
    this_quarter = (F.col("started") <= F.date_sub(F.add_months(F.date_trunc("quarter", now), 3), 1)) & (
        F.col("ended") >= F.date_trunc("quarter", now)
    )
    this_month = F.trunc("started", "month") == F.trunc(now, "month")
    counts = projects.filter(F.col("status") != "proposed").agg(
        F.count_if((F.col("tier") == 3) & running_now).alias("embeddings"),
        F.count_if((F.col("tier") == 2) & this_quarter).alias("programs"),
        F.count_if((F.col("tier") == 1) & this_month).alias("stories"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("limit_on"), F.col(n).alias("load"), F.lit(m).cast("bigint").alias("allowed"))
            for n, m in limits.items()
        ]
    )
    return counts.select(F.inline(rows)).withColumn("over", F.col("load") > F.col("allowed"))


def triage(opps: DataFrame, questions: Sequence[str], yellow: Sequence[str], least_energy: int = 6) -> DataFrame:
    """Six yes/no answers, yellow flags and the energy level to one decision."""
    score = sum((flag(F.col(q)) for q in questions), F.lit(0))
    flags = sum((flag(F.col(y)) for y in yellow), F.lit(0))
    decision = (
        F.when(F.col("energy") < least_energy, "no new commitments")
        .when(F.col("yellow_flags") >= 3, "defer")
        .when(F.col("yes") >= 5, "take")
        .when(F.col("yes") >= 3, "conditions")
        .otherwise("decline")
    )
    return opps.withColumns({"yes": score.cast("bigint"), "yellow_flags": flags.cast("bigint")}).withColumn(
        "decision", decision
    )


# Lines of a budget in one task.
BUDGET_ROWS = 250_000


def budget(lines: DataFrame, rows_per_task: int = BUDGET_ROWS) -> DataFrame:
    """Hours times rate plus travel per line, with a total per project and overall.

    Lines are dealt by project to as many tasks as they need, so that a task's groups do not grow with the table; both finer
    levels then need no other shuffle, and what is summed overall is a row per task.
    """
    cost = F.col("hours") * F.col("rate") + F.col("travel")
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // rows_per_task))
    dealt = lines.select("project", "line", "hours", cost.alias("cost")).repartition(tasks, "project")
    by_line = dealt.groupBy("project", "line").agg(F.sum("hours").alias("hours"), F.sum("cost").alias("cost"))
    sums = [total(F.sum("hours")).alias("hours"), total(F.sum("cost")).alias("cost")]
    none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("project", "line")]
    level = lambda n: F.lit(n).cast("bigint").alias("level")
    return (
        by_line.select("project", "line", total(F.col("hours")).alias("hours"), total(F.col("cost")).alias("cost"), level(0))
        .unionByName(by_line.groupBy("project").agg(*sums).select("project", none[1], "hours", "cost", level(1)))
        .unionByName(by_line.agg(*sums).select(*none, "hours", "cost", level(3)))
    )


def mission_drift(projects: DataFrame, by: Column, name: str, most: float = 0.30) -> DataFrame:
    """Share of work outside the mission, by projects and weighted by hours."""
    off = F.col("mission") == False  # noqa: E712
    return (
        projects.groupBy(by.alias(name))
        .agg(
            ratio(F.count_if(off), F.count("mission"), 4).alias("share"),
            ratio(F.sum(F.when(off, F.col("hours")).otherwise(0)), F.sum("hours"), 4).alias("hours_share"),
        )
        .withColumn("drift", F.col("hours_share") > most)
    )


def quote(lines: DataFrame) -> DataFrame:
    """Proposal totals: rush surcharge, capped discount, half now and half on delivery."""
    subtotal = lines.groupBy("proposal").agg(
        F.sum(F.col("quantity") * F.col("rate")).alias("subtotal"),
        F.max(F.col("rush")).alias("rush"),
        F.max(F.col("aligned")).alias("aligned"),
        F.max("discount_pct").alias("discount_pct"),
    )
    cap = F.when(F.col("aligned"), DISCOUNT_CAPS["aligned"]).otherwise(DISCOUNT_CAPS["other"])
    rushed = money(F.when(F.col("rush"), F.col("subtotal") * _dec(RUSH_RATE)).otherwise(F.col("subtotal")))
    granted = F.least(F.col("discount_pct"), cap)
    priced = subtotal.select("proposal", rushed.alias("gross"), granted.cast("int").alias("granted_pct"))
    cut = money(F.col("gross") * (100 - F.col("granted_pct")).cast("decimal(5,2)") / F.lit(100).cast("decimal(5,2)"))
    total = priced.withColumn("total", cut)
    half = money(F.col("total") * F.lit("0.5").cast("decimal(2,1)"))
    return total.withColumn("deposit", half).withColumn("balance", money(F.col("total") - F.col("deposit")))


def effective_rate(projects: DataFrame, floor: int | Column = 500) -> DataFrame:
    """Value per hour by tier against the hourly floor; with a floor that is a column, by tier and floor."""
    if isinstance(floor, Column):
        by = projects.groupBy("tier", floor.alias("floor"))
        rates = by.agg(ratio(F.sum("value"), F.sum("hours"), 2).alias("hourly"), F.count(F.lit(1)).alias("projects"))
        return rates.withColumn("below_floor", F.col("hourly") < F.col("floor"))
    return (
        projects.groupBy("tier")
        .agg(ratio(F.sum("value"), F.sum("hours"), 2).alias("hourly"), F.count(F.lit(1)).alias("projects"))
        .withColumn("below_floor", F.col("hourly") < floor)
    )


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column) -> DataFrame:
    return running(df, keys, order, bucket, [RunningSum("running_total", F.col(value))])


def cumulative_by_month(ledger: DataFrame, key: str) -> DataFrame:
    """Monthly income and its running total; months are summed before the window."""
    monthly = (
        ledger.filter(F.col("kind") == "income")
        .groupBy(key, F.trunc("date", "month").alias("month"))
        .agg(money(F.sum("amount")).alias("amount"))
    )
    upto = W.partitionBy(key).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return monthly.withColumn("running_total", money(F.sum("amount").over(upto)))


def period_change(df: DataFrame, key: str, period: Column, value: Column) -> DataFrame:
    """Period totals with the change against the period before."""
    totals = df.groupBy(key, period.alias("period")).agg(money(F.sum(value)).alias("amount"))
    w = W.partitionBy(key).orderBy("period")
    before = F.lag("amount").over(w)
    return totals.withColumn("change", money(F.col("amount") - before)).withColumn(
        "change_pct", F.bround(100 * F.try_divide(F.col("change").cast("double"), before.cast("double")), 1)
    )
