"""Survey responses, participation and coded transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.functions.stats import band, ratio

# Bands of the readiness total, stages of the fear journey.
READINESS_BANDS = [(0, "may not be ready"), (10, "significant work"), (15, "moderate"), (20, "high")]
FEAR_STAGES = ("fear-surface", "fear-underlying", "fear-root", "fear-transformation")


def mean_of(col: str, digits: int = 4) -> Column:
    """Exact integer sum over count, so the result does not depend on the task order."""
    return ratio(F.sum(col), F.count(col), digits)


def likert(responses: DataFrame) -> DataFrame:
    """Mean and count per assessment point and question, with all subtotals."""
    cubed = responses.cube("point", "question").agg(
        mean_of("score").alias("mean"), F.count("score").alias("answers"), F.grouping_id().alias("_g")
    )
    return cubed.select(
        F.when(F.col("_g").bitwiseAND(2) > 0, "*").otherwise(F.col("point")).alias("point"),
        F.when(F.col("_g").bitwiseAND(1) > 0, "*").otherwise(F.col("question")).alias("question"),
        "mean",
        "answers",
    )


def nps(responses: DataFrame, by: str) -> DataFrame:
    """Mean 0-10 score, and promoters minus detractors next to it."""
    up, down = F.count_if(F.col("score") >= 9), F.count_if(F.col("score") <= 6)
    return responses.groupBy(by).agg(
        mean_of("score", 2).alias("mean_score"),
        F.bround(100 * F.try_divide((up - down).cast("double"), F.count("score").cast("double")), 1).alias("net"),
        F.count("score").alias("answers"),
    )


def consistency(responses: DataFrame, questions: Sequence[str] = ("q1", "q2", "q3")) -> DataFrame:
    """Mean per question and overall for each stakeholder type."""
    per_question = [
        ratio(F.sum(F.when(F.col("question") == q, F.col("score"))), F.count_if(F.col("question") == q), 4).alias(q)
        for q in questions
    ]
    asked = responses.filter(F.col("question").isin(list(questions)))
    return asked.groupBy("stakeholder").agg(*per_question, mean_of("score").alias("overall"))


def stakeholder_variance(responses: DataFrame, key: str = "project") -> DataFrame:
    """Variance of the stakeholder means; null with a single stakeholder group."""
    means = responses.groupBy(key, "stakeholder").agg(ratio(F.sum("score"), F.count("score")).alias("mean"))
    return means.groupBy(key).agg(
        F.count(F.lit(1)).alias("groups"),
        F.round(F.var_samp("mean"), 6).alias("variance"),
        F.round(F.max("mean") - F.min("mean"), 6).alias("spread"),
    )


def register_corr(responses: DataFrame, metrics: DataFrame, by: str, key: str = "project") -> DataFrame:
    """Correlation of the mean consistency of a project with its institutional metric."""
    means = responses.groupBy(key).agg(ratio(F.sum("score"), F.count("score")).alias("mean"))
    return (
        means.join(metrics, key)
        .groupBy(by)
        .agg(F.round(F.corr("mean", "metric"), 6).alias("corr"), F.count(F.lit(1)).alias("projects"))
    )


def readiness(responses: DataFrame, items: Sequence[str], key: str = "project") -> DataFrame:
    """Total of the five items with its band; incomplete forms show how many were answered."""
    asked = responses.filter(F.col("item").isin(list(items)))
    totals = asked.groupBy(key).agg(
        F.sum("score").cast("bigint").alias("total"), F.count_distinct("item").alias("answered")
    )
    return totals.withColumn("band", band(F.col("total"), READINESS_BANDS))


def reach(participation: DataFrame, by: str) -> DataFrame:
    """Sessions per participant, retention, artifacts, distinct organisations and regions."""
    people = participation.groupBy(by, "participant").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("artifacts").alias("artifacts")
    )
    per_program = people.groupBy(by).agg(
        F.count(F.lit(1)).alias("participants"),
        ratio(F.sum("sessions"), F.count(F.lit(1)), 4).alias("sessions_each"),
        F.bround(100 * ratio(F.count_if(F.col("sessions") > 1), F.count(F.lit(1))), 1).alias("retention_pct"),
        F.sum("artifacts").cast("bigint").alias("artifacts"),
    )
    places = participation.groupBy(by).agg(
        F.count_distinct("org").alias("orgs"), F.count_distinct("region").alias("regions")
    )
    return per_program.join(places, by)


def reach_estimate(participation: DataFrame, by: str, error: float = 0.02) -> DataFrame:
    """Distinct participants from one fixed-size sketch per group, for very large inputs."""
    return participation.groupBy(by).agg(F.approx_count_distinct("participant", error).alias("participants"))


def reach_sketches(participation: DataFrame, by: str, period: Column, size: int = 12) -> DataFrame:
    """One sketch of 2^size small counters per group and period, to be stored once and merged for any span."""
    return participation.groupBy(by, period.alias("period")).agg(F.hll_sketch_agg("participant", size).alias("sketch"))


def reach_merged(sketches: DataFrame, by: str, size: int = 12) -> DataFrame:
    """Distinct participants over all given periods: the estimate, and bounds three standard errors apart."""
    error = 3 * 1.04 / (1 << size) ** 0.5
    merged = sketches.groupBy(by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("participants"))
    return merged.withColumns(
        {"low": F.floor(F.col("participants") * (1 - error)).cast("bigint"), "high": F.ceil(F.col("participants") * (1 + error)).cast("bigint")}
    )


def unit_costs(costs: DataFrame, by: str) -> DataFrame:
    """Cost per participant and equipment utilisation (days in use of days available)."""
    return costs.groupBy(by).agg(
        ratio(F.sum("cost"), F.count_distinct("participant"), 2).alias("cost_per_participant"),
        ratio(F.sum("days_used"), F.sum("days_available"), 4).alias("utilisation"),
    )


def asset_use(assets: DataFrame, by: str) -> DataFrame:
    return assets.groupBy(by).agg(
        ratio(F.count_if(F.col("in_use")), F.count("in_use"), 4).alias("still_used"),
        F.sum("uses").cast("bigint").alias("uses"),
    )


def register_matrix(projects: DataFrame, royal_high: float, nomadic_high: float) -> DataFrame:
    """Four readings from two thresholds."""
    royal, nomadic = F.col("royal") >= royal_high, F.col("nomadic") >= nomadic_high
    reading = (
        F.when(royal & nomadic, "convergence")
        .when(royal, "royal only")
        .when(nomadic, "nomadic only")
        .otherwise("both low")
    )
    return projects.groupBy(reading.alias("reading")).agg(
        F.count(F.lit(1)).alias("projects"), mean_of("royal", 3).alias("mean_royal"), mean_of("nomadic", 3).alias("mean_nomadic")
    )


def pre_post(responses: DataFrame, before: str, after: str) -> DataFrame:
    """Mean at two points per project and question, with the change where both exist."""
    a, b = F.col("point") == before, F.col("point") == after

    def at(cond: Column) -> Column:
        return ratio(F.sum(F.when(cond, F.col("score"))), F.count_if(cond))

    both = responses.filter(a | b).groupBy("project", "question").agg(at(a).alias("pre"), at(b).alias("post"))
    return both.filter(F.col("pre").isNotNull() & F.col("post").isNotNull()).withColumn(
        "change", F.bround(F.col("post") - F.col("pre"), 4)
    )


def outstanding(shipped: DataFrame, returned: DataFrame, keys: Sequence[str] = ("kit", "engagement")) -> DataFrame:
    """Kits shipped and not yet back."""
    return shipped.join(returned.select(*keys), list(keys), "left_anti")


def return_rate(shipped: DataFrame, returned: DataFrame, by: str, keys: Sequence[str] = ("kit", "engagement")) -> DataFrame:
    back = returned.select(*keys).distinct().withColumn("_back", F.lit(1))
    joined = shipped.join(back, list(keys), "left")
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("shipped"),
        F.count("_back").alias("returned"),
        ratio(F.count("_back"), F.count(F.lit(1)), 4).alias("return_rate"),
    )


# --- coded transcripts ------------------------------------------------------------------
def apply_codes(turns: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """One row per turn and code whose pattern occurs; each text is read in one pass."""
    hits = F.array_compact(
        F.array(*[F.when(F.col(text).rlike(f"(?iU){p}"), F.lit(code)) for code, p in patterns.items()])
    )
    return turns.withColumn("code", F.explode(hits)).drop(text)


def code_freq(codes: DataFrame) -> DataFrame:
    return codes.groupBy("client", "code").agg(
        F.count(F.lit(1)).alias("segments"), F.count_distinct("session").alias("sessions")
    )


def shared_codes(codes: DataFrame, least: int = 2) -> DataFrame:
    """Codes seen in at least ``least`` engagements."""
    seen = codes.groupBy("code").agg(F.count_distinct("client").alias("clients"), F.count(F.lit(1)).alias("segments"))
    return seen.filter(F.col("clients") >= least)


def code_cooccurrence(codes: DataFrame) -> DataFrame:
    """Segments in which two codes meet.

    Segments are reduced to their set of codes (at most the size of the codebook), equal
    sets are counted, and only the distinct sets are unfolded into pairs.
    """
    sets = codes.groupBy("client", "session", "segment").agg(F.array_sort(F.collect_set("code")).alias("set"))
    counted = sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    first = counted.select("set", "n", F.explode("set").alias("code_a"))
    later = F.filter("set", lambda c: c > F.col("code_a"))
    return (
        first.select("code_a", F.explode(later).alias("code_b"), "n")
        .groupBy("code_a", "code_b")
        .agg(F.sum("n").alias("segments"))
    )


def code_by_approach(codes: DataFrame, sessions: DataFrame, code: str) -> DataFrame:
    """Occurrences of a code per session, by facilitation approach."""
    per_session = codes.filter(F.col("code") == code).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    joined = sessions.join(per_session, "session", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return joined.groupBy("approach").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(n).alias("occurrences"),
        ratio(F.sum(n), F.count(F.lit(1)), 4).alias("per_session"),
    )


def texture(turns: DataFrame, classes: dict[str, str], key: str = "session", text: str = "text") -> DataFrame:
    """Occurrences of each word class per session, and per hundred words."""
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    counts = [F.regexp_count(text, F.lit(f"(?iU){p}")).alias(n) for n, p in classes.items()]
    per_turn = turns.select(key, words.alias("words"), *counts)
    summed = per_turn.groupBy(key).agg(*[F.sum(c).alias(c) for c in ["words", *classes]])
    rates = {f"{n}_rate": ratio(100 * F.col(n), F.col("words"), 4) for n in classes}
    return summed.withColumns(rates)


def fear_arc(codes: DataFrame, stages: Sequence[str] = FEAR_STAGES) -> DataFrame:
    """First time each stage is reached, the furthest one, and whether they came in order."""
    firsts = codes.filter(F.col("code").isin(list(stages))).groupBy("client").agg(
        *[F.min(F.when(F.col("code") == s, F.col("pos"))).alias(f"at_{i}") for i, s in enumerate(stages, 1)]
    )
    at = [F.col(f"at_{i}") for i in range(1, len(stages) + 1)]
    furthest = F.greatest(*[F.when(c.isNotNull(), i) for i, c in enumerate(at, 1)])
    reached = F.array_compact(F.array(*at))
    return firsts.withColumn("furthest", furthest.cast("bigint")).withColumn(
        "in_order", reached == F.array_sort(reached)
    )


def shift(df: DataFrame, key: str, order: Column, values: Sequence[str]) -> DataFrame:
    """Values at the first and last session of each key, and their difference."""
    ends = df.groupBy(key).agg(
        *[F.min_by(v, order).alias(f"first_{v}") for v in values],
        *[F.max_by(v, order).alias(f"last_{v}") for v in values],
    )
    return ends.withColumns({f"shift_{v}": F.col(f"last_{v}") - F.col(f"first_{v}") for v in values})
