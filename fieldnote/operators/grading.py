"""Grade text runs against assertion tables and turn the grades into A/B scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.functions import text as T
from fieldnote.functions.patterns import PatternIndex, hits_of
from fieldnote.functions.rules import apply_rules
from fieldnote.functions.stats import pct
from fieldnote.session import BROADCAST_BYTES, BROADCAST_ROWS, small

MODES = ("with_skill", "baseline")
PENDING = "pending_llm_grade"
RUN_KEYS = ["skill", "iteration", "eval", "mode", "run_id"]


def latest_iteration(df: DataFrame, name: str = "iteration_name", compat: str = "numeric") -> DataFrame:
    """Rows of each skill's newest iteration.

    ``iteration-10`` follows ``iteration-2``; ``compat='lexical'`` compares the names as text.
    The newest name per skill is aggregated first, so a skill with most of the rows costs
    one partial row per task.
    """
    number = F.regexp_extract(F.col(name), r"iteration-([0-9]+)$", 1).try_cast("int")
    rank = number if compat == "numeric" else F.col(name)
    ranked = df.withColumn("_rank", rank)
    newest = ranked.groupBy(F.col("skill").alias("_skill")).agg(F.max("_rank").alias("_max"))
    hit = F.col("skill").eqNullSafe(F.col("_skill")) & (F.col("_rank") == F.col("_max"))
    return ranked.join(newest, hit, "left_semi").drop("_rank")


def expected_grid(specs: DataFrame, iterations: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Every (skill, iteration, eval, mode) that should have an output."""
    evals = specs.select("skill", "eval").distinct()
    grid = iterations.select("skill", "iteration").distinct().join(evals, "skill")
    return grid.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def with_missing(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """Runs plus one error row for every expected output that is absent."""
    keys = ["skill", "iteration", "eval", "mode"]
    absent = grid.join(runs.select(*keys).distinct(), keys, "left_anti")
    where = F.concat_ws("/", "skill", F.concat(F.lit("iteration-"), F.col("iteration")), "eval", "mode")
    absent = absent.withColumn("error", F.concat(F.lit("output missing: "), where))
    return runs.withColumn("error", F.lit(None).cast("string")).unionByName(absent, allowMissingColumns=True)


def text_metrics(runs: DataFrame, signers: Sequence[str] = (), text: str = "text", index: PatternIndex | None = None) -> DataFrame:
    """Body, quote-free body, word and line counts, each computed once per document, and with an
    ``index`` the first match of each of its patterns (``found``).

    They are built inside one higher-order function, which Spark evaluates before the next
    operator.  As plain columns they would be deferred into the join with the assertions and
    computed again for every assertion.
    """

    def measure(body: Column) -> Column:
        return F.struct(
            body.alias("body"),
            T.strip_quotes(body).alias("unquoted"),
            T.word_total(body).alias("words"),
            T.line_total(body).alias("lines"),
            T.is_ascii(body).alias("ascii"),
        )

    measured = T.let(T.extract_body(F.col(text), signers), measure)
    if index is not None:
        kept = ("body", "unquoted", "words", "lines", "ascii")
        measured = T.let(measured, lambda m: F.struct(*[m[c].alias(c) for c in kept], index.found(m).alias("found")))
    return runs.withColumn("_m", measured).select("*", "_m.*").drop("_m")


def assertion_union(universal: DataFrame, fixture: DataFrame) -> DataFrame:
    """Bag union; universal rows have no eval."""
    return universal.unionByName(fixture, allowMissingColumns=True)


def expand(runs: DataFrame, assertions: DataFrame, few: bool | None = None) -> DataFrame:
    """One row per run and applicable assertion, in one pass over the runs.  A run without any, or
    with an ``error``, stays as one row without assertion, so that summaries list every run.

    Universal assertions (``eval`` null) meet every run of their skill, fixture assertions
    only runs of their eval.  A definition table is broadcast after its size was checked (``few``: by the
    caller), so the texts stay where they were read.
    """
    rules = small(assertions) if few is None else F.broadcast(assertions) if few else assertions
    rules = rules.withColumnsRenamed({"skill": "_skill", "eval": "_eval"})
    here = F.col("_eval").isNull() | (F.col("_eval") == F.col("eval"))
    if "error" in runs.columns:
        here = here & F.col("error").isNull()
    return runs.join(rules, (F.col("skill") == F.col("_skill")) & here, "left").drop("_skill", "_eval")


def grade(
    runs: DataFrame,
    assertions: DataFrame,
    prior: DataFrame | None = None,
    signers: Sequence[str] = (),
    legacy: bool = False,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Expectations in long form: one row per run and assertion with a three-valued grade.

    All patterns of the assertions are tried on a text before the assertions multiply it; what is multiplied are its
    counts and first matches (and its texts only if a rule of one's own reads them).
    """
    failed = [c for c in runs.columns if c == "error"]
    index = PatternIndex.of(assertions)
    measured = text_metrics(runs, signers, index=index).select(*keys, *failed, "body", "unquoted", "words", "lines", "ascii", "found")
    few = index.rows <= BROADCAST_ROWS and index.bytes <= BROADCAST_BYTES
    pairs = expand(measured, assertions.withColumn("_places", index.places_of(F.col("patterns"))), few)
    verdict = F.when(F.col("check") == "programmatic", apply_rules(F.col("rule"), legacy))
    graded = pairs.withColumn("hits", hits_of(F.col("_places"))).withColumn("_v", verdict).select(
        *keys,
        "assertion_id",
        F.col("assertion").alias("text"),
        "check",
        F.col("_v.passed").alias("passed"),
        F.when(F.col("check") == "qualitative", F.coalesce(F.col("_v.evidence"), F.lit(PENDING)))
        .otherwise(F.col("_v.evidence"))
        .alias("evidence"),
        F.col("words").alias("body_words"),
        F.col("lines").alias("body_lines"),
    )
    return graded if prior is None else carry_forward(graded, prior, [keys[-1]])


def settled(prior: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Usable earlier grades, the last duplicate of an assertion winning."""
    usable = F.col("assertion_id").isNotNull() & F.col("passed").isNotNull()
    usable = usable & (F.coalesce(F.col("evidence"), F.lit("")) != PENDING)
    return (
        prior.filter(usable)
        .groupBy(*keys, "assertion_id")
        .agg(F.max_by(F.struct("passed", "evidence"), "seq").alias("_old"))
    )


def carry_forward(fresh: DataFrame, prior: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Keep qualitative grades given earlier; everything else stays as freshly graded."""
    old = settled(prior, keys)
    qualitative = F.col("check") == "qualitative"
    joined = fresh.join(old, [*keys, "assertion_id"], "left")
    keep = qualitative & F.col("_old").isNotNull()
    return joined.select(
        *[
            F.when(keep, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c)
            if c in ("passed", "evidence")
            else F.col(c)
            for c in fresh.columns
        ]
    )


def classify(expectations: DataFrame, assertions: DataFrame) -> DataFrame:
    """Attach the check class by assertion id.

    An id defined under both classes yields a row for each; an id defined nowhere drops out.
    """
    defs = assertions.filter(F.col("check").isin("programmatic", "qualitative")).select(
        F.col("skill").alias("_skill"), F.col("eval").alias("_eval"), F.col("assertion_id").alias("_id"), F.col("check").alias("_check")
    ).distinct()
    everywhere = defs.filter("_eval IS NULL").drop("_eval")
    # What holds for all evals already needs no second row for one of them.
    for_one = defs.filter("_eval IS NOT NULL").join(everywhere, ["_skill", "_id", "_check"], "left_anti")
    plain = expectations.drop("check")
    here = (F.col("skill") == F.col("_skill")) & (F.col("assertion_id") == F.col("_id"))
    both = [
        plain.join(small(everywhere), here).drop("_skill", "_id"),
        plain.join(small(for_one), here & (F.col("eval") == F.col("_eval"))).drop("_skill", "_id", "_eval"),
    ]
    return both[0].unionByName(both[1]).withColumnRenamed("_check", "check")


def run_scores(expectations: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Passed and total per run and class; an ungraded expectation stays in the total."""
    passed = F.coalesce(F.col("passed"), F.lit(False))
    prog, qual = F.col("check") == "programmatic", F.col("check") == "qualitative"
    return expectations.groupBy(*keys).agg(
        F.count_if(prog & passed).alias("prog_passed"),
        F.count_if(prog).alias("prog_total"),
        F.count_if(qual & passed).alias("qual_passed"),
        F.count_if(qual).alias("qual_total"),
        F.count_if(F.col("passed").isNull() & F.col("assertion_id").isNotNull()).alias("pending"),
        F.max("body_words").alias("words"),
    )


def programmatic_summary(expectations: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Graded-only counts per run.  Qualitative grades already given are counted too."""
    return expectations.groupBy(*keys).agg(
        F.count_if(F.coalesce(F.col("passed"), F.lit(False))).alias("prog_passed"),
        F.count("passed").alias("prog_total"),
        F.coalesce(F.max("body_words"), F.lit(0)).alias("body_words"),
    )


def mode_totals(scores: DataFrame, by: Sequence[str] = ("skill", "mode")) -> DataFrame:
    sums = ["prog_passed", "prog_total", "qual_passed", "qual_total"]
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.sum(c).alias(c) for c in sums],
        (F.sum("words").cast("double") / F.count("words")).alias("mean_words"),
    )


def with_percentages(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "prog_pct": pct(F.col("prog_passed"), F.col("prog_total")),
            "qual_pct": pct(F.col("qual_passed"), F.col("qual_total")),
            "words": F.coalesce(F.bround("mean_words", 0), F.lit(0.0)),
        }
    ).drop("mean_words")


def ab_delta(totals: DataFrame, key: str = "skill", modes: Sequence[str] = MODES) -> DataFrame:
    """Differences between the two modes, taken from the rounded figures."""
    shown = with_percentages(totals)
    sides = shown.groupBy(key).agg(
        *[
            F.coalesce(F.max(F.when(F.col("mode") == m, F.col(c))), F.lit(0.0)).alias(f"{tag}_{c}")
            for tag, m in zip(("a", "b"), modes)
            for c in ("prog_pct", "qual_pct", "words")
        ]
    )
    words = F.col("a_words") - F.col("b_words")
    return sides.select(
        key,
        *[c for c in sides.columns if c != key],
        F.bround(F.col("a_prog_pct") - F.col("b_prog_pct"), 1).alias("prog_delta"),
        F.bround(F.col("a_qual_pct") - F.col("b_qual_pct"), 1).alias("qual_delta"),
        words.alias("words_delta"),
        F.coalesce(F.bround(F.try_divide(100 * words, F.col("b_words")), 0), F.lit(0.0)).alias("words_pct"),
    )


def ab_pairs(scores: DataFrame, value: Column, modes: Sequence[str] = MODES) -> DataFrame:
    """One row per eval with a column for each mode; an absent mode stays null."""
    return scores.groupBy("skill", "eval").pivot("mode", list(modes)).agg(value)


def failure_modes(expectations: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Failures per assertion and mode, most frequent first, ties by assertion id."""
    failed = expectations.filter(~F.col("passed"))
    counts = failed.groupBy("assertion_id", "text").agg(
        *[F.count_if(F.col("mode") == m).alias(f"{m}_fails") for m in modes]
    )
    total = sum((F.col(f"{m}_fails") for m in modes), F.lit(0))
    return (
        counts.withColumn("label", T.label(F.col("text")))
        .drop("text")
        .orderBy(total.desc(), "assertion_id", "label")
    )


def cross_skill(scores: DataFrame) -> DataFrame:
    """Totals per skill and mode, per skill, and overall (``*`` marks a total)."""
    sums = ["prog_passed", "prog_total", "qual_passed", "qual_total"]
    rolled = scores.rollup("skill", "mode").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct("eval").alias("evals"),
        *[F.sum(c).alias(c) for c in sums],
        F.grouping_id().alias("_g"),
    )
    return rolled.select(
        F.when(F.col("_g") == 3, "*").otherwise(F.col("skill")).alias("skill"),
        F.when(F.col("_g") >= 1, "*").otherwise(F.col("mode")).alias("mode"),
        "runs",
        "evals",
        pct(F.col("prog_passed"), F.col("prog_total")).alias("prog_pct"),
        pct(F.col("qual_passed"), F.col("qual_total")).alias("qual_pct"),
    )


def scorecard(expectations: DataFrame) -> dict[str, DataFrame]:
    """The four report tables."""
    scores = run_scores(expectations)
    totals = mode_totals(scores)
    return {
        "aggregate": ab_delta(totals),
        "per_eval": scores,
        "failures": failure_modes(expectations),
        "cross_skill": cross_skill(scores),
    }
