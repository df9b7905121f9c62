"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one
``failures`` number whose bit i says that rule i failed; a policy is a mask over these
bits, so that policies can be changed, compared and ablated without reading a text again.
Only JVM expressions are used and no row leaves its partition before the ablation's
aggregate.

Defined results: a null or blank text has no words and fails ``few_words``; repeated rows
are judged each for itself; extra columns stay as they are, also if they carry the name of
a measurement (``ledger`` puts its own into one struct).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.llm import text as T

# The rules in the order of their bits; each is a condition on the measurements that fails.
# The thresholds are parameters of the policy's author, here the usual ones for prose.
RULES = {
    "few_words": "m.n_words < 50",
    "repetition": "100 * m.n_repeat_words > 50 * m.n_words",
    "symbols": "10 * m.n_symbols > m.n_words",
    "duplicate_lines": "100 * m.n_dup_lines > 30 * m.n_lines",
    "capitals": "100 * m.n_capitals > 50 * m.word_chars",
    "long_words": "m.word_chars > 20 * m.n_words",
}
BASE = ("few_words", "repetition")
# Versioned policies: the rules whose failure rejects a document.
POLICIES = {1: BASE, 2: tuple(RULES)}


def mask(rules) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _windows(words: Column) -> Column:
    """One hash for each window of three consecutive words."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        )
    )


def _in_repeats(hashes: Column) -> Column:
    """How many words lie in a window that the text holds twice or more."""

    def covered(order: Column) -> Column:
        same = lambda i, j: F.get(order, i)["h"] == F.get(order, j)["h"]
        twice = F.filter(order, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        at = lambda d: F.transform(twice, lambda x: x["at"] + d)
        return F.size(F.array_distinct(F.concat(at(0), at(1), at(2))))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(T.let(ordered, covered))

    return T.let(hashes, count)


def ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` with a struct column ``out``: failures (bits) and the measurements."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(T.SPACES)) != "")
    without = lambda chars: F.length(F.translate(whole, chars, "")).cast("long")
    size = F.length(whole).cast("long")

    def measured(words: Column) -> Column:
        def of_lines(ls: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                without(T.SPACES).alias("word_chars"),
                (size - without("#*$%&|<>")).alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _in_repeats(_windows(words)).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                (size - without(T.UPPER)).alias("n_capitals"),
            )

        return T.let(lines, of_lines)

    def judged(m: Column) -> Column:
        bits = [F.when(_condition(rule, m), 1 << i).otherwise(0) for i, rule in enumerate(RULES.values())]
        return F.struct(reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long").alias("failures"), m.alias("measures"))

    return docs.withColumn(out, T.let(T.let(T.words(F.col(text)), measured), judged))


def _condition(rule: str, m: Column) -> Column:
    """A rule text over the measurement struct ``m``: [factor *] m.x (<|>) [factor *] (m.y | number)."""

    def side(words: list[str]) -> Column:
        parts = [m[w[2:]] if w.startswith("m.") else F.lit(int(w)) for w in words if w != "*"]
        return reduce(lambda a, b: a * b, parts)

    tokens = rule.split()
    at = next(i for i, w in enumerate(tokens) if w in "<>")
    left, right = side(tokens[:at]), side(tokens[at + 1 :])
    return left < right if tokens[at] == "<" else left > right


def passes(failures: Column, policy: int = 2) -> Column:
    return failures.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(ledgers: DataFrame, policy: int = 2, out: str = "ledger") -> DataFrame:
    """For each rule of the policy: documents it fails, fails alone, and that pass without it."""
    whole = mask(POLICIES[policy])
    held = F.col(out)["failures"].bitwiseAND(F.lit(whole).cast("long"))
    patterns = ledgers.groupBy(held.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(whole).cast("long") - F.col("r.bit"))
    return (
        patterns.select("bits", "n", rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def keep(docs: DataFrame, policy: int = 2) -> DataFrame:
    """The documents that pass the policy, with the columns they came with."""
    free = T.free_name(docs.columns)
    return ledger(docs, out=free).filter(passes(F.col(free)["failures"], policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
