"""Service tiers and practice rules as dimension tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnote.session import local_table

# Tier, key, segment, price floor and ceiling, pricing model, longest and
# shortest duration, offered now.
TIERS = [
    (1, "story", "rebuilder", "1500", "2500", "fixed", 3, None, None, True),
    (2, "program", "container-builder", "3000", "8000", "fixed", 12, None, None, True),
    (3, "embedding", "emergent-practitioner", "4000", "8000", "monthly-retainer", None, 3, 12, False),
]
TIER_SCHEMA = (
    "tier int, key string, segment string, floor decimal(18,2), ceiling decimal(18,2), model string, "
    "max_weeks int, min_months int, max_months int, offered boolean"
)
# Rule, amount.
RULES = [("hourly_floor", "500"), ("pause_days", "5"), ("reserve_rate", "0.30"), ("floor_tolerance", "0.70")]


def tiers(spark: SparkSession) -> DataFrame:
    return local_table(spark, TIERS, TIER_SCHEMA)


def rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, RULES, "rule string, amount decimal(18,2)")


DATED_SCHEMA = "rule string, amount decimal(18,4), valid_from date"


@dataclass(frozen=True)
class RuleBook:
    """Rules as dated rows: a row holds from its date until the next row of its rule.

    The rows are hand-written and few, so they are compiled into the plan: the amount in force on a date is a CASE over
    literals, and no row of data is joined or moved for it.  A row without date holds from the beginning; of two rows
    of one date the larger amount counts; before the first row of a rule its amount is null.
    """

    rows: tuple[tuple[str, Decimal, date | None], ...]

    @classmethod
    def of(cls, table: DataFrame) -> RuleBook:
        return cls(tuple((r["rule"], r["amount"], r["valid_from"]) for r in table.select("rule", "amount", "valid_from").collect()))

    @classmethod
    def fixed(cls, changes: Sequence[tuple[str, str, str]] = ()) -> RuleBook:
        """The fixed rules, and ``changes`` of them (rule, amount, first day)."""
        base = [(rule, Decimal(amount), None) for rule, amount in RULES]
        return cls(tuple(base + [(rule, Decimal(amount), date.fromisoformat(day)) for rule, amount, day in changes]))

    def amount(self, rule: str, on: Column) -> Column:
        """The amount of a rule in force on a day."""
        rows = sorted(((d or date.min, a) for r, a, d in self.rows if r == rule), reverse=True)
        if not rows:
            raise KeyError(rule)
        out = F.lit(None).cast("decimal(18,4)")
        for day, amount in reversed(rows):
            here = F.lit(str(amount)).cast("decimal(18,4)")
            out = F.when(F.lit(True) if day == date.min else on >= F.lit(day), here).otherwise(out)
        return out
