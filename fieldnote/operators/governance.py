"""Validation, sanitising, secret scans, consent and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.functions.ordered import Previous, running
from fieldnote.functions.stats import day, minutes_between
from fieldnote.session import local_table

# Touch types.
TOUCH_TYPES = (
    "email-sent", "email-received", "call", "meeting", "session", "referral-given",
    "referral-received", "stewardship-touch", "proposal-sent", "other",
)
# The declared stage graphs.
CONTACT_STAGES = [
    ("new-contact", "qualified"), ("qualified", "proposal-sent"), ("proposal-sent", "engaged"),
    ("engaged", "active-client"), ("active-client", "past-client"), ("engaged", "declined"),
    ("engaged", "wrong-fit"),
]
FUNDER_STAGES = [
    ("research", "loi-prep"), ("loi-prep", "submitted"), ("submitted", "reviewed"),
    ("reviewed", "awarded"), ("reviewed", "declined"),
]
# Secret families, and what marks a placeholder.
SECRET_PATTERNS = {
    "sk_ant_key": r"sk-ant-[A-Za-z0-9_-]+",
    "sk_key": r"sk-[A-Za-z0-9]{40,}",
    "apify_token": r"apify_api_[A-Za-z0-9]+",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pos]_[A-Za-z0-9]{20,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "env_assignment": r"(?i)[a-z_]*(?:key|token|secret|password)[a-z_]*[ ]*=[ ]*[^ \n\r\t]+",
}
# Fixed value: cheap test that any family can occur at all.
SECRET_MARK = (
    r"sk-|apify_api_|AKIA|gh[pos]_|PRIVATE KEY-----|(?i:(?:key|token|secret|password)[a-z_]*[ ]*=)"
)
PLACEHOLDER = r"(?i)(?:example|placeholder|your[-_]|xxx|changeme|<[a-z_ -]+>)"

# Columns an entity loses per destination; None keeps everything, and an
# entity without an entry for a destination is not released there.
METRICS = "metrics"
SANITIZE = {
    "contacts": {"*": ["email", "phone", "notes"]},
    "projects": {"*": ["contractValue", "hoursLogged"], METRICS: []},
    "financials": {METRICS: []},
}
# Consent tier each purpose needs.
CONSENT = {"internal": 1, "aggregate": 2, "identified": 3}


def validate(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """One row per record and broken rule; a rule that evaluates to null counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(key, F.explode(broken).alias("rule"))


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values))


def sanitize(df: DataFrame, entity: str, dest: str) -> DataFrame:
    """``df`` without what the entity's policy withholds from ``dest``; closed for what no policy names."""
    policy = SANITIZE.get(entity, {})
    lost = policy.get(dest, policy.get("*"))
    if lost is None:
        raise PermissionError(f"{entity} is not released to {dest}")
    if absent := set(lost) - set(df.columns):
        raise ValueError(f"columns that {entity} must lose are not there: {sorted(absent)}")
    return df.drop(*lost)


def secret_hits(docs: DataFrame, key: str, text: str = "text", allow: str = PLACEHOLDER) -> DataFrame:
    """Every secret found in a text, placeholders left out.

    One alternation without leading repetition skips the texts that cannot hold any.
    """
    def family(name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("family"), m.alias("secret")))

    hits = F.flatten(F.array(*[family(n, p) for n, p in SECRET_PATTERNS.items()]))
    found = docs.filter(F.col(text).rlike(SECRET_MARK)).select(key, F.inline(hits))
    return found.filter(~F.col("secret").rlike(allow))


def bad_transitions(history: DataFrame, edges: Sequence[tuple[str, str]]) -> DataFrame:
    """Stage changes the declared graph does not allow; staying in a stage is no change."""
    steps = running(
        history, ["contact_id"], ["date", "touch_id"], F.col("date"), [Previous("from_status", F.col("status"))]
    )
    changes = steps.filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")))
    allowed = local_table(history.sparkSession, list(edges), "from_status string, status string")
    return changes.join(allowed, ["from_status", "status"], "left_anti")


def append_only_breaches(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Earlier rows that were changed or removed."""
    # A digest of the row travels, not the row.
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in old.columns]), {"ignoreNullFields": "false"}), 256)
    now = new.select(F.col(key).alias("_key"), digest.alias("_now"))
    joined = old.select(key, digest.alias("_was")).join(now, F.col(key) == F.col("_key"), "left")
    same = F.col("_was") == F.col("_now")
    what = F.when(F.col("_key").isNull(), "removed").otherwise("changed")
    return joined.filter(F.col("_key").isNull() | ~same).select(key, what.alias("breach"))


def late_log(touches: DataFrame, hours: int = 24, happened: str = "happened_at", logged: str = "logged_at") -> DataFrame:
    late = minutes_between(F.col(logged), F.col(happened))
    return touches.withColumn("minutes_late", late).filter(F.col("minutes_late") > hours * 60)


def releasable(df: DataFrame, purpose: str) -> DataFrame:
    return df.filter(F.col("consent_tier") >= CONSENT[purpose])


def expired(df: DataFrame, as_of: str, days: int = 90, confirmed: str = "delivered_on") -> DataFrame:
    return df.filter(F.date_add(confirmed, days) <= day(as_of))


def anonymized(df: DataFrame, drop: Sequence[str], pseudonym: str) -> DataFrame:
    """Rows released for aggregate use, identifiers dropped and the key hashed."""
    return releasable(df, "aggregate").withColumn(
        pseudonym, F.sha2(F.col(pseudonym).cast("string"), 256)
    ).drop(*drop)


def forget(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows that stay after an erasure request."""
    return df.join(ids.select(key), key, "left_anti")


def forget_everywhere(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table, named with the column that holds the person, without the rows of ``ids``."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    return {
        name: df.join(gone, F.col(column) == F.col("_gone"), "left_anti") for name, (df, column) in tables.items()
    }
