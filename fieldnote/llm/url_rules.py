"""Host and path rules for URLs as a range join by a sorted sweep.

A rule's host is turned round, each label followed by a dot (``com.example.``), so that a
host and all its subdomains share a prefix of the canonical key.  Host part plus path make
a key whose prefixes are intervals of the sort order, and the intervals nest.  The sweep
runs over rules and URLs of one host part in path order; each rule event carries the stack
of rules that are open there, and a URL takes the deepest open rule that it lies in.

Scale: only distinct (host, path) pairs take part.  A host part with many URLs is dealt to
as many salts as its count asks for, and its rules go to each of them.

Defined results: a null URL, or one without ``://``, has empty host and path and gets the
default verdict; repeated pages get the same row each; of several rules with the same host
and path ``block`` counts; of fitting rules the longest text wins, then the longest host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm import text as T

# URLs that one sweep holds for a host part before the part is dealt to more salts.
URLS_PER_SALT = 100_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return T.lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _key(labels: Column) -> Column:
    """Labels from the top-level domain on, each followed by a dot."""
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with all rules of its host part that it lies in, the outermost first, itself last."""
    one = rules.select(
        T.lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("/")).alias("rpath"), F.col("verdict")
    ).groupBy("host", "rpath").agg(F.max("verdict").alias("verdict"))
    one = one.withColumn("anchor", _key(F.reverse(F.split("host", r"\."))))
    outer = one.select("anchor", F.col("rpath").alias("outer"), F.struct("rpath", "host", "verdict").alias("rule"))
    inside = one.select(
        "anchor", "rpath", F.explode(F.sequence(F.lit(0), F.length("rpath"))).alias("n")
    ).select("anchor", "rpath", F.col("rpath").substr(F.lit(1), F.col("n")).alias("outer"))
    return (
        inside.join(outer, ["anchor", "outer"])
        .groupBy("anchor", "rpath")
        .agg(F.sort_array(F.collect_list("rule")).alias("stack"))
    )


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``urls`` (host, path) made distinct, with the winning ``rule`` text (null: none) and ``verdict``."""
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    distinct = urls.select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    probes = distinct.filter("host != ''").select(
        "host", "path", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))).alias("n")
    ).filter("n > 0").select("host", "path", _key(F.slice("labels", F.lit(1), F.col("n"))).alias("anchor"))
    stacks = _stacks(rules)
    salts = (
        probes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        .join(stacks.select("anchor").distinct(), "anchor")
        .select("anchor", F.ceil(F.col("n") / URLS_PER_SALT).cast("int").alias("salts"))
    )
    opening = stacks.join(salts, "anchor").select(
        "anchor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.col("rpath").alias("path"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack",
    )
    asking = probes.join(salts, "anchor").select(
        "anchor", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
        "path", F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
    )
    sweep = Window.partitionBy("anchor", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        opening.unionByName(asking)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .filter("kind = 1")
        .select("host", "path", F.try_element_at(F.filter("open", lambda r: F.col("path").startswith(r["rpath"])), F.lit(-1)).alias("rule"))
        .filter("rule is not null")
        .withColumn("name", F.concat("rule.host", "rule.rpath"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("name", "rule.verdict"), F.struct(F.length("name"), F.length("rule.host"))).alias("best"))
    )
    return distinct.join(met, ["host", "path"], "left").select(
        "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.  ``rules``: host, path, verdict.

    Columns of ``pages`` with one of these names are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    known = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return known.join(judge(known, rules, default), ["host", "path"], "left").select(*kept, "host", "path", "rule", "verdict")
