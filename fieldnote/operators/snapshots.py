"""Document snapshots, forbidden terms and review digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """updated / unchanged / added / missing per path.

    Texts are hashed before the shuffle, and the sync date in a header is left out, so a
    new day alone changes nothing.
    """
    dated = r"(?m)\A(> \*\*Canonical source:\*\*.*last synced )[0-9]{4}-[0-9]{2}-[0-9]{2}"

    def prints(df: DataFrame, name: str) -> DataFrame:
        return df.select("path", F.sha2(F.regexp_replace("text", dated, "$1"), 256).alias(name))

    both = prints(old, "was").join(prints(new, "now"), "path", "full_outer")
    change = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("was").isNull(), "added")
        .when(F.col("was") == F.col("now"), "unchanged")
        .otherwise("updated")
    )
    return both.select("path", change.alias("change"))


def voice_leaks(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Documents that use a term reserved for the other practice, with the first hits."""
    any_term = "(?iU)(?:" + "|".join(terms) + ")"
    found = F.array_compact(
        F.array(*[F.nullif(F.regexp_extract(text, f"(?iU)(?:{t})", 0), F.lit("")) for t in terms])
    )
    return docs.filter(F.col(text).rlike(any_term)).withColumn("hits", found)


def review_digest(labelled: DataFrame, lowest: int = 1) -> tuple[DataFrame, DataFrame]:
    """Counts per product and bucket, and the quotes behind them.

    The quotes stay rows, because a product may own a third of all reviews.
    """
    kept = labelled.filter(F.col("score") > lowest)
    counts = kept.groupBy("product", "bucket").agg(
        F.count(F.lit(1)).alias("reviews"),
        (F.sum("score").cast("double") / F.count("score")).alias("mean_score"),
    )
    return counts, kept.drop("score")
