"""Mixing sources to target weights by weighted sampling without replacement.

Targets: the sources share ``total`` times all words by their weights; a target stops at
``most`` times its source's words, and the excess is shared again by weight (one pass over
the sources in order of the level at which they fill up).

Within a source the complete epochs come first: every document is taken as often as the
target holds the whole source.  The rest is a weighted sample (Efraimidis and Spirakis):
each document draws the exponential key -ln(u) / quality, documents are taken in key order,
and the prefix sum of their words stops at the rest.  The document on the border gives its
first words.  u is a hash of the row, so reruns agree.

Scale: no source is ever sorted whole.  Sums over 1,024 slices of the key range, then over
1,024 slices of the one that holds the border, leave a millionth of the source to be
ordered.  What is joined to the documents is one row per source.

Defined results: a null or blank text has size 0 and takes 0; rows alike in id and text
share what falls to them evenly; a null source is a source of its own, last in order; an
empty table gives an empty result; extra columns are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm import text as T
from fieldnote.session import cut_lineage

WEIGHTS = (3, 1, 2)
SLICES = 1024


def size_of(text: Column) -> Column:
    return F.size(T.words(text)).cast("long")


def quality_of(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters that are neither digits nor symbols."""
    whole = F.coalesce(text, F.lit(""))
    clean = F.length(F.translate(whole, "0123456789#*$%&|<>{}[]=_\\", ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(clean.cast("double"), F.length(whole)), F.lit(0.1)))


def place_of(doc_id: Column, text: Column) -> Column:
    """(key, tie): where a row stands in the order of its source."""
    tie = F.xxhash64(doc_id, text)
    u = (F.pmod(F.xxhash64(tie, F.lit("draw")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.ln(u) / quality_of(text)).alias("key"), tie.alias("tie"))


def draws(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and place (key, tie) of every row: all that the selection needs."""
    return docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), place_of(F.col("doc_id"), F.col("text")).alias("place")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    filling = Window.orderBy("level", "n")
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = (
        sizes.withColumn("weight", weight)
        .withColumn("n", F.row_number().over(order))
        .withColumn("level", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(below), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("share", (F.lit(total) * F.col("all") - F.col("filled")) / F.col("open"))
        .withColumn("share", F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "n", "share"))).over(everything)["share"])
    )
    cap = F.lit(most) * F.col("source_size")
    return ordered.select(
        "source", "source_size", F.least(cap, F.coalesce(F.col("share") * F.col("weight"), cap)).cast("double").alias("target")
    )


def _slice(df: DataFrame, value: str, out: str) -> DataFrame:
    """Deals ``value`` in [0, 1) to SLICES slices and keeps what is left of it within its slice."""
    scaled = F.col(value) * SLICES
    at = F.least(F.floor(scaled), F.lit(SLICES - 1))
    return df.withColumn(out, at.cast("int")).withColumn(value, scaled - at)


def _border(rows: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """The slice (or key) of each source in which the prefix sum of words reaches what is left."""
    sums = rows.groupBy("source", by).agg(F.sum("size").alias("part"))
    upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    reached = sums.withColumn("sum", F.sum("part").over(upto)).alias("r").join(
        sources.alias("s"), F.expr("r.source <=> s.source")
    ).filter("r.sum >= s.left and s.left > 0")
    return reached.groupBy("s.source").agg(
        F.min(F.struct(f"r.{by}", (F.col("s.left") - F.col("r.sum") + F.col("r.part")).alias("left"))).alias("b")
    ).select("source", F.col(f"b.{by}").alias(by), F.col("b.left").alias("left"))


def _inside(rows: DataFrame, border: DataFrame, by: str) -> DataFrame:
    return rows.alias("r").join(border.alias("b"), F.expr(f"r.source <=> b.source and r.{by} = b.{by}")).select("r.*")


def plan(drawn: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its words, target, complete epochs, and the border of the sample
    (last key and tie, and how many words the rows there give)."""
    rows = drawn.withColumn("x", 1 - F.exp(-F.col("place.key")))
    rows = _slice(_slice(rows, "x", "coarse"), "x", "fine")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sizes, weights, total, most)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    aimed = cut_lineage(aimed.withColumn("epochs", epochs).withColumn(
        "left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    ))
    coarse = cut_lineage(_border(rows, aimed, "coarse"))
    rows = _inside(rows, coarse, "coarse")
    fine = cut_lineage(_border(rows, coarse, "fine"))
    rows = _inside(rows, fine, "fine").select("source", "size", "place")
    last = _border(rows, fine, "place")
    alike = rows.groupBy("source", "place").agg(F.count(F.lit(1)).alias("alike"))
    last = last.alias("l").join(alike.alias("a"), F.expr("l.source <=> a.source and l.place = a.place")).select(
        "l.source", "l.place", F.expr("floor(l.left / a.alike)").alias("give")
    )
    return cut_lineage(aimed.alias("s").join(last.alias("l"), F.expr("s.source <=> l.source"), "left").select(
        "s.source", "s.source_size", "s.target", "s.epochs", "l.place", "l.give"
    ))


def _sampled(place: Column, size: Column) -> Column:
    """Words that the sample takes of a row, beside the complete epochs."""
    part = F.when(place < F.col("p.place"), size).when(place == F.col("p.place"), F.col("p.give")).otherwise(0)
    return F.coalesce(part, F.lit(0))


def mixture(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every document."""
    drawn = cut_lineage(draws(docs))
    sources = plan(drawn, weights, total, most)
    taken = (F.col("p.epochs") * F.col("d.size") + _sampled(F.col("d.place"), F.col("d.size"))).cast("long")
    return drawn.alias("d").join(sources.alias("p"), F.expr("d.source <=> p.source")).select(
        "d.doc_id", "d.size", "d.source", "p.source_size", "p.target", taken.alias("taken")
    )


def mix(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: every document once per complete take, and the border document of
    a source cut behind the words it gives.  Columns as in ``docs``; ``n_chars`` is renewed."""
    sources = plan(cut_lineage(draws(docs)), weights, total, most)
    place = place_of(F.col("d.doc_id"), F.col("d.text"))
    more = _sampled(place, F.lit(-1))  # -1: the whole document
    takes = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("p.epochs").cast("int")),
        F.when(more == 0, F.array().cast("array<bigint>")).otherwise(F.array(more.cast("long"))),
    )
    joined = docs.alias("d").join(sources.alias("p"), F.expr("d.source <=> p.source")).select("d.*", F.explode(takes).alias(T.free_name(docs.columns)))
    return _cut(joined, docs.columns)


def _cut(taken: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose last column says how many words stay (-1: all)."""
    n = F.col(taken.columns[-1])
    inner = F.slice(T.words(F.col("text")), F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    text = F.when(n < 0, F.col("text")).otherwise(F.array_join(inner, " "))
    made = {"text": text}
    if "n_chars" in columns:
        made["n_chars"] = F.when(n < 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return taken.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in columns])
