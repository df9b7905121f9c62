"""Pairwise bouts, score matrices, typed relations and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldnote.functions.ordered import RowNumber, running
from fieldnote.functions.stats import product, ratio
from fieldnote.session import cut_lineage, local_table


def numbered(df: DataFrame, order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """Number all rows 1..n without bringing them to one task."""
    return running(df, [], list(order), bucket, [RowNumber(out)])


def _hash(*cols: str, seed: int | None = None) -> Column:
    """Text hash that every engine computes alike; repeatable, unlike a random number."""
    parts = [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *([F.lit(str(seed))] if seed is not None else []), *parts))


def all_pairs(nodes: DataFrame, key: str) -> DataFrame:
    """Every unordered pair of nodes.

    The result has n(n-1)/2 rows by definition.  Nodes are numbered, each lists the numbers
    after its own, and partners are looked up by number: an equi join, no cross product.
    """
    named = nodes.select(F.col(key).alias("node")).distinct().withColumn("_h", _hash("node"))
    index = numbered(named, ["_h", "node"], F.left("_h", F.lit(3)), "i").drop("_h")
    last = index.agg(F.max("i")).scalar()
    later = index.filter(F.col("i") < last).select(
        F.col("node").alias("one"), F.explode(F.sequence(F.col("i") + 1, last)).alias("i")
    )
    pairs = later.join(index.withColumnRenamed("node", "two"), "i")
    return pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))


def schedule(pairs: DataFrame, seed: int = 42, batch: int = 8) -> DataFrame:
    """Seeded random order of the pairs, in batches."""
    hashed = pairs.withColumn("_h", _hash("a", "b", seed=seed))
    placed = numbered(hashed, ["_h", "a", "b"], F.left("_h", F.lit(3)), "place").drop("_h")
    return placed.withColumn("batch", F.ceil(F.col("place") / batch).cast("bigint"))


def quota_sample(df: DataFrame, mix: dict[str, float], total: int, kind: str, key: str, seed: int = 42) -> DataFrame:
    """``total`` rows split over classes by share, in hash order.  Shares are rounded by largest
    remainders, so that the quotas add up; a class with fewer rows gives all it has, and
    nobody else gives more for it.

    The fixed upper limit lets every task drop rows beyond the largest quota before the
    shuffle, so a class with most of the rows costs no more than the others.
    """
    exact = {k: total * s / sum(mix.values()) for k, s in mix.items()}
    quota = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: quota[k] - exact[k])[: total - sum(quota.values())]:
        quota[k] += 1
    goal = None
    for name, n in quota.items():
        goal = F.when(F.col(kind) == name, n) if goal is None else goal.when(F.col(kind) == name, n)
    ranked = (
        df.filter(F.col(kind).isin(list(quota)))
        .withColumn("_h", _hash(key, seed=seed))
        .withColumn("pick", F.row_number().over(W.partitionBy(kind).orderBy("_h", key)))
        .filter(F.col("pick") <= max(quota.values()))
    )
    return ranked.filter(F.col("pick") <= goal).drop("_h")


def canonical(df: DataFrame) -> DataFrame:
    """Bouts with a < b, scores following their side."""
    flip = F.col("a") > F.col("b")
    return df.withColumns(
        {
            "a": F.least("a", "b"),
            "b": F.greatest("a", "b"),
            "score_a": F.when(flip, F.col("score_b")).otherwise(F.col("score_a")),
            "score_b": F.when(flip, F.col("score_a")).otherwise(F.col("score_b")),
        }
    )


def untested(pairs: DataFrame, bouts: DataFrame) -> DataFrame:
    return pairs.join(canonical(bouts).select("a", "b").distinct(), ["a", "b"], "left_anti")


def findings(bouts: DataFrame) -> DataFrame:
    """Mean lead of a over b for every tested pair."""
    lead = ratio(F.sum(F.col("score_a") - F.col("score_b")), F.count(F.lit(1)), 4)
    return canonical(bouts).groupBy("a", "b").agg(lead.alias("lead"), F.count(F.lit(1)).alias("bouts"))


def convergent(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs on which both arms name the same leader."""
    other = y.select("a", "b", F.col("lead").alias("other_lead"))
    return (
        x.select("a", "b", "lead")
        .join(other, ["a", "b"])
        .filter(F.signum("lead") == F.signum("other_lead"))
    )


def divergent(x: DataFrame, y: DataFrame, eps: float) -> DataFrame:
    """Pairs whose lead differs by more than ``eps``; untested on one side counts as 0."""
    both = x.select("a", "b", "lead").join(
        y.select("a", "b", F.col("lead").alias("other_lead")), ["a", "b"], "full_outer"
    )
    diff = F.abs(F.coalesce("lead", F.lit(0.0)) - F.coalesce("other_lead", F.lit(0.0)))
    return both.withColumn("difference", F.bround(diff, 4)).filter(F.col("difference") > eps)


def emergent(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs seen only in the first arm."""
    return x.select("a", "b").join(y.select("a", "b"), ["a", "b"], "left_anti")


def kill_stats(bouts: DataFrame) -> DataFrame:
    """Bouts, kills and kill rate per phase and overall."""
    rolled = bouts.rollup("phase").agg(
        F.count(F.lit(1)).alias("bouts"),
        F.count_if(F.col("killed")).alias("kills"),
        ratio(F.count_if(F.col("killed")), F.count(F.lit(1)), 4).alias("kill_rate"),
        F.grouping_id().alias("_g"),
    )
    return rolled.withColumn("phase", F.when(F.col("_g") == 1, "*").otherwise(F.col("phase"))).drop("_g")


def criteria_hits(bouts: DataFrame) -> DataFrame:
    """How often each kill criterion was triggered, and how often it stuck."""
    each = bouts.select("killed", F.explode("criteria").alias("criterion"))
    return each.groupBy("criterion").agg(
        F.count(F.lit(1)).alias("triggered"), F.count_if(F.col("killed")).alias("stuck")
    )


def both_sides(bouts: DataFrame) -> DataFrame:
    """Long form: the score of each side against the other."""
    sides = F.array(
        F.struct(F.col("a").alias("claim"), F.col("b").alias("against"), F.col("score_a").alias("score")),
        F.struct(F.col("b").alias("claim"), F.col("a").alias("against"), F.col("score_b").alias("score")),
    )
    keep = [c for c in bouts.columns if c not in ("a", "b", "score_a", "score_b")]
    return bouts.select(*keep, F.inline(sides))


def score_long(bouts: DataFrame) -> DataFrame:
    return both_sides(bouts).groupBy("claim", "against").agg(
        ratio(F.sum("score"), F.count("score"), 4).alias("score")
    )


def score_matrix(bouts: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """The square matrix over a roster the caller names."""
    long = score_long(bouts)
    return long.groupBy("claim").pivot("against", list(nodes)).agg(F.max("score"))


def connector_profile(bouts: DataFrame, high: int) -> DataFrame:
    """Spread of a claim's scores: connectors score evenly, specialists do not.

    Means and deviations come from exact integer sums.  The median is over integer scores,
    so its buffer holds one counter per possible score.
    """
    scores = both_sides(bouts)
    s = F.col("score").cast("bigint")
    sums = scores.groupBy("claim").agg(
        F.count("score").alias("scores"),
        F.sum(s).alias("_s"),
        F.sum(s * s).alias("_q"),
        F.count_if(s >= high).alias("_h"),
        F.percentile("score", F.lit(0.5)).alias("median"),
    )
    n = F.col("scores")
    square = product(F.col("_s"), F.col("_s"))
    var = F.try_divide((product(n, F.col("_q")) - square).cast("double"), product(n, n - 1).cast("double"))
    return sums.select(
        "claim",
        "scores",
        ratio(F.col("_s"), n, 4).alias("mean"),
        F.round(F.sqrt(var), 6).alias("spread"),
        "median",
        ratio(F.col("_h"), n, 4).alias("share_high"),
    )


def trajectory(scores: DataFrame, key: str, period: Column) -> DataFrame:
    """Mean score per period with its change, peak and final value.

    Scores are averaged per period first, so the windows see one row per period.
    """
    steps = scores.groupBy(key, period.alias("period")).agg(ratio(F.sum("score"), F.count("score"), 4).alias("score"))
    w = W.partitionBy(key).orderBy("period")
    whole = W.partitionBy(key)
    return steps.select(
        key,
        "period",
        "score",
        F.bround(F.col("score") - F.lag("score").over(w), 4).alias("change"),
        F.max("score").over(whole).alias("peak"),
        F.last("score").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("final"),
    )


def absorption(kills: DataFrame, k: int) -> DataFrame:
    """Most absorptive nodes."""
    counts = kills.groupBy("absorber").agg(F.count(F.lit(1)).alias("absorbed"), F.count_distinct("lost").alias("claims"))
    return counts.orderBy(F.desc("absorbed"), "absorber").limit(k)


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree per node."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(
        F.count(F.lit(1)).alias("relations"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets")
    )


def density(edges: DataFrame) -> DataFrame:
    """Distinct linked pairs as a share of all possible pairs."""
    linked = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    nodes = degrees(edges).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    pairs = linked.agg(F.count(F.lit(1)).alias("linked")).withColumn("nodes", nodes)
    return pairs.withColumn("density", ratio(2 * F.col("linked"), F.col("nodes") * (F.col("nodes") - 1), 6))


def reach(edges: DataFrame, roots: DataFrame, types: Sequence[str] | None = None, rounds: list | None = None) -> DataFrame:
    """(root, node, depth) for every node reachable from the roots, at the least depth.

    Where every node has one way onward, jump tables of 1, 2, 4, ... steps lengthen all paths by doubling.
    Otherwise a node that is entered from one other node only is reached through it, so pointers
    backwards are doubled until they arrive at a root or at a node that several enter, and only between such
    nodes are steps taken one by one.  A chain or tree of any depth takes a logarithmic number of rounds;
    cycles end.  Every round is checkpointed in the shared folder; ``rounds`` collects their names.
    """
    steps = edges if types is None else edges.filter(F.col("type").isin(list(types)))
    steps = cut_lineage(steps.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    start = cut_lineage(roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("bigint").alias("depth")).distinct())
    rounds = [] if rounds is None else rounds
    widest = steps.groupBy("src").count().agg(F.max("count")).first()[0]
    if widest is None:
        return start
    return _along(steps, start, rounds) if widest == 1 else _through_heads(steps, start, rounds)


def _along(steps: DataFrame, start: DataFrame, rounds: list) -> DataFrame:
    """Reach where every node has one way onward.  After k rounds all depths below 2^k are found; nothing new
    means that every path has ended or closed."""
    jumps, found, n, length = steps, start, start.count(), 1
    while True:
        rounds.append("jump")
        ahead = found.join(jumps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.col("depth") + length)
        found = cut_lineage(found.union(ahead).groupBy("root", "node").agg(F.min("depth").alias("depth")))
        now = found.count()
        if now == n:
            return found
        n, length = now, 2 * length
        jumps = cut_lineage(jumps.alias("a").join(jumps.alias("b"), F.expr("a.dst = b.src")).select("a.src", "b.dst"))


def _through_heads(steps: DataFrame, start: DataFrame, rounds: list) -> DataFrame:
    entered = steps.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up"))
    roots = start.select("node").distinct()
    heads = cut_lineage(roots.union(entered.filter("n > 1").select("node")).distinct())
    near = cut_lineage(entered.filter("n = 1").join(heads, "node", "left_anti").select("node", "up", F.lit(1).cast("bigint").alias("dist"), F.lit(True).alias("open")))
    left = near.count()
    most = max(1, left).bit_length() + 1  # pointers that are open after that run in a circle without a root
    while left and most:
        rounds.append("pointer")
        most -= 1
        further = near.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"))
        joined = near.join(further, "up", "left")
        near = cut_lineage(
            joined.select("node", F.coalesce("_up", "up").alias("up"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.col("_up").isNotNull().alias("open"))
        )
        left = near.filter("open").count()
    near = near.join(heads.withColumnRenamed("node", "up"), "up", "left_semi").select("node", F.col("up").alias("head"), "dist")

    into = steps.join(heads.withColumnRenamed("node", "dst"), "dst", "left_semi")
    own = into.join(heads.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("head"), "dst", F.lit(1).cast("bigint").alias("dist"))
    over = into.join(near.withColumnRenamed("node", "src"), "src").select("head", "dst", F.col("dist") + 1)
    links = cut_lineage(own.union(over).filter("head <> dst").groupBy("head", "dst").agg(F.min("dist").alias("dist")))

    found = newest = start
    while not newest.isEmpty():
        rounds.append("head")
        onward = newest.join(links, F.col("node") == F.col("head")).groupBy("root", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("dist")).alias("depth"))
        known = found.withColumnRenamed("depth", "_depth")
        newest = cut_lineage(onward.join(known, ["root", "node"], "left").filter("_depth IS NULL OR depth < _depth").select("root", "node", "depth"))
        found = cut_lineage(found.unionByName(newest).groupBy("root", "node").agg(F.min("depth").alias("depth")))
    behind = near.join(found.withColumnRenamed("node", "head"), "head").select("root", "node", (F.col("depth") + F.col("dist")).alias("depth"))
    return found.unionByName(behind)


def lineage(edges: DataFrame, root, direction: str = "descendants") -> DataFrame:
    """Descendants or ancestors of one node with their depth."""
    ends = ("parent", "child") if direction == "descendants" else ("child", "parent")
    steps = edges.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"))
    kind = dict(edges.dtypes)["parent"]
    start = local_table(edges.sparkSession, [(root,)], f"node {kind}")
    return reach(steps, start).select("node", "depth")


def parent_death(edges: DataFrame, deaths: DataFrame) -> DataFrame:
    """Offspring of a parent that dies after the birth."""
    ended = deaths.select(F.col("node").alias("parent"), "died")
    return edges.join(ended, "parent").filter(F.col("died") > F.col("born")).select("parent", "child", "born", "died")
