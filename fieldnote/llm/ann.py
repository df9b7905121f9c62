"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a sample of at most ``sample`` vectors (documented bound; it sets the
centroids only) and every vector is indexed.  A query goes best bin first: a priority queue
of branches, the nearest centroid next, yields the leaves in order; a query visits as many
leaves as calibration asks for.  The sample's own best are candidates from the start, and what scores
less than the k-th of them is not passed on.

Calibration widens the visits: for up to ``probes`` vectors the true neighbours are found by
brute force over all rows, and the visits are set so that the leaves first in order hold the
share ``recall`` of them.

Inner product: vectors get one more component that makes all of equal length, which turns the
largest inner product into the smallest distance; scores come from the original vectors
in double precision.

Scale: leaves and their vectors are dealt by (leaf, salt), a large leaf over many salts; a query is sent to
the salts of its leaves, where blocks are multiplied and the best ``k`` are kept.  The tree
is bounded by the sample.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without id; ids stay whole numbers of 64 bits; ties go to the smaller id; rows with one id are candidates each for itself, but not for the one query of
that id, which takes the least of its vectors; a query visits further leaves until they hold more than ``k`` vectors; fewer candidates than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm.workers import ready
from fieldnote.session import cut_lineage

SAMPLE, PROBES, BRANCHES, LEAF = 20_000, 128, 8, 256
# Vectors of a leaf that one group holds.
PER_SALT = 20_000
# Candidate rows multiplied at once.
ROWS = 4096


class Tree:
    """Centroids by node; the children of a node stand in a row."""

    def __init__(self, points: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._add(points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            node, rows = open_nodes.pop(0)
            own = self._part(points[rows], branches, rng) if len(rows) > leaf else None
            if own is None:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            kinds = np.unique(own)
            first = len(self.centres)
            for c in kinds:
                mine = rows[own == c]
                open_nodes.append((self._add(points[mine].mean(axis=0)), mine))
            self.children[node] = (first, len(self.centres))
        self.centres = np.array(self.centres)

    def _add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append(None)
        self.leaf_of.append(-1)
        return len(self.centres) - 1

    @staticmethod
    def _part(points: np.ndarray, branches: int, rng) -> np.ndarray | None:
        """k-means labels; None where the points don't part."""
        centres = points[rng.choice(len(points), min(branches, len(points)), replace=False)]
        for _ in range(12):
            own = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
            new = np.array([points[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
            if np.allclose(new, centres):
                break
            centres = new
        return own if len(np.unique(own)) > 1 else None

    def find(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into: the nearest child at every node."""
        out = np.empty(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            span = self.children[node]
            if span is None:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centres[span[0] : span[1]]
            own = ((c**2).sum(1) - 2 * points[rows] @ c.T).argmin(1)
            todo += [(span[0] + i, rows[own == i]) for i in range(len(c)) if (own == i).any()]
        return out

    def order(self, point: np.ndarray, most: int, sizes: dict[int, int], least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and more until they hold ``least`` vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            span = self.children[node]
            if span is None:
                out.append(self.leaf_of[node])
                held += sizes.get(out[-1], 0)
                continue
            far = ((self.centres[span[0] : span[1]] - point) ** 2).sum(1)
            for i, d in enumerate(far):
                heapq.heappush(queue, (float(d), span[0] + i))
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _level(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component, all of the length ``longest``."""
    rest = np.maximum(longest**2 - (v**2).sum(1), 0)
    return np.hstack([v, np.sqrt(rest)[:, None]])


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (as stored) of the vectors that take part."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(key).alias("id"), v.alias("v")).filter(F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull())


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _top(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best of ``v`` for each query, in blocks of rows."""
    qid, q = queries
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, ids.dtype), np.zeros(0))] * len(qid)
    for lo in range(0, len(ids), ROWS):
        part, scores = ids[lo : lo + ROWS], q @ v[lo : lo + ROWS].T
        for i in range(len(qid)):
            other = part != qid[i]
            a = np.concatenate((held[i][0], part[other]))
            s = np.concatenate((held[i][1], scores[i][other]))
            at = _best(a, s, k)
            held[i] = a[at], s[at]
    n = [len(a) for a, _ in held]
    if sum(n):
        yield pd.DataFrame({"query_id": np.repeat(qid, n), "id": np.concatenate([a for a, _ in held]), "score": np.concatenate([s for _, s in held])})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95,
           sample: int = SAMPLE, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    whole = ready(usable(table, key, vector))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = whole.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    if not size[0]:
        return empty
    longest = float(size[1])
    # A bounded sample by hash: the least ``sample`` hashes of the ids.
    drawn = whole.orderBy(F.xxhash64("id")).limit(sample).toPandas()
    tree = Tree(_level(_matrix(drawn["v"]), longest))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=shared.value.find(_level(_matrix(b["v"]), longest)) if len(b) else np.zeros(0, np.int64))

    kind = table.schema[vector].dataType.simpleString()
    indexed = cut_lineage(whole.mapInPandas(place, f"id long, v {kind}, leaf long"))

    probe_rows = drawn.head(probes)
    pid, pv = probe_rows["id"].to_numpy(), _matrix(probe_rows["v"])

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for top in _top((pid, pv), b["id"].to_numpy(), _matrix(b["v"]), k):
                    leaf = pd.Series(b["leaf"].to_numpy(), index=b["id"].to_numpy())
                    leaf = leaf[~leaf.index.duplicated()]
                    yield top.assign(leaf=leaf.loc[top["id"]].to_numpy())

    truth = _ranked(indexed.mapInPandas(brute, "query_id long, id long, score double, leaf long"), k).select("query_id", "leaf").toPandas()
    ranks = []
    for q, rows in truth.groupby("query_id"):
        at = {leaf: i for i, leaf in enumerate(tree.order(_level(pv[pid == q][:1], longest)[0], tree.leaves, {}))}
        ranks += [at[x] for x in rows["leaf"]]
    visits = int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else tree.leaves

    sampled = _matrix(drawn["v"])
    known = spark.sparkContext.broadcast((drawn["id"].to_numpy(), sampled, tree.find(_level(sampled, longest))))

    def start(q: np.ndarray, own: int, leaves: list[int]) -> float:
        """A score that the k-th neighbour in these leaves reaches: that of the k-th best of the sample's vectors in
        them, a hair lower for rounding."""
        ids, v, at = known.value
        scores = v[(ids != own) & np.isin(at, leaves)] @ q
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) - 1e-9 * longest**2 if len(scores) >= k else -np.inf

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = _matrix(b["v"])
                leaves = [shared.value.order(p, visits, sizes, k + 1) for p in _level(v, longest)]
                yield b[["id", "v"]].assign(least=[start(q, i, x) for q, i, x in zip(v, b["id"], leaves)], leaves=leaves)

    # At most one row for each leaf, which the sample bounds.
    sizes = dict(map(tuple, indexed.groupBy("leaf").count().collect()))
    salts = [(leaf, -(-n // PER_SALT)) for leaf, n in sizes.items()]
    counts = F.broadcast(spark.createDataFrame(salts, "leaf long, salts int"))
    queries = indexed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    # The leaves of a query are unfolded row by row in the JVM; in Python a batch would hold them all.
    begun = cut_lineage(queries.mapInPandas(route, f"id long, v {kind}, least double, leaves array<long>"))
    routed = begun.select("id", "v", "least", F.explode("leaves").alias("leaf")).join(counts, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "id", "v", "least"
    )
    dealt = indexed.join(counts, "leaf").select("leaf", F.pmod(F.xxhash64("id", "v"), F.col("salts")).cast("int").alias("salt"), "id", "v")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = list(_top((q["id"].to_numpy(), _matrix(q["v"])), c["id"].to_numpy(), _matrix(c["v"]), k)) if len(q) and len(c) else []
        if found:
            return found[0][found[0]["score"] >= found[0]["query_id"].map(dict(zip(q["id"], q["least"])))]
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = routed.groupBy("leaf", "salt").cogroup(dealt.groupBy("leaf", "salt")).applyInPandas(compare, "query_id long, id long, score double")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
