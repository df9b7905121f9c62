"""Near copies: groups of texts whose sets of shingles reach a similarity (Jaccard).

Minima of independent hashes of the shingles find candidates in bands, a sketch of one bit of each minimum sorts out
most of the others, and the sets themselves decide every link.

Scale: equal sets are one node before anything is compared; components, not pairs, are what is returned.  What hubs leave
apart is compared in cells of a bounded number of hashes, which emit only links that join two components: no row is made
for a pair of texts that merely resemble each other.

Defined results: null and blank texts have the empty set and are one group; fewer words than a shingle make one
shingle; every row gets a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.llm import scan
from fieldnote.llm.components import components
from fieldnote.llm.simhash import SEED, _hashes
from fieldnote.llm.workers import ready, tidy
from fieldnote.session import cut_lineage, small

# Minima of a text: BANDS x PER_BAND of them find candidates, and a bit of each makes up the sketch.
MINIMA, BANDS, PER_BAND = 128, 20, 5
# Bits of the sketch in which a candidate may differ: at a similarity of 0.8 some 13 do, with a deviation of 3.4.
SKETCH_BITS = 30
HUBS = 2
# Hashes of shingles on either side of a cell.
CELL_HASHES = 1 << 20
_ODD = scan.mix64(np.arange(1, MINIMA + 1, dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)


def _sets(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk by chunk: the distinct shingle hashes of each text, rising, and how many there are."""
    for hashes, counts in _hashes(column, words):
        of = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        yield hashes[new], np.bincount(of[new], minlength=len(counts))


def _set_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scan.mix64(hashes), dtype=np.uint64)))
    ends = np.cumsum(counts)
    return scan.mix64(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))


def _minima(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands (a row for each text) and sketches (two longs) of sets; those of an empty set are zero."""
    held = np.flatnonzero(counts)
    bands = np.zeros((len(counts), BANDS), np.uint64)
    bits = np.zeros((len(counts), MINIMA), np.uint8)
    if len(held):
        begin = (np.cumsum(counts) - counts)[held]
        for i, odd in enumerate(_ODD):
            least = np.minimum.reduceat(hashes * odd, begin)
            bits[held, i] = (least >> np.uint64(31)) & np.uint64(1)
            if i < BANDS * PER_BAND:
                band = i // PER_BAND
                bands[held, band] = scan.mix64(bands[held, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(band))
    return bands, np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, node (a hash of the set of shingles), n (its size), sketch (s0, s1) and bands of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, sketch, bands = [], [], [], []
            for hashes, counts in _sets(batch.column(2), words):
                b, s = _minima(hashes, counts)
                node.append(_set_hashes(hashes, counts).view(np.int64))
                n.append(counts.astype(np.int64))
                sketch.append(s)
                bands.append(b.view(np.int64))
            if not node:
                continue
            sketch, flat = np.concatenate(sketch), np.concatenate(bands).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            cols = [np.concatenate(node), np.concatenate(n), np.ascontiguousarray(sketch[:, 0]), np.ascontiguousarray(sketch[:, 1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, cols), lists], ["doc_id", "text_hash", "node", "n", "s0", "s1", "bands"]
            )

    return ready(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, node long, n long, s0 long, s1 long, bands array<long>"
    )


def _near(a: str, b: str, similarity: float, bits: int) -> Column:
    """Sizes and sketches allow the similarity."""
    differ = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("s0", "s1")]
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(x, y) >= F.greatest(x, y) * similarity) & (differ[0] + differ[1] <= bits)


def _shingles(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node and its set of shingle hashes, from the row (``row``) that stands for each ``needed`` node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in _sets(batch.column(0), words):
                at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_hashes(hashes, counts).view(np.int64)), sets], ["node", "shingles"])

    rows = small(needed.select(F.col("row.doc_id").alias("i"), F.col("row.text_hash").alias("h")))
    found = ready(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        rows, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_semi"
    )
    # Rows with one id and text may be there several times.
    return found.select("text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _sets_of(ends: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and its set of shingle hashes for the nodes in ``ends`` (column ``end``)."""
    needed = nodes.join(ends.distinct(), F.col("node") == F.col("end"), "left_semi").select("row")
    return cut_lineage(_shingles(docs, needed, words))


def _verified(met: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of ``met`` whose sets reach the similarity exactly."""
    met = cut_lineage(met)
    sets = _sets_of(met.select(F.explode(F.array("u", "v")).alias("end")), docs, nodes, words)
    both = F.size(F.array_intersect("su", "sv"))
    return cut_lineage(
        met.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
        .filter(both / (F.size("su") + F.size("sv") - both) >= similarity)
        .select("u", "v")
    )


def _cell_links(cell: pa.Table, similarity: float, bits: int) -> list[tuple[int, int]]:
    """Links (node, node) between the sides of a cell, or within its only side, that join two components.

    A pair that shares an earlier band is left to a cell of that band."""
    side, node = cell["side"].to_numpy(), cell["node"].to_numpy()
    n, label = cell["n"].to_numpy(), np.unique(cell["component"].to_numpy(), return_inverse=True)[1]
    sketch = np.stack([cell[c].to_numpy().view(np.uint64) for c in ("s0", "s1")])
    bands = cell["bands"].combine_chunks().values.to_numpy().reshape(-1, BANDS)
    band = cell["place"][0].as_py()
    ids = np.unique(cell["shingles"].combine_chunks().values.to_numpy(), return_inverse=True)[1]
    begin = np.cumsum(n) - n
    held = np.zeros(int(ids.max()) + 1, np.uint8)
    others = np.flatnonzero(side == 1) if side.any() else None
    out = []
    for i in np.flatnonzero(side == 0).tolist():
        to = np.arange(i + 1, len(n)) if others is None else others
        to = to[label[to] != label[i]]
        to = to[np.minimum(n[to], n[i]) >= np.maximum(n[to], n[i]) * similarity]
        to = to[np.bitwise_count(sketch[:, to] ^ sketch[:, i : i + 1]).sum(axis=0) <= bits]
        to = to[~(bands[to, :band] == bands[i, :band]).any(axis=1)]
        if not len(to):
            continue
        mine, many = ids[begin[i] : begin[i] + n[i]], n[to]
        firsts = np.cumsum(many) - many
        held[mine] = 1
        both = np.add.reduceat(held[ids[np.repeat(begin[to] - firsts, many) + np.arange(many.sum())]], firsts, dtype=np.int64)
        held[mine] = 0
        to = to[both / (n[i] + many - both) >= similarity]
        for j in to[np.unique(label[to], return_index=True)[1]].tolist():
            out.append((int(node[i]), int(node[j])))
            label[label == label[j]] = label[i]
    return out


def _shared(nodes: DataFrame) -> DataFrame:
    """node, n, place and band of the bands that several nodes hold.  No sketch or list of bands is moved for the many that
    one node alone holds."""
    index = nodes.filter("n > 0").select("node", F.posexplode("bands").alias("place", "band"))
    several = index.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("band")
    return cut_lineage(index.join(several, "band").join(nodes.select("node", "n"), "node"))


def _cells(labelled: DataFrame) -> DataFrame:
    """Every node of a band with several components, once for each cell that it belongs to; ``labelled``: node, n, component, place and band.

    The members of a band outside its main component, and those in it, are dealt to tiles by a hash; a cell is a pair
    of tiles of which at least one lies outside.  Its key is (band, main, i, j), and ``side`` tells the two tiles apart."""
    split = labelled.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min_by("component", F.xxhash64("node", F.lit(0))).alias("main")
    ).filter("least < most").select("band", F.col("main").alias("chief"))
    still = cut_lineage(labelled.join(split, "band").withColumn("main", F.col("component") == F.col("chief")).drop("chief"))
    tiles = lambda main: F.ceil(F.sum(F.when(F.col("main") == main, F.col("n")).otherwise(0)) / CELL_HASHES).cast("int")
    sizes = still.groupBy("band").agg(tiles(False).alias("outside"), tiles(True).alias("inside"))
    dealt = still.join(sizes, "band").withColumn("t", F.pmod(F.xxhash64("node", F.lit("tile")), F.when(F.col("main"), F.col("inside")).otherwise(F.col("outside"))).cast("int"))
    t, zero, one = F.col("t"), F.lit(0).cast("byte"), F.lit(1).cast("byte")
    cell = lambda main, i, j, side: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"), side.alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    to_main = F.when(F.col("inside") > 0, F.transform(upto("inside"), lambda j: cell(True, t, j, zero))).otherwise(F.array().cast("array<struct<main: boolean, i: int, j: int, side: tinyint>>"))
    among = F.transform(upto("outside"), lambda j: cell(False, F.least(t, j), F.greatest(t, j), F.when(t <= j, zero).otherwise(one)))
    places = F.when(F.col("main"), F.transform(upto("outside"), lambda i: cell(True, i, t, one))).otherwise(F.concat(to_main, among))
    return dealt.select("node", "n", "component", "place", "band", F.explode(places).alias("c")).select("*", "c.*").drop("c")


def _across(labelled: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float, bits: int) -> DataFrame:
    """Links (u, v) between components of nodes that share a band."""
    cells = _cells(labelled)
    sets = _sets_of(cells.select(F.col("node").alias("end")), docs, nodes, words).join(nodes.select("node", "s0", "s1", "bands"), "node")

    def run(cell: pa.Table) -> pa.Table:
        links = _cell_links(cell, similarity, bits)
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["u", "v"])

    return cut_lineage(ready(cells.join(sets, "node")).groupBy("band", "main", "i", "j").applyInArrow(run, "u long, v long"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, text_hash and component of every row, for a similarity (Jaccard) on the sets of shingles of ``words`` words.

    Candidates share a band: ``PER_BAND`` minima of independent hashes of the shingles, of ``BANDS`` such.  A pair at
    0.8 shares one with a probability of 0.9997, whatever was added, cut or swapped.  Texts with one set are one node.
    A candidate is a link only if its sets reach the similarity.  ``sketch_bits`` spares most other candidates that; with
    ``MINIMA`` it spares none.

    A large group of near copies is not compared pair by pair: every band has a few hubs, to
    which its members are linked; after that only members of different components are compared, those outside the
    main component with all others, which loses no link between components.  They meet in cells of bounded size.
    """
    prints = cut_lineage(_sketches(docs, words))
    # The first row of a node stands for it.
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    nodes = cut_lineage(prints.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "s0", "s1", "bands")], first_row))
    shared = _shared(nodes)
    hubs = shared.groupBy("band").agg(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(HUBS)]).alias("hubs")).select(
        "band", F.explode(F.array_distinct("hubs")).alias("h")
    )
    met = shared.join(hubs, "band").filter("node <> h").select(F.least("node", "h").alias("u"), F.greatest("node", "h").alias("v")).distinct()
    sketches = nodes.select("node", "n", "s0", "s1")
    close = met.join(sketches.alias("a"), F.col("u") == F.col("a.node")).join(sketches.alias("b"), F.col("v") == F.col("b.node")).filter(
        _near("a", "b", similarity, sketch_bits)
    ).select("u", "v")
    linked = _verified(close, docs, nodes, words, similarity)

    labelled = shared.join(components(linked).withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select(
        "node", "n", "place", "band", F.coalesce("component", "node").alias("component")
    )
    joined = components(linked.unionByName(_across(labelled, docs, nodes, words, similarity, sketch_bits)))
    return prints.join(joined.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select(
        "doc_id", "text_hash", F.coalesce("component", "node").alias("component")
    )
