"""Near duplicates by 64-bit fingerprints that differ in few bits.

Deletion-variant signatures: with at most ``distance`` differing bits, cutting the
fingerprint into fewer segments than ``distance`` leaves one segment with at most one
differing bit.  Every fingerprint is entered once for each bit, under its segment with that
bit as a wildcard; an equality join on (bit, rest of the segment) meets every such pair, and
the join's own condition verifies the whole distance.  A pair that meets under several
wildcards counts under the first only.

Scale: equal fingerprints are one row before anything is compared, so that copies cost
nothing; components, not pairs, are what is returned.

Defined results: a null or blank text has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; rows with the same id get a row each; an empty
table gives an empty result; extra columns are ignored by ``groups`` and kept by ``first_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnote.llm import scan
from fieldnote.llm.components import components
from fieldnote.llm.workers import ready, tidy
from fieldnote.session import cut_lineage

SEED = 42


def _hashes(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk by chunk: hashes of all shingles, and how many belong to each text."""
    data, at = scan.raw(column)
    for i, j in scan.chunks(data, at):
        part, ends_at = scan.LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]
        starts, ends, first = scan.spans(part, ends_at)
        # Words joined by one space: the blank before a word stays unless the text begins there.
        keep = ~scan.IS_SPACE[part]
        inner = np.ones(len(starts), bool)
        inner[first[:-1][first[:-1] < first[1:]]] = False
        blanks = starts[inner] - 1
        keep[blanks] = True
        part[blanks] = 32
        moved = np.cumsum(keep) - 1
        flat = part[keep].tobytes()
        count = np.diff(first)
        shingles = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
        begins = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(shingles)[:-1])), shingles) + np.arange(shingles.sum())
        ends_with = np.minimum(begins + words - 1, np.repeat(first[1:] - 1, shingles))
        lo, hi = moved[starts[begins]].tolist(), (moved[ends[ends_with] - 1] + 1).tolist()
        h = xxhash.xxh64_intdigest
        yield np.array([h(flat[a:b], SEED) for a, b in zip(lo, hi)], np.uint64), shingles


def _fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit i is set if it is in more than half of a text's hashes."""
    out = np.zeros((len(counts), 64), np.int64)
    held = np.flatnonzero(counts)
    if len(held):
        begin = (np.cumsum(counts) - counts)[held]
        step = 1 << 18  # hashes unpacked at once
        total = np.zeros((len(held), 64), np.int64)
        for lo in range(0, len(hashes), step):
            hi = min(lo + step, len(hashes))
            bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            a = int(np.searchsorted(begin, lo, "right")) - 1
            b = int(np.searchsorted(begin, hi, "left"))
            total[a:b] += np.add.reduceat(bits, np.maximum(begin[a:b], lo) - lo, axis=0, dtype=np.int64)
        out[held] = 2 * total > counts[held, None]
    return np.packbits(out.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, words: int = 4, coarse: int | None = None) -> DataFrame:
    """doc_id, fp (64 bits as a long) and a hash of the text for every row; with ``coarse`` also
    the fingerprint over shingles of that many words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    sizes, names = ([words], ["fp"]) if coarse is None else ([words, coarse], ["fp", "coarse"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for size in sizes:
                found = [_fingerprints(h, n) for h, n in _hashes(batch.column(2), size)] or [np.zeros(0, np.uint64)]
                prints.append(pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *prints], ["doc_id", "text_hash", *names])

    return ready(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, " + ", ".join(f"{n} long" for n in names)
    )


def _segments(distance: int) -> list[int]:
    """Masks of the segments; fewer than ``distance``, yet so many that one differs by at most one bit."""
    n = distance // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints with at most ``distance`` differing bits."""
    masks = _segments(distance)
    index = _index(distinct.select("fp"), "fp", masks)
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    here = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("a.bit").cast("int"))
    return index.alias("a").join(
        index.alias("b"),
        (F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(differ) <= distance) & (_home(differ, masks) == here),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _home(differ: Column, masks: list[int]) -> Column:
    """The first segment with at most one differing bit, and in it that bit or else its lowest."""
    home = F.lit(None).cast("long")
    for m in reversed(masks):
        inside = differ.bitwiseAND(F.lit(_signed(m)))
        home = F.when(F.bit_count(inside) <= 1, F.when(inside == 0, F.lit(_signed(m & -m))).otherwise(inside)).otherwise(home)
    return home


def _index(nodes: DataFrame, column: str, masks: list[int]) -> DataFrame:
    """``nodes`` once for each bit, with the rest of the bit's segment of ``column``.

    Spark takes these 64 rows for as large as the one they come from, and would broadcast them; so joins with them are sorted."""
    of_bit = [next(m for m in masks if m >> b & 1) for b in range(64)]
    entries = F.array(*[F.struct(F.lit(b).cast("byte").alias("bit"), F.col(column).bitwiseAND(F.lit(_signed(of_bit[b] & ~(1 << b)))).alias("rest")) for b in range(64)])
    return nodes.select("*", F.explode(entries).alias("e")).select("*", "e.bit", "e.rest").drop("e").hint("merge")


HUBS = 4


def similar_groups(docs: DataFrame, words: int = 5, bits: int = 12, coarse_bits: int = 3) -> DataFrame:
    """doc_id, text_hash and component of every row, for a similarity of about 0.8 on shingles of ``words`` words.

    At that similarity a fingerprint over shingles differs in some ten bits, beyond what segments
    can index.  Single words change far less, so that a second fingerprint over them is
    indexed with deletion variants (``coarse_bits``) and the one over shingles verifies (``bits``).

    A large group of near copies is not compared pair by pair: every index entry has a few hubs, to
    which its members are linked where they verify; after that only members of different
    components are compared, which loses no link between components.
    """
    prints = cut_lineage(fingerprints(docs, words, 1).withColumn("node", F.xxhash64("fp", "coarse")))
    nodes = cut_lineage(prints.select("node", "fp", "coarse").distinct())
    masks = _segments(coarse_bits)
    index = _index(nodes, "coarse", masks)

    def close(a: str, b: str) -> Column:
        near = lambda c: F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
        return (near("coarse") <= coarse_bits) & (near("fp") <= bits)

    member = F.struct("node", "fp", "coarse")
    hubs = index.groupBy("bit", "rest").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min_by(member, F.xxhash64("node", F.lit(i))) for i in range(HUBS)]).alias("hubs"),
    ).filter("n > 1").select("bit", "rest", "hubs")
    linked = index.alias("a").join(hubs.alias("h"), ["bit", "rest"]).select(
        F.struct("a.node", "a.fp", "a.coarse").alias("a"), F.explode(F.array_distinct("hubs")).alias("h")
    ).filter((F.col("a.node") != F.col("h.node")) & close("a", "h")).select(
        F.col("a.node").alias("u"), F.col("h.node").alias("v")
    ).distinct()
    linked = cut_lineage(linked)
    first = components(linked)
    labelled = cut_lineage(nodes.join(first.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select(
        "node", "fp", "coarse", F.coalesce("component", "node").alias("component")
    ))
    again = _index(labelled, "coarse", masks)
    here = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("a.bit").cast("int"))
    rest = again.alias("a").join(
        again.alias("b"),
        (F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.node") < F.col("b.node"))
        & (F.col("a.component") != F.col("b.component")) & close("a", "b")
        & (_home(F.col("a.coarse").bitwiseXOR(F.col("b.coarse")), masks) == here),
    ).select(F.col("a.component").alias("u"), F.col("b.component").alias("v"))
    joined = components(linked.unionByName(rest))
    return prints.join(joined.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select(
        "doc_id", "text_hash", F.coalesce("component", "node").alias("component")
    )


def groups(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, text_hash, fp and component (the smallest fingerprint reachable) of every row."""
    prints = cut_lineage(fingerprints(docs, words))
    distinct = prints.select("fp").distinct()
    joined = components(links(distinct, distance))
    return prints.join(joined, prints["fp"] == joined["node"], "left").select(
        "doc_id", "text_hash", "fp", F.coalesce("component", "fp").alias("component")
    )


def united(rows: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, text_hash and component of ``rows``, whose components are joined where a component of ``other`` holds several.

    Both hold the rows of one table.  Only one link leaves each component, to the least that shares one of ``other``."""
    rows = cut_lineage(rows)
    texts = rows.select("text_hash", "component").distinct()
    met = texts.join(other.select("text_hash", F.col("component").alias("theirs")).distinct(), "text_hash").select("component", "theirs").distinct()
    least = met.groupBy("theirs").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    links = met.join(least, "theirs").filter("component <> least").select(F.col("least").alias("u"), F.col("component").alias("v")).distinct()
    joined = components(cut_lineage(links)).withColumnsRenamed({"node": "own", "component": "whole"})
    return rows.join(joined, F.col("component") == F.col("own"), "left").select("doc_id", "text_hash", F.coalesce("whole", "component").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest id in its component."""
    rows = cut_lineage(groups(docs, words, distance))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The document with the smallest id of each component of ``rows`` (null ids last), once; columns as in ``docs``."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = rows.groupBy("component").agg(least).select(F.col("first.doc_id").alias("i"), F.col("first.text_hash").alias("h"))
    same = F.col("d.doc_id").eqNullSafe(F.col("k.i")) & (F.xxhash64("d.text") == F.col("k.h"))
    found = docs.alias("d").join(kept.alias("k"), same, "left_semi")
    return found.dropDuplicates(["doc_id", "text"])
