"""Importance resampling of documents towards a target corpus by hashed n-grams.

Features are runs of 1 to ``LONGEST`` words, joined by one space; each falls into one of ``BUCKETS``
buckets by its CRC-32.  Counts by bucket of the whole corpus and of the target give every bucket a gain, floor(1000 ln of
the ratio of the smoothed shares); a document's weight is the sum of the gains over its features, and with
Gumbel noise from a hash of its id the highest scores are a sample without replacement.

A task works through its texts in pieces.  The words of a piece are written in a row, one space
between them, so that every n-gram is a range of bytes.  An open-addressed table of numpy arrays interns these: XXH64
keys for all ranges at once, linear probing, and a range joins a slot only if its bytes equal those of the slot's
first range.  A slot stores the bucket and the count; the slot number of every occurrence then
gathers its gain.  CRC-32 and bucket are thus computed once for each distinct n-gram of a piece.

Scale: both passes over the texts are narrow.  A task passes on at most ``BUCKETS`` counts, and as many gains come to
the driver and back.  For the ranks, rows of three numbers are sorted by range of (score, id, place), so that equal scores and ids
spread as well, written, and numbered by the prefix sums of the ranges' sizes; ranges behind the last drawn rank are
not numbered.

Defined results: a null, empty or blank text has no features and weight 0; a null id counts as the text "" and comes last
among ties; rows alike in id and score take ranks in any order; words may be of any length, and a very long text is worked
on in segments that end between words, so that memory is bound by the text itself and its longest word; an empty corpus gives an
empty result and an empty target gives every bucket the gain of its share; extra columns are kept by ``draw`` and
ignored by ``scored``, so that no name can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldnote.llm import scan
from fieldnote.llm.ranges import Bytes
from fieldnote.llm.text import free_name
from fieldnote.llm.workers import ready
from fieldnote.session import scratch_path

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
# Words worked on at once.
PIECE = 1 << 17

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Interned:
    """Open-addressed table of the ranges of a piece.

    slot_of: for every range the number of its slot; first: for each taken slot the range that took it;
    buckets and counts by slot.
    """

    def __init__(self, text: Bytes, start: np.ndarray, size: np.ndarray, buckets: int = BUCKETS):
        n = len(start)
        room = 1 << max(4, int(2 * n - 1).bit_length())
        mask = room - 1
        keys = text.hashes(start, size, SEED)
        owner = np.full(room, -1, np.int64)
        self.slot_of = np.empty(n, np.int64)
        todo, at = np.arange(n), (keys & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = owner[at] < 0
            owner[at[free][::-1]] = todo[free][::-1]  # the first range of those that meet in a free slot takes it
            holder = owner[at]
            fits = (keys[holder] == keys[todo]) & (size[holder] == size[todo])
            fits[fits] = text.equal(start[todo[fits]], start[holder[fits]], size[todo[fits]])
            self.slot_of[todo[fits]] = at[fits]
            todo, at = todo[~fits], (at[~fits] + 1) & mask
        taken = np.flatnonzero(owner >= 0)
        self.first = owner[taken]
        place = np.empty(room, np.int64)
        place[taken] = np.arange(len(taken))
        self.slot_of = place[self.slot_of]
        self.counts = np.bincount(self.slot_of, minlength=len(taken))
        data = memoryview(text.data)
        crc = zlib.crc32
        self.buckets = np.fromiter(
            (crc(data[a:b]) % buckets for a, b in zip(start[self.first].tolist(), (start + size)[self.first].tolist())), np.int64, len(taken)
        )


# ---- features of texts


def joined_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, lower-cased and one space behind each: bytes, starts, ends, and how many words
    come before each text (n + 1 numbers)."""
    gap = np.insert(scan.LOWER[data], at[1:-1], 32)  # a space between texts
    inside = np.append(_WORD[gap], False)
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    ends_here = edge == -1
    keep = inside | ends_here
    flat = np.where(inside[:-1], gap, 32)
    flat = np.append(flat, np.uint8(32))[keep].astype(np.uint8)
    place = np.cumsum(keep) - 1
    starts, ends = place[edge == 1], place[ends_here]
    before = np.searchsorted(np.flatnonzero(edge == 1), at + np.arange(len(at)))
    before[-1] = len(starts)
    return flat, starts, ends, before


def _next(data: np.ndarray, at: int, word: bool) -> int:
    """The first place from ``at`` whose byte is one of a word (or is none)."""
    while at < len(data):
        found = np.flatnonzero(_WORD[scan.LOWER[data[at : at + 4096]]] == word)
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


def segments(data: np.ndarray, longest: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of the longest - 1 words behind it) of segments that end between words."""
    a = 0
    while a < len(data):
        b = c = _next(data, min(a + most, len(data)), False)
        for _ in range(longest - 1):
            c = _next(data, _next(data, c, True), False)
        yield a, b, c
        a = b


def _chunks(data: np.ndarray, at: np.ndarray, longest: int, most: int) -> Iterator[tuple]:
    """(first row, number of rows, bytes, offsets of the texts and of what follows them as context)."""
    for i, j in scan.chunks(data, at, most):
        if j - i > 1 or at[j] - at[i] <= 2 * most:
            yield i, j - i, data[at[i] : at[j]], np.append(at[i : j + 1], at[j]) - at[i]
            continue
        whole = data[at[i] : at[j]]
        for a, b, c in segments(whole, longest, most):
            yield i, 1, whole[a:c], np.array([0, b - a, c - a])


def pieces(column: pa.Array, longest: int = LONGEST, most: int = PIECE, chunk: int = scan.CHUNK) -> Iterator[tuple]:
    """("words", first row, words of each row from there) of every chunk, and ("features", row of each feature, table) of the
    n-grams that begin with one of ``most`` words.  A row may come in several of both."""
    data, at = scan.raw(column)
    for i, n_rows, part, offsets in _chunks(data, at, longest, chunk):
        flat, starts, ends, before = joined_words(part, offsets)
        text, each = Bytes(flat), np.diff(before)
        yield "words", i, each[:n_rows]
        each[n_rows - 1] += each[n_rows]
        whose, own = np.repeat(np.arange(i, i + n_rows), each[:n_rows]), int(before[n_rows])
        for a in range(0, own, most):
            b = min(a + most, own)
            start, size, row = [], [], []
            for n in range(longest):
                f = np.arange(a, min(b, len(starts) - n))
                f = f[whose[f] == whose[f + n]] if n else f
                start.append(starts[f])
                size.append(ends[f + n] - starts[f])
                row.append(whose[f])
            order = np.argsort(np.concatenate(row), kind="stable")
            yield "features", np.concatenate(row)[order], Interned(text, np.concatenate(start)[order], np.concatenate(size)[order])


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for kind, _, found in pieces(b.column(0)):
                if kind == "features":
                    total += np.bincount(found.buckets, found.counts, BUCKETS).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    partial = ready(docs).select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus), by bucket."""
    total, aim = float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (total + BUCKETS)) / ((corpus + 1.0) * (aim + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight of every document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for b in batches:
            n = b.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for kind, at, found in pieces(b.column(1)):
                if kind == "words":
                    words[at : at + len(found)] += found
                    continue
                first = np.flatnonzero(np.diff(at, prepend=-1))
                rows = at[first]
                each = held.value[found.buckets][found.slot_of]
                if len(rows):
                    weight[rows] += np.add.reduceat(each, first)
                    features[rows] += np.diff(np.append(first, len(at)))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))], names=["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return ready(docs).select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


# ---- drawing


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 times Gumbel noise), from a hash of the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scores: DataFrame, n: int) -> DataFrame:
    """key, at and rank (from 1) of the ``n`` rows with the highest score, ties to the smaller key.  ``scores`` (key, score, at) comes from
    a table; at is unique."""
    spark = scores.sparkSession
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("at").asc()]
    path = scratch_path(spark, "ranges")
    scores.repartitionByRange(*order).select("*", F.spark_partition_id().alias("part")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row per task
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(before.filter(F.col("before") < n)), "part")
    rank = (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).cast("long")
    return numbered.select("key", "at", rank.alias("rank")).filter(F.col("rank") <= n)


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``key``, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    The scores are written to the shared folder, where they are counted and ranked.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    made = weights(docs, gain, key, text)
    path = scratch_path(spark, "scores")
    made.withColumn("score", F.col("weight") + noise(F.col("key"))).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    able = rows.filter(F.col("n_words") >= least_words)
    n = percent * able.count() // 100
    drawn = ranked(able.select("key", "score", "at"), n).select("at", "rank")
    return rows.join(drawn, "at", "left").select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """The drawn documents with the columns that they came with.  ``key`` is unique."""
    free = free_name(docs.columns)
    kept = scored(docs, target, key, **more).filter(F.col("rank").isNotNull()).select(F.col(key).alias(free))
    return docs.join(kept, docs[key].eqNullSafe(kept[free]), "left_semi")
