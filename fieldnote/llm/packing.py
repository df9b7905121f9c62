"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Large-item matching: pieces above a third of the capacity fit at most twice into a
sequence; each, the longest first, is matched with the longest other one that still fits.
The smaller pieces, again the longest first, go where they leave the smallest gap.

Scale: lengths are whole numbers up to the capacity, so that the packing is worked out on
the histogram of lengths (at most ``capacity`` rows, whatever the corpus) as runs of equal
sequences.  A piece is then placed by its rank among the pieces of its length.  Ranks come
from numbered hash buckets with prefix sums over the buckets; no length is sorted whole.
Token ids never leave the task that made them.

Defined results: a null or empty text is one token, the closing id; an empty table gives
no rows; rows alike in id and text are packed each for itself; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldnote.llm.workers import ready, tidy
from fieldnote.session import cut_lineage

CAPACITY = 2048
# Parts of words whose ids a task keeps; beyond it starts anew.
CACHED_PARTS = 600_000
# Pieces that one numbering task holds.
PIECES_PER_BUCKET = 100_000
# Bytes of text encoded at once.
TEXT_BYTES = 1 << 22
# Letters of ASCII and Latin-1, then marks that end a word of their own; no apostrophe, nothing of a special token.
_PLAIN = "^(?P<one>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(?P<two>[!\"#$%&()*+,\\-./:;=?@\\[\\\\\\]^_`{}~]*)$"
_held: dict = {}


class _Ids:
    """Ids of blank-separated words.

    A word of plain letters, plain marks or marks behind letters is put together from these two parts, which most
    texts share and which are kept; others go to the tokenizer as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Word ends are marked and case is dropped: then parts may be encoded side by side.
        self.whole = not self.closes.any() or self._direct(["Aa bB"]) != self._direct(["aa bb"])
        # A line break is a blank.
        self.lines = self._direct(["Aa\nbB", "a.\n\n.b", "a\n's 1\n2"]) == self._direct(["Aa bB", "a.  .b", "a 's 1 2"])

    def forget(self) -> None:
        """Drops the parts that are kept."""
        self.parts = {"": b""}

    def _direct(self, words: list[str]) -> list[bytes]:
        encode, out = self.tokenizer.encode_batch_fast, []
        for i in range(0, len(words), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in encode(words[i : i + 4096], add_special_tokens=False)]
        return out

    def _encode_parts(self, new: list[str]) -> None:
        (encoded,) = self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4")
        ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
        if len(ends) == len(new) and ends[-1] == 4 * len(ids):
            data, begin = ids.tobytes(), 0
            for part, end in zip(new, ends.tolist()):
                self.parts[part] = data[begin:end]
                begin = end
        else:
            self.parts.update(zip(new, self._direct(new)))

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        if len(self.parts) > CACHED_PARTS:
            self.forget()
        found = list(map(self.parts.get, parts))
        unknown = [p for p, ids in zip(parts, found) if ids is None]
        for i in range(0, len(unknown), 20_000):
            self._encode_parts(unknown[i : i + 20_000])
        return list(map(self.parts.__getitem__, parts)) if unknown else found

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after the other, and how many each has."""
        if self.whole:
            return _joined(self._direct(words.to_pylist()))
        split = pc.extract_regex(words, _PLAIN)
        plain = split.is_valid()
        split, n = split.filter(plain), pc.sum(plain).as_py() or 0
        parts = pa.concat_arrays([pc.utf8_lower(pc.struct_field(split, "one")), pc.struct_field(split, "two")]).dictionary_encode()
        known = self._of_parts(parts.dictionary.to_pylist())
        flat, size = _joined([*known, *self._direct(words.filter(pc.invert(plain)).to_pylist()), b""])
        # Two places for each word; the second of one that is not plain is empty.
        place = np.full((len(words), 2), len(size) - 1)
        plain, of = plain.to_numpy(zero_copy_only=False), parts.indices.to_numpy()
        place[plain, 0], place[plain, 1] = of[:n], of[n:]
        place[~plain, 0] = len(known) + np.arange(len(words) - n)
        return _gathered(flat, size, place.ravel()), size[place].sum(axis=1)

    def of(self, column: pa.Array, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed, one after the other, and how many each has.

        Arrow numbers the distinct words; their ids are looked up once and gathered by number."""
        texts = pc.fill_null(column, "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if self.lines else texts, " ")
        at = split.offsets.to_numpy()
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        flat, size = self._of_words(coded.dictionary)
        flat, size = np.append(flat, np.uint32(closing)), np.append(size, 1)
        ends = at[1:] - at[0]
        number = np.insert(coded.indices.to_numpy(), ends, len(size) - 1)
        upto = np.cumsum(size[number])[ends + np.arange(len(ends))]
        return _gathered(flat, size, number), np.diff(upto, prepend=0)


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _gathered(flat: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (of ``size``) that ``number`` names, one after the other."""
    many, begin = size[number], np.cumsum(size) - size
    upto = np.cumsum(many)
    return flat[np.repeat(begin[number] - upto + many, many) + np.arange(many.sum())]


def _encoder(path: str) -> _Ids:
    if path not in _held:
        _held[path] = _Ids(path)
    return _held[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: every document's ids, cut only where they
    exceed the capacity.  The tokenizer's pre-tokenizer must break at every blank; the file
    must be at the same path on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoder(tokenizer)
        for batch in batches:
            at = 0
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            upto = np.cumsum(size)
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + TEXT_BYTES, "right")))
                flat, total = ids.of(batch.column(1)[at:stop], closing)
                cut = -(-total // capacity)
                row = np.repeat(np.arange(at, stop), cut)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cut) - cut, cut)
                length = np.minimum(capacity, np.repeat(total, cut) - piece * capacity)
                data, ends = memoryview(flat.astype("<u4", copy=False).tobytes()), 4 * np.cumsum(length)
                crc = [zlib.crc32(data[i:j]) for i, j in zip((ends - 4 * length).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (piece * capacity, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                at = stop
        # A worker waits for further tasks, of other steps too, with all that it keeps.
        ids.forget()

    return ready(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def arrange(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks' end, first sequence, offset) for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, how many)
    bins = 0

    def put(n: int, first: int, many: int, offset: int) -> None:
        out.append((n, used[n], used[n] + many, first, offset))
        used[n] += many
        left[n] -= many

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            gaps.setdefault(gap, []).append((first, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m + n <= capacity and left[m] and (m != n or left[n] > 1)), None)
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, bins, many, 0)
            if mate is not None:
                put(mate, bins, many, n)
            free(capacity - n - (mate or 0), bins, many)
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                per = min(capacity // n, left[n])
                many = left[n] // per
                for i in range(per):
                    put(n, bins, many, i * n)
                free(capacity - per * n, bins, many)
                bins += many
                continue
            first, runs = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            many = min(runs, left[n])
            put(n, first, many, capacity - gap)
            free(gap - n, first, many)
            free(gap, first + many, runs - many)
    return out


def pack(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, length and more) with sequence_id and offset."""
    cut = cut_lineage(cut)
    total = cut.count()
    buckets = max(1, -(-total // PIECES_PER_BUCKET))
    dealt = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut_lineage(dealt.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # At most ``capacity`` rows come to the driver.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    places = spark.createDataFrame(
        arrange(histogram, capacity), "length long, _lo long, _hi long, _seq long, _at long"
    )
    number = Window.partitionBy("length", "_b").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_r", F.row_number().over(number) - 1).join(starts, ["length", "_b"]).withColumn(
        "_r", F.col("_r") + F.col("_first")
    )
    fits = (F.col("c.length") == F.col("p.length")) & (F.col("c._r") >= F.col("p._lo")) & (F.col("c._r") < F.col("p._hi"))
    return ranked.alias("c").join(F.broadcast(places).alias("p"), fits).select(
        *[F.col(f"c.`{x}`") for x in cut.columns],
        (F.col("p._seq") + F.col("c._r") - F.col("p._lo")).alias("sequence_id"),
        F.col("p._at").alias("offset"),
    )
