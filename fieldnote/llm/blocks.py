"""Blocks of documents that ask the corpus about keys.

Several operators need to know of very many keys (hashes of windows, n-grams, parts of
suffixes) whether they occur elsewhere, first or how often.  A row per key would cost far more than
the key, so that a task here works on a block of documents: it sends its distinct keys,
sorted and byte-packed, to parts by hash range; a part answers each block for each of its
keys; the block reads the answers in the order in which it asked.  All of it is Spark's own
grouping and shuffling of ``part`` and ``block``; nothing reaches the driver.

* Blocks follow the order of ``doc_id``: a smaller block holds smaller ids, so that "an
  earlier block has it" means "an earlier document has it".  Inside a block rows are sorted
  by id (null first) and text.
* A key that is everywhere comes once from each block, already counted there.
* The grouped documents are one exchange, which the passes over them share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm import scan
from fieldnote.llm.workers import give_back, ready

# Input bytes (as stored) of a block; a worker needs some 30 times as much memory.
BLOCK_BYTES = 6 << 20
# Numbers from which on byte planes are compressed apart.
PLANE = 256
REQUEST = "part int, block long, data array<binary>"
REPLY = "block long, part int, stage int, data array<binary>"
_REQUEST = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.list_(pa.binary()))])
_REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("stage", pa.int32()), ("data", pa.list_(pa.binary()))])


def count_for(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks ``docs`` makes, by the planner's size of its input, or where the planner
    has none by the bytes of its texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // block_bytes))


def blocked(docs: DataFrame, n: int, *more: str, bundle: bool = False) -> DataFrame:
    """block, doc_id, text and the columns ``more``, dealt out by block (``bundle``: as ``bundled`` rows).  ``doc_id`` is a whole number.

    The borders are n - 1 approximate quantiles of the ids, from one pass over that column.
    """
    borders = np.zeros(0, np.int64)
    if n > 1:
        found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n)).first()[0]
        borders = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("long")
    def block(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.searchsorted(borders, ids.fillna(0).to_numpy().astype(np.int64), "left")
        return pd.Series(np.where(known, at, 0))

    cols = ["doc_id", "text", *more]
    held = ready(docs).select(*cols).withColumn("block", block(F.col("doc_id").cast("long")))
    return bundled(held, n) if bundle else held.repartition(n, "block")


def bundled(held: DataFrame, n: int) -> DataFrame:
    """``held`` dealt out by its column ``block``, with the other columns of the rows of a batch and block as one compressed
    value ``rows``: texts take two thirds of the shuffle that they take as rows.  ``unbundled`` gives the rows back."""
    at = held.columns.index("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))
        for batch in batches:
            block = batch.column(at).to_numpy()
            order = np.argsort(block, kind="stable")
            rows = pa.Table.from_batches([batch]).drop_columns(["block"])
            numbers, first = np.unique(block[order], return_index=True)
            data = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_table(rows.take(order[a:b]).combine_chunks())
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], ["block", "rows"])

    return held.mapInArrow(run, "block long, rows binary").repartition(n, "block")


def unbundled(table: pa.Table) -> pa.Table:
    """The rows of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"]])


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows by id (null first) and text."""
    give_back()
    keys = pa.table({"i": table["doc_id"], "t": table["text"]})
    at = pa.compute.sort_indices(keys, sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start")
    return table.take(at)


# ---- byte packing


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed byte planes; ``rising``: sorted ones, kept as differences."""
    if rising and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    if len(values) < PLANE:
        return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    # A block of its own, and so a code of its own, for each plane.
    out = zstandard.ZstdCompressor(level=1).compressobj(size=planes.size)
    return b"".join([*(out.compress(p.data) + out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) for p in planes), out.flush()])


def expand(data: bytes, kind, rising: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def squeeze_text(columns: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes of text each as compressed rows: neighbours begin alike."""
    rows = np.stack(columns, axis=1).astype(">u8")
    return zstandard.ZstdCompressor(level=5).compress(rows.tobytes())


def expand_text(data: bytes, columns: int) -> list[np.ndarray]:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), ">u8").reshape(-1, columns)
    return [rows[:, i].astype(np.uint64) for i in range(columns)]


# ---- asking and answering


class Keys:
    """Distinct keys of a block in the order in which it asks for them.

    columns: one array per component of the key; the first is a hash or is hashed (with the
    others) to choose the part.  inverse: for each given key its place; first: for each
    distinct key the index of its first occurrence; counts.
    """

    def __init__(self, columns: list[np.ndarray], parts: int, hashed: bool = True):
        spread = columns[0]
        if not hashed:
            spread = np.zeros(len(columns[0]), np.uint64)
            for c in columns:
                spread = scan.mix64(spread * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
        part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        group, order = groups_of(columns) if hashed else _alike(columns, spread)
        opens = np.flatnonzero(np.diff(group[order], prepend=-1))
        self.first, self.counts, self.inverse = order[opens], np.diff(np.append(opens, len(order))), group
        if not hashed:
            place = _nearby(part[self.first], [c[self.first] for c in columns], parts)
            self.first, self.counts = self.first[place], self.counts[place]
            back = np.empty(len(place), np.int64)
            back[place] = np.arange(len(place))
            self.inverse = back[group]
        self.columns = [c[self.first] for c in columns]
        self.parts = parts
        self.edges = np.searchsorted(part[self.first], np.arange(parts + 1, dtype=np.uint64))

    def __len__(self) -> int:
        return len(self.first)

    def ask(self, block: int, *extra: np.ndarray, note: list[bytes] | None = None, text: bool = False) -> pa.Table:
        """One row for each part, also for parts without a key.  ``note``: what the block will want
        to know again, which comes back with the answers.  ``text``: the columns hold text and go as rows of it."""
        data = []
        for p in range(self.parts):
            a, b = self.edges[p], self.edges[p + 1]
            own = [c[a:b] for c in self.columns]
            data.append([squeeze_text(own)] if text else [squeeze(c, i == 0) for i, c in enumerate(own)] + [squeeze(x[a:b]) for x in extra])
        parts = list(range(self.parts))
        if note is not None:
            data.append(note)
            parts.append(-1 - block)
        return pa.table(
            [pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(data, pa.list_(pa.binary()))],
            schema=_REQUEST,
        )


def answer(
    requests: DataFrame, stage: int, kinds: list, fn: Callable[..., list | tuple], numbered: bool = False, text: bool = False, near: bool = False
) -> DataFrame:
    """Replies to ``requests``.  ``fn`` gets all keys (and extras) of a part and for each the number
    of its block, and returns arrays of answers in the same order, or these and
    arrays that every block gets whole.  ``numbered``: it gets the number of the part too.  ``text``: as asked with it.
    ``near``: answers of neighbours are near each other and go as differences."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        part = table["part"][0].as_py()
        if part < 0:
            same = pa.array([-stage] * len(table), pa.int32())
            return pa.table([table["block"], table["part"], same, table["data"]], schema=_REPLY)
        table = table.sort_by("block")
        blocks = table["block"].to_pylist()
        rows = table["data"].to_pylist()
        columns = list(zip(*(expand_text(r[0], len(kinds)) for r in rows))) if text else [[expand(r[i], k, i == 0) for r in rows] for i, k in enumerate(kinds)]
        sizes = [len(c) for c in columns[0]]
        whose = np.repeat(np.arange(len(rows)), sizes)
        out, same = fn([np.concatenate(c) for c in columns], whose, *[part] * numbered), []
        if isinstance(out, tuple):
            out, same = out
        cuts = np.cumsum([0, *sizes])
        data = [[squeeze(x[a:b], near) for x in out] + [squeeze(x) for x in same] for a, b in zip(cuts, cuts[1:])]
        n = len(rows)
        return pa.table(
            [pa.array(blocks, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([stage] * n, pa.int32()), pa.array(data, pa.list_(pa.binary()))],
            schema=_REPLY,
        )

    return requests.groupBy("part").applyInArrow(run, REPLY)


def replies(table: pa.Table, stage: int, kinds: list, near: bool = False) -> list[np.ndarray]:
    """A block's answers of one stage, in the order of its keys; ``near``: as answered with it."""
    rows = table.filter(pa.compute.equal(table["stage"], stage)).sort_by("part")["data"].to_pylist()
    return [np.concatenate([expand(r[i], k, near) for r in rows]) if rows else np.zeros(0, k) for i, k in enumerate(kinds)]


def note_of(table: pa.Table, stage: int) -> list[bytes]:
    """What the block noted when it asked."""
    return table.filter(pa.compute.equal(table["stage"], -stage))["data"][0].as_py()


def groups_of(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of equal keys for each key (groups in sorted order), and a stable order by group."""
    return _grouped(columns, scan.lexical(columns))


def _grouped(columns: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            s = c[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order


def _alike(columns: list[np.ndarray], spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``groups_of``, in the order of the hash ``spread`` of all columns; the columns themselves decide what is equal."""
    group, order = _grouped([spread, *columns], scan.rising(spread))
    if len(order) and group[order[-1]] != np.count_nonzero(np.diff(spread[order])):
        # Different keys of one hash may lie between each other.
        return groups_of([spread, *columns])
    return group, order


def _nearby(part: np.ndarray, columns: list[np.ndarray], parts: int) -> np.ndarray:
    """An order by part and then by the leading bits of the columns, which puts like keys together.  Two sorts of bits with
    the places below them; what lies behind those bits stays in the order that it has."""
    n, values = len(part), columns[0].astype(np.uint64)
    places, leads = max(n - 1, 1).bit_length(), (parts - 1).bit_length()
    low, place = np.uint64((1 << places) - 1), np.arange(n, dtype=np.uint64)
    spare = max(int(values.max(initial=0)).bit_length() - (64 - places - leads), 0)
    order = place
    if spare and len(columns) > 1:
        rest = values << np.uint64(64 - spare) | columns[1].astype(np.uint64) >> np.uint64(spare)
        order = np.sort((rest & ~low) | place) & low
    packed = (values[order] >> np.uint64(spare)) << np.uint64(places) | place
    if leads:
        packed |= part[order] << np.uint64(64 - leads)
    return order[np.sort(packed) & low].astype(np.int64)


def seen_before(columns: list[np.ndarray], whose: np.ndarray) -> list[np.ndarray]:
    """1 for keys that an earlier block holds too.  Keys come block by block."""
    group, order = groups_of(columns)
    out = np.ones(len(group), np.uint8)
    at = group[order]
    out[order[np.flatnonzero(np.diff(at, prepend=-1))]] = 0
    return [out]


def texts(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of chunks of a block's texts."""
    data, at = scan.raw(table["text"])
    for i, j in scan.chunks(data, at):
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out
