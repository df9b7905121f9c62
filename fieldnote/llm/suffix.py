"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A string of ``LENGTH`` bytes that starts earlier too is a suffix whose neighbour in the sorted
suffixes shares at least that many bytes.  Suffixes are therefore sorted by their first
``LENGTH`` bytes, with the difference cover {1, 2} modulo 3:

1. Sort sampled triples.  At the positions 1 and 2 (mod 3) of a document the triples of
   8-byte symbols (24 bytes) are sorted and named by their rank.
2. Recurse on names.  Triples of names 24 bytes apart are sorted and named: 72 bytes.  A
   third round would pass ``LENGTH``, so the recursion ends here.
3. Merge the remaining suffixes.  Of any two positions, one shift of 0, 1 or 2 puts both on
   sampled ones; so every suffix is entered under the two of three forms that fit its
   position: some leading bytes, then two names that overlap and end with byte ``LENGTH``.
4. Compare adjacent prefixes: entries that are equal stand together, the earliest is the original.

Parts keep their own sort order (by hash range, then by content), which decides equality as a
lexicographic order of everything would.

Before the sort, windows that cannot matter are set aside, exactly: each window has an anchor (the
least hash of the 50-byte strings in it), consecutive windows with one anchor form a run.  An anchor that
occurs in a single context has no repeated window; a run whose whole context occurs
earlier is repeated as a whole; only the first run of each context of an anchor with several
contexts goes into the sort.  Contexts under one anchor (40 bits) are compared by 96 bits of their own: a hash of their bytes
(64) and an independent one over the hashes of their 50-byte strings (32).

Defined results: a null text is empty; rows with one id count as documents one after the other, in
order of their text; matches never cross rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldnote.llm import blocks as B
from fieldnote.llm import scan

LENGTH, GRAM = 100, 50
# Input bytes of a block: smaller than elsewhere, as a block of copies sorts most of its bytes.
BLOCK_BYTES = 3 << 20
_U = np.uint64
_ANCHOR = _U(-1 << 24 & (1 << 64) - 1)
# The symbols of a triple, and the triples of the second round, are so far apart.
_SYMBOL, _TRIPLE = 8, 24


def _ranges(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First number and length of the ranges that rising numbers make up."""
    first = np.flatnonzero(np.diff(s, prepend=-2) != 1)
    return s[first], np.diff(np.append(first, len(s)))


class _Chunk:
    """Runs of windows of a chunk: first and last window, anchor and context."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        # Bytes of runs that repeat as a whole, as ranges, and the windows left for the sort.
        self.whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.residual = np.zeros(0, np.int64)

    def measure(self) -> _Chunk:
        data, at = self.data, self.at
        self.lo = self.hi = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, _U)
        self.context = np.zeros(0, _U)
        self.further = np.zeros(0, np.uint32)
        self.tied = np.zeros(0, bool)
        n = len(data) - LENGTH + 1
        if n <= 0:
            return self
        sums = scan.prefix(data.astype(_U) + _U(1))
        count = len(data) - GRAM + 1
        grams = scan.mix64((sums[GRAM:] - sums[:-GRAM]) * scan._powers_of(scan._INVERSE, len(sums))[:count])
        width = LENGTH - GRAM + 1
        least = B.sliding(grams, width, np.minimum)
        size = np.diff(at)
        valid = np.arange(n) + LENGTH <= np.repeat(at[1:], size)[:n]
        if not valid.any():
            return self
        opens = valid.copy()
        opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        closes = valid.copy()
        closes[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
        self.lo, self.hi = np.flatnonzero(opens), np.flatnonzero(closes)
        # The least of many hashes is small: mixed again it is spread evenly over the parts.
        least = least[self.lo]
        # Its leading bits are enough: anchors taken for one send more windows to the sort, as contexts are told apart by themselves.
        self.anchor = scan.mix64(least) & _ANCHOR
        self.context = scan.between(sums, self.lo, self.hi + LENGTH)
        self.further = (scan.between(scan.prefix(grams), self.lo, self.hi + width) >> _U(32)).astype(np.uint32)
        # A run that reaches beyond the first place of its anchor may repeat within itself.
        place = self.lo.copy()
        todo = np.flatnonzero(grams[place] != least)
        while len(todo):
            place[todo] += 1
            todo = todo[grams[place[todo]] != least[todo]]
        self.tied = self.hi > place
        return self

    def windows(self, runs: np.ndarray) -> np.ndarray:
        """The starts of all windows of some runs."""
        lo, n = self.lo[runs], self.hi[runs] - self.lo[runs] + 1
        return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(lo) else np.zeros(0, np.int64)

    def residue(self, s: np.ndarray) -> np.ndarray:
        return (s - self.at[np.searchsorted(self.at, s, "right") - 1]) % 3

    def symbols(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), _U)
        for i in range(_SYMBOL):
            out = (out << _U(8)) | self.data[p + i].astype(_U)
        return out

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions whose names of the second and of the first round the windows need."""
        s, r = self.residual, self.residue(self.residual)
        second = np.zeros(len(self.data), bool)
        for rest, shifts in ((0, (1, 28, 2, 26)), (1, (1, 28, 0, 27)), (2, (2, 26, 0, 27))):
            own = s[r == rest]
            for d in shifts:
                second[own + d] = True
        second = np.flatnonzero(second)
        first = np.zeros(len(self.data), bool)
        for d in (0, _TRIPLE, 2 * _TRIPLE):
            first[second + d] = True
        return second, np.flatnonzero(first)

    def spread(self, at: np.ndarray, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.data), _U)
        out[at] = names
        return out

    def forms(self, names: np.ndarray) -> list[np.ndarray]:
        """Two entries for each window: a name, a tag with leading and closing bytes, and another name."""
        s, r = self.residual, self.residue(self.residual)
        t = self.data.astype(_U)
        one = [_U(1 << 40) | t[s], names[s + 1], names[s + 28]]
        two = [_U(2 << 40) | t[s] | t[s + 1] << _U(8) | t[s + 98] << _U(16) | t[s + 99] << _U(24), names[s + 2], names[s + 26]]
        three = [_U(3 << 40) | t[s + 99], names[s], names[s + 27]]
        out = []
        for a, b, c in (list(zip(one, two, three))[i] for i in (1, 0, 2)):
            pair = np.empty(2 * len(s), _U)
            pair[0::2] = np.where(r == 2, b, a)
            pair[1::2] = np.where(r == 0, b, c)
            out.append(pair)
        return out


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class _Block:
    """``note``: what an earlier pass noted; without it the runs are found."""

    def __init__(self, table: pa.Table, parts: int, note: list[bytes] | None = None):
        self.table, self.parts = B.ordered(table), parts
        self.chunks = [_Chunk(data, at) for _, _, data, at in B.texts(self.table)]
        # Where each chunk begins in the block.
        self.base = np.cumsum([0, *(len(c.data) for c in self.chunks)])
        if note is not None:
            self._read(note)
            return
        for c in self.chunks:
            c.measure()
        self.runs = B.Keys([_joined([c.anchor for c in self.chunks], _U), _joined([c.context for c in self.chunks], _U), _joined([c.further for c in self.chunks], np.uint32)], parts)

    def settle(self, said: np.ndarray) -> None:
        """Which runs repeat as a whole, and the windows left for the sort."""
        twice = np.ones(len(self.runs.inverse), bool)
        twice[self.runs.first] = (said & 1).astype(bool)
        several = (said & 2).astype(bool)[self.runs.inverse]
        at = 0
        for c in self.chunks:
            own = slice(at, at + len(c.lo))
            at += len(c.lo)
            step = np.zeros(len(c.data) + 1, np.int64)
            np.add.at(step, c.lo[twice[own]], 1)
            np.add.at(step, c.hi[twice[own]] + LENGTH, -1)
            c.whole = _ranges(np.flatnonzero(np.cumsum(step[:-1])))
            c.residual = c.windows(np.flatnonzero(~twice[own] & (several[own] | c.tied)))
        self.cover = [c.cover() for c in self.chunks]

    def note(self) -> list[bytes]:
        """Ranges of bytes and of windows that ``settle`` found, so that later passes need no runs."""
        out = []
        for pairs in ([c.whole for c in self.chunks], [_ranges(c.residual) for c in self.chunks]):
            begin = [b + base for (b, _), base in zip(pairs, self.base.tolist())]
            out += [B.squeeze(_joined(begin, np.int64), True), B.squeeze(_joined([n for _, n in pairs], np.int64))]
        return out

    def _read(self, note: list[bytes]) -> None:
        found = []
        for begin, size in (note[:2], note[2:]):
            begin, size = B.expand(begin, np.int64, True), B.expand(size, np.int64)
            cuts = np.searchsorted(begin, self.base).tolist()
            found.append([(begin[a:b] - base, size[a:b]) for a, b, base in zip(cuts, cuts[1:], self.base.tolist())])
        for c, c.whole, (begin, size) in zip(self.chunks, *found):
            c.residual = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.cover = [c.cover() for c in self.chunks]

    def triples(self) -> B.Keys:
        columns = [[c.symbols(p + d) for c, (_, p) in zip(self.chunks, self.cover)] for d in (0, _SYMBOL, 2 * _SYMBOL)]
        return B.Keys([_joined(x, _U) for x in columns], self.parts, hashed=False)

    def _named(self, keys: B.Keys, names: np.ndarray, which: int) -> list[np.ndarray]:
        given, out, at = names[keys.inverse], [], 0
        for c, places in zip(self.chunks, self.cover):
            p = places[which]
            out.append(c.spread(p, given[at : at + len(p)]))
            at += len(p)
        return out

    def pairs(self, names: np.ndarray) -> B.Keys:
        one = self._named(self.triples(), names, 1)
        columns = [[n[p + d] for n, (p, _) in zip(one, self.cover)] for d in (0, _TRIPLE, 2 * _TRIPLE)]
        return B.Keys([_joined(x, _U) for x in columns], self.parts, hashed=False)

    def entries(self, first: np.ndarray, second: np.ndarray) -> B.Keys:
        two = self._named(self.pairs(first), second, 0)
        columns = [c.forms(n) for c, n in zip(self.chunks, two)]
        return B.Keys([_joined([x[i] for x in columns], _U) for i in range(3)], self.parts, hashed=False)

    def removed(self, first: np.ndarray, second: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
        """For each chunk which bytes go."""
        keys = self.entries(first, second)
        twice = np.ones(len(keys.inverse), bool)
        twice[keys.first] = before.astype(bool)
        twice = twice[0::2] | twice[1::2]
        out, at = [], 0
        for c in self.chunks:
            step = np.zeros(len(c.data) + 1, np.int64)
            begin, size = c.whole
            step[begin] += 1
            step[begin + size] -= 1
            gone = c.residual[twice[at : at + len(c.residual)]]
            at += len(c.residual)
            step[gone] += 1
            step[gone + LENGTH] -= 1
            out.append(np.cumsum(step[:-1]) > 0)
        return out


def _contexts(columns: list[np.ndarray], whose: np.ndarray) -> list[np.ndarray]:
    """Bit 0: an earlier block has the run; bit 1: its anchor has several contexts."""
    run, order = B.groups_of(columns)
    one = order[np.flatnonzero(np.diff(run[order], prepend=-1))]
    seen = np.ones(len(run), np.uint8)
    seen[one] = 0
    # Runs come in the order of their anchors.
    anchors = columns[0][one]
    anchor = np.cumsum(np.concatenate(([True], anchors[1:] != anchors[:-1]))) - 1 if len(one) else np.zeros(0, np.int64)
    several = np.bincount(anchor)[anchor] > 1
    return [seen | several[run].astype(np.uint8) << 1]


def _names(parts: int):
    def ranks(columns: list[np.ndarray], whose: np.ndarray, part: int) -> list[np.ndarray]:
        rank, _ = B.groups_of(columns)
        return [(rank * parts + part + 1).astype(_U)]

    return ranks


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with ``texts`` also the kept bytes) of every document."""
    n = B.count_for(docs, block_bytes)
    parts = -(-n // 2)
    held = B.blocked(docs, n, bundle=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    triple = [_U, _U, _U]

    def settled(table: pa.Table, said: pa.Table) -> _Block:
        return _Block(B.unbundled(table), parts, B.note_of(said, 2))

    def names(said: pa.Table, stage: int) -> np.ndarray:
        return B.replies(said, stage, [_U], near=True)[0]

    def ask_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _Block(B.unbundled(table), parts).runs.ask(key[0].as_py())

    def ask_triples(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        b = _Block(B.unbundled(table), parts)
        b.settle(B.replies(said, 1, [np.uint8])[0])
        return b.triples().ask(key[0].as_py(), note=b.note(), text=True)

    def ask_names(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        return settled(table, said).pairs(names(said, 2)).ask(key[0].as_py())

    def ask_entries(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        return settled(table, said).entries(names(said, 2), names(said, 3)).ask(key[0].as_py())

    def result(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        b = settled(table, said)
        gone = b.removed(names(said, 2), names(said, 3), B.replies(said, 4, [np.uint8])[0])
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for c, cut in zip(b.chunks, gone):
            total = np.concatenate(([0], np.cumsum(cut)))
            opens = cut.copy()
            opens[1:] &= ~cut[:-1]
            borders = c.at[:-1][np.diff(c.at) > 0]
            opens[borders] = cut[borders]
            begun = np.concatenate(([0], np.cumsum(opens)))
            sizes += np.diff(c.at).tolist()
            removed += np.diff(total[c.at]).tolist()
            spans += np.diff(begun[c.at]).tolist()
            flat, stays = c.data[~cut].tobytes(), c.at - total[c.at]
            for x, y in zip(stays[:-1].tolist(), stays[1:].tolist()):
                digests.append(hashlib.sha256(flat[x:y]).hexdigest())
                if texts:
                    kept.append(flat[x:y])
        cols = {
            "doc_id": b.table["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        }
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    blocks = held.groupBy("block")
    # Each answer is dealt to the blocks once; the passes after it reuse that exchange.
    back = lambda replies: replies.repartition(n, "block")
    said = back(B.answer(blocks.applyInArrow(ask_runs, B.REQUEST), 1, [_U, _U, np.uint32], _contexts))
    asked = blocks.cogroup(said.groupBy("block")).applyInArrow(ask_triples, B.REQUEST)
    said = said.unionByName(back(B.answer(asked, 2, triple, _names(parts), numbered=True, text=True, near=True)))
    asked = blocks.cogroup(said.groupBy("block")).applyInArrow(ask_names, B.REQUEST)
    said = said.unionByName(back(B.answer(asked, 3, triple, _names(parts), numbered=True, near=True)))
    asked = blocks.cogroup(said.groupBy("block")).applyInArrow(ask_entries, B.REQUEST)
    said = said.unionByName(back(B.answer(asked, 4, triple, B.seen_before)))
    return blocks.cogroup(said.groupBy("block")).applyInArrow(
        result, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    )
