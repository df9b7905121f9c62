"""Removal of repeated word windows by Aho-Corasick automata.

A window is ``window`` consecutive words.  Every window has an anchor: of the phrases of
``phrase`` words in it, the one with the least hash.  Equal windows have equal anchors, so
that a window can only repeat where its anchor recurs.

1. The blocks ask of their anchors which recur anywhere: these are the recurring phrases.
2. Each block compiles the recurring phrases that it holds into an automaton, its shard,
   and streams all its documents through it; the automata find every occurrence.  Windows around
   an occurrence are confirmed by 96-bit hashes: the block asks which an earlier block holds.
3. Words in a window that starts earlier too are removed.

Scale: a shard is as large as the block, not as the corpus, and every document runs through one automaton.
Windows are judged on the input, all of them; nothing is capped.

Defined results: null or blank texts have no words; rows with one id count as documents one after
the other, in order of their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldnote.llm import blocks as B
from fieldnote.llm import scan

WINDOW, PHRASE = 20, 8
_OTHER = 0xD6E8FEB86659FD93


class _Words:
    """A chunk's words: hashes, and for each phrase start whether it lies in one document."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        self.starts, self.ends, self.first = scan.spans(data, at)
        self.hashes = scan.word_hashes(data, self.starts, self.ends)
        self.sums = scan.prefix(self.hashes)

    def ranges(self, width: int) -> np.ndarray:
        """Starts of the runs of ``width`` words that stay in one document."""
        n = len(self.starts)
        ok = np.zeros(max(n - width + 1, 0), bool)
        if len(ok):
            end_of = np.repeat(self.first[1:], np.diff(self.first))
            lo = np.arange(len(ok))
            ok = lo + width <= end_of[: len(ok)]
        return ok

    def hashed(self, at: np.ndarray, width: int) -> np.ndarray:
        return scan.between(self.sums, at, at + width)

    def check(self, at: np.ndarray, width: int) -> np.ndarray:
        """32 more bits of the same ranges, from hashes of the words by another seed."""
        other = scan.prefix(scan.word_hashes(self.data, self.starts, self.ends, _OTHER))
        return (scan.between(other, at, at + width) >> np.uint64(32)).astype(np.uint32)


def _anchors(words: _Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors."""
    n = len(words.starts)
    valid = words.ranges(window)
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = words.hashed(np.arange(n - phrase + 1), phrase)
    width = window - phrase + 1
    least = B.sliding(grams, width, np.minimum)
    least = np.where(valid, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    reach = B.sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero((reach == grams) & (reach > 0))
    return at, grams[at]


def _occurrences(words: _Words, recurring: np.ndarray, phrase: int) -> np.ndarray:
    """Starts of all occurrences of the recurring phrases, by an automaton over word numbers.

    recurring: a start of each phrase in this chunk."""
    found = np.zeros(len(words.starts), bool)
    if not len(recurring):
        return found
    _, number = np.unique(words.hashes, return_inverse=True)
    number = number.astype(np.uint32).tolist()
    shard = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for p in recurring.tolist():
        shard.add_word(tuple(number[p : p + phrase]), 1)
    shard.make_automaton()
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= phrase:
            ends = [e for e, _ in shard.iter(tuple(number[a:b]))]
            if ends:
                found[np.array(ends) + (a - phrase + 1)] = True
    return found


class _Block:
    """A block's passes.  The automaton runs once; where its phrases begin is noted for the last pass."""

    def __init__(self, table: pa.Table, parts: int, window: int, phrase: int, anchored: bool = True):
        self.table = B.ordered(table)
        self.window, self.phrase = window, phrase
        self.parts = parts
        self.chunks = [(i, j, _Words(data, at)) for i, j, data, at in B.texts(self.table)]
        if not anchored:
            return
        found = [_anchors(w, window, phrase) for *_, w in self.chunks]
        self.places = [p for p, _ in found]
        self.anchors = B.Keys([np.concatenate([h for _, h in found] or [np.zeros(0, np.uint64)])], parts)

    def stream(self, recur: np.ndarray) -> list[np.ndarray]:
        """For each chunk where recurring phrases begin, given which anchors recur."""
        again = recur.astype(bool)[self.anchors.inverse]
        cuts = np.cumsum([0, *map(len, self.places)])
        out = []
        for (_, _, words), places, a, b in zip(self.chunks, self.places, cuts, cuts[1:]):
            inverse = self.anchors.inverse[a:b][again[a:b]]
            _, one = np.unique(inverse, return_index=True)
            out.append(_occurrences(words, places[again[a:b]][one], self.phrase))
        return out

    def confirm(self, hits: list[np.ndarray]) -> None:
        """Candidate windows: those with a recurring phrase."""
        self.windows, keys, checks = [], [], []
        for (_, _, words), hit in zip(self.chunks, hits):
            valid = words.ranges(self.window)
            width = self.window - self.phrase + 1
            near = np.cumsum(np.concatenate(([0], hit)))
            n = len(valid)
            near = near[width : width + n] - near[:n] > 0
            at = np.flatnonzero(valid & near)
            self.windows.append(at)
            keys.append(words.hashed(at, self.window))
            checks.append(words.check(at, self.window) if len(at) else np.zeros(0, np.uint32))
        none = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        self.keys = B.Keys([np.concatenate(keys or none[0]), np.concatenate(checks or none[1])], self.parts)

    def removed(self, before: np.ndarray) -> list[np.ndarray]:
        """For each chunk which words go, given which windows an earlier block holds."""
        twice = np.ones(len(self.keys.inverse), bool)
        twice[self.keys.first] = before.astype(bool)
        cuts = np.cumsum([0, *map(len, self.windows)])
        out = []
        for (_, _, words), at, a, b in zip(self.chunks, self.windows, cuts, cuts[1:]):
            step = np.zeros(len(words.starts) + 1, np.int64)
            gone = at[twice[a:b]]
            np.add.at(step, gone, 1)
            np.add.at(step, gone + self.window, -1)
            out.append(np.cumsum(step[:-1]) > 0)
        return out


def _kept(words: _Words, stays: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Kept words joined by one space, and the range of each text in it."""
    data = words.data.copy()
    starts, ends = words.starts[stays], words.ends[stays]
    before = np.concatenate(([0], np.cumsum(stays)))[words.first]
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
    inner = np.ones(len(starts), bool)
    inner[before[:-1][before[:-1] < before[1:]]] = False
    keep[starts[inner] - 1] = True
    data[starts[inner] - 1] = 32
    size = np.concatenate(([0], np.cumsum(keep)))
    lo = np.zeros(len(before) - 1, np.int64)
    hi = lo.copy()
    some = before[:-1] < before[1:]
    lo[some] = size[starts[before[:-1][some]]]
    hi[some] = size[ends[before[1:][some] - 1]]
    return data[keep].tobytes(), lo, hi


def _recurs(columns: list[np.ndarray], whose: np.ndarray) -> list[np.ndarray]:
    group, _ = B.groups_of(columns[:1])
    n = np.bincount(group, weights=columns[1])
    return [(n[group] > 1).astype(np.uint8)]


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block_bytes: int = B.BLOCK_BYTES, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with ``texts`` the kept words as kept) of every document."""
    n = B.count_for(docs, block_bytes)
    held = B.blocked(docs, n)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = _Block(table, n, window, phrase)
        return b.anchors.ask(key[0].as_py(), np.minimum(b.anchors.counts, 2).astype(np.uint8))

    def windows(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        b = _Block(table, n, window, phrase)
        hits = b.stream(B.replies(said, 1, [np.uint8])[0])
        b.confirm(hits)
        return b.keys.ask(key[0].as_py(), note=[B.squeeze(np.packbits(x)) for x in hits])

    def result(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        b = _Block(table, n, window, phrase, anchored=False)
        noted = [np.unpackbits(B.expand(x, np.uint8)) for x in B.note_of(said, 2)]
        b.confirm([bits[: len(words.starts)].astype(bool) for bits, (_, _, words) in zip(noted, b.chunks)])
        n_words, n_removed, digests, kept = [], [], [], []
        for (_, _, words), gone in zip(b.chunks, b.removed(B.replies(said, 2, [np.uint8])[0])):
            flat, lo, hi = _kept(words, ~gone)
            n_words += np.diff(words.first).tolist()
            n_removed += np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first]).tolist()
            for x, y in zip(lo.tolist(), hi.tolist()):
                digests.append(hashlib.sha256(flat[x:y]).hexdigest())
                if texts:
                    kept.append(flat[x:y].decode())
        cols = {"doc_id": b.table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    recur = B.answer(held.groupBy("block").applyInArrow(anchors, B.REQUEST), 1, [np.uint64, np.uint8], _recurs)
    asked = held.groupBy("block").cogroup(recur.groupBy("block")).applyInArrow(windows, B.REQUEST)
    earlier = B.answer(asked, 2, [np.uint64, np.uint32], B.seen_before)
    return held.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(
        result, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    )
