"""Secret scan: fixed patterns, and strings that neither the text around them nor a
dictionary of identifiers helps to compress.

Dictionary-primed zstandard novelty: a candidate stands in a sensitive context (a word such
as key, token or credential shortly before or after it, on any line, or a candidate right before it).  The text around it, without the candidate,
and common identifiers prime a compressor; the marginal compressed bytes of the candidate
over its length are its novelty.  Names, paths and repeated words compress, random keys
do not.

All work is row by row and moves nothing.  Defined results: a null or empty text has no
spans; positions are code points; repeated rows give repeated results; extra columns are
kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm import scan
from fieldnote.llm.workers import ready, tidy

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORD = re.compile(r"(?i:passw|passphrase|secret|token|api.?key|private.?key|access.?key|credential|authori[sz]ation|bearer)", re.S)
# Characters before and after a keyword in which a candidate may end or begin, over line breaks.
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Which texts need a closer look; RE2 reads them all at once.
BASE_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
CONTEXT_HINT = r"(?is:passw|passphrase|secret|token|api.?key|private.?key|access.?key|credential|authori[sz]ation|bearer)"
IDENTIFIERS = (
    b"access account address api application authentication authorization bearer client config connection credential "
    b"database default description development endpoint environment example expires function generate github header "
    b"identifier instance internal interface key login manager message module name number object option parameter "
    b"password permission placeholder private production project property provider public refresh region register "
    b"request resource response return secret security server service session settings signature source staging "
    b"storage string system test token type undefined update user username value version your_key_here xxxxxxxxxxxxxxxx "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 changeme"
)
AROUND = 256
# Bytes compressed at once: from 64 on the alphabet of a random string would lower its cost.
PIECE = 48
# Parts of a candidate, and in them words with the number behind (camel case apart).
SEGMENT = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"([A-Z]?[a-z]{3,}|[A-Z][a-z]{2}|[A-Z]{3,}(?![a-z]))([0-9]{0,4}(?![0-9]))")
# Bits of the dearest pair of letters, so that one rare pair makes no name a key.
DEAREST = 8.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end] per byte, given what stands around it and, piece by piece, before it in itself."""
    import zstandard

    around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).encode()
    word, cost = text[start:end].encode(), 0
    n = -(-len(word) // PIECE)
    for i in range(n):
        lo, hi = len(word) * i // n, len(word) * (i + 1) // n
        known = zstandard.ZstdCompressionDict(IDENTIFIERS + around + word[max(0, lo - AROUND) : lo], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=9, dict_data=known, write_checksum=False, write_content_size=False)
        cost += len(press.compress(word[lo:hi])) - len(press.compress(b""))
    return cost / len(word)


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings near a keyword, and those that follow such a string with nothing but blanks between (a key over several lines)."""
    words = [(m.start(), m.end()) for m in KEYWORD.finditer(text)]
    out, at, last = [], 0, -1
    for m in CANDIDATE.finditer(text) if words else ():
        a, b = m.span()
        while at < len(words) and words[at][1] + REACH <= a:
            at += 1
        near = at < len(words) and words[at][0] - REACH <= b
        if near or last >= 0 and not text[last:a].strip():
            out.append((a, b))
            last = b
        else:
            last = -1
    return out


def _cuts(text: str, a: int, b: int) -> Iterator[list[tuple[int, int]]]:
    """The string, and its parts from each keyword in it or behind keywords and equals signs: names in front do not dilute it."""
    yield [(a, b)]
    words = list(KEYWORD.finditer(text, a, b))
    signs = [m.end() for m in re.compile("=+").finditer(text, a, b)]
    for at in ([m.start() for m in words], sorted({m.end() for m in words} | set(signs))):
        edges = [a, *at, b]
        yield [(x, y) for x, y in zip(edges, edges[1:]) if y - x >= 16 and (x, y) != (a, b)]


def _pairs_of(data: np.ndarray) -> np.ndarray:
    """27 x 27 counts of neighbouring letters in UTF-8 bytes; 26 is whatever is no letter, either case is one."""
    low = data | 32
    code = np.where((low >= 97) & (low <= 122), low.astype(np.int64) - 97, 26)
    return np.bincount(code[:-1] * 27 + code[1:], minlength=729).reshape(27, 27)[:26, :26] if len(code) > 1 else np.zeros((26, 26), np.int64)


def _bits(pairs: np.ndarray) -> np.ndarray:
    """Bits that a letter costs behind another, at most ``DEAREST``."""
    return np.minimum(np.log2((pairs.sum(axis=1, keepdims=True) + 2.6) / (pairs + 0.1)), DEAREST)


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring letters (26 x 26) in the texts of all documents, each stretch of letters and digits of up to 15 characters."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((26, 26), np.int64)
        for batch in batches:
            data, at = scan.raw(batch.column(0))
            for i, j in scan.chunks(data, at):
                total += _pairs_of(_short(data[at[i] : at[j]]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["pair", "n"])

    out = np.zeros(676, np.int64)
    for pair, n in ready(docs).select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(26, 26)


def _short(data: np.ndarray) -> np.ndarray:
    """Bytes with every stretch of 16 or more letters and digits blanked: keys must not teach what a name is."""
    low = data | 32
    inside = ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    out = np.append(data, np.uint8(32))
    step = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= 16
    step[starts[long]] += 1
    step[ends[long]] -= 1
    out[np.cumsum(step) > 0] = 32
    return out


class Names:
    """Which segments are made of names and numbers, by the letter pairs of the identifiers or of the corpus, and of the text around."""

    def __init__(self, corpus: np.ndarray | None = None):
        self.pairs = [_pairs_of(np.frombuffer(IDENTIFIERS, np.uint8))] + ([] if corpus is None else [corpus])

    def around(self, text: str, start: int, end: int) -> list[np.ndarray]:
        near = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
        more = _pairs_of(_short(np.frombuffer(near.encode(), np.uint8)))
        return [_bits(p + more) for p in self.pairs]

    def strange(self, text: str, start: int, end: int) -> bool:
        """Whether at least half of the string lies in segments that are neither short, nor numbers, nor names."""
        bits = self.around(text, start, end)
        odd = sum(len(s) for s in SEGMENT.findall(text[start:end]) if len(s) > 3 and not self.plain(s, bits))
        return 2 * odd >= end - start

    @staticmethod
    def plain(segment: str, bits: list[np.ndarray]) -> bool:
        """A number of up to 12 digits, or six tenths of it words of three letters or more; the number behind a word of four or more counts with it."""
        if segment.isdigit():
            return len(segment) <= 12
        held = 0
        for word, number in WORD.findall(segment):
            code = np.frombuffer(word.lower().encode(), np.uint8).astype(np.int64) - 97
            if min(b[code[:-1], code[1:]].mean() for b in bits) < math.log2(26):
                held += len(word) + len(number) * (len(word) > 3)
        return 10 * held >= 6 * len(segment)


def novel_spans(text: str, known: list[tuple[int, int, int]], least: float = 0.8, names: Names | None = None) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that are new and outside the ``known`` spans."""
    names = names or Names()
    new = lambda a, b: novelty(text, a, b) >= least and names.strange(text, a, b)
    out = []
    for a, b in candidates(text):
        if not any(a < e and s < b for s, _, e in known):
            out += [(x, 3, y) for x, y in next(filter(None, ([c for c in cut if new(*c)] for cut in _cuts(text, a, b))), [])]
    return out


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _hints(column: pa.Array) -> tuple[list[bool], list[bool]]:
    look = lambda p: pc.fill_null(pc.match_substring_regex(column, p), False).to_pylist()
    return look(BASE_HINT), look(CONTEXT_HINT)


def _spans(column: pa.Array, names: Names) -> Iterator[tuple[list, list]]:
    for i, (base, context) in enumerate(zip(*_hints(column))):
        text = column[i].as_py() if base or context else ""
        fixed = base_spans(text) if base else []
        yield fixed, sorted(fixed + novel_spans(text, fixed, names=names)) if context else fixed


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = Names(letter_pairs(docs))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fixed, every in _spans(batch.column(1), names):
                n = [sum(k == i for _, k, _ in every) for i in range(4)]
                rows.append((*n, hashlib.sha256(_shown(fixed).encode()).hexdigest(), _shown(every)))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    return ready(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    )


def blotted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every stretch of spans replaced by ``mark``."""
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; ``n_chars`` is renewed where there is one."""
    at = docs.columns.index("text")
    names = Names(letter_pairs(docs))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new = [blotted(column[i].as_py(), every, mark) if every else column[i].as_py() for i, (_, every) in enumerate(_spans(column, names))]
            cols = [pa.array(new, column.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = ready(docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
