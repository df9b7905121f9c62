"""Patterns of an assertion table as literals of the plan, behind one prefilter.

A pattern that is a column is compiled for every row and assertion.  Definitions are written by hand and few, so
they come to the driver once; every distinct pattern becomes a literal, is tried once per text, and only on the texts
of the skills and evals that ask for it.  Most patterns can't match without some fixed run of letters: these runs make one
alternation that is searched first, and a text without any of them meets no pattern at all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters outside ASCII that match an ASCII letter when case is ignored, and that letter.
FOLDED = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}
SHORTEST = 2
_ZERO_WIDTH_OR_CLASS = set("dDsSwWbBAzZGhHvVntrfaeRX")


def required(pattern: str) -> tuple[str, ...] | None:
    """Runs of ASCII letters, one of which every match holds (lower case); None if none is sure.

    Only plain characters between the constructs of the pattern are taken; anything unusual gives None.
    """
    alternatives, runs, run = [], [], ""
    i, n = 0, len(pattern)

    def close():
        nonlocal run
        runs.append(run)
        run = ""

    while i < n:
        c = pattern[i]
        literal = None
        if c == "\\":
            if i + 1 >= n:
                return None
            e = pattern[i + 1]
            i += 1
            if not e.isalnum():
                literal = e
            elif e in _ZERO_WIDTH_OR_CLASS:
                close()
            else:
                return None
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            close()
            i = end
        elif c == "(":
            if pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
                return None
            end = _group_end(pattern, i)
            if end is None:
                return None
            close()
            i = end
        elif c == "|":
            close()
            alternatives.append(runs)
            runs = []
        elif c in "?*{":
            run = run[:-1]
            close()
            i = _quantifier_end(pattern, i)
            if i is None:
                return None
        elif c == "+":
            close()
            i = _quantifier_end(pattern, i)
        elif c in ".^$":
            close()
        elif c in ")]}":
            return None
        else:
            literal = c
        if literal is not None:
            if literal.isascii():
                run += literal
            else:
                close()
        i += 1
    close()
    alternatives.append(runs)
    best = [max(r, key=len, default="") for r in alternatives]
    return tuple(b.lower() for b in best) if all(len(b) >= SHORTEST for b in best) else None


def _class_end(pattern: str, at: int) -> int | None:
    """The closing bracket of a simple character class."""
    i = at + 1
    if pattern[i : i + 1] == "^":
        i += 1
    if pattern[i : i + 1] == "]":
        return None
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[" or pattern.startswith("&&", i):
            return None
        elif pattern[i] == "]":
            return i
        i += 1
    return None


def _group_end(pattern: str, at: int) -> int | None:
    depth, i = 0, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] == "Q":
                return None
            i += 1
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            i = end
        elif c == "(":
            if pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
                return None
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return None


def _quantifier_end(pattern: str, at: int) -> int | None:
    """The last character of a quantifier with its lazy or possessive mark."""
    if pattern[at] == "{":
        at = pattern.find("}", at)
        if at < 0:
            return None
    return at + 1 if pattern[at + 1 : at + 2] in ("?", "+") else at


def folded(text: Column, ascii: Column) -> Column:
    """``text`` in the form in which required runs are looked up."""
    return F.lower(F.when(ascii, text).otherwise(F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))))


@dataclass
class PatternIndex:
    """places: (source, pattern) to the place in ``found``; users: who asks for it, as (skill, eval or None); rows and
    bytes of the assertion table."""

    places: dict[tuple[str, str], int] = field(default_factory=dict)
    users: list[set[tuple[str, str | None]]] = field(default_factory=list)
    rows: int = 0
    bytes: int = 0

    @classmethod
    def of(cls, assertions: DataFrame) -> PatternIndex:
        index = cls()
        size = F.octet_length(F.to_json(F.struct("*"))).alias("size")
        for r in assertions.select("skill", "eval", source_of().alias("source"), "patterns", size).collect():  # hand-written definitions
            index.rows, index.bytes = index.rows + 1, index.bytes + r["size"]
            for p in r["patterns"] or ():
                if p is None:
                    continue
                at = index.places.setdefault((r["source"], p), len(index.places))
                if at == len(index.users):
                    index.users.append(set())
                index.users[at].add((r["skill"], r["eval"]))
        return index

    def places_of(self, patterns: Column) -> Column:
        """The places of an assertion's patterns."""
        if not self.places:
            return F.array().cast("array<int>")
        pairs = [F.lit(x) for (source, p), at in self.places.items() for x in (f"{source}:{p}", at)]
        return F.transform(patterns, lambda p: F.create_map(*pairs)[F.concat(source_of(), F.lit(":"), p)])

    def found(self, m: Column) -> Column:
        """The first match of every pattern in the text that it looks at, null where there is none or nobody asks.  ``m``: a
        struct of body, unquoted and ascii."""
        none = F.lit(None).cast("string")
        if not self.places:
            return F.array().cast("array<string>")
        runs = {at: required(p) for (_, p), at in self.places.items()}
        sources = sorted({s for s, _ in self.places})

        def look(folds: Column) -> Column:
            tried = []
            for (source, p), at in self.places.items():
                inside = [F.contains(folds[source], F.lit(x)) for x in runs[at] or ()]
                wanted = _asked(self.users[at])
                may = wanted & reduce(lambda a, b: a | b, inside) if inside else wanted
                tried.append(F.when(may, _first(m[source], m["ascii"], p)).otherwise(none))
            if any(r is None for r in runs.values()):
                return F.array(*tried)
            any_run = "|".join(re.escape(x) for x in sorted({x for r in runs.values() for x in r}))
            some = reduce(lambda a, b: a | b, [F.rlike(folds[s], F.lit(any_run)) for s in sources])
            return F.when(some, F.array(*tried)).otherwise(F.array(*[none] * len(tried)))

        folds = F.struct(*[folded(m[s], m["ascii"]).alias(s) for s in sources])
        return F.get(F.transform(F.array(folds), look), F.lit(0))


def source_of() -> Column:
    """Which text an assertion's patterns look at: only bans may look past quoted spans."""
    past_quotes = (F.col("rule") == "regex_absent") & F.coalesce(F.col("quote_aware"), F.lit(True))
    return F.when(past_quotes, "unquoted").otherwise("body")


def _asked(users: set[tuple[str, str | None]]) -> Column:
    everywhere = sorted({s for s, e in users if e is None})
    conditions = [F.col("skill").isin(everywhere)] if everywhere else []
    evals: dict[str, set[str]] = {}
    for skill, of in users:
        if of is not None and skill not in everywhere:
            evals.setdefault(of, set()).add(skill)
    conditions += [(F.col("eval") == of) & F.col("skill").isin(sorted(skills)) for of, skills in sorted(evals.items())]
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _first(text: Column, ascii: Column, pattern: str) -> Column:
    """The first match, or null.  Case is ignored and letters of every script are letters; when text and
    pattern are both ASCII the cheaper ASCII matching finds the same."""

    def search(flags: str) -> Column:
        whole = F.lit(f"(?{flags}:{pattern})")
        return F.when(F.rlike(text, whole), F.regexp_extract(text, f"(?{flags}:{pattern})", 0))

    return F.when(ascii, search("i")).otherwise(search("iU")) if pattern.isascii() else search("iU")


def hits_of(places: Sequence | Column) -> Column:
    """First matches of an assertion, in the order of its patterns."""
    return F.filter(F.transform(places, lambda i: F.get(F.col("found"), i)), lambda x: x.isNotNull())
