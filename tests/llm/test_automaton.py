"""The backoff automaton against the recursion that defines the model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldnote.llm import blocks as B
from fieldnote.llm import lm
from fieldnote.llm.workers import ready


def _train(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def _want(rows, order, alpha=0.1, discount=0.75):
    """(id, tokens, known, base, score) by the recursion over whole histories."""
    tokens = [(i, ["<s>", *(t or "").lower().split(), None]) for i, t in rows]
    count, after = Counter(), defaultdict(set)
    for i, ws in tokens:
        if _train(i):
            for end in range(1, len(ws)):
                for k in range(min(order - 1, end) + 1):
                    h = tuple(ws[end - k : end])
                    count[h, ws[end]] += 1
                    after[h].add(ws[end])
    seen = Counter()
    for (h, _), c in count.items():
        seen[h] += c
    n, v = seen[()], len(after[()])

    def p(h, w):
        if not h:
            return (count[(), w] + alpha) / (n + alpha * (v + 1))
        if not seen[h]:
            return p(h[1:], w)
        return max(count[h, w] - discount, 0) / seen[h] + discount * len(after[h]) / seen[h] * p(h[1:], w)

    out = []
    for i, ws in tokens:
        at = range(1, len(ws))
        base = sum(math.log10(p((), ws[e])) for e in at)
        out.append((i, len(at), sum(count[(), ws[e]] > 0 for e in at), base, sum(math.log10(p(tuple(ws[max(0, e - order + 1) : e]), ws[e])) for e in at)))
    return out


def _same(got, want):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=repr)
    want = sorted(want, key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)


def _rows():
    """Texts of few words, so that histories of every length recur; a third without id; repeats, blanks and one long text."""
    rng = random.Random(6)
    words = "a b c d e rain river stone The the unseen%d".split()
    text = lambda n: " ".join(rng.choices(words, range(len(words), 0, -1), k=n)).replace("%d", str(rng.randrange(9)))
    rows = [(i, text(rng.randrange(0, 40))) for i in range(60)] + [(None, text(12)) for _ in range(30)]
    rows += [(7, None), (8, ""), (9, " \n"), rows[3], rows[3], (11, text(5000)), (20, text(2100))]
    return rows


@pytest.mark.parametrize("order,block_bytes", [(1, 1 << 30), (2, 3000), (3, 1 << 30), (3, 2000), (4, 3000)])
def test_traversal_equals_the_recursion(spark, order, block_bytes):
    rows = _rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, train string").repartition(3)
    _same(lm.score(docs, block_bytes=block_bytes, order=order).collect(), _want(rows, order))


def test_lanes_change_nothing():
    """Cut anywhere, a text takes the same arcs: the tables of a closed set of n-grams, walked in lanes of several lengths."""
    rng = np.random.default_rng(3)
    sizes = np.array([2, 500, 3, 77, 1200])
    begin = np.cumsum(sizes) - sizes
    tokens = rng.integers(0, 4, sizes.sum())
    tokens[begin] = 9
    learned = {tuple(tokens[e - k : e + 1]) for s, m in zip(begin, sizes // 3) for e in range(s + 1, s + m) for k in range(4) if e - k >= s}
    has = np.zeros((4, len(tokens)), bool)
    for s, m in zip(begin, sizes):
        for e in range(s + 1, s + m):
            for k in range(min(3, e - s) + 1):
                has[k, e] = tuple(tokens[e - k : e + 1]) in learned
    arc, fail = rng.normal(size=has.shape), rng.normal(size=has.shape)
    whole = lm.traverse(begin, sizes, has, arc, fail, 1, lane=10_000)
    for lane in (1, 5, 64, 499):
        assert np.allclose(lm.traverse(begin, sizes, has, arc, fail, 1, lane=lane), whole)


def test_without_training_and_without_ids(spark):
    """No training text: every score is 0; ids need not be numbers."""
    got = lm.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id string, text string")).collect()
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [
        (True, 1, 0, 0, 0, 0), (True, 3, 0, 0, 0, 0)]


def test_higher_orders_tell_more_on_held_out_texts(spark):
    """Texts in which two words together decide the third, and one of them alone tells nothing."""
    rng = random.Random(1)

    def text():
        ws = [rng.randrange(12), rng.randrange(12)]
        while len(ws) < 60:
            ws.append((ws[-1] * 5 + ws[-2] * 7) % 12 if rng.random() < 0.9 else rng.randrange(12))
        return " ".join(f"w{x}" for x in ws)

    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    total = [sum(r["score"] for r in lm.score(docs, order=k).collect() if r["held_out"]) for k in (1, 2, 3)]
    assert total[2] > max(total[:2]) + 100


def test_a_block_lets_its_texts_go():
    """Only ids and numbers stay in memory beside the counts of n-grams."""
    table = pa.table({"doc_id": np.arange(50), "text": ["some words " * 500] * 50, "train": [True] * 50})
    held = vars(lm._Block(table, 3, 2)).values()
    assert sum(x.nbytes for x in held if isinstance(x, (pa.Table, pa.ChunkedArray))) < table["text"].nbytes / 10


def test_bundled_rows_come_back(spark):
    rows = [(None if i % 7 == 0 else i, None if i % 5 == 0 else f"text {i}", i % 3 == 0, i % 4) for i in range(200)]
    held = B.bundled(ready(spark.createDataFrame(rows, "doc_id long, text string, train boolean, block long")), 4)
    got = []
    for r in held.collect():
        got += [(*x.values(), r["block"]) for x in B.unbundled(pa.table({"rows": [bytes(r["rows"])]})).to_pylist()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_every_answer_is_made_once(spark):
    """Later passes read the exchange of an earlier answer instead of answering again."""
    docs = spark.createDataFrame([(i, f"a b {i % 7} c") for i in range(50)], "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lm.score(docs, block_bytes=200)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    steps = [re.search(r"FlatMap(CoGroups|Groups)InArrow", line) for line in plan.splitlines()]
    steps = [m.group(1) for m in steps if m]
    # Asked and answered at first; asked and answered for each further order, and the run.
    assert (steps.count("Groups"), steps.count("CoGroups")) == (2, 5)
