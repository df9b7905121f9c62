"""Reach equals a breadth-first search on chains, trees, cycles and graphs of any shape, in few rounds."""

import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fieldnote.operators import pairs as P


def bfs(edges, roots):
    onward = {}
    for a, b in edges:
        if a is not None and b is not None:
            onward.setdefault(a, set()).add(b)
    out = set()
    for r in roots:
        seen, queue = {r: 0}, deque([r])
        while queue:
            n = queue.popleft()
            for m in onward.get(n, ()):
                if m not in seen:
                    seen[m] = seen[n] + 1
                    queue.append(m)
        out |= {(r, n, d) for n, d in seen.items()}
    return out


def run(spark, edges, roots, **more):
    e = spark.createDataFrame(edges, "src long, dst long")
    r = spark.createDataFrame([(x,) for x in roots], "node long")
    got = [tuple(x) for x in P.reach(e, r, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("reverse", [False, True])
def test_a_chain_of_100000_nodes_in_under_20_rounds(spark, reverse):
    n, rounds = 100_000, []
    e = spark.range(1, n).selectExpr("id AS src", "id - 1 AS dst") if reverse else spark.range(1, n).selectExpr("id - 1 AS src", "id AS dst")
    e = e.union(spark.createDataFrame([(n + 5, n + 6), (n + 5, n + 7)], "src long, dst long"))  # not everywhere one way onward
    if reverse:
        e = e.filter(f"src < {n}")
    root = n - 1 if reverse else 0
    got = P.reach(e, spark.createDataFrame([(root,)], "node long"), rounds=rounds)
    row = got.selectExpr("count(*)", "max(depth)", "count(distinct node)", "sum(depth)").first()
    assert tuple(row) == (n, n - 1, n, n * (n - 1) // 2) and len(rounds) < 20


CASES = {
    "tree": ([(i // 2, i) for i in range(2, 60)], [1, 7]),
    "ancestors": ([(i, i // 2) for i in range(2, 60)], [59, 33, 1]),
    "cycle with its root": ([(1, 2), (2, 3), (3, 1), (3, 4)], [1]),
    "two roots on a cycle": ([(1, 2), (2, 3), (3, 4), (4, 1), (4, 9), (9, 10)], [1, 3]),
    "cycle of one way": ([(1, 2), (2, 3), (3, 1), (7, 1)], [7, 2]),
    "cycle without root": ([(1, 2), (2, 1), (1, 3), (5, 6), (5, 7)], [5]),
    "loops and repeats": ([(1, 1), (1, 2), (1, 2), (2, 2), (2, 3), (1, 3)], [1]),
    "nulls": ([(1, None), (None, 2), (1, 2)], [1]),
    "no edges": ([], [4]),
    "root without edges": ([(1, 2)], [9]),
    "shorter way later": ([(1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 5), (5, 7), (7, 8)], [1]),
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    edges, roots = CASES[name]
    assert run(spark, edges, roots) == bfs(edges, roots)


def test_no_roots(spark):
    assert run(spark, [(1, 2), (1, 3)], []) == set()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 25)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))]
    roots = rng.sample(range(n), rng.randrange(1, 4) if n > 3 else 1)
    assert run(spark, edges, roots) == bfs(edges, roots)
