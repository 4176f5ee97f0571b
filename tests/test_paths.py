"""Paths of complex concepts against brute force."""

import random

from taxograft.operators import graph as G


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def _paths(atomic, complex_):
    side = lambda rows, s: {(i, n) for i, x, n in rows if x == s}
    ap, ac, cp, cc = (side(r, s) for r in (atomic, complex_) for s in ("parents", "children"))
    meet = lambda a, i: {n for x, n in a if x == i and i is not None}
    out = {(i, "THING" if p is None else p, c) for i, c in cc for p in meet(ap, i) or {None}}
    out |= {(i, p, c) for i, p in cp for c in meet(ac, i) or {"NULL"}}
    return out | {(i, p, c) for i, p in cp for c in meet(cc, i)}


def test_complex_paths_equal_brute_force_without_a_shuffle_of_the_paths(spark):
    for seed in range(4):
        rng = random.Random(seed)
        ids = [None, "THING", "NULL", *"abcd"]
        rows = lambda n: [(rng.choice(ids), rng.choice(["parents", "children"]), rng.choice(ids)) for _ in range(n)]
        atomic, complex_ = rows(18), rows(12)
        schema = "id string, side string, neighbour string"
        found = G.complex_paths(spark.createDataFrame(atomic, schema), spark.createDataFrame(complex_, schema))
        assert _rows(found) == sorted(map(str, _paths(atomic, complex_)))
    shuffled = [x for x in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "hashpartitioning(id" in x and "parent" in x and "child" in x]
    assert len(shuffled) <= 1, shuffled  # of paths that belong to no id
