"""Flags of mentions meet their leaf edges only."""

import random

from pyspark.sql import functions as F

from taxograft.operators import enrich as N


def test_other_edges_are_not_joined_and_rows_are_the_same(spark):
    rng = random.Random(4)
    isa = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c"), ("e", None)], "child_id string, parent_id string")
    mentions, nodes = [None, 1, 2, 3, 4, 5], [None, "NULL", "a", "b", "c"]
    rows = [(rng.choice(mentions), rng.choice(nodes), rng.choice(nodes), float(i)) for i in range(80)]
    cands = spark.createDataFrame(rows, "mention_id long, parent_idx string, child_idx string, score double")
    top = [(1, 1, "a"), (2, 1, "b"), (3, 1, None), (None, 1, "a"), (None, 1, "b"), (4, 2, "a")]
    leaf = {1: False, 2: True, 3: True}
    score = lambda m, c, x: x if c != "NULL" else 9.0 if leaf.get(m) else -9.0
    for more in ([], [(1, 1, "b")]):  # a second top seed repeats the edges of its mention
        seeds = spark.createDataFrame(top + more, "mention_id long, rank int, id string")
        got = N.assume_leaf(cands, seeds, isa, 9)
        want = [(m, p, c, score(m, c, x)) for m, p, c, x in rows]
        if more:
            want += [(m, p, c, 9.0 if c == "NULL" else x) for m, p, c, x in rows if m == 1]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        joined = [x for x in plan.splitlines() if "Filter" in x and "= NULL" in x]
        assert bool(joined) == (not more), plan
    assert N.assume_leaf(cands, seeds.where(F.lit(False)), isa, 9).count() == len(rows)
