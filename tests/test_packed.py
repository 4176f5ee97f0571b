"""Edges in packed rows against brute force."""

import random

from pyspark.sql import functions as F

from taxograft.operators import enrich as N


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def _graph(rng, n=14, links=40):
    name = lambda: rng.choice([None, *(f"N{i}" for i in range(n))])
    return [(name(), name()) for _ in range(links)]


def _formed(seeds, isa):
    out = set()
    for m, c in {(m, c) for m, _, c in seeds if c is not None and "[" not in c}:
        up = {p for x, p in isa if x == c}
        down = {x for x, p in isa if p == c}
        out |= {(m, c, "NULL"), *((m, p, c) for p in up), *((m, c, x) for x in down), *((m, p, x) for p in up for x in down)}
    return out


def _hopped(cands, edges):
    own = {(m, p, c) for m, p, c in cands}
    known = {e for e in edges if None not in e}
    out = set(own)
    for m, p, c in own:
        up = {a for a, b in edges if b == p and b is not None} | {p}
        down = {b for a, b in edges if a == c and a is not None} | {c}
        out |= {(m, a, b) for a in up for b in down if (a, b) != (p, c) and (a, b) in known}
    return out


def _seeds(rng):
    ids = [None, "[EX.](<N1>)", *(f"N{i}" for i in range(14))]
    return [(rng.choice([None, 1, 2, 3, 4]), r, rng.choice(ids)) for r in range(1, 13)]


def test_formed_edges_equal_brute_force_in_any_packing(spark, monkeypatch):
    for seed, (task, pack) in enumerate([(1 << 21, 1 << 12), (4, 2), (1, 1)]):
        rng = random.Random(seed)
        isa, seeds = _graph(rng), _seeds(rng)
        monkeypatch.setattr(N, "TASK_EDGES", task)
        monkeypatch.setattr(N, "PACK_EDGES", pack)
        found = N.form_edges(
            spark.createDataFrame(seeds, "mention_id long, rank int, id string"), spark.createDataFrame(isa, "child_id string, parent_id string"))
        assert _rows(found) == sorted(map(str, _formed(seeds, isa))), (task, pack)


def test_hops_equal_brute_force_in_any_packing(spark, monkeypatch):
    for seed, (task, pack) in enumerate([(1 << 21, 1 << 12), (4, 2)]):
        rng = random.Random(seed)
        edges = _graph(rng)
        cands = [(rng.choice([None, 1, 2]), *e) for e in rng.sample(edges, 8)]
        monkeypatch.setattr(N, "TASK_EDGES", task)
        monkeypatch.setattr(N, "PACK_EDGES", pack)
        found = N.enrich_hops(
            spark.createDataFrame(cands, "mention_id long, parent_idx string, child_idx string"),
            spark.createDataFrame(edges, "parent_idx string, child_idx string"))
        assert _rows(found) == sorted(map(str, _hopped(cands, edges))), (task, pack)


def test_single_edges_are_not_shuffled(spark):
    isa = spark.createDataFrame([("a", "b"), ("b", "c")], "child_id string, parent_id string")
    seeds = spark.createDataFrame([(1, 1, "b")], "mention_id long, rank int, id string")
    digest = N.form_edges(seeds, isa).groupBy("mention_id").agg(F.count(F.lit(1)))
    cands = spark.createDataFrame([(1, "c", "b")], "mention_id long, parent_idx string, child_idx string")
    hops = N.enrich_hops(cands, isa.toDF("child_idx", "parent_idx"))
    for df in (digest, hops):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "mention_id" in x and "child_idx" in x], plan
        assert "Exchange" not in plan[: plan.index("Generate explode(children")], plan
