"""Edges of mentions that are put together where the packed edges are."""

import random

import pytest
from pyspark.sql import functions as F

from taxograft.operators import enrich as N
from tests.test_packed import _formed, _graph, _hopped, _rows, _seeds


@pytest.fixture
def small(spark, monkeypatch):
    """Tasks of few edges, batches of few rows."""
    monkeypatch.setattr(N, "TASK_EDGES", 20)
    monkeypatch.setattr(N, "CHUNK_EDGES", 5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def test_edges_are_formed_in_few_tasks_and_small_batches(spark, small):
    rng = random.Random(3)
    isa, seeds = _graph(rng, 14, 60), [(None if m is None else f"m{m}", r, c) for _ in range(6) for m, r, c in _seeds(rng)]
    found = N.form_edges(spark.createDataFrame(seeds, "mention_id string, rank int, id string"), spark.createDataFrame(isa, "child_id string, parent_id string"))
    assert _rows(found) == sorted(map(str, _formed(seeds, isa)))


def test_no_edges_are_sent_to_the_mentions(spark, small):
    isa = spark.createDataFrame([(f"c{i}", p) for i in range(40) for p in ("a", "b")], "child_id string, parent_id string")
    seeds = spark.createDataFrame([(i, 1, c) for i in range(30) for c in ("a", "b")], "mention_id long, rank int, id string")
    cands = spark.createDataFrame([(i, "a", f"c{i}") for i in range(30)], "mention_id long, parent_idx string, child_idx string")
    edges = isa.toDF("child_idx", "parent_idx").unionByName(spark.createDataFrame([("a", "x")], "child_idx string, parent_idx string"))
    for df in (N.form_edges(seeds, isa), N.enrich_hops(cands, edges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in plan.splitlines() if "Exchange" in x]
        assert "MapInArrow" in plan and not [x for x in shuffles if "hashpartitioning(mention_id" in x], plan


def test_asked_edges_come_with_their_parent(spark, small):
    rng = random.Random(8)
    edges = _graph(rng, 10, 50)
    cands = [(rng.choice([None, 1, 2, 3]), *e) for e in rng.sample(edges, 20)]
    asked = [(rng.choice([1, 2, 3, 4]), f"N{rng.randrange(10)}", f"N{rng.randrange(10)}") for _ in range(25)]
    schema = "mention_id long, parent_idx string, child_idx string"
    got = N._packed_hops(
        spark.createDataFrame(cands, schema), spark.createDataFrame(edges, "parent_idx string, child_idx string"), spark.createDataFrame(asked, schema))
    rows = lambda c: _rows(got.select("mention_id", "parent_idx", F.explode(c)))
    assert rows("children") == sorted(map(str, _hopped(cands, edges)))
    assert rows("asked") == sorted(map(str, set(asked)))
