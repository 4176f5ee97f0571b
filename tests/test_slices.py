"""Leaf slices and relaxed targets on examples worked out by hand."""

import pytest

from taxograft.operators import evaluate as E
from taxograft.operators import graph as G


def test_slices_by_row_and_by_mention(spark):
    gold = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False), (3, "d", True)], "mention_id int, cand_id string, is_leaf boolean")
    cands = spark.createDataFrame([(1, 1, "b"), (1, 2, "x"), (2, 2, "c"), (3, 1, "y")], "mention_id int, rank int, cand_id string")
    get = lambda by: {(r.is_leaf, r.k): (r.n_mentions, r.n_gold, r.tp, r["any"], r["all"]) for r in E.rates_by_leaf(cands, gold, (1, 2), by).collect()}
    assert get("row") == {
        (None, 1): (3, 4, 1, 1 / 3, 0.0), (None, 2): (3, 4, 2, 2 / 3, 1 / 3),
        (True, 1): (2, 2, 0, 0.0, 0.0), (True, 2): (2, 2, 0, 0.0, 0.0),
        (False, 1): (2, 2, 1, 0.5, 0.5), (False, 2): (2, 2, 2, 1.0, 1.0)}
    assert get("mention")[True, 1] == (2, 3, 1, 0.5, 0.0)
    with pytest.raises(ValueError):
        E.rates_by_leaf(cands, gold, by="edge")


def test_relaxed_concept_recall_equals_widened_gold(spark):
    isa = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "c"), ("f", "e"), ("c", "x")], "child_id string, parent_id string")
    gold = spark.createDataFrame([(1, "c", "e"), (1, "b", "NULL"), (2, "c", "d"), (3, "b", "c"), (4, "d", "NULL")], "mention_id int, parent_idx string, child_idx string")
    pool = spark.createDataFrame([(1, "a"), (1, "f"), (2, "x"), (3, "f"), (3, "d")], "mention_id int, id string")
    for hops in (0, 1, 2):
        plain = gold.toDF("mention_id", "parent", "child")
        wide = G.relax_targets(plain, isa, hops).toDF("mention_id", "parent_idx", "child_idx")
        assert E.concept_recall(pool, gold, isa=isa, hops=hops).first() == E.concept_recall(pool, wide).first()
    leaves = {r.is_leaf: r.n_evaluated for r in E.concept_recall(pool, gold, E.leaf_mentions(gold), isa, 1).collect()}
    assert leaves == {None: 4, True: 2, False: 2}
    with pytest.raises(ValueError):
        E.concept_recall(pool, gold, hops=1)
