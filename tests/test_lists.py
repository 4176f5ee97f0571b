"""Scores of pairs whose tokens are lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxograft.operators import retrieve as R


def test_pairs_carry_lists(spark):
    pairs = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), (None, "x"), ("a", None), ("a", "x"), ("c", "x")]
    terms = [("a", "t1", 2.0), ("a", "t2", -0.5), ("b", "t2", 1.0), ("b", "t3", 4.0), (None, "t1", 1.0)]
    postings = [("t1", "x", 1.0), ("t2", "x", 3.0), ("t3", "z", 0.25), ("t9", "y", 1.0), ("t1", None, 1.0)]
    df = R.score_pairs(
        spark.createDataFrame(pairs, "q string, id string"), spark.createDataFrame(terms, "q string, token string, w double"),
        spark.createDataFrame(postings, "token string, id string, pw double"))
    got = {(r.q, r.id): r.score for r in df.collect()}
    assert got == {("a", "x"): 0.5, ("a", "y"): 0.0, ("b", "x"): 3.0, ("b", "z"): 1.0, (None, "x"): 0.0, ("a", None): 0.0, ("c", "x"): 0.0}
    # tokens are lists before anything is joined
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "token" not in plan[: plan.rindex("Join")].replace("_tokens", "")


def test_repeated_ids_and_edges(spark):
    concepts = spark.createDataFrame([("p", "red fox"), ("p", "red dog"), ("c", "dog"), ("n", None)], "id string, text string")
    idf = {"red": np.log10(3), "fox": np.log10(3), "dog": np.log10(1.5)}
    pairs = spark.createDataFrame([("p", "c"), ("c", "p"), ("n", "p"), ("p", "p"), ("p", "c")], "a string, b string")
    got = {(r.a, r.b): r.sim for r in R.concept_idf_similarity(pairs, concepts).collect()}
    assert got == pytest.approx({
        ("p", "c"): idf["dog"], ("c", "p"): idf["dog"], ("n", "p"): 0.0, ("p", "p"): 2 * idf["red"] + idf["fox"] + idf["dog"]}, abs=1e-8)
    cands = spark.createDataFrame([(1, "p", "c", 7), (1, "p", "c", 8), (1, None, "c", 9), (2, "p", "x", 7), (None, "p", "c", 1)],
                                  "mention_id long, parent_idx string, child_idx string, extra long")
    mentions = spark.createDataFrame([(1, "red red dog"), (2, None)], "mention_id long, mention string")
    df = R.edge_idf_score(cands, mentions, concepts)
    assert df.columns == [*cands.columns, "score"]
    assert R.edge_idf_score(cands.withColumn("score", F.lit(9.0)), mentions, concepts).columns == df.columns
    full = 2 * idf["red"] + idf["dog"]
    got = sorted(((r.extra, r.mention_id or 0, r.score) for r in df.collect()))
    want = [(1, 0, 0.0), (7, 1, (full + idf["dog"]) / 2), (7, 2, 0.0), (8, 1, (full + idf["dog"]) / 2), (9, 1, idf["dog"] / 2)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-8)
