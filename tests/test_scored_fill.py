"""Filling up with given scores: the best of a mention against all of them."""

import random

from taxograft.operators import enrich as N


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_best_scores_give_what_all_scores_give_and_the_others_are_not_joined(spark, monkeypatch):
    rng = random.Random(11)
    node = lambda: rng.choice([None, "NULL", *(f"N{i}" for i in range(9))])
    edges = [(node(), node()) for _ in range(60)]
    mentions = [None, 1, 2, 3, 4, 5, 6]
    cands = [(m, r, *rng.choice(edges), rng.choice([None, float(r)])) for m in mentions for r in range(1, 9)]
    known = [(m, *e, float(rng.randrange(6))) for m in mentions[:5] for e in set(edges)]
    strange = [(m, node(), node(), rng.choice([None, 4.0, 7.0])) for m in (2, 3, 5) for _ in range(30)]  # often not enriched, some twice
    schema = "mention_id long, parent_idx string, child_idx string, score double"
    c = spark.createDataFrame(cands, "mention_id long, rank int, parent_idx string, child_idx string, score double")
    e = spark.createDataFrame(edges, "parent_idx string, child_idx string")
    for scores, k in ((known, 12), (known + strange, 4), ([], 4)):
        given = spark.createDataFrame(scores, schema)
        whole = _rows(N.seed_enrich_fill(c, e, 3, k, scores=given, whole=True))
        assert _rows(N.seed_enrich_fill(c, e, 3, k, scores=given)) == whole and whole, k
    calls, fill = [], N.seed_enrich_fill
    monkeypatch.setattr(N, "seed_enrich_fill", lambda *a, **kw: calls.append(1) or fill(*a, **kw))
    # every enriched edge has a score: no mention is ranked with all of them
    every = N.enrich_edges(c.where("rank <= 3 AND mention_id < 4 AND parent_idx IS NOT NULL AND child_idx IS NOT NULL"), e).selectExpr("*", "1.0D AS score")
    some = c.where("mention_id < 4 AND parent_idx IS NOT NULL AND child_idx IS NOT NULL")
    assert _rows(N.seed_enrich_fill(some, e, 3, 2, scores=every)) == _rows(fill(some, e, 3, 2, scores=every, whole=True)) and len(calls) == 1
