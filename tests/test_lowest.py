"""Lowest common ancestors in lists against those in rows."""

import random

from taxograft.operators import graph as G


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_lists_equal_rows_and_common_ancestors_are_not_written(spark, monkeypatch):
    written, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    rng = random.Random(5)
    names = [None, *(f"N{i:02}" for i in range(16))]
    # links mostly upwards, a cycle that hangs on no root, a self link, nulls
    links = [(rng.choice(names[i:]), names[i]) for i in range(1, 13) for _ in range(3)] + [("N01", "N01"), ("X", "Y"), ("Y", "X"), ("N15", "X"), (None, "N03"), ("N04", None)]
    isa = spark.createDataFrame(links, "child_id string, parent_id string")
    pairs = spark.createDataFrame([(a, b) for a in [*names, "X", "?"] for b in names[::2]], "a string, b string")
    closure, depth = cut(G.ancestors(isa)), cut(G.depths(isa))
    written.clear()
    found = {}
    for most in (4_096, 5, 0):
        monkeypatch.setattr(G, "LISTED_ANCESTORS", most)
        found[most] = _rows(G.lowest_common_ancestor(pairs, closure, depth, isa))
        assert (most == 4_096) == ({"a", "b", "anc"} not in written)
    assert found[4_096] == found[5] == found[0] and len(found[0]) > 20
