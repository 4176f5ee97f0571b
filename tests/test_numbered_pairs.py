"""Complex ids are joined by the number of their pair."""

from pyspark.sql import functions as F

from taxograft.operators import graph as G


def test_long_ids_are_not_shuffled_with_their_parts(spark):
    isa = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b")], "child_id string, parent_id string")
    role = spark.createDataFrame([("r",)], "id string")
    one, two = "[EX.](<r> <d>)", "[AND](<b> [EX.](<r> <c>) <b>)"  # b stands twice
    rows = [(one, two), ("d", "c"), (one, "d"), (two, one), (one, two), ("d", None), ("?", "d")]
    pairs = spark.createDataFrame(rows, "a string, b string")
    found = G.wu_palmer_complex(pairs, G.ancestors(isa), G.depths(isa), isa, role)
    got = {(r["a"], r["b"]): round(r["wp"], 6) for r in found.where(~F.col("null_a") & ~F.col("null_b")).collect()}
    db, dc = 2 * 3 / (4 + 3), 2 * 2 / (4 + 3)  # depths: a 1, b and c 2, d 3
    mixed = round((1 + (2 * db + dc) / 3) / 2, 6)  # the same operator and property on both sides
    assert got == {(one, two): mixed, (two, one): mixed, ("d", "c"): round((1 + dc) / 2, 6), (one, "d"): 0.5}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_no" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "null_a" in x and "part" in x.split("hashpartitioning(")[-1].split(")")[0]], plan
