"""Derived inputs: Spark's own texts against the common ones, and how stored ones are kept."""

from pyspark.sql import functions as F

import taxograft.workload  # noqa: F401
from taxograft.workload.registry import INPUTS, SPARK_INPUTS, Inputs


def _rows(df):
    return sorted(map(str, df.collect()))


def test_spark_text_keeps_not_in(spark):
    links = [[("N1", "R1"), ("S1", "N1")], [("N1", "R1"), (None, "N1")], [("N1", None), ("S1", "N1")], []]
    spark.createDataFrame([("R1", "r"), ("N1", "n"), ("S1", "s"), ("X", "x"), ("X", "y"), (None, "z")], "id string, title string").createOrReplaceTempView("concept")
    for rows in links:
        spark.createDataFrame(rows, "child_id string, parent_id string").createOrReplaceTempView("isa")
        assert _rows(spark.sql(SPARK_INPUTS["closed"])) == _rows(spark.sql(INPUTS["closed"])), rows


def test_closing_the_links_sends_no_table_to_all_tasks(spark):
    spark.createDataFrame([("R1", "r")], "id string, title string").createOrReplaceTempView("concept")
    spark.createDataFrame([("N1", "R1")], "child_id string, parent_id string").createOrReplaceTempView("isa")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.sql(SPARK_INPUTS.get("closed", INPUTS["closed"]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan


def test_stored_inputs_are_read_from_files(spark, folder):
    inputs = Inputs(spark, folder)
    edge = inputs.edge
    assert edge.inputFiles() and edge.columns == ["parent_idx", "child_idx", "parent", "child", "degree"]
    # and are not derived again by what is built from them
    plan = inputs.known_edge._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    assert inputs.edge.where(F.col("degree").isNull()).isEmpty()


def test_shared_inner_id_is_looked_up_once(spark, monkeypatch):
    from taxograft.operators import graph as G

    written, cut = [], G.cut_lineage

    def watched(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(G, "cut_lineage", watched)
    rows = [("S", f"[EX.](<R> <P{i}>)") for i in range(50)] + [("S", "[EX.](<GONE> <P1>)"), ("S", "[EX.](<GONE> <P2>)"), ("T", "P1"), (None, None)]
    universe = spark.createDataFrame([("R",), (None,), *((f"P{i}",) for i in range(50))], "id string")
    out = G.known_complex(spark.createDataFrame(rows, "id string, neighbour string"), universe)
    assert {(r.id, r.neighbour) for r in out.collect()} == {r for r in rows if "GONE" not in (r[1] or "")}
    assert [r.id for r in written[0].collect()] == ["GONE"]


def test_expanded_pairs_are_not_sorted_to_be_summed_up(spark, folder):
    from taxograft.workload import QUERIES

    plan = QUERIES["expand_to_pairs"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_concept_vectors_are_no_nested_loop(spark):
    spark.createDataFrame([("P8", "p"), ("P8", "q"), ("S4", "s"), ("N1", "n"), (None, "z")], "id string, title string").createOrReplaceTempView("concept")
    vectors = [(1, [0.5]), (1, [0.25]), (None, [1.0]), (9, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").createOrReplaceTempView("embeddings")
    text = SPARK_INPUTS.get("concept_vector", INPUTS["concept_vector"])
    assert _rows(spark.sql(text)) == _rows(spark.sql(INPUTS["concept_vector"])) and spark.sql(text).count() == 6
    assert "NestedLoop" not in spark.sql(text)._jdf.queryExecution().executedPlan().toString()
