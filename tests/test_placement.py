"""Placement with vectors, with a saved index, and over several batches."""

import pytest
from pyspark.sql import functions as F

from taxograft.model import Settings
from taxograft.operators import retrieve as R
from taxograft.plans.placement import TextIndex, place_mentions
from taxograft.streaming.placement import place_stream

CONCEPTS = [("a", "heart disease"), ("b", "acute heart disease"), ("c", "lung disease"), ("d", "acute lung disease"), ("e", "disease")]
ISA = [("a", "e"), ("c", "e"), ("b", "a"), ("d", "c")]
VECTORS = [("a", [1.0, 0.1]), ("b", [1.0, 0.0]), ("c", [0.1, 1.0]), ("d", [0.0, 1.0])]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(CONCEPTS, "id string, text string"), spark.createDataFrame(ISA, "child_id string, parent_id string"),
        spark.createDataFrame(VECTORS, "id string, vector array<double>"),
    )


def rows(df):
    return sorted((r["mention_id"], r["rank"], r["parent_idx"], r["child_idx"], round(r["score"], 6)) for r in df.collect())


def test_dense_and_mixed_placement(spark, tables):
    concepts, isa, vectors = tables
    m = spark.createDataFrame([(1, "lung trouble", [1.0, 0.0]), (2, "lung trouble", [0.0, 1.0])], "mention_id long, mention string, vector array<double>")
    dense = rows(place_mentions(m, concepts, isa, None, Settings(seeds=1, cap=5, seeds_by="dense", edges_by="dense"), vectors))
    assert dense[0][2:4] == ("a", "b") and {r[2:4] for r in dense if r[0] == 1} == {("a", "b"), ("b", "NULL")}
    assert {r[2:4] for r in dense if r[0] == 2} == {("c", "d"), ("d", "NULL")}  # equal texts, other vectors
    mixed = rows(place_mentions(m, concepts, isa, None, Settings(seeds=1, cap=5, edges_by="dense"), vectors))
    assert {r[2:4] for r in mixed if r[0] == 1} == {r[2:4] for r in mixed if r[0] == 2}  # seeds by text
    assert [r[4] for r in mixed if r[0] == 1] != [r[4] for r in mixed if r[0] == 2]  # scores by vector
    always = rows(place_mentions(m, concepts, isa, None, Settings(seeds=1, cap=5, edges_by="dense", leaf_value=9.0, leaf_always=True), vectors))
    assert all(r[4] == 9.0 for r in always if r[3] == "NULL")
    with pytest.raises(ValueError, match="vectors"):
        place_mentions(m, concepts, isa, None, Settings(edges_by="dense"))
    with pytest.raises(ValueError, match="idf or dense"):
        place_mentions(m, concepts, isa, None, Settings(edges_by="magic"))


def test_context_blends_vectors(spark, tables):
    concepts, isa, vectors = tables
    m = spark.createDataFrame([(1, "x", "y", [1.0, 0.0], [0.0, 1.0])], "mention_id long, mention string, context string, vector array<double>, context_vector array<double>")
    got = rows(place_mentions(m, concepts, isa, None, Settings(seeds=2, cap=9, seeds_by="dense", edges_by="dense"), vectors))
    edges = {r[2:4]: r[4] for r in got}
    assert ("a", "b") in edges and ("c", "d") in edges  # one seed of each text
    assert edges["a", "b"] == pytest.approx(edges["c", "d"])


def test_saved_index_gives_the_same(spark, tables, tmp_path):
    concepts, isa, _ = tables
    m = spark.createDataFrame([(1, "acute heart trouble"), (2, "lung")], "mention_id long, mention string")
    TextIndex.build(concepts).save(str(tmp_path / "index"))
    index = TextIndex.load(spark, str(tmp_path / "index"))
    assert rows(place_mentions(m, index, isa, None, Settings(seeds=2, cap=9))) == rows(place_mentions(m, concepts, isa, None, Settings(seeds=2, cap=9)))


def test_three_batches_index_the_concepts_once(spark, tables, tmp_path, monkeypatch):
    concepts, isa, _ = tables
    built = []
    build = R.build_postings
    monkeypatch.setattr(R, "build_postings", lambda *a, **k: built.append(1) or build(*a, **k))
    texts = ["acute heart trouble", "lung", "disease of the heart"]
    for i, text in enumerate(texts):
        spark.createDataFrame([(i, text)], "mention_id long, mention string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("mention_id long, mention string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = {}
    sink = lambda df, batch: seen.setdefault(batch, rows(df))
    settings = Settings(seeds=2, cap=9)
    query = place_stream(stream, concepts, isa, None, sink, settings).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == 3 and len(built) == 1
    whole = spark.createDataFrame(list(enumerate(texts)), "mention_id long, mention string").withColumn("mention", F.col("mention"))
    assert sorted(r for part in seen.values() for r in part) == rows(place_mentions(whole, concepts, isa, None, settings))
