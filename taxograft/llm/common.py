"""Session settings, lineage cuts and connected components shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage
from taxograft.session import tune

#: Rows of an Arrow batch: texts are long, so batches hold fewer rows than Spark's default.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings for text batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, comp)`` for each node with an
    edge, ``comp`` the smallest node reachable.

    Minimum labels are handed along the edges and every label then jumps to the label of its
    own node, so chains shrink by halves.  Each round aggregates before it shuffles and is
    checkpointed; a hub is an aggregated key, never a collected group.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = cut_lineage(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("comp")
    ))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy("u").agg(F.min("comp").alias("near"))
            .withColumnRenamed("u", "node")
        )
        met = labels.join(near, "node").select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        met = cut_lineage(met)
        jump = met.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = met.join(jump, "comp", "left").select(
            "node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")
        )
        new = cut_lineage(new)
        labels = new.select("node", "comp")
        if new.where("comp <> old").limit(1).count() == 0:
            return labels
