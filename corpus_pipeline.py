"""The corpus pipeline: toxicity, exact and near duplicates, benchmark leaks, source mixing.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of ``documents``.
Rows are told apart by doc_id and the hash of their text, so null and repeated ids are no
obstacle; of repeated rows that are equal in both, exact_dedup keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.llm import decontaminate, exact_dup, mixing, near_dup, toxicity
from taxograft.llm.common import prepare, table
from taxograft.plans.lineage import cut_lineage, ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


KEY = ["_id", "_none", "_mark"]
#: Bytes of rejected keys up to which they are sent to the texts; beyond it, texts and keys meet in
#: a shuffled join.
SENT_BYTES = 16 << 20
KEY_BYTES = 32


def _keyed(rows: DataFrame, mark: Column) -> DataFrame:
    return rows.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull(), "_mark": mark})


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not in ``rejected(doc_id, mark)``; few keys leave the texts in place."""
    gone = cut_lineage(_keyed(rejected, F.col("mark")).select(*KEY).distinct())
    if gone.count() * KEY_BYTES <= SENT_BYTES:
        gone = F.broadcast(gone)
    return _keyed(docs, F.xxhash64("text")).join(gone, KEY, "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return without(docs, found.where("rejected"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    kept = _keyed(exact_dup.exact_duplicates(docs).where("kept"), F.col("mark")).select(*KEY)
    same = _keyed(docs.select(*COLUMNS), F.xxhash64("text")).join(kept, KEY, "left_semi")
    return same.dropDuplicates(KEY).select(*COLUMNS)  # on the keys of the join: no further shuffle


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component stays, of several
    texts with this id the one with the smallest hash."""
    found = cut_lineage(near_dup.near_duplicates(docs).select("doc_id", "mark", "kept", "comp"))
    kept = found.where("kept AND comp IS NOT NULL")
    several = kept.groupBy("comp").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last")
    further = kept.join(several, "comp").where("mark <> first")
    return without(docs, found.where("NOT kept").select("doc_id", "mark").union(further.select("doc_id", "mark")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document gets its place in the mix."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Neither trained stages nor MinHash links are SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written beside the shared checkpoints and read again; what
    a stage wrote is removed when the next one has been written, so the result alone is left."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    last = None
    for number, (name, stage) in enumerate(STAGES):
        out = f"{top}/{number}_{name}"
        stage(prepare(spark), docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if last:
            remove(spark, last)
        last = out
    return docs
