"""Exact duplicates by merging sorted digest runs in a tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage

#: Characters that do not count: fixed values of the contract, 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_duplicates(docs: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row ``(doc_id, keep_id, group_size, kept, text_sha256, mark)`` for each row of ``docs``.

    Texts are equal when they are identical without blanks.  Of equal texts the row with most
    code points stays, then the one with the smallest doc_id (a null id comes last), then the
    first row read.  ``kept`` is true for exactly one row of a group; ``mark`` is the hash of the
    original text, by which rows that share an id are told apart.

    Every input partition is a run; ``runs`` of them exist.  In each round up to ``fan_in``
    neighbouring runs are merged: equal digests meet, sizes add up and the better row survives,
    until one run is left.  Spark combines inside each task and then merges key-sorted blocks,
    so a group of copies, however large, arrives as one row from each task.  A digest is
    verified by the normalised length and a second hash, which are part of the key.
    """
    clean = normalised(F.col("text"))
    rows = cut_lineage(
        docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", "mark", F.length("text").alias("size"), clean.alias("clean"))
        .select(
            "doc_id", "mark", "size",
            F.unhex(F.sha2("clean", 256)).alias("digest"),
            F.xxhash64("clean").alias("check"), F.length("clean").alias("length"),
        )
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
    )
    key = ["digest", "check", "length"]
    best = F.struct(
        (-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"
    )
    level = rows.select(*key, "run", best.alias("best"), F.lit(1).cast("long").alias("n"))
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy(*key, "run").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
    winners = level.select(
        *key, F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), F.col("n").alias("group_size")
    )
    return rows.join(winners, key).select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "mark",
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
