"""Deciding that a mention is not in the catalogue.

Candidates are ``(mention_id, rank, cand_id, score)`` with ranks from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.model import Sentinels

NIL = Sentinels().unseen


def softmax(cands: DataFrame, score: str = "score", out: str = "p", key: str = "mention_id") -> DataFrame:
    """Softmax of the scores of a mention, by pre-aggregated sums."""
    top = cands.groupBy(key).agg(F.max(score).alias("_m"))
    shifted = cands.join(top, key).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    total = shifted.groupBy(key).agg(F.sum("_e").alias("_z"))
    return shifted.join(total, key).withColumn(out, F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")


def nil_low_confidence(cands: DataFrame, theta: float, raw: bool = False, nil_id=NIL) -> DataFrame:
    """Put the unseen mark into each candidate list.

    First, moving the others back, when no candidate is more confident than ``theta``;
    otherwise in place of the last one.  ``raw`` compares the scores themselves.
    """
    scored = cands.withColumn("p", F.col("score")) if raw else softmax(cands)
    lists = scored.groupBy("mention_id").agg((F.max("p") <= theta).alias("_low"), F.max("rank").alias("_k"))
    wide = cands.join(lists, "mention_id")
    moved = wide.where(F.col("rank") < F.col("_k")).select(
        "mention_id", F.when(F.col("_low"), F.col("rank") + 1).otherwise(F.col("rank")).alias("rank"), "cand_id"
    )
    nil = lists.select(
        "mention_id", F.when(F.col("_low"), F.lit(1)).otherwise(F.col("_k")).alias("rank"), F.lit(nil_id).alias("cand_id")
    )
    return moved.unionByName(nil)


def nil_last(cands: DataFrame, k: int, nil_id=NIL) -> DataFrame:
    """Make the unseen mark the ``k``-th candidate where a list lacks it."""
    lists = cands.groupBy("mention_id").agg(F.bool_or(F.col("cand_id") == nil_id).alias("_has"))
    lacking = lists.where("NOT _has").select("mention_id")
    kept = cands.join(lists, "mention_id").where(F.col("_has") | (F.col("rank") < k)).select("mention_id", "rank", "cand_id")
    return kept.unionByName(lacking.select("mention_id", F.lit(k).alias("rank"), F.lit(nil_id).alias("cand_id")))


def best_candidate(cands: DataFrame) -> DataFrame:
    """Best candidate of each mention with its softmax probability."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "cand_id", "p"))
    return softmax(cands).groupBy("mention_id").agg(best.alias("b")).select("mention_id", "b.cand_id", "b.p")


def nil_decide(cands: DataFrame, theta: float, nil_id=NIL) -> DataFrame:
    """Final answer ``(mention_id, cand_id, is_nil)`` over re-scored candidate lists.

    The mention is unseen when the mark was ranked first, or scores best, or when no other
    candidate's softmax (without the mark) exceeds ``theta``.
    """
    is_nil = F.col("cand_id") == nil_id
    others = softmax(cands.where(~is_nil)).groupBy("mention_id").agg(F.max("p").alias("_p"))
    picked = cands.groupBy("mention_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "cand_id")).alias("b"),
        F.bool_or(is_nil & (F.col("rank") == 1)).alias("_first"),
    )
    decided = picked.join(others, "mention_id", "left").withColumn(
        "is_nil",
        F.col("_first") | (F.col("b.cand_id") == nil_id) | (F.coalesce("_p", F.lit(0.0)) <= theta),
    )
    return decided.select(
        "mention_id", F.when(F.col("is_nil"), F.lit(nil_id)).otherwise(F.col("b.cand_id")).alias("cand_id"), "is_nil"
    )


def nil_from_classifier(cands: DataFrame, flags: DataFrame, nil_id=NIL) -> DataFrame:
    """Final answer by a binary classifier ``flags(mention_id, logit_known, logit_nil)``.

    Its verdict only counts for lists that hold the unseen mark.
    """
    picked = cands.groupBy("mention_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "cand_id")).alias("b"),
        F.bool_or(F.col("cand_id") == nil_id).alias("_has"),
    )
    verdict = flags.select("mention_id", (F.col("logit_nil") > F.col("logit_known")).alias("_says"))
    decided = picked.join(verdict, "mention_id", "left").withColumn(
        "is_nil", F.col("_has") & F.coalesce("_says", F.lit(False))
    )
    return decided.select(
        "mention_id", F.when(F.col("is_nil"), F.lit(nil_id)).otherwise(F.col("b.cand_id")).alias("cand_id"), "is_nil"
    )


def pool_scores(cands: DataFrame) -> DataFrame:
    """Smallest, largest and mean score of each mention's candidates."""
    return cands.groupBy("mention_id").agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score")
    )
