"""Prompt rows: marking candidates, grouping, answers and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.functions.text import tokenize
from taxograft.plans.skew import balanced_join


def match_marks(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """Mark each candidate edge: parent right, child right, both right as one gold edge.

    Both inputs hold ``(mention_id, parent_idx, child_idx)``.
    """
    g = gold.select("mention_id", "parent_idx", "child_idx").distinct()
    gp = g.select("mention_id", "parent_idx").distinct().withColumn("parent_ok", F.lit(True))
    gc = g.select("mention_id", "child_idx").distinct().withColumn("child_ok", F.lit(True))
    gb = g.withColumn("both_ok", F.lit(True))
    out = cands.join(gp, ["mention_id", "parent_idx"], "left").join(gc, ["mention_id", "child_idx"], "left")
    return out.join(gb, ["mention_id", "parent_idx", "child_idx"], "left").fillna(
        False, ["parent_ok", "child_ok", "both_ok"]
    )


def group_prompts(prompts: DataFrame, answer: str = "bool") -> tuple[DataFrame, DataFrame]:
    """One row per distinct prompt, and the long table of the rows behind each prompt.

    ``answer="bool"`` ORs the ``answer`` column; ``"list"`` gathers the distinct option
    numbers, whose count the options of the prompt bound.  A prompt may stand for any
    number of rows, so those stay one per line under ``prompt_id``.
    """
    keyed = prompts.withColumn("prompt_id", F.xxhash64("prompt"))
    key = ["prompt_id", "prompt"]
    if answer == "bool":
        merged = F.bool_or("answer")
    else:
        merged = F.array_sort(F.collect_set("answer"))
    grouped = keyed.groupBy(*key).agg(merged.alias("answer"), F.count(F.lit(1)).alias("n_rows"))
    return grouped, keyed.select("prompt_id", "row_id")


def prompt_length(prompts: DataFrame, tokenizer=None) -> DataFrame:
    """Shortest and longest prompt in tokens."""
    n = F.size(tokenize("prompt", tokenizer))
    return prompts.agg(F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"))


def reuse_answers(prompts: DataFrame, archive: DataFrame) -> DataFrame:
    """Prompts with the archived answer to the identical text, null where there is none.

    The join runs on a hash of the text and on the text itself.
    """
    one = (
        archive.groupBy("prompt").agg(F.min("generated").alias("generated"))
        .withColumn("_h", F.xxhash64("prompt"))
    )
    asked = prompts.withColumn("_h", F.xxhash64("prompt"))
    return balanced_join(asked, one, ["_h", "prompt"], "left", fanout=False).drop("_h")


def open_prompts(prompts: DataFrame, archive: DataFrame) -> DataFrame:
    """Prompts nobody has answered yet."""
    return prompts.join(archive.select("prompt").distinct(), "prompt", "left_anti")


def report(mentions: DataFrame, cands: DataFrame) -> DataFrame:
    """Readable lines ``(mention_id, line_no, line)``: the record, then its candidates.

    ``mentions`` has ``(mention_id, record)``; ``cands`` has the edge text, rank, score and
    marks of :func:`match_marks`.  Write it sorted by ``(mention_id, line_no)``.
    """
    mark = F.concat(
        F.when(F.col("both_ok"), "(**p) (**c)").otherwise(
            F.concat_ws(" ", F.when(F.col("parent_ok"), "(*p)"), F.when(F.col("child_ok"), "(*c)"))
        )
    )
    head = mentions.select("mention_id", F.lit(0).alias("line_no"), F.col("record").alias("line"))
    body = cands.select(
        "mention_id", F.col("rank").cast("int").alias("line_no"),
        F.rtrim(F.format_string("%d %s %.4f %s", F.col("rank").cast("int"), "edge_text", F.col("score"), mark)).alias("line"),
    )
    return head.unionByName(body)


def answer_metrics(answers: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Any/all rates of answers at several cut-offs and over the whole list.

    ``answers`` has ``pred`` (ordered option numbers) and ``gold`` arrays, one row per
    asked mention; ``n_mentions`` is the denominator of every rate.  Rows with a null
    ``pred`` (not answered) stay in it, and so do rows whose gold is ``-1`` or empty, which no
    answer hits.  ``mean_answers`` is taken over the answered rows with another gold only.
    """
    pred = F.coalesce(F.col("pred"), F.array().cast("array<string>"))
    gold = F.col("gold")
    usable = (F.size(gold) > 0) & ~gold.eqNullSafe(F.array(F.lit("-1")))
    usable = F.coalesce(usable, F.lit(False))
    cols = []
    for k in (*ks, None):
        cut = pred if k is None else F.slice(pred, 1, k)
        name = "full" if k is None else str(k)
        cols.append(F.avg((usable & F.coalesce(F.arrays_overlap(cut, gold), F.lit(False))).cast("double")).alias(f"any_{name}"))
        cols.append(F.avg((usable & (F.size(F.array_except(gold, cut)) == 0)).cast("double")).alias(f"all_{name}"))
    return answers.agg(
        F.count(F.lit(1)).alias("n_mentions"), F.avg(F.when(usable & (F.size(pred) > 0), F.size(pred))).alias("mean_answers"), *cols
    )
