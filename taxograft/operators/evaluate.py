"""Ranking, linking and multi-label metrics.

Candidates are ``(mention_id, rank, cand_id)`` with ranks from 1, gold is
``(mention_id, cand_id)``; edges are ids or structs.  Each metric row names its
denominator where several are in use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.functions.arrays import f1
from taxograft.operators.graph import within_hops
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import running_totals, top_k
from taxograft.plans.skew import balanced_join

KS = (1, 3, 5, 10, 20, 50, 100, 150, 200, 250, 300)
GUARD = 1e-10  # fixed value: added to the denominators of the label-wise rates


def ratio(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


#: Rows of candidates and gold that one task compares.
TASK_ROWS = 1 << 20


def gold_ranks(cands: DataFrame, gold: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every distinct gold item with the rank at which it was found, or null.

    With ``tasks``, both sides are dealt to so many tasks before they are grouped, which then hold their share only,
    however few partitions the candidates come in.
    """
    key = ["mention_id", "cand_id"]
    g, c = gold.select(*key), cands.select(*key, "rank")
    if tasks is not None:
        g, c = g.repartition(tasks, *key), c.repartition(tasks, *key)
    found = c.groupBy(*key).agg(F.min("rank").alias("rank"))
    return g.distinct().join(found, key, "left")


def gold_position(cands: DataFrame, gold: DataFrame, missing: int = -1) -> DataFrame:
    """0-based position of the best-ranked gold item per mention, ``missing`` if absent."""
    return gold_ranks(cands, gold).groupBy("mention_id").agg(
        F.coalesce(F.min("rank") - 1, F.lit(missing)).alias("position")
    )


def _long(df: DataFrame, ks: Sequence[int], keep: Sequence[str], name) -> DataFrame:
    """One row per cut-off from columns named ``name(k)``."""
    structs = [
        F.struct(F.lit(k).alias("k"), *[F.col(f"{c}_{k}").alias(c) for c in keep]) for k in ks
    ]
    return df.select(*name, F.explode(F.array(*structs)).alias("r")).select(*name, "r.*")


def precision_recall_at(
    cands: DataFrame, gold: DataFrame, ks: Sequence[int] = KS, ranks: DataFrame | None = None
) -> DataFrame:
    """Precision ``TP / (mentions * k)`` and recall ``TP / gold items`` at each cut-off.

    ``ranks`` are the :func:`gold_ranks`, where they are known already.
    """
    ranks = gold_ranks(cands, gold) if ranks is None else ranks
    n_mentions = gold.agg(F.count_distinct("mention_id").alias("n"))
    one = ranks.agg(
        F.count(F.lit(1)).alias("n_gold"), *[F.count_if(F.col("rank") <= k).alias(f"tp_{k}") for k in ks]
    ).withColumn("n_mentions", n_mentions.scalar())
    return _long(one, ks, ["tp"], ["n_mentions", "n_gold"]).select(
        "k", "n_mentions", "n_gold", "tp",
        ratio("tp", F.col("n_mentions") * F.col("k")).alias("precision"), ratio("tp", "n_gold").alias("recall"),
    )


def recall_any_all_at(
    cands: DataFrame, gold: DataFrame, ks: Sequence[int] = KS, by: DataFrame | None = None, ranks: DataFrame | None = None
) -> DataFrame:
    """Share of mentions with any / all gold items among the first ``k``.

    ``by(mention_id, slice)`` adds one group per slice next to the overall one (null); ``ranks`` are the
    :func:`gold_ranks`, where they are known already.
    """
    per = (gold_ranks(cands, gold) if ranks is None else ranks).groupBy("mention_id").agg(
        *[F.coalesce(F.bool_or(F.col("rank") <= k), F.lit(False)).alias(f"any_{k}") for k in ks],
        *[F.bool_and(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"all_{k}") for k in ks],
    )
    aggs = [F.count(F.lit(1)).alias("n_mentions")]
    for k in ks:
        aggs += [F.avg(F.col(f"{n}_{k}").cast("double")).alias(f"{n}_{k}") for n in ("any", "all")]
    if by is None:
        return _long(per.agg(*aggs), ks, ["any", "all"], ["n_mentions"])
    sliced = per.join(by.select("mention_id", "slice"), "mention_id")
    return _long(sliced.rollup("slice").agg(*aggs), ks, ["any", "all"], ["slice", "n_mentions"])


def _with_kind(gold: DataFrame, by: str) -> DataFrame:
    """Gold with ``is_leaf`` of the row itself, or of its mention (any of its rows is one)."""
    if by not in {"row", "mention"}:
        raise ValueError(by)
    if by == "row":
        return gold
    of_mention = gold.groupBy("mention_id").agg(F.bool_or("is_leaf").alias("is_leaf"))
    return gold.drop("is_leaf").join(of_mention, "mention_id")


def _all_and_sliced(df: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of each mention over all of its rows (``is_leaf`` null) and over those of a slice."""
    sets = [["mention_id"], ["mention_id", "is_leaf"]]
    return df.groupingSets([[F.col(c) for c in x] for x in sets], "mention_id", "is_leaf").agg(*aggs)


def rates_by_leaf(cands: DataFrame, gold: DataFrame, ks: Sequence[int] = KS, by: str = "row") -> DataFrame:
    """Precision, recall and any/all rates at each cut-off, for all, leaf and other gold.

    ``gold(mention_id, cand_id, is_leaf)``.  By ``row`` a slice asks for its own gold items only,
    so a mention with both kinds is in both slices; by ``mention`` a mention with any leaf item is
    in the leaf slice with all of its items.  ``is_leaf`` is null for the rates over everything.
    """
    key = ["mention_id", "cand_id"]
    kinds = _with_kind(gold.groupBy(*key).agg(F.coalesce(F.bool_or("is_leaf"), F.lit(False)).alias("is_leaf")), by)
    ranks = gold_ranks(cands, gold).join(kinds, key)
    within = [F.coalesce(F.col("rank") <= k, F.lit(False)) for k in ks]
    per = _all_and_sliced(ranks, [
        F.count(F.lit(1)).alias("n"), *[F.count_if(w).alias(f"tp_{k}") for k, w in zip(ks, within)]
    ])
    aggs = [F.count(F.lit(1)).alias("n_mentions"), F.sum("n").alias("n_gold")]
    for k in ks:
        tp = F.col(f"tp_{k}")
        aggs += [
            F.sum(tp).alias(f"tp_{k}"), F.avg((tp > 0).cast("double")).alias(f"any_{k}"),
            F.avg((tp == F.col("n")).cast("double")).alias(f"all_{k}"),
        ]
    rows = _long(per.groupBy("is_leaf").agg(*aggs), ks, ["tp", "any", "all"], ["is_leaf", "n_mentions", "n_gold"])
    return rows.select(
        "is_leaf", "k", "n_mentions", "n_gold", "tp", ratio("tp", F.col("n_mentions") * F.col("k")).alias("precision"),
        ratio("tp", "n_gold").alias("recall"), "any", "all",
    )


def leaf_mentions(gold: DataFrame, null: str = "NULL") -> DataFrame:
    """``(mention_id, is_leaf)``: whether any gold child of the mention is the null node."""
    return gold.groupBy("mention_id").agg(F.bool_or(F.col("child_idx") == null).alias("is_leaf"))


def similarity_by_leaf(ranked: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """:func:`similarity_at` for all, leaf and other rows of ``ranked(mention_id, rank, sim, is_leaf)``."""
    return _similarity(ranked, ks, ["is_leaf"])


def similarity_at(ranked: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Mean over mentions of the average, least and largest similarity among the first k.

    ``ranked(mention_id, rank, sim)``; rows without a similarity are left out, and so are
    mentions that have none left.
    """
    return _similarity(ranked, ks, [])


def _similarity(ranked: DataFrame, ks: Sequence[int], slices: list[str]) -> DataFrame:
    valid = ranked.where(F.col("sim").isNotNull() & (F.col("sim") >= 0))
    parts = []
    for k in ks:
        within = F.when(F.col("rank") <= k, F.col("sim"))
        parts += [F.avg(within).alias(f"avg_{k}"), F.min(within).alias(f"min_{k}"), F.max(within).alias(f"max_{k}")]
    per = _all_and_sliced(valid, parts) if slices else valid.groupBy("mention_id").agg(*parts)
    aggs = []
    for k in ks:
        aggs.append(F.count(f"avg_{k}").alias(f"n_evaluated_{k}"))
        aggs += [F.avg(f"{n}_{k}").alias(f"wp_{n}_{k}") for n in ("avg", "min", "max")]
    return _long(per.groupBy(*slices).agg(*aggs), ks, ["n_evaluated", "wp_avg", "wp_min", "wp_max"], slices)


def concept_recall(
    pool: DataFrame, gold: DataFrame, leaves: DataFrame | None = None, isa: DataFrame | None = None, hops: int = 0
) -> DataFrame:
    """Share of mentions whose pool of concepts has a gold parent, child, or both.

    ``pool(mention_id, id)`` and ``gold(mention_id, parent_idx, child_idx)``; both sides
    must come from the same gold edge.  ``leaves(mention_id, is_leaf)`` adds slices.

    With ``hops``, ancestors of a gold parent and descendants of a gold child within that many
    links of ``isa(child_id, parent_id)`` count too.  Both are found by going up, from the gold
    parents and from the pool, so the many children of a hub are never listed.
    """
    have = pool.select("mention_id", "id").distinct()
    g = gold.select("mention_id", "parent_idx", "child_idx").distinct()
    p = have.select("mention_id", F.col("id").alias("parent_idx"))
    c = have.select("mention_id", F.col("id").alias("child_idx"))
    if hops:
        if isa is None:
            raise ValueError("hops need the links")
        have, g = cut_lineage(have), cut_lineage(g)
        asked = g.select("mention_id", "parent_idx").distinct()
        above = within_hops(asked.select(F.col("parent_idx").alias("id")), isa, hops)
        accepted = balanced_join(asked.withColumnRenamed("parent_idx", "id"), above, "id")
        p = accepted.select("mention_id", F.col("id").alias("parent_idx"), F.col("anc").alias("id")).join(
            have, ["mention_id", "id"], "left_semi").select("mention_id", "parent_idx").distinct()
        c = balanced_join(have, within_hops(have.select("id"), isa, hops), "id").select(
            "mention_id", F.col("anc").alias("child_idx")).distinct()
    p, c = p.withColumn("_p", F.lit(True)), c.withColumn("_c", F.lit(True))
    hit = g.join(p, ["mention_id", "parent_idx"], "left").join(c, ["mention_id", "child_idx"], "left").fillna(False, ["_p", "_c"])
    per = hit.groupBy("mention_id").agg(
        F.bool_or("_p").alias("parent"), F.bool_or("_c").alias("child"), F.bool_or(F.col("_p") & F.col("_c")).alias("both")
    )
    rates = [F.count(F.lit(1)).alias("n_evaluated")] + [
        F.avg(F.col(x).cast("double")).alias(f"recall_{x}") for x in ("parent", "child", "both")
    ]
    if leaves is None:
        return per.agg(*rates)
    return per.join(leaves, "mention_id").rollup("is_leaf").agg(*rates)


def edge_recall(
    ranked: DataFrame, gold: DataFrame, n_mentions: DataFrame | None = None, null: str = "NULL",
    targets: DataFrame | None = None,
) -> DataFrame:
    """Any/all edge recall per leaf, non-leaf and all mentions.

    A mention is a leaf when any of its gold children is the null node.  The leaf slice asks
    for the leaf edges of such mentions only, the other slice for the (inner) edges of the
    others; the overall rates ask for every edge.  ``targets`` (gold widened by some hops)
    decides ``any``; ``all`` always needs the gold edges themselves.
    ``n_mentions``, a one-row table, counts the mentions before those without gold were
    skipped; the rates refer to it for the overall slice when given.
    """
    key = ["mention_id", "parent_idx", "child_idx"]
    seen = ranked.select(*key).distinct().withColumn("_hit", F.lit(True))
    exact = gold.select(*key).distinct().join(seen, key, "left").fillna(False, ["_hit"])
    leaf = F.col("child_idx") == null
    per = exact.groupBy("mention_id").agg(
        F.bool_or(leaf).alias("is_leaf"), F.bool_or("_hit").alias("any"), F.bool_and("_hit").alias("all"),
        F.bool_or(F.col("_hit") & leaf).alias("any_leaf"), F.bool_or(F.col("_hit") & ~leaf).alias("any_inner"),
        F.bool_and(F.col("_hit") | ~leaf).alias("all_leaf"),
    )
    if targets is not None:
        loose = targets.select(*key).distinct().join(seen, key, "left_semi").groupBy("mention_id").agg(
            F.bool_or(leaf).alias("_leaf"), F.bool_or(~leaf).alias("_inner")
        )
        no = F.lit(False)
        per = per.join(loose, "mention_id", "left").withColumns({
            "any": F.col("any") | F.col("_leaf").isNotNull(),
            "any_leaf": F.col("any_leaf") | F.coalesce("_leaf", no), "any_inner": F.col("any_inner") | F.coalesce("_inner", no),
        })
    hits = lambda c, n: F.sum(c.cast("int")).alias(n)
    pick = lambda c: F.when(F.col("is_leaf"), F.col(f"{c}_leaf"))
    count = F.count(F.lit(1)).alias("n_evaluated")
    by_kind = per.groupBy("is_leaf").agg(
        count, hits(pick("any").otherwise(F.col("any_inner")), "n_any"), hits(pick("all").otherwise(F.col("all")), "n_all")
    )
    whole = per.agg(count, hits(F.col("any"), "n_any"), hits(F.col("all"), "n_all"))
    out = by_kind.unionByName(whole.withColumn("is_leaf", F.lit(None).cast("boolean")))
    if n_mentions is None:
        total = F.col("n_evaluated")
    else:
        total = F.when(F.col("is_leaf").isNull(), n_mentions.scalar()).otherwise(F.col("n_evaluated"))
    return out.withColumn("denominator", total).withColumn("any", ratio("n_any", "denominator")).withColumn(
        "all", ratio("n_all", "denominator")
    )


def mean_rank(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean rank and mean reciprocal rank of each mention's first gold item found.

    Mentions without a hit count 0 in the reciprocal rank and are left out of the rank.
    """
    best = gold_ranks(cands, gold).groupBy("mention_id").agg(F.min("rank").alias("r"))
    return best.agg(
        F.count(F.lit(1)).alias("n_mentions"), F.count("r").alias("n_found"), F.avg("r").alias("mr"),
        F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr"),
    )


def mean_candidates(cands: DataFrame) -> DataFrame:
    sizes = cands.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.avg("n").alias("mean_candidates"), F.count(F.lit(1)).alias("n_mentions"))


def recall_curve(cands: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Share of mentions whose first gold item lies within the first i, for i = 1..k.

    The row for 1 is the accuracy.
    """
    best = gold_ranks(cands, gold).groupBy("mention_id").agg(F.min("rank").alias("r"))
    n = best.agg(F.count(F.lit(1)).alias("n"))
    hist = best.where(F.col("r") <= k).groupBy(F.col("r").alias("i")).agg(F.count(F.lit(1)).alias("h"))
    steps = cands.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("i"))
    # k rows: the histogram, not the mentions, is accumulated
    filled = steps.join(hist, "i", "left").select("i", F.coalesce("h", F.lit(0)).alias("h"))
    total = F.sum("h").over(_upto("i"))
    return filled.select("i", ratio(total, n.scalar()).alias("recall"))


def _upto(col: str):
    from pyspark.sql import Window as W

    return W.orderBy(col).rowsBetween(W.unboundedPreceding, 0)


def hits_at(cands: DataFrame, gold: DataFrame, ranks: Sequence[int] = (1, 4, 8, 16, 32, 64, 128, 256, 512)) -> DataFrame:
    """Number of mentions whose gold lies within each fixed rank."""
    best = gold_ranks(cands, gold).groupBy("mention_id").agg(F.min("rank").alias("r"))
    return best.agg(
        F.count(F.lit(1)).alias("n_mentions"), *[F.count_if(F.col("r") <= r).alias(f"hits_{r}") for r in ranks]
    )


def cumulative_recall(positions: DataFrame, max_rank: int | None = None) -> DataFrame:
    """Percentage of mentions found up to each occurring 0-based gold position."""
    n = positions.agg(F.count(F.lit(1)).alias("n"))
    found = positions.where(F.col("position") >= 0)
    if max_rank is not None:
        found = found.where(F.col("position") < max_rank)
    hist = found.groupBy("position").agg(F.count(F.lit(1)).alias("h"))
    # one row per occurring position, which the candidate list length bounds
    return hist.select("position", (100 * ratio(F.sum("h").over(_upto("position")), n.scalar())).alias("recall"))


def candidate_recall(mentions: DataFrame, max_rank: int | None = None) -> DataFrame:
    """Recall per dataset and overall (null) from ``(dataset, position)``, -1 = not found."""
    ok = F.col("position") >= 0
    if max_rank is not None:
        ok = ok & (F.col("position") < max_rank)
    return mentions.rollup("dataset").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.count_if(ok).alias("n_found"),
        F.avg(ok.cast("double")).alias("recall"),
    )


def accuracy(pred: DataFrame) -> DataFrame:
    """Accuracy over all, known and unseen mentions from ``(gold_id, pred_id, is_nil)``."""
    ok = (F.col("gold_id") == F.col("pred_id")).cast("double")
    return pred.agg(
        F.avg(F.coalesce(ok, F.lit(0.0))).alias("acc"),
        F.avg(F.when(~F.col("is_nil"), F.coalesce(ok, F.lit(0.0)))).alias("acc_known"),
        F.avg(F.when(F.col("is_nil"), F.coalesce(ok, F.lit(0.0)))).alias("acc_nil"),
        F.count_if("is_nil").alias("n_nil"),
    )


def ranking_accuracy(positions: DataFrame, n_samples: DataFrame, ks: Sequence[int] = (1, 2, 4, 8, 16, 32, 64)) -> DataFrame:
    """Accuracies over two denominators and recall@k of the gold's candidate position.

    ``positions(mention_id, position, correct)`` covers the evaluated samples whose gold
    was a candidate; ``n_samples`` (one row) counts all samples.
    """
    return positions.agg(
        F.count(F.lit(1)).alias("n_evaluated"), F.sum(F.col("correct").cast("int")).alias("n_correct"),
        *[F.count_if(F.col("position") < k).alias(f"_hits_{k}") for k in ks],
    ).withColumn("n_samples", n_samples.scalar()).select(
        "n_evaluated", "n_samples", ratio("n_correct", "n_evaluated").alias("normalised"),
        ratio("n_correct", "n_samples").alias("unnormalised"), ratio("n_evaluated", "n_samples").alias("candidate_recall"),
        *[ratio(f"_hits_{k}", "n_samples").alias(f"recall_{k}") for k in ks],
    )


def within_top_k(samples: DataFrame, k: int, col: str = "position") -> DataFrame:
    """Samples whose gold position lies in (0, k]."""
    return samples.where((F.col(col) > 0) & (F.col(col) <= k))


def linking_prf(pred: DataFrame, gold: DataFrame, nil: str = "NIL", detected: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 of ``(mention_id, entity)`` links; unseen predictions do not
    count.  With ``detected``, the mentions a detector found, precision refers to these without
    the unseen predictions; recall refers to all gold mentions either way."""
    made = pred.where(F.col("entity") != nil)
    right = made.join(gold.select("mention_id", "entity"), ["mention_id", "entity"], "left_semi")
    counts = right.agg(F.count(F.lit(1)).alias("n_correct")).withColumn(
        "n_pred", made.agg(F.count(F.lit(1)).alias("n")).scalar() if detected is None else
        detected.agg(F.count(F.lit(1)).alias("n")).scalar()
        - pred.where(F.col("entity") == nil).agg(F.count(F.lit(1)).alias("n")).scalar()
    ).withColumn("n_gold", gold.agg(F.count(F.lit(1)).alias("n")).scalar())
    rates = counts.withColumn("precision", ratio("n_correct", "n_pred")).withColumn("recall", ratio("n_correct", "n_gold"))
    return rates.withColumn("f1", f1("precision", "recall"))


def best_run(metrics: DataFrame, name: str) -> DataFrame:
    """The run ``(run, run_no, name, value)`` with the best value; the earlier one on ties."""
    return metrics.where(F.col("name") == name).groupBy("name").agg(
        F.max(F.struct("value", (-F.col("run_no")).alias("o"), "run")).alias("b")
    ).select("name", F.col("b.run").alias("run"), F.col("b.value").alias("value"))


def sort_runs(metrics: DataFrame, by: str = "recall") -> DataFrame:
    """Runs by a metric column, best first."""
    return metrics.orderBy(F.desc(by), F.asc("run"))


def metrics_frame(metrics: dict[str, DataFrame], dataset: str) -> DataFrame:
    """Stack one-row metric tables into ``(dataset, slice, name, value)`` rows."""
    out = None
    for slice_, df in metrics.items():
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns]
        part = df.select(
            F.lit(dataset).alias("dataset"), F.lit(slice_).alias("slice"), F.explode(F.array(*pairs)).alias("m")
        ).select("dataset", "slice", "m.*")
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ multi-label

def aggregate_labels(pairs: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mention-edge rows grouped into multi-label samples.

    ``pairs`` has the key, ``row_id``, ``position`` (-1 = gold not among the candidates),
    ``is_nil`` and ``gold_id``.  Returns the samples (id, completeness, last unseen flag,
    first row), the long tables of their distinct positions and of their rows and gold ids.
    """
    keyed = pairs.withColumn("sample_id", F.xxhash64(*key))
    samples = keyed.groupBy("sample_id", *key).agg(
        F.bool_and(F.col("position") != -1).alias("complete"),
        F.max_by("is_nil", "row_id").alias("is_nil"),
        F.min("row_id").alias("first_row"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    positions = keyed.where(F.col("position") != -1).select("sample_id", "position").distinct()
    return samples, positions, keyed.select("sample_id", "row_id", "gold_id").distinct()


def _counts(by: Sequence[str]) -> list[Column]:
    y, p = F.col("y") == 1, F.col("yhat") == 1
    return [
        F.count_if(y & p).alias("tp"), F.count_if(y | p).alias("union"), F.count_if(p).alias("pred"), F.count_if(y).alias("pos"),
    ]


def macro(ml: DataFrame) -> DataFrame:
    """Label-wise accuracy, precision, recall (averaged over labels) and their F1."""
    per = ml.groupBy("label").agg(*_counts(["label"]))
    rate = lambda d: F.avg(F.col("tp") / (F.col(d) + GUARD))
    out = per.agg(rate("union").alias("acc"), rate("pred").alias("prec"), rate("pos").alias("rec"))
    return out.withColumn("f1", ratio(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))


def micro(ml: DataFrame, group: Column | str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 over all decisions, optionally per label group."""
    base = ml.agg(*_counts([])) if group is None else ml.withColumn(
        "label_group", F.col(group) if isinstance(group, str) else group
    ).where("label_group IS NOT NULL").groupBy("label_group").agg(*_counts([]))
    out = base.withColumn("acc", ratio("tp", "union")).withColumn("prec", ratio("tp", "pred")).withColumn("rec", ratio("tp", "pos"))
    out = out.withColumn("f1", ratio(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))
    return out.drop("tp", "union", "pred", "pos")


def code_family(col: Column | str) -> Column:
    """Which of two code families a label code belongs to, by the place of its dot.

    Diagnosis codes have the dot after three characters, or after four behind an ``E``;
    procedure codes after two.  A code without a dot is a diagnosis if it ends where the dot
    would be.  Any other code belongs to neither: null.
    """
    c = F.col(col) if isinstance(col, str) else col
    dot = F.locate(".", c)
    before = F.when(dot > 0, dot - 1).otherwise(F.length(c))
    external = c.startswith("E") & (before == 4)
    return F.when((before == 3) | external, "diagnosis").when((dot > 0) & (before == 2), "procedure")


def instance_average(ml: DataFrame) -> DataFrame:
    """Precision and recall averaged over instances, and their F1; undefined rates are 0."""
    per = ml.groupBy("row_id").agg(*_counts(["row_id"]))
    out = per.agg(F.avg(ratio("tp", "pred")).alias("prec"), F.avg(ratio("tp", "pos")).alias("rec"))
    return out.withColumn("f1", ratio(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))


def at_k(ml: DataFrame, ks: Sequence[int] = (1, 5, 8, 15)) -> DataFrame:
    """Recall, precision and F1 at each cut-off, averaged over instances."""
    best = top_k(ml, "row_id", [F.desc("score"), F.asc("label")], max(ks))
    hits = best.groupBy("row_id").agg(
        *[F.count_if((F.col("rank") <= k) & (F.col("y") == 1)).alias(f"h_{k}") for k in ks],
        *[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks],
    )
    pos = ml.groupBy("row_id").agg(F.count_if(F.col("y") == 1).alias("pos"))
    joined = hits.join(pos, "row_id")
    aggs = []
    for k in ks:
        aggs += [F.avg(ratio(f"h_{k}", "pos")).alias(f"rec_{k}"), F.avg(ratio(f"h_{k}", f"n_{k}")).alias(f"prec_{k}")]
    long = _long(joined.agg(*aggs), ks, ["rec", "prec"], [])
    return long.withColumn("f1", ratio(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))


def insertion(ml: DataFrame) -> DataFrame:
    """Share of instances with any label predicted, and with exactly their labels predicted.

    ``all`` needs equal sets that are not empty.  ``complete`` is false when some gold label
    was not offered; such an instance cannot have all its labels predicted.
    """
    y, p = F.col("y") == 1, F.col("yhat") == 1
    per = ml.groupBy("row_id").agg(
        F.bool_or(y & p).alias("any"), (F.bool_and(y == p) & F.bool_or(y) & F.bool_and("complete")).alias("all")
    )
    return per.agg(
        F.avg(F.col("any").cast("double")).alias("any"), F.avg(F.col("all").cast("double")).alias("all"),
        F.count(F.lit(1)).alias("n_instances"),
    )


def insertion_at(ml: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Any / all insertion rates among the ``k`` best-scored labels; an instance without labels
    counts for neither."""
    best = top_k(ml, "row_id", [F.desc("score"), F.asc("label")], max(ks))
    hits = best.groupBy("row_id").agg(
        *[F.count_if((F.col("rank") <= k) & (F.col("y") == 1)).alias(f"h_{k}") for k in ks]
    )
    pos = ml.groupBy("row_id").agg(F.count_if(F.col("y") == 1).alias("pos"), F.bool_and("complete").alias("complete"))
    joined = hits.join(pos, "row_id")
    aggs = []
    for k in ks:
        aggs.append(F.avg((F.col(f"h_{k}") > 0).cast("double")).alias(f"any_{k}"))
        aggs.append(F.avg(((F.col(f"h_{k}") == F.col("pos")) & (F.col("pos") > 0) & F.col("complete")).cast("double")).alias(f"all_{k}"))
    return _long(joined.agg(*aggs), ks, ["any", "all"], [])


def auc(ml: DataFrame) -> DataFrame:
    """ROC AUC per label with both classes, their mean, and over all decisions.

    Rank-sum with ties at half: equal scores are merged first, then negatives below each
    score come from one running total over (label, score).  Returns ``(label, auc)`` plus
    the rows ``macro`` and ``micro``.
    """
    labelled = ml.select(F.col("label").cast("string").alias("label"), "y", "score")
    everything = labelled.withColumn("label", F.lit("micro"))
    merged = labelled.unionByName(everything).groupBy("label", "score").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")
    )
    run = running_totals(merged, ["label", "score"], upto=F.col("n"))
    totals = merged.groupBy("label").agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    # negatives counted before the label starts
    start = run.groupBy("label").agg(F.min(F.col("upto") - F.col("n")).alias("before"))
    wins = (
        run.join(start, "label")
        .groupBy("label")
        .agg(F.sum(F.col("p") * (F.col("upto") - F.col("before") - F.col("n") / 2)).alias("w"))
        .join(totals, "label").where("P > 0 AND N > 0")
        .select("label", (F.col("w") / (F.col("P") * F.col("N"))).alias("auc"))
    )
    wins = cut_lineage(wins)
    mean = wins.where("label <> 'micro'").agg(F.lit("macro").alias("label"), F.avg("auc").alias("auc"))
    return wins.unionByName(mean)


def in_batch_accuracy(scores: DataFrame, batch: DataFrame) -> DataFrame:
    """Accuracy of picking, per row of a batch, the first occurrence of its own candidate.

    ``batch(batch_id, idx, candidate)`` and ``scores(batch_id, row, idx, score)``; repeated
    candidates count once, at their first index.
    """
    first = batch.groupBy("batch_id", "candidate").agg(F.min("idx").alias("first"))
    target = batch.join(first, ["batch_id", "candidate"]).select(
        "batch_id", F.col("idx").alias("row"), F.col("first").alias("target")
    )
    distinct = scores.join(first.select("batch_id", F.col("first").alias("idx")), ["batch_id", "idx"], "left_semi")
    best = distinct.groupBy("batch_id", "row").agg(F.min(F.struct((-F.col("score")).alias("s"), "idx")).alias("b"))
    return target.join(best, ["batch_id", "row"], "left").agg(
        F.avg(F.coalesce((F.col("b.idx") == F.col("target")).cast("double"), F.lit(0.0))).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def pool_synonyms(
    cands: DataFrame, entities: DataFrame, how: str = "max", k: int = 10, factor: int | None = None
) -> DataFrame:
    """Synonym-row candidates merged into their concept, ranked and cut to ``k``.

    ``cands(mention_id, local_id, score)`` should hold more than ``k`` rows per mention;
    ``entities(local_id, canonical_id)`` names each row's concept.  With ``factor`` only the best
    ``k * factor`` rows of a mention are merged (equal scores by ascending row id).
    """
    if how not in {"max", "avg"}:
        raise ValueError(how)
    if factor is not None:
        cands = top_k(cands, "mention_id", [F.desc("score"), F.asc("local_id")], k * factor, "_row").drop("_row")
    fn = F.max if how == "max" else F.avg
    merged = cands.join(entities.select("local_id", "canonical_id"), "local_id").groupBy(
        "mention_id", F.col("canonical_id").alias("cand_id")
    ).agg(fn("score").alias("score"))
    return top_k(merged, "mention_id", [F.desc("score"), F.asc("cand_id")], k)


def name_match_features(cands: DataFrame, tolerance: int = 2) -> DataFrame:
    """How well a mention's name matches its candidates' names.

    ``cands(mention_id, mention_tokens, title_tokens, label_tokens)``.  Four kinds of match
    (exact title, contained in the label, title within ``tolerance`` differing tokens, at
    most ``tolerance`` mention tokens missing in the label) are counted per mention; all but
    the first are told apart into one and several.
    """
    from taxograft.functions.arrays import contains_run, diff_size

    m, t, l = F.col("mention_tokens"), F.col("title_tokens"), F.col("label_tokens")
    per = cands.groupBy("mention_id").agg(
        F.count_if(m == t).alias("e"),
        F.count_if(contains_run(m, l)).alias("c"),
        F.count_if(diff_size(m, t) <= tolerance).alias("f"),
        F.count_if(diff_size(m, l, both=False) <= tolerance).alias("a"),
    )
    return per.select(
        "mention_id", (F.col("e") > 0).alias("exact_title"),
        (F.col("c") == 1).alias("contained_one"), (F.col("c") > 1).alias("contained_many"),
        (F.col("f") == 1).alias("fuzzy_title_one"), (F.col("f") > 1).alias("fuzzy_title_many"),
        (F.col("a") == 1).alias("fuzzy_any_one"), (F.col("a") > 1).alias("fuzzy_any_many"),
    )


def pad_candidates(cands: DataFrame, k: int) -> DataFrame:
    """Exactly ``k`` rows per mention: real candidates (mask 1), then empty ones (mask 0)."""
    kept = cands.where(F.col("rank") <= k).select("mention_id", "rank", "cand_id", F.lit(1).alias("mask"))
    slots = kept.select("mention_id").distinct().select(
        "mention_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    )
    return slots.join(kept, ["mention_id", "rank"], "left").select(
        "mention_id", "rank", "cand_id", F.coalesce("mask", F.lit(0)).alias("mask")
    )
