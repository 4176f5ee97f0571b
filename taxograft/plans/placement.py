"""The training-free placement of mentions: search, edges, scores, enrichment, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograft.functions.arrays import blend
from taxograft.model import Settings
from taxograft.operators import enrich, evaluate, retrieve
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.skew import balanced_join


@dataclass(frozen=True)
class TextIndex:
    """What the searches by text need of the concepts; built once, used for any mentions."""

    postings: DataFrame
    total: DataFrame

    @staticmethod
    def build(concepts: DataFrame) -> TextIndex:
        return TextIndex(cut_lineage(retrieve.build_postings(concepts)), cut_lineage(retrieve.concept_count(concepts)))

    def save(self, path: str) -> None:
        """Write the index as tables under ``path``, postings sorted by token for later look-ups."""
        self.postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
        self.total.write.mode("overwrite").parquet(f"{path}/total")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/total"))


def place_mentions(
    mentions: DataFrame,
    concepts: DataFrame | TextIndex,
    isa: DataFrame,
    edges: DataFrame | None = None,
    settings: Settings | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Ranked edges ``(mention_id, rank, parent_idx, child_idx, score)`` of every mention.

    ``mentions(mention_id, mention)`` with an optional ``context`` query text, and
    ``concepts(id, text)``, or the index built from them.  Equal mentions are searched once.
    With a context, seeds come from both texts and edge scores are blended.

    Where the settings say ``dense``, the columns ``vector`` (and ``context_vector``) of the mentions are
    compared with ``vectors(id, vector)`` of the concepts instead of the texts; seeds and edge
    scores may be of different kinds.  Concepts without a vector score 0 there.
    """
    settings = settings or Settings()
    names = settings.names
    kinds = {settings.seeds_by, settings.edges_by}
    if not kinds <= {"idf", "dense"}:
        raise ValueError(f"searches are by idf or dense, not {sorted(kinds)}")
    if "dense" in kinds and vectors is None:
        raise ValueError("a dense search needs the vectors of the concepts")
    texts = ["mention", "context"] if "context" in mentions.columns else ["mention"]
    dense = [c for c in ("vector", "context_vector")[: len(texts)] if "dense" in kinds]
    key = F.xxhash64(*texts, *dense).alias("q")
    asked = cut_lineage(mentions.select(key, *texts, *dense).dropDuplicates(["q"]))
    vector_of = dict(zip(texts, dense, strict=False))
    by_text = {}
    if "idf" in kinds:
        index = concepts if isinstance(concepts, TextIndex) else TextIndex.build(concepts)
        weighted = index.postings.withColumn("pw", F.lit(1.0))
        by_text = {
            c: cut_lineage(retrieve.idf_terms(
                retrieve.query_terms(asked.select("q", F.col(c).alias("text"))), index.postings, index.total
            )) for c in texts
        }

    def seeds_of(c: str) -> DataFrame:
        if settings.seeds_by == "dense":
            found = retrieve.nearest_concepts(asked.select("q", F.col(vector_of[c]).alias("vector")), vectors, settings.seeds)
        else:
            found = retrieve.sparse_top_k(by_text[c], weighted, settings.seeds)
        return found.select(F.col("q").alias("mention_id"), "rank", "id")

    def similar(nodes: DataFrame, c: str) -> DataFrame:
        if settings.edges_by == "dense":
            return retrieve.node_cosines(
                nodes.select(F.col("q").alias("mention_id"), "id"), vectors,
                asked.select(F.col("q").alias("mention_id"), F.col(vector_of[c]).alias("vector")),
            ).select(F.col("mention_id").alias("q"), "id", F.col("sim").alias("score"))
        return retrieve.score_pairs(nodes, by_text[c], weighted)

    if len(texts) > 1:
        seeds = enrich.union_with_quota(
            seeds_of("mention"), seeds_of("context"), settings.seeds, 1 - settings.alpha
        ).select("mention_id", F.col("pos").alias("rank"), "id")
    else:
        seeds = seeds_of("mention")
    seeds = cut_lineage(seeds)
    formed = cut_lineage(enrich.form_edges(seeds, isa, names))
    if edges is not None and settings.enrich:
        pair = ["parent_idx", "child_idx"]
        catalogued = formed.join(edges.select(*pair), pair, "left_semi")
        more = enrich.enrich_edges(catalogued, edges, names).where(F.col("parent_idx") != names.top)
        formed = cut_lineage(formed.unionByName(more).distinct())
    nodes = cut_lineage(
        formed.select(F.col("mention_id").alias("q"), F.col("parent_idx").alias("id"))
        .unionByName(formed.select(F.col("mention_id").alias("q"), F.col("child_idx").alias("id"))).distinct()
    )
    sims = similar(nodes, "mention")
    if len(texts) > 1:
        # a node known to one of the two searches only scores 0 in the other
        ctx = similar(nodes, "context").withColumnRenamed("score", "ctx")
        both = nodes.join(sims, ["q", "id"], "left").join(ctx, ["q", "id"], "left").fillna(0.0, ["score", "ctx"])
        sims = both.select("q", "id", blend("ctx", "score", settings.alpha).alias("score"))
    scored = retrieve.edge_scores(
        formed, sims.select(F.col("q").alias("mention_id"), "id", F.col("score").alias("sim"))
    )
    if settings.leaf_value is not None:
        if settings.leaf_always:
            scored = enrich.leaf_score(scored, settings.leaf_value, True, names)
        else:
            scored = enrich.assume_leaf(scored, seeds, isa, settings.leaf_value, names, twice=False)
    ranked = enrich.rank_edges(scored, settings.cap).withColumnRenamed("mention_id", "q")
    return balanced_join(mentions.select("mention_id", key), cut_lineage(ranked), "q").select(
        "mention_id", "rank", "parent_idx", "child_idx", "score"
    )


def evaluate_placement(ranked: DataFrame, gold: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Precision, recall and any/all rates of ranked edges at the cut-offs of the settings.

    ``gold(mention_id, parent_idx, child_idx)``.
    """
    settings = settings or Settings()
    edge = F.struct("parent_idx", "child_idx").alias("cand_id")
    cands = cut_lineage(ranked.select("mention_id", "rank", edge))
    wanted = gold.select("mention_id", edge)
    # mentions of one text bring all their edges in a few partitions: they are dealt out by their number
    rows = cands.count() + wanted.count()
    tasks = max(cands.sparkSession.sparkContext.defaultParallelism, -(-rows // evaluate.TASK_ROWS))
    ranks = cut_lineage(evaluate.gold_ranks(cands, wanted, tasks).select("mention_id", "rank"))
    rates = evaluate.precision_recall_at(cands, wanted, settings.ks, ranks)
    per_mention = evaluate.recall_any_all_at(cands, wanted, settings.ks, ranks=ranks).drop("n_mentions")
    return rates.join(per_mention, "k")
