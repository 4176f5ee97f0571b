"""Metrics over the candidates and gold of parts, and over multi-label decisions."""

from pyspark.sql import functions as F

from taxograft.operators import evaluate as E
from taxograft.workload.registry import derive, query

_KS = (1, 3, 5, 10, 20)
derive("gold_rank", """
SELECT g.mention_id, g.cand_id, r.rank FROM gold g LEFT JOIN ranked_cand r ON r.mention_id = g.mention_id AND r.cand_id = g.cand_id
""")
derive("best_rank", "SELECT mention_id, min(rank) AS r FROM gold_rank GROUP BY mention_id")


def _cg(t):
    return t.ranked_cand.select("mention_id", "cand_id", "rank"), t.gold


@query("gold_position", "SELECT mention_id, coalesce(min(rank) - 1, -1) AS position FROM gold_rank GROUP BY mention_id")
def _(t):
    return E.gold_position(*_cg(t))


@query("precision_recall_at", """
WITH n AS (SELECT count(DISTINCT mention_id) AS n_mentions, count(*) AS n_gold FROM gold),
c AS (SELECT k, count(*) AS tp FROM gold_rank JOIN (VALUES (1), (3), (5), (10), (20)) v(k) ON rank <= k GROUP BY k)
SELECT k, n_mentions, n_gold, tp, tp / (n_mentions * k) AS precision, tp / n_gold AS recall FROM c, n""")
def _(t):
    return E.precision_recall_at(*_cg(t), ks=_KS)


_PER = """per AS (SELECT mention_id, k, bool_or(coalesce(rank <= k, false)) AS a, bool_and(coalesce(rank <= k, false)) AS b
  FROM gold_rank CROSS JOIN (VALUES (1), (3), (5), (10), (20)) v(k) GROUP BY mention_id, k)"""


@query("recall_any_all_at", f"""WITH {_PER} SELECT count(*) AS n_mentions, k, avg(CAST(a AS INT)) AS "any", avg(CAST(b AS INT)) AS "all" FROM per GROUP BY k""")
def _(t):
    return E.recall_any_all_at(*_cg(t), ks=_KS)


@query("recall_any_all_by_slice", f"""WITH {_PER}, s AS (SELECT per.*, p_size > 25 AS slice FROM per JOIN part ON p_partkey = mention_id)
SELECT slice, count(*) AS n_mentions, k, avg(CAST(a AS INT)) AS "any", avg(CAST(b AS INT)) AS "all" FROM s GROUP BY slice, k
UNION ALL SELECT NULL, count(*), k, avg(CAST(a AS INT)), avg(CAST(b AS INT)) FROM s GROUP BY k""")
def _(t):
    by = t.part.select(F.col("p_partkey").alias("mention_id"), (F.col("p_size") > 25).alias("slice"))
    return E.recall_any_all_at(*_cg(t), ks=_KS, by=by)


@query("similarity_at", """
WITH s AS (SELECT mention_id, rank, CASE WHEN score > 20 THEN score / 100 END AS sim FROM ranked_cand),
p AS (SELECT mention_id, k, avg(sim) AS a, min(sim) AS mi, max(sim) AS ma FROM s JOIN (VALUES (1), (5), (10)) v(k) ON rank <= k WHERE sim IS NOT NULL GROUP BY mention_id, k)
SELECT k, count(*) AS n_evaluated, round(avg(a), 9) AS wp_avg, round(avg(mi), 9) AS wp_min, round(avg(ma), 9) AS wp_max FROM p GROUP BY k""")
def _(t):
    sim = F.when(F.col("score") > 20, F.col("score") / 100)
    out = E.similarity_at(t.ranked_cand.select("mention_id", "rank", sim.alias("sim")))
    return out.select("k", "n_evaluated", *[F.round(c, 9).alias(c) for c in ("wp_avg", "wp_min", "wp_max")])


_HIT = """h AS (SELECT g.mention_id, (g.mention_id, g.parent_idx) IN (SELECT (mention_id, parent_idx) FROM cand_edge) AS p, (g.mention_id, g.child_idx) IN (SELECT (mention_id, child_idx) FROM cand_edge) AS c FROM gold_edge g),
m AS (SELECT mention_id, bool_or(p) AS parent, bool_or(c) AS child, bool_or(p AND c) AS bth FROM h GROUP BY mention_id)"""


@query("concept_recall", f"""WITH {_HIT} SELECT count(*) AS n_evaluated, avg(CAST(parent AS INT)) AS recall_parent, avg(CAST(child AS INT)) AS recall_child, avg(CAST(bth AS INT)) AS recall_both FROM m""")
def _(t):
    pool = t.cand_edge.select("mention_id", F.col("parent_idx").alias("id")).unionByName(
        t.cand_edge.select("mention_id", F.col("child_idx").alias("id")))
    return E.concept_recall(pool, t.gold_edge)


# Large parts have a leaf edge, most of them inner edges too; the others have inner edges only.
derive("mixed_gold", """
SELECT DISTINCT mention_id, 'N' || s_nationkey AS parent_idx, 'S' || cand_id AS child_idx FROM gold JOIN supplier ON cand_id = s_suppkey
UNION SELECT p_partkey, 'B:' || p_brand, 'NULL' FROM part WHERE p_size > 30
UNION SELECT p_partkey, 'T:' || p_type, 'NULL' FROM part WHERE p_size > 45
""")
_ER = """x AS (SELECT g.*, (g.mention_id, g.parent_idx, g.child_idx) IN (SELECT (mention_id, parent_idx, child_idx) FROM cand_edge) AS hit FROM mixed_gold g),
m AS (SELECT mention_id, bool_or(child_idx = 'NULL') AS is_leaf, bool_or(hit) AS a, bool_and(hit) AS b,
  bool_or(hit AND child_idx = 'NULL') AS al, bool_or(hit AND child_idx <> 'NULL') AS ai, bool_and(hit OR child_idx <> 'NULL') AS bl FROM x GROUP BY mention_id),
u AS (SELECT is_leaf, CASE WHEN is_leaf THEN al ELSE ai END AS a, CASE WHEN is_leaf THEN bl ELSE b END AS b FROM m UNION ALL SELECT NULL, a, b FROM m)"""


@query("edge_recall", f"""WITH {_ER} SELECT is_leaf, count(*) AS n_evaluated, sum(CAST(a AS INT)) AS n_any, sum(CAST(b AS INT)) AS n_all,
 CASE WHEN is_leaf IS NULL THEN (SELECT count(*) FROM part) ELSE count(*) END AS denominator,
 sum(CAST(a AS INT)) / CASE WHEN is_leaf IS NULL THEN (SELECT count(*) FROM part) ELSE count(*) END AS "any",
 sum(CAST(b AS INT)) / CASE WHEN is_leaf IS NULL THEN (SELECT count(*) FROM part) ELSE count(*) END AS "all" FROM u GROUP BY is_leaf""")
def _(t):
    return E.edge_recall(t.cand_edge, t.mixed_gold, t.part.agg(F.count(F.lit(1)).alias("n")))


@query("edge_recall_relaxed", f"""WITH {_ER}, tg AS (SELECT mention_id, parent_idx, child_idx FROM x UNION SELECT mention_id, 'T:' || p_type, 'P' || p_partkey FROM x JOIN part ON p_partkey = mention_id),
l AS (SELECT mention_id, bool_or(child_idx = 'NULL') AS ll, bool_or(child_idx <> 'NULL') AS li FROM tg SEMI JOIN cand_edge USING (mention_id, parent_idx, child_idx) GROUP BY mention_id),
m2 AS (SELECT m.mention_id, is_leaf, a OR l.mention_id IS NOT NULL AS a, b, al OR coalesce(ll, false) AS al, ai OR coalesce(li, false) AS ai, bl FROM m LEFT JOIN l ON l.mention_id = m.mention_id),
u2 AS (SELECT is_leaf, CASE WHEN is_leaf THEN al ELSE ai END AS a, CASE WHEN is_leaf THEN bl ELSE b END AS b FROM m2 UNION ALL SELECT NULL, a, b FROM m2)
SELECT is_leaf, count(*) AS n_evaluated, sum(CAST(a AS INT)) AS n_any, sum(CAST(b AS INT)) AS n_all, count(*) AS denominator, avg(CAST(a AS INT)) AS "any", avg(CAST(b AS INT)) AS "all" FROM u2 GROUP BY is_leaf""")
def _(t):
    g = t.mixed_gold
    own = t.part.join(g.select(F.col("mention_id").alias("p_partkey")).distinct(), "p_partkey").select(
        F.col("p_partkey").alias("mention_id"), F.concat(F.lit("T:"), "p_type").alias("parent_idx"), F.concat(F.lit("P"), "p_partkey").alias("child_idx"))
    return E.edge_recall(t.cand_edge, g, targets=g.unionByName(own))


# Candidates with leaf edges among them, and gold of both kinds.
derive("leafy_cand", """
SELECT mention_id, rank, parent_idx, child_idx FROM cand_edge
UNION ALL SELECT p_partkey, 1 + p_size % 7, 'B:' || p_brand, 'NULL' FROM part WHERE p_size % 3 > 0
""")


def _leafy(t):
    edge = F.struct("parent_idx", "child_idx").alias("cand_id")
    gold = t.mixed_gold.select("mention_id", edge, (F.col("child_idx") == "NULL").alias("is_leaf"))
    return t.leafy_cand.select("mention_id", "rank", edge), gold


_RATES = """WITH f AS (SELECT mention_id, parent_idx, child_idx, min(rank) AS rank FROM leafy_cand GROUP BY ALL),
x AS (SELECT g.*, g.child_idx = 'NULL' AS leaf_row, bool_or(g.child_idx = 'NULL') OVER (PARTITION BY g.mention_id) AS leaf_mention, f.rank FROM mixed_gold g LEFT JOIN f USING (mention_id, parent_idx, child_idx)),
u AS (SELECT mention_id, {by} AS is_leaf, rank FROM x UNION ALL SELECT mention_id, NULL, rank FROM x),
m AS (SELECT mention_id, is_leaf, k, count(*) AS n, count(*) FILTER (rank <= k) AS tp FROM u, (VALUES (1), (3), (5), (10), (20)) v(k) GROUP BY ALL)
SELECT is_leaf, k, count(*) AS n_mentions, sum(n) AS n_gold, sum(tp) AS tp, sum(tp) / (count(*) * k) AS precision, sum(tp) / sum(n) AS recall,
 avg(CASE WHEN tp > 0 THEN 1.0 ELSE 0 END) AS "any", avg(CASE WHEN tp = n THEN 1.0 ELSE 0 END) AS "all" FROM m GROUP BY is_leaf, k"""


@query("rates_by_leaf_row", _RATES.format(by="leaf_row"))
def _(t):
    return E.rates_by_leaf(*_leafy(t), ks=_KS)


@query("rates_by_leaf_mention", _RATES.format(by="leaf_mention"))
def _(t):
    return E.rates_by_leaf(*_leafy(t), ks=_KS, by="mention")


@query("similarity_by_leaf", """
WITH s AS (SELECT r.mention_id, r.rank, CASE WHEN score > 20 THEN score / 100 END AS sim, (r.cand_id + r.mention_id) % 3 = 0 AS leaf FROM ranked_cand r),
u AS (SELECT mention_id, rank, sim, leaf AS is_leaf FROM s UNION ALL SELECT mention_id, rank, sim, NULL FROM s),
p AS (SELECT mention_id, is_leaf, k, avg(sim) AS a, min(sim) AS mi, max(sim) AS ma FROM u JOIN (VALUES (1), (5), (10)) v(k) ON rank <= k WHERE sim IS NOT NULL GROUP BY ALL)
SELECT is_leaf, k, count(*) AS n_evaluated, round(avg(a), 9) AS wp_avg, round(avg(mi), 9) AS wp_min, round(avg(ma), 9) AS wp_max FROM p GROUP BY is_leaf, k""")
def _(t):
    sim = F.when(F.col("score") > 20, F.col("score") / 100)
    leaf = (F.col("cand_id") + F.col("mention_id")) % 3 == 0
    out = E.similarity_by_leaf(t.ranked_cand.select("mention_id", "rank", sim.alias("sim"), leaf.alias("is_leaf")))
    return out.select("is_leaf", "k", "n_evaluated", *[F.round(c, 9).alias(c) for c in ("wp_avg", "wp_min", "wp_max")])


# Pools: the concepts of every second candidate edge.
derive("concept_pool", """
SELECT mention_id, parent_idx AS id FROM cand_edge WHERE rank % 2 = 0 UNION SELECT mention_id, child_idx FROM cand_edge WHERE rank % 3 = 0
UNION SELECT p_partkey, 'R0' FROM part WHERE p_size % 4 = 0
""")
_POOLED = """h AS (SELECT g.mention_id, g.child_idx = 'NULL' AS leaf, {p} AS p, {c} AS c FROM mixed_gold g),
m AS (SELECT mention_id, bool_or(leaf) AS is_leaf, bool_or(p) AS parent, bool_or(c) AS child, bool_or(p AND c) AS bth FROM h GROUP BY mention_id),
u AS (SELECT * FROM m UNION ALL SELECT mention_id, NULL, parent, child, bth FROM m)
SELECT is_leaf, count(*) AS n_evaluated, avg(CAST(parent AS INT)) AS recall_parent, avg(CAST(child AS INT)) AS recall_child, avg(CAST(bth AS INT)) AS recall_both FROM u GROUP BY is_leaf"""


@query("concept_recall_by_leaf", "WITH " + _POOLED.format(
    p="(g.mention_id, g.parent_idx) IN (SELECT (mention_id, id) FROM concept_pool)", c="(g.mention_id, g.child_idx) IN (SELECT (mention_id, id) FROM concept_pool)"))
def _(t):
    return E.concept_recall(t.concept_pool, t.mixed_gold, E.leaf_mentions(t.mixed_gold))


_WIDE = """gold_up0 AS (SELECT DISTINCT parent_idx AS id, parent_idx AS a FROM mixed_gold), gold_up1 AS (SELECT * FROM gold_up0 UNION SELECT gold_up0.id, parent_id FROM gold_up0 JOIN isa ON child_id = a),
gold_up2 AS (SELECT * FROM gold_up1 UNION SELECT gold_up1.id, parent_id FROM gold_up1 JOIN isa ON child_id = a),
gold_down0 AS (SELECT DISTINCT child_idx AS id, child_idx AS d FROM mixed_gold), gold_down1 AS (SELECT * FROM gold_down0 UNION SELECT gold_down0.id, child_id FROM gold_down0 JOIN isa ON parent_id = d),
gold_down2 AS (SELECT * FROM gold_down1 UNION SELECT gold_down1.id, child_id FROM gold_down1 JOIN isa ON parent_id = d),
hit_up AS (SELECT DISTINCT mention_id, gold_up2.id FROM concept_pool pool JOIN gold_up2 ON pool.id = a), hit_down AS (SELECT DISTINCT mention_id, gold_down2.id FROM concept_pool pool JOIN gold_down2 ON pool.id = d), """


@query("concept_recall_relaxed", "WITH " + _WIDE + _POOLED.format(
    p="(g.mention_id, g.parent_idx) IN (SELECT (mention_id, id) FROM hit_up)", c="(g.mention_id, g.child_idx) IN (SELECT (mention_id, id) FROM hit_down)"))
def _(t):
    return E.concept_recall(t.concept_pool, t.mixed_gold, E.leaf_mentions(t.mixed_gold), t.isa, 2)


@query("mean_rank", """
SELECT count(*) AS n_mentions, count(r) AS n_found, avg(r) AS mr, round(avg(coalesce(1.0 / r, 0)), 9) AS mrr FROM best_rank""")
def _(t):
    return E.mean_rank(*_cg(t)).withColumn("mrr", F.round("mrr", 9))


@query("mean_candidates", "SELECT avg(n) AS mean_candidates, count(*) AS n_mentions FROM (SELECT count(*) AS n FROM cand GROUP BY mention_id)")
def _(t):
    return E.mean_candidates(t.cand)


@query("recall_curve", """
SELECT i, (SELECT count(*) FROM best_rank WHERE r <= i) / (SELECT count(*) FROM best_rank) AS recall FROM (SELECT unnest(range(1, 31)) AS i)""")
def _(t):
    return E.recall_curve(*_cg(t), 30)


@query("hits_at", """
SELECT count(*) AS n_mentions, """ + ", ".join(f"count(*) FILTER (r <= {k}) AS hits_{k}" for k in (1, 4, 8, 16, 32, 64, 128, 256, 512)) + " FROM best_rank")
def _(t):
    return E.hits_at(*_cg(t))


@query("cumulative_recall", """
WITH p AS (SELECT coalesce(r - 1, -1) AS position FROM best_rank)
SELECT position, 100 * sum(h) OVER (ORDER BY position) / (SELECT count(*) FROM p) AS recall FROM (SELECT position, count(*) AS h FROM p WHERE position >= 0 AND position < 40 GROUP BY position)""")
def _(t):
    return E.cumulative_recall(E.gold_position(*_cg(t)), 40)


@query("candidate_recall", """
WITH p AS (SELECT p_brand AS dataset, coalesce(r - 1, -1) AS position FROM best_rank JOIN part ON p_partkey = mention_id), u AS (SELECT * FROM p UNION ALL SELECT NULL, position FROM p)
SELECT dataset, count(*) AS n_mentions, count(*) FILTER (position >= 0 AND position < 3) AS n_found, avg(CASE WHEN position >= 0 AND position < 3 THEN 1.0 ELSE 0 END) AS recall FROM u GROUP BY dataset""")
def _(t):
    pos = E.gold_position(*_cg(t)).join(t.part, F.col("p_partkey") == F.col("mention_id"))
    return E.candidate_recall(pos.select(F.col("p_brand").alias("dataset"), "position"), 3)


@query("accuracy", """
WITH x AS (SELECT CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE l_linenumber END AS g, l_suppkey AS p, l_linestatus = 'F' AS nil FROM lineitem)
SELECT avg(CASE WHEN g = p THEN 1.0 ELSE 0 END) AS acc, avg(CASE WHEN NOT nil THEN CASE WHEN g = p THEN 1.0 ELSE 0 END END) AS acc_known, avg(CASE WHEN nil THEN CASE WHEN g = p THEN 1.0 ELSE 0 END END) AS acc_nil, count(*) FILTER (nil) AS n_nil FROM x""")
def _(t):
    return E.accuracy(t.lineitem.select(
        F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")).otherwise(F.col("l_linenumber")).alias("gold_id"),
        F.col("l_suppkey").alias("pred_id"), (F.col("l_linestatus") == "F").alias("is_nil")))


@query("ranking_accuracy", """
WITH p AS (SELECT r - 1 AS position, r = 1 AS correct FROM best_rank WHERE r IS NOT NULL)
SELECT count(*) AS n_evaluated, (SELECT count(*) FROM part) AS n_samples, count(*) FILTER (correct) / count(*) AS normalised, count(*) FILTER (correct) / (SELECT count(*) FROM part) AS unnormalised,
 count(*) / (SELECT count(*) FROM part) AS candidate_recall, count(*) FILTER (position < 1) / (SELECT count(*) FROM part) AS recall_1, count(*) FILTER (position < 8) / (SELECT count(*) FROM part) AS recall_8 FROM p""")
def _(t):
    pos = E.gold_position(*_cg(t)).where("position >= 0").withColumn("correct", F.col("position") == 0)
    return E.ranking_accuracy(pos, t.part.agg(F.count(F.lit(1)).alias("n")), (1, 8))


@query("within_top_k", "SELECT mention_id, r - 1 AS position FROM best_rank WHERE r - 1 > 0 AND r - 1 <= 5")
def _(t):
    return E.within_top_k(E.gold_position(*_cg(t)), 5)


@query("linking_prf", """
WITH p AS (SELECT mention_id, CASE WHEN score < 60 THEN 'NIL' ELSE 'S' || cand_id END AS entity FROM ranked_cand WHERE rank = 1), g AS (SELECT mention_id, 'S' || min(cand_id) AS entity FROM gold GROUP BY mention_id),
c AS (SELECT (SELECT count(*) FROM p JOIN g USING (mention_id, entity)) AS n_correct, (SELECT count(*) FROM p WHERE entity <> 'NIL') AS n_pred, (SELECT count(*) FROM g) AS n_gold)
SELECT *, coalesce(n_correct / nullif(n_pred, 0), 0) AS precision, n_correct / n_gold AS recall, coalesce(2.0 * n_correct / (n_pred + n_gold), 0) AS f1 FROM c""")
def _(t):
    pred = t.ranked_cand.where("rank = 1").select(
        "mention_id", F.when(F.col("score") < 60, "NIL").otherwise(F.concat(F.lit("S"), "cand_id")).alias("entity"))
    gold = t.gold.groupBy("mention_id").agg(F.concat(F.lit("S"), F.min("cand_id")).alias("entity"))
    return E.linking_prf(pred, gold)


@query("linking_prf_detected", """
WITH p AS (SELECT mention_id, CASE WHEN score < 60 THEN 'NIL' ELSE 'S' || cand_id END AS entity FROM ranked_cand WHERE rank = 1), g AS (SELECT mention_id, 'S' || min(cand_id) AS entity FROM gold GROUP BY mention_id),
c AS (SELECT (SELECT count(*) FROM p JOIN g USING (mention_id, entity)) AS n_correct, (SELECT count(*) FROM part) - (SELECT count(*) FROM p WHERE entity = 'NIL') AS n_pred, (SELECT count(*) FROM g) AS n_gold)
SELECT *, coalesce(n_correct / nullif(n_pred, 0), 0) AS precision, n_correct / n_gold AS recall, coalesce(2.0 * n_correct / (n_pred + n_gold), 0) AS f1 FROM c""")
def _(t):
    pred = t.ranked_cand.where("rank = 1").select(
        "mention_id", F.when(F.col("score") < 60, "NIL").otherwise(F.concat(F.lit("S"), "cand_id")).alias("entity"))
    gold = t.gold.groupBy("mention_id").agg(F.concat(F.lit("S"), F.min("cand_id")).alias("entity"))
    return E.linking_prf(pred, gold, detected=t.part.select(F.col("p_partkey").alias("mention_id")))


@query("best_run", """
SELECT 'recall' AS name, arg_max(run, (value, -run_no)) AS run, max(value) AS value FROM (
  SELECT p_brand AS run, CAST(substr(p_brand, 7) AS INT) AS run_no, CAST(max(p_size) AS DOUBLE) AS value FROM part GROUP BY p_brand)""")
def _(t):
    m = t.part.groupBy(F.col("p_brand").alias("run")).agg(F.max("p_size").cast("double").alias("value"))
    return E.best_run(m.select("run", F.expr("substring(run, 7)").cast("int").alias("run_no"), F.lit("recall").alias("name"), "value"), "recall")


@query("sort_runs", "SELECT p_brand AS run, avg(p_size) AS recall FROM part GROUP BY p_brand ORDER BY recall DESC, run")
def _(t):
    return E.sort_runs(t.part.groupBy(F.col("p_brand").alias("run")).agg(F.avg("p_size").alias("recall")))


@query("metrics_frame", """
SELECT 'parts' AS dataset, 'all' AS slice, 'n_mentions' AS name, CAST(count(*) AS DOUBLE) AS value FROM best_rank
UNION ALL SELECT 'parts', 'all', 'mean_candidates', (SELECT count(*) FROM cand) / (SELECT count(DISTINCT mention_id) FROM cand)""")
def _(t):
    one = E.mean_rank(*_cg(t)).select("n_mentions")
    two = E.mean_candidates(t.cand).select("mean_candidates")
    return E.metrics_frame({"all": one}, "parts").unionByName(E.metrics_frame({"all": two}, "parts"))


# ------------------------------------------------------------------ multi-label
derive("ml", """
SELECT c.mention_id AS row_id, c.cand_id AS label, CASE WHEN g.cand_id IS NULL THEN 0 ELSE 1 END AS y,
  CASE WHEN c.score > 50 THEN 1 ELSE 0 END AS yhat, c.score, m.mention_id IS NULL AS complete
FROM cand c LEFT JOIN gold g ON g.mention_id = c.mention_id AND g.cand_id = c.cand_id
LEFT JOIN (SELECT DISTINCT mention_id FROM gold_rank WHERE rank IS NULL) m ON m.mention_id = c.mention_id
""", stored=True)
_C = "sum(y * yhat) AS tp, sum(greatest(y, yhat)) AS un, sum(yhat) AS pred, sum(y) AS pos"
_F1 = "coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1"


@query("macro", f"""WITH c AS (SELECT label, {_C} FROM ml GROUP BY label), r AS (SELECT avg(tp / (un + 1e-10)) AS acc, avg(tp / (pred + 1e-10)) AS prec, avg(tp / (pos + 1e-10)) AS rec FROM c)
SELECT acc, prec, rec, {_F1} FROM r""")
def _(t):
    return E.macro(t.ml)


_RATE = "coalesce(tp / nullif({d}, 0), 0)"
_MICRO = f"{_RATE.format(d='un')} AS acc, {_RATE.format(d='pred')} AS prec, {_RATE.format(d='pos')} AS rec"


@query("micro", f"WITH c AS (SELECT {_C} FROM ml), r AS (SELECT {_MICRO} FROM c) SELECT acc, prec, rec, {_F1} FROM r")
def _(t):
    return E.micro(t.ml)


@query("micro_by_group", f"""WITH c AS (SELECT CASE label % 6 WHEN 0 THEN 'procedure' ELSE 'diagnosis' END AS label_group, {_C} FROM ml WHERE label % 6 IN (0, 1, 2, 4) GROUP BY 1), r AS (SELECT label_group, {_MICRO} FROM c)
SELECT label_group, acc, prec, rec, {_F1} FROM r""")
def _(t):
    # dots behind two, three, four digits, four behind an E; no dot behind E and three, or five
    forms = F.array(*(F.lit(x) for x in ("12.", "123.", "E123.", "1234.", "E123", "12345")))
    kind = (F.col("label") % 6).cast("int")
    dotted = F.when(kind <= 3, F.col("label").cast("string")).otherwise("")
    code = F.concat(F.get(forms, kind), dotted)
    return E.micro(t.ml, E.code_family(code))


@query("instance_average", f"""WITH c AS (SELECT row_id, {_C} FROM ml GROUP BY row_id), r AS (SELECT avg({_RATE.format(d='pred')}) AS prec, avg({_RATE.format(d='pos')}) AS rec FROM c)
SELECT prec, rec, {_F1} FROM r""")
def _(t):
    return E.instance_average(t.ml)


_TOPK = """b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label) AS rk FROM ml), p AS (SELECT row_id, sum(y) AS pos, bool_and(complete) AS comp FROM ml GROUP BY row_id),
h AS (SELECT row_id, k, sum(y) AS h, count(*) AS n FROM b JOIN (VALUES (1), (5), (10)) v(k) ON rk <= k GROUP BY row_id, k)"""


@query("at_k", f"""WITH {_TOPK}, r AS (SELECT k, avg(coalesce(h / nullif(pos, 0), 0)) AS rec, avg(h / n) AS prec FROM h JOIN p USING (row_id) GROUP BY k) SELECT k, rec, prec, {_F1} FROM r""")
def _(t):
    return E.at_k(t.ml, (1, 5, 10))


@query("insertion", """
WITH p AS (SELECT row_id, bool_or(y = 1 AND yhat = 1) AS a, bool_and(y = yhat) AND bool_or(y = 1) AND bool_and(complete) AS b FROM ml GROUP BY row_id)
SELECT avg(CAST(a AS INT)) AS "any", avg(CAST(b AS INT)) AS "all", count(*) AS n_instances FROM p""")
def _(t):
    return E.insertion(t.ml)


@query("insertion_at", f"""WITH {_TOPK} SELECT k, avg(CASE WHEN h > 0 THEN 1.0 ELSE 0 END) AS "any", avg(CASE WHEN h = pos AND pos > 0 AND comp THEN 1.0 ELSE 0 END) AS "all" FROM h JOIN p USING (row_id) GROUP BY k""")
def _(t):
    return E.insertion_at(t.ml, (1, 5, 10))


@query("auc", """
WITH l AS (SELECT CAST(label AS VARCHAR) AS label, y, score FROM ml UNION ALL SELECT 'micro', y, score FROM ml),
r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS rk FROM l),
a AS (SELECT label, (sum(CASE WHEN y = 1 THEN rk END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS auc FROM r GROUP BY label HAVING sum(y) > 0 AND sum(1 - y) > 0)
SELECT label, round(auc, 9) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 9) FROM a WHERE label <> 'micro'""")
def _(t):
    return E.auc(t.ml).withColumn("auc", F.round("auc", 9))


derive("sample_row", """
SELECT l_orderkey * 10 + l_linenumber AS row_id, p_name AS mention, o_orderpriority AS context_left, l_suppkey AS gold_id,
  CASE WHEN l_quantity > 10 THEN l_linenumber ELSE -1 END AS position, l_returnflag = 'R' AS is_nil
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)
JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
""", stored=True)


@query("aggregate_labels", """
SELECT mention, context_left, bool_and(position <> -1) AS complete, arg_max(is_nil, row_id) AS is_nil, min(row_id) AS first_row, count(*) AS n_rows FROM sample_row GROUP BY mention, context_left""")
def _(t):
    return E.aggregate_labels(t.sample_row, ["mention", "context_left"])[0].drop("sample_id")


@query("aggregate_labels_positions", "SELECT DISTINCT mention, context_left, position FROM sample_row WHERE position <> -1")
def _(t):
    samples, positions, _ = E.aggregate_labels(t.sample_row, ["mention", "context_left"])
    return positions.join(samples, "sample_id").select("mention", "context_left", "position")


@query("in_batch_accuracy", """
WITH b AS (SELECT DISTINCT l_orderkey AS batch_id, l_linenumber AS idx, min(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) % 5 AS candidate FROM lineitem),
f AS (SELECT batch_id, candidate, min(idx) AS first FROM b GROUP BY ALL), s AS (SELECT a.batch_id, a.idx AS row, c.idx, (a.idx * 7 + c.idx * 3) % 5 AS score FROM b a JOIN b c ON a.batch_id = c.batch_id),
d AS (SELECT s.* FROM s SEMI JOIN f ON f.batch_id = s.batch_id AND f.first = s.idx),
x AS (SELECT batch_id, row, arg_min(idx, (-score, idx)) AS pick FROM d GROUP BY ALL)
SELECT avg(CASE WHEN pick = first THEN 1.0 ELSE 0 END) AS accuracy, count(*) AS n FROM b JOIN f USING (batch_id, candidate) LEFT JOIN x ON x.batch_id = b.batch_id AND x.row = b.idx""")
def _(t):
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("idx")).agg((F.min("l_suppkey") % 5).alias("candidate"))
    # a batch has at most seven rows
    c = b.select("batch_id", F.col("idx").alias("idx2"))
    s = b.join(c, "batch_id").select("batch_id", F.col("idx").alias("row"), F.col("idx2").alias("idx"),
                                     ((F.col("idx") * 7 + F.col("idx2") * 3) % 5).alias("score"))
    return E.in_batch_accuracy(s, b)


@query("pool_synonyms_max", """
WITH m AS (SELECT mention_id, CAST(floor(cand_id / 3) AS BIGINT) AS cand_id, max(score) AS score FROM cand GROUP BY ALL)
SELECT mention_id, cand_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_id) AS rank FROM m) WHERE rank <= 5""")
def _(t):
    e = t.supplier.select(F.col("s_suppkey").alias("local_id"), F.floor(F.col("s_suppkey") / 3).alias("canonical_id"))
    return E.pool_synonyms(t.cand.withColumnRenamed("cand_id", "local_id"), e, "max", 5)


@query("pool_synonyms_avg", """
WITH m AS (SELECT mention_id, CAST(floor(cand_id / 3) AS BIGINT) AS cand_id, avg(score) AS score FROM cand GROUP BY ALL)
SELECT mention_id, cand_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_id) AS rank FROM m) WHERE rank <= 5""")
def _(t):
    e = t.supplier.select(F.col("s_suppkey").alias("local_id"), F.floor(F.col("s_suppkey") / 3).alias("canonical_id"))
    return E.pool_synonyms(t.cand.withColumnRenamed("cand_id", "local_id"), e, "avg", 5)


@query("pool_synonyms_factor", """
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_id) AS pos FROM cand) WHERE pos <= 10),
m AS (SELECT mention_id, CAST(floor(cand_id / 3) AS BIGINT) AS cand_id, avg(score) AS score FROM f GROUP BY ALL)
SELECT mention_id, cand_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_id) AS rank FROM m) WHERE rank <= 5""")
def _(t):
    e = t.supplier.select(F.col("s_suppkey").alias("local_id"), F.floor(F.col("s_suppkey") / 3).alias("canonical_id"))
    return E.pool_synonyms(t.cand.withColumnRenamed("cand_id", "local_id"), e, "avg", 5, 2)


@query("pad_candidates", """
SELECT m.mention_id, rank, cand_id, CASE WHEN cand_id IS NULL THEN 0 ELSE 1 END AS mask FROM (
  SELECT mention_id, unnest(range(1, 21)) AS rank FROM (SELECT DISTINCT mention_id FROM cand)) m LEFT JOIN ranked_cand r USING (mention_id, rank)""")
def _(t):
    return E.pad_candidates(t.ranked_cand, 20)
