"""Edge formation, enrichment, ranking and whole placements."""

from pyspark.sql import functions as F

from taxograft.model import Settings
from taxograft.operators import enrich as N
from taxograft.plans.order import number_rows
from taxograft.plans.placement import evaluate_placement, place_mentions
from taxograft.workload.registry import derive, query
from taxograft.workload.search import _TITLE_TF, _TOK

# Seeds: the suppliers with the largest shipped quantity per part, and the part itself.
derive("seed", """
SELECT mention_id, CAST(rank AS INT) AS rank, 'S' || cand_id AS id FROM ranked_cand WHERE rank <= 3
UNION ALL SELECT p_partkey, 4, 'P' || p_partkey FROM part
UNION ALL SELECT p_partkey, 5, '[EX.](role)(S1)' FROM part WHERE p_size > 40
""")
# Complex seeds are not expanded.
derive("simple_seed", "SELECT * FROM seed WHERE NOT contains(id, '[')")
# What these queries return on the whole graph is compared by a count and a digest of a mention's
# edges: all rows are computed, and every one of them changes the sum.
_DIGEST = """ SELECT mention_id, count(*) AS n_edges, CAST(sum(CAST('0x' || substr(md5({row}), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM ({{rows}}) GROUP BY mention_id"""
_EDGE_DIGEST = _DIGEST.format(row="parent_idx || '|' || child_idx")


def _digest(edges, *more):
    row = F.md5(F.concat_ws("|", "parent_idx", "child_idx", *more))
    number = F.conv(F.substring(row, 1, 8), 16, 10).cast("long")
    return edges.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(number).alias("digest"))


_FORM = """SELECT DISTINCT mention_id, parent_idx, child_idx FROM (
  SELECT mention_id, id AS parent_idx, 'NULL' AS child_idx FROM {s}
  UNION ALL SELECT mention_id, parent_id, id FROM {s} JOIN {g} ON child_id = id
  UNION ALL SELECT mention_id, id, child_id FROM {s} JOIN {g} ON parent_id = id
  UNION ALL SELECT mention_id, u.parent_id, d.child_id FROM {s} JOIN {g} u ON u.child_id = id JOIN {g} d ON d.parent_id = id)"""


@query("form_edges", _EDGE_DIGEST.format(rows=_FORM.format(s="simple_seed", g="isa")))
def _(t):
    return _digest(N.form_edges(t.seed, t.isa))


@query("enrich_concepts", """
WITH nb AS (SELECT parent_id AS id, 0 AS side, child_id AS nxt FROM isa UNION SELECT child_id, 1, parent_id FROM isa),
pool AS (SELECT mention_id, id, 0 AS late, rank, -1 AS side FROM seed
  UNION ALL SELECT s.mention_id, nxt, 1, rank, nb.side FROM simple_seed s JOIN nb ON nb.id = s.id),
o AS (SELECT mention_id, id, min((late, rank, side)) AS o FROM pool GROUP BY mention_id, id),
r AS (SELECT mention_id, id, row_number() OVER (PARTITION BY mention_id ORDER BY o, id) AS pos FROM o)
SELECT mention_id, pos, id FROM r WHERE pos <= 20 UNION ALL SELECT mention_id, max(pos) + 1, 'NULL' FROM r WHERE pos <= 20 GROUP BY mention_id""")
def _(t):
    return N.enrich_concepts(t.seed, t.isa, 20)


# Candidate edges of a mention (a part): nation over its best suppliers, type over itself.
derive("cand_edge", """
SELECT r.mention_id, CAST(r.rank AS INT) AS rank, 'N' || s_nationkey AS parent_idx, 'S' || r.cand_id AS child_idx, r.score
FROM ranked_cand r JOIN supplier ON r.cand_id = s_suppkey
UNION ALL SELECT p_partkey, 1000, 'T:' || p_type, 'P' || p_partkey, CAST(p_size AS DOUBLE) FROM part
""", stored=True)
_LEAF = """leaf AS (SELECT DISTINCT parent_idx FROM {k} WHERE child_idx = 'NULL'),
lf AS (SELECT mention_id, parent_idx, child_idx FROM {c} UNION SELECT mention_id, parent_idx, 'NULL' FROM {c} SEMI JOIN leaf USING (parent_idx) WHERE child_idx <> 'NULL')"""
_HOPS = """hp AS (SELECT mention_id, parent_idx, child_idx FROM {c}
  UNION SELECT h.mention_id, h.np, h.nc FROM (
   SELECT c.mention_id, u.parent_idx AS np, c.child_idx AS nc FROM {c} c JOIN {k} u ON u.child_idx = c.parent_idx
   UNION SELECT c.mention_id, c.parent_idx, d.child_idx FROM {c} c JOIN {k} d ON d.parent_idx = c.child_idx
   UNION SELECT c.mention_id, u.parent_idx, d.child_idx FROM {c} c JOIN {k} u ON u.child_idx = c.parent_idx JOIN {k} d ON d.parent_idx = c.child_idx) h
  SEMI JOIN {k} k ON k.parent_idx = h.np AND k.child_idx = h.nc)"""


@query("enrich_leaf", "WITH " + _LEAF.format(c="cand_edge", k="edge") + " SELECT * FROM lf")
def _(t):
    return N.enrich_leaf(t.cand_edge, t.edge)


@query("enrich_hops", "WITH " + _HOPS.format(c="cand_edge", k="edge") + _EDGE_DIGEST.format(rows="SELECT * FROM hp"))
def _(t):
    return _digest(N.enrich_hops(t.cand_edge, t.edge))


@query("enrich_edges", "WITH " + _LEAF.format(c="cand_edge", k="edge") + ", " + _HOPS.format(c="lf", k="edge") + _EDGE_DIGEST.format(rows="SELECT * FROM hp"))
def _(t):
    return _digest(N.enrich_edges(t.cand_edge, t.edge))


_SEF = """WITH sd AS (SELECT * FROM cand_edge WHERE rank <= 3), """ + _LEAF.format(c="sd", k="edge") + ", " + _HOPS.format(c="lf", k="edge") + """,
n AS (SELECT mention_id, count(*) AS n FROM hp GROUP BY mention_id),
rest AS (SELECT c.*, row_number() OVER (PARTITION BY c.mention_id ORDER BY rank) AS pos FROM cand_edge c ANTI JOIN hp h ON h.mention_id = c.mention_id AND h.parent_idx = c.parent_idx AND h.child_idx = c.child_idx WHERE rank > 3),
al AS (SELECT h.*, c.score FROM hp h LEFT JOIN cand_edge c USING (mention_id, parent_idx, child_idx)
  UNION ALL SELECT r.mention_id, r.parent_idx, r.child_idx, r.score FROM rest r JOIN n USING (mention_id) WHERE r.pos + n.n <= 12),
rk AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC NULLS LAST, parent_idx, child_idx) AS rank FROM al)
SELECT mention_id, parent_idx, child_idx, rank, score FROM rk WHERE rank <= 12"""


@query("seed_enrich_fill", _SEF)
def _(t):
    return N.seed_enrich_fill(t.cand_edge, t.edge, 3, 12)


# Every enriched edge has a score of its own here.
@query("seed_enrich_fill_scored", _SEF.replace(
    "al AS (SELECT h.*, c.score FROM hp h LEFT JOIN cand_edge c USING (mention_id, parent_idx, child_idx)",
    "al AS (SELECT h.*, CAST((mention_id * 7 + length(parent_idx) * 3 + length(child_idx) * 5) % 100 AS DOUBLE) AS score FROM hp h"))
def _(t):
    seeds = t.cand_edge.where("rank <= 3")
    score = (F.col("mention_id") * 7 + F.length("parent_idx") * 3 + F.length("child_idx") * 5) % 100
    scores = N.enrich_edges(seeds, t.edge).withColumn("score", score.cast("double"))
    return N.seed_enrich_fill(t.cand_edge, t.edge, 3, 12, scores=scores)


@query("edge_ids", """
WITH k AS (SELECT parent_idx, child_idx, row_number() OVER (ORDER BY parent_idx, child_idx) - 1 AS edge_id FROM edge)
SELECT mention_id, c.parent_idx, c.child_idx, coalesce(edge_id, -1) AS edge_id FROM cand_edge c LEFT JOIN k USING (parent_idx, child_idx)""")
def _(t):
    from taxograft.operators.catalogue import number_edges

    known = number_edges(t.edge)
    return N.edge_ids(t.cand_edge.select("mention_id", "parent_idx", "child_idx"), known)


@query("leaf_score", """
SELECT mention_id, parent_idx, CASE WHEN score > 40 THEN 'NULL' ELSE child_idx END AS child_idx, CASE WHEN score > 40 THEN 1000.0 ELSE score END AS score FROM cand_edge""")
def _(t):
    c = F.when(F.col("score") > 40, "NULL").otherwise(F.col("child_idx"))
    return N.leaf_score(t.cand_edge.select("mention_id", "parent_idx", c.alias("child_idx"), "score"), 1000, on=True)


@query("assume_leaf", """
WITH f AS (""" + _FORM.format(s="simple_seed", g="isa") + """),
t AS (SELECT mention_id, id NOT IN (SELECT parent_id FROM isa) AS leaf FROM seed WHERE rank = 1)""" + _DIGEST.format(
    row="parent_idx || '|' || child_idx || '|' || score").format(rows="""
SELECT f.mention_id, parent_idx, child_idx, CASE WHEN child_idx <> 'NULL' THEN 5 WHEN leaf THEN 1000 ELSE -1000 END AS score
FROM f LEFT JOIN t ON t.mention_id = f.mention_id"""))
def _(t):
    edges = N.form_edges(t.seed, t.isa).withColumn("score", F.lit(5.0))
    return _digest(N.assume_leaf(edges, t.seed, t.isa, 1000), F.col("score").cast("int").cast("string"))


@query("rank_edges", """
SELECT mention_id, parent_idx, child_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, parent_idx, child_idx) AS rank FROM (
  SELECT mention_id, parent_idx, child_idx, max(score) AS score FROM cand_edge GROUP BY ALL)) WHERE rank <= 5""")
def _(t):
    return N.rank_edges(t.cand_edge, 5)


@query("top_k", "SELECT mention_id, cand_id, score, rank FROM ranked_cand WHERE rank <= 10")
def _(t):
    from taxograft.plans.order import top_k

    return top_k(t.cand, "mention_id", [F.desc("score"), F.asc("cand_id")], 10)


# A second candidate list: suppliers by the number of lines.
derive("second_cand", """
SELECT mention_id, cand_id, row_number() OVER (PARTITION BY mention_id ORDER BY n DESC, cand_id) AS rank FROM (
  SELECT l_partkey AS mention_id, l_suppkey AS cand_id, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)
""")


@query("union_with_quota", """
WITH u AS (SELECT mention_id, cand_id AS id, 0 AS s, rank FROM ranked_cand WHERE rank <= 5 UNION ALL SELECT mention_id, cand_id, 1, rank FROM second_cand),
o AS (SELECT mention_id, id, min((s, rank)) AS o FROM u GROUP BY mention_id, id)
SELECT mention_id, pos, id FROM (SELECT mention_id, id, row_number() OVER (PARTITION BY mention_id ORDER BY o) AS pos FROM o) WHERE pos <= 10""")
def _(t):
    a = t.ranked_cand.select("mention_id", "rank", F.col("cand_id").alias("id"))
    return N.union_with_quota(a, t.second_cand.select("mention_id", "rank", F.col("cand_id").alias("id")), 10)


@query("expand_to_pairs", """
SELECT l_orderkey, count(*) AS n, min(parent_idx || child_idx) AS first_edge, max(parent_idx || child_idx) AS last_edge FROM lineitem JOIN cand_edge ON mention_id = l_partkey GROUP BY l_orderkey""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("mention_id"))
    edge = F.concat("parent_idx", "child_idx").alias("edge")
    # edges are compared by their number in the order of their texts: numbers are summed up as they come,
    # while for texts all pairs would be sorted first
    numbered = number_rows(t.cand_edge.select(edge).where(F.col("edge").isNotNull()).distinct(), ["edge"], "no")
    ranked = t.cand_edge.select("mention_id", "parent_idx", "child_idx", edge).join(numbered, "edge", "left").drop("edge")
    found = N.expand_to_pairs(ranked, rows, ["mention_id"]).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("no").alias("first"), F.max("no").alias("last"))
    first, last = (numbered.select(F.col("no").alias(x), F.col("edge").alias(f"{x}_edge")) for x in ("first", "last"))
    return found.join(first, "first", "left").join(last, "last", "left").select("l_orderkey", "n", "first_edge", "last_edge")


@query("filter_degree", "SELECT * FROM edge WHERE degree <> 0")
def _(t):
    return N.filter_degree(t.edge)


derive("gold_edge", """
SELECT DISTINCT mention_id, 'N' || s_nationkey AS parent_idx, 'S' || cand_id AS child_idx FROM gold JOIN supplier ON cand_id = s_suppkey
UNION SELECT p_partkey, 'B:' || p_brand, 'NULL' FROM part
""", stored=True)


@query("gold_in_candidates", """
SELECT mention_id, parent_idx, child_idx FROM cand_edge WHERE mention_id IN (
  SELECT c.mention_id FROM cand_edge c JOIN gold_edge g USING (mention_id, parent_idx, child_idx))""")
def _(t):
    return N.gold_in_candidates(t.cand_edge.select("mention_id", "parent_idx", "child_idx"), t.gold_edge)


@query("pair_edges", """
SELECT mention_id, c.parent_idx AS pred_parent, c.child_idx AS pred_child, count(*) AS n, min(g.parent_idx || g.child_idx) AS first_gold, max(g.parent_idx || g.child_idx) AS last_gold
FROM cand_edge c JOIN gold_edge g USING (mention_id) GROUP BY mention_id, c.parent_idx, c.child_idx""")
def _(t):
    gold = F.concat("gold_parent", "gold_child")
    return N.pair_edges(t.cand_edge, t.gold_edge).groupBy("mention_id", "pred_parent", "pred_child").agg(
        F.count(F.lit(1)).alias("n"), F.min(gold).alias("first_gold"), F.max(gold).alias("last_gold"))


@query("match_marks", """
SELECT c.mention_id, c.parent_idx, c.child_idx,
  (c.mention_id, c.parent_idx) IN (SELECT (mention_id, parent_idx) FROM gold_edge) AS parent_ok,
  (c.mention_id, c.child_idx) IN (SELECT (mention_id, child_idx) FROM gold_edge) AS child_ok,
  (c.mention_id, c.parent_idx, c.child_idx) IN (SELECT (mention_id, parent_idx, child_idx) FROM gold_edge) AS both_ok FROM cand_edge c""")
def _(t):
    from taxograft.operators.prompting import match_marks

    return match_marks(t.cand_edge.select("mention_id", "parent_idx", "child_idx"), t.gold_edge)


_PLACE = f"""p AS ({_TITLE_TF}), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
m AS (SELECT DISTINCT p_name AS q FROM part),
w AS (SELECT q, token, count(*) * log10((SELECT count(DISTINCT id) FROM concept) / any_value(df)) AS w FROM (SELECT q, {_TOK.format(c='q')} AS token FROM m) JOIN d USING (token) GROUP BY q, token),
sc AS (SELECT q, id, round(sum(w), 9) AS score FROM w JOIN p USING (token) GROUP BY q, id),
sd AS (SELECT q AS mention_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5),
f0 AS ({_FORM.format(s='sd', g='isa')})"""
_PLACE_RANK = """,
x AS (SELECT DISTINCT mention_id, parent_idx AS id FROM {f} UNION SELECT mention_id, child_idx FROM {f}),
ns AS (SELECT x.mention_id, x.id, round(sum(w), 9) AS sim FROM x JOIN p ON p.id = x.id JOIN w ON w.q = x.mention_id AND w.token = p.token GROUP BY ALL),
es AS (SELECT f.mention_id, parent_idx, child_idx, CASE WHEN child_idx = 'NULL' THEN {leaf} ELSE round((coalesce(a.sim, 0) + coalesce(b.sim, 0)) / 2, 9) END AS score FROM {f} f
  LEFT JOIN ns a ON a.mention_id = f.mention_id AND a.id = parent_idx LEFT JOIN ns b ON b.mention_id = f.mention_id AND b.id = child_idx {join}),
rk AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, parent_idx, child_idx) AS rank FROM es)
SELECT p_partkey AS mention_id, rank, parent_idx, child_idx, CAST(score AS DOUBLE) AS score FROM part JOIN rk ON p_name = rk.mention_id WHERE rank <= 20"""


def _place(t, edges=None, **kw):
    mentions = t.part.select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("mention"))
    concepts = t.concept.select("id", F.col("title").alias("text"))
    return place_mentions(mentions, concepts, t.isa, edges, Settings(seeds=5, cap=20, **kw))


@query("place_mentions", "WITH " + _PLACE + _PLACE_RANK.format(f="f0", leaf="CASE WHEN l.leaf THEN 1000.0 ELSE -1000.0 END",
       join="LEFT JOIN (SELECT mention_id, id NOT IN (SELECT parent_id FROM isa) AS leaf FROM sd WHERE rank = 1) l ON l.mention_id = f.mention_id"))
def _(t):
    return _place(t, enrich=False, leaf_value=1000.0)


@query("place_mentions_enriched", "WITH " + _PLACE + """,
fc AS (SELECT f0.* FROM f0 SEMI JOIN edge k ON k.parent_idx = f0.parent_idx AND k.child_idx = f0.child_idx), """
       + _LEAF.format(c="fc", k="edge") + ", " + _HOPS.format(c="lf", k="edge") + """,
f1 AS (SELECT mention_id, parent_idx, child_idx FROM f0 UNION SELECT mention_id, parent_idx, child_idx FROM hp WHERE parent_idx <> 'THING')"""
       + _PLACE_RANK.format(f="f1", leaf="round((coalesce(a.sim, 0) + coalesce(b.sim, 0)) / 2, 9)", join=""))
def _(t):
    return _place(t, t.edge)


# Vectors of parts and suppliers, and of the parts as mentions: those of the given table in turn.
derive("part_vector", """
SELECT p_partkey AS mention_id, p_name AS mention, p_name || ' ' || p_brand AS context, embedding AS vector
FROM (SELECT part.*, p_partkey % top AS turn FROM part, (SELECT max(vec_id) AS top FROM embeddings)) JOIN embeddings ON vec_id = turn
""", stored=True)
derive("concept_vector", """
SELECT id, embedding AS vector FROM concept JOIN embeddings ON id = 'P' || (vec_id + 7) OR id = 'S' || (vec_id + 3)
""", stored=True, spark="""
SELECT id, embedding AS vector FROM concept JOIN (
  SELECT 'P' || (vec_id + 7) AS _id, embedding FROM embeddings UNION ALL SELECT 'S' || (vec_id + 3), embedding FROM embeddings) ON id = _id
""")
_COS = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
_DENSE = """mv AS (SELECT mention_id, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM part_vector),
cv AS (SELECT id, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM concept_vector)"""
_DENSE_SEEDS = f"""sc AS (SELECT mention_id, b.id, round({_COS}, 9) AS score FROM mv a, cv b),
sd AS (SELECT mention_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5)"""
_TEXT_SEEDS = _PLACE.split(",\nf0 AS")[0].replace("sd AS (", "sq AS (") + """,
sd AS (SELECT p_partkey AS mention_id, id, rank FROM part_vector JOIN part ON p_partkey = part_vector.mention_id JOIN sq ON sq.mention_id = p_name)"""
_DENSE_RANK = f""",
f0 AS ({_FORM.format(s='sd', g='isa')}),
x AS (SELECT DISTINCT mention_id, parent_idx AS id FROM f0 UNION SELECT mention_id, child_idx FROM f0),
ns AS (SELECT x.mention_id, x.id, {_COS} AS sim FROM x JOIN mv a ON a.mention_id = x.mention_id JOIN cv b ON b.id = x.id),
es AS (SELECT f.mention_id, parent_idx, child_idx, {{score}} AS score FROM f0 f
  LEFT JOIN ns a ON a.mention_id = f.mention_id AND a.id = parent_idx LEFT JOIN ns b ON b.mention_id = f.mention_id AND b.id = child_idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, parent_idx, child_idx) AS rank FROM es)
SELECT mention_id, rank, parent_idx, child_idx, CAST(score AS DOUBLE) AS score FROM rk WHERE rank <= 20"""
_MEAN = "round((coalesce(a.sim, 0) + coalesce(b.sim, 0)) / 2, 9)"


def _place_dense(t, **kw):
    concepts = t.concept.select("id", F.col("title").alias("text"))
    mentions = t.part_vector.select("mention_id", "mention", "vector")
    return place_mentions(mentions, concepts, t.isa, None, Settings(seeds=5, cap=20, edges_by="dense", **kw), t.concept_vector)


@query("place_mentions_dense", f"WITH {_DENSE}, {_DENSE_SEEDS}" + _DENSE_RANK.format(score=_MEAN))
def _(t):
    return _place_dense(t, seeds_by="dense")


@query("place_mentions_mixed", f"WITH {_TEXT_SEEDS}, {_DENSE}" + _DENSE_RANK.format(score=_MEAN))
def _(t):
    return _place_dense(t)


@query("place_mentions_leaf_always", f"WITH {_DENSE}, {_DENSE_SEEDS}" + _DENSE_RANK.format(score=f"CASE WHEN child_idx = 'NULL' THEN 1000.0 ELSE {_MEAN} END"))
def _(t):
    return _place_dense(t, seeds_by="dense", leaf_value=1000.0, leaf_always=True)


# Seeds: two by the mention, then new ones by its context; scores of both texts are blended.
@query("place_mentions_context", f"""WITH p AS ({_TITLE_TF}), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
m AS (SELECT p_partkey AS q, 0 AS side, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, p_name || ' ' || p_brand FROM part),
w AS (SELECT q, side, token, count(*) * log10((SELECT count(DISTINCT id) FROM concept) / any_value(df)) AS w FROM (SELECT q, side, {_TOK.format(c='text')} AS token FROM m) JOIN d USING (token) GROUP BY q, side, token),
sc AS (SELECT q, side, id, round(sum(w), 9) AS score FROM w JOIN p USING (token) WHERE w > 0 GROUP BY q, side, id),
bt AS (SELECT q, side, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q, side ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5),
un AS (SELECT q, id, min((side, rank)) AS o FROM bt WHERE side = 1 OR rank <= 2 GROUP BY q, id),
sd AS (SELECT q AS mention_id, id, rank FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY o) AS rank FROM un) WHERE rank <= 5),
f0 AS ({_FORM.format(s='sd', g='isa')}),
x AS (SELECT DISTINCT mention_id, parent_idx AS id FROM f0 UNION SELECT mention_id, child_idx FROM f0),
ns AS (SELECT mention_id, id, 0.5 * coalesce(round(sum(w) FILTER (side = 1), 9), 0) + 0.5 * coalesce(round(sum(w) FILTER (side = 0), 9), 0) AS sim
  FROM x JOIN p USING (id) JOIN w ON w.q = mention_id AND w.token = p.token GROUP BY ALL),
es AS (SELECT f.mention_id, parent_idx, child_idx, {_MEAN} AS score FROM f0 f
  LEFT JOIN ns a ON a.mention_id = f.mention_id AND a.id = parent_idx LEFT JOIN ns b ON b.mention_id = f.mention_id AND b.id = child_idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, parent_idx, child_idx) AS rank FROM es)
SELECT mention_id, rank, parent_idx, child_idx, CAST(score AS DOUBLE) AS score FROM rk WHERE rank <= 20""")
def _(t):
    mentions = t.part.select(
        F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("mention"), F.concat_ws(" ", "p_name", "p_brand").alias("context"))
    concepts = t.concept.select("id", F.col("title").alias("text"))
    return place_mentions(mentions, concepts, t.isa, None, Settings(seeds=5, cap=20))


_PLACED = ("WITH " + _PLACE + _PLACE_RANK.format(f="f0", leaf="round((coalesce(a.sim, 0) + coalesce(b.sim, 0)) / 2, 9)", join="")).replace(
    "\nSELECT p_partkey AS mention_id", ",\npl AS (SELECT p_partkey AS mention_id")


@query("evaluate_placement", _PLACED + """),
g AS (SELECT g.mention_id, pl.rank FROM gold_edge g LEFT JOIN pl ON pl.mention_id = g.mention_id AND pl.parent_idx = g.parent_idx AND pl.child_idx = g.child_idx),
n AS (SELECT count(DISTINCT mention_id) AS n_mentions, count(*) AS n_gold FROM gold_edge),
per AS (SELECT mention_id, k, bool_or(coalesce(rank <= k, false)) AS a, bool_and(coalesce(rank <= k, false)) AS b, count(*) FILTER (rank <= k) AS tp
  FROM g CROSS JOIN (VALUES (1), (5), (20)) v(k) GROUP BY mention_id, k)
SELECT k, any_value(n_mentions) AS n_mentions, any_value(n_gold) AS n_gold, sum(tp) AS tp, sum(tp) / (any_value(n_mentions) * k) AS precision,
  sum(tp) / any_value(n_gold) AS recall, avg(CAST(a AS INT)) AS "any", avg(CAST(b AS INT)) AS "all" FROM per, n GROUP BY k""")
def _(t):
    return evaluate_placement(_place(t, enrich=False), t.gold_edge, Settings(ks=(1, 5, 20)))
