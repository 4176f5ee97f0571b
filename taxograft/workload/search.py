"""Sparse and dense search on the given tables, always over whole tables and texts."""

from pyspark.sql import functions as F

from taxograft.operators import retrieve as R
from taxograft.workload.registry import derive, query

_TOK = r"unnest(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_#]+'))"
_TF = "SELECT {i} AS id, token, count(*) AS tf FROM (SELECT {i}, " + _TOK + " AS token FROM {t}) GROUP BY ALL"
_DOC_TF = _TF.format(i="doc_id", c="text", t="documents")
_QRY_TF = "SELECT item_id AS q, token, count(*) AS qtf FROM (SELECT item_id, " + _TOK.format(c="text") + " AS token FROM benchmark) GROUP BY ALL"


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _items(t):
    return t.benchmark.select(F.col("item_id").alias("q"), "text")


@query("build_postings", f"SELECT token, id, tf FROM ({_DOC_TF})")
def _(t):
    return R.build_postings(_docs(t))


@query("document_frequency", f"SELECT token, count(*) AS df FROM ({_DOC_TF}) GROUP BY token")
def _(t):
    return R.document_frequency(R.build_postings(_docs(t)))


_RANKED = """SELECT q, rank, id, score FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}"""
_IDF = f"""WITH p AS ({_DOC_TF}), t AS ({_QRY_TF}), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT q, id, round(sum(qtf * log10((SELECT count(*) FROM documents) / df)), 9) AS score FROM t JOIN d USING (token) JOIN p USING (token)
 WHERE df < (SELECT count(*) FROM documents) GROUP BY q, id)
{_RANKED.format(k=10)}"""


@query("idf_select", _IDF)
def _(t):
    return R.idf_select(_items(t), _docs(t), 10)


@query("idf_select_pruned", _IDF)
def _(t):
    return R.idf_select(_items(t), _docs(t), 10, shard_postings=5_000, block_docs=16)


_BM25 = f"""WITH p AS ({_DOC_TF}), t AS ({_QRY_TF}), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
l AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id), z AS (SELECT count(*) AS n, avg(dl) AS m FROM l),
w AS (SELECT token, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / m)) AS pw FROM p JOIN d USING (token) JOIN l USING (id), z),
s AS (SELECT q, id, round(sum(qtf * pw), 9) AS score FROM t JOIN w USING (token) GROUP BY q, id)
{_RANKED.format(k=10)}"""


@query("bm25", _BM25)
def _(t):
    return R.bm25(_items(t), _docs(t), 10)


@query("bm25_pruned", _BM25)
def _(t):
    return R.bm25(_items(t), _docs(t), 10, shard_postings=5_000, block_docs=16)


# Searchable fields of a document: its first line, its source and the whole text.
derive("doc_field", """
SELECT doc_id AS id, 'title' AS field, split_part(text, chr(10), 1) AS text FROM documents
UNION ALL SELECT doc_id, 'alias', lang || ' ' || source FROM documents
UNION ALL SELECT doc_id, 'sentence', text FROM documents
""")
derive("doc_links", "SELECT doc_id AS id, n_chars AS n_links FROM documents")
_FIELDS = """
p AS (SELECT field, id, token, count(*) AS tf FROM (SELECT field, id, """ + _TOK.format(c="text") + """ AS token FROM doc_field) GROUP BY ALL),
d AS (SELECT field, token, count(*) AS df FROM p GROUP BY ALL), l AS (SELECT field, id, sum(tf) AS dl FROM p GROUP BY ALL),
z AS (SELECT field, count(*) AS n, avg(dl) AS m FROM l GROUP BY field),
w AS (SELECT p.field, p.token, p.id, CASE WHEN p.field = 'sentence' THEN 0.5 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / m)) AS pw
  FROM p JOIN d USING (field, token) JOIN l USING (field, id) JOIN z USING (field)),
m AS (SELECT q, id, sum(qtf * pw) AS score FROM t JOIN w USING (token) GROUP BY q, id),
s AS (SELECT q, id, round(score + log10(n_links + 1), 9) AS score FROM m JOIN doc_links USING (id))
"""
_WEIGHTS = {"title": 1.0, "alias": 1.0, "sentence": 0.5}


@query("multi_field_search", f"WITH t AS ({_QRY_TF}), {_FIELDS} {_RANKED.format(k=10)}")
def _(t):
    return R.multi_field_search(_items(t), t.doc_field, _WEIGHTS, 10, t.doc_links)


@query("multi_field_search_pruned", f"WITH t AS ({_QRY_TF}), {_FIELDS} {_RANKED.format(k=10)}")
def _(t):
    return R.multi_field_search(_items(t), t.doc_field, _WEIGHTS, 10, t.doc_links, shard_postings=5_000, block_docs=16)


_GRID_Q = "SELECT q, token, count(*) AS qtf FROM (SELECT q, " + _TOK.format(c="text") + """ AS token FROM (
  SELECT 'item#' || item_id AS q, text FROM benchmark UNION ALL SELECT 'turn#' || (conv_id * 1000 + turn), text FROM conversations)) GROUP BY ALL"""


@query("retrieval_grid", f"""WITH t AS ({_GRID_Q}), {_FIELDS}
SELECT split_part(q, '#', 1) AS setting, CAST(split_part(q, '#', 2) AS BIGINT) AS mention_id, rank, id, score FROM ({_RANKED.format(k=5)})""")
def _(t):
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), "text")
    return R.retrieval_grid({"item": _items(t), "turn": turns}, t.doc_field, _WEIGHTS, 5, t.doc_links)


derive("doc_pair", """
SELECT d.doc_id AS a, f.first_doc AS b FROM documents d JOIN (SELECT source, lang, min(doc_id) AS first_doc FROM documents GROUP BY source, lang) f
ON d.source = f.source AND d.lang = f.lang
""")


@query("concept_idf_similarity", f"""WITH p AS ({_DOC_TF}), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT a, b, sum(x.tf * log10((SELECT count(*) FROM documents) / df)) AS sim FROM doc_pair JOIN p x ON x.id = a JOIN p y ON y.id = b AND y.token = x.token JOIN d ON d.token = x.token GROUP BY a, b)
SELECT a, b, round(coalesce(sim, 0), 9) AS sim FROM doc_pair LEFT JOIN s USING (a, b)""")
def _(t):
    return R.concept_idf_similarity(t.doc_pair, _docs(t))


# ----------------------------------------------------------------------- dense
derive("vec", "SELECT vec_id, label, embedding FROM embeddings")
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_METRIC = {
    "ip": "list_dot_product(a.v, b.v)",
    "cosine": "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))",
    "l2": "-list_distance(a.v, b.v)",
}
_NN = "WITH " + _V + ", s AS (SELECT a.vec_id AS q, b.vec_id AS id, round({m}, 9) AS score FROM v a JOIN v b ON {on}) " + _RANKED.format(k=10)


def _qv(t, *extra):
    return t.vec.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"), *extra)


def _iv(t, *extra):
    return t.vec.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *extra)


_shown = lambda df: df.withColumn("score", F.col("score") + 0.0)


@query("nearest_exact", _NN.format(m=_METRIC["ip"], on="true"))
def _(t):
    return _shown(R.nearest_exact(_qv(t), _iv(t), 10))


@query("score_all", _NN.format(m=_METRIC["ip"], on="true").replace("rank <= 10", "rank <= 50"))
def _(t):
    return _shown(R.score_all(_qv(t), _iv(t), 50))


@query("nearest_exact_blocks", _NN.format(m=_METRIC["ip"], on="true"))
def _(t):
    return _shown(R.nearest_exact(_qv(t), _iv(t), 10, block_rows=200))


@query("nearest_concepts_l2", _NN.format(m=_METRIC["l2"], on="true"))
def _(t):
    return _shown(R.nearest_concepts(_qv(t), _iv(t), 10, "l2"))


@query("nearest_concepts_cosine", _NN.format(m=_METRIC["cosine"], on="true"))
def _(t):
    return _shown(R.nearest_concepts(_qv(t), _iv(t), 10, "cosine"))


@query("nearest_in_domain", _NN.format(m=_METRIC["ip"], on="a.label = b.label"))
def _(t):
    d = F.col("label").alias("domain")
    return _shown(R.nearest_in_domain(_qv(t, d), _iv(t, d), 10))


# Which neighbours an approximate search finds is no SQL; that every query gets ten different
# ones in order, each with its exact product, is.
@query("nearest_approx", """
SELECT vec_id AS q, least(10, (SELECT count(*) FROM embeddings)) AS n, least(10, (SELECT count(*) FROM embeddings)) AS n_different, true AS exact, true AS ordered FROM embeddings""")
def _(t):
    found = R.nearest_approx(_qv(t), _iv(t), 10)
    a = t.vec.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"))
    b = t.vec.select(F.col("vec_id").alias("id"), F.col("embedding").alias("y"))
    product = F.aggregate(F.zip_with("x", "y", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)
    by_rank = F.sort_array(F.collect_list(F.struct("rank", "score")))  # ten rows a query
    down = F.zip_with(F.slice("r.score", 1, 9), F.slice("r.score", 2, 9), lambda x, y: y.isNull() | (x >= y))
    return found.join(a, "q").join(b, "id").groupBy("q").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_different"),
        F.bool_and(F.abs(product - F.col("score")) < 1e-6).alias("exact"), by_rank.alias("r"),
    ).withColumn("ordered", F.forall(down, lambda x: x)).drop("r")


@query("nearest_approx_recall", "SELECT true AS recall_at_least_nine_tenths")
def _(t):
    approx = R.nearest_approx(_qv(t), _iv(t), 10)
    recall = R.recall_of(approx, R.nearest_exact(_qv(t), _iv(t), 10))
    return recall.select((F.col("recall") >= 0.9).alias("recall_at_least_nine_tenths"))


@query("complex_vectors", """
WITH u AS (SELECT DISTINCT id FROM complex_id), x AS (SELECT id, unnest(regexp_extract_all(id, '<(.*?)>', 1)) AS part FROM u),
m AS (SELECT x.id, avg(CAST(embedding[1] AS DOUBLE)) AS first, avg(CAST(embedding[64] AS DOUBLE)) AS last FROM x JOIN embeddings ON part = 'P' || vec_id GROUP BY x.id)
SELECT u.id, round(coalesce(first, 0), 6) AS first, round(coalesce(last, 0), 6) AS last FROM u LEFT JOIN m ON u.id = m.id""")
def _(t):
    vectors = t.vec.select(F.concat(F.lit("P"), "vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.complex_vectors(t.complex_id, vectors, 64).select(
        "id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(63)), 6).alias("last"))


derive("vec_edge", """
SELECT DISTINCT l_suppkey AS mention_id, 'P' || l_partkey AS parent_idx, 'P' || (l_suppkey + l_linenumber) AS child_idx FROM lineitem
""")


@query("edge_cosine_score", f"""WITH {_V},
c AS (SELECT mention_id, node, coalesce({_METRIC['cosine']}, 0) AS sim FROM (SELECT DISTINCT mention_id, parent_idx AS node FROM vec_edge UNION SELECT mention_id, child_idx FROM vec_edge)
  JOIN v a ON a.vec_id = mention_id JOIN v b ON 'P' || b.vec_id = node)
SELECT e.*, round((coalesce(x.sim, 0) + coalesce(y.sim, 0)) / 2, 9) AS score FROM vec_edge e
LEFT JOIN c x ON x.mention_id = e.mention_id AND x.node = parent_idx LEFT JOIN c y ON y.mention_id = e.mention_id AND y.node = child_idx""")
def _(t):
    vectors = t.vec.select(F.concat(F.lit("P"), "vec_id").alias("id"), F.col("embedding").alias("vector"))
    mv = t.vec.select(F.col("vec_id").alias("mention_id"), F.col("embedding").alias("vector"))
    return R.edge_cosine_score(t.vec_edge, vectors, mv)


derive("text_edge", """
SELECT DISTINCT l_partkey AS mention_id, 'S' || l_suppkey AS parent_idx, 'P' || l_partkey AS child_idx FROM lineitem
UNION SELECT p_partkey, 'T:' || p_type, 'NULL' FROM part
UNION SELECT l_partkey, 'P' || l_suppkey, 'P' || l_linenumber FROM lineitem
""")
_TITLE_TF = _TF.format(i="id", c="title", t="concept")


@query("edge_idf_score", f"""WITH p AS ({_TITLE_TF}), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
t AS (SELECT p_partkey AS q, token, count(*) AS qtf FROM (SELECT p_partkey, {_TOK.format(c='p_name')} AS token FROM part) GROUP BY ALL),
w AS (SELECT q, token, qtf * log10((SELECT count(DISTINCT id) FROM concept) / df) AS w FROM t JOIN d USING (token)),
n AS (SELECT DISTINCT mention_id AS q, parent_idx AS id FROM text_edge UNION SELECT mention_id, child_idx FROM text_edge),
s AS (SELECT n.q, n.id, sum(w) AS sim FROM n JOIN p ON p.id = n.id JOIN w ON w.q = n.q AND w.token = p.token GROUP BY ALL)
SELECT e.*, round((coalesce(x.sim, 0) + coalesce(y.sim, 0)) / 2, 9) AS score FROM text_edge e
LEFT JOIN s x ON x.q = e.mention_id AND x.id = parent_idx LEFT JOIN s y ON y.q = e.mention_id AND y.id = child_idx""")
def _(t):
    mentions = t.part.select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("mention"))
    return R.edge_idf_score(t.text_edge, mentions, t.concept.select("id", F.col("title").alias("text")))


@query("encode_ngrams", """
SELECT p_partkey AS id, length(p_name) AS n_grams FROM part""")
def _(t):
    v = R.encode(t.part.select(F.col("p_partkey").alias("id"), "p_name"), "p_name")
    return v.select("id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_grams"))


@query("encode_hook", "SELECT conv_id, turn, length(text) AS len, len(string_split(text, ' ')) AS words FROM conversations")
def _(t):
    def lengths(texts):
        return [[len(x), len(x.split(" "))] for x in texts]

    v = R.encode(t.conversations.select("conv_id", "turn", "text"), "text", lengths)
    return v.select("conv_id", "turn", F.get("vector", F.lit(0)).cast("long").alias("len"), F.get("vector", F.lit(1)).cast("long").alias("words"))


@query("score_hook", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * (1 - l_discount), 6) AS score FROM lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    out = R.score_with(df, lambda q, d: q * (1 - d), ["l_quantity", "l_discount"])
    return out.drop("l_quantity", "l_discount").withColumn("score", F.round("score", 6))


@query("blend", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * l_discount + 0.5 * l_tax, 9) AS score FROM lineitem")
def _(t):
    from taxograft.functions.arrays import blend

    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(blend("l_discount", "l_tax"), 9).alias("score"))
