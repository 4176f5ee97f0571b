"""Mention construction on the given tables."""

from pyspark.sql import functions as F

from taxograft.operators import graph as G
from taxograft.operators import mentions as M
from taxograft.operators.detect import detect_mentions
from taxograft.workload.registry import derive, query

derive("newer", """
SELECT c.id FROM concept c LEFT JOIN part p ON c.id = 'P' || p.p_partkey WHERE coalesce(p.p_size, 0) <= 40
""")
derive("classified", """
SELECT m.mention_id, m.doc_id, m.mention, m.context_left, m.context_right, m.split, m.label_concept AS label_concept_ori,
  CASE WHEN r.id IS NULL THEN 'NIL' ELSE m.label_concept END AS label_concept, r.id IS NULL AS is_nil
FROM mention m LEFT JOIN retained r ON m.label_concept = r.id LEFT JOIN newer n ON m.label_concept = n.id
WHERE r.id IS NOT NULL OR n.id IS NOT NULL
""", stored=True)


@query("map_annotations", """
SELECT mention_id, label_concept AS cui, parent_id AS concept FROM mention JOIN isa ON child_id = label_concept""")
def _(t):
    m = t.mention.select("mention_id", F.col("label_concept").alias("cui"))
    return M.map_annotations(m, t.isa.select(F.col("child_id").alias("cui"), F.col("parent_id").alias("concept")))


@query("classify_by_version", "SELECT mention_id, label_concept, label_concept_ori, is_nil FROM classified")
def _(t):
    return M.classify_by_version(t.mention, t.retained, t.newer).select("mention_id", "label_concept", "label_concept_ori", "is_nil")


_ROWS = """SELECT idx, title, row_number() OVER (ORDER BY idx, ord) - 1 AS local_id FROM (
  SELECT 'P' || p_partkey AS idx, 0 AS ord, p_name AS title FROM part
  UNION ALL SELECT 'P' || p_partkey, 1, p_brand || ' ' || p_name FROM part)"""


def _rows(t):
    from taxograft.operators.catalogue import local_ids

    p = F.concat(F.lit("P"), "p_partkey").alias("idx")
    rows = t.part.select(p, F.lit(0).alias("ord"), F.col("p_name").alias("title")).unionByName(
        t.part.select(p, F.lit(1).alias("ord"), F.concat_ws(" ", "p_brand", "p_name").alias("title")))
    return local_ids(rows, ["idx", "ord"])


@query("attach_label_first", f"""
SELECT mention_id, min(local_id) AS label_id, arg_min(title, local_id) AS label_title
FROM mention JOIN ({_ROWS}) ON idx = label_concept GROUP BY mention_id""")
def _(t):
    return M.attach_label(t.mention, _rows(t)).select("mention_id", "label_id", "label_title")


@query("attach_label_all", f"""
SELECT mention_id, local_id AS label_id, title AS label_title FROM mention JOIN ({_ROWS}) ON idx = label_concept""")
def _(t):
    return M.attach_label(t.mention, _rows(t), all_rows=True).select("mention_id", "label_id", "label_title")


# Gold paths of a part: its type and its brand over the null node.
derive("gold_path", "SELECT child_id AS id, parent_id AS parent, 'NULL' AS child FROM isa WHERE left(child_id, 1) = 'P'")
derive("known_edge", "SELECT parent_idx, child_idx, degree FROM edge WHERE parent NOT LIKE 'Brand#1%' AND parent NOT LIKE 'S%'")


@query("explode_gold_edges", """
SELECT mention_id, parent_idx, child_idx, degree FROM classified JOIN gold_path ON id = label_concept_ori
JOIN known_edge ON parent_idx = parent AND child_idx = child""")
def _(t):
    pairs, _ = M.explode_gold_edges(t.classified, t.gold_path, t.known_edge)
    return pairs.select("mention_id", "parent_idx", "child_idx", "degree")


_DROPPED = """SELECT c.* FROM classified c WHERE label_concept_ori NOT IN (
  SELECT id FROM gold_path JOIN known_edge ON parent_idx = parent AND child_idx = child)"""


@query("explode_gold_edges_dropped", f"SELECT mention_id, label_concept_ori FROM ({_DROPPED})")
def _(t):
    _, dropped = M.explode_gold_edges(t.classified, t.gold_path, t.known_edge)
    return dropped.select("mention_id", "label_concept_ori")


@query("remove_filtered", f"""
SELECT mention_id FROM classified WHERE (mention, context_left, context_right, label_concept_ori) NOT IN (
  SELECT (mention, context_left, context_right, label_concept_ori) FROM ({_DROPPED}))""")
def _(t):
    _, dropped = M.explode_gold_edges(t.classified, t.gold_path, t.known_edge)
    return M.remove_filtered(t.classified, dropped).select("mention_id")


@query("distinct_mentions", "SELECT DISTINCT mention, context_left, context_right, label_concept_ori FROM classified")
def _(t):
    return M.distinct_mentions(t.classified)


@query("drop_repeats", """
SELECT mention, context_left, min(mention_id) AS mention_id FROM mention GROUP BY mention, context_left""")
def _(t):
    return M.drop_repeats(t.mention.select("mention", "context_left", "mention_id"), ["mention", "context_left"], ["mention_id"])


@query("nil_frequency", """
SELECT split, label_concept_ori, count(*) AS n FROM classified WHERE is_nil GROUP BY split, label_concept_ori
UNION ALL SELECT NULL, label_concept_ori, count(*) FROM classified WHERE is_nil GROUP BY label_concept_ori""")
def _(t):
    return M.nil_frequency(t.classified)


@query("nil_totals", """
SELECT split, count(DISTINCT label_concept_ori) AS n_concepts, count(*) AS n_rows FROM classified WHERE is_nil GROUP BY split
UNION ALL SELECT NULL, count(DISTINCT label_concept_ori), count(*) FROM classified WHERE is_nil""")
def _(t):
    return M.nil_totals(t.classified)


@query("discovered", """
SELECT label_concept_ori, arg_max(mention, mention_id) AS example, count(*) AS n FROM classified WHERE is_nil GROUP BY label_concept_ori""")
def _(t):
    return M.discovered(t.classified, "mention_id")


@query("count_nil", "SELECT count(*) AS n_nil FROM classified WHERE label_concept = 'NIL'")
def _(t):
    return M.count_nil(t.classified)


@query("recompose_splits", """
SELECT final_split, count(*) AS n, sum(mention_id) AS check_sum FROM classified
JOIN (VALUES ('train', false, 'train'), ('train', false, 'train-all'), ('valid', false, 'valid'), ('valid', false, 'train-all'),
  ('test', false, 'test-in-KB'), ('test', false, 'train-all'), ('test', false, 'test'),
  ('train', true, 'valid-NIL'), ('train', true, 'test-NIL-all'), ('train', true, 'test'),
  ('valid', true, 'test-NIL'), ('valid', true, 'test-NIL-all'), ('valid', true, 'test'),
  ('test', true, 'test-NIL'), ('test', true, 'test-NIL-all'), ('test', true, 'test')) v(s, nil, final_split)
ON split = s AND is_nil = nil GROUP BY final_split""")
def _(t):
    out = M.recompose_splits(t.classified).groupBy("final_split")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("mention_id").alias("check_sum"))


# Spans: the middle sixth of every document.
derive("span", """
SELECT doc_id, CAST(floor(length(text) / 2) AS INT) AS start, CAST(floor(length(text) / 2) + floor(length(text) / 6) AS INT) AS stop FROM documents
""")


@query("context_window", """
SELECT doc_id, array_to_string(l[greatest(1, len(l) - 63):], ' ') AS context_left, mention, array_to_string(r[:64], ' ') AS context_right FROM (
  SELECT doc_id, list_filter(string_split(text[:start], ' '), lambda x: x <> '') AS l, text[start + 1 : stop] AS mention,
    list_filter(string_split(text[stop + 1:], ' '), lambda x: x <> '') AS r FROM documents JOIN span USING (doc_id))""")
def _(t):
    spans = t.span.withColumnRenamed("stop", "end")
    return M.context_window(t.documents, spans, 128).select("doc_id", "context_left", "mention", "context_right")


@query("query_contexts", """
SELECT doc_id, concat_ws(' ', array_to_string(l[greatest(1, len(l) - 9):], ' '), mention, array_to_string(r[:10], ' ')) AS query_10,
  concat_ws(' ', array_to_string(l[greatest(1, len(l) - 24):], ' '), mention, array_to_string(r[:25], ' ')) AS query_25 FROM (
  SELECT doc_id, list_filter(string_split(text[:start], ' '), lambda x: x <> '') AS l, text[start + 1 : stop] AS mention,
    list_filter(string_split(text[stop + 1:], ' '), lambda x: x <> '') AS r FROM documents JOIN span USING (doc_id))""")
def _(t):
    d = t.documents.join(t.span, "doc_id").select(
        "doc_id", F.substring(F.col("text"), F.lit(1), F.col("start")).alias("context_left"),
        F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")).alias("mention"),
        F.substring(F.col("text"), F.col("stop") + 1, F.length("text")).alias("context_right"))
    return M.query_contexts(d).select("doc_id", "query_10", "query_25")


@query("sentence_context", """
SELECT conv_id AS doc_id, turn AS sent_id, text, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t):
    return M.sentence_context(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "text"))


@query("sentence_mentions", """
SELECT conv_id AS doc_id, turn AS sent_id, mention FROM conversations LEFT JOIN
 (SELECT conv_id AS d, turn AS s, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS mention FROM conversations) ON d = conv_id AND s = turn""")
def _(t):
    s = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "text")
    m = s.select("doc_id", "sent_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1)).alias("mention"))
    return M.sentence_mentions(s, m).select("doc_id", "sent_id", "mention")


@query("rejoin_mentions", """
SELECT m.mention_id, mention, l_suppkey AS cand_id FROM mention m JOIN lineitem ON m.mention_id = l_orderkey * 10 + l_linenumber""")
def _(t):
    c = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"), F.col("l_suppkey").alias("cand_id"))
    return M.rejoin_mentions(c, t.mention.select("mention_id", "mention"))


@query("lower_mentions", """
SELECT mention_id, lower(mention) AS mention, lower(context_left) AS context_left, lower(context_right) AS context_right FROM mention""")
def _(t):
    return M.lower_mentions(t.mention.select("mention_id", "mention", "context_left", "context_right"))


@query("head", "SELECT mention_id, mention FROM mention ORDER BY mention_id LIMIT 50")
def _(t):
    return M.head(t.mention.select("mention_id", "mention"), 50, "mention_id")


@query("sample_n", "SELECT mention_id FROM mention ORDER BY md5(mention_id || chr(1) || '1234'), mention_id LIMIT 100")
def _(t):
    return M.sample_n(t.mention.select("mention_id"), 100, "mention_id")


_PRUNE = """SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(id || chr(1) || '1234'), id) AS r, count(*) OVER () AS n
 FROM (SELECT DISTINCT id FROM concept)) WHERE r {op} floor(n * 0.2)"""


@query("prune_kept", _PRUNE.format(op=">"))
def _(t):
    return M.prune(t.concept, 0.2)[0]


@query("prune_deleted", _PRUNE.format(op="<="))
def _(t):
    return M.prune(t.concept, 0.2)[1]


@query("complement", "SELECT id FROM concept WHERE id NOT IN (SELECT id FROM retained)")
def _(t):
    return M.complement(t.concept, t.retained)


# Names to find: the words that benchmark items begin and end with, as a dictionary.
derive("name_dict", r"""
SELECT DISTINCT lower(regexp_extract(text, '^([^ ]+ [^ ]+)', 1)) AS name, 'I' || item_id AS id FROM benchmark
UNION SELECT DISTINCT lower(regexp_extract(text, '([^ ]+)$', 1)), 'L' || item_id FROM benchmark
""")


@query("detect_mentions", r"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM w),
r AS (SELECT conv_id, turn, i - 1 AS start_word, 1 AS n_words, w[i] AS mention FROM p
  UNION ALL SELECT conv_id, turn, i - 1, 2, w[i] || ' ' || w[i + 1] FROM p WHERE i < len(w))
SELECT conv_id AS doc_id, turn AS sent_id, start_word, n_words, mention, id FROM r JOIN name_dict ON name = mention""")
def _(t):
    s = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "text")
    return detect_mentions(s, t.name_dict)
