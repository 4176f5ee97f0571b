"""String, array and prompt expressions on the given tables."""

from pyspark.sql import functions as F

from taxograft.functions import arrays as A
from taxograft.functions import prompts as P
from taxograft.functions import text as X
from taxograft.operators import evaluate as E
from taxograft.operators import prompting as R
from taxograft.workload.registry import derive, query

derive("name_variant", """
SELECT p_partkey AS id, '[X]' || p_name || ' (' || p_type || ')' AS name FROM part
UNION ALL SELECT p_partkey, upper(p_name) || ', NOS' FROM part
UNION ALL SELECT p_partkey, '[ambiguous] diagnosis ' || p_brand || ' unspecified' FROM part
UNION ALL SELECT p_partkey, p_name || '-RETIRED-' || p_size FROM part
UNION ALL SELECT p_partkey, 'NOS' FROM part
""")
_CLEAN = """
SELECT id, name, CASE WHEN s4 = '' THEN NULL ELSE s4 END AS cleaned FROM (
SELECT id, name, regexp_replace(trim({vague}), ',$', '') AS s4 FROM (
SELECT id, name, split_part(s2, '-retired', 1) AS s3 FROM (
SELECT id, name, CASE WHEN s1 LIKE '%)' THEN trim(regexp_replace(s1, '\\([^(]*$', '')) ELSE s1 END AS s2 FROM (
SELECT id, name, regexp_replace(trim(replace(lower(name), '[ambiguous]', '')), '^\\[[^\\]]\\]', '') AS s1 FROM name_variant))))
"""


@query("clean_synonym", _CLEAN.format(vague="regexp_replace(regexp_replace(s3, '\\bunspecified\\b', '', 'g'), '\\bnos\\b', '', 'g')"))
def _(t):
    return t.name_variant.select("id", "name", X.clean_synonym("name").alias("cleaned"))


@query("clean_synonym_compat", _CLEAN.format(vague="replace(replace(s3, 'unspecified', ''), 'nos', '')"))
def _(t):
    return t.name_variant.select("id", "name", X.clean_synonym("name", compat=True).alias("cleaned"))


@query("escape_query", r"""
SELECT conv_id, turn, regexp_replace(q, '([&|+\-!(){}\[\]/^"~*?:])', '\\\1', 'g') AS escaped FROM (
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'and ' ELSE 'x or ' END || replace(text, '\', '') || ' or' AS q FROM conversations)""")
def _(t):
    q = F.concat(F.when(F.col("role") == "user", "AND ").otherwise("x OR "), F.replace("text", F.lit("\\"), F.lit("")), F.lit(" OR"))
    return t.conversations.select("conv_id", "turn", X.escape_query(q).alias("escaped"))


@query("first_sentences", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
j AS (SELECT doc_id, trim(string_agg(trim(line), ' ' ORDER BY n)) AS body FROM l WHERE n > 1 AND line <> '' AND line NOT LIKE 'Section::%' GROUP BY doc_id),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:10] AS s FROM j)
SELECT d.doc_id, coalesce(len(s), 0) AS n, coalesce(array_to_string(s, '|'), '') AS sentences FROM documents d LEFT JOIN s USING (doc_id)""")
def _(t):
    first = X.first_sentences(F.split("text", "\n"))
    return t.documents.select("doc_id", F.size(first).alias("n"), F.array_join(first, "|").alias("sentences"))


@query("tokenize", r"""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_#]+')) AS token FROM documents) GROUP BY token""")
def _(t):
    return t.documents.select(F.explode(X.tokenize("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# Every document is cut at its middle; the two words there become the mention.
def _middle(t):
    w = F.split("text", " ")
    m = F.floor(F.size(w) / 2).cast("int")
    return t.documents.select(
        "doc_id", F.slice(w, F.lit(1), m).alias("left"), F.slice(w, m + 1, F.lit(2)).alias("mention"),
        F.slice(w, m + 3, F.size(w)).alias("right"))


_MID = """
WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
e AS (SELECT doc_id, w[:len(w) // 2] AS l, w[len(w) // 2 + 1 : len(w) // 2 + 2] AS m, w[len(w) // 2 + 3 :] AS r FROM d)
"""


@query("budget_window", _MID + """,
q AS (SELECT doc_id, l, m, r, len(l) AS nl, len(m) AS nm, len(r) AS nr, (32 - len(m)) // 2 - 1 AS lh, 32 - len(m) - ((32 - len(m)) // 2 - 1) - 2 AS rh FROM e),
z AS (SELECT *, CASE WHEN nl > lh AND nr <= rh THEN lh + rh - nr ELSE lh END AS lq, CASE WHEN nl <= lh AND nr > rh THEN rh + lh - nl ELSE rh END AS rq FROM q)
SELECT doc_id, array_to_string(list_concat(list_concat(l[greatest(1, nl - lq + 1):], m), r[:least(rq, nr)]), ' ') AS win FROM z""")
def _(t):
    win = X.budget_window(F.col("left"), F.col("mention"), F.col("right"), 32)
    return _middle(t).select("doc_id", F.array_join(win, " ").alias("win"))


@query("truncate_pair", _MID + """,
k AS (SELECT doc_id, l, r, least(len(l), greatest(21, 41 - len(r))) AS ka FROM e)
SELECT doc_id, array_to_string(CASE WHEN len(l) + len(r) > 41 THEN l[:ka] ELSE l END, ' ') AS a,
       array_to_string(CASE WHEN len(l) + len(r) > 41 THEN r[:41 - ka] ELSE r END, ' ') AS b FROM k""")
def _(t):
    cut = X.truncate_pair(F.col("left"), F.col("right"), 41)
    return _middle(t).select("doc_id", F.array_join(cut["a"], " ").alias("a"), F.array_join(cut["b"], " ").alias("b"))


@query("pair_sequence", _MID + """
SELECT doc_id, array_to_string(list_concat(l, r[2:])[:50], ' ') AS seq FROM e""")
def _(t):
    return _middle(t).select("doc_id", F.array_join(X.pair_sequence(F.col("left"), F.col("right"), 50), " ").alias("seq"))


@query("candidate_text", """
SELECT p_partkey AS id, array_to_string(list_filter(string_split(p_name || ' [TITLE] ' || p_brand || ' ' || p_name || ' [SYN] ' || p_type || ' [SYN] size ' || p_size, ' '), lambda x: x <> '')[:8], ' ') AS tokens FROM part""")
def _(t):
    syn = F.array(F.concat_ws(" ", "p_brand", "p_name"), F.col("p_type"))
    text = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(X.candidate_text(F.col("p_name"), syn, text, 10), " ").alias("tokens"))


@query("edge_candidate_text", """
SELECT parent_idx, child_idx, array_to_string(string_split(
  CASE WHEN parent_idx = 'THING' THEN '[TOP]' ELSE parent END || ' [PARENT] ' ||
  CASE WHEN child_idx = 'NULL' THEN '[BOTTOM]' ELSE child END || ' [CHILD] [TITLE]', ' ')[:6], ' ') AS tokens FROM edge""")
def _(t):
    p = F.when(F.col("parent_idx") == "THING", F.lit("THING")).otherwise(F.col("parent"))
    return t.edge.select("parent_idx", "child_idx", F.array_join(X.edge_candidate_text(p, F.col("child"), 8), " ").alias("tokens"))


@query("short_context", _MID + """
SELECT doc_id, concat_ws(' ', array_to_string(lf[greatest(1, len(lf) - 4):], ' '), array_to_string(m, ' '), array_to_string(rf[:5], ' ')) AS q
FROM (SELECT doc_id, m, list_filter(l, lambda x: x <> '') AS lf, list_filter(r, lambda x: x <> '') AS rf FROM e)""")
def _(t):
    j = lambda c: F.array_join(c, " ")
    return _middle(t).select("doc_id", X.short_context(j("left"), j("mention"), j("right"), 5).alias("q"))


@query("contains_run", """
WITH a AS (SELECT conv_id, turn, ' ' || text || ' ' AS hay, text FROM conversations),
b AS (SELECT conv_id, turn, string_split(text, ' ')[2:3] AS needle FROM conversations)
SELECT a.conv_id, a.turn, contains(hay, ' ' || array_to_string(needle, ' ') || ' ') OR len(needle) = 0 AS inside
FROM a JOIN b ON a.conv_id = b.conv_id AND b.turn = 0""")
def _(t):
    w = F.split("text", " ")
    first = t.conversations.where("turn = 0").select("conv_id", F.slice(w, 2, 2).alias("needle"))
    return t.conversations.join(first, "conv_id").select(
        "conv_id", "turn", A.contains_run(F.col("needle"), w).alias("inside"))


@query("list_set_functions", """
SELECT conv_id, turn, len(list_distinct(list_concat(a, b))) AS n_union, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) + len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS diff_both,
       len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS diff_one,
       round(len(list_filter(list_distinct(a), lambda x: list_contains(b, x))) / len(list_distinct(list_concat(a, b))), 9) AS jac
FROM (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lower(text), ' ') AS b FROM conversations)""")
def _(t):
    a, b = F.split("text", " "), F.split(F.lower("text"), " ")
    return t.conversations.select(
        "conv_id", "turn", F.size(A.list_union(a, b)).alias("n_union"), A.diff_size(a, b).alias("diff_both"),
        A.diff_size(a, b, both=False).alias("diff_one"), F.round(A.jaccard(a, b), 9).alias("jac"))


@query("vector_functions", """
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, w), 6) AS with_reverse,
       round(list_dot_product(v, w) / list_dot_product(v, v), 6) AS cos_reverse, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_unit
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS w FROM embeddings)""")
def _(t):
    v, w = F.col("embedding"), F.reverse("embedding")
    return t.embeddings.select(
        "vec_id", F.round(A.norm(v), 6).alias("norm"), F.round(A.dot(v, w), 6).alias("with_reverse"),
        F.round(A.cosine(v, w), 6).alias("cos_reverse"), F.round(F.get(A.unit(v), F.lit(0)), 6).alias("first_unit"))


@query("pad_to", """
SELECT conv_id, turn, array_to_string(list_concat(w, list_resize(CAST([] AS VARCHAR[]), 8, '-1'))[:8], ' ') AS padded
FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)""")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(A.pad_to(F.split("text", " "), 8, "-1"), " ").alias("padded"))


@query("multi_hot", """
SELECT o_orderkey, array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN list_contains(p, i) THEN 1 ELSE 0 END), '') AS hot
FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber) AS p FROM lineitem GROUP BY l_orderkey)""")
def _(t):
    # a line number is one of seven, so the set is bounded
    pos = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("p"))
    return pos.select("o_orderkey", F.array_join(A.multi_hot("p", 8), "").alias("hot"))


@query("f1_and_decide", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE 2 * l_discount * l_tax / (l_discount + l_tax) END, 9) AS f1,
       CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS yes FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(A.f1("l_discount", "l_tax"), 9).alias("f1"),
        A.decide(F.col("l_quantity") - 25).alias("yes"))


@query("span_context", """
SELECT conv_id, turn, trim(text[:s]) AS l, trim(text[s + 6:]) AS r FROM (SELECT conv_id, turn, text, CAST(floor(length(text) / 2) AS INT) AS s FROM conversations)""")
def _(t):
    s = F.floor(F.length("text") / 2).cast("int")
    l, r = X.span_context(F.col("text"), s, s + 5)
    return t.conversations.select("conv_id", "turn", l.alias("l"), r.alias("r"))


@query("annotated_text", """
SELECT l_orderkey, l_linenumber, l_partkey, p_name || ' (' || l_linenumber || ', ' || p_size || ') - ' ||
  CASE WHEN l_returnflag = 'A' THEN 'No candidate selected' ELSE s_name || format(' (conf. {:.5f})', l_quantity / 64) END AS line
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    cand = F.when(F.col("l_returnflag") != "A", F.col("s_name"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", X.annotated_text(
        F.col("p_name"), F.col("l_linenumber"), F.col("p_size"), cand, F.col("l_quantity") / 64).alias("line"))


@query("decode_href", r"""
SELECT page_id, pos, raw, CASE WHEN regexp_matches(raw, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN raw ELSE url_decode(raw) END AS href
FROM (SELECT page_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS raw FROM (
  SELECT page_id, list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: url_encode(x)) AS m FROM pages))""")
def _(t):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return t.pages.select("page_id", F.posexplode(hrefs).alias("pos", "h")).select(
        "page_id", "pos", F.replace(F.url_encode("h"), F.lit("+"), F.lit("%20")).alias("raw")
    ).select("page_id", "pos", F.replace("raw", F.lit("*"), F.lit("%2A")).alias("raw")).select(
        "page_id", "pos", F.replace("raw", F.lit("%7E"), F.lit("~")).alias("raw")).withColumn("href", X.decode_href("raw"))


@query("edge_text", """
SELECT parent_idx, child_idx, parent || ' (' || parent_idx || ') -> ' || child || ' (' || child_idx || '), degree ' || degree AS with_degree,
       parent || ' (' || parent_idx || ') -> ' || child || ' (' || child_idx || ')' AS plain FROM edge""")
def _(t):
    return t.edge.select(
        "parent_idx", "child_idx", P.edge_text("parent", "parent_idx", "child", "child_idx", "degree").alias("with_degree"),
        P.edge_text("parent", "parent_idx", "child", "child_idx").alias("plain"))


_PAIR = "'Considering ' || {m} || ' (marked with asterisk) in the context below: \"' || {l} || ' *' || {m} || '* ' || {r} || '\" Is ' || {m} || ' a {rel} of ' || {o} || '? Please answer briefly with yes or no.'"
_ask = lambda rel, o: _PAIR.format(m="mention", l="context_left", r="context_right", rel=rel, o=o)


@query("pair_prompts", f"""
SELECT mention_id, {_ask('child', 'p_brand')} AS ask_parent, CASE WHEN p_size > 25 THEN '' ELSE {_ask('parent', 'p_type')} END AS ask_child
FROM mention JOIN part ON label_concept = 'P' || p_partkey""")
def _(t):
    m = t.mention.join(t.part, F.col("label_concept") == F.concat(F.lit("P"), "p_partkey"))
    child = F.when(F.col("p_size") > 25, F.lit("NULL")).otherwise(F.col("p_type"))
    a, b = P.pair_prompts("mention", "context_left", "context_right", "p_brand", child)
    return m.select("mention_id", a.alias("ask_parent"), b.alias("ask_child"))


_EDGE_Q = P.EDGE_QUESTION.replace("{null}", "NULL")
# Options of a part's question: its type, its brand and its type again over the null node.
derive("option_row", """
SELECT p_partkey, p_name, p_brand, p_type, p_size,
  p_type || ' (' || p_partkey || ') -> ' || p_brand || ' (NULL)' AS o0,
  p_brand || ' (' || p_size || ') -> NULL (NULL)' AS o1, p_type || ' (' || p_partkey || ') -> NULL (NULL)' AS o2 FROM part
""")
_EDGE_P = f"'{_EDGE_Q}' || chr(10) || chr(10) || 'context_left:' || chr(10) || p_brand || chr(10) || chr(10) || 'mention:' || chr(10) || p_name || chr(10) || chr(10) || 'context_right:' || chr(10) || p_type || chr(10) || chr(10) || 'options:' || chr(10) || '0.' || o0 || chr(10) || '1.' || o1 || chr(10) || '2.' || o2"
_JOINED_Q = _EDGE_Q.replace(*P.WORDING).replace(*P.JOINED_TASK).replace(" (NULL)", "")
_JOINED_P = f"'{_JOINED_Q}' || chr(10) || chr(10) || 'mention in context:' || chr(10) || p_brand || '*' || p_name || '*' || p_type || chr(10) || chr(10) || 'options:' || chr(10) || '0.' || p_type || ' -> ' || p_brand || chr(10) || '1.' || p_brand || ' -> NULL' || chr(10) || '2.' || p_type || ' -> NULL'"


def _prompt(t):
    return t.option_row.select("*", P.edge_prompt("p_name", "p_brand", "p_type", F.array("o0", "o1", "o2")).alias("prompt"))


@query("edge_prompt", f"SELECT p_partkey, {_EDGE_P} AS prompt FROM option_row")
def _(t):
    return _prompt(t).select("p_partkey", "prompt")


@query("rewrite_prompt", f"SELECT p_partkey, {_JOINED_P} AS prompt FROM option_row")
def _(t):
    return _prompt(t).select("p_partkey", P.rewrite_prompt("prompt").alias("prompt"))


@query("marked_mention", "SELECT p_partkey, p_name AS mention FROM part")
def _(t):
    return _prompt(t).select("p_partkey", P.marked_mention(
        F.substring_index(P.rewrite_prompt("prompt"), "mention in context:", -1)).alias("mention"))


@query("parse_prompt", """
SELECT p_partkey, p_name AS mention, CASE WHEN p_size > 25 THEN '0,1' ELSE '2' END AS gold, p_type || '|' || p_brand AS parents,
  CASE WHEN p_size > 25 THEN p_type || '|' || p_brand ELSE p_type END AS gold_parents,
  CASE WHEN p_size > 25 THEN '0,2,1' ELSE '0,2' END AS narrowed,
  p_brand || '|NULL' AS children, CASE WHEN p_size > 25 THEN p_brand || '|NULL' ELSE 'NULL' END AS gold_children FROM part""")
def _(t):
    answer = F.when(F.col("p_size") > 25, "0,1").otherwise("2")
    said = _prompt(t).select("p_partkey", P.parse_prompt(P.rewrite_prompt("prompt"), answer).alias("s"))
    j = lambda c, sep="|": F.array_join(f"s.{c}", sep).alias(c)
    return said.select(
        "p_partkey", "s.mention", j("gold", ","), j("parents"), j("gold_parents"), j("narrowed", ","), j("children"), j("gold_children"))


@query("order_answer", """
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort([l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)]), ',') AS ordered FROM lineitem""")
def _(t):
    s = F.concat_ws(",", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", P.order_answer(s).alias("ordered"))


@query("instruction", f"""
SELECT p_partkey, '### Input:' || chr(10) || {_JOINED_P} || chr(10) || chr(10) || '### Response:' || chr(10) || '0,1' || chr(10) AS plain,
 '### Input:' || chr(10) || {_JOINED_P} || chr(10) || chr(10) || '### Explanation:' || chr(10) ||
 'From the parents in the options above, including ' || p_type || ', ' || p_brand || ', the correct parents of the mention, ' || p_name || ', include ' || p_type || ', ' || p_brand || '. Thus the options are narrowed down to 0, 2, 1. From the children in the narrowed options, including ' || p_brand || ', NULL, the correct children of the mention, ' || p_name || ', include ' || p_brand || ', NULL. Thus, the final answers are 0, 1.'
 || chr(10) || chr(10) || '### Response:' || chr(10) || '0,1' || chr(10) AS reasoned,
 '### Input:' || chr(10) || {_JOINED_P} || chr(10) || chr(10) || '### Explanation:' || chr(10) AS asked FROM option_row""")
def _(t):
    q = P.rewrite_prompt("prompt")
    return _prompt(t).select(
        "p_partkey", P.instruction(q, F.lit("1,0")).alias("plain"), P.instruction(q, F.lit("1,0"), reasoning=True).alias("reasoned"),
        P.inference_prompt(q, reasoning=True).alias("asked"))


# Answers as a model would phrase them, made of the values of a shipped line.
derive("answer_text", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  CASE WHEN l_returnflag = 'A' THEN l_linenumber || '.a -> b, ' || l_suppkey
       WHEN l_returnflag = 'N' THEN 'A ' || l_linenumber || ', ' || l_suppkey || ' or ' || l_linenumber
       ELSE 'None of them, ' || l_suppkey END AS said FROM lineitem
""")
_NUMS = """CASE WHEN l_returnflag = 'R' THEN {none} WHEN l_linenumber = l_suppkey THEN CAST(l_linenumber AS VARCHAR)
 WHEN l_returnflag = 'A' THEN l_linenumber || ',' || l_suppkey ELSE l_linenumber || ',' || l_suppkey END"""


@query("parse_answer", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_NUMS.format(none=chr(39) * 2)} AS nums FROM answer_text")
def _(t):
    return t.answer_text.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(P.parse_answer("said"), ",").alias("nums"))


@query("parse_answer_marked", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_NUMS.format(none='CAST(l_suppkey AS VARCHAR)')} AS nums FROM answer_text")
def _(t):
    gen = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("1,2 ### Response:\n"), "said", F.lit("</s>"))).otherwise(
        F.concat(F.lit("7 so the final answers are "), "said"))
    return t.answer_text.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(P.parse_answer_marked(gen), ",").alias("nums"))


@query("parse_answer_affix", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN '' ELSE said END AS core FROM answer_text""")
def _(t):
    return t.answer_text.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                P.parse_answer_affix(F.concat(F.lit("<pad> "), "said", F.lit("</s>"))).alias("core"))


@query("clean_answers", """
SELECT p_partkey, CASE WHEN p_size <= 30 THEN '2' ELSE '0,1' END AS answer FROM part WHERE p_size > 10""")
def _(t):
    a = F.when(F.col("p_size") <= 10, "-1").when(F.col("p_size") <= 30, "-1,2,-1").otherwise("0,1")
    return P.clean_answers(t.part.select("p_partkey", a.alias("answer")))


@query("answer_metrics", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  CASE WHEN l_returnflag = 'R' THEN [] WHEN l_linenumber = l_suppkey THEN [l_suppkey] ELSE [CAST(l_linenumber AS BIGINT), l_suppkey] END AS p,
  CASE WHEN l_quantity < 5 THEN [-1] WHEN l_quantity < 9 THEN [] WHEN l_linestatus = 'F' THEN [l_suppkey] ELSE [l_suppkey, CAST(l_linenumber AS BIGINT)] END AS g, l_quantity >= 9 AS ok FROM lineitem)
SELECT count(*) AS n_mentions, avg(CASE WHEN ok AND len(p) > 0 THEN len(p) END) AS mean_answers,
  avg(CAST(ok AND list_has_any(p[:1], g) AS INT)) AS any_1, avg(CAST(ok AND list_has_all(p[:1], g) AS INT)) AS all_1,
  avg(CAST(ok AND list_has_any(p[:3], g) AS INT)) AS any_3, avg(CAST(ok AND list_has_all(p[:3], g) AS INT)) AS all_3,
  avg(CAST(ok AND list_has_any(p, g) AS INT)) AS any_full, avg(CAST(ok AND list_has_all(p, g) AS INT)) AS all_full FROM a""")
def _(t):
    s = lambda c: F.col(c).cast("string")
    gold = (
        F.when(F.col("l_quantity") < 5, F.array(F.lit("-1"))).when(F.col("l_quantity") < 9, F.array().cast("array<string>"))
        .when(F.col("l_linestatus") == "F", F.array(s("l_suppkey"))).otherwise(F.array(s("l_suppkey"), s("l_linenumber")))
    )
    return R.answer_metrics(
        t.lineitem.select("*").withColumn("gold", gold)
        .withColumn("said", F.when(F.col("l_returnflag") == "A", F.concat(s("l_linenumber"), F.lit(".a -> b, "), s("l_suppkey")))
                    .when(F.col("l_returnflag") == "N", F.concat(F.lit("A "), s("l_linenumber"), F.lit(", "), s("l_suppkey"), F.lit(" or "), s("l_linenumber")))
                    .otherwise("None"))
        .withColumn("pred", P.parse_answer("said")), ks=(1, 3))


@query("group_prompts_bool", """
SELECT p_name || ' is ' || p_type AS prompt, bool_or(l_returnflag = 'R') AS answer, count(*) AS n_rows
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat("p_name", F.lit(" is "), "p_type").alias("prompt"), (F.col("l_returnflag") == "R").alias("answer"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return R.group_prompts(rows)[0].drop("prompt_id")


@query("group_prompts_list", """
SELECT p_name || ' is ' || p_type AS prompt, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS answer, count(*) AS n_rows
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat("p_name", F.lit(" is "), "p_type").alias("prompt"), F.col("l_linenumber").alias("answer"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return R.group_prompts(rows, "list")[0].drop("prompt_id").withColumn("answer", F.array_join("answer", ","))


@query("prompt_length", r"""
SELECT min(n) AS min_tokens, max(n) AS max_tokens FROM (
  SELECT len(regexp_extract_all(lower(text), '[\p{L}\p{N}_#]+')) AS n FROM conversations)""")
def _(t):
    return R.prompt_length(t.conversations.select(F.col("text").alias("prompt")))


@query("reuse_answers", """
SELECT conv_id, turn, text AS prompt, g AS generated FROM conversations
LEFT JOIN (SELECT text AS p, min(role) AS g FROM conversations WHERE turn > 0 GROUP BY text) ON p = text""")
def _(t):
    c = t.conversations
    archive = c.where("turn > 0").select(F.col("text").alias("prompt"), F.col("role").alias("generated"))
    return R.reuse_answers(c.select("conv_id", "turn", F.col("text").alias("prompt")), archive)


@query("open_prompts", """
SELECT conv_id, turn, text AS prompt FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE turn > 0)""")
def _(t):
    c = t.conversations
    return R.open_prompts(c.select("conv_id", "turn", F.col("text").alias("prompt")),
                          c.where("turn > 0").select(F.col("text").alias("prompt")))


@query("name_match_features", """
WITH c AS (SELECT a.p_partkey AS mention_id, string_split(a.p_name, ' ') AS m, string_split(b.p_name, ' ') AS t, string_split(b.p_name || ' ' || b.p_type, ' ') AS l,
   ' ' || a.p_name || ' ' AS ms, ' ' || b.p_name || ' ' || b.p_type || ' ' AS ls
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size),
f AS (SELECT mention_id, sum(CASE WHEN m = t THEN 1 ELSE 0 END) AS e, sum(CASE WHEN contains(ls, ms) THEN 1 ELSE 0 END) AS c,
  sum(CASE WHEN len(list_filter(list_distinct(m), lambda x: NOT list_contains(t, x))) + len(list_filter(list_distinct(t), lambda x: NOT list_contains(m, x))) <= 2 THEN 1 ELSE 0 END) AS z,
  sum(CASE WHEN len(list_filter(list_distinct(m), lambda x: NOT list_contains(l, x))) <= 1 THEN 1 ELSE 0 END) AS a0,
  sum(CASE WHEN len(list_filter(list_distinct(m), lambda x: NOT list_contains(l, x))) <= 2 THEN 1 ELSE 0 END) AS a FROM c GROUP BY mention_id)
SELECT mention_id, e > 0 AS exact_title, c = 1 AS contained_one, c > 1 AS contained_many, z = 1 AS fuzzy_title_one, z > 1 AS fuzzy_title_many, a = 1 AS fuzzy_any_one, a > 1 AS fuzzy_any_many FROM f""")
def _(t):
    b = t.part.select("p_brand", "p_size", F.col("p_name").alias("n2"), F.col("p_type").alias("t2"))
    w = lambda c: F.split(c, " ")
    cands = t.part.join(b, ["p_brand", "p_size"]).select(
        F.col("p_partkey").alias("mention_id"), w("p_name").alias("mention_tokens"), w("n2").alias("title_tokens"),
        w(F.concat_ws(" ", "n2", "t2")).alias("label_tokens"))
    return E.name_match_features(cands)
