"""Readers and writers on lines that Spark derives from the given tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxograft.model import EDGE
from taxograft.operators import terminology as Y
from taxograft.plans.lineage import ensure_checkpoint_dir
from taxograft.plans.order import number_rows
from taxograft.sources import readers as S
from taxograft.sources import writers as K
from taxograft.workload.registry import derive, query


def scratch(spark) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"


@query("catalogue_round_trip", """
SELECT row_number() OVER (ORDER BY parent_idx, child_idx) - 1 AS row_id, parent_idx, child_idx, parent, child, degree FROM edge""")
def _(t):
    path = scratch(t.spark)
    K.write_jsonl(t.edge.orderBy("parent_idx", "child_idx"), path)
    return S.read_catalogue(t.spark, path, EDGE)


@query("read_mentions_limit", "SELECT mention_id, mention FROM mention ORDER BY mention_id LIMIT 200")
def _(t):
    path = scratch(t.spark)
    K.write_jsonl(t.mention.select("mention_id", "mention").orderBy("mention_id"), path)
    schema = T.StructType([T.StructField("mention_id", T.LongType()), T.StructField("mention", T.StringType())])
    return S.read_mentions(t.spark, path, schema, limit=200).drop("row_id")


@query("write_by_dataset", "SELECT split AS dataset_name, count(*) AS n, sum(mention_id) AS check_sum FROM mention GROUP BY split")
def _(t):
    path = scratch(t.spark)
    K.write_by_dataset(t.mention.select("mention_id", "mention", F.col("split").alias("dataset_name")), path)
    back = t.spark.read.schema("mention_id long, mention string, dataset_name string").json(path)
    return back.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.sum("mention_id").alias("check_sum"))


@query("read_prompts", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, text AS prompt FROM conversations")
def _(t):
    path = scratch(t.spark)
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("prompt"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return S.read_prompts(t.spark, path)


@query("build_kb_table", "SELECT doc_id AS id, lang, source, md5(text) AS digest FROM documents")
def _(t):
    path = scratch(t.spark)
    K.build_kb_table(t.documents.withColumnRenamed("doc_id", "id"), path)
    return t.spark.read.parquet(path).select("id", "lang", "source", F.md5("text").alias("digest"))


# ----------------------------------------------------------------- terminology
derive("name_row", """
SELECT 'C' || p_partkey AS cui, CASE WHEN p_size > 25 THEN 'ENG' ELSE 'SPA' END AS lang, 'A' || p_partkey || 'x0' AS aui, 'SRC_A' AS source, 'X' || p_partkey AS code, p_name AS name, p_partkey * 3 AS line_no FROM part
UNION ALL SELECT 'C' || p_partkey, 'ENG', 'A' || p_partkey || 'x1', 'SRC_A', 'Y' || p_partkey, p_brand || ', NOS', p_partkey * 3 + 1 FROM part
UNION ALL SELECT 'C' || p_partkey, 'SPA', 'A' || p_partkey || 'x2', 'SRC_B', 'Z' || p_partkey, upper(p_name), p_partkey * 3 + 2 FROM part
""")
derive("name_line", """
SELECT 'names' AS file, line_no, cui || '|' || lang || '|||||||'  AS a,
  cui || '|' || lang || '|2|3|4|5|6|' || aui || '|8|9|10|' || source || '|12|' || code || '|' || name || '|0|N||' AS value FROM name_row
""")
derive("default_name", """
SELECT cui, name FROM (SELECT cui, name, row_number() OVER (PARTITION BY cui ORDER BY CASE WHEN lang = 'ENG' THEN 0 ELSE 1 END, line_no) AS r FROM name_row) WHERE r = 1
""")


@query("parse_rrf", "SELECT line_no, cui, lang, aui, source, code, name FROM name_row")
def _(t):
    return S.parse_rrf(t.name_line.select("file", "line_no", "value"), S.RRF["names"]).drop("file")


@query("filter_terms", """
SELECT cui, name, line_no FROM name_row WHERE source = 'SRC_A' AND lang = 'ENG' AND cui IN (SELECT 'C' || p_partkey FROM part WHERE p_type = 'SMALL')""")
def _(t):
    types = t.part.where("p_type = 'SMALL'").select(F.concat(F.lit("C"), "p_partkey").alias("cui"))
    return Y.filter_terms(t.name_row, types, ["SRC_A"], ["ENG"]).select("cui", "name", "line_no")


@query("cui_map", "SELECT DISTINCT cui, code FROM name_row WHERE source = 'SRC_A'")
def _(t):
    return Y.cui_map(t.name_row, "SRC_A")


@query("map_aui", "SELECT l_orderkey, l_linenumber, l_suppkey, 'A' || l_partkey || 'x' || (l_linenumber % 3) AS aui, 'C' || l_partkey AS cui FROM lineitem")
def _(t):
    a = F.concat(F.lit("A"), "l_partkey", F.lit("x"), F.col("l_linenumber") % 3)
    return Y.map_aui(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", a.alias("aui")), Y.aui_map(t.name_row))


@query("default_names", "SELECT cui, name FROM default_name")
def _(t):
    return Y.default_names(t.name_row)


@query("synonyms", """
SELECT DISTINCT n.cui, n.name AS synonym FROM name_row n JOIN default_name d USING (cui) WHERE n.name <> d.name AND n.name <> lower(d.name)""")
def _(t):
    return Y.synonyms(t.name_row, Y.default_names(t.name_row))


@query("synonyms_clean", r"""
WITH c AS (SELECT cui, regexp_replace(trim(regexp_replace(lower(name), '\bnos\b', '', 'g')), ',$', '') AS s FROM name_row),
d AS (SELECT cui, name, regexp_replace(trim(regexp_replace(lower(name), '\bnos\b', '', 'g')), ',$', '') AS s FROM default_name)
SELECT DISTINCT c.cui, c.s AS synonym FROM c JOIN d USING (cui) WHERE c.s <> d.s AND c.s <> d.name""")
def _(t):
    return Y.synonyms(t.name_row, Y.default_names(t.name_row), clean=True)


@query("definitions", """
SELECT 'C' || l_partkey AS cui, arg_max(l_returnflag || l_quantity, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey) AS definition FROM lineitem GROUP BY l_partkey""")
def _(t):
    d = t.lineitem.select(
        F.concat(F.lit("C"), "l_partkey").alias("cui"), F.concat("l_returnflag", F.col("l_quantity").cast("string")).alias("definition"),
        (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey")).alias("line_no"))
    return Y.definitions(d)


# Hierarchy blocks of suppliers: a row under their nation, a second row under the next
# nation, and a row of another source.
derive("hier_line", """
SELECT 'h' AS file, s_suppkey * 3 AS line_no, 'S' || s_suppkey AS cui, 'SRC_A' AS source, CASE WHEN s_acctbal < 1000 THEN 'part' ELSE 'isa' END AS rel,
  'A:top.A:R' || n_regionkey || '.A:N' || n_nationkey AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'h', s_suppkey * 3 + 1, '', '', '', 'A:top.A:R' || n_regionkey || '.A:N' || n_nationkey FROM supplier JOIN nation ON (s_nationkey + 1) % 25 = n_nationkey
UNION ALL SELECT 'h', s_suppkey * 3 + 2, 'S' || s_suppkey, 'OTHER', 'isa', 'A:top.A:R1.A:N1' FROM supplier
""")
derive("hier_aui", """
SELECT 'A:N' || n_nationkey AS aui, 'N' || n_nationkey AS cui FROM nation
UNION ALL SELECT 'A:R' || r_regionkey, 'R' || r_regionkey FROM region UNION ALL SELECT DISTINCT 'A:top', 'top' FROM region
""")
derive("hier_link", """
SELECT DISTINCT 'S' || s_suppkey AS child_id, 'N' || n.n_nationkey AS parent_id, 'R' || n.n_regionkey AS grand FROM supplier
JOIN nation o ON s_nationkey = o.n_nationkey JOIN region ON o.n_regionkey = r_regionkey
JOIN nation n ON n.n_nationkey = s_nationkey OR n.n_nationkey = (s_nationkey + 1) % 25
WHERE r_name = 'AMERICA' AND s_acctbal >= 1000
""")


def _hier(t):
    names = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("cui"), F.col("r_name").alias("name"))
    return Y.hierarchy_pairs(t.hier_line, t.hier_aui, names, "SRC_A", "AMERICA")


@query("hierarchy_pairs_links", "SELECT DISTINCT child_id, parent_id FROM hier_link")
def _(t):
    return _hier(t)[0]


@query("hierarchy_pairs_paths", """
SELECT parent_id AS id, grand AS parent, child_id AS child FROM hier_link
UNION SELECT child_id, parent_id, 'NULL' FROM hier_link""")
def _(t):
    return _hier(t)[1]


derive("rf2_line", """
SELECT 'rf2' AS file, event_id + 1 AS line_no, user_id || chr(9) || CAST(CAST(ts AS DATE) AS VARCHAR(10)) || chr(9) || CASE WHEN event_type = 'error' THEN '0' ELSE '1' END || chr(9) || 'm' AS value FROM events
UNION ALL SELECT 'rf2', 0, 'id' || chr(9) || 'effectiveTime' || chr(9) || 'active' FROM region WHERE r_regionkey = 0
""")
_STATE = """SELECT CAST(user_id AS VARCHAR) AS id, arg_max(CASE WHEN event_type = 'error' THEN '0' ELSE '1' END, (CAST(ts AS DATE), event_id)) AS active, bool_or(event_type <> 'error') AS ever_active FROM events GROUP BY user_id"""


@query("latest_state", _STATE)
def _(t):
    return Y.latest_state(S.parse_rf2(t.rf2_line))


@query("state_counts", f"SELECT count(*) AS n_ids, count(*) FILTER (active = '1') AS n_active, count(*) FILTER (ever_active) AS n_ever_active FROM ({_STATE})")
def _(t):
    return Y.state_counts(Y.latest_state(S.parse_rf2(t.rf2_line)))


@query("check_inactive", f"SELECT i.id, active FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part) i LEFT JOIN ({_STATE}) s ON s.id = i.id WHERE coalesce(active, '1') <> '0'")
def _(t):
    return Y.check_inactive(t.part.select(F.col("p_partkey").cast("string").alias("id")), Y.latest_state(S.parse_rf2(t.rf2_line)))


@query("to_sieve", """
SELECT cui || '||' || string_agg(name, '|' ORDER BY line_no) AS value FROM name_row GROUP BY cui""")
def _(t):
    # a concept has three names here
    g = t.name_row.groupBy(F.col("cui").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line_no", "name"))).alias("n"))
    return K.to_sieve(g.select("id", F.get("n.name", F.lit(0)).alias("name"), F.slice("n.name", F.lit(2), F.size("n")).alias("synonyms")))


@query("keep_list", "SELECT DISTINCT 'http://example.org/' || code AS value FROM name_row WHERE source = 'SRC_A' AND lang = 'ENG'")
def _(t):
    n = t.name_row.where("lang = 'ENG'")
    return K.keep_list(n, Y.cui_map(n, "SRC_A"), "http://example.org/")


# ---------------------------------------------------------------------- corpora
derive("pubtator_block", """
SELECT doc_id || '|t|' || lang || ' ' || source || chr(10) || doc_id || '|a|' || replace(text, chr(10), ' ') || chr(10) ||
  doc_id || chr(9) || '0' || chr(9) || length(lang) || chr(9) || lang || chr(9) || 'T1' || chr(9) || 'UMLS:C' || doc_id || chr(10) ||
  doc_id || chr(9) || (length(lang) + 1) || chr(9) || (length(lang) + 1 + length(source)) || chr(9) || source || chr(9) || 'T2' || chr(9) || 'D' || doc_id AS value FROM documents
""")


@query("parse_pubtator", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(lang || ' ' || source || ' ' || replace(text, chr(10), ' ')) AS digest, 0 AS start, length(lang) AS "end", lang AS mention, 'C' || doc_id AS cui FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), md5(lang || ' ' || source || ' ' || replace(text, chr(10), ' ')), length(lang) + 1, length(lang) + 1 + length(source), source, 'D' || doc_id FROM documents""")
def _(t):
    return S.parse_pubtator(t.pubtator_block).withColumn("digest", F.md5("text")).drop("text")


@query("split_docs", "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, lang AS mention FROM documents d JOIN labels l USING (doc_id)")
def _(t):
    spans = S.parse_pubtator(t.pubtator_block).where("cui LIKE 'C%'").select("doc_id", "mention")
    return S.split_docs(spans, t.labels.select(F.col("doc_id").cast("string").alias("value")))


@query("parse_sieve", r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents),
x AS (SELECT doc_id, start, stop AS "end", list_filter(string_split(text[:start], ' '), lambda x: x <> '') AS l, text[start + 1 : stop] AS mention,
    list_filter(string_split(text[stop + 1:], ' '), lambda x: x <> '') AS r FROM d JOIN span USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'X' || doc_id AS concept, start, "end", array_to_string(l[greatest(1, len(l) - 63):], ' ') AS context_left, mention, array_to_string(r[:64], ' ') AS context_right FROM x""")
def _(t):
    texts = t.documents.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("value"))
    ann = t.span.select(F.col("doc_id").cast("string").alias("name"), F.concat(
        "doc_id", F.lit("||"), "start", F.lit("|"), "stop", F.lit("||T||m||X"), "doc_id").alias("value"))
    return S.parse_sieve(texts, ann).drop("line")


def _conll(t):
    w = F.regexp_extract_all("text", F.lit(r"([^\s]+)"), 1)
    cap = lambda x: x.rlike("^[A-Z]")
    line = lambda x, i: F.when(~cap(x), x).otherwise(F.concat_ws(
        "\t", x, F.when((i > 0) & cap(F.get(F.col("w"), F.greatest(i - 1, F.lit(0)))), "I").otherwise("B"), F.lit("-"), F.lit("-"), F.concat(F.lit("link:"), x), F.lit("-")))
    rows = t.conversations.select("conv_id", "turn", w.alias("w"))
    tok = rows.select("conv_id", "turn", F.posexplode(F.transform("w", line)).alias("i", "value"))
    start = rows.where("turn = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("i"), F.concat(F.lit("-DOCSTART- ("), "conv_id").alias("value"))
    end = rows.select("conv_id", "turn", F.size("w").alias("i"), F.lit("").alias("value"))
    lines = number_rows(tok.unionByName(start).unionByName(end), ["conv_id", "turn", "i"], "line_no")
    return lines.select(F.lit("all").alias("file"), "line_no", "value")


_TOKENS = r"""tk AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\s]+') AS w FROM conversations))"""


@query("number_tokens", f"WITH {_TOKENS} SELECT CAST(conv_id AS VARCHAR) AS doc, turn AS sent_id, pos, token FROM tk")
def _(t):
    return S.parse_conll(_conll(t))[0].select("doc", "sent_id", "pos", "token")


@query("parse_conll_mentions", f"""WITH {_TOKENS}, c AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS isl FROM tk WHERE regexp_matches(token, '^[A-Z]'))
SELECT CAST(conv_id AS VARCHAR) AS doc, turn AS sent_id, min(pos) AS start, max(pos) + 1 AS "end", 'link:' || arg_min(token, pos) AS wikilink FROM c GROUP BY conv_id, turn, isl""")
def _(t):
    return S.parse_conll(_conll(t))[1].select("doc", "sent_id", "start", "end", "wikilink")


@query("parse_sentences_lines", r"SELECT conv_id AS file, turn AS line_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS sentence FROM conversations")
def _(t):
    lines = t.conversations.select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), F.col("text").alias("value"))
    return S.parse_sentences(lines).drop("pos")


@query("parse_sentences_split", r"""
SELECT doc_id AS file, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def _(t):
    lines = t.documents.select(F.col("doc_id").alias("file"), F.lit(0).alias("line_no"), F.col("text").alias("value"))
    return S.parse_sentences(lines, one_per_line=False).drop("line_no")


@query("parse_worlds", """
SELECT doc_id, source AS domain, text[:256] AS text FROM documents WHERE source < 'src2'""")
def _(t):
    domains = t.documents.select(F.col("source").alias("domain")).distinct().withColumn(
        "split", F.when(F.col("domain") < "src2", "train").otherwise("valid"))
    return S.parse_worlds(t.documents.select("doc_id", F.col("source").alias("domain"), "text"), domains, "train")


derive("tsv_line", """
SELECT 'tsv' AS file, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS line_no, l_orderkey || chr(9) || 'doc' || chr(9) || p_name || chr(9) || 'left' || chr(9) || 'right' || chr(9) || 'CANDIDATES' || chr(9) ||
  CASE WHEN l_returnflag = 'R' THEN 'EMPTYCAND' ELSE l_suppkey || ',0.5,Part "' || p_name || '", one' || chr(9) || l_partkey || ',0.25,' || p_type END || chr(9) || 'GT:' || chr(9) ||
  CASE WHEN l_linestatus = 'F' THEN '-1,x,' || p_name || ', two' ELSE '0,1,2,' || p_type || ' b' END AS value FROM lineitem JOIN part ON l_partkey = p_partkey
""")


@query("parse_candidates_tsv", """
SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS line_no, l_orderkey || ' doc' AS doc, p_name AS mention,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE 'Part_%22' || replace(p_name, ' ', '_') || '%22,_one=0.5;' || p_type || '=0.25' END AS cands,
  CASE WHEN l_linestatus = 'F' THEN replace(p_name, ' ', '_') || ',_two' ELSE p_type || '_b' END AS gold FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    shown = F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["title"], c["prior"].cast("string"))), ";")
    return S.parse_candidates_tsv(t.tsv_line).select("line_no", "doc", "mention", shown.alias("cands"), "gold")


derive("dump_line", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN '{"id":"Q' || p_partkey || '","sitelinks":{"dewiki":{"title":"x"}}},' WHEN p_size <= 20 THEN '{"id": broken'
  ELSE '{"id":"Q' || p_partkey || '","sitelinks":{"enwiki":{"title":"' || p_name || '"}},"aliases":{"en":[{"value":"' || p_brand || '"},{"value":"' || p_type || '"}]},"labels":{"en":{"value":"' || upper(p_name) || '"}},"descriptions":{}},' END AS value FROM part
""")


@query("parse_wikidata", """
SELECT 'Q' || p_partkey AS item_id, p_name AS title, p_brand || '|' || p_type AS aliases, upper(p_name) AS label, CAST(NULL AS VARCHAR) AS description FROM part WHERE p_size > 20""")
def _(t):
    return S.parse_wikidata(t.dump_line.select("value")).withColumn("aliases", F.array_join("aliases", "|")).drop("quote_title")


derive("wiki_block", """
SELECT chr(10) || '<doc id="' || doc_id || '" url="http://x.org/' || doc_id || '" title="' || lang || ' &amp; ' || source || '">' || chr(10) || source || chr(10) || text || chr(10) || 'Section::::End' || chr(10) || lang || chr(10) AS value FROM documents
""")
_LINES = r"list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g'))"


@query("parse_docs_intro", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, lang || ' & ' || source AS title, 'http://x.org/' || doc_id AS url, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest
FROM (SELECT doc_id, lang, source, {_LINES.format(x="source || chr(10) || text")} AS l FROM documents)""")
def _(t):
    d = S.parse_docs(t.wiki_block, "intro")
    return d.select("id", "title", "url", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("parse_docs_full", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, len(l) AS n_lines, len(string_split(array_to_string(l, ' '), ' ')) AS num_tokens
FROM (SELECT doc_id, {_LINES.format(x="source || chr(10) || text || chr(10) || 'Section::::End' || chr(10) || lang")} AS l FROM documents)""")
def _(t):
    return S.parse_docs(t.wiki_block, "full").select("id", F.size("lines").alias("n_lines"), "num_tokens")


_HREF = r"""x AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=([^>]+)>([^\n]*?)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href=([^>]+)>([^\n]*?)</a>', 2)) AS txt,
  generate_subscripts(regexp_extract_all(html, '<a href=([^>]+)>([^\n]*?)</a>', 1), 1) - 1 AS pos FROM pages),
lk AS (SELECT page_id, pos, trim(h, '"') AS href, trim(txt) AS text FROM x)"""


@query("extract_links", f"WITH {_HREF} SELECT page_id, pos, href, text FROM lk")
def _(t):
    return S.extract_links(t.pages, "html", ["page_id"])


@query("read_mapping", """
SELECT DISTINCT url AS title, 'Q' || page_id AS item_id FROM pages WHERE url LIKE 'https%'""")
def _(t):
    item = F.when(F.col("url").startswith("https"), F.concat(F.lit("Q"), "page_id"))
    return S.read_mapping(t.pages.select("page_id", F.col("url").alias("title"), item.alias("item_id")))[0]


@query("export_ranked_text", """
SELECT mention_id, 0 AS part, string_agg('S' || cand_id || ' (' || format('{:.4f}', score) || ')', '; ' ORDER BY rank) AS edges FROM ranked_cand GROUP BY mention_id""")
def _(t):
    r = t.ranked_cand.select("mention_id", "rank", F.concat(F.lit("S"), "cand_id").alias("edge"), "score")
    return K.export_ranked(r, "text")


@query("export_ranked_map", "SELECT mention_id, count(*) AS n, max(score) AS best FROM ranked_cand GROUP BY mention_id")
def _(t):
    r = t.ranked_cand.select("mention_id", "rank", F.concat(F.lit("S"), "cand_id").alias("edge"), "score")
    return K.export_ranked(r, "map").select("mention_id", F.size("edges").alias("n"), F.array_max(F.map_values("edges")).alias("best"))


@query("report", """
SELECT mention_id, 0 AS line_no, 'part ' || p_name AS line FROM (SELECT p_partkey AS mention_id, p_name FROM part)
UNION ALL SELECT mention_id, rank, rtrim(rank || ' ' || parent_idx || ' -> ' || child_idx || ' ' || format('{:.4f}', score) || ' ' ||
  CASE WHEN b THEN '(**p) (**c)' ELSE concat_ws(' ', CASE WHEN p THEN '(*p)' END, CASE WHEN c THEN '(*c)' END) END) FROM (
  SELECT *, (mention_id, parent_idx) IN (SELECT (mention_id, parent_idx) FROM gold_edge) AS p, (mention_id, child_idx) IN (SELECT (mention_id, child_idx) FROM gold_edge) AS c,
   (mention_id, parent_idx, child_idx) IN (SELECT (mention_id, parent_idx, child_idx) FROM gold_edge) AS b FROM cand_edge)""")
def _(t):
    from taxograft.operators.prompting import match_marks, report

    marked = match_marks(t.cand_edge, t.gold_edge).withColumn("edge_text", F.concat_ws(" -> ", "parent_idx", "child_idx"))
    return report(t.part.select(F.col("p_partkey").alias("mention_id"), F.concat(F.lit("part "), "p_name").alias("record")), marked)


@query("pivot_metrics", "SELECT p_brand AS dataset, 'all' AS slice, avg(p_size) AS mean_size, count(*)::DOUBLE AS n FROM part GROUP BY p_brand")
def _(t):
    g = t.part.groupBy(F.col("p_brand").alias("dataset")).agg(F.avg("p_size").alias("mean_size"), F.count(F.lit(1)).cast("double").alias("n"))
    long = g.select("dataset", F.lit("all").alias("slice"), F.expr("stack(2, 'mean_size', mean_size, 'n', n) AS (name, value)"))
    return K.pivot_metrics(long, ["mean_size", "n"])
