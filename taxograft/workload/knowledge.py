"""Knowledge-base operators and streams on the given tables."""

from pyspark.sql import functions as F

from taxograft.operators import kb as B
from taxograft.sources import readers as S
from taxograft.streaming import placement as P
from taxograft.workload.edges import _PLACE, _PLACE_RANK, _place
from taxograft.workload.files import _HREF, scratch
from taxograft.workload.registry import derive, query

# Pages named like the links of the given pages; an index of further titles.
derive("kb_page", """
SELECT min(item_id) AS page_id, title, 'Q' || min(item_id) AS item_id FROM (SELECT item_id, '/' || split_part(text, ' ', 1) AS title FROM benchmark) t GROUP BY title
""")
derive("title_index", """
SELECT title, 'Q' || min(id) AS item_id FROM (
  SELECT '/' || split_part(text, ' ', 2) AS title, item_id AS id FROM benchmark UNION ALL SELECT '/' || lower(split_part(text, ' ', 1)), item_id FROM benchmark) t GROUP BY title
""")
_RES = f"""{_HREF}, c AS (SELECT href, count(*) AS n FROM lk GROUP BY href),
rs AS (SELECT href, n, CASE WHEN href IN (SELECT title FROM kb_page) THEN href END AS title,
  CASE WHEN href NOT IN (SELECT title FROM kb_page) THEN coalesce(a.item_id, b.item_id) END AS item_id FROM c
  LEFT JOIN title_index a ON a.title = replace(href, ' ', '_') LEFT JOIN title_index b ON b.title = upper(left(replace(href, ' ', '_'), 1)) || lower(substr(replace(href, ' ', '_'), 2)))"""


@query("resolve_links", f"WITH {_RES} SELECT * FROM rs")
def _(t):
    return B.resolve_links(S.extract_links(t.pages, "html", ["page_id"]), t.kb_page, t.title_index)


@query("incoming_links", f"""WITH {_RES} SELECT page_id, p.title, p.item_id, coalesce(x.n, 0) + coalesce(y.n, 0) AS num_incoming_links FROM kb_page p
LEFT JOIN (SELECT title, sum(n) AS n FROM rs WHERE title IS NOT NULL GROUP BY title) x ON x.title = p.title
LEFT JOIN (SELECT item_id, sum(n) AS n FROM rs WHERE item_id IS NOT NULL GROUP BY item_id) y ON y.item_id = p.item_id""")
def _(t):
    return B.incoming_links(S.extract_links(t.pages, "html", ["page_id"]), t.kb_page, t.title_index)


derive("wiki_page", """
SELECT p_partkey AS page_id, p_name || ' ' || p_brand || ' ' || p_size AS title, 'Q' || (p_partkey + 1) AS index_id FROM part
""")
derive("wiki_item", "SELECT 'Q' || p_partkey AS item_id, p_name || ' ' || p_brand || ' ' || p_size AS title, p_type AS description FROM part WHERE p_size < 30")


@query("link_pages", """
WITH t AS (SELECT title, min((item_id, description)) AS s FROM wiki_item GROUP BY title)
SELECT page_id, p.title, index_id, coalesce(struct_extract(s, 1), i.item_id) AS item_id, CASE WHEN s IS NOT NULL THEN struct_extract(s, 2) ELSE i.description END AS description,
  CASE WHEN s IS NOT NULL THEN 'title' WHEN i.item_id IS NOT NULL THEN 'id' ELSE 'none' END AS matched_by
FROM wiki_page p LEFT JOIN t ON t.title = p.title LEFT JOIN wiki_item i ON i.item_id = p.index_id""")
def _(t):
    return B.link_pages(t.wiki_page, t.wiki_item)


@query("min_tokens", "SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) >= 100")
def _(t):
    d = t.documents.select("doc_id", F.size(F.split("text", " ")).alias("num_tokens"))
    return B.min_tokens(d, 100).select("doc_id")


@query("drop_disambiguation", """
SELECT p_partkey AS id FROM part WHERE p_size > 5 AND NOT (p_type = 'SMALL' AND p_size > 30)""")
def _(t):
    title = F.when(F.col("p_size") <= 5, F.concat("p_name", F.lit(" (disambiguation)"))).otherwise(F.col("p_name"))
    desc = F.when((F.col("p_type") == "SMALL") & (F.col("p_size") > 30), "Disambiguation page")
    return B.drop_disambiguation(t.part.select(F.col("p_partkey").alias("id"), title.alias("title"), desc.alias("item_desc"))).select("id")


@query("flatten_kb", r"""
SELECT doc_id AS id, lang AS title, CASE WHEN lang = 'en' THEN 'Q' || doc_id ELSE 'I' || doc_id END AS item_id,
  array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ') AS "desc", '"' || source || '" "' || lang || '"' AS aliases, '' AS item_desc,
  len(string_split(text, ' ')) AS num_tokens, 0 AS num_incoming_links, coalesce(s[1], '') AS sent_desc_1, coalesce(s[2], '') AS sent_desc_2
FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def _(t):
    from taxograft.functions.text import sentences

    docs = t.documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.when(F.col("lang") == "en", F.concat(F.lit("Q"), "doc_id")).alias("item_id"),
        F.concat(F.lit("I"), "doc_id").alias("index_id"), F.split("text", "\n").alias("intro_lines"), F.array(F.col("source"), F.lit("\U0001F600"), F.col("lang")).alias("aliases"),
        F.lit(None).cast("string").alias("item_desc"), F.size(F.split("text", " ")).alias("num_tokens"), F.lit(None).cast("int").alias("num_incoming_links"),
        sentences("text").alias("sentences"))
    return B.flatten_kb(docs, 2)


@query("resolve_gold", "SELECT mention_id, p_name AS label, p_min AS label_id FROM mention JOIN part ON label_concept = 'P' || p_partkey JOIN (SELECT p_name AS n, min(p_partkey) AS p_min FROM part WHERE p_size > 10 GROUP BY p_name HAVING min(p_size) > 10) ON n = p_name")
def _(t):
    kb = t.part.where("p_size > 10").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("label_id"))
    return B.resolve_gold(t.mention.select("mention_id", F.col("mention").alias("label")), kb)[0]


@query("resolve_gold_missing", "SELECT mention_id, mention AS label FROM mention WHERE mention NOT IN (SELECT p_name FROM part WHERE p_type = 'SMALL')")
def _(t):
    kb = t.part.where("p_type = 'SMALL'").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("label_id"))
    return B.resolve_gold(t.mention.select("mention_id", F.col("mention").alias("label")), kb)[1]


@query("attach_ids", f"WITH {_HREF} SELECT page_id, pos, href AS title, item_id FROM lk LEFT JOIN title_index ON title = href")
def _(t):
    links = S.extract_links(t.pages, "html", ["page_id"]).select("page_id", "pos", F.col("href").alias("title"))
    return B.attach_ids(links, t.title_index)[0]


@query("attach_ids_missing", f"WITH {_HREF} SELECT DISTINCT href AS title FROM lk WHERE href NOT IN (SELECT title FROM title_index)")
def _(t):
    links = S.extract_links(t.pages, "html", ["page_id"]).select("page_id", "pos", F.col("href").alias("title"))
    return B.attach_ids(links, t.title_index)[1]


@query("fetch_details", """
SELECT mention_id, rank, score AS prior, s_suppkey AS item_id, s_name, s_acctbal FROM ranked_cand JOIN supplier ON cand_id = s_suppkey WHERE s_acctbal > 0""")
def _(t):
    c = t.ranked_cand.select("mention_id", "rank", F.col("score").alias("prior"), F.col("cand_id").alias("item_id"))
    return B.fetch_details(c, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("item_id"), "s_name", "s_acctbal"))


# Priors of users given event types, in mixed-case forms.
derive("prior_row", """
SELECT CASE WHEN event_type = 'error' THEN 'Error' WHEN event_type = 'signup' THEN 'SIGNUP' ELSE event_type END AS mention, user_id AS entity,
  CAST(count(*) AS DOUBLE) AS p FROM events GROUP BY 1, user_id
""")
derive("prior_low", "SELECT lower(mention) AS mention, entity, p / 2 AS p FROM prior_row WHERE mention = 'SIGNUP'")
derive("prior_freq", "SELECT mention, CAST(sum(p) AS BIGINT) AS n FROM prior_row WHERE mention <> 'purchase' GROUP BY mention")
derive("asked", """
SELECT DISTINCT event_type AS mention FROM events UNION SELECT DISTINCT upper(event_type) FROM events UNION SELECT DISTINCT event_type || ' now' FROM events
""")


@query("prior_candidates", """
SELECT 'click' AS mention, entity, p FROM prior_row WHERE mention = 'click' UNION ALL SELECT 'CLICK', entity, p FROM prior_row WHERE mention = 'click'
UNION ALL SELECT 'view', entity, p FROM prior_row WHERE mention = 'view' UNION ALL SELECT 'VIEW', entity, p FROM prior_row WHERE mention = 'view'
UNION ALL SELECT 'purchase', entity, p FROM prior_row WHERE mention = 'purchase' UNION ALL SELECT 'PURCHASE', entity, p FROM prior_row WHERE mention = 'purchase'
UNION ALL SELECT 'error', entity, p FROM prior_row WHERE mention = 'Error' UNION ALL SELECT 'ERROR', entity, p FROM prior_row WHERE mention = 'Error'
UNION ALL SELECT 'SIGNUP', entity, p FROM prior_row WHERE mention = 'SIGNUP' UNION ALL SELECT 'signup', entity, p FROM prior_low""")
def _(t):
    return B.prior_candidates(t.asked, t.prior_row, t.prior_low, t.prior_freq)


@query("title_case", "SELECT DISTINCT event_type AS mention, upper(left(event_type, 1)) || substr(event_type, 2) || '-' || upper(left(event_type, 1)) || substr(event_type, 2) AS t FROM events")
def _(t):
    return t.events.select(F.col("event_type").alias("mention")).distinct().select(
        "mention", B.title_case(F.concat_ws("-", F.upper("mention"), "mention")).alias("t"))


derive("coref_mention", """
SELECT doc_id, mention_id, CASE WHEN split <> 'train' THEN upper(mention) ELSE split_part(mention, ' ', 2) END AS mention, label_concept FROM mention
""")
derive("coref_cand", """
SELECT mention_id, 1 AS rank, p_type AS entity, p_size / 100.0 AS p FROM coref_mention JOIN part ON label_concept = 'P' || p_partkey
UNION ALL SELECT mention_id, 2, p_brand, p_size / 200.0 FROM coref_mention JOIN part ON label_concept = 'P' || p_partkey
""")


@query("person_coref", """
WITH m AS (SELECT doc_id, mention_id, lower(mention) AS m FROM coref_mention), per AS (SELECT mention_id FROM coref_cand WHERE rank = 1 AND entity IN (SELECT p_type FROM part WHERE p_type IN ('SMALL', 'PROMO', 'ECONOMY'))),
j AS (SELECT a.mention_id AS cur, b.mention_id AS other FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.m <> b.m SEMI JOIN per ON per.mention_id = b.mention_id
  WHERE strpos(b.m, a.m) > 0 AND (strpos(b.m, a.m) = 1 OR substr(b.m, strpos(b.m, a.m) - 1, 1) = ' ') AND (strpos(b.m, a.m) + length(a.m) > length(b.m) OR substr(b.m, strpos(b.m, a.m) + length(a.m), 1) = ' ')),
n AS (SELECT cur, count(*) AS n FROM j GROUP BY cur)
SELECT j.cur AS mention_id, entity, round(CAST(sum(p) AS DOUBLE) / any_value(n.n), 9) AS p FROM j JOIN n ON n.cur = j.cur JOIN coref_cand c ON c.mention_id = other GROUP BY j.cur, entity""")
def _(t):
    persons = t.part.where("p_type IN ('SMALL', 'PROMO', 'ECONOMY')").select(F.col("p_type").alias("entity"))
    cands = t.coref_cand.withColumn("p", F.col("p").cast("double"))
    return B.person_coref(t.coref_mention, cands, persons).withColumn("p", F.round("p", 9))


@query("align_mentions", """
WITH a AS (SELECT doc_id, mention_id AS seq, mention, row_number() OVER (PARTITION BY doc_id, mention ORDER BY mention_id) AS o FROM mention),
b AS (SELECT doc_id, mention_id + 5 AS seq, mention, row_number() OVER (PARTITION BY doc_id, mention ORDER BY mention_id) AS o FROM mention WHERE split <> 'valid')
SELECT a.doc_id, a.seq, a.mention, b.seq AS span_seq, upper(b.mention) || '.' AS text FROM a JOIN b ON a.doc_id = b.doc_id AND a.mention = b.mention AND a.o = b.o""")
def _(t):
    m = t.mention.select("doc_id", F.col("mention_id").alias("seq"), "mention")
    s = t.mention.where("split <> 'valid'").select("doc_id", (F.col("mention_id") + 5).alias("seq"), F.concat(F.upper("mention"), F.lit(".")).alias("text"))
    return B.align_mentions(m, s)


# ----------------------------------------------------------------------- streams
def _stream(t, name):
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}.parquet*")


def _drain(t, writer):
    q = writer.option("checkpointLocation", scratch(t.spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("place_stream", "WITH " + _PLACE + _PLACE_RANK.format(f="f0", leaf="CASE WHEN l.leaf THEN 1000.0 ELSE -1000.0 END",
       join="LEFT JOIN (SELECT mention_id, id NOT IN (SELECT parent_id FROM isa) AS leaf FROM sd WHERE rank = 1) l ON l.mention_id = f.mention_id"))
def _(t):
    from taxograft.model import Settings

    out = scratch(t.spark)
    mentions = _stream(t, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("mention"))
    concepts = t.concept.select("id", F.col("title").alias("text"))
    _drain(t, P.place_stream(mentions, concepts, t.isa, None, P.parquet_sink(out), Settings(seeds=5, cap=20, enrich=False, leaf_value=1000.0)))
    return t.spark.read.parquet(out).drop("batch")


@query("drop_repeats_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    out = scratch(t.spark)
    once = P.drop_repeats_stream(_stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "1 day")
    _drain(t, once.select("user_id", "event_type").writeStream.foreachBatch(P.parquet_sink(out)))
    return t.spark.read.parquet(out).drop("batch")


@query("nil_frequency_stream", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    out = scratch(t.spark)
    counts = P.nil_frequency_stream(_stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "1 hour", "1 day")
    _drain(t, counts.writeStream.outputMode("update").foreachBatch(P.parquet_sink(out)))
    # a window may be updated by several batches: the last one counts
    last = F.max_by("n", "batch")
    return t.spark.read.parquet(out).groupBy("window_start", "event_type").agg(last.alias("n"))
