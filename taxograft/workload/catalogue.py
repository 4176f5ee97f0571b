"""Catalogue construction on the derived taxonomy."""

from pyspark.sql import functions as F

from taxograft.functions import ids
from taxograft.operators import catalogue as C
from taxograft.operators import graph as G
from taxograft.workload.registry import derive, not_in, query

# Links closed by the virtual top and null nodes.
derive("closed", """
SELECT parent_id AS p, child_id AS c FROM isa
UNION SELECT 'THING', id FROM concept WHERE id NOT IN (SELECT child_id FROM isa)
UNION SELECT id, 'NULL' FROM concept WHERE id NOT IN (SELECT parent_id FROM isa)
""", spark=f"""
SELECT parent_id AS p, child_id AS c FROM isa
UNION SELECT 'THING', id FROM {not_in("concept", "id", "child_id", "isa")}
UNION SELECT id, 'NULL' FROM {not_in("concept", "id", "parent_id", "isa")}
""", stored=True)
derive("edge_pair", """
SELECT p, c, min(degree) AS degree FROM (
  SELECT p, c, 0 AS degree FROM closed
  UNION ALL SELECT x.p, y.c, 1 FROM closed x JOIN closed y ON x.c = y.p)
GROUP BY p, c
""")
derive("edge", """
SELECT e.p AS parent_idx, e.c AS child_idx,
       CASE WHEN e.p = 'THING' THEN 'TOP' ELSE a.title END AS parent,
       CASE WHEN e.c = 'NULL' THEN 'NULL' ELSE b.title END AS child, e.degree
FROM edge_pair e LEFT JOIN concept a ON e.p = a.id LEFT JOIN concept b ON e.c = b.id
""", stored=True)
derive("part_info", """
SELECT id, min(CASE WHEN prop = 'label' THEN value END) AS title,
       coalesce(min(CASE WHEN prop = 'definition' THEN value END), '') AS definition,
       min(CASE WHEN prop = 'prefLabel' THEN value END) AS pref,
       min(CASE WHEN prop = 'altLabel' THEN value END) AS alt,
       min(CASE WHEN prop = 'exactSynonym' THEN value END) AS exact_syn
FROM annotation GROUP BY id
""")
# Complex concepts: a restriction per shipped part-supplier pair and conjunctions of them.
derive("complex_id", """
SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN '[AND](<P' || l_partkey || '> [EX.](<ROLE> <S' || l_suppkey || '>))'
     WHEN l_returnflag = 'N' THEN '[EX.](<ROLE> [EX.](<S' || l_suppkey || '> <P' || l_partkey || '>))'
     ELSE 'P' || l_partkey END AS id, 'S' || l_suppkey AS of_supplier FROM lineitem
""")
derive("role", """
SELECT 'ROLE' AS id FROM region UNION SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 2000
""")


@query("edge_catalogue", "SELECT * FROM edge")
def _(t):
    return C.edge_catalogue(t.concept, t.isa)


@query("edge_catalogue_core", """
WITH closed_core AS (
  SELECT parent_id AS p, child_id AS c FROM isa_core
  UNION SELECT 'THING', id FROM concept WHERE id NOT IN (SELECT child_id FROM isa_core)
  UNION SELECT id, 'NULL' FROM concept WHERE id NOT IN (SELECT parent_id FROM isa_core)),
e AS (SELECT p, c, min(degree) AS degree FROM (
  SELECT p, c, 0 AS degree FROM closed_core
  UNION ALL SELECT x.p, y.c, 1 FROM closed_core x JOIN closed_core y ON x.c = y.p) GROUP BY p, c)
SELECT row_number() OVER (ORDER BY p, c) - 1 AS edge_id, p AS parent_idx, c AS child_idx,
       CASE WHEN p = 'THING' THEN 'TOP' ELSE a.title END AS parent,
       CASE WHEN c = 'NULL' THEN 'NULL' ELSE b.title END AS child, degree
FROM e LEFT JOIN concept a ON p = a.id LEFT JOIN concept b ON c = b.id""")
def _(t):
    return C.number_edges(C.edge_catalogue(t.concept, t.isa_core))


@query("edge_catalogue_first_insertion", """
SELECT parent_idx, child_idx, arg_min(degree, ord) AS degree FROM (
  SELECT p AS parent_idx, c AS child_idx, 0 AS degree, c || '#0' AS ord FROM closed WHERE c <> 'NULL'
  UNION ALL SELECT p, c, 0, p || '#1' FROM closed WHERE p <> 'THING'
  UNION ALL SELECT x.p, y.c, 1, x.c || '#2' FROM closed x JOIN closed y ON x.c = y.p)
GROUP BY parent_idx, child_idx""")
def _(t):
    return C.edge_catalogue(t.concept, t.isa, first_insertion=True).drop("parent", "child")


@query("dedupe_edges", """
SELECT parent_idx, child_idx, min(degree) AS degree FROM (
  SELECT 'S' || l_suppkey AS parent_idx, 'P' || l_partkey AS child_idx, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS degree
  FROM lineitem) GROUP BY ALL""")
def _(t):
    rows = t.lineitem.select(
        F.concat(F.lit("S"), "l_suppkey").alias("parent_idx"), F.concat(F.lit("P"), "l_partkey").alias("child_idx"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("degree"))
    return C.dedupe_edges(rows)


@query("fill_neighbours", "SELECT p AS parent_idx, c AS child_idx FROM closed")
def _(t):
    return C.fill_neighbours(t.concept, t.isa)


@query("catalogue_stats", "SELECT degree, count(*) AS n_edges FROM edge_pair GROUP BY degree")
def _(t):
    return C.catalogue_stats(C.edge_catalogue(t.concept, t.isa).select("parent_idx", "child_idx", "degree"))


@query("concept_info_skos", """
SELECT id, coalesce(title, '') AS title, definition, concat_ws('|', pref, alt) AS synonyms FROM part_info""")
def _(t):
    return C.concept_info(t.annotation).drop("part").withColumn("synonyms", F.array_join("synonyms", "|"))


@query("concept_info_exact", """
SELECT id, coalesce(title, '') AS title, definition, coalesce(exact_syn, '') AS synonyms FROM part_info""")
def _(t):
    return C.concept_info(t.annotation, "exact").drop("part").withColumn("synonyms", F.array_join("synonyms", "|"))


@query("entity_rows_attr", """
SELECT id AS idx, 0 AS pos, coalesce(title, '') AS title, coalesce(title, '') AS entity, definition AS text,
       concat_ws('|', pref, alt) AS synonyms FROM part_info""")
def _(t):
    return C.entity_rows(t.annotation, "attr")


@query("entity_rows_synonym_rows", """
SELECT id AS idx, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS pos, title, entity, text, '' AS synonyms FROM (
  SELECT id, 0 AS ord, title, title AS entity, definition AS text FROM part_info
  UNION ALL SELECT id, 1, pref, title, definition FROM part_info WHERE pref IS NOT NULL
  UNION ALL SELECT id, 2, alt, title, definition FROM part_info WHERE alt IS NOT NULL)""")
def _(t):
    return C.entity_rows(t.annotation, "rows")


@query("entity_rows_concat", """
SELECT id AS idx, 0 AS pos, trim(concat_ws(' ', title, pref, alt)) AS title, title AS entity, definition AS text,
       '' AS synonyms FROM part_info""")
def _(t):
    return C.entity_rows(t.annotation, "concat")


@query("property_catalogue", """
SELECT id AS idx, 0 AS pos, title, title AS entity, definition AS text, concat_ws('|', pref, alt) AS synonyms
FROM part_info WHERE id IN (SELECT id FROM role)""")
def _(t):
    return C.property_catalogue(t.role, t.annotation)


@query("definition_share", """
SELECT count(*) AS n_concepts, sum(CASE WHEN definition <> '' THEN 1 ELSE 0 END) AS n_defined,
       avg(CASE WHEN definition <> '' THEN 1.0 ELSE 0.0 END) AS share FROM part_info""")
def _(t):
    return C.definition_share(C.concept_heads(t.annotation))


@query("local_ids", """
SELECT idx, title, row_number() OVER (ORDER BY idx, pos) - 1 AS local_id,
       min(rn) OVER (PARTITION BY idx) - 1 AS canonical_id
FROM (SELECT idx, pos, title, row_number() OVER (ORDER BY idx, pos) AS rn FROM (
  SELECT id AS idx, 0 AS pos, title FROM part_info
  UNION ALL SELECT id, 1, pref FROM part_info WHERE pref IS NOT NULL
  UNION ALL SELECT id, 2, alt FROM part_info WHERE alt IS NOT NULL))""")
def _(t):
    rows = C.entity_rows(t.annotation, "rows")
    return C.local_ids(rows, ["idx", "pos"]).select("idx", "title", "local_id", "canonical_id")


@query("rows_by_concept", """
SELECT idx, pos, rn - 1 AS local_id, title FROM (
  SELECT idx, pos, title, row_number() OVER (ORDER BY idx, pos) AS rn FROM (
  SELECT id AS idx, 0 AS pos, title FROM part_info
  UNION ALL SELECT id, 1, pref FROM part_info WHERE pref IS NOT NULL
  UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY 1) + 1, alt FROM part_info WHERE alt IS NOT NULL))""")
def _(t):
    rows = C.entity_rows(t.annotation, "rows")
    return C.rows_by_concept(C.local_ids(rows, ["idx", "pos"]))


@query("append_nil", """
SELECT id AS idx, title FROM part_info UNION ALL SELECT 'NIL', 'NIL'""")
def _(t):
    return C.append_nil(C.entity_rows(t.annotation)).select("idx", "title")


@query("append_complex", """
SELECT id AS idx, title FROM part_info
UNION ALL SELECT DISTINCT id, id FROM complex_id WHERE id LIKE '[EX.]%'""")
def _(t):
    extra = t.complex_id.select("id", F.col("id").alias("title"))
    return C.append_complex(C.entity_rows(t.annotation), extra).select("idx", "title")


@query("is_complex", """
SELECT id, of_supplier, contains(id, '[EX.]') OR contains(id, '[AND]') AS plain,
       starts_with(id, '[EX.](') OR starts_with(id, '[AND](') AS strict FROM complex_id""")
def _(t):
    return t.complex_id.select(
        "id", "of_supplier", ids.is_complex("id").alias("plain"), ids.is_complex("id", strict=True).alias("strict"))


@query("keep_complex", """
SELECT id, of_supplier FROM complex_id WHERE contains(id, '[EX.]') AND NOT starts_with(id, '[AND]')""")
def _(t):
    return t.complex_id.where(ids.keep_complex("id"))


@query("drop_complex_edges", """
SELECT of_supplier AS parent_idx, id AS child_idx FROM complex_id WHERE id NOT LIKE '%[%'""")
def _(t):
    return C.drop_complex_edges(t.complex_id.select(
        F.col("of_supplier").alias("parent_idx"), F.col("id").alias("child_idx")))


@query("complex_subset", """
SELECT of_supplier AS parent_concept, id AS child_concept FROM complex_id WHERE id LIKE '%[EX%'""")
def _(t):
    return C.complex_subset(t.complex_id.select(
        F.col("of_supplier").alias("parent_concept"), F.col("id").alias("child_concept")))


@query("id_iri_round_trip", """
SELECT id, 'http://example.org/id/' || id AS iri, id AS back FROM concept""")
def _(t):
    p = "http://example.org/id/"
    return t.concept.select("id", ids.to_iri("id", p).alias("iri")).withColumn("back", ids.to_id("iri", p))


@query("numeric_id", """
SELECT id, coalesce(try_cast(substr(id, 2) AS BIGINT), 0) AS num FROM concept""")
def _(t):
    return t.concept.select("id", ids.numeric_id("id").alias("num"))


@query("complex_parts", r"""
WITH u AS (SELECT DISTINCT id FROM complex_id)
SELECT id, 'operator' AS kind, '[EX.]0' AS part FROM u WHERE id LIKE '%[EX.]%'
UNION ALL SELECT id, 'operator', '[EX.]1' FROM u WHERE id LIKE '[EX.]%'
UNION ALL SELECT id, CASE WHEN p IN (SELECT id FROM role) THEN 'property' ELSE 'entity' END, p
FROM (SELECT id, unnest(regexp_extract_all(id, '<(.*?)>', 1)) AS p FROM u)
UNION ALL SELECT id, 'entity', id FROM u WHERE NOT contains(id, '[')""")
def _(t):
    return ids.complex_parts(t.complex_id, "id", t.role)


@query("expand_axioms", """
SELECT DISTINCT child_id, parent_id FROM (
  SELECT 'P' || p_partkey AS child_id, 'T:' || p_type AS parent_id FROM part
  UNION ALL SELECT 'P' || p_partkey, 'B:' || p_brand FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)""")
def _(t):
    parts = t.part.select(
        F.concat(F.lit("P"), "p_partkey").alias("sub_id"),
        F.when(F.col("p_size") > 20, "equivalent").otherwise("subclass").alias("kind"),
        F.array(F.concat(F.lit("T:"), "p_type"), F.concat(F.lit("B:"), "p_brand")).alias("conjuncts"))
    single = t.supplier.select(
        F.concat(F.lit("S"), "s_suppkey").alias("sub_id"), F.lit("subclass").alias("kind"),
        F.array(F.concat(F.lit("N"), "s_nationkey")).alias("conjuncts"))
    plain = single.withColumn("kind", F.lit("equivalent")).withColumn("conjuncts", F.array(F.lit("X")))
    return C.expand_axioms(parts.unionByName(single).unionByName(plain))


@query("merge_neighbours", """
SELECT DISTINCT of_supplier AS id, 'children' AS side, id AS neighbour FROM complex_id WHERE id LIKE '[EX.]%'
UNION SELECT parent_id, 'children', child_id FROM isa""")
def _(t):
    atomic = G.neighbours(t.isa, "children").select("id", F.lit("children").alias("side"), "neighbour")
    cx = t.complex_id.where(ids.is_complex("id")).select(
        F.col("of_supplier").alias("id"), F.lit("children").alias("side"), F.col("id").alias("neighbour"))
    return C.merge_neighbours(atomic, cx)


@query("pack_neighbours", """
SELECT parent_id AS id, count(*) AS n, min(child_id) AS first_child, max(child_id) AS last_child FROM isa GROUP BY parent_id""")
def _(t):
    packed = C.pack_neighbours(G.neighbours(t.isa, "children"))
    return packed.groupBy("id").agg(
        F.sum(F.size("ids")).alias("n"), F.min(F.get("ids", F.lit(0))).alias("first_child"),
        F.max(F.element_at("ids", -1)).alias("last_child"))


@query("retained_universe", "SELECT id FROM retained UNION SELECT id FROM role")
def _(t):
    return C.retained_universe(t.retained, t.role)
