"""Inputs derived from the given tables that stand for licensed ontology data."""

from taxograft.workload.registry import derive

# Subsumption graph: nations under regions, suppliers and customers under nations,
# parts under their type, brand and every supplier that shipped them.
derive("isa_core", """
SELECT 'N' || n_nationkey AS child_id, 'R' || n_regionkey AS parent_id FROM nation
UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
UNION SELECT 'P' || p_partkey, 'T:' || p_type FROM part
UNION SELECT 'P' || p_partkey, 'B:' || p_brand FROM part
""", stored=True)
derive("isa", """
SELECT child_id, parent_id FROM isa_core
UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem
""", stored=True)
derive("concept", """
SELECT 'R' || r_regionkey AS id, r_name AS title FROM region
UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier
UNION ALL SELECT 'C' || c_custkey, c_name FROM customer
UNION ALL SELECT 'P' || p_partkey, p_name FROM part
UNION ALL SELECT DISTINCT 'T:' || p_type, p_type FROM part
UNION ALL SELECT DISTINCT 'B:' || p_brand, p_brand FROM part
""", stored=True)
# The older version lacks large parts and suppliers with a low balance.
derive("retained", """
SELECT c.id FROM concept c
LEFT JOIN part p ON c.id = 'P' || p.p_partkey
LEFT JOIN supplier s ON c.id = 'S' || s.s_suppkey
WHERE coalesce(p.p_size, 0) <= 25 AND coalesce(s.s_acctbal, 9999.0) >= 4000
""", stored=True)
# Annotations: labels, alternative names and definitions of parts and suppliers.
derive("annotation", """
SELECT 'P' || p_partkey AS id, 'label' AS prop, p_name AS value FROM part
UNION SELECT 'P' || p_partkey, 'prefLabel', p_name || ' (' || p_type || ')' FROM part
UNION SELECT 'P' || p_partkey, 'altLabel', p_brand || ' ' || p_name FROM part
UNION SELECT 'P' || p_partkey, 'definition', 'size ' || p_size FROM part WHERE p_size > 10
UNION SELECT 'S' || s_suppkey, 'label', s_name FROM supplier
UNION SELECT 'S' || s_suppkey, 'exactSynonym', 'vendor ' || s_suppkey FROM supplier
UNION SELECT 'P' || p_partkey, 'exactSynonym', p_brand || ' ' || p_type FROM part
""", stored=True)
# One mention per shipped line; the annotated concept is the part.
derive("mention", """
SELECT l_orderkey * 10 + l_linenumber AS mention_id, l_orderkey AS doc_id, p_name AS mention,
       o_orderpriority || ' ' || o_orderstatus AS context_left, p_brand || ' ' || p_type AS context_right,
       'P' || l_partkey AS label_concept,
       CASE WHEN l_returnflag = 'A' THEN 'train' WHEN l_returnflag = 'N' THEN 'valid' ELSE 'test' END AS split
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag
      FROM lineitem GROUP BY l_orderkey, l_linenumber) l
JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
""", stored=True)
# Candidates and gold of a mention (a part): suppliers with a score.
derive("cand", """
SELECT l_partkey AS mention_id, l_suppkey AS cand_id, CAST(sum(l_quantity) AS DOUBLE) AS score
FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_partkey, l_suppkey
""", stored=True)
derive("gold", """
SELECT DISTINCT l_partkey AS mention_id, l_suppkey AS cand_id FROM lineitem WHERE l_returnflag = 'R'
""", stored=True)
derive("ranked_cand", """
SELECT mention_id, cand_id, score,
       row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_id) AS rank
FROM cand
""")
