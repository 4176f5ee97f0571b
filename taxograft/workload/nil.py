"""Unseen-mention decisions over the candidate lists of parts."""

from pyspark.sql import functions as F

from taxograft.operators import nil as L
from taxograft.workload.registry import derive, query

# Ten candidates per part with scaled scores; one supplier plays the unseen mark.
derive("scored", """
SELECT mention_id, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 + CAST(floor(p_size / 8) AS INT) THEN 'NIL' ELSE 'S' || cand_id END AS cand_id, score / 40 AS score
FROM ranked_cand JOIN part ON p_partkey = mention_id WHERE rank <= 10
""")
derive("unmarked", "SELECT mention_id, CAST(rank AS INT) AS rank, 'S' || cand_id AS cand_id, score / 40 AS score FROM ranked_cand WHERE rank <= 10")
_P = "pr AS (SELECT *, exp(score - max(score) OVER m) / sum(exp(score - 1)) OVER m * exp(max(score) OVER m - 1) AS p FROM {t} {f} WINDOW m AS (PARTITION BY mention_id))"


@query("softmax", "WITH " + _P.format(t="scored", f="") + " SELECT mention_id, rank, cand_id, round(p, 9) AS p FROM pr")
def _(t):
    return L.softmax(t.scored).select("mention_id", "rank", "cand_id", F.round("p", 9).alias("p"))


_LOW = """, l AS (SELECT mention_id, max({v}) <= {th} AS low, max(rank) AS k FROM pr GROUP BY mention_id)
SELECT u.mention_id, CASE WHEN low THEN rank + 1 ELSE rank END AS rank, cand_id FROM unmarked u JOIN l USING (mention_id) WHERE rank < k
UNION ALL SELECT mention_id, CASE WHEN low THEN 1 ELSE k END, 'NIL' FROM l"""


@query("nil_low_confidence", "WITH " + _P.format(t="unmarked", f="") + _LOW.format(v="p", th=0.3))
def _(t):
    return L.nil_low_confidence(t.unmarked, 0.3)


@query("nil_low_confidence_raw", "WITH " + _P.format(t="unmarked", f="") + _LOW.format(v="score", th=1.2))
def _(t):
    return L.nil_low_confidence(t.unmarked, 1.2, raw=True)


@query("nil_last", """
WITH h AS (SELECT mention_id, bool_or(cand_id = 'NIL') AS has FROM scored GROUP BY mention_id)
SELECT mention_id, rank, cand_id FROM scored JOIN h USING (mention_id) WHERE has OR rank < 10
UNION ALL SELECT mention_id, 10, 'NIL' FROM h WHERE NOT has""")
def _(t):
    return L.nil_last(t.scored, 10)


_BEST = "b AS (SELECT mention_id, cand_id, p FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_id) AS r FROM {t}) WHERE r = 1)"


@query("best_candidate", "WITH " + _P.format(t="scored", f="") + ", " + _BEST.format(t="pr") + " SELECT mention_id, cand_id, round(p, 9) AS p FROM b")
def _(t):
    return L.best_candidate(t.scored).withColumn("p", F.round("p", 9))


@query("nil_decide", "WITH " + _P.format(t="scored", f="WHERE cand_id <> 'NIL'") + ", " + _BEST.format(t="(SELECT *, 0 AS p FROM scored)") + """,
o AS (SELECT mention_id, max(p) AS p FROM pr GROUP BY mention_id), f AS (SELECT mention_id, bool_or(cand_id = 'NIL' AND rank = 1) AS first FROM scored GROUP BY mention_id),
z AS (SELECT b.mention_id, b.cand_id, first OR b.cand_id = 'NIL' OR coalesce(o.p, 0) <= 0.3 AS is_nil FROM b JOIN f USING (mention_id) LEFT JOIN o USING (mention_id))
SELECT mention_id, CASE WHEN is_nil THEN 'NIL' ELSE cand_id END AS cand_id, is_nil FROM z""")
def _(t):
    return L.nil_decide(t.scored, 0.3)


@query("nil_from_classifier", "WITH " + _BEST.format(t="(SELECT *, 0 AS p FROM scored)") + """,
h AS (SELECT mention_id, bool_or(cand_id = 'NIL') AS has FROM scored GROUP BY mention_id),
z AS (SELECT b.mention_id, cand_id, has AND coalesce(p_size > p_retailprice / 36, false) AS is_nil FROM b JOIN h USING (mention_id) LEFT JOIN part ON p_partkey = b.mention_id)
SELECT mention_id, CASE WHEN is_nil THEN 'NIL' ELSE cand_id END AS cand_id, is_nil FROM z""")
def _(t):
    flags = t.part.select(F.col("p_partkey").alias("mention_id"), (F.col("p_retailprice") / 36).alias("logit_known"), F.col("p_size").alias("logit_nil"))
    return L.nil_from_classifier(t.scored, flags)


@query("pool_scores", """
SELECT mention_id, round(min(score), 9) AS min_score, round(max(score), 9) AS max_score, round(avg(score), 9) AS mean_score FROM scored GROUP BY mention_id""")
def _(t):
    return L.pool_scores(t.scored).select("mention_id", *[F.round(c, 9).alias(c) for c in ("min_score", "max_score", "mean_score")])
