"""The hand-made taxonomy: results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from taxograft.functions import ids
from taxograft.functions import prompts as P
from taxograft.functions import text as X
from taxograft.model import Settings
from taxograft.operators import catalogue as C
from taxograft.operators import enrich as N
from taxograft.operators import evaluate as E
from taxograft.operators import graph as G
from taxograft.operators import kb as B
from taxograft.operators import mentions as M
from taxograft.operators import nil as L
from taxograft.operators import retrieve as R
from taxograft.plans.placement import place_mentions

LINKS = [("3", "1"), ("4", "1"), ("5", "3"), ("5", "4"), ("5", "2")]
TITLES = [("1", "disease"), ("2", "finding"), ("3", "lung disease"), ("4", "heart disease"), ("5", "lung heart finding")]


@pytest.fixture(scope="module")
def isa(spark):
    return spark.createDataFrame(LINKS, "child_id string, parent_id string")


@pytest.fixture(scope="module")
def concept(spark):
    return spark.createDataFrame(TITLES, "id string, title string")


@pytest.fixture(scope="module")
def edges(isa, concept):
    return C.edge_catalogue(concept, isa).cache()


def pairs_of(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_edge_catalogue(edges):
    direct = {("THING", "1"), ("THING", "2"), ("1", "3"), ("1", "4"), ("3", "5"), ("4", "5"), ("2", "5"), ("5", "NULL")}
    over = {("THING", "3"), ("THING", "4"), ("THING", "5"), ("1", "5"), ("3", "NULL"), ("4", "NULL"), ("2", "NULL")}
    assert pairs_of(edges.where("degree = 0"), "parent_idx", "child_idx") == direct
    assert pairs_of(edges.where("degree = 1"), "parent_idx", "child_idx") == over
    row = edges.where("parent_idx = 'THING' AND child_idx = '1'").first()
    assert (row.parent, row.child) == ("TOP", "disease")


def test_edge_ids_are_positions(edges):
    got = [r.edge_id for r in C.number_edges(edges).orderBy("parent_idx", "child_idx").collect()]
    assert got == list(range(15))


def test_orphan_concept(spark, isa, concept):
    lone = concept.unionByName(spark.createDataFrame([("9", "alone")], concept.schema))
    got = pairs_of(C.edge_catalogue(lone, isa).where("degree = 1"), "parent_idx", "child_idx")
    assert ("THING", "NULL") in got
    assert "9" not in {r.id for r in G.paths_through(isa).collect()}


def test_complex_neighbours_filtered(spark, concept, isa):
    more = isa.unionByName(
        spark.createDataFrame([("5", "[EX.](<R> <2>)"), ("5", "[AND](<1> [EX.](<R> <2>))")], isa.schema))
    got = pairs_of(C.fill_neighbours(concept, more), "parent_idx", "child_idx")
    assert ("[EX.](<R> <2>)", "5") in got and not any(p.startswith("[AND]") for p, _ in got)


def test_depths_and_similarity(spark, isa):
    d = G.depths(isa)
    assert {r.id: r.depth for r in d.collect()} == {"THING": 0, "1": 1, "2": 1, "3": 2, "4": 2, "5": 2}
    asked = spark.createDataFrame([("3", "4"), ("1", "2"), ("5", "5"), ("3", "5")], "a string, b string")
    wp = {(r.a, r.b): r.wp for r in G.wu_palmer(asked, G.ancestors(isa), d, isa).collect()}
    assert wp[("3", "4")] == pytest.approx(2 / 3)
    assert wp[("1", "2")] == pytest.approx(0.5)
    assert wp[("5", "5")] == pytest.approx(1) and wp[("3", "5")] == pytest.approx(1)


def test_null_child_edge_similarity(spark, isa):
    e = spark.createDataFrame([("3", "NULL", "3", "5")], "pred_parent string, pred_child string, gold_parent string, gold_child string")
    got = G.edge_similarity(e, G.ancestors(isa), G.depths(isa), isa).first()
    assert got.sim == pytest.approx(0.928571, abs=1e-6)


def test_similarity_can_exceed_one(spark, isa):
    more = isa.unionByName(spark.createDataFrame(
        [("8", "3"), ("9", "8"), ("10", "9"), ("10", "2"), ("11", "9"), ("11", "2")], isa.schema))
    d = G.depths(more)
    asked = spark.createDataFrame([("10", "11")], "a string, b string")
    low = G.lowest_common_ancestor(asked, G.ancestors(more), d, more).first()
    assert (low.lca, low.lca_depth) == ("9", 4)
    closure = G.ancestors(more)
    assert G.wu_palmer(asked, closure, d, more).first().wp == pytest.approx(5 / 3)
    assert G.wu_palmer(asked, closure, d, more, clamp=True).first().wp == 1


def test_enrichment(spark, edges):
    seed = spark.createDataFrame([(1, "1", "3")], "mention_id long, parent_idx string, child_idx string")
    got = pairs_of(N.enrich_edges(seed, edges), "parent_idx", "child_idx")
    assert got == {("1", "3"), ("1", "5"), ("THING", "3"), ("THING", "5")}


def test_idf(spark, concept):
    q = spark.createDataFrame([(1, "lung disease")], "q long, text string")
    got = R.idf_select(q, concept.select("id", F.col("title").alias("text")), 5).orderBy("rank").collect()
    assert [r.id for r in got] == ["3", "5", "1", "4"]
    assert got[0].score == pytest.approx(0.619789, abs=1e-6) and got[2].score == pytest.approx(0.221849, abs=1e-6)
    cand = spark.createDataFrame([(1, "3", "5"), (1, "1", "3")], "mention_id long, parent_idx string, child_idx string")
    m = spark.createDataFrame([(1, "lung disease")], "mention_id long, mention string")
    scores = {(r.parent_idx, r.child_idx): r.score for r in R.edge_idf_score(cand, m, concept.select("id", F.col("title").alias("text"))).collect()}
    assert scores[("3", "5")] == pytest.approx(0.508864, abs=1e-6) and scores[("1", "3")] == pytest.approx(0.420819, abs=1e-6)


def test_contraction_over_several_steps(spark, isa):
    new = isa.unionByName(spark.createDataFrame([("7", "3"), ("6", "7"), ("12", "6")], isa.schema))
    old = spark.createDataFrame([(i,) for i in "12345"], "id string")
    got = pairs_of(G.contract(new, old), "id", "neighbour")
    assert ("6", "3") in got and ("12", "3") in got and ("7", "3") in got
    down = pairs_of(G.contract(new, old, "children"), "id", "neighbour")
    assert not any(n in {"6", "7", "12"} for _, n in down)


def test_contraction_ends_on_a_cycle(spark):
    loop = spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "x"), ("y", "k")], "child_id string, parent_id string")
    keep = spark.createDataFrame([("k",), ("a",)], "id string")
    assert ("a", "k") in pairs_of(G.contract(loop, keep), "id", "neighbour")


def test_version_diff(spark):
    m = spark.createDataFrame([(1, "3"), (2, "6"), (3, "99")], "mention_id long, label_concept string")
    old = spark.createDataFrame([("3",)], "id string")
    new = spark.createDataFrame([("3",), ("6",)], "id string")
    got = {r.mention_id: (r.label_concept, r.label_concept_ori, r.is_nil) for r in M.classify_by_version(m, old, new).collect()}
    assert got == {1: ("3", "3", False), 2: ("NIL", "6", True)}


def test_precision_recall_any_all(spark):
    cands = spark.createDataFrame([(1, 1, "1>3"), (1, 2, "3>5"), (1, 3, "1>5")], "mention_id long, rank int, cand_id string")
    gold = spark.createDataFrame([(1, "1>5"), (1, "1>3")], "mention_id long, cand_id string")
    pr = {r.k: (r.precision, r.recall) for r in E.precision_recall_at(cands, gold, (1, 3)).collect()}
    assert pr[1] == (1, 0.5) and pr[3] == (pytest.approx(2 / 3), 1)
    aa = {r["k"]: (r["any"], r["all"]) for r in E.recall_any_all_at(cands, gold, (1, 3)).collect()}
    assert aa == {1: (1, 0), 3: (1, 1)}


def test_scalar_cases(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert get(X.clean_synonym(lit("[X]Asthma (disorder)"))) == "asthma"
    assert get(X.clean_synonym(lit("Asthma, NOS"))) == "asthma"
    assert get(X.clean_synonym(lit("diagnosis"))) == "diagnosis"
    assert get(X.clean_synonym(lit("diagnosis"), compat=True)) == "diagis"
    assert get(X.clean_synonym(lit("NOS"))) is None
    assert get(P.order_answer(lit("10,2,1"))) == "1,2,10"
    assert get(P.parse_answer(lit("0.a -> b, 3\nNone"))) == ["0", "3"]
    assert get(P.parse_answer(lit("A 7, 2 or 4"))) == ["7", "2", "4"]
    assert get(P.parse_answer(lit("None of them"))) == []
    assert get(P.parse_answer_marked(lit("x ### Response: 1,2</s>"))) == ["1", "2"]
    assert get(X.last_n(F.array(*map(lit, "abc")), 64)) == ["a", "b", "c"]
    assert get(ids.keep_complex(lit("[AND](<1> [EX.](<2> <3>))"))) is False
    assert get(ids.keep_complex(lit("[EX.](<2> <3>)"))) is True
    assert get(X.decode_href(lit("a%20b+c"))) == "a b+c" and get(X.decode_href(lit("5%zz"))) == "5%zz"
    assert get(X.escape_query(lit("AND a\\b (x) OR"))) == "and a\\b \\(x\\) or"
    assert get(B.title_case(lit("obama 44th o'neil-x"))) == "Obama 44Th O'Neil-X"


def test_complex_parts(spark):
    df = spark.createDataFrame([("[EX.](<609> [EX.](<427> <946>))",), ("77",)], "id string")
    props = spark.createDataFrame([("609",), ("427",)], "id string")
    got = pairs_of(ids.complex_parts(df, "id", props), "kind", "part")
    assert got == {("operator", "[EX.]0"), ("operator", "[EX.]1"), ("property", "609"), ("property", "427"), ("entity", "946"), ("entity", "77")}


def test_nil_thresholds(spark):
    c = spark.createDataFrame([(1, 1, "a", 2.0), (1, 2, "b", 1.0), (1, 3, "c", 0.0)], "mention_id long, rank int, cand_id string, score double")
    order = lambda df: [r.cand_id for r in df.orderBy("rank").collect()]
    assert order(L.nil_low_confidence(c, 0.7)) == ["NIL", "a", "b"]
    assert order(L.nil_low_confidence(c, 0.5)) == ["a", "b", "NIL"]
    p = [round(r.p, 4) for r in L.softmax(c).orderBy("rank").collect()]
    assert p == [0.6652, 0.2447, 0.09]


def test_placement_properties(spark, concept, isa, edges):
    m = spark.createDataFrame([(1, "lung disease", "heart"), (2, "finding", "lung disease")], "mention_id long, mention string, context string")
    text = concept.select("id", F.col("title").alias("text"))
    plain = place_mentions(m.drop("context"), text, isa, edges, Settings(seeds=3, cap=30))
    bare = place_mentions(m.drop("context"), text, isa, edges, Settings(seeds=3, cap=30, enrich=False))
    assert pairs_of(bare, "mention_id", "parent_idx", "child_idx") <= pairs_of(plain, "mention_id", "parent_idx", "child_idx")
    both = place_mentions(m, text, isa, edges, Settings(seeds=4, cap=5))
    assert both.groupBy("mention_id").count().agg(F.max("count")).first()[0] <= 5


def test_large_synonym_list_is_split(spark):
    rows = [("c", "label", "t")] + [("c", "altLabel", f"s{i:03d}") for i in range(50)]
    a = spark.createDataFrame(rows, "id string, prop string, value string")
    got = C.concept_info(a, chunk=10).collect()
    assert len(got) > 1 and sorted(s for r in got for s in r.synonyms) == sorted(f"s{i:03d}" for i in range(50))


def test_enrich_concepts_equals_scan(spark):
    """The neighbour limit must not change the pool: compare with a plain scan."""
    import random

    rnd = random.Random(5)
    links = sorted({(str(rnd.randrange(40)), "h" if rnd.random() < 0.4 else str(rnd.randrange(40, 60))) for _ in range(200)})
    seeds = [(m, r, x) for m in range(8) for r, x in enumerate(["h"] + rnd.sample([str(i) for i in range(60)], 4), 1)]
    isa = spark.createDataFrame(links, "child_id string, parent_id string")
    sd = spark.createDataFrame(seeds, "mention_id long, rank int, id string")
    got = {}
    for r in N.enrich_concepts(sd, isa, 12).orderBy("mention_id", "pos").collect():
        got.setdefault(r.mention_id, []).append(r.id)
    for m in range(8):
        own = [x for mm, _, x in sorted(seeds) if mm == m]
        pool = list(own)
        for x in own:
            near = sorted(c for c, p in links if p == x) + sorted(p for c, p in links if c == x)
            for n in near:
                if n not in pool and len(pool) < 12:
                    pool.append(n)
        assert got[m] == pool[:12] + ["NULL"]


# ------------------------------------------------------------------ metrics by hand

def test_insertion_needs_equal_sets(spark):
    rows = [
        (1, "a", 1, 1, 0.9, True), (1, "b", 0, 0, 0.1, True),  # exact
        (2, "a", 1, 1, 0.9, True), (2, "b", 0, 1, 0.8, True),  # one prediction too many
        (3, "a", 0, 0, 0.9, True), (3, "b", 0, 0, 0.1, True),  # no labels
        (4, "a", 1, 1, 0.9, False),  # a gold label was never offered
    ]
    ml = spark.createDataFrame(rows, "row_id long, label string, y int, yhat int, score double, complete boolean")
    got = E.insertion(ml).first()
    assert (got["any"], got["all"], got["n_instances"]) == (0.75, 0.25, 4)
    at = {r["k"]: (r["any"], r["all"]) for r in E.insertion_at(ml, (1, 2)).collect()}
    assert at == {1: (0.75, 0.5), 2: (0.75, 0.5)}


def test_edge_recall_of_a_mixed_mention(spark):
    gold = [(1, "p", "NULL"), (1, "p", "c"), (2, "p", "c"), (2, "p", "d"), (3, "q", "NULL")]
    ranked = [(1, "p", "c"), (2, "p", "c"), (2, "p", "d")]
    frame = lambda rows: spark.createDataFrame(rows, "mention_id long, parent_idx string, child_idx string")
    got = {r["is_leaf"]: (r["n_evaluated"], r["n_any"], r["n_all"]) for r in E.edge_recall(frame(ranked), frame(gold)).collect()}
    # mention 1 is a leaf mention by one of its edges; its inner hit counts overall only
    assert got == {True: (2, 0, 0), False: (1, 1, 1), None: (3, 2, 1)}
    wide = frame(gold + [(3, "p", "c"), (1, "p", "c")])
    got = {r["is_leaf"]: r["n_any"] for r in E.edge_recall(frame(ranked + [(3, "p", "c")]), frame(gold), targets=wide).collect()}
    assert got == {True: 0, False: 1, None: 3}


def test_precision_over_detected_mentions(spark):
    pred = spark.createDataFrame([(1, "a"), (2, "b"), (3, "NIL")], "mention_id long, entity string")
    gold = spark.createDataFrame([(1, "a"), (2, "x"), (4, "y")], "mention_id long, entity string")
    found = spark.createDataFrame([(i,) for i in range(1, 7)], "mention_id long")
    got = E.linking_prf(pred, gold, detected=found).first()
    assert (got["n_pred"], got["precision"], got["recall"]) == (5, 0.2, pytest.approx(1 / 3))
    assert E.linking_prf(pred, gold).first()["precision"] == 0.5


def test_code_families(spark):
    codes = ["123.4", "E123.4", "12.34", "1234.5", "123", "E123", "12", "1234", ""]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", E.code_family("c").alias("f")).collect()
    assert [r["f"] for r in rows] == ["diagnosis", "diagnosis", "procedure", None, "diagnosis", "diagnosis", None, None, None]


def test_mean_answers_of_answered_rows(spark):
    from taxograft.operators.prompting import answer_metrics

    rows = [(["1", "2"], ["1"]), (["3"], ["-1"]), (None, ["1"]), (["1"], []), (["1"], ["1"])]
    got = answer_metrics(spark.createDataFrame(rows, "pred array<string>, gold array<string>"), (1,)).first()
    assert (got["n_mentions"], got["mean_answers"], got["any_full"], got["all_full"]) == (5, 1.5, 0.4, 0.4)


def test_complex_seeds_are_not_expanded(spark, isa):
    seeds = spark.createDataFrame([(1, 1, "5"), (1, 2, "[EX.](r)(3)")], "mention_id long, rank int, id string")
    assert all("[" not in r["parent_idx"] for r in N.form_edges(seeds, isa).collect())
    pool = N.enrich_concepts(seeds, isa.union(spark.createDataFrame([("x", "[EX.](r)(3)")], isa.schema)), 9)
    assert "[EX.](r)(3)" in {r["id"] for r in pool.collect()} and "x" not in {r["id"] for r in pool.collect()}


def test_values_longer_than_a_million(spark):
    long = "x" * 1_200_000
    df = spark.createDataFrame([(long,)], "v string")
    assert df.select(F.length(ids.to_id(F.concat(F.lit("P:"), "v"), "P:"))).first()[0] == 1_200_000
    assert df.select(F.length(B.capitalized(F.col("v"))), F.length(B.title_case(F.col("v")))).first()[:] == (1_200_000, 1_200_000)
    number = df.select(ids.numeric_id(F.concat(F.lit("Q"), F.repeat(F.lit("0"), 1_000_100), F.lit("7")))).first()[0]
    assert number == 7
