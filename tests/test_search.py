"""Pruned sparse search, block search and metrics against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxograft.operators import evaluate as E
from taxograft.operators import retrieve as R


def brute_sparse(terms, postings, static, k):
    by_token = {}
    for t, i, w in postings:
        by_token.setdefault(t, []).append((i, w))
    out = {}
    for q, t, w in terms:
        for i, pw in by_token.get(t, []):
            out.setdefault(q, {}).setdefault(i, 0.0)
            out[q][i] += w * pw
    res = {}
    for q, s in out.items():
        full = {i: round(v + static.get(i, 0.0), 9) for i, v in s.items()}
        res[q] = sorted(full.items(), key=lambda x: (-x[1], x[0]))[:k]
    return res


@pytest.mark.parametrize(("shard_postings", "block_docs"), [(1 << 22, 512), (1 << 22, 8), (60, 4), (15, 1)])
@pytest.mark.parametrize("with_static", [False, True])
def test_sparse_pruning_is_exact(spark, shard_postings, block_docs, with_static):
    rnd = random.Random(block_docs)
    n = 120
    freq = {f"t{j}": max(1, int(n / (j + 1))) for j in range(40)}
    postings = [(t, i, round(rnd.uniform(0.2, 1.0), 3)) for t, f in freq.items() for i in rnd.sample(range(n), f)]
    # weights fall with frequency, as with idf; two queries have frequent tokens only
    terms = [(q, t, round(3.0 / freq[t] ** 0.5, 3)) for q in range(12) for t in rnd.sample(sorted(freq), 5)]
    terms += [(100, "t0", 0.3), (100, "t1", 0.3), (101, "t0", 0.1)]
    static = {i: rnd.choice([0.0, 0.4]) for i in range(n)} if with_static else {}
    st = spark.createDataFrame(sorted(static.items()), "id long, static double") if with_static else None
    got = {}
    df = R.sparse_top_k(
        spark.createDataFrame(terms, "q long, token string, w double"),
        spark.createDataFrame(postings, "token string, id long, pw double"), 5, st, shard_postings, block_docs)
    for r in df.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.id, r.score))
    want = brute_sparse(terms, postings, static, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)


def test_small_shards_share_tasks(spark, monkeypatch):
    rnd = random.Random(1)
    postings = [(f"t{rnd.randrange(30)}", i, 1.0) for i in range(200) for _ in range(3)]
    postings = sorted(set(postings))
    terms = [(q, f"t{t}", 1.0 + t / 100) for q in range(9) for t in rnd.sample(range(30), 4)]
    want = brute_sparse(terms, postings, {}, 5)
    tasks = {}
    for held in (1 << 20, 25):
        monkeypatch.setattr(R, "HELD_POSTINGS", held)
        monkeypatch.setattr(R, "SHARD_POSTINGS", held)
        df = R.sparse_top_k(
            spark.createDataFrame(terms, "q long, token string, w double"),
            spark.createDataFrame(postings, "token string, id long, pw double"), 5, None, 7, 2)
        got = {}
        for r in df.orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.id)
        assert got == {q: [i for i, _ in rows] for q, rows in want.items()}
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        tasks[held] = int(re.search(r", (\d+)\), REPARTITION_BY_NUM", plan).group(1))
    cores = spark.sparkContext.defaultParallelism
    assert tasks[1 << 20] <= cores and tasks[25] > cores


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_block_search(spark, metric):
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(23, 8)), rng.normal(size=(70, 8))
    qd = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(q)], "q long, vector array<double>, g int")
    vd = spark.createDataFrame([(i, x.tolist(), int(i % 10 == 0)) for i, x in enumerate(v)], "id long, vector array<double>, g int")
    n = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = {"ip": q @ v.T, "cosine": n(q) @ n(v).T, "l2": -np.linalg.norm(q[:, None] - v[None], axis=2)}[metric]
    got = R.nearest_exact(qd, vd, 4, metric, block_rows=9).collect()
    assert len(got) == 23 * 4
    for r in got:
        order = np.argsort(-np.round(s[r.q], 9), kind="stable")
        assert r.id == order[r["rank"] - 1] and r.score == pytest.approx(s[r.q, r.id], abs=1e-7)
    for r in R.block_search(qd, vd, 4, metric, ("g",), block_rows=5).collect():
        pool = [i for i in range(70) if int(i % 10 == 0) == r.q % 2]
        best = sorted(pool, key=lambda i: (-round(s[r.q, i], 9), i))
        assert r.id == best[r["rank"] - 1]


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("held_rows", [20, 1 << 15])
def test_blocks_held_together_hand_on_k_rows(spark, monkeypatch, metric, held_rows):
    rng = np.random.default_rng(5)
    q, v = rng.integers(-2, 3, (19, 4)) + 0.0, rng.integers(-2, 3, (90, 4)) + 0.0  # many equal scores
    q[:, 0], v[:, 0] = 1, 1
    qd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "q long, vector array<double>")
    vd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    n = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = {"ip": q @ v.T, "cosine": n(q) @ n(v).T, "l2": -np.linalg.norm(q[:, None] - v[None], axis=2)}[metric]
    sent, scan = [], R.scan_blocks

    def watched(*args, **kw):
        sent.append(scan(*args, **kw))
        return sent[-1]

    monkeypatch.setattr(R, "scan_blocks", watched)
    got = R.block_search(qd, vd, 3, metric, block_rows=7, held_rows=held_rows).collect()
    for r in got:
        assert r.id == np.argsort(-np.round(s[r.q], 9), kind="stable")[r["rank"] - 1]
    assert len(got) == 19 * 3 and sent[0].count() == 19 * 3 * max(1, -(-90 // held_rows))


def test_probes_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 4))
    vd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").coalesce(1)
    qd = vd.withColumnRenamed("id", "q")
    lists = R.Lists(vd, n_lists=20)
    once = sorted(map(str, lists.probes(qd, 9).collect()))
    monkeypatch.setattr(R, "PROBED_ROWS", 3)
    assert sorted(map(str, lists.probes(qd, 9).collect())) == once and len(once) == 200 * 9


def test_ngrams_are_hashed_once(spark):
    df = R.encode(spark.createDataFrame([("Abcab",), ("",), (None,)], "t string"), "t", dim=8)
    got = {r.t: r.vector for r in df.collect()}
    text = " abcab "
    want = [0.0] * 8
    for i in range(len(text) - 2):
        want[zlib.crc32(text[i : i + 3].encode()) % 8] += 1
    assert got["Abcab"] == want and sum(got[""]) == 1 and got[None] == [0.0] * 8
    # what is counted is a value, not the hashing of all n-grams again for each of the places
    assert "filter(transform" not in df._jdf.queryExecution().analyzed().toString()


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 16)) + np.repeat(rng.normal(size=(30, 16)) * 3, 30, axis=0)
    vd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    qd = vd.select(F.col("id").alias("q"), "vector")
    exact = R.nearest_exact(qd, vd, 5)
    lists = R.Lists(vd, n_lists=30, block_rows=8)  # lists of several blocks
    assert (lists.blocks > 1).any() and lists.rows.count() == 900
    probes = lists.calibrated(qd, 5, 0.95, rows=100)
    assert probes < 15
    approx = R.nearest_approx(qd, vd, 5, lists, probes=probes)
    assert R.recall_of(approx, exact).first().recall >= 0.9
    met = exact.join(approx.withColumnRenamed("score", "s2"), ["q", "id"])
    assert met.where(F.abs(F.col("score") - F.col("s2")) > 1e-6).count() == 0


def test_all_probes_and_their_bounds_are_exact(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)) * 0.3 + np.repeat(rng.normal(size=(10, 8)) * 5, 40, axis=0)
    vd = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, vector array<float>")
    qd = vd.select(F.struct("id").alias("q"), "vector")
    lists = R.Lists(vd, n_lists=20)
    key = lambda df: sorted((r["q"][0], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    exact = R.nearest_exact(qd, vd, 6)
    assert key(R.nearest_approx(qd, vd, 6, lists, probes=20)) == key(exact)
    floors = exact.where("rank = 6").select("q", F.col("score").alias("floor"))
    assert lists.probes(qd.join(floors, "q"), 20).count() < 400 * 10  # most lists are passed over


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    ask = lambda df: df.select(F.col("id").alias("q"), "vector")
    assert R.nearest_approx(ask(some), none, 3).count() == 0
    assert R.nearest_approx(ask(none), some, 3).count() == 0
    assert R.nearest_exact(ask(some), none, 3).count() == 0


def test_recall_is_monotone_and_all_below_any(spark):
    rnd = random.Random(6)
    cands = [(m, r, rnd.randrange(30)) for m in range(20) for r in range(1, 11)]
    gold = [(m, rnd.randrange(30)) for m in range(20) for _ in range(3)]
    c = spark.createDataFrame(cands, "mention_id long, rank int, cand_id long")
    g = spark.createDataFrame(gold, "mention_id long, cand_id long")
    curve = [r.recall for r in E.recall_curve(c, g, 10).orderBy("i").collect()]
    assert curve == sorted(curve)
    for r in E.recall_any_all_at(c, g, (1, 5, 10)).collect():
        assert r["all"] <= r["any"]


def test_auc_against_pairs(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("xy"), rnd.randrange(2), rnd.randrange(6) / 5) for i in range(120)]
    got = {r.label: r.auc for r in E.auc(spark.createDataFrame(rows, "row_id long, label string, y int, score double")).collect()}

    def pairs(part):
        pos = [s for _, _, y, s in part if y]
        neg = [s for _, _, y, s in part if not y]
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    for label in "xy":
        assert got[label] == pytest.approx(pairs([r for r in rows if r[1] == label]))
    assert got["micro"] == pytest.approx(pairs(rows))
    assert got["macro"] == pytest.approx((got["x"] + got["y"]) / 2)


def test_hooks(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "t string")
    v = R.encode(df, "t", lambda s: [[len(x), 1.0] for x in s]).collect()
    assert [r.vector for r in v] == [[2.0, 1.0], [3.0, 1.0]]
    s = R.score_with(df.withColumn("n", F.length("t")), lambda t, n: n * 2.0, ["t", "n"]).collect()
    assert [r.score for r in s] == [4.0, 6.0]
    z = R.complex_vectors(
        spark.createDataFrame([("[EX.](<r> <a>)",), ("[EX.](<r> <q>)",)], "id string"),
        spark.createDataFrame([("a", [1.0, 3.0]), ("r", [3.0, 5.0])], "id string, vector array<double>"), 2)
    assert {r.id: r.vector for r in z.collect()} == {"[EX.](<r> <a>)": [2.0, 4.0], "[EX.](<r> <q>)": [3.0, 5.0]}


def test_fields_share_their_terms(spark):
    # one row a query and not one a field; a title repeats a word of its sentence
    fields = spark.createDataFrame(
        [(1, "title", "red fox"), (1, "sentence", "red red fox runs"), (2, "title", "blue"), (2, "sentence", "red dog"),
         (3, "title", "dog"), (3, "sentence", "blue fox"), (4, "note", "red fox")], "id long, field string, text string")
    queries = spark.createDataFrame([("x", "red fox"), ("y", "dog dog unknown"), ("z", "unknown")], "q string, text string")
    weights = {"title": 1.0, "sentence": 0.5, "note": 0.0}
    sizes = []
    real = R.sparse_top_k

    def spy(terms, postings, k, *rest, **kw):
        sizes.append(terms.count())
        return real(terms, postings, k, *rest, **kw)

    R.sparse_top_k = spy
    try:
        rows = R.multi_field_search(queries, fields, weights, 3).collect()
    finally:
        R.sparse_top_k = real
    assert sizes == [5]
    texts = {(r.id, r.field): r.text.split() for r in fields.collect()}
    want = {}
    for q, words in (("x", ["red", "fox"]), ("y", ["dog", "dog"])):
        for (i, field), text in texts.items():
            of = [t for (_, f), t in texts.items() if f == field]
            mean = sum(map(len, of)) / len(of)
            for w in words:
                tf, df = text.count(w), sum(w in t for t in of)
                if tf and weights[field] > 0:
                    idf = np.log(1 + (len(of) - df + 0.5) / (df + 0.5))
                    part = weights[field] * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(text) / mean))
                    want[q, i] = want.get((q, i), 0.0) + part
    assert {(r.q, r.id): r.score for r in rows} == pytest.approx(want, abs=1e-8)


def test_terms_are_packed(spark, monkeypatch):
    monkeypatch.setattr(R, "PACK_TERMS", 4)
    rnd = random.Random(5)
    postings = sorted({(f"t{rnd.randrange(60)}", i) for i in range(150) for _ in range(9)})
    postings = [(t, None if i == 0 else f"d{i:03d}", 1.0 + i / 1000) for t, i in postings]
    terms = [(q, f"t{t}", 1.0 + t / 100) for q in range(40) for t in rnd.sample(range(90), 20)]
    df = R.sparse_top_k(
        spark.createDataFrame(terms, "q long, token string, w double"),
        spark.createDataFrame(postings, "token string, id string, pw double"), 150)
    got = {(r.q, r.id): r.score for r in df.collect()}
    want, by_token = {}, {}
    for t, i, w in postings:
        by_token.setdefault(t, []).append((i, w))
    for q, t, w in terms:
        for i, pw in by_token.get(t, []):
            want[q, i] = want.get((q, i), 0.0) + w * pw
    assert got == pytest.approx(want, abs=1e-8)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" in plan and "ws" in plan
