"""Trained operators, host reputation, fixity audit and the pipeline."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taxograft.llm import decontaminate, fixity, hosts, quality, toxicity
from taxograft.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.llm.helpers import documents, near_components
from tests.llm.test_groups import plain_leaks

BIG = "/root/testdata/sf0.01"


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    order = np.argsort(np.argsort(score, kind="stable"))
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    assert differences(spark, connect(folder), folder, QUERIES[name], ORACLES[name])[0] is None


def test_toxicity_on_rows_it_has_not_seen(spark):
    big = "/root/testdata/sf0.1"  # toxic words of four languages need some thousand labels
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    found = toxicity.toxicity(docs, labels.where("doc_id % 3 <> 0"))
    seen = found.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert auc([r["p_toxic"] for r in seen], [r["toxic"] for r in seen]) > 0.9
    clean = [r for r in seen if r["toxic"] == 0]
    assert sum(r["rejected"] for r in clean) <= 0.03 * len(clean)


def toxic_rows(n):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        words = [f"n{rng.randrange(3000)}" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[3] = words[9] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - (i % 7 == 0), int(bad)))
    return rows, labels


def test_chain_learns_and_meets_awkward_rows(spark):
    rows, labels = toxic_rows(300)
    labels += [(None, None, None), (3, None, None), (3, 1, 0)]
    odd = [(None, "so vile and nasty"), (None, None), (900, ""), (900, "VILE! " * 40_000), (901, "n1 n2 n3 " * 40_000)]
    found = toxicity.toxicity(documents(spark, rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows) + len(odd)
    assert all(r["rejected"] == (r["doc_id"] % 5 == 0) for r in found if r["doc_id"] is not None and r["doc_id"] < 300)
    assert Counter(r["rejected"] for r in found if r["doc_id"] is None) == {True: 1, False: 1}
    assert Counter(r["rejected"] for r in found if r["doc_id"] == 900) == {True: 1, False: 1}
    assert [r["rejected"] for r in found if r["doc_id"] == 901] == [False]
    assert all(0 <= r[c] <= 1 for r in found for c in ("p_junk", "p_toxic", "p_severe"))


def test_chain_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["rejected"] for r in toxicity.toxicity(documents(spark, [(1, "a b")]), none).collect()] == [False]
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(documents(spark, []), one).count() == 0


def test_later_models_train_on_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.4, (400, 6)).astype(float)
    first = (counts[:, 0] > 0).astype(float)
    targets = np.stack([first, first], axis=1)
    models = toxicity.train(counts, targets, np.arange(400) % 5)
    assert models[0][2].shape == (0,) and models[1][2].shape == (1,) and models[1][2][0] > 0


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    found = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert auc([r["score"] for r in held], [r["quality"] for r in held]) > 0.93
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in found)  # held-out labels are not used


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "a b c."), (1, None), (None, ""), (2, "x" * 2_000_000), (4, "w " * 100_000), (5, "AB!! CD!!")]
    for table in (labels, labels.limit(0)):
        found = quality.score_quality(documents(spark, rows), table).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
        assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert quality.score_quality(documents(spark, []), labels).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [0.1, 0.35, 0.35, 0.9]
    assert quality.isotonic(np.array([]), np.array([])).tolist() == []


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, bad string")


def test_url_rules_and_hosts(spark):
    urls = {
        1: ("http://A.Example.NET/en/x?q=/de/", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
        3: ("ftp://www.example.com/de/1#f", "www.example.com", "/de/1", "example.com/de/", "block"),
        4: ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        5: ("http://a.org/fr/é", "a.org", "/fr/é", "org/fr/", "allow"),
        6: ("http://x.net", "x.net", "", None, "allow"),
        7: ("no scheme", "", "", None, "allow"),
        8: (None, "", "", None, "allow"),
        9: ("http://h.com?u=http://z.net/", "h.com", "", None, "allow"),
        10: ("http://", "", "", None, "allow"),
        11: ("http://net/a", "net", "/a", "net/", "block"),
    }
    none = spark.createDataFrame([], "page_id long, bad int")
    table = pages(spark, [(k, v[0], "") for k, v in urls.items()] + [(None, "http://a.org/fr/", None), (4, urls[4][0], "")])
    got = hosts.filter_urls(table, none).collect()
    for r in got:
        if r["page_id"] is not None:
            assert tuple(r)[1:] == urls[r["page_id"]][1:]
    assert Counter(r["page_id"] for r in got) == {**dict.fromkeys([*urls, None], 1), 4: 2}
    assert hosts.filter_urls(pages(spark, []), none).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows, outcomes = [], []
    for host, n, bad in (("bad.com", 60, 54), ("good.com", 60, 3), ("fine.com", 80, 4), ("tiny.com", 1, 1), ("a.bad.com", 0, 0), ("ok.com", 60, 5)):
        for i in range(max(n, 1)):
            rows.append((len(rows), f"http://{host}/{i}", ""))
            if i < n:
                outcomes.append((rows[-1][0], int(i < bad)))
    outcomes += [(None, 1), (0, None), (10_000, 1)]
    got = hosts.filter_urls(pages(spark, rows), spark.createDataFrame(outcomes, "page_id long, bad int"))
    verdicts = {r["host"]: r["verdict"] for r in got.collect()}
    assert verdicts == {"bad.com": "block", "a.bad.com": "block", "good.com": "allow", "fine.com": "allow", "tiny.com": "allow", "ok.com": "allow"}


def test_audit_finds_damage_and_nothing_else(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h{rng.choice([0, 0, 1, 2])}.org/{i}", "b" * rng.randrange(4000)) for i in range(500)] + [(None, None, None)] * 2
    host, _ = hosts.host_and_path(F.col("url"))
    left = fixity.catalogue(pages(spark, rows), host)
    assert fixity.audit(left, left).count() == 0
    right = left.where("coalesce(page_id, -1) NOT IN (17, 230)").withColumn(
        "digest", F.when(F.col("page_id").isin(5, 6, 499), "bad").otherwise(F.col("digest"))
    ).union(left.where("page_id = 3").withColumn("offset", F.lit(10_000_019)))
    got = {(r["page_id"], r["status"]) for r in fixity.audit(left, right, leaf_bytes=4096, fanout=4).collect()}
    assert got == {(17, "missing"), (230, "missing"), (5, "changed"), (6, "changed"), (499, "changed"), (3, "extra")}
    lost = fixity.audit(left, left.where("archive <> 'h1.org'")).collect()
    assert {r["status"] for r in lost} == {"missing"} and len(lost) == left.where("archive = 'h1.org'").count()
    empty = left.limit(0)
    assert fixity.audit(empty, empty).count() == 0 and fixity.audit(empty, left).count() == left.count()
    assert fixity.catalogue(pages(spark, []), host).count() == 0


def test_addresses_share_no_reputation(spark):
    rows, outcomes = [], []
    for host, n, bad in (("10.0.5.1", 60, 60), ("99.7.5.1:80", 0, 0), ("[::1]:8080", 60, 58), ("[::2]", 0, 0), ("ok.org", 200, 2), ("fine.com", 200, 1)):
        for i in range(max(n, 1)):
            rows.append((len(rows), f"http://{host}/{i}", ""))
            if i < n:
                outcomes.append((rows[-1][0], int(i < bad)))
    got = hosts.filter_urls(pages(spark, rows), spark.createDataFrame(outcomes, "page_id long, bad int"))
    assert {r["host"]: r["verdict"] for r in got.collect()} == {
        "10.0.5.1": "block", "99.7.5.1:80": "allow", "[::1]:8080": "block", "[::2]": "allow", "ok.org": "allow", "fine.com": "allow"}


def test_null_archives_are_audited(spark):
    rows = [(i, f"http://h/{i}", "x" * i) for i in range(60)]
    left = fixity.catalogue(pages(spark, rows), F.when(F.col("page_id") % 2 == 0, "a"))
    assert left.count() == 60 and left.where("archive IS NULL AND offset = 0").count() == 1
    right = left.where("page_id <> 7").withColumn("digest", F.when(F.col("page_id").isin(4, 9), "bad").otherwise(F.col("digest")))
    for a, b, lost in ((left, right, "missing"), (right, left, "extra")):
        got = {(r["archive"], r["page_id"], r["status"]) for r in fixity.audit(a, b, leaf_bytes=512, fanout=2).collect()}
        assert got == {(None, 7, lost), ("a", 4, "changed"), (None, 9, "changed")}


def stage_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = [(None, None, None, None, None), (None, "null id text of some words", "en", "s", 1), (7_000, None, "en", None, 0), (7_001, "", None, "s", 0),
           (7_002, "same same", "en", "s", 1), (7_002, "same same", "en", "s", 1), (7_002, "another text", "en", "s", 1)]
    return docs.union(spark.createDataFrame(odd, docs.schema))


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = stage_rows(spark, folder)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    steps = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = str(tmp_path / name)
        steps[name](spark, df, folder).write.parquet(out)
        return spark.read.parquet(out)

    clean = step("toxicity", docs)
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() > 0.7 * docs.count()

    once = step("exact_dedup", docs)
    best = {}
    for r in docs.collect():
        text = r["text"] or ""
        rank = (-len(text), r["doc_id"] is None, r["doc_id"] or 0)
        key = re.sub(r"[\x20\x09-\x0D]", "", text)
        mine = (rank, (r["doc_id"], r["text"]))
        best[key] = min(best.get(key, mine), mine, key=lambda x: x[0])
    assert rows_of(once) == Counter(v[1] for v in best.values())

    apart = step("near_dedup", once)
    data = [(r["doc_id"], r["text"]) for r in once.collect()]
    comp, size = near_components(data, 5, 4, 5)
    assert rows_of(apart) == Counter((d, t) for (d, t), c, n in zip(data, comp, size, strict=True) if not n or d == c)

    unseen = step("decontamination", apart)
    data = [(r["doc_id"], r["text"]) for r in apart.collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {i for i, row in enumerate(data) if plain_leaks([row], bench)}
    assert rows_of(unseen) == Counter(row for i, row in enumerate(data) if i not in leaked)

    mixed = step("mixing", unseen)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in unseen.collect())


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_leaks_of_the_given_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()]
    got = QUERIES["op4_benchmark_leaks"](spark, BIG).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got) == plain_leaks(docs, bench)
    assert decontaminate.sketch_size(30, Fraction(4, 5)) == 7


def test_quality_keeps_large_ids_beside_nulls(spark):
    ids = [9007199254740993, 9007199254740995, None, -5]
    got = quality.score_quality(documents(spark, [(i, "some words here") for i in ids]), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["doc_id"] for r in got.collect()} == set(ids)


def test_toxicity_trains_on_one_text_of_an_id(spark):
    rows = [(1, f"word{i} common text") for i in range(400)] + [(2, "bad bad words"), (3, "good words")]
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows).select("doc_id", "text")
    seen = []
    original = toxicity.without_copies
    try:
        toxicity.without_copies = lambda df: seen.append(df.count()) or original(df)
        assert toxicity.toxicity(docs, labels).count() == len(rows)
    finally:
        toxicity.without_copies = original
    assert seen == [3]
