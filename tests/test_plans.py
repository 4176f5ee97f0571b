"""Balanced joins, running totals and numbered lines against their plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from taxograft.plans import order as O
from taxograft.plans import skew as K
from taxograft.sources import lines
from taxograft.sources.lines import read_lines


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(1)
    left = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}", i) for i in range(400)] + [(None, 999)]
    right = [("hot", f"r{i}") for i in range(7)] + [(f"k{i}", f"q{i}") for i in range(0, 30, 2)]
    return spark.createDataFrame(left, "k string, v long"), spark.createDataFrame(right, "k string, w string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("fanout", [True, False])
def test_balanced_join(skewed, how, fanout):
    left, right = skewed
    got = K.balanced_join(left, right, "k", how, fanout=fanout, rows_per_task=20)
    want = left.join(right, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_hot_key_is_salted(skewed):
    left, right = skewed
    hot = {r.k: (r._a, r._b) for r in K.hot_keys(left, right, ["k"], 20).collect()}
    assert hot["hot"][0] > 10 and hot["hot"][1] == 1


def test_hot_right_side_is_sliced(skewed):
    right, left = skewed
    left, right = left.where("w <> 'r0'"), right
    hot = {r.k: (r._a, r._b) for r in K.hot_keys(left, right, ["k"], 20, both_sides=True).collect()}
    assert hot["hot"][0] == 6 and hot["hot"][1] > 5
    got = K.balanced_join(left, right, "k", rows_per_task=20)
    want = left.join(right, "k")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_running_sum_and_last_seen_over_blocks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, rnd.randrange(5), rnd.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, x long, m long")
    summed = O.running_sum(df, ["g"], "i", F.col("x"), "s", size=7)
    both = O.last_seen(summed, ["g"], "i", F.col("m"), "last", size=7).orderBy("i").collect()
    total, last = {}, {}
    for (g, i, x, m), r in zip(rows, both):
        total[g] = total.get(g, 0) + x
        last[g] = m if m is not None else last.get(g)
        assert (r.s, r.last) == (total[g], last[g])


def test_running_sum_over_sparse_order_values(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaab"), rnd.randrange(-(1 << 62), 1 << 62), rnd.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    total, want = {}, set()
    for g, i, x in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + x
        want.add((g, i, total[g]))
    got = O.running_sum(df, ["g"], "i", F.col("x"), "s", dense=False)
    assert {(r.g, r.i, r.s) for r in got.collect()} == want


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    got = O.number_rows(df, ["k"], "n").collect()
    assert all(r.k == r.n for r in got) and len(got) == 1000


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("score"))
    plan = O.top_k(df, "g", [F.desc("score")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in O.first_rows(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, "z")}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 5000), ("b.txt", 37)):
        lines = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
        want[name] = lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        rows = read_lines(spark, str(tmp_path))
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(got) == 5037
    for r in got:
        assert r.value == want[r.file.rsplit("/", 1)[1]][r.line_no]
    assert sorted(r.row_no for r in got) == list(range(5037))


def test_lines_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(300)))
    rows = read_lines(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    monkeypatch.setattr(lines, "SENT_SPLITS", 0)
    assert {(r.row_no, r.value) for r in read_lines(spark, str(tmp_path)).collect()} == {(i, f"line {i}") for i in range(300)}


def test_checkpoint_dir_setting_is_used():
    import inspect

    from taxograft.plans import lineage

    src = inspect.getsource(lineage)
    assert "spark.checkpoint.dir" in src and "localCheckpoint" not in src


def test_every_hot_key_is_split(spark, monkeypatch):
    left = spark.range(30_000).select((F.col("id") % 1500).cast("string").alias("k"), F.col("id").alias("v"))
    right = spark.range(1500).select(F.col("id").cast("string").alias("k"), F.lit("w").alias("w"))
    assert K.hot_keys(left, right, ["k"], 10).count() == 1500
    for sent in (10_000, 100):
        monkeypatch.setattr(K, "SENT_KEYS", sent)
        assert K.balanced_join(left, right, "k", rows_per_task=10).count() == 30_000
