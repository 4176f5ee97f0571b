"""Readers and writers on real files, and streams over several batches."""

import bz2
import json
import random

from pyspark.sql import functions as F

from taxograft.operators import mentions as M
from taxograft.sources import readers as S
from taxograft.sources import writers as K
from taxograft.streaming import placement as P


def test_conll(spark, tmp_path):
    text = (
        "-DOCSTART- (d1\n\nEU\tB\tEU\tx\tlink_EU\t-\nrejects\nGerman\tB\tG\tx\tDE\t-\ncall\n\n"
        "Peter\tB\tP\tx\tPB\t-\nBlackburn\tI\tP\tx\tPB\t-\n\n-DOCSTART- (d2\n\nx\n\n"
    )
    (tmp_path / "f.conll").write_text(text)
    tokens, spans = S.read_conll(spark, str(tmp_path))
    got = {(r.doc, r.sent_id, r.pos, r.token) for r in tokens.collect()}
    assert ("d1", 1, 0, "EU") in got and ("d1", 2, 1, "Blackburn") in got and ("d2", 1, 0, "x") in got
    assert {(r.doc, r.sent_id, r.start, r.end, r.wikilink) for r in spans.collect()} == {
        ("d1", 1, 0, 1, "link_EU"), ("d1", 1, 2, 3, "DE"), ("d1", 2, 0, 2, "PB")}


def test_wikidata_bz2(spark, tmp_path):
    item = {"id": "Q1", "sitelinks": {"enwiki": {"title": "A"}}, "aliases": {"en": [{"value": "x"}]}, "labels": {}, "descriptions": {"en": {"value": "d"}}}
    other = {"id": "Q2", "sitelinks": {}, "aliases": {}, "labels": {}, "descriptions": {}}
    body = "[\n" + json.dumps(item) + ",\n" + json.dumps(other) + ",\n{broken\n]\n"
    (tmp_path / "d.json.bz2").write_bytes(bz2.compress(body.encode()))
    rows = S.read_wikidata(spark, str(tmp_path)).collect()
    assert [(r.item_id, r.title, r.aliases, r.description) for r in rows] == [("Q1", "A", ["x"], "d")]


def test_wiki_docs(spark, tmp_path):
    text = (
        '<doc id="1" url="u?a=1" title="A &amp; B">\nA &amp; B\n\nIntro one.\nSection::::History\nLater.\n</doc>\n'
        '<doc id="2" url="v" title="C">\nC\nOnly <a href="D%20E">link</a> here\n</doc>\n'
    )
    (tmp_path / "w").write_text(text)
    intro = {r.id: r for r in S.read_docs(spark, str(tmp_path)).collect()}
    assert intro["1"].title == "A & B" and intro["1"].lines == ["A &amp; B", "", "Intro one."]
    full = S.read_docs(spark, str(tmp_path), "full")
    assert {r.id: r.num_tokens for r in full.collect()}["1"] == 3 + 1 + 2 + 1 + 1
    link = S.extract_links(full.withColumn("t", F.array_join("lines", " ")), "t", ["id"]).first()
    assert (link.href, link.text) == ("D E", "link")


def test_sieve_folder(spark, tmp_path):
    (tmp_path / "n1.txt").write_text("﻿The lung disease was seen")
    (tmp_path / "n1.concept").write_text("n1||4|16||T||lung disease||C7")
    (tmp_path / "n2.txt").write_text("no annotation")
    r = S.read_sieve(spark, str(tmp_path)).collect()
    assert [(x.doc_id, x.context_left, x.mention, x.context_right, x.concept) for x in r] == [("n1", "The", "lung disease", "was seen", "C7")]


def test_pubtator(spark, tmp_path):
    (tmp_path / "p").write_text(
        "11|t|Lung disease\n11|a|Was seen.\n11\t0\t12\tLung disease\tT\tUMLS:C1\n\n12|t|X\n12|a|Y z\n12\t2\t3\tY\tT\tC2\n\n")
    spans = S.read_pubtator(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.mention, r.cui, r.text[r.start : r.end]) for r in spans] == [
        ("11", "Lung disease", "C1", "Lung disease"), ("12", "Y", "C2", "Y")]


def test_context_window_shorter_than_budget(spark):
    docs = spark.createDataFrame([(1, "a b c mention d e")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 6, 13)], "doc_id long, start int, end int")
    r = M.context_window(docs, spans, 128).first()
    assert (r.context_left, r.mention, r.context_right) == ("a b c", "mention", "d e")


def test_context_window_equals_splitting(spark, monkeypatch):
    rng = random.Random(11)
    texts = {i: " ".join(rng.choice(["a", "bb", "", "ä😀", "c.", "x" * 30]) for _ in range(rng.randint(0, 400))) for i in range(6)}
    texts[6] = None
    texts[7] = ""
    texts[8] = "no spans"
    spans = [(d, s, s + rng.randint(0, 40), f"t{i}") for d in range(8) for i, s in enumerate(rng.choices(range(0, 1200), k=30))]
    spans += [spans[0], spans[0], (0, None, 5, "n"), (0, 5, None, "m"), (None, 0, 1, "z"), (99, 0, 1, "gone")]

    def want(d, start, end, tag):
        t = texts[d]
        side = lambda x: [w for w in x.split(" ") if w]
        if t is None:
            return (d, start, end, tag, None, None, None)
        left = None if start is None else " ".join(side(t[:start])[-4:])
        mid = None if start is None or end is None else t[start:end]
        return (d, start, end, tag, left, mid, None if end is None else " ".join(side(t[end:])[:4]))

    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    rows = spark.createDataFrame(spans, "doc_id int, start int, end int, tag string")
    expected = sorted((want(*s) for s in spans if s[0] in texts), key=str)
    for size, stretch in ((1_000, 65_536), (3, 100)):
        monkeypatch.setattr(M, "SPANS", size)
        monkeypatch.setattr(M, "STRETCH", stretch)
        assert sorted((tuple(r) for r in M.context_window(docs, rows, 8).collect()), key=str) == expected


def test_documents_without_spans_survive(spark):
    blocks = spark.createDataFrame([("11|t|Lung disease\n11|a|Was seen.\n11\t0\t4\tLung\tT\tUMLS:C1",), ("12|t|X\n12|a|Y",)], "value string")
    got = {r.doc_id: (r.text, [tuple(x) for x in r.spans]) for r in S.pubtator_docs(blocks).collect()}
    assert got == {"11": ("Lung disease Was seen.", [(0, 4, "Lung", "C1")]), "12": ("X Y", [])}
    near = {r.doc_id: [tuple(c) for c in r.contexts] for r in M.span_contexts(S.pubtator_docs(blocks), 4).collect()}
    assert near == {"11": [("", "Lung", "disease Was")], "12": []}
    assert S.parse_pubtator(blocks).count() == 1


def test_worlds_and_sentences(spark, tmp_path):
    (tmp_path / "w1.json").write_text(json.dumps({"document_id": "1", "title": "t", "text": "x" * 300}) + "\n")
    (tmp_path / "w2.json").write_text(json.dumps({"document_id": "2", "title": "t", "text": "y"}) + "\n")
    domains = spark.createDataFrame([("w1", "train"), ("w2", "valid")], "domain string, split string")
    rows = S.read_worlds(spark, str(tmp_path), domains, "train").collect()
    assert [(r.domain, len(r.text)) for r in rows] == [("w1", 256)]
    (tmp_path / "s.txt").write_text("One. Two!\n\n Three \n")
    got = S.read_sentences(spark, str(tmp_path / "s.txt"), one_per_line=False).orderBy("line_no", "pos").collect()
    assert [r.sentence for r in got] == ["One.", "Two!", "Three"]


def test_split_writer_and_text_sink(spark, tmp_path):
    df = spark.createDataFrame([("b", "train"), ("a", "test")], "value string, split string")
    K.write_jsonl(df, str(tmp_path / "j"), by="split")
    assert {p.name for p in (tmp_path / "j").iterdir() if p.is_dir()} == {"split=train", "split=test"}
    K.write_text(df, str(tmp_path / "t"), order=["value"])
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]


def test_bucketed_table(spark):
    K.bucket_kb_table(spark.range(20).withColumnRenamed("id", "id"), "kb_docs_test", 4, mode="overwrite")
    try:
        plan = spark.table("kb_docs_test").groupBy("id").count()._jdf.queryExecution().toString()
        assert "Bucketed: true" in plan
    finally:
        spark.sql("DROP TABLE kb_docs_test")


def test_streams_over_several_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i, f"m{i % 4}", f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, m string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(4):
        df.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))

    def drain(writer, name):
        q = writer.option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()

    once = P.drop_repeats_stream(stream(), ["m"], "ts", "2 hours")
    drain(once.writeStream.foreachBatch(P.parquet_sink(str(tmp_path / "once"))), "once")
    assert sorted(r.m for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["m0", "m1", "m2", "m3"]

    counts = P.nil_frequency_stream(stream(), "m", "ts", "10 minutes", "2 hours")
    drain(counts.writeStream.outputMode("update").foreachBatch(P.parquet_sink(str(tmp_path / "n"))), "n")
    last = spark.read.parquet(str(tmp_path / "n")).groupBy("window_start", "m").agg(F.max_by("n", "batch").alias("n"))
    want = df.groupBy(F.window("ts", "10 minutes").alias("w"), "m").count()
    assert {(r.window_start, r.m, r.n) for r in last.collect()} == {(r.w.start, r.m, r["count"]) for r in want.collect()}


def test_long_rankings_go_on_in_parts(spark):
    rows = [(1, r, f"e{r}", 1.0 / r) for r in range(1, 26)]
    got = K.export_ranked(spark.createDataFrame(rows, "mention_id long, rank int, edge string, score double"), "map", chunk=10)
    sizes = {r.part: len(r.edges) for r in got.collect()}
    assert sizes == {0: 10, 1: 10, 2: 5}
