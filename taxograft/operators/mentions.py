"""Mention rows: labels, unseen concepts, gold edges, contexts, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.functions.text import first_n, last_n, words
from taxograft.model import MENTION_KEY, Sentinels
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import first_rows, number_rows
from taxograft.plans.skew import balanced_join

NAMES = Sentinels()


def map_annotations(mentions: DataFrame, id_map: DataFrame) -> DataFrame:
    """One mention per ontology id of its annotation id ``cui``; unmapped ones drop out."""
    return balanced_join(mentions, id_map.select("cui", "concept").distinct(), "cui")


def classify_by_version(mentions: DataFrame, old: DataFrame, new: DataFrame, names: Sentinels = NAMES) -> DataFrame:
    """Tell known from unseen concepts by comparing two taxonomy versions ``(id)``.

    ``label_concept_ori`` keeps the id; ``label_concept`` is the id when the older version
    has it and the unseen mark when only the newer one does.  Others drop out.
    """
    flags = (
        old.select("id").distinct().withColumn("_old", F.lit(True))
        .join(new.select("id").distinct().withColumn("_new", F.lit(True)), "id", "full")
        .select(F.col("id").alias("label_concept"), "_old", "_new")
    )
    joined = balanced_join(mentions, flags, "label_concept", fanout=False)
    return joined.where("_old OR _new").withColumn(
        "label_concept_ori", F.col("label_concept")
    ).withColumn(
        "is_nil", F.col("_old").isNull()
    ).withColumn(
        "label_concept", F.when(F.col("is_nil"), names.unseen).otherwise(F.col("label_concept"))
    ).drop("_old", "_new")


def attach_label(mentions: DataFrame, entities: DataFrame, all_rows: bool = False) -> DataFrame:
    """Catalogue row id and title of each mention's concept.

    ``entities`` has ``(idx, local_id, title)``; only the first row of a concept counts
    unless the synonym rows are wanted.
    """
    rows = entities.select(
        F.col("idx").alias("label_concept"), F.col("local_id").alias("label_id"), F.col("title").alias("label_title")
    )
    if not all_rows:
        rows = first_rows(rows, ["label_concept"], ["label_id"])
    return balanced_join(mentions, rows, "label_concept", fanout=all_rows)


def explode_gold_edges(
    mentions: DataFrame, paths: DataFrame, edges: DataFrame, names: Sentinels = NAMES
) -> tuple[DataFrame, DataFrame]:
    """Mention-edge pairs, and the mentions none of whose gold edges is catalogued.

    ``paths(id, parent, child)`` are the gold paths of a concept; joining them by concept
    instead of carrying a list per mention keeps the mention rows small.
    """
    gold = cut_lineage(
        paths.select(
            F.col("id").alias("label_concept_ori"),
            F.col("parent").alias("parent_idx"), F.col("child").alias("child_idx"),
        ).join(edges, ["parent_idx", "child_idx"])
    )
    pairs = balanced_join(mentions, gold, "label_concept_ori")
    dropped = mentions.join(gold.select("label_concept_ori").distinct(), "label_concept_ori", "left_anti")
    return pairs, dropped


def remove_filtered(annotations: DataFrame, dropped: DataFrame, key: Sequence[str] = MENTION_KEY) -> DataFrame:
    """Annotations whose mention was not dropped."""
    return annotations.join(dropped.select(*key).distinct(), list(key), "left_anti")


def distinct_mentions(pairs: DataFrame, key: Sequence[str] = MENTION_KEY) -> DataFrame:
    return pairs.select(*key).distinct()


def drop_repeats(mentions: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each repeated mention."""
    return first_rows(mentions, list(key), list(order))


def nil_frequency(pairs: DataFrame) -> DataFrame:
    """Rows per unseen concept, per split and overall (null split)."""
    return (
        pairs.where("is_nil").groupingSets(
            [[F.col("split"), F.col("label_concept_ori")], [F.col("label_concept_ori")]], "split", "label_concept_ori"
        ).agg(F.count(F.lit(1)).alias("n"))
    )


def nil_totals(pairs: DataFrame) -> DataFrame:
    """Number of unseen concepts and of their rows, per split and overall."""
    return pairs.where("is_nil").rollup("split").agg(
        F.count_distinct("label_concept_ori").alias("n_concepts"), F.count(F.lit(1)).alias("n_rows")
    )


def discovered(mentions: DataFrame, order: str) -> DataFrame:
    """Unseen concepts with the mention seen last."""
    return mentions.where("is_nil").groupBy("label_concept_ori").agg(
        F.max_by("mention", order).alias("example"), F.count(F.lit(1)).alias("n")
    )


def count_nil(mentions: DataFrame, names: Sentinels = NAMES) -> DataFrame:
    return mentions.agg(F.count_if(F.col("label_concept") == names.unseen).alias("n_nil"))


def recompose_splits(pairs: DataFrame) -> DataFrame:
    """Place rows of (split, is_nil) into the final splits; a row may go to several.

    In-KB rows keep their split (test as test-in-KB) and form train-all; unseen concepts of
    train serve validation, those of valid and test serve testing.
    """
    # fixed values: which final splits each kind of row belongs to
    known = {
        "train": ["train", "train-all"],
        "valid": ["valid", "train-all"],
        "test": ["test-in-KB", "train-all", "test"],
    }
    unseen = {
        "train": ["valid-NIL", "test-NIL-all", "test"],
        "valid": ["test-NIL", "test-NIL-all", "test"],
        "test": ["test-NIL", "test-NIL-all", "test"],
    }

    def targets(table: dict[str, list[str]]):
        return F.coalesce(*[F.when(F.col("split") == s, F.array(*map(F.lit, t))) for s, t in table.items()])

    target = F.when(F.col("is_nil"), targets(unseen)).otherwise(targets(known))
    return pairs.withColumn("final_split", F.explode(target))


#: Spans of one document that meet its text at once, and the characters they are spread over.
SPANS, STRETCH = 1_000, 65_536


def span_contexts(docs: DataFrame, n: int = 128) -> DataFrame:
    """``contexts``, an array ``(context_left, mention, context_right)``, in place of ``text``.

    ``docs(text, spans, ...)`` with ``spans`` an array of structs with ``start`` and ``end``; the
    entries stand in the same order.  A text is met once, whatever the number of its spans: a small
    helper walks from a span to both sides until it has ``n // 2`` words.  A missing offset or text
    gives nulls, offsets beyond the text are cut to it.
    """
    half = n // 2
    rest = [c for c in docs.columns if c != "text"]
    item = "struct<context_left:string,mention:string,context_right:string>"
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        import pyarrow as pa

        def words_before(text, at):
            out = []
            while at > 0 and len(out) < half:
                blank = text.rfind(" ", 0, at)
                if blank + 1 < at:
                    out.append(text[blank + 1 : at])
                at = blank
            return " ".join(reversed(out))

        def words_after(text, at):
            out = []
            while at < len(text) and len(out) < half:
                blank = text.find(" ", at)
                blank = len(text) if blank < 0 else blank
                if blank > at:
                    out.append(text[at:blank])
                at = blank + 1
            return " ".join(out)

        def context(text, span):
            if text is None or span is None:
                return (None, None, None)
            start, end = (None if x is None else max(0, min(x, len(text))) for x in (span["start"], span["end"]))
            return (
                None if start is None else words_before(text, start),
                None if start is None or end is None else text[start:end],
                None if end is None else words_after(text, end),
            )

        names = ("context_left", "mention", "context_right")
        shape = pa.list_(pa.struct([(x, pa.string()) for x in names]))
        for batch in batches:
            places = batch.column("places").to_pylist()
            found = [
                None if spans is None else [dict(zip(names, context(text, x))) for x in spans]
                for text, spans in zip(batch.column("text").to_pylist(), places)
            ]
            kept = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, shape)], names=[*rest, "contexts"])

    places = F.transform("spans", lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], f"contexts array<{item}>"])
    return docs.select(*rest, "text", places.alias("places")).mapInArrow(run, schema)


def context_window(docs: DataFrame, spans: DataFrame, n: int = 128) -> DataFrame:
    """``n // 2`` words of document text on each side of a character span.

    ``docs(doc_id, text)`` and ``spans(doc_id, start, end, ...)``.  The spans of a document are
    packed by their place, about ``SPANS`` of them at most, and each pack meets the text once, so
    neither a long text nor a document with very many spans is copied for every span.  Repeated
    spans are packed once and repeated at the end.
    """
    own = spans.columns
    once = spans.where(F.col("doc_id").isNotNull()).groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    once = once.withColumn("_stretch", F.coalesce(F.floor(F.col("start") / STRETCH), F.lit(-1)))
    sizes = once.groupBy("doc_id", "_stretch").agg(F.ceil(F.count(F.lit(1)) / SPANS).alias("_packs"))
    # more than one pack only where a stretch has very many spans
    many = sizes.where("_packs > 1")
    packed = once.join(many, ["doc_id", "_stretch"], "left").withColumn(
        "_pack", F.pmod(F.xxhash64(*own), F.coalesce("_packs", F.lit(1)))
    )
    one = F.struct(*[c for c in [*own, "_n"] if c != "doc_id"])
    packs = packed.groupBy("doc_id", "_stretch", "_pack").agg(F.collect_list(one).alias("spans"))
    met = balanced_join(packs.select("doc_id", "spans"), docs.select("doc_id", "text"), "doc_id", fanout=False)
    flat = span_contexts(met, n).select("doc_id", F.explode(F.arrays_zip("spans", "contexts")).alias("_z")).select(
        "doc_id", "_z.spans.*", "_z.contexts.*"
    )
    repeated = flat.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))))
    return repeated.select(*own, "context_left", "mention", "context_right")


def query_contexts(mentions: DataFrame, sizes: Sequence[int] = (10, 25)) -> DataFrame:
    """Search texts with up to that many context words on each side of the mention."""
    side = lambda c: F.filter(words(F.col(c)), lambda w: w != "")
    cols = [
        F.concat_ws(
            " ", F.array_join(last_n(side("context_left"), s), " "), "mention",
            F.array_join(first_n(side("context_right"), s), " "),
        ).alias(f"query_{s}")
        for s in sizes
    ]
    return mentions.select("*", *cols)


def sentence_context(sentences: DataFrame, prev: bool = True, next: bool = True) -> DataFrame:
    """Sentences ``(doc_id, sent_id, text)`` with their neighbours as context columns.

    Neighbours are found by joining on the sentence number, so a document of any length
    stays spread over many tasks.
    """
    out = sentences
    for wanted, name, step in ((prev, "prev_text", 1), (next, "next_text", -1)):
        if wanted:
            other = sentences.select(
                "doc_id", (F.col("sent_id") + step).alias("sent_id"), F.col("text").alias(name)
            )
            out = out.join(other, ["doc_id", "sent_id"], "left")
    return out


def sentence_mentions(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every sentence with its mentions, one per row; a sentence without any has nulls."""
    key = ["doc_id", "sent_id"]
    with_any = balanced_join(mentions, sentences, key, fanout=False)
    bare = sentences.join(mentions.select(*key).distinct(), key, "left_anti")
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in mentions.schema if f.name not in key]
    return with_any.select(*sentences.columns, *[c for c in mentions.columns if c not in key]).unionByName(
        bare.select("*", *extra)
    )


def rejoin_mentions(cands: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidate rows with the columns of their source mention."""
    return cands.join(mentions, "mention_id")


def lower_mentions(mentions: DataFrame, on: bool = True) -> DataFrame:
    if not on:
        return mentions
    cols = [c for c in ("mention", "context_left", "context_right") if c in mentions.columns]
    return mentions.withColumns({c: F.lower(c) for c in cols})


def head(df: DataFrame, n: int, key: str | Sequence[str]) -> DataFrame:
    """First ``n`` rows by key (a debugging cap)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def _shuffled(key: Sequence[str], seed: int):
    return F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 1234) -> DataFrame:
    """``n`` rows drawn by a seeded hash of a unique key: the same rows on every run."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(_shuffled(keys, seed), *keys).limit(n)


def prune(concepts: DataFrame, ratio: float, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """Delete ``floor(n * ratio)`` of the distinct concepts ``(id)``; both parts are returned."""
    ids = concepts.select("id").distinct().withColumn("_h", _shuffled(["id"], seed))
    numbered = number_rows(ids, ["_h", "id"], "_pos")
    # one-row aggregate as a scalar subquery
    cut = numbered.agg(F.floor(F.count(F.lit(1)) * ratio).alias("c"))
    marked = numbered.withColumn("_gone", F.col("_pos") < cut.scalar())
    return marked.where("NOT _gone").select("id"), marked.where("_gone").select("id")


def complement(classes: DataFrame, keep: DataFrame) -> DataFrame:
    return classes.select("id").distinct().join(keep.select("id"), "id", "left_anti")
