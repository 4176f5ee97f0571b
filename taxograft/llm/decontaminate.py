"""Benchmark items inside long documents: size-partitioned MinHash containment search.

The short side is sketched, not the long one: of an item with ``n`` shingles the ``k`` least in a
fixed order are kept, with ``k`` fixed for each size class of items.  A document that contains a
share ``t`` of the item lacks at most ``n - ceil(t * n)`` of its shingles, so with ``k`` above that
number at least one kept minimum is found in the document, and no item can be missed, however
long the document is.  The order is the number of items that hold a shingle, then its hash, so
that what many items have in common is not what they are searched by.

Documents meet the kept minima only; that, and having enough shingles for the size class, gives
distinct candidate pairs.  Each pair is then verified by the exact share of the item's shingles
that the document has.
"""

from __future__ import annotations

import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxograft.llm import kernels as K
from taxograft.plans.lineage import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of item shingles (8 each) up to which they are sent to the tasks that read the documents;
#: beyond it, document shingles and item shingles meet in a shuffled join.
SENT_BYTES = 16 << 20


def sketch_size(n: int, threshold: Fraction) -> int:
    """Minima kept for an item with ``n`` shingles: enough for the largest item of its class."""
    upper = 1 << max(0, (n - 1).bit_length())
    return min(n, upper - -(-upper * threshold.numerator // threshold.denominator) + 1)


def item_shingles(items: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """``(item, item_id, n, size_class, keep, h)``: every distinct shingle of every item, and how many
    of them its sketch keeps."""

    def run(batches):
        for batch in batches:
            for at, to, raw, offsets in K.chunks(batch.column(2)):
                words = K.Words(raw, offsets, K.ALNUM)
                values, offs = K.distinct(*K.shingles(words, width), words.n_texts)
                n = np.diff(offs)
                row = np.repeat(np.arange(len(n)), n)
                keep = np.array([sketch_size(int(x), threshold) if x else 0 for x in n], dtype=np.int64)
                classes = np.array([(int(x) - 1).bit_length() if x else 0 for x in n], dtype=np.int32)
                pick = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(n[row]), pa.array(classes[row]),
                     pa.array(keep[row]), pa.array(values.view(np.int64))],
                    names=["item", "item_id", "n", "size_class", "keep", "h"],
                )

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return rows.mapInArrow(run, "item long, item_id long, n long, size_class int, keep long, h long")


def sketches(parts: DataFrame) -> DataFrame:
    """``(item, n, size_class, h)``: the kept minima of every item."""
    held = parts.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("item").orderBy("held", F.xxhash64("h"), "h")
    ranked = parts.join(held, "h").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= F.col("keep")).select("item", "n", "size_class", "h")


def document_shingles(docs: DataFrame, width: int, only: np.ndarray | None = None) -> DataFrame:
    """``(row, doc_id, mark, size, h)``: distinct shingles of every whole text, those in ``only`` if given;
    ``size`` counts all shingles of the text, repeats included."""

    def run(batches):
        for batch in batches:
            for at, _, raw, offsets in K.chunks(batch.column(2)):
                words = K.Words(raw, offsets, K.ALNUM)
                s, text = K.shingles(words, width)
                size = np.bincount(text, minlength=words.n_texts)
                if only is not None:
                    p = np.minimum(np.searchsorted(only, s), max(len(only) - 1, 0))
                    hit = only[p] == s if len(only) else np.zeros(len(s), dtype=bool)
                    s, text = s[hit], text[hit]
                values, offs = K.distinct(s, text, words.n_texts)
                own = np.repeat(np.arange(words.n_texts), np.diff(offs))
                pick = pa.array(own + at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pick) for i in (0, 1, 3)), pa.array(size[own].astype(np.int64)), pa.array(values.view(np.int64))],
                    names=["row", "doc_id", "mark", "size", "h"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(run, "row long, doc_id long, mark long, size long, h long")


def candidates(hits: DataFrame, kept: DataFrame, threshold: Fraction) -> DataFrame:
    """Distinct ``(row, item)`` of documents that hold a kept minimum of an item.

    A document with fewer shingles than the least item of the size class must show is not
    looked at for that class.
    """
    least = F.when(F.col("size_class") > 0, F.expr("shiftleft(1L, size_class - 1)") + 1).otherwise(1)
    enough = threshold.denominator * F.col("size") >= threshold.numerator * least
    return hits.join(kept.select("item", "size_class", "h"), "h").where(enough).select("row", "item").distinct()


def leaks(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), sent: int = SENT_BYTES
) -> DataFrame:
    """One row ``(doc_id, item_id, size_class, n_item, n_shared, containment, mark)`` for each row of
    ``docs`` and each item of which it has at least ``threshold`` of the distinct shingles.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, so
    neither case nor punctuation hides a leak.  A text with fewer than ``width`` words is one
    shingle: such an item is found in a document that consists of just these words.  Null and
    empty texts have no shingles and match nothing, nor do empty tables; texts of any length are
    read whole.  Null and repeated ids are kept as they are: a repeated item or document gives a row
    each time; ``mark``, the hash of the text, tells documents that share an id apart.  A share
    equal to the threshold is enough.  Other columns are ignored.
    """
    parts = cut_lineage(item_shingles(items, width, threshold))
    kept = cut_lineage(sketches(parts))
    wanted = parts.select("h").distinct()
    if 8 * wanted.count() <= sent:
        only = wanted.toArrow().column(0).to_numpy().view(np.uint64)
        hits = document_shingles(docs, width, np.sort(only))
    else:
        hits = document_shingles(docs, width).join(wanted, "h", "left_semi")
    hits = cut_lineage(hits)
    pairs = candidates(hits, kept, threshold)
    verified = (
        pairs.join(parts, "item").join(hits.select("row", "h", "doc_id", "mark"), ["row", "h"])
        .groupBy("row", "item").agg(
            F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("item_id").alias("item_id"),
            F.first("size_class").alias("size_class"), F.first("n").alias("n_item"), F.count(F.lit(1)).alias("n_shared"),
        )
    )
    return (
        verified.where(threshold.denominator * F.col("n_shared") >= threshold.numerator * F.col("n_item"))
        .select("doc_id", "item_id", "size_class", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"), "mark")
    )
