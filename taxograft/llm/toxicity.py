"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

Categories are predicted one after the other; the probability of each earlier category is a
feature of every later model.  For training, those probabilities are out of fold: they come
from models that have not seen the row, as they will not have seen the rows to be scored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.llm import kernels as K
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import first_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bound of the labelled rows that train the chain, chosen by a hash of doc_id.
MAX_ROWS = 8_000
#: Words taken for each category, by the chi-squared statistic of their document counts.
WORDS = 100
LEAST_CHI2 = 40.0
LEAST_DOCS = 5
#: Bytes of the word beginnings that are features besides whole words: stems, whatever the ending.
BEGINNINGS = (3, 5, 7)
#: Shingle minima by which copies among the training rows are recognised.
COPY_KEYS = 4
#: Probability from which a document is rejected.
THRESHOLD = 0.4
FOLDS = 5
RIDGE = 0.3


@dataclass(frozen=True)
class Chain:
    """Word hashes (sorted), and intercept, word weights and chain weights of each category."""

    categories: tuple[str, ...]
    words: np.ndarray
    models: tuple[tuple[float, np.ndarray, np.ndarray], ...]

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        out = np.zeros((len(counts), len(self.models)))
        for k, (bias, weights, chained) in enumerate(self.models):
            out[:, k] = _sigmoid(bias + x @ weights + out[:, :k] @ chained)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps; a constant where one class is missing."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), np.zeros(x.shape[1])
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z
        h[np.diag_indices_from(h)] += penalty
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return float(w[0]), w[1:]


def train(counts: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Models of the chain from word counts, 0/1 targets (a column each) and fold numbers."""
    x = np.log1p(counts)
    earlier = np.zeros((len(x), 0))
    models = []
    for k in range(targets.shape[1]):
        full, y = np.concatenate([x, earlier], axis=1), targets[:, k]
        bias, w = _fit(full, y)
        models.append((bias, w[: x.shape[1]], w[x.shape[1] :]))
        outside = np.zeros(len(x))
        for f in np.unique(folds):
            at = folds == f
            b, v = _fit(full[~at], y[~at])
            outside[at] = _sigmoid(b + full[at] @ v)
        earlier = np.concatenate([earlier, outside[:, None]], axis=1)
    return models


def _features(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and their text numbers."""
    parts = [(words.hashes, words.text), *(words.prefixes(k) for k in BEGINNINGS)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _word_rows(batches, kinds: int):
    """Distinct word hashes of every text, with the targets of the row."""
    for batch in batches:
        targets = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(kinds)], axis=1)
        for at, _, raw, offsets in K.chunks(batch.column(0)):
            words = K.Words(raw, offsets, K.ALNUM)
            values, offs = K.distinct(*_features(words), words.n_texts)
            rows = np.repeat(np.arange(at, at + words.n_texts), np.diff(offs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), *(pa.array(targets[rows, i].astype(np.int32)) for i in range(kinds))],
                names=["word", *(f"y{i}" for i in range(kinds))],
            )


def _copy_keys(batches):
    """A few MinHash minima of the shingles of every training row."""
    for batch in batches:
        for at, to, raw, offsets in K.chunks(batch.column(1)):
            words = K.Words(raw, offsets, K.ALNUM)
            low = K.minima(*K.distinct(*K.shingles(words, 3), words.n_texts), COPY_KEYS).astype(np.int64)
            low += np.arange(COPY_KEYS, dtype=np.int64) << 32
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, COPY_KEYS, dtype=np.int32)), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], lists], names=["row", "keys"])


def without_copies(sample: DataFrame) -> DataFrame:
    """Training rows that share no shingle minimum with an earlier one: a text that was copied
    many times, with its label, would make its own words look telling."""
    keys = sample.select("row", "text").mapInArrow(_copy_keys, "row long, keys array<long>").select("row", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min("row").alias("first"))
    late = keys.join(first, "key").where("row > first").select("row").distinct()
    return sample.join(late, "row", "left_anti")


def _counts(words: K.Words, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each vocabulary word in each text."""
    size = len(vocabulary)
    if not size or not len(words.hashes):
        return np.zeros((words.n_texts, size))
    hashes, text = _features(words)
    p = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
    hit = vocabulary[p] == hashes
    return np.bincount(text[hit] * size + p[hit], minlength=words.n_texts * size).reshape(-1, size)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS) -> Chain:
    """Train the chain on at most ``max_rows`` labelled rows, copies among them left out.

    ``categories`` names 0/1 expressions over the columns of ``labels``, in chain order; a
    null counts as 0.  Labels of one doc_id are merged by their maximum, of the texts of one
    doc_id the one with the smallest hash is taken; rows with a null id are left out.  Without labelled rows every probability is that of an empty table, about 0.
    """
    kinds = list(categories)
    known = labels.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values()))
    ).groupBy("_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(kinds))))
    present = docs.select(F.col("doc_id").alias("_id")).distinct()
    chosen = known.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(max_rows)
    # at most max_rows rows of a few integers: bounded whatever the size of the tables
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
    # an id may stand on many texts: the one with the smallest hash is trained on
    drawn = first_rows(drawn.withColumn("hash", F.xxhash64("text")), ["doc_id"], ["hash", "text"]).drop("hash")
    drawn = cut_lineage(drawn.withColumn("row", F.monotonically_increasing_id()))
    sample = cut_lineage(without_copies(drawn))
    ys = [f"y{i}" for i in range(len(kinds))]
    n_kinds = len(kinds)
    by_word = (
        sample.select("text", *ys)
        .mapInArrow(lambda b: _word_rows(b, n_kinds), ", ".join(["word long", *(f"{y} int" for y in ys)]))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in ys))
    )
    total = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    vocabulary: set[int] = set()
    for y in ys:
        size, positive = float(total["n"]), float(total[y] or 0)
        if not 0 < positive < size:
            continue
        a, n = F.col(y).cast("double"), F.col("n").cast("double")
        gap = a * (size - n - positive + a) - (n - a) * (positive - a)
        chi2 = size * gap * gap / (n * (size - n + 1e-9) * positive * (size - positive))
        best = by_word.where(F.col("n") >= LEAST_DOCS).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
        vocabulary |= {r["word"] for r in best.orderBy(F.desc("chi2"), "word").limit(WORDS).select("word").collect()}
    words = np.sort(np.array(sorted(vocabulary), dtype=np.int64).view(np.uint64))

    def features(batches):
        for batch in batches:
            for at, to, raw, offsets in K.chunks(batch.column(0)):
                counts = _counts(K.Words(raw, offsets, K.ALNUM), words)
                row, col = np.nonzero(counts)
                offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offs), pa.array(v.astype(np.int32))) for v in (col, counts[row, col])]
                yield pa.RecordBatch.from_arrays(
                    [*lists, *(batch.column(i + 1)[at:to] for i in range(n_kinds + 1))], names=["at", "times", *ys, "fold"]
                )

    rows = (
        sample.select("text", *ys, F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"))
        .mapInArrow(features, ", ".join(["at array<int>", "times array<int>", *(f"{y} int" for y in ys), "fold int"]))
        .orderBy("fold", "at", "times", *ys).toPandas()
    )
    counts = np.zeros((len(rows), len(words)))
    for i, (at, times) in enumerate(zip(rows["at"], rows["times"], strict=True)):
        counts[i, np.asarray(at, dtype=int)] = times
    targets = rows[ys].to_numpy(dtype=float).reshape(len(rows), n_kinds)
    return Chain(tuple(kinds), words, tuple(train(counts, targets, rows["fold"].to_numpy())))


def score(docs: DataFrame, chain: Chain, verdict: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_<category>..., rejected, mark)`` for each row of ``docs``.

    ``rejected`` says that the probability of the category ``verdict`` reaches ``threshold``.
    Whole texts are read; a null text counts as empty and gets the probability of no words.
    Null and repeated ids stay as they are; ``mark`` is the hash of the text, by which rows that
    share an id are told apart; other columns are ignored.
    """
    at = chain.categories.index(verdict)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for batch in batches:
            for lo, hi, raw, offsets in K.chunks(batch.column(1)):
                p = chain.probabilities(_counts(K.Words(raw, offsets, K.ALNUM), chain.words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi].cast(pa.int64()), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, at] >= threshold),
                     batch.column(2)[lo:hi]],
                    names=["doc_id", *names, "rejected", "mark"],
                )

    schema = ", ".join(["doc_id long", *(f"{n} double" for n in names), "rejected boolean", "mark long"])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, schema)


#: Chain order: junk first, then toxicity, then junk that is toxic.
CATEGORY_SQL = {
    "junk": "quality = 0",
    "toxic": "toxic = 1",
    "severe": "toxic = 1 AND quality = 0",
}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score every row; see :func:`score`."""
    return score(docs, fit(docs, labels, {k: F.expr(v) for k, v in CATEGORY_SQL.items()}), "toxic", threshold)
