"""Document quality: random Fourier features, ridge by summed normal equations, isotonic scores."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.llm import kernels as K
from taxograft.plans.lineage import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 256
#: Width of the Gaussian kernel in standard deviations of the statistics.
WIDTH = 3.0
RIDGE = 1.0
BINS = 512
#: Tasks whose sums of normal equations are added up at once.
SUMS = 256
#: Range of raw scores that the bins cut; rarer ones fall into the outer bins.
LOW, HIGH = -0.5, 1.5

_B = np.arange(256)


def _is(chars: str) -> np.ndarray:
    return np.isin(_B, np.frombuffer(chars.encode(), dtype=np.uint8))


_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_CLASSES = (_UPPER, _LOWER, (_B >= 48) & (_B <= 57), _is("#$%&*@^~+=<>"), _is("!?"), _is("|"), _is(".,;:"), _is("\n"), _is(" \t"), _B >= 128)


def statistics(words: K.Words) -> np.ndarray:
    """One row of statistics for each text: shares of byte classes, word lengths, repetition."""
    n = words.n_texts
    size = np.diff(words.offsets).astype(float)
    count = words.per_text.astype(float)
    at_least = lambda x: np.maximum(x, 1.0)
    shares = []
    for kind in _CLASSES:
        total = np.concatenate([[0], np.cumsum(kind[words.data])])
        shares.append((total[words.offsets[1:]] - total[words.offsets[:-1]]) / at_least(size))
    length = (words.ends - words.starts).astype(float)
    mean = np.bincount(words.text, length, minlength=n) / at_least(count)
    square = np.bincount(words.text, length**2, minlength=n) / at_least(count)
    same = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
    repeated = np.bincount(words.text[1:][same], minlength=n) / at_least(count)
    _, offs = K.distinct(words.hashes, words.text, n)
    kinds = np.diff(offs)
    first = words.data[words.starts] if len(words.starts) else np.zeros(0, dtype=np.uint8)
    capital = np.bincount(words.text[_UPPER[first]], minlength=n) / at_least(count)
    return np.stack([
        *shares, mean, np.sqrt(np.maximum(square - mean**2, 0)), repeated,
        np.log1p(kinds) / at_least(np.log1p(count)), capital, np.log1p(count), np.log1p(size),
    ], axis=1)


WIDE = len(_CLASSES) + 7


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` of every row: the statistics of its whole text."""

    def run(batches):
        for batch in batches:
            for at, to, raw, offsets in K.chunks(batch.column(1)):
                x = statistics(K.Words(raw, offsets, K.NON_SPACE))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDE, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to].cast(pa.int64()), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Standardisation, random frequencies, ridge weights, and the calibrated curve."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([np.ones((len(x), 1)), f], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.curve_x, self.curve_y)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing values, weighted by ``n``."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, WIDE))


def fit(rows: DataFrame, features: int = FEATURES, seed: int = 3) -> Model:
    """Fit on ``rows(x, label, calibrate)``: ridge on the rows without ``calibrate``, the isotonic
    curve on those with it.  All rows count: tasks sum their part of the normal equations and of
    the calibration bins, and only these sums, of fixed size, reach the driver."""
    stats = rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"))
    mean, scale = np.zeros(WIDE), np.ones(WIDE)
    for r in stats.collect():
        mean[r["pos"]], scale[r["pos"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1.0
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (WIDE, features)), rng.uniform(0, 2 * np.pi, features),
                  np.zeros(features + 1), np.array([0.0]), np.array([0.5]))

    def sums(batches):
        task = TaskContext.get().partitionId()
        total = np.zeros((features + 1, features + 2))
        for pdf in batches:
            f = model.features(_matrix(pdf["x"]))
            total += f.T @ np.concatenate([f, pdf["label"].to_numpy(dtype=float)[:, None]], axis=1)
        yield pd.DataFrame({"part": task // SUMS, "i": range(features + 1), "v": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "i": [int(pdf["i"].iloc[0])], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    fitted = rows.where("NOT calibrate").select("x", F.col("label").cast("double").alias("label"))
    shape = "part int, i int, v array<double>"
    # a tree of two levels: rows of SUMS tasks are added before all of them are
    some = fitted.mapInPandas(sums, shape).groupBy("part", "i").applyInPandas(add, shape)
    summed = some.groupBy("i").applyInPandas(add, shape)
    whole = np.zeros((features + 1, features + 2))
    for r in summed.collect():
        whole[r["i"]] = r["v"]
    penalty = np.full(features + 1, RIDGE)
    penalty[0] = 1e-6
    weights = np.linalg.solve(whole[:, :-1] + np.diag(penalty), whole[:, -1])
    model = Model(mean, scale, model.frequency, model.phase, weights, model.curve_x, model.curve_y)

    def binned(batches):
        for pdf in batches:
            raw = model.raw(_matrix(pdf["x"]))
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            yield pd.DataFrame({"bin": at, "raw": raw, "label": pdf["label"].to_numpy(dtype=float)})

    bins = (
        rows.where("calibrate").select("x", F.col("label").cast("double").alias("label"))
        .mapInPandas(binned, "bin int, raw double, label double")
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("label").alias("label"))
        .orderBy("bin").toPandas()
    )
    if not len(bins):
        return Model(mean, scale, model.frequency, model.phase, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    n = bins["n"].to_numpy(dtype=float)
    smooth = (bins["label"].to_numpy() * n + 0.5) / (n + 1)  # a lone row is not certain
    curve = isotonic(smooth, n)
    # a slight slope keeps the order of scores inside a pooled block
    x = bins["raw"].to_numpy()
    y = np.clip(curve * 0.999 + 0.001 * np.clip((x - LOW) / (HIGH - LOW), 0, 1), 0, 1)
    return Model(mean, scale, model.frequency, model.phase, weights, x, y)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    ``held_out`` rows have ``crc32(doc_id as text) mod 4 = 2``; a null id has no check sum and
    is not held out, nor labelled.  Of the other labelled rows, those with remainder 3 calibrate
    and the rest fit.  Several labels of one id count once, by their minimum; null labels not at
    all.  A null text counts as empty; an empty text is scored by its statistics, all 0.  Texts of
    any length are read whole, equal texts get equal scores, and a table without rows gives none.
    Without labelled rows every score is 0.5 or the raw one.  Other columns are ignored.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = cut_lineage(document_statistics(docs).withColumn("part", F.coalesce(part, F.lit(0).cast("long"))))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("quality").alias("label")
    )
    train = cut_lineage(
        rows.where("part <> 2").join(known, F.col("doc_id") == F.col("_id")).select("x", "label", (F.col("part") == 3).alias("calibrate"))
    )
    model = fit(train)

    def run(batches):
        for batch in batches:  # ids stay in Arrow: beside a null, pandas would turn them into floats
            x = batch.column(1).flatten().to_numpy().reshape(-1, WIDE)
            score = model.calibrated(model.raw(x))
            held_out = batch.column(2).to_numpy() == 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held_out), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.select("doc_id", "x", "part").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
