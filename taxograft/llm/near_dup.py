"""Near-duplicate documents by b-bit MinHash.

1. Each text gets its distinct word shingles, ``bands * rows`` MinHash minima, a band key for
   every ``rows`` minima, and the two low bits of every minimum packed into longs.
2. Texts with the same shingle set form a class; only one member of a class goes on.
3. Band buckets name candidates.  Instead of all pairs of a bucket, every class meets the
   bucket's *pivot* (the class with most copies, then the smallest id).  Bit counts over the
   packed signatures give the collision-corrected similarity; pairs that may reach the
   threshold are confirmed on the full shingle sets.
4. Classes around one pivot that are still in different components are compared with each
   other in tiles: blocks of bounded size, and only blocks whose set sizes may reach the
   threshold.  A tile first gets packed signatures; shingle sets are sent for those classes only
   that have a partner there by bit counts.  Links that join two components leave a tile.
"""

from __future__ import annotations

import sys
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.llm import kernels as K
from taxograft.llm.common import components
from taxograft.plans.lineage import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 2
#: Standard errors by which an estimate may fall short before a pair is dismissed.
MARGIN = 5.0
#: Bounds of one block of a group: shingles, and classes.
BLOCK_SHINGLES = 500_000
BLOCK_CLASSES = 1_024
TILE = ["pivot", "band", "cross", "i", "j"]
#: Vocabulary columns of one exact matrix product.
COLUMNS = 4_096


def pack(minima: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of every minimum, 32 of them in each long."""
    n, k = minima.shape
    out = np.zeros((n, -(-k // 32)), dtype=np.uint64)
    for i in range(k):
        out[:, i // 32] |= (minima[:, i].astype(np.uint64) & np.uint64(3)) << np.uint64(BITS * (i % 32))
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(minima), bands), dtype=np.uint64)
    for j in range(bands):
        h = np.full(len(minima), j + 1, dtype=np.uint64)
        for i in range(j * rows, (j + 1) * rows):
            h = h * np.uint64(0xD6E8FEB86659FD93) + minima[:, i].astype(np.uint64)
        keys[:, j] = K.mix(h)
    return keys


def _fingerprints(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums that name a shingle set."""
    zero = np.uint64(0)
    one = K.reduce_texts(np.add, K.mix(values), offsets, zero)
    two = K.reduce_texts(np.add, K.mix(values ^ np.uint64(0x5851F42D4C957F2D)), offsets, zero)
    return one.view(np.int64), two.view(np.int64)


def _cut(texts, width: int):
    for at, to, raw, offsets in K.chunks(texts):
        words = K.Words(raw, offsets, K.NON_SPACE)
        values, offs = K.distinct(*K.shingles(words, width), words.n_texts)
        yield at, to, values, offs


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, mark, n, f1, f2, sig, keys)`` of every row."""
    schema = "doc_id long, mark long, n long, f1 long, f2 long, sig array<long>, keys array<long>"

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, to, values, offs in _cut(batch.column(1), width):
                low = K.minima(values, offs, bands * rows)
                f1, f2 = _fingerprints(values, offs)
                n = np.diff(offs)
                flat = lambda m: pa.ListArray.from_arrays(
                    pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [ids[at:to].cast(pa.int64()), batch.column(2)[at:to], pa.array(n), pa.array(f1), pa.array(f2),
                     flat(pack(low)), flat(band_keys(low, bands, rows))],
                    names=["doc_id", "mark", "n", "f1", "f2", "sig", "keys"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, schema)


def sets(texts: DataFrame, width: int) -> DataFrame:
    """``(cid, items)``: the sorted shingle set of every row of ``texts(cid, text)``."""

    def run(batches):
        for batch in batches:
            for at, to, values, offs in _cut(batch.column(1), width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:to], K.list_column(values, offs)], names=["cid", "items"]
                )

    return texts.select("cid", "text").mapInArrow(run, "cid long, items array<long>")


def least_estimate(threshold: float, minima: int) -> float:
    """Estimated similarity below which a pair is dismissed unconfirmed."""
    chance = 0.5**BITS
    p = chance + (1 - chance) * threshold
    return threshold - MARGIN * float(np.sqrt(p * (1 - p) / minima)) / (1 - chance)


def estimate(a, b, minima: int):
    """Collision-corrected similarity of two packed signatures (columns)."""
    odd = F.lit(0x5555555555555555)
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)).cast("int"),
    )
    chance = 0.5**BITS
    return (1 - differ / F.lit(float(minima)) - chance) / (1 - chance)


def _suspects(threshold: Fraction, minima: int):
    """Kernel over one tile of signatures: the rows with a partner in another component."""
    low = least_estimate(float(threshold), minima)
    chance = 0.5**BITS
    most = int(np.floor(minima * (1 - chance - low * (1 - chance))))  # differing places
    num, den = threshold.numerator, threshold.denominator

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack(pdf["sig"].to_numpy()).astype(np.int64).view(np.uint64)
        left, right = np.flatnonzero(pdf["left"]), np.flatnonzero(pdf["right"])
        comp, n = pdf["comp"].to_numpy(), pdf["n"].to_numpy()
        differ = np.zeros((len(left), len(right)), dtype=np.uint16)
        for c in range(sig.shape[1]):
            x = sig[left, c][:, None] ^ sig[right, c][None, :]
            differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        may = (differ <= most) & (comp[left][:, None] != comp[right][None, :])
        na, nb = n[left][:, None], n[right][None, :]
        may &= den * np.minimum(na, nb) >= num * np.maximum(na, nb)
        rows = np.union1d(left[may.any(axis=1)], right[may.any(axis=0)])
        return pdf.iloc[rows][[*TILE, "left", "right", "cid", "comp", "n"]]

    return run


def _links(threshold: Fraction):
    """Kernel over one tile of shingle sets: links between classes of different components."""
    num, den = threshold.numerator, threshold.denominator

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["left"]], pdf[pdf["right"]]
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            # sets are sorted as unsigned numbers
            xa, xb = ([np.asarray(x, dtype=np.int64).view(np.uint64) for x in side["items"]] for side in (left, right))
            vocabulary = np.intersect1d(np.concatenate(xa), np.concatenate(xb))
            common = np.zeros((len(xa), len(xb)), dtype=np.int64)
            for at in range(0, len(vocabulary), COLUMNS):
                part = vocabulary[at : at + COLUMNS]

                def matrix(rows):
                    m = np.zeros((len(rows), len(part)), dtype=np.float32)
                    for k, items in enumerate(rows):
                        has = items[np.searchsorted(items, part[0]) : np.searchsorted(items, part[-1], "right")]
                        p = np.searchsorted(part, has)
                        m[k, p[part[p] == has]] = 1
                    return m

                # at most COLUMNS a product, so its sums are whole numbers in float32
                common += (matrix(xa) @ matrix(xb).T).astype(np.int64)
            union = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - common
            ca, cb = left["comp"].to_numpy(), right["comp"].to_numpy()
            linked = (ca[:, None] != cb[None, :]) & (den * common >= num * union)
            up: dict[int, int] = {}

            def top(x):
                while up.setdefault(x, x) != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            ia, ib = left["cid"].to_numpy(), right["cid"].to_numpy()
            for p, q in zip(*np.nonzero(linked), strict=True):
                x, y = top(int(ca[p])), top(int(cb[q]))
                if x != y:
                    up[x] = y
                    found.append((int(ia[p]), int(ib[q])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def suspects(around: DataFrame, threshold: Fraction, minima: int) -> DataFrame:
    """The members of open groups that need their sets, once for each tile they need them in.

    ``around(pivot, cid, comp, n, sig)`` are the classes around each pivot.  A group is open when
    it holds more than one component.  Its classes fall into bands of set sizes, so that sizes
    within the threshold are in one band or two neighbouring ones, and each band into blocks.
    """
    step = float(np.log(1 / float(threshold))) * (1 + 1e-6) or 1e-9
    rows = around.withColumn("band", F.floor(F.log(F.col("n")) / step).cast("long"))
    bands = cut_lineage(rows.groupBy("pivot", "band").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    ))
    open_ = bands.groupBy("pivot").agg(
        F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("m").alias("m"),
        (F.sum("m") <= BLOCK_CLASSES).alias("few"), (F.sum("total") <= BLOCK_SHINGLES).alias("short"),
    ).where("c0 <> c1 AND m > 2").select("pivot", (F.col("few") & F.col("short")).alias("whole"))
    bands = bands.join(open_, "pivot").select("pivot", "band", "whole", F.least("m", F.ceil(F.greatest(
        F.col("total") / BLOCK_SHINGLES, F.col("m") / BLOCK_CLASSES
    ))).cast("int").alias("blocks"))
    near = lambda name, by: bands.where(~F.col("whole")).select(
        "pivot", (F.col("band") + by).alias("band"), F.col("blocks").alias(name)
    )
    # a group that fits one block is one tile, whatever its bands
    bands = cut_lineage(
        bands.join(near("above", -1), ["pivot", "band"], "left").join(near("below", 1), ["pivot", "band"], "left")
        .select(
            "pivot", "band", F.when(F.col("whole"), F.lit(0)).otherwise(F.col("band")).alias("own"),
            F.when(F.col("whole"), F.lit(1)).otherwise(F.col("blocks")).alias("blocks"),
            F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"),
        )
    )

    def tiles(blocks, body):
        numbers = F.slice(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), 1, blocks)
        return F.transform(numbers, lambda o: F.struct(
            *(c.alias(name) for c, name in zip(body(o), ["band", "cross", "i", "j", "left", "right"], strict=True))
        ))

    block, band, yes, no = F.col("block"), F.col("own"), F.lit(True), F.lit(False)
    spread = (
        rows.join(bands, ["pivot", "band"])
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("tile", F.explode(F.concat(
            tiles(F.col("blocks"), lambda o: (band, no, F.least(block, o), F.greatest(block, o), block <= o, block >= o)),
            tiles(F.col("above"), lambda o: (band, yes, block, o, yes, no)),
            tiles(F.col("below"), lambda o: (band - 1, yes, o, block, no, yes)),
        )))
        .select("pivot", "tile.*", "cid", "comp", "n", "sig")
    )
    schema = "pivot long, band long, cross boolean, i int, j int, left boolean, right boolean, cid long, comp long, n long"
    # signatures are few bytes but much work: a stated number of tasks is not coalesced by size
    tasks = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(tasks, *TILE).groupBy(*TILE).applyInPandas(_suspects(threshold, minima), schema)


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), bands: int = 26, rows: int = 4
) -> DataFrame:
    """One row ``(doc_id, n_shingles, component_id, class_id, kept, mark, comp)`` for each row of ``docs``.

    Texts are linked when their sets of distinct ``width``-word shingles have a Jaccard
    similarity of at least ``threshold``; ``component_id`` is the smallest doc_id reachable.
    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer words
    is one shingle, and a text without words (or null) has an empty set, is linked with nothing
    and is its own component.  ``class_id`` is the smallest doc_id with the same set.

    Rows with a null doc_id take part; an id is null only where every doc_id of the group is.
    ``kept`` marks the rows with ``doc_id = component_id``, so a repeated row stays repeated; of
    a component without any id, it marks the first row read.  ``mark`` is the hash of the text,
    by which rows that share an id are told apart.  Other columns are ignored.
    A link at the threshold escapes all bands with probability ``(1 - t**rows) ** bands``.
    """
    rows_ = cut_lineage(sketch(docs, width, bands, rows).withColumn("uid", F.monotonically_increasing_id()))
    filled = rows_.where("n > 0")
    classes = cut_lineage(
        filled.groupBy("f1", "f2", "n").agg(
            F.min("uid").alias("cid"), F.count(F.lit(1)).alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("row"),
            F.first("sig").alias("sig"), F.first("keys").alias("keys"),
        ).withColumn("class_id", F.col("row.doc_id"))
    )
    keyed = classes.select(
        F.explode("keys").alias("key"), F.struct((-F.col("copies")).alias("c"), F.col("cid").alias("id")).alias("rank")
    )
    # tables that are joined on the key they were grouped by are written first: only then can a
    # hot key be split when it is joined
    pivots = cut_lineage(
        keyed.groupBy("key").agg(F.min("rank").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    )
    pairs = cut_lineage(
        keyed.join(pivots, "key")
        .select(F.col("rank.id").alias("cid"), F.col("pivot.id").alias("pivot"))
        .where("cid <> pivot").distinct()
    )
    # the text of one row of every candidate, found by its id and the hash of its text
    wanted = (
        pairs.select("cid").union(pairs.select("pivot")).distinct()
        .join(classes.select("cid", "row"), "cid")
        .select("cid", F.coalesce("row.doc_id", F.lit(0)).alias("id"), "row.no_id", "row.mark")
    )
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64("text").alias("mark"), "text",
    )
    row = ["id", "no_id", "mark"]
    full = cut_lineage(sets(texts.join(wanted, row).dropDuplicates(row), width))
    k = bands * rows
    num, den = threshold.numerator, threshold.denominator
    signed = lambda name, tag: classes.select(
        F.col("cid").alias(name), F.col("n").alias(f"n{tag}"), F.col("sig").alias(f"s{tag}")
    )
    near = (
        pairs.join(signed("cid", "a"), "cid").join(signed("pivot", "b"), "pivot")
        .where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        .where(estimate(F.col("sa"), F.col("sb"), k) >= least_estimate(float(threshold), k))
        .select("cid", "pivot", "na", "nb")
    )
    side = lambda name, tag: full.select(F.col("cid").alias(name), F.col("items").alias(f"x{tag}"))
    common = F.size(F.array_intersect("xa", "xb"))
    star = cut_lineage(
        near.join(side("cid", "a"), "cid").join(side("pivot", "b"), "pivot")
        .where(den * common >= num * (F.col("na") + F.col("nb") - common))
        .select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    )
    first = components(star)

    around = pairs.union(pairs.select(F.col("pivot").alias("cid"), "pivot").distinct())
    around = cut_lineage(
        around.join(first.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("comp", F.coalesce("comp", "cid"))
        .join(classes.select("cid", "n", "sig"), "cid")
    )
    rest = (
        suspects(around, threshold, k).join(full, "cid")
        .groupBy(*TILE).applyInPandas(_links(threshold), "a long, b long")
    )
    comp = components(star.union(cut_lineage(rest)))
    members = cut_lineage(
        classes.select("f1", "f2", "n", "class_id", F.col("cid").alias("node")).join(comp, "node", "left")
        .withColumn("comp", F.coalesce("comp", "node")).drop("node")
    )
    smallest = cut_lineage(members.groupBy("comp").agg(F.min("class_id").alias("component_id")))
    named = members.join(smallest, "comp")
    out = rows_.select("uid", "doc_id", "mark", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    own = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        # the label of a component is the smallest row number in it
        F.when(own, F.lit(True)).when(F.col("component_id").isNull(), F.col("uid") == F.col("comp"))
        .otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"), "mark",
        # tells components apart that share their smallest doc_id
        F.when(~own, F.col("comp")).alias("comp"),
    )
