"""Ranked lexical search by an exact sparse ball tree.

Documents are sparse vectors of integer term scores, an item is the 0/1 vector of its terms, and
the score is their inner product.  Documents are sorted by their heaviest term and their length
over range partitions, so that a block of ``BLOCK`` rows holds similar ones; each block is split
into a tree of balls.  A ball with centroid ``c`` and radius ``r`` holds no document above
``q.c + |q| r``; the bound is rounded up by more than the floating-point error, and a subtree below
the ``k``-th best score known is passed over.  Subtrees are taken best first; at the leaves scores
are summed in 64-bit integers, so results are exact.

Blocks first look into their best leaf only.  What the best of these leaves hold gives every
item a threshold that all blocks then start from.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.llm import kernels as K
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import top_k

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of one tree and of one leaf.
BLOCK = 1024
LEAF = 64
#: Item terms searched in one pass, which bounds what a task is sent; more items take more passes.
PASS_TERMS = 100_000


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, h)``: the distinct terms of every item, by hash."""

    def run(batches):
        for batch in batches:
            for at, _, raw, offsets in K.chunks(batch.column(2)):
                words = K.Words(raw, offsets, K.ALNUM)
                values, offs = K.distinct(words.hashes, words.text, words.n_texts)
                pick = pa.array(np.repeat(np.arange(at, at + words.n_texts), np.diff(offs)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(values.view(np.int64))],
                    names=["item", "item_id", "h"],
                )

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    return rows.mapInArrow(run, "item long, item_id long, h long")


def document_vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of all rows: count of all terms, and those of the sorted vocabulary."""

    def run(batches):
        for batch in batches:
            for at, to, raw, offsets in K.chunks(batch.column(1)):
                words = K.Words(raw, offsets, K.ALNUM)
                place = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
                known = vocabulary[place] == words.hashes
                pair = words.text[known] * len(vocabulary) + place[known]
                pair, tf = np.unique(pair, return_counts=True)
                text, term = np.divmod(pair, len(vocabulary))
                offs = np.zeros(words.n_texts + 1, dtype=np.int32)
                np.cumsum(np.bincount(text, minlength=words.n_texts), out=offs[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(words.per_text.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Rows:
    """Sparse integer vectors of some documents."""

    def __init__(self, ids: list, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.ids, self.sizes, self.terms, self.values = ids, sizes, terms, values
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * dense[self.terms], len(self.sizes))

    def squares(self) -> np.ndarray:
        return np.bincount(self.owner, self.values.astype(np.float64) ** 2, len(self.sizes))

    def mean(self, dim: int) -> np.ndarray:
        return np.bincount(self.terms, self.values, dim) / len(self.sizes)

    def reach(self, centre: np.ndarray) -> np.ndarray:
        """Largest distance from the centre along every term; a row without the term lies at 0."""
        out = np.where(np.bincount(self.terms, minlength=len(centre)) < len(self.sizes), centre, 0.0)
        np.maximum.at(out, self.terms, np.abs(self.values - centre[self.terms]))
        return out

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Rows([self.ids[i] for i in rows], sizes, self.terms[at], self.values[at])

    def exact(self, asked: np.ndarray) -> np.ndarray:
        """Integer scores against the terms marked in ``asked``."""
        total = np.zeros(len(self.values) + 1, dtype=np.int64)
        np.cumsum(np.where(asked[self.terms], self.values, 0), out=total[1:])
        return total[self.ends] - total[self.starts]


class Tree:
    """Balls of documents: children of each node, leaves with their rows, centroids and radii."""

    def __init__(self, rows: Rows, dim: int, leaf: int = LEAF):
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, Rows] = {}
        centres: list[np.ndarray] = []
        radii: list[float] = []
        along: list[np.ndarray] = []
        todo = [(rows, None, 0)]
        while todo:
            part, parent, side = todo.pop()
            node = len(self.children)
            self.children.append(None)
            if parent is not None:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            centre, squares = part.mean(dim), part.squares()
            length = float(centre @ centre)
            # the three terms cancel: add more than their rounding error before the root
            far = squares - 2 * part.dot(centre) + length + 1e-9 * (squares + length)
            centres.append(centre)
            radii.append(math.sqrt(max(float(far.max()), 0.0)) * (1 + 1e-9))
            along.append(part.reach(centre))
            if len(part.sizes) <= leaf:
                self.leaves[node] = part
                continue
            # split between the row farthest from the centre and the row farthest from it
            one = self._dense(part, int(far.argmax()), dim)
            away = squares - 2 * part.dot(one)
            other = self._dense(part, int(away.argmax()), dim)
            order = np.argsort(part.dot(one - other), kind="stable")
            half = len(order) // 2
            todo += [(part.take(order[:half]), node, 0), (part.take(order[half:]), node, 1)]
        self.centres, self.radii, self.along = np.stack(centres), np.array(radii), np.stack(along)

    @staticmethod
    def _dense(part: Rows, row: int, dim: int) -> np.ndarray:
        out = np.zeros(dim)
        own = slice(part.starts[row], part.ends[row])
        out[part.terms[own]] = part.values[own]
        return out

    def bounds(self, asked: list[np.ndarray]) -> np.ndarray:
        """For each list of distinct terms an upper bound of its score in each node."""
        sizes = np.array([len(terms) for terms in asked])
        terms, starts = np.concatenate(asked), np.cumsum(sizes) - sizes
        near = np.add.reduceat(self.centres[:, terms], starts, axis=1)
        apart = np.add.reduceat(self.along[:, terms], starts, axis=1)
        return ((near + np.minimum(self.radii[:, None] * np.sqrt(sizes), apart)) * (1 + 1e-9) + 1).T


class Best:
    """The ``k`` best (score, id) of an item; null ids after all others."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.heap = k, max(1, floor), []

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.floor = max(self.floor, self.heap[0][0])


def search_tree(tree: Tree, asked: list[np.ndarray], best: list[Best], leaves: int | None = None) -> int:
    """Best-first search of one tree for every item; ``leaves`` stops after as many.  Returns the
    number of leaves that were scored."""
    bounds = tree.bounds(asked)
    marked = np.zeros(tree.centres.shape[1], dtype=bool)
    scored = 0
    for i, found in enumerate(best):
        heap, seen = [(-bounds[i, 0], 0)], 0
        marked[asked[i]] = True
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < found.floor:
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if bounds[i, child] >= found.floor:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            rows = tree.leaves[node]
            scores = rows.exact(marked)
            for r in np.flatnonzero(scores >= found.floor):
                found.add(int(scores[r]), rows.ids[r])
            seen += 1
            if seen == leaves:
                break
        marked[asked[i]] = False
        scored += seen
    return scored


def search(
    vectors: DataFrame, items: dict[int, np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int,
    floors: dict[int, int], leaves: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """The best ``k`` ``(item, doc_id, score)`` that each partition of sorted ``vectors`` holds."""
    names = list(items)

    def run(batches: Iterator[pa.RecordBatch]):
        dim = len(weights)
        asked = [items[name] for name in names]
        best = [Best(k, floors.get(name, 0)) for name in names]

        def finish(rows: list[pa.RecordBatch]) -> None:
            data = pa.Table.from_batches(rows).combine_chunks()
            terms, tfs = (data.column(c).combine_chunks() for c in ("terms", "tfs"))
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n = data.column("n").to_numpy()
            tf = tfs.flatten().to_numpy().astype(np.int64)
            term = terms.flatten().to_numpy().astype(np.int64)
            slack = 10 + (90 * n * n_docs) // n_terms
            values = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(slack, sizes)))
            tree = Tree(Rows(data.column("doc_id").to_pylist(), sizes, term, values), dim)
            search_tree(tree, asked, best, leaves)

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= block:
                finish(held)
                held, count = [], 0
        if count:
            finish(held)
        out = [(name, (-e[2] if e[1] else None), e[0]) for name, b in zip(names, best, strict=True) for e in b.heap]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, pass_terms: int = PASS_TERMS, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents ``(item_id, rank, doc_id, score)`` of every item, scores above 0 only.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, told apart
    by 64-bit hashes.  With ``N`` documents that have terms, ``L`` terms in all of them and a term in
    ``df`` documents, its weight is ``floor(1000 ln((2N+2)/(2df+1)))``; a document with ``n`` terms
    adds ``weight * ((10^9 tf) div (1000 tf + 8 (10 + (90 n N) div L)))`` for each term of the item.

    Null and empty texts have no terms: such documents are never found, such items find
    nothing.  Equal scores go by ascending doc_id, null ids last; repeated rows are ranked one by
    one, and a repeated item has its rows each time.  Texts of any length are read whole.  Empty
    tables give no rows; other columns are ignored.
    """
    parts = cut_lineage(item_terms(items))
    passes = max(1, -(-parts.count() // pass_terms))
    best = lambda rows: top_k(rows, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    found = None
    for number in range(passes):
        # bounded by pass_terms pairs and the longest item
        own = parts.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).select("item", "h").toArrow()
        item, h = own.column(0).to_numpy(), own.column(1).to_numpy().view(np.uint64)
        if not len(h):
            continue
        vocabulary, term = np.unique(h, return_inverse=True)
        wanted = {int(i): term[item == i] for i in np.unique(item)}
        vectors = cut_lineage(document_vectors(docs, vocabulary))
        total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
        if not total["l"]:
            continue
        counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        df[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        # by the rarest term: documents that share it lie side by side, long ones apart from short ones
        places = F.lit(np.argsort(np.argsort(df, kind="stable"), kind="stable").astype(np.int32))
        sorted_ = (
            vectors.where(F.size("terms") > 0)
            .withColumns({"_key": F.array_min(F.transform("terms", lambda t: F.get(places, t))), "_size": F.size("terms")})
            .repartitionByRange("_key", "_size", F.xxhash64("doc_id", "n")).sortWithinPartitions("_key", "_size")
        )
        at = lambda floors, leaves: best(
            search(sorted_, wanted, weights, total["n"], total["l"], k, floors, leaves, block)
        )
        first = at({}, 1).where(F.col("rank") == k).select("item", "score").toArrow()
        floors = dict(zip(first.column(0).to_pylist(), first.column(1).to_pylist(), strict=True))
        rows = cut_lineage(at(floors, None))
        found = rows if found is None else found.unionByName(rows)
    ids = parts.select("item", "item_id").distinct()
    if found is None:
        return ids.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found.join(ids, "item").select("item_id", "rank", "doc_id", "score")


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

SQL = f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
z AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, z),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN d USING (doc_id), z GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
