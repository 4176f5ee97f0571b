"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in a seeded order, are cut into blocks, and one block is dealt in every
slot.  The target of a source is fluid: at every moment the sources that still have blocks
share the next one in proportion to their weights, and a source leaves when its target reaches
its blocks.  Block ``i`` is released in the slot in which the target passes ``i`` and due in the
one in which it reaches ``i + 1``; of the released blocks the one with the earliest deadline is
dealt.  The fluid targets fit into these windows, so every block is dealt inside its own, and in
every prefix each source is less than one block off its target, before and after others have
left.

Release times and deadlines are taken from the weights exactly, in integers.  Dealing is a pass
over the slots by one task that holds one block of each source and hands on a row for each slot;
documents are numbered, cut and joined with their slots in parallel.  ``block`` sets how many
slots there are: with 64 documents of 2 kB a slot stands for 128 kB of text.
"""

from __future__ import annotations

import heapq
import sys
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import running_totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64
#: Slots that are handed on at once.
BATCH = 1 << 14


class Targets:
    """Fluid targets of sources with ``blocks`` blocks and ``weights``, in exact arithmetic."""

    def __init__(self, blocks: list[int], weights: list[float]):
        exact = [Fraction(w) for w in weights]
        unit = lcm(*(w.denominator for w in exact)) if exact else 1
        self.blocks, self.weights = blocks, [int(w * unit) for w in exact]
        # sources leave in the order of blocks / weight
        order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], self.weights[s]))
        self.order = order
        self.leave = [blocks[s] / self.weights[s] for s in order]
        self.gone, self.active = [0], [sum(self.weights)]
        for s in order:
            self.gone.append(self.gone[-1] + blocks[s])
            self.active.append(self.active[-1] - self.weights[s])

    def at(self, source: int, i: int) -> tuple[int, int, int]:
        """Where the target of the source reaches ``i``: numerator, denominator and the sum of the
        weights that share the slots from there."""
        w = self.weights[source]
        k = bisect_right(self.leave, i / w)
        while k and self._leaves_after(k - 1, i, w):
            k -= 1
        while k < len(self.order) and not self._leaves_after(k, i, w):
            k += 1
        return self.gone[k] * w + i * self.active[k], w, self.active[k]

    def _leaves_after(self, k: int, i: int, w: int) -> bool:
        s = self.order[k]
        return self.blocks[s] * w > i * self.weights[s]


def deal(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int, int, float]]:
    """``(slot, source, block, release, deadline, weight)`` of every slot, earliest deadline first;
    ``weight`` is the share that the source has when the block is released."""
    targets = Targets(blocks, weights)

    def job(s: int, i: int) -> tuple[int, int, int, int, float]:
        top, bottom, active = targets.at(s, i)
        end, _, _ = targets.at(s, i + 1)
        return top // bottom, s, i, -(-end // bottom), bottom / active

    coming = [job(s, 0) for s, n in enumerate(blocks) if n]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int, int, float]] = []
    for slot in range(sum(blocks)):
        while coming and coming[0][0] <= slot:
            release, s, i, deadline, weight = coming[0]
            heapq.heappush(ready, (deadline, s, i, release, weight))
            if i + 1 < blocks[s]:
                heapq.heapreplace(coming, job(s, i + 1))
            else:
                heapq.heappop(coming)
        deadline, s, i, release, weight = heapq.heappop(ready)
        yield slot, s, i, release, deadline, weight


def schedule(sources: DataFrame) -> DataFrame:
    """``(first, block, slot, release, deadline, weight)`` of all blocks of ``sources(first, blocks,
    target)``; ``first`` names and orders the sources."""
    names = ["first", "block", "slot", "release", "deadline", "weight"]

    def run(batches):
        rows = sorted(
            row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
        )
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            kinds = [pa.int64()] * 5 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for slot, s, i, release, deadline, weight in deal([r[1] for r in rows], [r[2] for r in rows]):
            held.append((rows[s][0], i, slot, release, deadline, weight))
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()

    shape = "first long, block long, slot long, release long, deadline long, weight double"
    # one row a source, one row a slot: no document passes here
    return sources.select("first", "blocks", "target").repartition(1).mapInArrow(run, shape)


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, seed: int = 17
) -> DataFrame:
    """One row ``(doc_id, source, block, place, slot, release, deadline, weight)`` for each row
    of ``docs``; ``(slot, place)`` is its position in the mix.

    ``weights`` gives a positive target weight for each source, by default the square root of
    its document count; a source without an entry gets the smallest weight given.  A null
    source is a source of its own; there may be any number of them.  Blocks have ``block``
    documents, the last one of a source the rest.  Every row is dealt exactly once: a source that
    runs out leaves, the others keep their proportions.  ``weight`` is the exact share of the source
    among those left when its block is released.  Inside a source, rows follow a seeded hash of
    doc_id; rows with null or repeated ids are told apart by the order they are read in.  Texts are
    not read, so their length does not matter; equal deadlines go by the name of the source, and a
    table without rows gives none.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).withColumn(
        "uid", F.monotonically_increasing_id()
    ).withColumn("h", F.xxhash64(F.coalesce("doc_id", "uid"), F.lit(seed)))
    # numbered over (source, hash) ranges: a source of any size is spread over many tasks
    numbered = running_totals(rows, ["source", "h", "uid"], rn=F.lit(1).cast("long"))
    counted = cut_lineage(numbered.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first")))
    if weights:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "_source string, target double")
        known = counted.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        sources = known.withColumn("target", F.coalesce("target", F.lit(float(min(weights.values())))))
    else:
        sources = counted.withColumn("target", F.sqrt("n"))
    dealt = cut_lineage(schedule(sources.withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))))
    own = counted.select(F.col("source").alias("_source"), "first")
    at = F.col("rn") - F.col("first")
    return (
        numbered.join(own, F.col("source").eqNullSafe(F.col("_source")))
        .withColumns({"block": F.floor(at / block), "place": (at % block).cast("int")})
        .join(dealt, ["first", "block"])
        .select("doc_id", "source", "block", "place", "slot", "release", "deadline", "weight")
    )
