"""From concept candidates to edges, and from edges to their neighbourhood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxograft.functions.ids import is_complex
from taxograft.model import Sentinels
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import top_k
from taxograft.plans.skew import balanced_join

NAMES = Sentinels()
EDGE = ["parent_idx", "child_idx"]


def enrich_concepts(seeds: DataFrame, isa: DataFrame, pool_size: int, names: Sentinels = NAMES) -> DataFrame:
    """Concept pool ``(mention_id, pos, id)``: the seeds, then their neighbours, then null.

    ``seeds(mention_id, rank, id)``.  Seed by seed the children and then the parents are
    added until the pool is full; the null node always closes the pool.  A complex seed stays
    in the pool but has no neighbours.
    """
    children = isa.select(F.col("parent_id").alias("id"), F.lit(0).alias("side"), F.col("child_id").alias("next")).distinct()
    parents = isa.select(F.col("child_id").alias("id"), F.lit(1).alias("side"), F.col("parent_id").alias("next")).distinct()
    # a pool already holds fewer than pool_size ids, so of the first 2 * pool_size
    # neighbours of a node enough are new: the rest can never be added
    around = cut_lineage(
        top_k(children.unionByName(parents), ["id", "side"], [F.asc("next")], 2 * pool_size, "_n").drop("_n")
    )
    start = seeds.select("mention_id", "rank", F.lit(-1).alias("side"), "id")
    simple = seeds.where(~is_complex("id")).select("mention_id", "rank", "id")
    added = balanced_join(simple, around, "id").select(
        "mention_id", "rank", "side", F.col("next").alias("id")
    )
    first = F.struct(F.when(F.col("side") >= 0, 1).otherwise(0).alias("late"), "rank", "side")
    pool = start.unionByName(added).groupBy("mention_id", "id").agg(F.min(first).alias("o"))
    picked = top_k(
        pool, "mention_id", [F.asc("o.late"), F.asc("o.rank"), F.asc("o.side"), F.asc("id")], pool_size, "pos"
    ).select("mention_id", "pos", "id")
    null = picked.groupBy("mention_id").agg((F.max("pos") + 1).alias("pos")).select(
        "mention_id", "pos", F.lit(names.null).alias("id")
    )
    return picked.unionByName(null)


#: Edges that one task holds, and edges of one packed row.
TASK_EDGES = 1 << 21
PACK_EDGES = 1 << 12
#: Edges of mentions that a worker puts together at a time.
CHUNK_EDGES = 1 << 20
#: Compressed bytes of a member and of an edge on their way to a task, about.
MEMBER_BYTES, EDGE_BYTES = 10, 5


def _dealt(edges: int, members: int, tasks: int) -> tuple[int, int]:
    """Slots of children and blocks of mentions: a task gets a slot for a block.

    A slot holds ``TASK_EDGES`` edges of the graph.  Members are sent to all slots and edges to all blocks, so
    for more tasks the number is raised that repeats fewer bytes.
    """
    slots, blocks = max(1, -(-edges // TASK_EDGES)), 1
    while slots * blocks < tasks:
        if members * slots * MEMBER_BYTES <= edges * blocks * EDGE_BYTES:
            slots *= 2
        else:
            blocks *= 2
    return slots, blocks


def _slot(child: str, slots: int):
    return F.pmod(F.xxhash64(child), F.lit(slots))


def _part(col: str, parts):
    """Parts of a large list, by hash."""
    return F.pmod(F.xxhash64(col, F.lit(1)), F.greatest(parts, F.lit(1)))


def _listed(col: str):
    """Distinct values as a sorted list; a null, which collect_set leaves out, comes last."""
    values = F.sort_array(F.collect_set(col))
    return F.when(F.max(F.col(col).isNull()), F.array_append(values, F.lit(None))).otherwise(values)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size`` of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _worker(asked: bool, chunk: int):
    """Distinct children of each mention and parent.

    Rows come by ``_task``, packed edges first, then by mention.  The packed edges of a task are held as numbers;
    mentions are put together a few at a time, so their edges are neither shuffled nor held.
    """

    def codes(values: pa.Array, known: pa.Array | None = None) -> tuple[np.ndarray, pa.Array]:
        if known is not None:
            values = pa.concat_arrays([known, values])
        found = values.dictionary_encode(null_encoding="encode")
        return found.indices.to_numpy(zero_copy_only=False)[0 if known is None else len(known):].astype(np.int64), found.dictionary

    def lists(col: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        col = col.combine_chunks()
        return col.flatten(), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def units(rows: pa.Table, parents: pa.Array | None, children: pa.Array | None):
        """A row for each parent of a packed row: parent, first child, number of children, packed row."""
        p, wide = lists(rows["parents"])
        c, size = lists(rows["children"])
        p, parents = codes(p, parents)
        c, children = codes(c, children)
        row = np.repeat(np.arange(len(rows)), wide)
        return p, (np.cumsum(size) - size)[row], size[row], row, c, parents, children

    def distinct(group: np.ndarray, start: np.ndarray, size: np.ndarray, child: np.ndarray, base: int) -> np.ndarray:
        pair = np.repeat(group, size) * base + child[_spans(start, size)]
        if len(group) > 1 and (group[1:] == group[:-1]).any():
            pair.sort()
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        return pair

    def put_together(graph, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, first, last, parent, start, size, child, parents, children = graph
        kind = rows["_kind"].to_numpy()
        mention, mentions = codes(rows["mention_id"].combine_chunks())
        k = pc.fill_null(rows["_k"], -1).to_numpy()
        at = np.searchsorted(key, k)
        met = (kind == 1) & (at < len(key))
        met[met] = key[at[met]] == k[met]
        many = np.where(met, (last - first)[np.where(met, at, 0)] if len(key) else 0, 0)
        unit = _spans(first[at[met]], many[met]) if met.any() else np.zeros(0, np.int64)
        own = np.flatnonzero(kind > 1)
        p, s, n, row, c, parents, children = units(rows.take(pa.array(own)), parents, children)
        who = np.concatenate([np.repeat(mention, many), mention[own][row]])
        what = np.concatenate([np.ones(len(unit), np.int64), kind[own][row]])
        parent = np.concatenate([parent[unit], p])
        start = np.concatenate([start[unit], s + len(child)])
        size = np.concatenate([size[unit], n])
        child = np.concatenate([child, c])
        order = np.lexsort((parent, who))
        who, what, parent, start, size = (x[order] for x in (who, what, parent, start, size))
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (parent[1:] != parent[:-1])]) if len(who) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        ends = np.append(heads[1:], len(who))
        total = np.concatenate([[0], np.cumsum(size)])
        base, g = len(children) + 1, 0
        while g < len(heads):
            h = max(g + 1, int(np.searchsorted(total[ends], total[heads[g]] + chunk, "right")))
            a, b = heads[g], ends[h - 1]
            cols = [mentions.take(pa.array(who[heads[g:h]])), parents.take(pa.array(parent[heads[g:h]]))]
            for wanted in (what[a:b] < 3, what[a:b] == 3)[: 1 + asked]:
                pair = distinct(group[a:b][wanted] - g, start[a:b][wanted], size[a:b][wanted], child, base)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(pair // base, minlength=h - g))]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), children.take(pa.array(pair % base))))
            yield pa.RecordBatch.from_arrays(cols, names=["mention_id", "parent_idx", "children", "asked"][: len(cols)])
            g = h

    def graph_of(rows: list[pa.Table], like: pa.Table):
        rows = pa.concat_tables(rows) if rows else like.slice(0, 0)
        k = rows["_k"].to_numpy()
        parent, start, size, row, child, parents, children = units(rows, None, None)
        order = np.argsort(k[row], kind="stable")
        key, first = np.unique(k[row][order], return_index=True)
        return key, first, np.append(first[1:], len(order)).astype(np.int64)[: len(first)], parent[order], start[order], size[order], child, parents, children

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packed, graph, waiting = None, [], None, []

        def flush(keep_last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal graph, packed, waiting
            if not waiting:
                return
            rows = pa.concat_tables(waiting)
            if graph is None:
                graph, packed = graph_of(packed, rows), []
            cut = len(rows)
            if keep_last:  # the last mention may go on
                who = codes(rows["mention_id"].combine_chunks())[0]
                cut = int(np.flatnonzero(who != who[-1])[-1]) + 1 if (who != who[-1]).any() else 0
            waiting = [rows.slice(cut)] if cut < len(rows) else []
            if cut:
                yield from put_together(graph, rows.slice(0, cut))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            number = rows["_task"].to_numpy()
            for at in np.split(np.arange(len(number)), np.flatnonzero(number[1:] != number[:-1]) + 1) if len(number) else []:
                if number[at[0]] != task:
                    yield from flush(False)
                    task, packed, graph, waiting = number[at[0]], [], None, []
                some = rows.slice(at[0], len(at))
                held = int((some["_kind"].to_numpy() == 0).sum())
                if held:
                    packed.append(some.slice(0, held))
                if held < len(some):
                    waiting.append(some.slice(held))
                    if sum(map(len, waiting)) >= 8_192:
                        yield from flush(True)
        yield from flush(False)

    return run


def _told_apart(members: DataFrame, packs: DataFrame, slots: int, blocks: int, own: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Rows ``(mention_id, parent_idx, children)``: the distinct edges that the members of a mention bring.

    ``members(mention_id, _k)`` and ``packs(_k, _slot, parents, children)``, every parent with every child, and edges
    ``own`` that a mention has anyway.  The children are dealt to slots, and a parent has a row a slot.  The members and
    not their edges are sent to the tasks: each holds the packed edges of its slot and puts the mentions of its block
    together there.  With ``asked(mention_id, parent_idx, child_idx)``, ``asked`` lists those children of a parent.
    """
    single = [F.array("parent_idx").alias("parents"), F.array("child_idx").alias("children")]
    more = []
    for kind, rows in ((2, own), (3, asked)):
        if rows is not None:
            if kind == 3:
                rows = rows.where(F.col("parent_idx").isNotNull() & F.col("child_idx").isNotNull())
            more.append(rows.select("mention_id", F.lit(None).cast("long").alias("_k"), _slot("child_idx", slots).alias("_slot"), *single, F.lit(kind).alias("_kind")))
    if slots * blocks == 1:
        rows = members.join(packs, "_k").select("mention_id", "parents", "children", F.lit(1).alias("_kind"))
        for x in more:
            rows = rows.unionByName(x.drop("_k", "_slot"))
        at = F.col("_kind") == 3
        none = F.array().cast(packs.schema["children"].dataType)
        wide = rows.repartition("mention_id").select("mention_id", F.explode("parents").alias("parent_idx"), "children", at.alias("_asked"))
        told = [F.array_distinct(F.flatten(F.collect_list(F.when(x, F.col("children")).otherwise(none)))).alias(c) for c, x in (
            ("children", ~F.col("_asked")), ("asked", F.col("_asked")))]
        # the rows of a mention are in one task already: nothing is shuffled again
        return wide.groupBy("mention_id", "parent_idx").agg(*told[: 1 if asked is None else 2])
    block = F.pmod(F.xxhash64("mention_id"), F.lit(blocks))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none = F.lit(None).cast("array<string>")
    sent = members.withColumns({"_slot": each(slots), "parents": none, "children": none, "_kind": F.lit(1)})
    for x in more:
        sent = sent.unionByName(x)
    task = (F.col("_slot") * blocks + F.col("_block")).cast("int").alias("_task")
    cols = ["mention_id", "_k", "parents", "children", "_kind"]
    rows = sent.withColumn("_block", block).select(task, *cols).unionByName(
        packs.withColumns({"_block": each(blocks), "_kind": F.lit(0), "mention_id": F.lit(None).cast(members.schema["mention_id"].dataType)}).select(task, *cols))
    schema = T.StructType([
        T.StructField("mention_id", members.schema["mention_id"].dataType), T.StructField("parent_idx", T.StringType()),
        *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("children", "asked")[: 1 if asked is None else 2])])
    ordered = rows.repartition(slots * blocks, "_task").sortWithinPartitions("_task", F.col("_kind") > 0, "mention_id")
    return ordered.mapInArrow(_worker(asked is not None, CHUNK_EDGES), schema)


def _deal(sizes: DataFrame, members: DataFrame) -> tuple[int, int]:
    """Slots and blocks for the ``members(_k)`` and ``sizes(_k, _n)``, the number of edges of a key."""
    n = F.coalesce(F.sum("_n"), F.lit(0))
    edges = sizes.agg(n).first()[0]
    load = members.join(sizes, "_k").agg(n, F.count(F.lit(1))).first()
    if load[0] + load[1] <= TASK_EDGES:
        return 1, 1
    tasks = 3 * members.sparkSession.sparkContext.defaultParallelism
    return _dealt(edges, load[1], max(tasks, -(-(edges + load[1]) // TASK_EDGES)))


def _unpacked(packed: DataFrame) -> DataFrame:
    return packed.select("mention_id", "parent_idx", F.explode("children").alias("child_idx"))


def _formed(seeds: DataFrame, isa: DataFrame, names: Sentinels) -> DataFrame:
    s = cut_lineage(seeds.where(~is_complex("id")).select("mention_id", "id").distinct())
    n = F.count(F.lit(1))
    ids = s.select("id").where("id IS NOT NULL").distinct()
    for name, side in (("_down", "parent_id"), ("_up", "child_id")):
        ids = ids.join(isa.groupBy(F.col(side).alias("id")).agg(n.alias(name)), "id", "left").fillna(0, [name])
    ids = cut_lineage(ids.withColumn("_k", F.monotonically_increasing_id()))
    wide = F.ceil((F.col("_up") + 1) / PACK_EDGES)
    members = s.join(ids, "id").select("mention_id", "_k")
    slots, blocks = _deal(ids.select("_k", (F.col("_down") * wide + F.col("_up") + 1).alias("_n")), members)
    up = isa.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent"), F.lit(True).alias("_known")).distinct().join(ids, "id")
    up = up.select("_k", "id", _part("parent", wide).alias("_wide"), "parent", "_known").unionByName(
        ids.select("_k", "id", F.lit(0).cast("long").alias("_wide"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("_known")))
    # the first list of every concept also stands where the concept has no parent
    known = F.sort_array(F.collect_list("parent"))
    nothing = F.max(F.col("parent").isNull() & F.col("_known"))
    up = cut_lineage(up.groupBy("_k", "id", "_wide").agg(
        F.when(nothing, F.array_append(known, F.lit(None))).otherwise(known).alias("parents")))
    down = isa.select(F.col("parent_id").alias("id"), F.col("child_id").alias("child")).distinct().join(ids, "id")
    down = down.groupBy("_k", _slot("child", slots).alias("_slot"), _part("child", F.ceil(F.col("_down") / (slots * PACK_EDGES))).alias("_block")).agg(
        _listed("child").alias("children"))
    itself = F.array("id")
    above = F.when(F.col("_wide") == 0, F.concat("parents", itself)).otherwise(F.col("parents")).alias("parents")
    packs = (
        down.join(up, "_k").select("_k", "_slot", above, "children")
        .unionByName(up.where(F.size("parents") > 0).select("_k", _slot("id", slots).alias("_slot"), "parents", itself.alias("children")))
        .unionByName(ids.select("_k", _slot(F.lit(names.null), slots).alias("_slot"), itself.alias("parents"), F.array(F.lit(names.null)).alias("children")))
    )
    return _told_apart(members, packs, slots, blocks)


def form_edges(seeds: DataFrame, isa: DataFrame, names: Sentinels = NAMES) -> DataFrame:
    """Edges ``(mention_id, parent_idx, child_idx)`` around each seed concept C.

    ``<C, null>``, ``<C+, C>``, ``<C, C->`` and ``<C+, C->`` for its parents C+ and
    children C-; complex seeds form none.  What a concept contributes does not depend on the mention, so its
    parents and children are listed once, and a mention's edges are put together where the lists are.
    """
    return _unpacked(_formed(seeds, isa, names))


def _leaf_of(distinct_edges: DataFrame, edges: DataFrame, names: Sentinels) -> DataFrame:
    """``(parent_idx, child_idx, new_parent, new_child)`` leaf edges of the same parent."""
    leaf = edges.where(F.col("child_idx") == names.null).select("parent_idx").distinct()
    return distinct_edges.where(F.col("child_idx") != names.null).join(leaf, "parent_idx", "left_semi").select(
        *EDGE, F.col("parent_idx").alias("new_parent"), F.lit(names.null).alias("new_child")
    )


def enrich_leaf(cands: DataFrame, edges: DataFrame, names: Sentinels = NAMES) -> DataFrame:
    """Add ``<p, null>`` for each candidate ``<p, c>``, where the catalogue has it."""
    own = cut_lineage(cands.select("mention_id", *EDGE).distinct())
    new = balanced_join(own, _leaf_of(own.select(*EDGE).distinct(), edges, names), EDGE, fanout=False).select(
        "mention_id", F.col("new_parent").alias("parent_idx"), F.col("new_child").alias("child_idx")
    )
    return own.unionByName(new).distinct()


def _packed_hops(cands: DataFrame, edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    own = cut_lineage(cands.select("mention_id", *EDGE).distinct())
    known = edges.select(*EDGE)
    some = own.select(*EDGE).where("parent_idx IS NOT NULL AND child_idx IS NOT NULL").distinct()
    some = cut_lineage(some.withColumn("_k", F.monotonically_increasing_id()))
    # only links that touch an edge of a mention are written
    up = cut_lineage(known.select(F.col("child_idx").alias("parent_idx"), F.col("parent_idx").alias("new_parent")).join(
        some.select("parent_idx").distinct(), "parent_idx", "left_semi").distinct())
    down = cut_lineage(known.select(F.col("parent_idx").alias("child_idx"), F.col("child_idx").alias("new_child")).join(
        some.select("child_idx").distinct(), "child_idx", "left_semi").distinct())
    n = F.count(F.lit(1))
    sized = some.join(up.groupBy("parent_idx").agg(n.alias("_up")), "parent_idx", "left").join(
        down.groupBy("child_idx").agg(n.alias("_down")), "child_idx", "left").fillna(0, ["_up", "_down"])
    sized = cut_lineage(sized.where("_up + _down > 0"))
    members = own.join(sized.select(*EDGE, "_k"), EDGE).select("mention_id", "_k")
    slots, blocks = _deal(sized.select("_k", ((F.col("_up") + 1) * (F.col("_down") + 1)).alias("_n")), members)
    edge = ["_k", "_down", *EDGE]
    raised = balanced_join(sized.select(*edge), up, "parent_idx").select(*edge, "new_parent")
    raised = cut_lineage(raised.unionByName(sized.select(*edge, F.col("parent_idx").alias("new_parent"))))
    reached = raised.where(~F.col("new_parent").eqNullSafe(F.col("parent_idx"))).select(
        "_k", "_down", "new_parent", F.col("child_idx").alias("new_child")
    ).unionByName(balanced_join(raised, down, "child_idx").select("_k", "_down", "new_parent", "new_child"))
    found = reached.join(known.toDF("new_parent", "new_child"), ["new_parent", "new_child"], "left_semi")
    lists = found.groupBy("_k", _slot("new_child", slots).alias("_slot"), _part("new_child", F.ceil(F.col("_down") / (slots * PACK_EDGES))).alias("_block"), "new_parent").agg(
        _listed("new_child").alias("children"))
    packs = lists.groupBy("_k", "_slot", "children").agg(F.collect_list("new_parent").alias("parents"))
    return _told_apart(members, packs, slots, blocks, own, asked)


def enrich_hops(cands: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``<p+, c>``, ``<p, c->`` and ``<p+, c->`` where the catalogue has them.

    Neighbours are those of the whole catalogue.  The hops of an edge are found once, not
    once per mention that has the edge as a candidate.
    """
    return _unpacked(_packed_hops(cands, edges))


def enrich_edges(cands: DataFrame, edges: DataFrame, names: Sentinels = NAMES) -> DataFrame:
    """Leaf and then hop enrichment."""
    return enrich_hops(enrich_leaf(cands, edges, names), edges)


def edge_ids(ranked: DataFrame, edges: DataFrame, missing: int = -1) -> DataFrame:
    """Catalogue id of each predicted edge, ``missing`` where there is none."""
    known = edges.select(*EDGE, "edge_id")
    return balanced_join(ranked, known, EDGE, "left", fanout=False).withColumn(
        "edge_id", F.coalesce("edge_id", F.lit(missing))
    )


def leaf_score(cands: DataFrame, value: float, on: bool = False, names: Sentinels = NAMES) -> DataFrame:
    """Give every ``<p, null>`` edge a constant score."""
    if not on:
        return cands
    return cands.withColumn(
        "score", F.when(F.col("child_idx") == names.null, F.lit(float(value))).otherwise(F.col("score"))
    )


def assume_leaf(
    cands: DataFrame, seeds: DataFrame, isa: DataFrame, value: float, names: Sentinels = NAMES, twice: bool = True
) -> DataFrame:
    """Leaf edges score ``+value`` when the mention's top seed has no child, else ``-value``.

    The flags meet the leaf edges only, so the other edges are not shuffled; ``cands`` is read ``twice`` for
    that, unless it is not.
    """
    inner = isa.select(F.col("parent_id").alias("id")).distinct().withColumn("_inner", F.lit(True))
    top = cut_lineage(seeds.where(F.col("rank") == 1).select("mention_id", "id").join(inner, "id", "left").select(
        "mention_id", F.col("_inner").isNull().alias("_leaf")
    ))
    leaf = F.coalesce(F.col("child_idx") == names.null, F.lit(False))
    # several top seeds would repeat the other edges as well
    several = top.where("mention_id IS NOT NULL").groupBy("mention_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    split = twice and several.isEmpty()
    flagged = balanced_join(cands.where(leaf) if split else cands, top, "mention_id", "left", fanout=False)
    constant = F.when(F.col("_leaf"), F.lit(float(value))).otherwise(F.lit(-float(value)))
    scored = flagged.withColumn("score", F.when(leaf, constant).otherwise(F.col("score"))).drop("_leaf")
    return scored.unionByName(cands.where(~leaf)) if split else scored


def rank_edges(cands: DataFrame, cap: int) -> DataFrame:
    """A mention's distinct edges by their best score, cut to ``cap``."""
    best = cands.groupBy("mention_id", *EDGE).agg(F.max("score").alias("score"))
    return top_k(best, "mention_id", [F.desc_nulls_last("score"), F.asc("parent_idx"), F.asc("child_idx")], cap)


def seed_enrich_fill(
    cands: DataFrame,
    edges: DataFrame,
    seed: int,
    k: int,
    rerank: bool = True,
    scores: DataFrame | None = None,
    names: Sentinels = NAMES,
    whole: bool = False,
) -> DataFrame:
    """Cut to seeds, enrich them, fill up with the other candidates, rank again.

    ``cands(mention_id, rank, parent_idx, child_idx, score)``.  ``scores`` supplies the
    score of edges that enrichment adds; it defaults to the candidates' own.  Candidates
    beyond the seeds are only used up to a total of ``k``.  ``scores`` are shuffled ``whole`` only for mentions
    whose best ones are not all among the enriched edges.
    """
    key = ["mention_id", *EDGE]
    edge_order = [F.asc("parent_idx"), F.asc("child_idx")]
    cands = cut_lineage(cands)
    seeds = cands.where(F.col("rank") <= seed)
    asked, best, given = cands, None, scores
    if scores is None:
        scores = cands
    elif rerank and not whole:
        # a mention's k best scored edges are enough where enrichment has them all
        best = cut_lineage(top_k(scores.select(*key, "score"), "mention_id", [F.desc_nulls_last("score"), *edge_order], k, "_at"))
        asked, scores = cands.select(*key).unionByName(best.select(*key)), best
    if given is None or best is not None:
        # edges that are not asked for have neither rank nor score: k of a parent are enough, by child
        rich = cut_lineage(_packed_hops(enrich_leaf(seeds, edges, names), edges, asked).select(
            "mention_id", "parent_idx", F.size("children").alias("_n"), F.array_intersect("children", "asked").alias("met"),
            F.slice(F.sort_array(F.array_except("children", "asked")), 1, k).alias("rest"),
        ))
        n = rich.groupBy("mention_id").agg(F.sum("_n").alias("_n"))
        new = rich.select("mention_id", "parent_idx", F.explode("rest").alias("child_idx"))
        rich = rich.select("mention_id", "parent_idx", F.explode("met").alias("child_idx"))
    else:
        rich = cut_lineage(enrich_edges(seeds, edges, names))
        n = rich.groupBy("mention_id").agg(F.count(F.lit(1)).alias("_n"))
        new = None
    open_ = None
    if best is not None:
        # where it has not, and there may be further scores, the mention is ranked with all of them
        full = rich.join(best.where("score IS NOT NULL"), key).groupBy("mention_id").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= k)
        open_ = cut_lineage(best.where(F.col("_at") == k).select("mention_id").where("mention_id IS NOT NULL").join(full, "mention_id", "left_anti"))
    kept = rich.join(cands.select(*key, "rank"), key, "left").join(scores.select(*key, "score"), key, "left")
    if new is not None:
        kept = kept.unionByName(new, allowMissingColumns=True)
    others = top_k(
        cands.where(F.col("rank") > seed).select(*key, "rank", "score").join(rich, key, "left_anti"),
        "mention_id", [F.asc("rank")], k, "_pos",
    )
    fill = others.join(n, "mention_id").where(F.col("_pos") + F.col("_n") <= k).drop("_pos", "_n")
    late = F.when(F.col("rank") <= seed, 0).otherwise(1)
    both = kept.select(*key, "rank", "score", late.alias("_late")).unionByName(
        fill.select(*key, "rank", "score", F.lit(2).alias("_late"))
    )
    if rerank:
        order = [F.desc_nulls_last("score"), *edge_order]
    else:
        order = [F.asc("_late"), F.asc_nulls_last("rank"), *edge_order]
    out = top_k(both.withColumnRenamed("rank", "seed_rank"), "mention_id", order, k).select(*key, "rank", "score")
    if open_ is None or open_.isEmpty():
        return out
    some = [df.join(open_, "mention_id", "left_semi") for df in (cands, given)]
    return out.join(open_, "mention_id", "left_anti").unionByName(seed_enrich_fill(some[0], edges, seed, k, rerank, some[1], names, whole=True))


def union_with_quota(primary: DataFrame, secondary: DataFrame, quota: int, share: float = 0.5) -> DataFrame:
    """Candidates ``(mention_id, pos, id)`` from two lists ``(mention_id, rank, id)``.

    The first list fills ``floor(quota * share)`` places; new ids of the second one follow
    in order until ``quota`` is reached.
    """
    first = int(quota * share)
    a = primary.where(F.col("rank") <= first).select("mention_id", "id", F.struct(F.lit(0).alias("s"), "rank").alias("o"))
    b = secondary.select("mention_id", "id", F.struct(F.lit(1).alias("s"), "rank").alias("o"))
    once = a.unionByName(b).groupBy("mention_id", "id").agg(F.min("o").alias("o"))
    return top_k(once, "mention_id", [F.asc("o.s"), F.asc("o.rank")], quota, "pos").select("mention_id", "pos", "id")


def expand_to_pairs(ranked: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Ranked edges of a mention key for every mention-edge pair row of that key."""
    return balanced_join(pairs, ranked, key)


def filter_degree(cands: DataFrame, exclude: int = 0) -> DataFrame:
    return cands.where(F.col("degree") != exclude)


def gold_in_candidates(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates of the mentions at least one of whose gold edges is among them."""
    hit = cands.join(gold.select("mention_id", *EDGE), ["mention_id", *EDGE], "left_semi").select("mention_id").distinct()
    return cands.join(hit, "mention_id", "left_semi")


def pair_edges(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted and gold edges of the same mention side by side."""
    p = ranked.select("mention_id", F.col("parent_idx").alias("pred_parent"), F.col("child_idx").alias("pred_child"))
    g = gold.select("mention_id", F.col("parent_idx").alias("gold_parent"), F.col("child_idx").alias("gold_child"))
    return balanced_join(p, g, "mention_id")
