"""The subsumption graph: neighbours, contraction, depths, ancestors, similarity.

A graph is a DataFrame ``isa(child_id, parent_id)``.  Nothing here builds a list of
the neighbours of a node, whose number is unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.functions.ids import complex_parts, inner_ids
from taxograft.model import Sentinels
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import number_rows
from taxograft.plans.skew import balanced_join

NAMES = Sentinels()


def neighbours(isa: DataFrame, side: str = "parents") -> DataFrame:
    """Direct neighbours in long form ``(id, neighbour)``."""
    if side == "parents":
        return isa.select(F.col("child_id").alias("id"), F.col("parent_id").alias("neighbour")).distinct()
    if side == "children":
        return isa.select(F.col("parent_id").alias("id"), F.col("child_id").alias("neighbour")).distinct()
    raise ValueError(side)


def contract(
    isa: DataFrame, retained: DataFrame, side: str = "parents", max_rounds: int = 1_000
) -> DataFrame:
    """Neighbours of every node among the ``retained(id)`` nodes.

    A neighbour that is not retained is replaced by its own neighbours on the same side,
    again and again, until only retained ones are left.
    """
    keep = retained.select(F.col("id").alias("neighbour"), F.lit(True).alias("_kept")).distinct()
    flagged = cut_lineage(neighbours(isa, side).join(keep, "neighbour", "left"))
    done = flagged.where("_kept").select("id", "neighbour")
    open_ = flagged.where("_kept IS NULL").select("id", F.col("neighbour").alias("via")).distinct()
    step = flagged.withColumnRenamed("id", "via")
    seen = open_
    parts = [done]
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        # distinct (id, via) pairs are expanded once each, so cycles end as well
        wide = cut_lineage(balanced_join(open_, step, "via").select("id", "neighbour", "_kept").distinct())
        parts.append(wide.where("_kept").select("id", "neighbour"))
        open_ = (
            wide.where("_kept IS NULL").select("id", F.col("neighbour").alias("via"))
            .join(seen, ["id", "via"], "left_anti")
        )
        open_ = cut_lineage(open_)
        seen = cut_lineage(seen.unionByName(open_))
    else:
        raise RuntimeError("contraction did not end")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def contract_pruned(isa: DataFrame, kept: DataFrame) -> DataFrame:
    """Subsumption links among the kept concepts after the others were pruned."""
    links = contract(isa, kept, "parents").select(
        F.col("id").alias("child_id"), F.col("neighbour").alias("parent_id")
    )
    return links.join(kept.select(F.col("id").alias("child_id")).distinct(), "child_id", "left_semi")


def roots(isa: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    parents = isa.select(F.col("parent_id").alias("id")).distinct()
    return parents.join(isa.select(F.col("child_id").alias("id")), "id", "left_anti")


def leaves(isa: DataFrame) -> DataFrame:
    """Nodes without a child."""
    children = isa.select(F.col("child_id").alias("id")).distinct()
    return children.join(isa.select(F.col("parent_id").alias("id")), "id", "left_anti")


def nodes(isa: DataFrame) -> DataFrame:
    return (
        isa.select(F.col("child_id").alias("id"))
        .unionByName(isa.select(F.col("parent_id").alias("id")))
        .distinct()
    )


def paths_through(
    isa: DataFrame, concepts: DataFrame | None = None, names: Sentinels = NAMES
) -> DataFrame:
    """Parent-child paths ``(id, parent, child)`` that pass through each concept.

    A missing side becomes the top or the null node; a concept with no neighbour at all
    has no path (the edge catalogue treats that case differently).
    """
    up = isa.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent")).distinct()
    down = isa.select(F.col("parent_id").alias("id"), F.col("child_id").alias("child")).distinct()
    if concepts is not None:
        only = concepts.select("id").distinct()
        up = up.join(only, "id", "left_semi")
        down = down.join(only, "id", "left_semi")
    both = balanced_join(down, up, "id").select("id", "parent", "child")
    tops = down.join(up, "id", "left_anti").select("id", F.lit(names.top).alias("parent"), "child")
    nulls = up.join(down, "id", "left_anti").select("id", "parent", F.lit(names.null).alias("child"))
    return both.unionByName(tops).unionByName(nulls)


def complex_paths(
    atomic: DataFrame, complex_: DataFrame, names: Sentinels = NAMES
) -> DataFrame:
    """Paths with a complex concept on at least one side.

    Both inputs hold ``(id, side, neighbour)`` with side ``parents`` or ``children``.
    The missing atomic side opposite a complex neighbour becomes the top or null node.
    """

    def pick(df: DataFrame, side: str, name: str) -> DataFrame:
        return df.where(F.col("side") == side).select("id", F.col("neighbour").alias(name)).distinct()

    ap, ac = pick(atomic, "parents", "parent"), pick(atomic, "children", "child")
    cp, cc = cut_lineage(pick(complex_, "parents", "parent")), cut_lineage(pick(complex_, "children", "child"))
    # neighbours are told apart before they are joined, so the paths, whose number is the product, need not be:
    # a complex parent meets all children, any other parent the complex children
    top, null = F.lit(names.top), F.lit(names.null)
    upper = cc.select("id").distinct().join(ap, "id", "left").select("id", F.coalesce("parent", top).alias("parent")).distinct()
    lower = ac.join(cp, "id", "left_semi").unionByName(cp.join(ac, "id", "left_anti").select("id", null.alias("child")))
    lower = cut_lineage(lower.unionByName(cc).distinct())
    return (
        balanced_join(lower, cp, "id").select("id", "parent", "child")
        .unionByName(balanced_join(cc, cut_lineage(upper.join(cp, ["id", "parent"], "left_anti")), "id").select("id", "parent", "child"))
        # what belongs to no id meets nothing
        .unionByName(
            cc.where("id IS NULL").select("id", top.alias("parent"), "child")
            .unionByName(cp.where("id IS NULL").select("id", "parent", null.alias("child"))).distinct()
        )
    )


def known_complex(neighbours_: DataFrame, universe: DataFrame) -> DataFrame:
    """Complex neighbours ``(id, neighbour)`` all of whose inner ids the universe has."""
    inner = neighbours_.select("neighbour").distinct().select(
        "neighbour", F.explode(inner_ids("neighbour")).alias("id")
    )
    # distinct inner ids are looked up, so one that most concepts share is one row; the tables written
    # before the next join let a hot id be split there
    missing = cut_lineage(inner.select("id").distinct().join(universe.select("id"), "id", "left_anti"))
    broken = inner.join(missing, "id", "left_semi").select("neighbour").distinct()
    return neighbours_.join(broken, "neighbour", "left_anti")


def neighbour_titles(neighbours_: DataFrame, concepts: DataFrame) -> DataFrame:
    """Titles of neighbours, taken from the given (older) version's concepts."""
    titles = concepts.select(F.col("id").alias("neighbour"), "title")
    return balanced_join(
        neighbours_, titles, "neighbour", "left", fanout=False
    ).select(*neighbours_.columns, "title")


def depths(isa: DataFrame, names: Sentinels = NAMES, max_rounds: int = 1_000) -> DataFrame:
    """Shortest depth ``(id, depth)`` below the virtual top node, which has depth 0."""
    down = cut_lineage(isa.select(F.col("parent_id").alias("id"), F.col("child_id").alias("next")).distinct())
    frontier = cut_lineage(roots(isa).withColumn("depth", F.lit(1)))
    layers = [frontier]
    seen = frontier.select("id")
    for d in range(2, max_rounds):
        # breadth first: the first round that reaches a node gives its depth
        nxt = cut_lineage(
            down.join(frontier.select("id"), "id", "left_semi")
            .select(F.col("next").alias("id")).distinct()
            .join(seen, "id", "left_anti")
            .withColumn("depth", F.lit(d))
        )
        if nxt.isEmpty():
            break
        layers.append(nxt)
        frontier = nxt
        seen = seen.unionByName(nxt.select("id"))
    else:
        raise RuntimeError("depths did not end")
    spark = isa.sparkSession
    out = spark.range(1).select(F.lit(names.top).alias("id"), F.lit(0).alias("depth"))
    for layer in layers:
        out = out.unionByName(layer)
    return out


def ancestors(
    isa: DataFrame,
    seeds: DataFrame | None = None,
    names: Sentinels = NAMES,
    max_rounds: int = 1_000,
) -> DataFrame:
    """Closure ``(id, anc, dist)`` upwards, each node being its own ancestor at 0.

    ``dist`` is the shortest number of links; every node reaches the virtual top.  With
    ``seeds(id)`` only those nodes are followed, so the result grows with the nodes asked
    about and not with all pairs of the graph.
    """
    base = isa.select("child_id", "parent_id").distinct()
    tops = roots(isa).select(F.col("id").alias("child_id"), F.lit(names.top).alias("parent_id"))
    up = cut_lineage(base.unionByName(tops)).withColumnRenamed("child_id", "anc")
    start = (nodes(isa) if seeds is None else seeds.select("id").distinct())
    frontier = cut_lineage(start.select("id", F.col("id").alias("anc"), F.lit(0).alias("dist")))
    closure = frontier
    for d in range(1, max_rounds):
        # nodes have few parents each, so adaptive splitting of hot ancestors is enough
        wide = frontier.select("id", "anc").join(up, "anc").select(
            "id", F.col("parent_id").alias("anc")
        ).distinct()
        frontier = cut_lineage(
            wide.join(closure, ["id", "anc"], "left_anti").withColumn("dist", F.lit(d))
        )
        if frontier.isEmpty():
            return closure
        closure = cut_lineage(closure.unionByName(frontier)) if d % 4 == 0 else closure.unionByName(frontier)
    raise RuntimeError("closure did not end")


def common_ancestors(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Every common ancestor ``(a, b, anc)`` of each distinct pair ``(a, b)``."""
    wanted = pairs.select("a", "b").distinct()
    # a node has few ancestors, so only a hot node makes skew, which is split at run time
    of_a = wanted.join(closure.select(F.col("id").alias("a"), "anc"), "a")
    return of_a.join(closure.select(F.col("id").alias("b"), "anc"), ["b", "anc"], "left_semi").select("a", "b", "anc")


#: Ancestors up to which those of a node are one list; pairs with a node that has more are compared row by row.
LISTED_ANCESTORS = 4_096


def lowest_common_ancestor(
    pairs: DataFrame, closure: DataFrame, depth: DataFrame, isa: DataFrame, names: Sentinels = NAMES
) -> DataFrame:
    """``(a, b, lca, lca_depth)`` for each distinct pair.

    A common ancestor is lowest when no other common ancestor lies below it, which holds
    exactly when it is no direct parent of a common ancestor.  Of several, the deepest
    wins, then the smallest id.

    The ancestors of a node are one list of numbers, which is sent to its pairs and compared there, so common
    ancestors are never rows.
    """
    wanted = cut_lineage(pairs.select("a", "b").distinct())
    known = closure.select("id", "anc").where("id IS NOT NULL AND anc IS NOT NULL")
    wide = cut_lineage(known.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LISTED_ANCESTORS).select("id"))
    if wide.isEmpty():
        return _lowest_in_lists(wanted, known, depth, isa, names)
    marks = [wide.select(F.col("id").alias(x), F.lit(True).alias(f"_{x}")) for x in ("a", "b")]
    marked = cut_lineage(wanted.join(marks[0], "a", "left").join(marks[1], "b", "left"))
    by_row = F.coalesce("_a", "_b", F.lit(False))
    return _lowest_in_lists(
        marked.where(~by_row).select("a", "b"), known.join(wide, "id", "left_anti"), depth, isa, names
    ).unionByName(_lowest_in_rows(marked.where(by_row).select("a", "b"), closure, depth, isa, names))


def _links_up(isa: DataFrame, names: Sentinels) -> DataFrame:
    tops = roots(isa).select(F.col("id").alias("anc"), F.lit(names.top).alias("parent_id"))
    return isa.select(F.col("child_id").alias("anc"), "parent_id").distinct().unionByName(tops)


def _lowest_in_lists(wanted: DataFrame, known: DataFrame, depth: DataFrame, isa: DataFrame, names: Sentinels) -> DataFrame:
    deep = depth.groupBy(F.col("id").alias("anc")).agg(F.max("depth").alias("depth"))
    # numbers follow the order of preference, those without a depth last
    node = cut_lineage(number_rows(
        known.select("anc").distinct().join(deep, "anc", "left"), [F.desc_nulls_last("depth"), F.asc("anc")], "no"))
    parents = _links_up(isa, names).join(node.select(F.col("anc").alias("parent_id"), F.col("no").alias("_p")), "parent_id")
    parents = parents.groupBy("anc").agg(F.collect_set("_p").alias("parents"))
    up = node.join(parents, "anc", "left").select("anc", "no", F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"))
    lists = cut_lineage(known.join(up, "anc").groupBy("id").agg(F.collect_list(F.struct("no", "parents")).alias("ups")))
    met = (
        wanted.join(lists.select(F.col("id").alias("a"), F.col("ups.no").alias("_no")), "a")
        .join(lists.select(F.col("id").alias("b"), "ups"), "b")
        .select("a", "b", "ups", F.array_intersect("_no", "ups.no").alias("common"))
    )
    above = F.flatten(F.transform(F.filter("ups", lambda u: F.array_contains("common", u["no"])), lambda u: u["parents"]))
    # written, as the filter of the next join would work the lists out again
    best = cut_lineage(met.select("a", "b", F.array_min(F.array_except("common", above)).alias("no")))
    return best.join(node.where("depth IS NOT NULL"), "no").select("a", "b", F.col("anc").alias("lca"), F.col("depth").alias("lca_depth"))


def _lowest_in_rows(wanted: DataFrame, closure: DataFrame, depth: DataFrame, isa: DataFrame, names: Sentinels) -> DataFrame:
    common = cut_lineage(common_ancestors(wanted, closure))
    above = common.join(_links_up(isa, names), "anc").select("a", "b", F.col("parent_id").alias("anc")).distinct()
    lowest = common.join(above, ["a", "b", "anc"], "left_anti").join(
        depth.select(F.col("id").alias("anc"), "depth"), "anc"
    )
    best = lowest.groupBy("a", "b").agg(
        F.min(F.struct((-F.col("depth")).alias("d"), F.col("anc").alias("lca"))).alias("m")
    )
    return best.select("a", "b", "m.lca", (-F.col("m.d")).alias("lca_depth"))


def wu_palmer(
    pairs: DataFrame,
    closure: DataFrame,
    depth: DataFrame,
    isa: DataFrame,
    names: Sentinels = NAMES,
    clamp: bool = False,
) -> DataFrame:
    """Wu-Palmer similarity ``(a, b, null_a, null_b, wp)`` of each distinct pair.

    ``null_a``/``null_b`` mark a side that stands for the null child of the given node:
    it is one deeper, while the common ancestor is that of the node itself.  The optional
    columns default to false.  Depths are shortest paths, so on a graph with several
    parents the value can exceed 1 unless ``clamp`` is set.
    """
    for flag in ("null_a", "null_b"):
        if flag not in pairs.columns:
            pairs = pairs.withColumn(flag, F.lit(False))
    wanted = cut_lineage(pairs.select("a", "b", "null_a", "null_b").distinct())
    low = lowest_common_ancestor(wanted, closure, depth, isa, names)
    da = depth.select(F.col("id").alias("a"), F.col("depth").alias("_da"))
    db = depth.select(F.col("id").alias("b"), F.col("depth").alias("_db"))
    wp = (
        2.0 * (F.col("lca_depth") + 1)
        / (
            F.col("_da") + F.col("null_a").cast("int") + 1
            + F.col("_db") + F.col("null_b").cast("int") + 1
        )
    )
    if clamp:
        wp = F.least(wp, F.lit(1.0))
    return (
        wanted.join(low, ["a", "b"]).join(da, "a").join(db, "b")
        .select("a", "b", "null_a", "null_b", wp.alias("wp"))
    )


def wu_palmer_complex(
    pairs: DataFrame,
    closure: DataFrame,
    depth: DataFrame,
    isa: DataFrame,
    properties: DataFrame,
    names: Sentinels = NAMES,
    prefix: str = "",
) -> DataFrame:
    """Similarity of possibly complex ids: mean of an attribute and an atomic part.

    The attribute part is the Jaccard similarity of numbered operators and properties
    (1 when both ids are plain); the atomic part is the mean Wu-Palmer similarity over
    the inner entities of both sides.
    """
    for flag in ("null_a", "null_b"):
        if flag not in pairs.columns:
            pairs = pairs.withColumn(flag, F.lit(False))
    key = ["a", "b", "null_a", "null_b"]
    # a pair is joined by its number: its ids may be long texts
    wanted = cut_lineage(pairs.select(*key).distinct().withColumn("_no", F.monotonically_increasing_id()))
    of_a = wanted.select("a", "_no")
    of_b = wanted.select("b", "_no")
    pa = complex_parts(wanted, "a", properties, prefix)
    pb = complex_parts(wanted, "b", properties, prefix)

    def entities(parts: DataFrame, side: str, name: str) -> DataFrame:
        return parts.where("kind = 'entity'").select(side, F.col("part").alias(name))

    flags = wanted.select("_no", "null_a", "null_b")
    both = (
        of_a.join(entities(pa, "a", "_ea"), "a").select("_no", "_ea")
        .join(of_b.join(entities(pb, "b", "_eb"), "b").select("_no", "_eb"), "_no").join(flags, "_no")
    )
    inner = wu_palmer(
        both.select(F.col("_ea").alias("a"), F.col("_eb").alias("b"), "null_a", "null_b"),
        closure, depth, isa, names,
    ).select(F.col("a").alias("_ea"), F.col("b").alias("_eb"), "null_a", "null_b", "wp")
    atomic = both.join(inner, ["_ea", "_eb", "null_a", "null_b"]).groupBy("_no").agg(
        F.avg("wp").alias("_atomic")
    )

    def attributes(parts: DataFrame, side: str) -> DataFrame:
        return parts.where("kind <> 'entity'").select(side, "part").distinct()

    aa = of_a.join(attributes(pa, "a"), "a").select("_no", "part", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    ab = of_b.join(attributes(pb, "b"), "b").select("_no", "part", F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    shared = (
        aa.unionByName(ab).groupBy("_no", "part")
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
        .groupBy("_no")
        .agg((F.sum(F.col("in_a") * F.col("in_b")) / F.count(F.lit(1))).alias("_jaccard"))
    )
    mean = atomic.join(shared, "_no", "left").select(
        "_no", ((F.coalesce("_jaccard", F.lit(1.0)) + F.col("_atomic")) / 2).alias("wp")
    )
    return wanted.join(mean, "_no").select(*key, "wp")


def edge_similarity(
    edge_pairs: DataFrame,
    closure: DataFrame,
    depth: DataFrame,
    isa: DataFrame,
    properties: DataFrame | None = None,
    names: Sentinels = NAMES,
    prefix: str = "",
) -> DataFrame:
    """Similarity of ``(pred_parent, pred_child)`` and ``(gold_parent, gold_child)``.

    It is the mean of the parent and the child similarity; a null child is represented
    by its parent, one level deeper.  With ``properties`` the ids may be complex.
    Returns the distinct edge pairs with ``sim``.
    """
    key = ["pred_parent", "pred_child", "gold_parent", "gold_child"]
    wanted = edge_pairs.select(*key).distinct()
    wide = wanted.select(
        *key,
        F.when(F.col("pred_child") == names.null, F.col("pred_parent")).otherwise(F.col("pred_child")).alias("a"),
        F.when(F.col("gold_child") == names.null, F.col("gold_parent")).otherwise(F.col("gold_child")).alias("b"),
        (F.col("pred_child") == names.null).alias("null_a"),
        (F.col("gold_child") == names.null).alias("null_b"),
    )
    sides = wide.select("a", "b", "null_a", "null_b").unionByName(
        wide.select(
            F.col("pred_parent").alias("a"), F.col("gold_parent").alias("b"),
            F.lit(False).alias("null_a"), F.lit(False).alias("null_b"),
        )
    )
    if properties is None:
        wp = wu_palmer(sides, closure, depth, isa, names)
    else:
        wp = wu_palmer_complex(sides, closure, depth, isa, properties, names, prefix)
    wp = cut_lineage(wp)
    child = wp.withColumnRenamed("wp", "_child")
    parent = wp.where("NOT null_a AND NOT null_b").select(
        F.col("a").alias("pred_parent"), F.col("b").alias("gold_parent"), F.col("wp").alias("_parent")
    )
    return (
        wide.join(child, ["a", "b", "null_a", "null_b"])
        .join(parent, ["pred_parent", "gold_parent"])
        .select(*key, ((F.col("_parent") + F.col("_child")) / 2).alias("sim"))
    )


def mention_similarity(
    ranked: DataFrame,
    gold: DataFrame,
    closure: DataFrame,
    depth: DataFrame,
    isa: DataFrame,
    properties: DataFrame | None = None,
    names: Sentinels = NAMES,
) -> DataFrame:
    """Best gold similarity of each predicted edge, then average/min/max per mention.

    ``ranked`` and ``gold`` hold ``(mention_id, parent, child)``.  Edge pairs without a
    similarity (unknown ids) are left out.
    """
    best = best_similarity(ranked, gold, closure, depth, isa, properties, names)
    return best.groupBy("mention_id").agg(
        F.avg("sim").alias("wp_avg"), F.min("sim").alias("wp_min"), F.max("sim").alias("wp_max")
    )


def best_similarity(
    ranked: DataFrame,
    gold: DataFrame,
    closure: DataFrame,
    depth: DataFrame,
    isa: DataFrame,
    properties: DataFrame | None = None,
    names: Sentinels = NAMES,
) -> DataFrame:
    """``ranked`` rows with ``sim``, the highest similarity to a gold edge of the mention."""
    p = ranked.withColumnsRenamed({"parent": "pred_parent", "child": "pred_child"})
    g = gold.select(
        "mention_id", F.col("parent").alias("gold_parent"), F.col("child").alias("gold_child")
    ).distinct()
    met = cut_lineage(balanced_join(p, g, "mention_id"))
    sims = edge_similarity(met, closure, depth, isa, properties, names)
    key = ["pred_parent", "pred_child", "gold_parent", "gold_child"]
    rest = [c for c in p.columns]
    return (
        met.join(sims, key)
        .groupBy(*rest).agg(F.max("sim").alias("sim"))
        .withColumnsRenamed({"pred_parent": "parent", "pred_child": "child"})
    )


def subsumes(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Pairs ``(sub, super)`` where the second is an ancestor of the first or equal to it."""
    return pairs.join(
        closure.select(F.col("id").alias("sub"), F.col("anc").alias("super")), ["sub", "super"], "left_semi"
    )


def within_hops(nodes: DataFrame, isa: DataFrame, hops: int) -> DataFrame:
    """``(id, anc)``: each node ``(id)`` with itself and its ancestors at most ``hops`` links away."""
    up = cut_lineage(isa.select(F.col("child_id").alias("anc"), F.col("parent_id").alias("next")).distinct())
    front = cut_lineage(nodes.select("id").distinct().withColumn("anc", F.col("id")))
    reach = front
    for _ in range(hops):
        front = cut_lineage(balanced_join(front, up, "anc").select("id", F.col("next").alias("anc")).distinct())
        reach = reach.unionByName(front)
    return cut_lineage(reach.distinct())


def relax_targets(gold: DataFrame, isa: DataFrame, hops: int = 1) -> DataFrame:
    """Gold edges widened by ``hops``: ancestors of the gold parent and descendants of the
    gold child within that many links, in every combination."""
    up = cut_lineage(isa.select(F.col("child_id").alias("parent"), F.col("parent_id").alias("next")).distinct())
    down = cut_lineage(isa.select(F.col("parent_id").alias("child"), F.col("child_id").alias("next")).distinct())
    g = cut_lineage(gold.select("mention_id", "parent", "child").distinct())

    def widen(df: DataFrame, step: DataFrame, col: str) -> DataFrame:
        """``(mention_id, origin, col)``: each node itself and what lies within the hops."""
        origin = cut_lineage(df.select(col).distinct().withColumn("origin", F.col(col)))
        reach = origin
        front = origin
        for _ in range(hops):
            front = cut_lineage(
                balanced_join(front, step, col).select("origin", F.col("next").alias(col)).distinct()
            )
            reach = reach.unionByName(front)
        return reach.distinct()

    wp = widen(g, up, "parent").select(F.col("parent").alias("new_parent"), F.col("origin").alias("parent"))
    wc = widen(g, down, "child").select(F.col("child").alias("new_child"), F.col("origin").alias("child"))
    raised = cut_lineage(balanced_join(g, wp, "parent"))
    wide = balanced_join(raised, wc, "child")
    return wide.select(
        "mention_id", F.col("new_parent").alias("parent"), F.col("new_child").alias("child")
    ).distinct()
