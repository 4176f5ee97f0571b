"""Entity and edge catalogues built from a subsumption graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.functions.ids import is_complex, usable
from taxograft.model import Sentinels
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import first_rows, number_rows, running_sum
from taxograft.plans.skew import balanced_join

NAMES = Sentinels()

# fixed values: annotation properties in the order their values become synonyms
PROFILES = {
    "skos": ("label", "prefLabel", "altLabel"),
    "exact": ("label", "exactSynonym"),
}


def concept_heads(annotations: DataFrame) -> DataFrame:
    """Title and definition of each concept: the first label and the first definition."""
    first = lambda prop: F.coalesce(F.min(F.when(F.col("prop") == prop, F.col("value"))), F.lit(""))
    return annotations.groupBy("id").agg(first("label").alias("title"), first("definition").alias("definition"))


def concept_synonyms(annotations: DataFrame, profile: str = "skos") -> DataFrame:
    """Synonyms of each concept, one per row: ``(id, prop_rank, synonym)``.

    All labels but the title, property by property in the profile's order, sorted by value.
    """
    props = PROFILES[profile]
    rank = F.coalesce(*[F.when(F.col("prop") == p, F.lit(i)) for i, p in enumerate(props)])
    labels = annotations.select("id", rank.alias("prop_rank"), F.col("value").alias("synonym")).where(
        F.col("prop_rank").isNotNull()
    ).distinct()
    title = annotations.where(F.col("prop") == props[0]).groupBy("id").agg(F.min("value").alias("synonym"))
    return labels.join(title.withColumn("prop_rank", F.lit(0)), ["id", "prop_rank", "synonym"], "left_anti")


def concept_info(annotations: DataFrame, profile: str = "skos", chunk: int = 10_000) -> DataFrame:
    """Title, definition and synonym list of each concept from ``(id, prop, value)`` rows.

    A concept with more than ``chunk`` synonyms has several rows, told apart by ``part``,
    so that no list grows with the data.
    """
    synonyms = cut_lineage(concept_synonyms(annotations, profile))
    sizes = synonyms.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_parts"))
    lists = (
        synonyms.join(sizes, "id")
        .withColumn("part", F.pmod(F.xxhash64("synonym"), F.col("_parts")).cast("int"))
        .groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("prop_rank", "synonym"))).alias("_s"))
    )
    return concept_heads(annotations).join(lists, "id", "left").select(
        "id", F.coalesce("part", F.lit(0)).alias("part"), "title", "definition",
        F.coalesce(F.col("_s.synonym"), F.array().cast("array<string>")).alias("synonyms"),
    )


def entity_rows(annotations: DataFrame, synonyms: str = "attr", profile: str = "skos") -> DataFrame:
    """Catalogue rows of annotated concepts in one of three layouts.

    ``attr`` keeps one row with the synonyms as a ``|`` list, ``rows`` gives the title and
    every synonym a row of its own under the same id, ``concat`` appends the synonyms to
    the title.  ``pos`` is the row's place within its concept.
    """
    if synonyms == "rows":
        heads = cut_lineage(concept_heads(annotations))
        titles = heads.select("id", F.lit(-1).alias("prop_rank"), F.col("title").alias("synonym"))
        ordered = number_rows(
            titles.unionByName(concept_synonyms(annotations, profile)), ["id", "prop_rank", "synonym"], "_n"
        )
        first = ordered.where("prop_rank = -1").select("id", F.col("_n").alias("_first"))
        return ordered.join(first, "id").join(heads, "id").select(
            F.col("id").alias("idx"), (F.col("_n") - F.col("_first")).cast("int").alias("pos"),
            F.col("synonym").alias("title"), F.col("title").alias("entity"), F.col("definition").alias("text"),
            F.lit("").alias("synonyms"),
        )
    base = concept_info(annotations, profile)
    if synonyms == "attr":
        return base.select(
            F.col("id").alias("idx"), F.col("part").alias("pos"), "title",
            F.col("title").alias("entity"), F.col("definition").alias("text"),
            F.array_join("synonyms", "|").alias("synonyms"),
        )
    if synonyms == "concat":
        return base.select(
            F.col("id").alias("idx"), F.col("part").alias("pos"),
            F.trim(F.concat_ws(" ", F.array("title"), "synonyms")).alias("title"),
            F.col("title").alias("entity"), F.col("definition").alias("text"), F.lit("").alias("synonyms"),
        )
    raise ValueError(synonyms)


def property_catalogue(properties: DataFrame, annotations: DataFrame, profile: str = "skos") -> DataFrame:
    """Catalogue rows of the ontology's properties ``(id)``."""
    own = annotations.join(properties.select("id").distinct(), "id", "left_semi")
    return entity_rows(own, "attr", profile)


def fill_neighbours(
    concepts: DataFrame, isa: DataFrame, names: Sentinels = NAMES
) -> DataFrame:
    """Links ``(parent_idx, child_idx)`` around each concept, closed by the virtual nodes.

    A concept without a parent hangs under the top node and one without a child gets the
    null node as its child.  Complex neighbours that are not worth keeping are dropped.
    """
    links = isa.where(usable("parent_id") & usable("child_id")).select(
        F.col("parent_id").alias("parent_idx"), F.col("child_id").alias("child_idx")
    ).distinct()
    ids = concepts.select("id").distinct()
    no_parent = ids.join(links.select(F.col("child_idx").alias("id")), "id", "left_anti")
    no_child = ids.join(links.select(F.col("parent_idx").alias("id")), "id", "left_anti")
    return links.unionByName(
        no_parent.select(F.lit(names.top).alias("parent_idx"), F.col("id").alias("child_idx"))
    ).unionByName(
        no_child.select(F.col("id").alias("parent_idx"), F.lit(names.null).alias("child_idx"))
    )


def dedupe_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One row per ``(parent_idx, child_idx)``.

    A direct edge wins over an indirect one; with ``order`` the earliest row decides,
    as a scan that keeps the first insertion would.
    """
    degree = F.min("degree") if order is None else F.min_by("degree", order)
    return edges.groupBy("parent_idx", "child_idx").agg(degree.alias("degree"))


def edge_catalogue(
    concepts: DataFrame,
    isa: DataFrame,
    names: Sentinels = NAMES,
    first_insertion: bool = False,
) -> DataFrame:
    """All edges a concept could be inserted into, with titles.

    Degree 0 edges are the links themselves; degree 1 edges skip exactly one concept.
    ``first_insertion`` gives a duplicate edge the degree of its first occurrence when
    concepts are scanned by id, as the order-dependent variant of the catalogue does.
    """
    # read four times below, so written once
    links = cut_lineage(fill_neighbours(concepts, isa, names))
    own = concepts.select("id").distinct()
    up = links.join(own.withColumnRenamed("id", "child_idx"), "child_idx", "left_semi").select(
        F.col("child_idx").alias("mid"), "parent_idx"
    )
    down = links.join(own.withColumnRenamed("id", "parent_idx"), "parent_idx", "left_semi").select(
        F.col("parent_idx").alias("mid"), "child_idx"
    )
    over = balanced_join(down, up, "mid")
    if first_insertion:
        direct = up.select(
            "parent_idx", F.col("mid").alias("child_idx"), F.lit(0).alias("degree"),
            F.struct(F.col("mid"), F.lit(0).alias("phase")).alias("_order"),
        ).unionByName(
            down.select(
                F.col("mid").alias("parent_idx"), "child_idx", F.lit(0).alias("degree"),
                F.struct(F.col("mid"), F.lit(1).alias("phase")).alias("_order"),
            )
        )
        edges = dedupe_edges(
            direct.unionByName(
                over.select(
                    "parent_idx", "child_idx", F.lit(1).alias("degree"),
                    F.struct(F.col("mid"), F.lit(2).alias("phase")).alias("_order"),
                )
            ),
            "_order",
        )
    else:
        direct = up.select("parent_idx", F.col("mid").alias("child_idx")).unionByName(
            down.select(F.col("mid").alias("parent_idx"), "child_idx")
        )
        edges = dedupe_edges(
            direct.withColumn("degree", F.lit(0)).unionByName(
                over.select("parent_idx", "child_idx", F.lit(1).alias("degree"))
            )
        )
    return with_titles(edges, concepts, names)


def with_titles(edges: DataFrame, concepts: DataFrame, names: Sentinels = NAMES) -> DataFrame:
    """Add the ``parent`` and ``child`` titles; ids and titles are filtered together."""
    titles = first_rows(concepts.select("id", "title"), ["id"], ["title"])
    p = titles.select(F.col("id").alias("parent_idx"), F.col("title").alias("parent"))
    c = titles.select(F.col("id").alias("child_idx"), F.col("title").alias("child"))
    wide = edges.join(p, "parent_idx", "left").join(c, "child_idx", "left")
    return wide.select(
        "parent_idx", "child_idx",
        F.when(F.col("parent_idx") == names.top, names.top_title)
        .otherwise(F.coalesce("parent", "parent_idx")).alias("parent"),
        F.when(F.col("child_idx") == names.null, names.null_title)
        .otherwise(F.coalesce("child", "child_idx")).alias("child"),
        *[x for x in edges.columns if x not in {"parent_idx", "child_idx"}],
    )


def number_edges(edges: DataFrame) -> DataFrame:
    """Edge ids: 0-based positions in (parent, child) order."""
    return number_rows(edges, ["parent_idx", "child_idx"], "edge_id")


def local_ids(catalogue: DataFrame, order: list[str], concept: str = "idx") -> DataFrame:
    """Row ids of a catalogue and, per concept, the id of its first (canonical) row."""
    numbered = number_rows(catalogue, order, "local_id")
    canonical = numbered.groupBy(concept).agg(F.min("local_id").alias("canonical_id"))
    return numbered.join(canonical, concept)


def rows_by_concept(numbered: DataFrame, concept: str = "idx") -> DataFrame:
    """All catalogue rows of each concept in row order, numbered from 0 (long form)."""
    counted = running_sum(numbered, [concept], "local_id", F.lit(1), "_n", dense=False)
    return counted.select(concept, (F.col("_n") - 1).alias("pos"), "local_id", "title")


def merge_neighbours(atomic: DataFrame, complex_: DataFrame) -> DataFrame:
    """Union of atomic and kept complex neighbours ``(id, side, neighbour)``, no empties."""
    return (
        atomic.unionByName(complex_.where(usable("neighbour")))
        .where(F.length("neighbour") > 0).distinct()
    )


def retained_universe(classes: DataFrame, properties: DataFrame) -> DataFrame:
    return classes.select("id").unionByName(properties.select("id")).distinct()


def append_complex(rows: DataFrame, complex_ids: DataFrame) -> DataFrame:
    """Append complex concepts ``(id, title)`` to catalogue rows, without neighbours."""
    extra = complex_ids.where(usable("id") & is_complex("id")).select(
        F.col("id").alias("idx"), F.lit(0).alias("pos"), "title",
        F.col("title").alias("entity"), F.lit("").alias("text"), F.lit("").alias("synonyms"),
    )
    return rows.unionByName(extra.distinct())


def append_nil(rows: DataFrame, names: Sentinels = NAMES) -> DataFrame:
    """Append the one row that stands for unseen concepts."""
    spark = rows.sparkSession
    nil = spark.range(1).select(
        F.lit(names.unseen).alias("idx"), F.lit(0).alias("pos"), F.lit(names.unseen).alias("title"),
        F.lit(names.unseen).alias("entity"), F.lit("").alias("text"), F.lit("").alias("synonyms"),
    )
    return rows.unionByName(nil)


def drop_complex_edges(edges: DataFrame) -> DataFrame:
    return edges.where(~is_complex("parent_idx") & ~is_complex("child_idx"))


def complex_subset(pairs: DataFrame, parent: str = "parent_concept", child: str = "child_concept") -> DataFrame:
    """Rows of any split whose edge touches a complex concept."""
    mark = r"(?i)\[EX"
    return pairs.where(F.col(parent).rlike(mark) | F.col(child).rlike(mark))


def expand_axioms(axioms: DataFrame) -> DataFrame:
    """Subsumption links from axioms ``(sub_id, kind, conjuncts)``.

    A conjunction on the right gives one link per part.  An equivalence counts as an
    inclusion, but only when its right side is a real conjunction.
    """
    used = axioms.where((F.col("kind") == "subclass") | (F.size("conjuncts") > 1))
    return used.select(
        F.col("sub_id").alias("child_id"), F.explode("conjuncts").alias("parent_id")
    ).distinct()


def pack_neighbours(neighbours_: DataFrame, titles: DataFrame | None = None, chunk: int = 10_000) -> DataFrame:
    """Export form: neighbour lists ``(id, part, ids)`` with at most about ``chunk`` entries.

    Concepts with fewer neighbours have one sorted list; a hub is spread over several
    parts, so no row and no task has to hold all of its neighbours.
    """
    n = neighbours_.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    parts = neighbours_.join(n, "id").withColumn(
        "part", F.pmod(F.xxhash64("neighbour"), F.ceil(F.col("_n") / chunk)).cast("int")
    )
    if titles is not None:
        parts = parts.join(titles.select(F.col("id").alias("neighbour"), "title"), "neighbour", "left")
        item = F.struct("neighbour", "title")
    else:
        item = F.col("neighbour")
    return parts.groupBy("id", "part").agg(F.array_sort(F.collect_list(item)).alias("ids"))


def catalogue_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("degree").agg(F.count(F.lit(1)).alias("n_edges"))


def definition_share(concepts: DataFrame) -> DataFrame:
    """Number of concepts and the share with a definition."""
    has = (F.length("definition") > 0).cast("int")
    return concepts.agg(
        F.count(F.lit(1)).alias("n_concepts"),
        F.sum(has).alias("n_defined"),
        F.avg(has).alias("share"),
    )
