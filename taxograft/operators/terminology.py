"""Terminology tables: names, synonyms, definitions, hierarchy and release history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.functions.text import clean_synonym
from taxograft.model import Sentinels
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import last_seen
from taxograft.plans.skew import balanced_join

NAMES = Sentinels()


def filter_terms(
    names: DataFrame, types: DataFrame | None = None, sources: Sequence[str] | None = None,
    langs: Sequence[str] | None = None,
) -> DataFrame:
    """Names of concepts with a wanted semantic type ``types(cui)``, source and language."""
    if sources is not None:
        names = names.where(F.col("source").isin(*sources))
    if langs is not None:
        names = names.where(F.col("lang").isin(*langs))
    if types is not None:
        names = names.join(types.select("cui").distinct(), "cui", "left_semi")
    return names


def cui_map(names: DataFrame, source: str) -> DataFrame:
    """Ontology ids ``(cui, code)`` of one source."""
    return names.where(F.col("source") == source).select("cui", "code").distinct()


def aui_map(names: DataFrame) -> DataFrame:
    return names.select("aui", "cui").distinct()


def map_aui(paths: DataFrame, aui: DataFrame, col: str = "aui") -> DataFrame:
    """Hierarchy atoms replaced by their concepts."""
    return balanced_join(paths, aui.withColumnRenamed("aui", col), col, fanout=False)


def default_names(names: DataFrame, lang: str = "ENG") -> DataFrame:
    """First name in the preferred language, else the first in any."""
    order = F.struct((F.col("lang") != lang).alias("other"), "line_no")
    return names.groupBy("cui").agg(F.min_by("name", order).alias("name"))


def synonyms(names: DataFrame, defaults: DataFrame, clean: bool = False, compat: bool = False) -> DataFrame:
    """Distinct synonyms ``(cui, synonym)`` other than the default name."""
    value = clean_synonym("name", compat) if clean else F.col("name")
    own = clean_synonym("name", compat) if clean else F.lower("name")
    all_ = names.select("cui", value.alias("synonym")).where(F.col("synonym").isNotNull()).distinct()
    named = defaults.select("cui", own.alias("synonym"))
    raw = defaults.select("cui", F.col("name").alias("synonym"))
    return all_.join(named.unionByName(raw).distinct(), ["cui", "synonym"], "left_anti")


def definitions(defs: DataFrame) -> DataFrame:
    """The last definition of each concept."""
    return defs.groupBy("cui").agg(F.max_by("definition", "line_no").alias("definition"))


def latest_state(history: DataFrame) -> DataFrame:
    """Latest state of each id by effective time (a later row wins ties), and whether it
    was ever active."""
    return history.groupBy("id").agg(
        F.max_by("active", F.struct("effective_time", "line_no")).alias("active"),
        F.bool_or(F.col("active") == "1").alias("ever_active"),
    )


def state_counts(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("active") == "1").alias("n_active"),
        F.count_if("ever_active").alias("n_ever_active"),
    )


def check_inactive(ids: DataFrame, state: DataFrame) -> DataFrame:
    """Listed ids that are not inactive in the latest state (or have none)."""
    return ids.select("id").distinct().join(state, "id", "left").where(
        F.col("active").isNull() | (F.col("active") != "0")
    ).select("id", "active")


def hierarchy_pairs(
    paths: DataFrame, aui: DataFrame, chapter_names: DataFrame, source: str, chapter: str,
    rel: str = "isa", names: Sentinels = NAMES,
) -> tuple[DataFrame, DataFrame]:
    """Direct links and parent-child paths from hierarchy rows.

    ``paths(file, line_no, cui, source, rel, path)``: a row of the wanted source opens a
    block for its concept, selected when the relation fits and the second step of its
    dotted path belongs to the chapter; rows with an empty source continue the block.
    ``chapter_names(cui, name)`` are default names.  Returns ``isa(child_id, parent_id)``
    and ``paths(id, parent, child)``, completed by the null and top nodes.
    """
    steps = F.split("path", r"\.")
    in_chapter = (
        aui.join(chapter_names.where(F.col("name") == chapter).select("cui"), "cui", "left_semi")
        .select(F.col("aui").alias("_chapter")).distinct().withColumn("_in", F.lit(True))
    )
    rows = paths.where((F.col("source") == source) | (F.col("source") == "")).withColumn(
        "_chapter", F.when(F.col("source") == source, F.get(steps, F.lit(1)))
    )
    rows = balanced_join(rows, in_chapter, "_chapter", "left", fanout=False)
    opens = F.col("source") == source
    state = F.when(
        opens, F.struct((F.coalesce("_in", F.lit(False)) & (F.col("rel") == rel)).alias("on"), F.col("cui").alias("child"))
    )
    marked = last_seen(cut_lineage(rows), ["file"], "line_no", state, "_block_state")
    used = cut_lineage(
        marked.where("_block_state.on").where(F.size(steps) > 1).select(
            F.col("_block_state.child").alias("child_id"), F.element_at(steps, -1).alias("parent_aui"),
            F.when(F.size(steps) > 2, F.element_at(steps, -2)).alias("grand_aui"),
        ).distinct()
    )
    parents = balanced_join(used, aui.select(F.col("aui").alias("parent_aui"), F.col("cui").alias("parent_id")), "parent_aui", fanout=False)
    isa = cut_lineage(parents.select("child_id", "parent_id").distinct())
    grand = aui.select(F.col("aui").alias("grand_aui"), F.col("cui").alias("parent"))
    through = cut_lineage(
        balanced_join(parents.where("grand_aui IS NOT NULL"), grand, "grand_aui", fanout=False)
        .select(F.col("parent_id").alias("id"), "parent", F.col("child_id").alias("child")).distinct()
    )
    has = through.select("id").distinct()
    low = isa.select(F.col("child_id").alias("id"), F.col("parent_id").alias("parent")).join(has, "id", "left_anti").withColumn("child", F.lit(names.null))
    settled = has.unionByName(low.select("id")).distinct()
    high = isa.select(F.col("parent_id").alias("id"), F.col("child_id").alias("child")).join(settled, "id", "left_anti").select(
        "id", F.lit(names.top).alias("parent"), "child"
    )
    return isa, through.unionByName(low).unionByName(high)
