"""Sinks: catalogues, splits, predictions, reports and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, optionally one folder per value of ``by``."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


def write_by_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of JSON lines per ``dataset_name``."""
    write_jsonl(df, path, "dataset_name", mode)


def to_sieve(df: DataFrame) -> DataFrame:
    """Lines ``id||name|synonym|synonym`` from ``(id, name, synonyms)``."""
    return df.select(
        F.concat(F.col("id"), F.lit("||"), F.array_join(F.concat(F.array("name"), "synonyms"), "|")).alias("value")
    )


def keep_list(concepts: DataFrame, id_map: DataFrame, prefix: str) -> DataFrame:
    """Distinct IRIs of the kept concepts ``(cui)`` through a map ``(cui, code)``."""
    return concepts.select("cui").distinct().join(id_map, "cui").select(
        F.concat(F.lit(prefix), "code").alias("value")
    ).distinct()


def export_ranked(ranked: DataFrame, form: str = "map", chunk: int = 1_000) -> DataFrame:
    """Ranked edges ``(mention_id, rank, edge, score)`` of each mention in one value.

    ``map`` gives edge to score, ``text`` the edges best first with their scores.  A value
    holds ``chunk`` ranks at most; longer rankings go on in further parts.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "edge", "score")))
    part = F.floor((F.col("rank") - 1) / chunk).cast("int")
    grouped = ranked.groupBy("mention_id", part.alias("part")).agg(rows.alias("r"))
    if form == "map":
        pairs = F.transform("r", lambda x: F.struct(x["edge"], x["score"]))
        return grouped.select("mention_id", "part", F.map_from_entries(pairs).alias("edges"))
    if form == "text":
        each = F.transform("r", lambda x: F.format_string("%s (%.4f)", x["edge"], x["score"]))
        return grouped.select("mention_id", "part", F.array_join(each, "; ").alias("edges"))
    raise ValueError(form)


def write_text(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """The ``value`` (or ``line``) column as text files, globally sorted if asked."""
    col = "value" if "value" in df.columns else "line"
    out = df.orderBy(*order) if order else df
    out.select(F.col(col).alias("value")).write.mode(mode).text(path)


def pivot_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metric table ``(dataset, slice, name, value)`` with one column per metric."""
    return metrics.groupBy("dataset", "slice").pivot("name", list(names)).agg(F.max("value"))


def build_kb_table(docs: DataFrame, path: str, key: str = "id", mode: str = "errorifexists") -> None:
    """Documents as Parquet, range-partitioned and sorted by key for selective look-ups."""
    docs.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def bucket_kb_table(docs: DataFrame, table: str, buckets: int, key: str = "id", mode: str = "errorifexists") -> None:
    """Documents as a bucketed table, so that joins on the key need no shuffle of it."""
    docs.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
