"""Mentions that arrive over time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from taxograft.model import Settings
from taxograft.plans.placement import TextIndex, place_mentions


def place_stream(
    stream: DataFrame,
    concepts: DataFrame | TextIndex,
    isa: DataFrame,
    edges: DataFrame | None,
    sink: Callable[[DataFrame, int], None],
    settings: Settings | None = None,
    vectors: DataFrame | None = None,
) -> DataStreamWriter:
    """Place each micro-batch of mentions with the batch operator and hand it to ``sink``.

    The sink gets ``(ranked edges, batch id)``; a sink that overwrites the batch's own
    folder makes retries harmless.  The concepts are indexed once, before the first batch, or
    come as an index that was saved before.
    """
    by_idf = settings is None or "idf" in {settings.seeds_by, settings.edges_by}
    index = TextIndex.build(concepts) if by_idf and not isinstance(concepts, TextIndex) else concepts

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(place_mentions(batch, index, isa, edges, settings, vectors), batch_id)

    return stream.writeStream.foreachBatch(each)


def drop_repeats_stream(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """First arrival of each repeated mention; repeats later than ``delay`` count as new."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def nil_frequency_stream(
    stream: DataFrame, concept: str, time: str, window: str, delay: str
) -> DataFrame:
    """Running number of mentions of each concept per time window."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), concept)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), concept, "n")
    )


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps every batch in a folder of its own."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
