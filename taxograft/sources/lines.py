"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File splits up to which their totals (about 200 bytes each) are sent to all tasks.
SENT_SPLITS = 200_000


def read_lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """``(file, line_no, row_no, value)`` without a byte-order mark.

    ``line_no`` counts from 0 within the file, ``row_no`` over all files in path order.
    Lines are counted per file split; only the split totals, one row per split, are added
    up in order and sent to the tasks, so the lines stay where they are read.  With more than
    ``SENT_SPLITS`` splits the totals are joined like any table.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    raw = reader.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        # increasing inside a split, which is all that is used of it
        F.monotonically_increasing_id().alias("_seq"),
    )
    splits = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    in_file = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    in_all = W.orderBy("file", "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "_block", "_first",
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_line"),
        F.coalesce(F.sum("_n").over(in_all), F.lit(0)).alias("_row"),
    )
    # a split is the last one of its file or fills a partition
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= SENT_SPLITS:
        offsets = F.broadcast(offsets)
    place = F.col("_seq") - F.col("_first")
    return raw.join(offsets, ["file", "_block"]).select(
        "file", (F.col("_line") + place).alias("line_no"), (F.col("_row") + place).alias("row_no"), "value"
    )
