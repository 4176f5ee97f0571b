"""Ranks, row numbers and running totals without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage


def top_k(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of each group, ranked from 1.

    Spark plans the filter on ``row_number`` as a group limit that already runs before
    the shuffle, so each task sends at most ``k`` rows of a hot group.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group, by a pre-aggregating minimum instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*")


def running_totals(
    df: DataFrame, order: Sequence[str | Column], **values: Column
) -> DataFrame:
    """Inclusive running sums over the whole table in the given order.

    The table is range-partitioned and written once; sums inside a partition and the
    few partition totals are then added.  ``order`` should be a unique key.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    for name, value in values.items():
        ranged = ranged.withColumn(f"_v_{name}", value)
    ranged = cut_lineage(ranged)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    # one row per partition: bounded by the partition count, not by the data
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    out = ranged
    for name in values:
        out = out.withColumn(name, F.sum(f"_v_{name}").over(inside))
    out = out.join(F.broadcast(offsets), "_part")
    for name in values:
        out = out.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    extra = ["_part"] + [f"_v_{n}" for n in values] + [f"_o_{n}" for n in values]
    return out.drop(*extra)


def number_rows(
    df: DataFrame, order: Sequence[str | Column], name: str = "row_id", start: int = 0
) -> DataFrame:
    """Consecutive row numbers over the whole table in the order of a unique key."""
    numbered = running_totals(df, order, **{name: F.lit(1).cast("long")})
    return numbered.withColumn(name, F.col(name) + (start - 1))


BLOCK = 100_000


def _blocks(df: DataFrame, keys: Sequence[str], order: str, size: int, dense: bool) -> DataFrame:
    """Blocks of consecutive rows of a group.

    Dense order values (line numbers, positions) are cut by value, which costs nothing.
    Others are range-partitioned by group and order and written once, so that a block is what
    one partition holds of a group, however far apart the values lie.
    """
    if dense:
        return df.withColumn("_block", F.floor(F.col(order) / size))
    return cut_lineage(df.repartitionByRange(*keys, order).withColumn("_block", F.spark_partition_id()))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    size: int = BLOCK,
    dense: bool = True,
) -> DataFrame:
    """Running sum per group over an order column, for groups of any size.

    Each group is cut into blocks, of ``size`` consecutive order values where these are
    ``dense``; only the block totals are ever sorted together.
    """
    blocked = _blocks(df, keys, order, size, dense).withColumn("_v", value)
    by_block = [*keys, "_block"]
    inside = W.partitionBy(*by_block).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = (
        W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy(*by_block)
        .agg(F.sum("_v").alias("_t"))
        .withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .drop("_t")
    )
    return (
        blocked.withColumn(name, F.sum("_v").over(inside))
        .join(offsets, by_block)
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_block", "_v", "_before")
    )


def last_seen(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    size: int = BLOCK,
    dense: bool = True,
) -> DataFrame:
    """Last non-null value up to and including each row, blocked like :func:`running_sum`."""
    blocked = _blocks(df, keys, order, size, dense).withColumn("_v", value)
    by_block = [*keys, "_block"]
    inside = W.partitionBy(*by_block).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = (
        W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    )
    carried = (
        blocked.groupBy(*by_block)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_t"))
        .withColumn("_before", F.last("_t", ignorenulls=True).over(before))
        .drop("_t")
    )
    return (
        blocked.withColumn(name, F.last("_v", ignorenulls=True).over(inside))
        .join(carried, by_block)
        .withColumn(name, F.coalesce(F.col(name), F.col("_before")))
        .drop("_block", "_v", "_before")
    )
