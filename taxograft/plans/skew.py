"""Joins that stay balanced when few keys hold most rows.

Adaptive execution splits a skewed *input* partition.  It cannot see a join whose
inputs are small but whose output explodes on one key, nor a hot key that feeds an
aggregation in the same stage.  :func:`balanced_join` covers those cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
#: Hot keys up to which they are broadcast; more of them are joined like any other table.
SENT_KEYS = 10_000


def hot_keys(
    left: DataFrame,
    right: DataFrame | None,
    keys: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    both_sides: bool = False,
) -> DataFrame:
    """Rows ``(keys, _a, _b)`` of all keys worth splitting.

    ``_a`` is the number of slices of the left rows, ``_b`` that of the right ones.  With
    ``right`` given, the weight of a key is the number of joined rows it makes, and with
    ``both_sides`` the right rows are sliced where the left ones are too few.
    """
    weight = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if right is not None:
        fan = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
        weight = weight.join(fan, list(keys))
    else:
        weight = weight.withColumn("_m", F.lit(1))
    total = F.col("_n") * F.col("_m")
    slices = F.ceil(total / F.lit(rows_per_task))
    a = F.least(slices, F.col("_n"))
    b = F.ceil(slices / a) if both_sides else F.lit(1)
    return (
        weight.where(total > rows_per_task)
        .select(*keys, a.cast("long").alias("_a"), b.cast("long").alias("_b"))
    )


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    fanout: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join that spreads the rows of hot keys over many tasks.

    A left row of a hot key goes to one of ``a`` slices, computed from its ``spread``
    columns, and is repeated for the ``b`` slices of the right rows; a right row the other
    way round.  Each pair meets exactly once, so the result equals the plain join.  Only
    inner joins slice the right side.  ``how`` may be inner, left, left_semi or left_anti.

    Joins that only look up one row (no ``fanout``) cannot explode: they stay lazy plain joins,
    whose skewed partitions adaptive execution splits.  The others count their keys first.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"balanced_join cannot do {how!r}")
    if not fanout:
        return left.join(right, keys, how)
    both = how == "inner"
    hot = hot_keys(left, right, keys, rows_per_task, both)
    few = hot.limit(SENT_KEYS + 1).collect()  # a bounded number of keys and two counts
    if not few:
        return left.join(right, keys, how)
    if len(few) <= SENT_KEYS:
        hot = F.broadcast(left.sparkSession.createDataFrame(few, hot.schema))
    zero = F.lit(0).cast("long")

    def slot(count: str, by: Sequence[str]):
        return F.coalesce(F.pmod(F.xxhash64(*by), F.col(count)), zero)

    def copies(count: str):
        return F.explode(F.sequence(zero, F.coalesce(F.col(count) - 1, zero)))

    spread = list(spread) if spread else left.columns
    l = left.join(hot, keys, "left").withColumn("_i", slot("_a", spread))
    l = l.withColumn("_j", copies("_b") if both else zero).drop("_a", "_b")
    r = right.join(hot, keys, "left").withColumn("_j", slot("_b", right.columns) if both else zero)
    r = r.withColumn("_i", copies("_a")).drop("_a", "_b")
    return l.join(r, [*keys, "_i", "_j"], how).drop("_i", "_j")
