"""Expressions over concept ids, atomic and complex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the operator marks of the complex-concept notation
SOME = "[EX.]"
AND = "[AND]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_complex(col: Column | str, strict: bool = False) -> Column:
    """Whether an id denotes a complex concept.

    ``strict`` asks for the bracket shape (mark, opening parenthesis, closing one).
    """
    c = _c(col)
    if strict:
        return c.rlike(r"^\[(EX\.|AND)\]\(.*\)$")
    return c.contains(SOME) | c.contains(AND)


def keep_complex(col: Column | str) -> Column:
    """Complex ids worth keeping: with a restriction and not a top-level conjunction."""
    c = _c(col)
    return c.contains(SOME) & ~c.startswith(AND)


def usable(col: Column | str) -> Column:
    """Atomic ids, and those complex ids that are kept."""
    return ~is_complex(col) | keep_complex(col)


def to_iri(col: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _c(col))


def to_id(col: Column | str, prefix: str) -> Column:
    """Strip a mandatory prefix."""
    c = _c(col)
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).when(
        c.isNotNull(), F.raise_error(F.concat(F.lit("id without the expected prefix: "), c))
    )


def prefixed(col: Column | str, prefix: str) -> Column:
    """The prefixed form of an id, whichever form it came in."""
    c = _c(col)
    return F.when(c.startswith(prefix), c).otherwise(to_iri(c, prefix))


def inner_ids(col: Column | str) -> Column:
    """Ids inside the angle brackets of a complex id."""
    return F.regexp_extract_all(_c(col), F.lit("<(.*?)>"), 1)


def complex_parts(
    df: DataFrame, col: str, properties: DataFrame, prefix: str = ""
) -> DataFrame:
    """Long form ``(col, kind, part)`` of the parts of each distinct id.

    Operators are numbered (``[EX.]0``, ``[EX.]1``); inner ids are properties when the
    property table ``(id)`` knows them and entities otherwise; an atomic id is its own
    only entity.
    """
    ids = df.select(col).distinct()
    ops = ids.where(is_complex(col)).select(
        col, F.lit("operator").alias("kind"),
        F.posexplode(F.regexp_extract_all(F.col(col), F.lit(r"(\[EX\.\])"), 1)).alias("pos", "op"),
    ).select(col, "kind", F.concat("op", F.col("pos").cast("string")).alias("part"))
    inner = ids.where(is_complex(col)).select(
        col, F.explode(inner_ids(col)).alias("part")
    ).withColumn("_key", prefixed("part", prefix))
    known = properties.select(prefixed("id", prefix).alias("_key"), F.lit(True).alias("_p")).distinct()
    inner = inner.join(known, "_key", "left").select(
        col, F.when(F.col("_p"), "property").otherwise("entity").alias("kind"), "part"
    )
    atomic = ids.where(~is_complex(col)).select(
        col, F.lit("entity").alias("kind"), F.col(col).alias("part")
    )
    return ops.unionByName(inner).unionByName(atomic)


def numeric_id(col: Column | str) -> Column:
    """The number behind a one-letter id prefix, 0 where there is none."""
    return F.coalesce(_c(col).substr(F.lit(2), F.length(_c(col))).try_cast("long"), F.lit(0))
