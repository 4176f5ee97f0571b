"""Array, vector and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def list_union(a: Column | str, b: Column | str) -> Column:
    """Ordered union without repeats."""
    return F.array_union(_c(a), _c(b))


def diff_size(a: Column | str, b: Column | str, both: bool = True) -> Column:
    """Number of distinct entries of ``a`` missing in ``b``, and the reverse with ``both``."""
    one = F.size(F.array_except(_c(a), _c(b)))
    return one + F.size(F.array_except(_c(b), _c(a))) if both else one


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def contains_run(needle: Column, hay: Column) -> Column:
    """Whether ``needle`` occurs in ``hay`` as consecutive entries."""
    edge = "\u0001"
    join = lambda a: F.concat(F.lit(edge), F.array_join(a, edge), F.lit(edge))
    return (F.size(needle) == 0) | F.contains(join(hay), join(needle))


def pad_to(col: Column | str, k: int, value=-1) -> Column:
    """First ``k`` entries, filled up with ``value``."""
    c = _c(col)
    return F.slice(F.concat(c, F.array_repeat(F.lit(value), F.greatest(F.lit(k) - F.size(c), F.lit(0)))), 1, k)


def multi_hot(positions: Column | str, k: int) -> Column:
    """0/1 vector of length ``k`` from a list of positions."""
    p = _c(positions)
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.array_contains(p, i).cast("int")
    )


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, v: s + v,
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(_c(a), lambda x: x.cast("double"))).otherwise(
        F.transform(_c(a), lambda x: x.cast("double") / n)
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def blend(score_ctx: Column | str, score: Column | str, alpha: float = 0.5) -> Column:
    return F.lit(alpha) * _c(score_ctx) + F.lit(1 - alpha) * _c(score)


def f1(p: Column | str, r: Column | str) -> Column:
    """F1 of two rates; -1 when either is undefined, 0 when both are 0."""
    p, r = _c(p), _c(r)
    return F.when(p.isNull() | r.isNull() | (p < 0) | (r < 0), F.lit(-1.0)).otherwise(
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    )


def decide(logit: Column | str) -> Column:
    """0/1 decision of a logit: sigmoid rounded to the nearest, one half downwards."""
    return (1 / (1 + F.exp(-_c(logit))) > 0.5).cast("int")
