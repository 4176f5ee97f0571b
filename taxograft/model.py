"""Schemas, sentinel node names and operator settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Sentinels:
    """Names of the virtual nodes that close a taxonomy at both ends."""

    top: str = "THING"
    top_title: str = "TOP"
    null: str = "NULL"
    null_title: str = "NULL"
    unseen: str = "NIL"


@dataclass(frozen=True)
class Settings:
    """Parameters of a placement run (what a command line would carry)."""

    seeds: int = 10
    cap: int = 50
    alpha: float = 0.5
    leaf_value: float | None = None
    #: Every leaf edge gets ``leaf_value``, not only those of mentions taken for leaves.
    leaf_always: bool = False
    #: Seeds and edge scores by ``idf`` over texts or ``dense`` by the cosine of given vectors.
    seeds_by: str = "idf"
    edges_by: str = "idf"
    enrich: bool = True
    ks: tuple[int, ...] = (1, 3, 5, 10, 20, 50, 100, 150, 200, 250, 300)
    names: Sentinels = field(default_factory=Sentinels)


NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType())])
PATH = T.StructType(
    [T.StructField("parent", T.StringType()), T.StructField("child", T.StringType())]
)

ISA = T.StructType(
    [T.StructField("child_id", T.StringType()), T.StructField("parent_id", T.StringType())]
)

ANNOTATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("prop", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

ENTITY = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("idx", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("parents", T.ArrayType(NODE)),
        T.StructField("children", T.ArrayType(NODE)),
        T.StructField("paths", T.ArrayType(PATH)),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("parent_idx", T.StringType()),
        T.StructField("child_idx", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("child", T.StringType()),
        T.StructField("degree", T.IntegerType()),
    ]
)

MENTION = T.StructType(
    [
        T.StructField("context_left", T.StringType()),
        T.StructField("mention", T.StringType()),
        T.StructField("context_right", T.StringType()),
        T.StructField("label_concept", T.StringType()),
        T.StructField("label_concept_ori", T.StringType()),
    ]
)

#: Columns that identify one mention.
MENTION_KEY = ["mention", "context_left", "context_right", "label_concept_ori"]
