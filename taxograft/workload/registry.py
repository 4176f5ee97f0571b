"""Registered queries with the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxograft.plans.lineage import store
from taxograft.session import tune

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

#: Tables with long texts and their keys.
LONG_TEXTS = {"documents": "doc_id", "pages": "page_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}  # without the derived inputs, see oracle()
INPUTS: dict[str, str] = {}
SPARK_INPUTS: dict[str, str] = {}  # where Spark needs another text for the same rows
STORED: set[str] = set()
_written: dict[tuple[str, str, str], DataFrame] = {}


def derive(name: str, sql: str, stored: bool = False, spark: str | None = None) -> None:
    """Name an input that both engines derive from the given tables with one SQL text.

    A ``stored`` input is written once per session, as a real taxonomy table would be.  ``spark`` is a
    text that gives the same rows where Spark's plan for the common one does not scale.
    """
    INPUTS[name] = sql.strip()
    if spark is not None:
        SPARK_INPUTS[name] = spark.strip()
    if stored:
        STORED.add(name)


def not_in(source: str, x: str, column: str, table: str) -> str:
    """``source WHERE x NOT IN (SELECT column FROM table)`` without sending the table to every task.

    Spark broadcasts the subquery of a NOT IN, whatever its size.  This is an anti join; the conditions
    keep what NOT IN does: a null in the column leaves no row, a null ``x`` only passes an empty table.
    """
    return f"""{source} LEFT ANTI JOIN (SELECT DISTINCT {column} AS _x FROM {table}) ON {x} = _x
WHERE (SELECT count(*) - count({column}) FROM {table}) = 0 AND ({x} IS NOT NULL OR (SELECT count(*) FROM {table}) = 0)"""


def _needs(sql: str) -> list[str]:
    return [n for n in INPUTS if re.search(rf"\b{n}\b", sql)]


def _ordered(sql: str) -> list[str]:
    """Derived inputs the text uses, each after the ones it depends on."""
    done: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in _needs(text):
            if name != own and name not in done:
                visit(INPUTS[name], name)
                done.append(name)

    visit(sql)
    return done


def oracle(sql: str) -> str:
    """Prefix a query with the derived inputs it uses."""
    body = sql.strip()
    parts = [f"{n} AS (\n{INPUTS[n]}\n)" for n in _ordered(body)]
    if not parts:
        return body
    if re.match(r"with\s+recursive\b", body, re.I):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + re.sub(r"^with\s+recursive\s+", "", body, flags=re.I)
    if re.match(r"with\b", body, re.I):
        return "WITH " + ",\n".join(parts) + ",\n" + re.sub(r"^with\s+", "", body, flags=re.I)
    return "WITH " + ",\n".join(parts) + "\n" + body


class Inputs:
    """Given tables and derived inputs of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            cores = self.spark.sparkContext.defaultParallelism
            if name in LONG_TEXTS and len(df.inputFiles()) < cores:
                # fewer files than cores: spread the texts before tokenising them
                df = df.repartition(cores, LONG_TEXTS[name])
            return df
        if name in STORED:
            key = (self.spark.sparkContext.applicationId, self.folder, name)
            if key not in _written:
                _written[key] = store(self._derived(name), name)
            return _written[key]
        if name in INPUTS:
            return self._derived(name)
        raise AttributeError(name)

    def _derived(self, name: str) -> DataFrame:
        """The rows of an input, from the given tables and from stored inputs, which are read and not derived again."""
        parts: dict[str, str] = {}
        stored: list[str] = []

        def visit(text: str) -> None:
            for n in INPUTS:
                if n == name or n in parts or n in stored or not re.search(rf"\b(from|join)\s+{n}\b", text, re.I):
                    continue
                if n in STORED:
                    stored.append(n)
                else:
                    body = SPARK_INPUTS.get(n, INPUTS[n])
                    visit(body)
                    parts[n] = body

        body = SPARK_INPUTS.get(name, INPUTS[name])
        visit(body)
        full = "\n".join([*([f"WITH {', '.join(f'{n} AS ({t})' for n, t in parts.items())}"] if parts else []), body])
        used = {t: getattr(self, t) for t in [*TABLES, *stored] if t in stored or re.search(rf"\b{t}\b", full)}
        for name, df in used.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(full)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``, with its oracle if it has one."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
