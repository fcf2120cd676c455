"""Registry of named queries: a Spark builder and, where SQL can say the same
thing, the DuckDB text that the correctness check runs on the same tables.

Doubles are rounded to 6 places on both sides (and ``-0.0`` folded into
``0.0``) so that summation order cannot change a value hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns for comparison; other columns unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def rounded_sql(sql: str, doubles: Sequence[str], digits: int = 6) -> str:
    """Wrap a DuckDB query so the named double columns are rounded like ``present``."""
    if not doubles:
        return sql
    repl = ", ".join(f"round(\"{c}\", {digits}) + 0.0 AS \"{c}\"" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS q"


def register(name: str, sql: str | None = None, doubles: Sequence[str] = (),
             raw_sql: bool = False):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))
        text = None
        if sql is not None:
            text = sql if raw_sql else rounded_sql(sql, doubles)
        REGISTRY[name] = Query(name, build, text, (fn.__doc__ or "").strip())
        return fn
    return wrap
