"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (and its DuckDB oracle, when it has one)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (and arrays of doubles) so both engines compare equal."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.round(c, digits).alias(f.name))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (DoubleType, FloatType)):
            out.append(F.transform(c, lambda x: F.round(x, digits)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def sql_round(sql: str, cols: list[str], digits: int = 6) -> str:
    """Wrap an oracle query so the given double columns are rounded like ``round_doubles``."""
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _r"
