"""Small helpers shared by the corpus operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.session import discard, ensure_checkpoint_dir, tidy  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, its lineage ends
    here, and a lost executor costs no recomputation of what came before."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def whole_text(col: str | Column = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays (``lower`` maps some of them into ASCII)."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


# a character of a word: any but ASCII controls, blanks and punctuation
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
