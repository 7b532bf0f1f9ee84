"""Scans and sinks.

Readers take explicit schemas (no inference on the hot path); writers keep
output parallel (no ``coalesce(1)``).
"""
from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from placerank.functions.expr import strip_ws

# Reference inputs (FIXTURES.md section 1): the columns the jobs read.
BUSINESS_SCHEMA = ("business_id string, name string, address string, city string, state string, "
                   "postal_code string, latitude double, longitude double, stars double, review_count int, "
                   "is_open int, attributes map<string,string>, categories string")
REVIEW_SCHEMA = ("review_id string, user_id string, business_id string, stars int, useful int, funny int, "
                 "cool int, text string, date string")
TIP_SCHEMA = "business_id string, user_id string, text string, date string"
CHECKIN_SCHEMA = "business_id string, date string"


CORRUPT = "_corrupt_record"


def _with_corrupt(schema: str | StructType) -> StructType:
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return StructType(fields.fields + [StructField(CORRUPT, StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, corrupt: bool = False) -> DataFrame:
    """S1 - one JSON object per line; ``corrupt`` adds ``_corrupt_record`` with the text of a line that does not fit the
    schema (null for good ones; what could be read of the line is kept)."""
    return spark.read.schema(_with_corrupt(schema) if corrupt else schema).json(path)


def read_wrapped_json(spark: SparkSession, path: str | list[str], schema: str | StructType,
                      wrapper: str = "restaurants", corrupt: bool = False) -> DataFrame:
    """S2 - files holding ``{"<wrapper>": [...]}`` or a bare ``[...]`` list of objects; ``corrupt`` adds a row with the
    file's text in ``_corrupt_record`` for a file that is neither.

    Whole-file JSON cannot be split, so this is for the small wrapped exports only; large
    inputs should be JSON lines (``read_jsonl``).
    """
    item = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.text(path, wholetext=True)
    arr = F.from_json("value", f"array<{item.simpleString()}>")
    obj = F.from_json("value", f"struct<{wrapper}: array<{item.simpleString()}>>")
    raw = raw.select("value", F.when(F.ltrim("value").startswith("["), arr).otherwise(obj[wrapper]).alias("items"))
    if not corrupt:
        return raw.select(F.explode("items").alias("r")).select("r.*")
    rows = raw.select(F.when(F.col("items").isNull(), F.col("value")).alias(CORRUPT), F.explode_outer("items").alias("r"))
    return rows.filter(F.col(CORRUPT).isNotNull() | F.col("r").isNotNull()).select("r.*", CORRUPT)


def write_wrapped_json(df: DataFrame, path: str, key: Column, wrapper: str | None = "restaurants") -> None:
    """S2 - one file per value of ``key`` with that value's rows as ``{"<wrapper>": [...]}`` or, without a wrapper, as a
    bare list. A file is written whole by one task, so ``key`` should hold few rows a value."""
    rows = df.select(key.alias("_file"), F.to_json(F.struct(*df.columns)).alias("_r")).groupBy("_file").agg(
        F.array_join(F.array_sort(F.collect_list("_r")), ",").alias("_r"))
    head, tail = (f'{{"{wrapper}": [', "]}") if wrapper else ("[", "]")
    rows.select("_file", F.concat(F.lit(head), "_r", F.lit(tail)).alias("value")).write.mode("overwrite").partitionBy("_file").text(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType, corrupt: bool = False) -> DataFrame:
    """S3 - header CSV whose text fields may hold quoted newlines; ``corrupt`` as in ``read_jsonl``."""
    return (spark.read.schema(_with_corrupt(schema) if corrupt else schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def read_id_list(spark: SparkSession, path: str, header: str = "user_id", cap: int | None = None) -> DataFrame:
    """S4 - one id per line: stripped, blanks and the header line dropped, distinct.

    ``cap`` keeps the smallest ``cap`` ids (a deterministic version of the reference's cap).
    """
    ids = (spark.read.text(path).select(strip_ws("value").alias(header))
           .filter((F.col(header) != "") & (F.col(header) != header)).distinct())
    return ids.orderBy(header).limit(cap) if cap is not None else ids


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """S5 - (table, n_rows) for a set of loaded tables (one aggregate per table, unioned)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """P7 / S6 - keep the wanted columns that exist (by name, never by position)."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def load_subset(df: DataFrame, wanted: list[str], path: str) -> DataFrame:
    """S6 - column subset written as a parquet table in replace mode; returns the table."""
    select_available(df, wanted).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", quoted: bool = False) -> None:
    """S7 - header CSV, written in parallel, quotes doubled as ``read_csv`` expects; ``quoted`` puts all fields in quotes."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", quoted).csv(path)


def save_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S8 - parquet / csv overwrite; json appends (as the reference does); else an error."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        write_csv(df, path)
    elif fmt == "json":
        df.write.mode("append").json(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def append_batch(df: DataFrame, path: str, batch: str | int, fmt: str = "json") -> None:
    """S8 / U1 - append a batch so that it can be repeated: its rows are stored under their batch id, and writing the
    same id again replaces just that batch (dynamic partition overwrite)."""
    (df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").format(fmt).save(path))


def read_batches(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json") -> DataFrame:
    """All batches of ``append_batch``, concatenated."""
    return spark.read.schema(schema).format(fmt).load(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """S9 - JSON lines."""
    df.write.mode("overwrite").json(path)


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    rows = spark.read.schema("version int, manifest string").json(f"{path}/manifests").collect()   # one a version
    return sorted(({"version": r["version"], **json.loads(r["manifest"])} for r in rows), key=lambda m: m["version"])


def save_bundle(path: str, tables: dict[str, DataFrame], manifest: dict) -> int:
    """S10 - a new version of a model bundle: one parquet table per entry under the version's own folder, then a manifest
    with the tables' schemas. The version exists from the moment its manifest's file is committed; until then, and after
    a failed write, readers see the version before it. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    try:
        version = _manifests(spark, path)[-1]["version"] + 1
    except AnalysisException:   # no manifest folder yet
        version = 1
    folder = f"version-{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    text = json.dumps({**manifest, "folder": folder, "tables": {n: json.loads(df.schema.json()) for n, df in tables.items()}})
    spark.createDataFrame([(version, text)], "version int, manifest string").coalesce(1).write.mode("append").json(f"{path}/manifests")
    return version


def load_bundle(spark: SparkSession, path: str, names: list[str] | None = None,
                version: int | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """S10 - (manifest, tables) of the newest version or a given one; ``names`` loads just these tables (the model without
    its data), and a bundle that holds only the model loads the same way."""
    found = [m for m in _manifests(spark, path) if version is None or m["version"] == version]
    if not found:
        raise ValueError(f"no version {version} in {path}")
    m = found[-1]
    wanted = [n for n in m["tables"] if names is None or n in names]
    return m, {n: spark.read.schema(StructType.fromJson(m["tables"][n])).parquet(f"{path}/{m['folder']}/{n}") for n in wanted}
