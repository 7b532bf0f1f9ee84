"""Registered queries: sources and sinks. Each writes tables derived from the input to a new folder beside the checkpoints
and returns what is read back; damaged rows are written on purpose and counted."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from placerank.models import hybrid
from placerank.models.common import materialize
from placerank.operators import score
from placerank.plans.catalog_scoring import M3_SQL, MODEL, MU, SCORE_SQL, fixture_model, train_test
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.session import ensure_checkpoint_dir
from placerank.sources import fixtures as fx
from placerank.sources import io
from placerank.sources.fixture_sql import ctes


def folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


B_COLS = ["business_id", "name", "city", "state", "stars", "categories"]
B_SCHEMA = "business_id long, name string, city string, state string, stars double, categories string"
B_SQL = ctes("business") + f"SELECT {', '.join(B_COLS)}, {{damaged}} AS damaged FROM business"


def _business(spark, d):
    return fx.business(spark, d).select(*B_COLS)


@query("s1_jsonl_scan", ctes("business") + """SELECT CASE WHEN business_id % 50 = 0 THEN NULL ELSE business_id END AS business_id,
    CASE WHEN business_id % 50 = 0 THEN NULL ELSE name END AS name, business_id % 50 = 0 AS damaged FROM business""")
def s1_jsonl_scan(spark, d):
    """Every 50th line is cut in its first key."""
    line = F.to_json(F.struct(*B_COLS))
    path = folder(spark, "jsonl")
    _business(spark, d).select(F.when(F.col("business_id") % 50 == 0, F.left(line, F.lit(8))).otherwise(line).alias("value")).write.text(path)
    return io.read_jsonl(spark, path, B_SCHEMA, corrupt=True).select("business_id", "name", F.col(io.CORRUPT).isNotNull().alias("damaged"))


@query("s2_wrapped_json_scan", ctes("business") + """SELECT business_id, name, stars, false AS damaged FROM business
    UNION ALL SELECT NULL, NULL, NULL, true""")
def s2_wrapped_json_scan(spark, d):
    """Files of 500 ids, every other one a bare list, and one file that is neither."""
    path, part = folder(spark, "wrapped"), F.floor(F.col("business_id") / 500)
    b = _business(spark, d)
    io.write_wrapped_json(b.filter(part % 2 == 0), f"{path}/wrapped", part)
    io.write_wrapped_json(b.filter(part % 2 == 1), f"{path}/bare", part, wrapper=None)
    spark.createDataFrame([('{"restaurants": [{"business_id": 1',)], "value string").coalesce(1).write.text(f"{path}/broken")
    files = [f"{path}/wrapped/*", f"{path}/bare/*", f"{path}/broken"]
    return io.read_wrapped_json(spark, files, B_SCHEMA, corrupt=True).select(
        "business_id", "name", "stars", F.col(io.CORRUPT).isNotNull().alias("damaged"))


@query("s3_csv_scan", """SELECT doc_id AS review_id, md5(coalesce(text, '')) AS text_md5, false AS damaged FROM documents
    UNION ALL SELECT NULL, md5('x' || doc_id), true FROM documents WHERE doc_id % 100 = 0""")
def s3_csv_scan(spark, d):
    """Whole texts with their quotes and line ends; a line whose id is no number for every 100th."""
    path = folder(spark, "csv")
    texts = fx.review_texts(spark, d)
    io.write_csv(texts.select("review_id", F.coalesce("text", F.lit("")).alias("text")), f"{path}/good", quoted=True)
    io.write_csv(texts.filter(F.col("review_id") % 100 == 0).select(
        F.lit("no number").alias("review_id"), F.concat(F.lit("x"), "review_id").alias("text")), f"{path}/bad", quoted=True)
    rows = io.read_csv(spark, [f"{path}/good", f"{path}/bad"], "review_id long, text string", corrupt=True)
    return rows.select("review_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.col(io.CORRUPT).isNotNull().alias("damaged"))


IDS = """ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM reviews)"""


def _id_lines(spark, d):
    """Ids with blanks around them, repeated, between empty lines and headers."""
    path, u = folder(spark, "ids"), F.col("user_id").cast("string")
    line = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" \t"), u, F.lit("  "))).otherwise(u)
    rows = fx.reviews(spark, d).select(F.explode(F.array(line, F.lit(""), F.lit("user_id"))).alias("value"))
    rows.write.text(path)
    return path


@query("s4_id_list", ctes("reviews", extra=IDS) + "SELECT user_id FROM ids")
def s4_id_list(spark, d):
    return io.read_id_list(spark, _id_lines(spark, d))


@query("s4_id_list_capped", ctes("reviews", extra=IDS) + "SELECT user_id FROM ids ORDER BY user_id LIMIT 2466")
def s4_id_list_capped(spark, d):
    """The reference's cap of 2,466 ids, which are the smallest."""
    return io.read_id_list(spark, _id_lines(spark, d), cap=2466)


@query("s6_load_subset", ctes("business") + "SELECT business_id, city, stars FROM business")
def s6_load_subset(spark, d):
    """Wanted columns that exist, twice: the second load replaces the first."""
    path, b = folder(spark, "subset"), fx.business(spark, d)
    io.load_subset(b, ["business_id", "name"], path)
    return io.load_subset(b, ["business_id", "city", "no_such_column", "stars"], path)


@query("s7_csv_sink", sql_round(ctes("business") + f"SELECT {', '.join(B_COLS)} FROM business", ["stars"]))
def s7_csv_sink(spark, d):
    path = folder(spark, "csv")
    io.write_csv(_business(spark, d), path)
    return round_doubles(io.read_csv(spark, path, B_SCHEMA))


@query("s8_save_results", ctes("business") + " UNION ALL ".join(
    f"SELECT '{fmt}' AS format, business_id, stars FROM business, (SELECT unnest(generate_series(1, {times})) AS t)"
    for fmt, times in (("parquet", 1), ("csv", 1), ("json", 2))))
def s8_save_results(spark, d):
    """Each format is saved twice: Parquet and CSV replace, JSON appends as the reference does."""
    path, b = folder(spark, "results"), _business(spark, d).select("business_id", "stars")
    out = None
    for fmt in ("parquet", "csv", "json"):
        for _ in range(2):
            io.save_results(b, f"{path}/{fmt}", fmt)
        reader = spark.read.schema("business_id long, stars double").option("header", True)
        rows = reader.format(fmt).load(f"{path}/{fmt}").select(F.lit(fmt).alias("format"), "business_id", "stars")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s8_repeated_batches", ctes("reviews") + "SELECT review_id, user_id, stars, CAST(year(date) AS INTEGER) AS batch FROM reviews")
def s8_repeated_batches(spark, d):
    """A batch a year, each written twice: the repeated one replaces itself, so the result is the union once."""
    path = folder(spark, "batches")
    r = fx.reviews(spark, d).select("review_id", "user_id", "stars", F.year("date").alias("year"))
    r = materialize(r)   # read for the years and for every batch
    years = sorted(x["year"] for x in r.select("year").distinct().collect())   # a handful of batch ids
    for year in years + years:
        io.append_batch(r.filter(F.col("year") == year).drop("year"), path, year)
    return io.read_batches(spark, path, "review_id string, user_id long, stars int, batch int")


@query("s9_jsonl_sink", ctes("users") + "SELECT user_id, name, elite, average_stars FROM users")
def s9_jsonl_sink(spark, d):
    path = folder(spark, "users")
    io.write_jsonl(fx.users(spark, d).select("user_id", "name", "elite", "average_stars"), path)
    return io.read_jsonl(spark, path, "user_id long, name string, elite string, average_stars double")


@query("s10_bundle", sql_round(ctes("reviews", extra=MODEL) + f"""SELECT s.user_id, s.business_id,
    CASE WHEN u.user_id IS NOT NULL AND i.business_id IS NOT NULL THEN {SCORE_SQL} END AS predicted_rating, 2 AS version
    FROM split s LEFT JOIN uf u ON s.user_id = u.user_id LEFT JOIN itf i ON s.business_id = i.business_id
    WHERE s.split = 'test'""", ["predicted_rating"]))
def s10_bundle(spark, d):
    """A bundle of the model with its data, a first version with other biases; the newest version is loaded."""
    tt = materialize(train_test(spark, d))   # each table of both versions is made of it
    path, m = folder(spark, "bundle"), fixture_model(spark, d, tt)
    tables = {"users": m.users, "items": m.items, "test": tt.filter(F.col("split") == "test")}
    io.save_bundle(path, tables | {"users": m.users.withColumn("bias", F.lit(9.0))}, {"mu": m.mu})
    io.save_bundle(path, tables, {"mu": m.mu})
    manifest, t = io.load_bundle(spark, path)
    pairs = t["test"].select("user_id", "business_id")
    out = score.score_pairs(score.FactorModel(manifest["mu"], t["users"], t["items"]), pairs)
    return round_doubles(out.withColumn("version", F.lit(manifest["version"])))


@query("s10_model_of_a_bundle", sql_round(ctes("reviews", extra=MODEL) + M3_SQL, ["predicted_rating"]))
def s10_model_of_a_bundle(spark, d):
    """A hybrid model saved with its test rows and loaded alone."""
    path, m = folder(spark, "bundle"), fixture_model(spark, d)
    empty = F.array().cast("array<double>")
    users = m.users.select("user_id", F.col("bias").alias("bu"), F.col("uvec").alias("p"), empty.alias("x"))
    items = m.items.select("business_id", F.col("bias").alias("bi"), F.col("ivec").alias("q"), empty.alias("y"))
    test = train_test(spark, d).filter(F.col("split") == "test")
    hybrid.save_model(hybrid.HybridModel(hybrid.HybridParams(n_factors=4), MU, users, items, None, None), path, {"test": test})
    model, rest = hybrid.load_model(spark, path, model_only=True)
    assert not rest
    return round_doubles(score.predict_test(model.factor_model(), test))
