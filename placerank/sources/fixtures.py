"""Stand-in review-site tables derived from the driver's TPC-H-like parquet.

The reference reads business / user / review / tip / check-in JSONL files that
are not shipped; these views derive the same shapes from the given tables so
every job's work grows with the input.  The rules are listed in FIXTURES.md and
mirrored, for the SQL oracle, in ``fixture_sql``.

nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions, so they
are broadcast; every other join is left to the optimizer (AQE turns a
sort-merge join into a broadcast only when the runtime size is below
``spark.sql.autoBroadcastJoinThreshold``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.sources.reference_values import CATEGORY_GROUPS, BLOCKED_CATEGORIES

# Names of the extra user count columns the user feature table carries.
COMPLIMENT_COLUMNS = [
    "compliment_hot", "compliment_more", "compliment_profile", "compliment_cute", "compliment_list",
    "compliment_note", "compliment_plain", "compliment_cool", "compliment_funny", "compliment_writer",
    "compliment_photos",
]
# modulus per compliment column: value = user_id % modulus
COMPLIMENT_MODULI = [7, 3, 4, 5, 6, 8, 9, 11, 13, 10, 12]


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` (one DataFrame object per session and path, so repeated
    reads share one file listing and Spark can reuse the scan inside a plan)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return F.broadcast(
        n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    )


def _categories(p_type: Column, key: Column) -> Column:
    tail = (
        F.when(p_type == "PROMO", F.lit("Chinese, Tea Rooms"))
        .when(p_type == "ECONOMY", F.lit("Mexican"))
        .when(p_type == "MEDIUM", F.lit("Italian, Seafood"))
        .when(p_type == "SMALL", F.lit("Coffee & Tea, Desserts"))
        .when(p_type == "LARGE", F.lit("Steakhouses, Wine Bars"))
        .otherwise(F.lit("Automotive"))
    )
    return (
        F.when(key % 13 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, tail)
        .otherwise(F.concat(F.lit("Restaurants, "), tail))
    )


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id, name, city, state, latitude, longitude, stars, review_count,
    is_open, categories, price_raw, attributes MAP<STRING,STRING>."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    m25 = k % 25
    size5 = F.col("p_size") % 5
    price_raw = (
        F.when(size5 == 0, F.lit(None).cast("string"))
        .when(size5 == 4, F.lit("None"))
        .otherwise(size5.cast("string"))
    )
    dogs = F.when(F.col("p_size") % 3 == 0, F.lit("True")).when(F.col("p_size") % 3 == 1, F.lit("False"))
    open24 = F.when(k % 7 == 0, F.lit("True")).otherwise(F.lit("False"))
    parking = (
        F.when(F.col("p_size") % 4 == 0, F.lit("{'garage': False, 'street': True}"))
        .when(F.col("p_size") % 4 == 1, F.lit("{'garage': False, 'street': False}"))
        .when(F.col("p_size") % 4 == 2, F.lit("u'free'"))
    )
    music = F.when(k % 6 == 0, F.lit("{'dj': False, 'live': True}")).when(k % 6 == 1, F.lit("None"))
    seating = F.when(k % 4 == 0, F.lit("True")).when(k % 4 == 1, F.lit("False")).when(k % 4 == 2, F.lit("None"))
    ambience = F.when(k % 9 == 0, F.lit("{'casual': True}")).when(k % 9 < 4, F.lit("{'casual': False}"))
    attrs = F.create_map(
        F.lit("Music"), music,
        F.lit("OutdoorSeating"), seating,
        F.lit("Ambience"), ambience,
        F.lit("BusinessParking"), parking,
        F.lit("DogsAllowed"), dogs,
        F.lit("Open24Hours"), open24,
        F.lit("RestaurantsPriceRange2"), price_raw,
    )
    return (
        p.join(_geo(spark, sf_dir), m25 == F.col("n_nationkey"))
        .select(
            k.alias("business_id"),
            F.col("p_name").alias("name"),
            "city",
            "state",
            (F.lit(25) + m25).cast("double").alias("latitude"),
            (F.lit(-120) + F.lit(2) * m25).cast("double").alias("longitude"),
            (F.lit(1) + k % 5).cast("double").alias("stars"),
            (F.col("p_size") * 7).cast("int").alias("review_count"),
            (k % 2).cast("int").alias("is_open"),
            _categories(F.col("p_type"), k).alias("categories"),
            price_raw.alias("price_raw"),
            attrs.alias("attributes"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, name, city, elite, friends, fans, review_count, useful, funny,
    cool, average_stars, yelping_since and 11 compliment_* counts."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    elite = F.when(k % 5 == 0, F.lit("2010,2011")).when(k % 5 == 1, F.lit("2015")).otherwise(F.lit(""))
    friends = F.when(k % 4 == 0, F.lit("None")).otherwise(
        F.concat_ws(",", (k + 1).cast("string"), (k + 2).cast("string")))
    since = F.when(k % 53 == 0, F.lit("n/a")).otherwise(
        F.date_format(F.date_add(F.lit("2004-10-01").cast("date"), ((k * 7) % 5000).cast("int")), "yyyy-MM-dd"))
    cols = [
        k.alias("user_id"),
        F.col("c_name").alias("name"),
        "city",
        elite.alias("elite"),
        friends.alias("friends"),
        (k % 17).alias("fans"),
        (k % 50 + 1).alias("review_count"),
        (k % 23).alias("useful"),
        (k % 19).alias("funny"),
        (k % 29).alias("cool"),
        (F.lit(1.0) + (k % 41) / F.lit(10.0)).alias("average_stars"),
        since.alias("yelping_since"),
    ] + [(k % m).alias(name) for name, m in zip(COMPLIMENT_COLUMNS, COMPLIMENT_MODULI)]
    n = _geo(spark, sf_dir).select("n_nationkey", "city")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(*cols)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, user_id, business_id, stars, date (one review per line item)."""
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    qty = F.col("l_quantity").cast("int")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    qty.cast("string")).alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("business_id"),
        (F.lit(1) + qty % 5).alias("stars"),
        F.col("o_orderdate").alias("date"),
    )


def _event_business(spark: SparkSession, sf_dir: str) -> Column:
    """Events over the part table's whole key range."""
    keys = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).scalar()
    return (F.col("event_id") % keys).alias("business_id")


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tip per click event: business_id, user_id, date."""
    e = table(spark, sf_dir, "events")
    return e.filter(F.col("event_type") == "click").select(
        _event_business(spark, sf_dir), "user_id", F.col("ts").alias("date"))


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check-in rows: business_id, date = ','-joined timestamps (one or two per view event)."""
    e = table(spark, sf_dir, "events")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ts2 = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss")
    return e.filter(F.col("event_type") == "view").select(
        _event_business(spark, sf_dir),
        F.when(F.col("event_id") % 3 == 0, F.concat_ws(",", ts, ts2)).otherwise(ts).alias("date"),
    )


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review text stand-in: documents as (review_id, business_id, text)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), F.col("source").alias("business_id"), "text")


def category_groups(spark: SparkSession) -> DataFrame:
    """(group, category) table of the default groups."""
    rows = [(g, c) for g, cats in CATEGORY_GROUPS.items() for c in cats]
    return spark.createDataFrame(rows, "group string, category string")


def blocked_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in BLOCKED_CATEGORIES], "category string")
