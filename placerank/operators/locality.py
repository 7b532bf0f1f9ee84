"""Where reviewers are at home, and which reviews are local.

Scale notes: every per-user statistic starts from a ``(user, city)`` partial
aggregate, so a reviewer with a huge share of all reviews still becomes a
handful of rows before the shuffle by user.  Mode/argmax uses ``min_by`` (a
partially aggregated built-in) rather than a window over raw rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.functions.expr import haversine_miles, null_safe_eq, strip_ws


def _mode(df: DataFrame, key: str, value: str, out: str, count_col: str = "n") -> DataFrame:
    """Most frequent ``value`` per ``key`` from a pre-counted (key, value, n) table.

    Ties go to the smallest value; a null value loses every tie.
    """
    order = F.struct(-F.col(count_col), F.col(value).isNull(), F.col(value))
    return df.groupBy(key).agg(F.min_by(F.col(value), order).alias(out))


def home_city(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """W1 - per user, the city of the businesses they review most (null city is a candidate).

    reviews(user_id, business_id), business(business_id, city) -> (user_id, home_city)
    """
    counts = (reviews.select("user_id", "business_id")
              .join(business.select("business_id", "city"), "business_id", "left")
              .groupBy("user_id", "city").agg(F.count(F.lit(1)).alias("n")))
    return _mode(counts, "user_id", "city", "home_city")


def reviews_with_home(reviews: DataFrame, business: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """J6 - reviews left-joined with the business geo columns and the reviewer's home city."""
    home = home if home is not None else home_city(reviews, business)
    geo = business.select("business_id", "name", F.col("latitude").alias("lat"),
                          F.col("longitude").alias("lon"), "city")
    return reviews.join(geo, "business_id", "left").join(home, "user_id", "left")


def base_city(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """A1 - most frequent city over reviews whose business is known; none -> no row.

    -> (user_id, base_city).  Ties: smallest city.
    """
    counts = (reviews.select("user_id", "business_id")
              .join(business.select("business_id", "city").filter(F.col("city").isNotNull()), "business_id")
              .groupBy("user_id", "city").agg(F.count(F.lit(1)).alias("n")))
    return _mode(counts, "user_id", "city", "base_city")


def users_with_base_city(users: DataFrame, reviews: DataFrame, business: DataFrame) -> DataFrame:
    """A1 applied to the user table: adds ``base_city`` (null when no known business)."""
    return users.join(base_city(reviews, business), "user_id", "left")


def classify_reviews(reviews: DataFrame, business: DataFrame, bases: DataFrame) -> DataFrame:
    """P12 / A2 - adds ``location_classification``: 'local' when the business city equals the
    reviewer's base city (both null counts as equal), 'tourist' otherwise, null when the
    business is unknown."""
    b = business.select("business_id", F.col("city").alias("_bcity"), F.lit(True).alias("_known"))
    return (reviews.join(b, "business_id", "left").join(bases, "user_id", "left")
            .withColumn("location_classification",
                        F.when(F.col("_known").isNull(), F.lit(None).cast("string"))
                        .when(F.col("_bcity").eqNullSafe(F.col("base_city")), F.lit("local"))
                        .otherwise(F.lit("tourist")))
            .drop("_bcity", "_known", "base_city"))


def city_state(business: DataFrame) -> DataFrame:
    """A3 - most frequent state per normalised city name (lower, stripped); empty states skipped.

    business(city, state) -> (city_key, state)
    """
    rows = (business.select(F.lower(strip_ws("city")).alias("city_key"), strip_ws("state").alias("state"))
            .filter((F.col("city_key") != "") & (F.col("state") != ""))
            .groupBy("city_key", "state").agg(F.count(F.lit(1)).alias("n")))
    return _mode(rows, "city_key", "state", "state")


def attach_state(users: DataFrame, states: DataFrame, city_col: str = "base_city",
                 overwrite: bool = False) -> DataFrame:
    """J14 - ``inferred_state`` from the city->state table; also fills ``state_code`` when it
    is missing or empty (or always, with ``overwrite``)."""
    s = states.select(F.col("city_key").alias("_ck"), F.col("state").alias("inferred_state"))
    out = users.join(s, F.lower(strip_ws(F.col(city_col))) == F.col("_ck"), "left").drop("_ck")
    if "state_code" in users.columns:
        fill = F.lit(True) if overwrite else (F.col("state_code").isNull() | (F.col("state_code") == ""))
        out = out.withColumn("state_code", F.when(fill & F.col("inferred_state").isNotNull(),
                                                  F.col("inferred_state")).otherwise(F.col("state_code")))
    else:
        out = out.withColumn("state_code", F.col("inferred_state"))
    return out


def reviews_with_locality(reviews: DataFrame, business: DataFrame, users_city: DataFrame,
                          user_city_col: str = "base_city") -> DataFrame:
    """A7 side columns: ``business_city``, ``user_city`` and ``is_local`` (null on either
    side is not local)."""
    b = business.select("business_id", F.col("city").alias("business_city"))
    u = users_city.select("user_id", F.col(user_city_col).alias("user_city"))
    return (reviews.join(b, "business_id", "left").join(u, "user_id", "left")
            .withColumn("is_local", null_safe_eq("business_city", "user_city")))


def user_review_stats(reviews: DataFrame) -> DataFrame:
    """A23 - per user: review count, mean stars, first and last review date."""
    return reviews.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("num_reviews"), F.avg("stars").alias("avg_stars"),
        F.max("date").alias("latest_review_date"), F.min("date").alias("first_review_date"))


def user_geography(rwh: DataFrame, exact: bool = False) -> DataFrame:
    """A24 - per user geography from J6 rows: distinct cities (approximate unless ``exact``),
    located reviews, bounding box, and share of reviews in the home city."""
    cities = F.count_distinct("city") if exact else F.approx_count_distinct("city")
    return rwh.groupBy("user_id").agg(
        cities.alias("unique_cities"),
        F.count(F.when(F.col("lat").isNotNull(), 1)).alias("reviews_with_location"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.avg(F.when(F.col("city") == F.col("home_city"), 1.0).otherwise(0.0)).alias("home_city_review_ratio"))


def temporal_features(reviews: DataFrame) -> DataFrame:
    """A26 - mean day of week (1 = Sunday) and sample std of the month per user."""
    return reviews.groupBy("user_id").agg(
        F.avg(F.dayofweek("date")).alias("avg_review_dayofweek"),
        F.stddev_samp(F.month("date")).alias("seasonal_variation"))


def city_sketches(reviews: DataFrame, business: DataFrame, bits: int = 12) -> DataFrame:
    """A24 - (user_id, month, cities): a mergeable sketch of the cities a user reviewed in a month, to be kept and merged
    over any span of months (``merged_cities``) without the reviews. 2^bits registers; the relative standard error is
    about 1.04 / sqrt(2^bits)."""
    r = reviews.join(business.select("business_id", "city"), "business_id", "left")
    return r.groupBy("user_id", F.date_trunc("month", "date").alias("month")).agg(F.hll_sketch_agg("city", bits).alias("cities"))


def merged_cities(sketches: DataFrame) -> DataFrame:
    """A24 - (user_id, unique_cities): approximate distinct cities over the months given."""
    return sketches.groupBy("user_id").agg(F.hll_sketch_estimate(F.hll_union_agg("cities")).alias("unique_cities"))


def user_activity_features(reviews: DataFrame, business: DataFrame, users: DataFrame) -> DataFrame:
    """J7 + P13 + P14 - the per-user local/tourist feature table.

    The reviews are read and joined to the businesses once and summed by user and city; all statistics of a user
    (A23, A24 with exact cities, A26, and the home city's share, W1) come from those sums. Numeric nulls become 0; then
    reviews per year, bounding-box radius (built-in haversine, no UDF), compliments and the elite indicator are derived.
    """
    from placerank.functions.expr import elite_years

    geo = business.select("business_id", "city", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    month = F.month("date")
    by_city = reviews.select("user_id", "business_id", "date", "stars").join(geo, "business_id", "left").groupBy("user_id", "city").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"), F.max("date").alias("last"), F.min("date").alias("first"),
        F.count("lat").alias("located"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"),
        F.max("lon").alias("lon1"), F.sum(F.dayofweek("date")).alias("dow"), F.sum(month).alias("m"), F.sum(month * month).alias("mm"))
    home = F.struct(-F.col("n"), F.col("city").isNull(), F.col("city"))   # as in home_city
    st = by_city.groupBy("user_id").agg(
        *[F.sum(c).alias(f"_{c}") for c in ("n", "stars", "dow", "m", "mm")],
        F.max("last").alias("latest_review_date"), F.min("first").alias("first_review_date"),
        F.count("city").alias("unique_cities"), F.sum("located").alias("reviews_with_location"), F.min("lat0").alias("min_lat"),
        F.max("lat1").alias("max_lat"), F.min("lon0").alias("min_lon"), F.max("lon1").alias("max_lon"),
        F.min_by(F.when(F.col("city").isNotNull(), F.col("n")).otherwise(0), home).alias("_home"))
    n = F.col("_n").cast("double")
    stats = st.select(
        "user_id", F.col("_n").alias("num_reviews"), (F.col("_stars") / n).alias("avg_stars"), "latest_review_date", "first_review_date",
        "unique_cities", "reviews_with_location", "min_lat", "max_lat", "min_lon", "max_lon", (F.col("_home") / n).alias("home_city_review_ratio"),
        (F.col("_dow") / n).alias("avg_review_dayofweek"),
        F.when(n > 1, F.sqrt(F.greatest(F.col("_mm") - F.col("_m") * F.col("_m") / n, F.lit(0.0)) / (n - 1))).alias("seasonal_variation"))
    social = users.select(
        "user_id",
        F.when(F.col("friends").isNull() | (F.col("friends") == "None") | (F.col("friends") == ""), 0)
        .otherwise(F.size(F.split("friends", ","))).alias("num_friends"),
        elite_years("elite").alias("elite_years"),
        "compliment_hot", "compliment_cool", "compliment_funny", F.col("fans").alias("num_fans"))
    feats = stats.join(social, "user_id", "left")
    numeric = [f.name for f in feats.schema.fields
               if f.dataType.typeName() in ("double", "long", "integer", "float")]
    feats = feats.fillna(0, subset=numeric)
    return (feats
            .withColumn("reviews_per_year", F.col("num_reviews") / (
                F.datediff("latest_review_date", "first_review_date") / F.lit(365.25) + F.lit(0.5)))
            .withColumn("geographic_radius", F.coalesce(
                haversine_miles("min_lat", "min_lon", "max_lat", "max_lon"), F.lit(0.0)))
            .withColumn("total_compliments", F.col("compliment_hot") + F.col("compliment_cool")
                        + F.col("compliment_funny"))
            .withColumn("compliment_ratio", F.col("total_compliments") / (F.col("num_reviews") + 1))
            .withColumn("elite_indicator", F.when(F.col("elite_years") > 0, 1).otherwise(0)))
