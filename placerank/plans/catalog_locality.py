"""Registered queries: home city, locality, user geography and the hidden-gem score."""
from __future__ import annotations

from pyspark.sql import functions as F

from placerank.operators import gem, locality
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources.fixture_sql import ctes

# ---- shared oracle fragments ----
HOME = """home_counts AS (SELECT r.user_id, b.city, count(*) AS n
        FROM reviews r LEFT JOIN business b ON r.business_id = b.business_id GROUP BY r.user_id, b.city),
    home AS (SELECT user_id, city AS home_city FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, city ASC NULLS LAST) AS rn
        FROM home_counts) WHERE rn = 1),
    rwh AS (SELECT r.user_id, r.business_id, r.stars, r.date, b.city, b.latitude AS lat, b.longitude AS lon,
                   b.name, h.home_city
        FROM reviews r LEFT JOIN business b ON r.business_id = b.business_id
        LEFT JOIN home h ON r.user_id = h.user_id)"""

METRICS = """metrics AS (SELECT business_id, count(*) AS total_reviews, avg(stars) AS avg_rating,
        count(CASE WHEN city = home_city THEN 1 END) AS local_reviews,
        count(CASE WHEN city <> home_city THEN 1 END) AS tourist_reviews,
        any_value(lat) AS lat, any_value(lon) AS lon, any_value(name) AS name
        FROM rwh GROUP BY business_id)"""

GEM_SELECT = """SELECT *,
        local_ratio_ AS local_ratio,
        CASE WHEN avg_rating >= 3.5 THEN (avg_rating - 2.5) / 2.5 ELSE 0.0 END AS sentiment_score,
        exp(-total_reviews / 200.0) AS volume_score,
        pow(local_ratio_, 1.5) AS local_preference_score,
        CAST((CASE WHEN avg_rating >= 3.5 THEN (avg_rating - 2.5) / 2.5 ELSE 0.0 END) * 0.30
             + exp(-total_reviews / 200.0) * 0.25 + pow(local_ratio_, 1.5) * 0.20
             + (CASE WHEN avg_rating >= 3.5 THEN 1.0 ELSE pow(avg_rating / 3.5, 2) END) * 0.25 AS DOUBLE)
            AS hidden_gem_score
    FROM (SELECT *, local_reviews / total_reviews AS local_ratio_ FROM metrics)"""
GEM_COLS = ["avg_rating", "local_ratio", "sentiment_score", "volume_score", "local_preference_score",
            "hidden_gem_score"]

GEM_SQL = sql_round(
    "SELECT * EXCLUDE (local_ratio_) FROM (" + ctes("business", "reviews", extra=HOME + ",\n" + METRICS)
    + GEM_SELECT + ")", GEM_COLS + ["lat", "lon"])


def flagship(spark, d):
    """J6 + W1 + A25 + P15: business metrics with the hidden-gem score."""
    return round_doubles(gem.gem_scores(fx.reviews(spark, d), fx.business(spark, d)))


query("gem_score", GEM_SQL)(flagship)


@query("w1_home_city", ctes("business", "reviews", extra=HOME.split(",\n    rwh AS")[0])
       + "SELECT user_id, home_city FROM home")
def w1_home_city(spark, d):
    return locality.home_city(fx.reviews(spark, d), fx.business(spark, d))


@query("a25_business_metrics", sql_round(ctes("business", "reviews", extra=HOME + ",\n" + METRICS)
                                         + "SELECT * FROM metrics", ["avg_rating", "lat", "lon"]))
def a25_business_metrics(spark, d):
    return round_doubles(gem.business_metrics(fx.reviews(spark, d), fx.business(spark, d)))


@query("j6_reviews_with_home", ctes("business", "reviews", extra=HOME)
       + "SELECT user_id, business_id, stars, date, city, lat, lon, name, home_city FROM rwh")
def j6_reviews_with_home(spark, d):
    r = fx.reviews(spark, d).select("user_id", "business_id", "stars", "date")
    return locality.reviews_with_home(r, fx.business(spark, d))


@query("a23_user_review_stats", sql_round(ctes("reviews") + """SELECT user_id, count(*) AS num_reviews,
        avg(stars) AS avg_stars, max(date) AS latest_review_date, min(date) AS first_review_date
        FROM reviews GROUP BY user_id""", ["avg_stars"]))
def a23_user_review_stats(spark, d):
    return round_doubles(locality.user_review_stats(fx.reviews(spark, d)))


@query("a24_user_geography", sql_round(ctes("business", "reviews", extra=HOME) + """SELECT user_id,
        count(DISTINCT city) AS unique_cities, count(lat) AS reviews_with_location,
        min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
        avg(CASE WHEN city = home_city THEN 1.0 ELSE 0.0 END) AS home_city_review_ratio
        FROM rwh GROUP BY user_id""", ["home_city_review_ratio"]))
def a24_user_geography(spark, d):
    r = fx.reviews(spark, d)
    rwh = locality.reviews_with_home(r, fx.business(spark, d))
    return round_doubles(locality.user_geography(rwh, exact=True))


@query("a24_city_sketches", ctes("business", "reviews") + """SELECT user_id, count(DISTINCT city) AS exact_cities,
        true AS within_bound FROM reviews r LEFT JOIN business b ON r.business_id = b.business_id GROUP BY user_id""")
def a24_city_sketches(spark, d):
    """Monthly sketches merged by user, next to the exact count: at most one city or 5 %, three standard errors, apart."""
    r, b = fx.reviews(spark, d), fx.business(spark, d)
    merged = locality.merged_cities(locality.city_sketches(r, b))
    exact = locality.user_geography(locality.reviews_with_home(r, b), exact=True).select("user_id", F.col("unique_cities").alias("exact_cities"))
    off = F.abs(F.col("unique_cities") - F.col("exact_cities"))
    return merged.join(exact, "user_id").select("user_id", "exact_cities", (off <= F.greatest(F.lit(1.0), F.col("exact_cities") * 0.05)).alias("within_bound"))


@query("a26_temporal_features", sql_round(ctes("reviews") + """SELECT user_id,
        avg(dayofweek(date) + 1) AS avg_review_dayofweek, stddev_samp(month(date)) AS seasonal_variation
        FROM reviews GROUP BY user_id""", ["avg_review_dayofweek", "seasonal_variation"]))
def a26_temporal_features(spark, d):
    return round_doubles(locality.temporal_features(fx.reviews(spark, d)))


BASE = """base_counts AS (SELECT r.user_id, b.city, count(*) AS n
        FROM reviews r JOIN business b ON r.business_id = b.business_id
        WHERE b.city IS NOT NULL GROUP BY r.user_id, b.city),
    bases AS (SELECT user_id, city AS base_city FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, city ASC) AS rn
        FROM base_counts) WHERE rn = 1)"""


@query("a1_base_city", ctes("business", "reviews", "users", extra=BASE)
       + "SELECT u.user_id, u.city, b.base_city FROM users u LEFT JOIN bases b ON u.user_id = b.user_id")
def a1_base_city(spark, d):
    u = fx.users(spark, d).select("user_id", "city")
    return locality.users_with_base_city(u, fx.reviews(spark, d), fx.business(spark, d))


@query("p12_classify_reviews", ctes("business", "reviews", extra=BASE) + """SELECT r.review_id, r.user_id,
        r.business_id, CASE WHEN b.business_id IS NULL THEN NULL
            WHEN b.city IS NOT DISTINCT FROM s.base_city THEN 'local' ELSE 'tourist' END
            AS location_classification
        FROM reviews r LEFT JOIN business b ON r.business_id = b.business_id
        LEFT JOIN bases s ON r.user_id = s.user_id""")
def p12_classify_reviews(spark, d):
    r, b = fx.reviews(spark, d), fx.business(spark, d)
    bases = locality.base_city(r, b)
    return locality.classify_reviews(r.select("review_id", "user_id", "business_id"), b, bases)


CITY_STATE = """cs_counts AS (SELECT lower(trim(city, E' \\t\\n\\r')) AS city_key, trim(state, E' \\t\\n\\r') AS state,
            count(*) AS n FROM business GROUP BY ALL),
    city_state AS (SELECT city_key, state FROM (
        SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY n DESC, state ASC) AS rn
        FROM cs_counts WHERE city_key <> '' AND state <> '') WHERE rn = 1)"""


@query("a3_city_state", ctes("business", extra=CITY_STATE) + "SELECT city_key, state FROM city_state")
def a3_city_state(spark, d):
    return locality.city_state(fx.business(spark, d))


@query("j14_attach_state", ctes("business", "reviews", "users", extra=BASE + ",\n" + CITY_STATE) + """
    SELECT u.user_id, s.base_city, c.state AS inferred_state, c.state AS state_code
    FROM users u LEFT JOIN bases s ON u.user_id = s.user_id
    LEFT JOIN city_state c ON lower(trim(s.base_city, E' \\t\\n\\r')) = c.city_key""")
def j14_attach_state(spark, d):
    r, b = fx.reviews(spark, d), fx.business(spark, d)
    u = locality.users_with_base_city(fx.users(spark, d).select("user_id"), r, b)
    return locality.attach_state(u, locality.city_state(b))


LOCALITY = """loc AS (SELECT r.*, b.city AS business_city, s.base_city AS user_city,
            coalesce(b.city = s.base_city, false) AS is_local
        FROM reviews r LEFT JOIN business b ON r.business_id = b.business_id
        LEFT JOIN bases s ON r.user_id = s.user_id)"""


@query("a7_local_preference_ratio", sql_round(ctes("business", "reviews", extra=BASE + ",\n" + LOCALITY) + """
    SELECT business_id, avg(CASE WHEN is_local THEN 1.0 ELSE 0.0 END) AS local_preference_ratio
    FROM loc GROUP BY business_id""", ["local_preference_ratio"]))
def a7_local_preference_ratio(spark, d):
    from placerank.operators import features_business as fb
    r, b = fx.reviews(spark, d), fx.business(spark, d)
    loc = locality.reviews_with_locality(r, b, locality.base_city(r, b))
    return round_doubles(fb.local_preference_ratio(loc))


ACTIVITY_COLS = ["avg_stars", "min_lat", "max_lat", "min_lon", "max_lon", "home_city_review_ratio",
                 "avg_review_dayofweek", "seasonal_variation", "reviews_per_year", "geographic_radius",
                 "compliment_ratio"]


@query("j7_user_activity_features", sql_round(ctes("business", "reviews", "users", extra=HOME) + """,
    stats AS (SELECT user_id, count(*) AS num_reviews, avg(stars) AS avg_stars,
        max(date) AS latest_review_date, min(date) AS first_review_date FROM reviews GROUP BY user_id),
    ugeo AS (SELECT user_id, count(DISTINCT city) AS unique_cities, count(lat) AS reviews_with_location,
        min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
        avg(CASE WHEN city = home_city THEN 1.0 ELSE 0.0 END) AS home_city_review_ratio
        FROM rwh GROUP BY user_id),
    temporal AS (SELECT user_id, avg(dayofweek(date) + 1) AS avg_review_dayofweek,
        stddev_samp(month(date)) AS seasonal_variation FROM reviews GROUP BY user_id),
    social AS (SELECT user_id,
        CAST(CASE WHEN friends IS NULL OR friends IN ('None', '') THEN 0 ELSE len(string_split(friends, ',')) END
            AS INTEGER) AS num_friends,
        CAST(CASE WHEN length(elite) > 0 THEN len(string_split(elite, ',')) ELSE 0 END AS INTEGER) AS elite_years,
        compliment_hot, compliment_cool, compliment_funny, fans AS num_fans FROM users),
    j AS (SELECT s.user_id, s.num_reviews, s.avg_stars, s.latest_review_date, s.first_review_date,
        coalesce(g.unique_cities, 0) AS unique_cities, coalesce(g.reviews_with_location, 0) AS reviews_with_location,
        coalesce(g.min_lat, 0) AS min_lat, coalesce(g.max_lat, 0) AS max_lat,
        coalesce(g.min_lon, 0) AS min_lon, coalesce(g.max_lon, 0) AS max_lon,
        coalesce(g.home_city_review_ratio, 0) AS home_city_review_ratio,
        coalesce(t.avg_review_dayofweek, 0) AS avg_review_dayofweek,
        coalesce(t.seasonal_variation, 0) AS seasonal_variation,
        coalesce(o.num_friends, 0) AS num_friends, coalesce(o.elite_years, 0) AS elite_years,
        coalesce(o.compliment_hot, 0) AS compliment_hot, coalesce(o.compliment_cool, 0) AS compliment_cool,
        coalesce(o.compliment_funny, 0) AS compliment_funny, coalesce(o.num_fans, 0) AS num_fans
        FROM stats s LEFT JOIN ugeo g ON s.user_id = g.user_id LEFT JOIN temporal t ON s.user_id = t.user_id
        LEFT JOIN social o ON s.user_id = o.user_id)
    SELECT *,
        num_reviews / (date_diff('day', first_review_date, latest_review_date) / 365.25 + 0.5) AS reviews_per_year,
        2 * 3959.0 * atan2(sqrt(a), sqrt(1 - a)) AS geographic_radius,
        compliment_hot + compliment_cool + compliment_funny AS total_compliments,
        (compliment_hot + compliment_cool + compliment_funny) / (num_reviews + 1) AS compliment_ratio,
        CASE WHEN elite_years > 0 THEN 1 ELSE 0 END AS elite_indicator
    FROM (SELECT *, pow(sin((radians(max_lat) - radians(min_lat)) / 2), 2)
                 + cos(radians(min_lat)) * cos(radians(max_lat))
                   * pow(sin((radians(max_lon) - radians(min_lon)) / 2), 2) AS a FROM j)
    """.replace("SELECT *,\n        num_reviews", "SELECT * EXCLUDE (a),\n        num_reviews"), ACTIVITY_COLS))
def j7_user_activity_features(spark, d):
    return round_doubles(locality.user_activity_features(fx.reviews(spark, d), fx.business(spark, d), fx.users(spark, d)))
