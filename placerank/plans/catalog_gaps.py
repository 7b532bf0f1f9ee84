"""Registered queries over reviews with gaps: users without reviews or with a single one, and unknown businesses, so that
defaults and missing partners take part."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placerank.operators import features_business as fb
from placerank.operators import features_user as fu
from placerank.operators import locality, score
from placerank.plans.catalog_features import USER_REVIEW_SQL
from placerank.plans.catalog_locality import BASE, CITY_STATE, HOME, LOCALITY
from placerank.plans.catalog_prepare import BF, BF_COLS, UF, UF_COLS, UF_DBL
from placerank.plans.catalog_scoring import MODEL, SCORE_SQL, fixture_model, train_test
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources.fixture_sql import VIEWS, ctes
from placerank.sources.reference_values import GROUP_NAMES, PROMOTED_ATTRIBUTES

GAPS = f"""reviews AS (SELECT review_id, user_id, CASE WHEN business_id % 7 = 0 THEN business_id + 1000000000000 ELSE business_id END AS business_id,
        stars, date FROM ({VIEWS['reviews'][1]}) r WHERE user_id % 5 <> 0
        QUALIFY user_id % 5 <> 1 OR review_id = min(review_id) OVER (PARTITION BY user_id))"""


def gapped_reviews(spark, d):
    r = fx.reviews(spark, d).filter(F.col("user_id") % 5 != 0)
    first = F.min("review_id").over(Window.partitionBy("user_id"))
    r = r.withColumn("_first", first).filter((F.col("user_id") % 5 != 1) | (F.col("review_id") == F.col("_first"))).drop("_first")
    return r.withColumn("business_id", F.when(F.col("business_id") % 7 == 0, F.col("business_id") + 1000000000000).otherwise(F.col("business_id")))


@query("p12_classify_with_gaps", ctes("business", extra=GAPS + ",\n" + BASE) + """SELECT r.review_id,
        CASE WHEN b.business_id IS NULL THEN NULL WHEN b.city IS NOT DISTINCT FROM s.base_city THEN 'local' ELSE 'tourist' END
            AS location_classification
        FROM reviews r LEFT JOIN business b ON r.business_id = b.business_id LEFT JOIN bases s ON r.user_id = s.user_id""")
def p12_classify_with_gaps(spark, d):
    r, b = gapped_reviews(spark, d), fx.business(spark, d)
    return locality.classify_reviews(r.select("review_id", "user_id", "business_id"), b, locality.base_city(r, b)).select(
        "review_id", "location_classification")


URF_COLS = ["user_id", "rating_variance", "local_review_ratio", "days_since_last_review", "review_frequency", "avg_price_preference",
            "num_cities_reviewed"]


@query("a12_a16_user_review_features_with_gaps", sql_round(
    USER_REVIEW_SQL.replace(f"reviews AS ({VIEWS['reviews'][1]})", GAPS) + f"SELECT {', '.join(URF_COLS)} FROM urf",
    ["rating_variance", "local_review_ratio", "review_frequency", "avg_price_preference"]))
def a12_a16_user_review_features_with_gaps(spark, d):
    r, b = gapped_reviews(spark, d), fx.business(spark, d)
    loc = locality.reviews_with_locality(r, b, locality.base_city(r, b))
    return round_doubles(fu.user_review_features(loc, b, fx.users(spark, d)).select(*URF_COLS))


@query("user_feature_table_with_gaps", sql_round(ctes("business", "users", "category_groups", extra=",\n".join(
    [GAPS, BASE, LOCALITY, CITY_STATE, UF])) + f"SELECT {', '.join(UF_COLS)} FROM uf", UF_DBL))
def user_feature_table_with_gaps(spark, d):
    b = fx.business(spark, d)
    u = fu.user_feature_table(fx.users(spark, d), gapped_reviews(spark, d), b, fx.category_groups(spark), GROUP_NAMES)
    return round_doubles(locality.attach_state(u, locality.city_state(b)).select(*UF_COLS))


@query("business_feature_table_with_gaps", sql_round(ctes("business", "users", "tips", "checkins", "blocked_categories", extra=",\n".join(
    [GAPS, BASE, LOCALITY, BF])) + f"SELECT {', '.join(BF_COLS)} FROM bf", ["local_preference_ratio", "elite_user_ratio"]))
def business_feature_table_with_gaps(spark, d):
    b = fb.business_feature_table(fx.business(spark, d), gapped_reviews(spark, d), fx.users(spark, d), fx.tips(spark, d), fx.checkins(spark, d),
                                  fx.category_groups(spark), fx.blocked_categories(spark), GROUP_NAMES, PROMOTED_ATTRIBUTES)
    return round_doubles(b.select(*BF_COLS))


@query("w1_home_city_with_gaps", ctes("business", extra=GAPS + ",\n" + HOME.split(",\n    rwh AS")[0]) + "SELECT user_id, home_city FROM home")
def w1_home_city_with_gaps(spark, d):
    return locality.home_city(gapped_reviews(spark, d), fx.business(spark, d))


@query("m5_score_pairs_with_unknown_ids", sql_round(ctes("reviews", extra=MODEL) + f""", pairs AS (SELECT
        CASE WHEN user_id % 4 = 0 THEN user_id + 1000000000000 ELSE user_id END AS user_id,
        CASE WHEN business_id % 6 = 0 THEN business_id + 1000000000000 ELSE business_id END AS business_id FROM split WHERE split = 'test')
    SELECT s.user_id, s.business_id, CASE WHEN u.user_id IS NOT NULL AND i.business_id IS NOT NULL THEN {SCORE_SQL} END AS predicted_rating
    FROM pairs s LEFT JOIN uf u ON s.user_id = u.user_id LEFT JOIN itf i ON s.business_id = i.business_id""", ["predicted_rating"]))
def m5_score_pairs_with_unknown_ids(spark, d):
    far = lambda c, m: F.when(F.col(c) % m == 0, F.col(c) + 1000000000000).otherwise(F.col(c)).alias(c)
    pairs = train_test(spark, d).filter(F.col("split") == "test").select(far("user_id", 4), far("business_id", 6))
    return round_doubles(score.score_pairs(fixture_model(spark, d), pairs))


STATES = """, u AS (SELECT user_id, CASE WHEN user_id % 6 = 0 THEN 'Nowhere' WHEN user_id % 6 = 1 THEN NULL ELSE ' ' || upper(city) || ' ' END AS base_city,
        CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'ZZ' END AS state_code FROM users)
    SELECT u.user_id, c.state AS inferred_state, CASE WHEN c.state IS NOT NULL AND ({fill}) THEN c.state ELSE u.state_code END AS state_code
    FROM u LEFT JOIN city_state c ON lower(trim(u.base_city, E' \\t\\n\\r')) = c.city_key"""


def _states(spark, d, overwrite):
    k = F.col("user_id")
    u = fx.users(spark, d).select(
        "user_id", F.when(k % 6 == 0, "Nowhere").when(k % 6 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), F.upper("city"), F.lit(" "))).alias("base_city"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "").otherwise("ZZ").alias("state_code"))
    out = locality.attach_state(u, locality.city_state(fx.business(spark, d)), overwrite=overwrite)
    return out.select("user_id", "inferred_state", "state_code")


@query("j14_fill_state", ctes("business", "users", extra=CITY_STATE) + STATES.format(fill="u.state_code IS NULL OR u.state_code = ''"))
def j14_fill_state(spark, d):
    """A state that is there stays; unknown cities give none."""
    return _states(spark, d, False)


@query("j14_overwrite_state", ctes("business", "users", extra=CITY_STATE) + STATES.format(fill="true"))
def j14_overwrite_state(spark, d):
    return _states(spark, d, True)
