"""Registered queries: activity filter, dataset statistics and model-ready feature tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from placerank.operators import features_business as fb
from placerank.operators import features_user as fu
from placerank.operators import locality
from placerank.operators import prepare as pr
from placerank.plans.catalog_features import FLAGS_SQL, IMPUTE_FLAGS, TOKENS, UCC, _promote_sql
from placerank.plans.catalog_locality import BASE, CITY_STATE, LOCALITY
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources.fixture_sql import ctes
from placerank.sources.reference_values import (
    BUSINESS_CATEGORICAL, BUSINESS_NUMERIC, GROUP_NAMES, NEW_USER_VECTOR, PROMOTED_ATTRIBUTES, USER_CATEGORICAL,
    USER_NUMERIC)

# fixture thresholds (FIXTURES.md section 3: the reference's 20 / 50 leave no rows here)
MIN_USER, MIN_BIZ = 20, 25

FILTERED = f"""bcount AS (SELECT business_id FROM reviews GROUP BY business_id HAVING count(*) >= {MIN_BIZ}),
    kept AS (SELECT * FROM reviews WHERE business_id IN (SELECT business_id FROM bcount)),
    ucount AS (SELECT user_id FROM kept GROUP BY user_id HAVING count(*) >= {MIN_USER}),
    fr AS (SELECT * FROM kept WHERE user_id IN (SELECT user_id FROM ucount))"""


def filtered_reviews(spark, d):
    return pr.filter_activity(fx.reviews(spark, d), MIN_USER, MIN_BIZ)


@query("a20_filter_activity", ctes("reviews", extra=FILTERED) + "SELECT review_id, user_id, business_id, stars FROM fr")
def a20_filter_activity(spark, d):
    return filtered_reviews(spark, d).select("review_id", "user_id", "business_id", "stars")


@query("a20_filter_activity_independent", ctes("reviews") + """, b AS (SELECT business_id FROM reviews
        GROUP BY business_id HAVING count(*) >= 25),
    u AS (SELECT user_id FROM reviews GROUP BY user_id HAVING count(*) >= 30)
    SELECT review_id, user_id, business_id, stars FROM reviews
    WHERE business_id IN (SELECT business_id FROM b) AND user_id IN (SELECT user_id FROM u)""")
def a20_filter_activity_independent(spark, d):
    return pr.filter_activity(fx.reviews(spark, d), 30, 25, order="independent").select(
        "review_id", "user_id", "business_id", "stars")


@query("a21_dataset_stats", sql_round(ctes("reviews", extra=FILTERED) + """SELECT count(DISTINCT user_id) AS n_users,
        count(DISTINCT business_id) AS n_businesses, count(*) AS n_reviews,
        1.0 - count(*) / (count(DISTINCT user_id) * count(DISTINCT business_id)) AS sparsity FROM fr""",
    ["sparsity"]))
def a21_dataset_stats(spark, d):
    return round_doubles(pr.dataset_stats(filtered_reviews(spark, d)))


@query("a22_rating_distribution", ctes("reviews") + "SELECT stars, count(*) AS n FROM reviews GROUP BY stars")
def a22_rating_distribution(spark, d):
    return pr.rating_distribution(fx.reviews(spark, d))


def _std_sql(c):
    return (f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
            f"ELSE 0.0 END AS {c}")


def _code_sql(c, alias=None):
    return (f"CASE WHEN {c} IS NULL THEN -1 ELSE CAST(dense_rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) - 1"
            f" AS INTEGER) END AS {alias or c}")


F1_COLS = ["latitude", "longitude", "stars", "review_count"]


@query("f1_standardize", sql_round(ctes("business") + f"""SELECT business_id,
    {', '.join(_std_sql(c) for c in F1_COLS)} FROM (SELECT business_id,
    {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in F1_COLS)} FROM business)""", F1_COLS))
def f1_standardize(spark, d):
    b = fx.business(spark, d).select("business_id", *[F.col(c).cast("double").alias(c) for c in F1_COLS])
    return round_doubles(pr.standardize(b, F1_COLS))


F2_COLS = ["city", "state", "price_raw", "is_open"]


@query("f2_label_encode", ctes("business") + f"""SELECT business_id, {', '.join(_code_sql(c) for c in F2_COLS)}
    FROM business""")
def f2_label_encode(spark, d):
    b = fx.business(spark, d).select("business_id", *F2_COLS)
    return pr.label_encode(b, F2_COLS)


@query("f3_account_age", ctes("users") + """SELECT user_id, yelping_since,
    CAST(coalesce(date_diff('day', TRY_CAST(yelping_since AS TIMESTAMP),
        (SELECT max(TRY_CAST(yelping_since AS TIMESTAMP)) FROM users)), 0) AS DOUBLE) AS days_yelping FROM users""")
def f3_account_age(spark, d):
    return pr.account_age_days(fx.users(spark, d).select("user_id", "yelping_since"))


@query("f6_train_test_split", ctes("reviews") + """SELECT review_id, user_id, business_id, stars,
    CASE WHEN CAST('0x' || substr(md5(review_id || '|42'), 1, 8) AS BIGINT) % 10000 < 2000 THEN 'test'
         ELSE 'train' END AS split FROM reviews""")
def f6_train_test_split(spark, d):
    r = fx.reviews(spark, d).select("review_id", "user_id", "business_id", "stars")
    return pr.split_train_test(r, 0.2, 42)


# ---- business feature table and F4 ----
BF = f"""bf0 AS (SELECT * FROM business
        WHERE categories IS NOT NULL AND (lower(categories) LIKE '%food%' OR lower(categories) LIKE '%restaurant%')
          AND NOT coalesce(list_has_any({TOKENS}, (SELECT list(category) FROM blocked_categories)), false)),
    tipc AS (SELECT business_id, count(*) AS num_tips FROM tips GROUP BY business_id),
    chk AS (SELECT business_id, CAST(sum(CASE WHEN length(date) > 0 THEN len(string_split(date, ',')) ELSE 0 END)
        AS BIGINT) AS num_checkins FROM checkins GROUP BY business_id),
    elite_u AS (SELECT user_id FROM users
        WHERE (CASE WHEN length(elite) > 0 THEN len(string_split(elite, ',')) ELSE 0 END) > 0),
    brf AS (SELECT l.business_id, avg(CASE WHEN l.is_local THEN 1.0 ELSE 0.0 END) AS local_preference_ratio,
        avg(CASE WHEN e.user_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS elite_user_ratio
        FROM loc l LEFT JOIN elite_u e ON l.user_id = e.user_id GROUP BY l.business_id),
    bf AS (SELECT b.business_id, b.name, b.city, b.state, b.latitude, b.longitude, b.stars, b.review_count,
        b.is_open, b.categories, {IMPUTE_FLAGS},
        {_promote_sql('attr_businessparking')} AS BusinessParking,
        coalesce({_promote_sql('attr_dogsallowed')}, 'False') AS DogsAllowed,
        coalesce({_promote_sql('attr_open24hours')}, 'False') AS Open24Hours,
        coalesce(TRY_CAST({_promote_sql('attr_restaurantspricerange2')} AS DOUBLE), 2.0) AS RestaurantsPriceRange2,
        coalesce(t.num_tips, 0) AS num_tips, coalesce(c.num_checkins, 0) AS num_checkins,
        r.local_preference_ratio, r.elite_user_ratio
        FROM bf0 b LEFT JOIN tipc t ON b.business_id = t.business_id
        LEFT JOIN chk c ON b.business_id = c.business_id LEFT JOIN brf r ON b.business_id = r.business_id)"""
BF_CTES = ctes("business", "reviews", "users", "tips", "checkins", "blocked_categories",
               extra=BASE + ",\n" + LOCALITY + ",\n" + BF)


def business_table(spark, d):
    r, b, u = fx.reviews(spark, d), fx.business(spark, d), fx.users(spark, d)
    return fb.business_feature_table(b, r, u, fx.tips(spark, d), fx.checkins(spark, d), fx.category_groups(spark),
                                     fx.blocked_categories(spark), GROUP_NAMES, PROMOTED_ATTRIBUTES)


BF_COLS = ["business_id", "name", "city", "state", "latitude", "longitude", "stars", "review_count", "is_open",
           "categories"] + GROUP_NAMES + ["BusinessParking", "DogsAllowed", "Open24Hours", "RestaurantsPriceRange2",
                                          "num_tips", "num_checkins", "local_preference_ratio", "elite_user_ratio"]


@query("business_feature_table", sql_round(BF_CTES + f"SELECT {', '.join(BF_COLS)} FROM bf",
                                           ["local_preference_ratio", "elite_user_ratio"]))
def business_feature_table(spark, d):
    return round_doubles(business_table(spark, d).select(*BF_COLS))


BNUM = [c for c in BUSINESS_NUMERIC if c != "avg_sentiment"]


@query("f4_business_features_prepared", sql_round(BF_CTES + ",\n" + FILTERED + f""",
    bsel AS (SELECT business_id, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}' for c in BNUM)},
        {', '.join(BUSINESS_CATEGORICAL)} FROM bf WHERE business_id IN (SELECT business_id FROM fr))
    SELECT business_id, {', '.join(_std_sql(c) for c in BNUM)}, {', '.join(_code_sql(c) for c in BUSINESS_CATEGORICAL)}
    FROM bsel""", BNUM))
def f4_business_features_prepared(spark, d):
    bt = business_table(spark, d)
    out = pr.prepare_business_features(bt, filtered_reviews(spark, d), BUSINESS_NUMERIC, BUSINESS_CATEGORICAL)
    return round_doubles(out)


# ---- user feature table and F5 ----
RATIO_SQL = ",\n        ".join(
    f"coalesce(coalesce(sum(g.n) FILTER (WHERE g.\"group\" = '{g}'), 0) / any_value(t.total), 0.0) AS {g}_ratio"
    for g in GROUP_NAMES)
UF = f"""{UCC},
    tot AS (SELECT user_id, sum(n) AS total FROM ucc GROUP BY user_id),
    pg AS (SELECT u.user_id, g."group", sum(u.n) AS n FROM ucc u JOIN category_groups g ON u.category = g.category
        GROUP BY u.user_id, g."group"),
    ratios AS (SELECT t.user_id, {RATIO_SQL} FROM tot t LEFT JOIN pg g ON t.user_id = g.user_id GROUP BY t.user_id),
    topc AS (SELECT user_id, category AS top_category, n / total AS top_category_ratio FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS rn,
               sum(n) OVER (PARTITION BY user_id) AS total FROM ucc) WHERE rn = 1),
    per_user AS (SELECT l.user_id, stddev_samp(l.stars) AS rating_variance,
        avg(CASE WHEN l.is_local THEN 1.0 ELSE 0.0 END) AS local_review_ratio,
        min(l.date) AS first_d, max(l.date) AS last_d,
        avg(coalesce(TRY_CAST(b.price_raw AS DOUBLE), 2.0)) AS avg_price_preference,
        count(DISTINCT l.business_city) AS num_cities_reviewed
        FROM loc l LEFT JOIN business b ON l.business_id = b.business_id GROUP BY l.user_id),
    uf AS (SELECT u.*, s.base_city, cs.state AS inferred_state, cs.state AS state_code,
        CAST(CASE WHEN length(u.elite) > 0 THEN len(string_split(u.elite, ',')) ELSE 0 END AS INTEGER) AS years_elite,
        p.rating_variance, coalesce(p.local_review_ratio, 0.0) AS local_review_ratio,
        date_diff('day', p.last_d, (SELECT max(date) FROM loc)) AS days_since_last_review,
        u.review_count / CASE WHEN date_diff('day', p.first_d, p.last_d) = 0 THEN 1
                              ELSE date_diff('day', p.first_d, p.last_d) END AS review_frequency,
        p.avg_price_preference, coalesce(p.num_cities_reviewed, 1) AS num_cities_reviewed,
        {', '.join(f'coalesce(r.{g}_ratio, 0.0) AS {g}_ratio' for g in GROUP_NAMES)},
        t.top_category, coalesce(t.top_category_ratio, 0.0) AS top_category_ratio
        FROM users u LEFT JOIN bases s ON u.user_id = s.user_id
        LEFT JOIN city_state cs ON lower(trim(s.base_city, E' \\t\\n\\r')) = cs.city_key
        LEFT JOIN per_user p ON u.user_id = p.user_id
        LEFT JOIN ratios r ON u.user_id = r.user_id LEFT JOIN topc t ON u.user_id = t.user_id)"""
UF_CTES = ctes("business", "reviews", "users", "category_groups",
               extra=BASE + ",\n" + LOCALITY + ",\n" + CITY_STATE + ",\n" + UF)


def user_table(spark, d):
    r, b, u = fx.reviews(spark, d), fx.business(spark, d), fx.users(spark, d)
    return locality.attach_state(fu.user_feature_table(u, r, b, fx.category_groups(spark), GROUP_NAMES), locality.city_state(b))


UF_COLS = ["user_id", "base_city", "state_code", "years_elite", "rating_variance", "local_review_ratio",
           "days_since_last_review", "review_frequency", "avg_price_preference", "num_cities_reviewed",
           "top_category", "top_category_ratio"] + [f"{g}_ratio" for g in GROUP_NAMES]
UF_DBL = ["rating_variance", "local_review_ratio", "review_frequency", "avg_price_preference",
          "top_category_ratio"] + [f"{g}_ratio" for g in GROUP_NAMES]


@query("user_feature_table", sql_round(UF_CTES + f"SELECT {', '.join(UF_COLS)} FROM uf", UF_DBL))
def user_feature_table(spark, d):
    return round_doubles(user_table(spark, d).select(*UF_COLS))


UNUM = [c for c in USER_NUMERIC if c != "avg_sentiment"]


@query("f5_user_features_prepared", sql_round(UF_CTES + ",\n" + FILTERED + f""",
    usel AS (SELECT user_id, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}' for c in UNUM)},
        CAST(coalesce(date_diff('day', TRY_CAST(yelping_since AS TIMESTAMP),
            max(TRY_CAST(yelping_since AS TIMESTAMP)) OVER ()), 0) AS DOUBLE) AS days_yelping,
        {', '.join(USER_CATEGORICAL)} FROM uf WHERE user_id IN (SELECT user_id FROM fr))
    SELECT user_id, {', '.join(_std_sql(c) for c in UNUM + ['days_yelping'])},
        {', '.join(_code_sql(c, c + '_encoded') for c in USER_CATEGORICAL)} FROM usel""", UNUM + ["days_yelping"]))
def f5_user_features_prepared(spark, d):
    out = pr.prepare_user_features(user_table(spark, d), filtered_reviews(spark, d), USER_NUMERIC, USER_CATEGORICAL)
    return round_doubles(out)


F7_COLS = ["latitude", "longitude", "stars", "review_count"]


@query("f7_feature_vectors", ctes("business", "reviews") + f"""SELECT i.business_id,
    [{', '.join(f'coalesce(CAST(f.{c} AS DOUBLE), 0.0)' for c in F7_COLS)}] AS features
    FROM (SELECT DISTINCT business_id FROM reviews) i LEFT JOIN (SELECT * FROM business
        WHERE categories IS NOT NULL AND (lower(categories) LIKE '%food%' OR lower(categories) LIKE '%restaurant%')) f
    ON i.business_id = f.business_id""")
def f7_feature_vectors(spark, d):
    feats = fb.food_places(fx.business(spark, d))
    return pr.feature_vectors(fx.reviews(spark, d), feats, "business_id", F7_COLS)


# ---- new users (those outside the filtered reviews) and stored scaling statistics ----
SCALED = fx.COMPLIMENT_COLUMNS + ["review_count", "useful", "funny", "cool", "fans", "average_stars"]
SCALER = ctes("users", "reviews", extra=FILTERED) + ", st AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std FROM known" for c in SCALED) + ")"
SCALER = SCALER.replace(", st AS (", ", known AS (SELECT * FROM users WHERE user_id IN (SELECT user_id FROM fr)),\n    "
                        "cold AS (SELECT * FROM users WHERE user_id NOT IN (SELECT user_id FROM fr)),\n    st AS (", 1)


def known_and_cold(spark, d):
    u, fr = fx.users(spark, d), filtered_reviews(spark, d).select("user_id")
    return u.join(fr, "user_id", "left_semi"), u.join(fr, "user_id", "left_anti")


def _scaled_sql(c):
    return (f"CASE WHEN (SELECT std FROM st WHERE \"column\" = '{c}') > 0 THEN (coalesce(CAST({c} AS DOUBLE), 0.0) - (SELECT mean FROM st "
            f"WHERE \"column\" = '{c}')) / (SELECT std FROM st WHERE \"column\" = '{c}') ELSE 0.0 END")


@query("f1_scaler_fit", sql_round(SCALER + " SELECT * FROM st", ["mean", "std"]))
def f1_scaler_fit(spark, d):
    return round_doubles(pr.fit_scaler(known_and_cold(spark, d)[0], SCALED))


@query("f1_scaler_applied_to_other_rows", sql_round(SCALER + f" SELECT user_id, {', '.join(_scaled_sql(c) + f' AS {c}' for c in SCALED)} FROM cold", SCALED))
def f1_scaler_applied_to_other_rows(spark, d):
    known, cold = known_and_cold(spark, d)
    return round_doubles(pr.apply_scaler(cold.select("user_id", *SCALED), pr.fit_scaler(known, SCALED), SCALED))


def _new_users(spark, d):
    return known_and_cold(spark, d)[1].drop("elite", "city", "name", "friends", "yelping_since")


@query("f8_new_user_vectors", SCALER + f"""SELECT user_id,
    [{', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0)' if c in SCALED else '0.0' for c in NEW_USER_VECTOR)}] AS features FROM cold""")
def f8_new_user_vectors(spark, d):
    return pr.new_user_vectors(_new_users(spark, d), NEW_USER_VECTOR)


@query("f8_new_user_vectors_scaled", SCALER + f"""SELECT user_id,
    [{', '.join(f'round({_scaled_sql(c)}, 6)' if c in SCALED else '0.0' for c in NEW_USER_VECTOR)}] AS features FROM cold""")
def f8_new_user_vectors_scaled(spark, d):
    stats = pr.fit_scaler(known_and_cold(spark, d)[0], SCALED)
    return round_doubles(pr.new_user_vectors(_new_users(spark, d), NEW_USER_VECTOR, stats))
