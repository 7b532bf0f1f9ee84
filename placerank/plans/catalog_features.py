"""Registered queries: business cleaning / features and user features."""
from __future__ import annotations

from pyspark.sql import functions as F

from placerank.functions.expr import elite_years, price_level, to_ts
from placerank.operators import features_business as fb
from placerank.operators import features_user as fu
from placerank.operators import locality
from placerank.plans.catalog_locality import BASE, LOCALITY
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources.fixture_sql import ctes
from placerank.sources.reference_values import CATEGORY_GROUPS, GROUP_NAMES, PROMOTED_ATTRIBUTES

TOKENS = "list_transform(string_split(categories, ', '), lambda x: lower(trim(x, E' \\t\\n\\r')))"


def _sql_list(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


FLAGS_SQL = ",\n        ".join(
    f"CASE WHEN list_has_any({TOKENS}, {_sql_list(cats)}) THEN true END AS {g}"
    for g, cats in CATEGORY_GROUPS.items())


@query("p1_food_filter", ctes("business") + """SELECT business_id, categories FROM business
    WHERE categories IS NOT NULL AND (lower(categories) LIKE '%food%' OR lower(categories) LIKE '%restaurant%')""")
def p1_food_filter(spark, d):
    return fb.food_places(fx.business(spark, d)).select("business_id", "categories")


@query("p2_drop_blocked", ctes("business", "blocked_categories") + f"""SELECT business_id, categories FROM business
    WHERE NOT coalesce(list_has_any({TOKENS}, (SELECT list(category) FROM blocked_categories)), false)""")
def p2_drop_blocked(spark, d):
    b = fx.business(spark, d).select("business_id", "categories")
    return fb.drop_blocked(b, fx.blocked_categories(spark))


@query("p3_group_flags", ctes("business") + f"SELECT business_id, {FLAGS_SQL} FROM business")
def p3_group_flags(spark, d):
    b = fx.business(spark, d).select("business_id", "categories")
    return fb.group_flags(b, fx.category_groups(spark), GROUP_NAMES).drop("categories")


def _promote_sql(col):
    return (f"CASE WHEN lower({col}) LIKE '%true%' THEN 'True' WHEN lower({col}) LIKE '%false%' THEN 'False' "
            f"ELSE {col} END")


PROMOTE_SQL = ", ".join(f"{_promote_sql('attr_' + k.lower())} AS {k}" for k in PROMOTED_ATTRIBUTES)


@query("p4_promote_attributes", ctes("business") + f"SELECT business_id, {PROMOTE_SQL} FROM business")
def p4_promote_attributes(spark, d):
    b = fx.business(spark, d).select("business_id", "attributes")
    return fb.promote_attributes(b, PROMOTED_ATTRIBUTES).drop("attributes")


IMPUTE_FLAGS = ",\n        ".join(
    f"coalesce(list_has_any({TOKENS}, {_sql_list(cats)}), false) AS {g}" for g, cats in CATEGORY_GROUPS.items())


@query("p5_impute", sql_round(ctes("business") + f"""SELECT business_id, {IMPUTE_FLAGS},
        coalesce({_promote_sql('attr_dogsallowed')}, 'False') AS DogsAllowed,
        coalesce({_promote_sql('attr_open24hours')}, 'False') AS Open24Hours,
        coalesce(TRY_CAST({_promote_sql('attr_restaurantspricerange2')} AS DOUBLE), 2.0) AS RestaurantsPriceRange2
        FROM business""", ["RestaurantsPriceRange2"]))
def p5_impute(spark, d):
    b = fx.business(spark, d).select("business_id", "categories", "attributes")
    b = fb.group_flags(b, fx.category_groups(spark), GROUP_NAMES)
    b = fb.promote_attributes(b, ["DogsAllowed", "Open24Hours", "RestaurantsPriceRange2"])
    b = fb.impute(b, GROUP_NAMES + ["DogsAllowed", "Open24Hours"])
    return round_doubles(b.drop("categories", "attributes"))


@query("p8_elite_years", ctes("users") + """SELECT user_id, elite,
    CAST(CASE WHEN length(elite) > 0 THEN len(string_split(elite, ',')) ELSE 0 END AS INTEGER) AS years_elite
    FROM users""")
def p8_elite_years(spark, d):
    return fx.users(spark, d).select("user_id", "elite", elite_years("elite").alias("years_elite"))


@query("p9_price_level", sql_round(ctes("business") + """SELECT business_id, price_raw,
    coalesce(TRY_CAST(price_raw AS DOUBLE), 2.0) AS price FROM business""", ["price"]))
def p9_price_level(spark, d):
    return round_doubles(fx.business(spark, d).select("business_id", "price_raw",
                                                      price_level("price_raw").alias("price")))


@query("p10_parse_dates", ctes("users") + """SELECT user_id, yelping_since,
    TRY_CAST(yelping_since AS TIMESTAMP) AS since_ts FROM users""")
def p10_parse_dates(spark, d):
    return fx.users(spark, d).select("user_id", "yelping_since", to_ts("yelping_since").alias("since_ts"))


@query("a8_elite_user_ratio", sql_round(ctes("reviews", "users") + """SELECT r.business_id,
    avg(CASE WHEN e.user_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS elite_user_ratio
    FROM reviews r LEFT JOIN (SELECT user_id FROM users
        WHERE (CASE WHEN length(elite) > 0 THEN len(string_split(elite, ',')) ELSE 0 END) > 0) e
    ON r.user_id = e.user_id GROUP BY r.business_id""", ["elite_user_ratio"]))
def a8_elite_user_ratio(spark, d):
    return round_doubles(fb.elite_user_ratio(fx.reviews(spark, d), fx.users(spark, d)))


@query("a17_tip_counts", ctes("tips") + "SELECT business_id, count(*) AS num_tips FROM tips GROUP BY business_id")
def a17_tip_counts(spark, d):
    return fb.tip_counts(fx.tips(spark, d))


@query("a18_checkin_counts", ctes("checkins") + """SELECT business_id,
    CAST(sum(CASE WHEN length(date) > 0 THEN len(string_split(date, ',')) ELSE 0 END) AS BIGINT) AS num_checkins
    FROM checkins GROUP BY business_id""")
def a18_checkin_counts(spark, d):
    return fb.checkin_counts(fx.checkins(spark, d))


UCC = f"""cats AS (SELECT business_id, unnest({TOKENS}) AS category FROM business),
    ucc AS (SELECT r.user_id, c.category, count(*) AS n FROM reviews r JOIN cats c ON r.business_id = c.business_id
        WHERE c.category NOT IN ('food', 'restaurants') GROUP BY r.user_id, c.category)"""


@query("a9_user_category_counts", ctes("business", "reviews", extra=UCC) + "SELECT user_id, category, n FROM ucc")
def a9_user_category_counts(spark, d):
    return fu.user_category_counts(fx.reviews(spark, d), fx.business(spark, d))


RATIO_SQL = ",\n        ".join(
    f"coalesce(sum(g.n) FILTER (WHERE g.\"group\" = '{g}'), 0) / t.total AS {g}_ratio" for g in GROUP_NAMES)


@query("a10_user_group_ratios", sql_round(ctes("business", "reviews", "category_groups", extra=UCC) + f""",
    tot AS (SELECT user_id, sum(n) AS total FROM ucc GROUP BY user_id),
    pg AS (SELECT u.user_id, g."group", sum(u.n) AS n FROM ucc u JOIN category_groups g ON u.category = g.category
        GROUP BY u.user_id, g."group")
    SELECT t.user_id, {RATIO_SQL}
    FROM tot t LEFT JOIN pg g ON t.user_id = g.user_id GROUP BY t.user_id, t.total""",
    [f"{g}_ratio" for g in GROUP_NAMES]))
def a10_user_group_ratios(spark, d):
    counts = fu.user_category_counts(fx.reviews(spark, d), fx.business(spark, d))
    return round_doubles(fu.user_group_ratios(counts, fx.category_groups(spark), GROUP_NAMES))


@query("a11_user_top_category", sql_round(ctes("business", "reviews", extra=UCC) + """SELECT user_id,
        category AS top_category, n / total AS top_category_ratio FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS rn,
               sum(n) OVER (PARTITION BY user_id) AS total FROM ucc) WHERE rn = 1""", ["top_category_ratio"]))
def a11_user_top_category(spark, d):
    counts = fu.user_category_counts(fx.reviews(spark, d), fx.business(spark, d))
    return round_doubles(fu.user_top_category(counts))


USER_REVIEW_SQL = ctes("business", "reviews", "users", extra=BASE + ",\n" + LOCALITY) + """,
    per_user AS (SELECT l.user_id, stddev_samp(l.stars) AS rating_variance,
        avg(CASE WHEN l.is_local THEN 1.0 ELSE 0.0 END) AS local_review_ratio,
        min(l.date) AS first_d, max(l.date) AS last_d,
        avg(coalesce(TRY_CAST(b.price_raw AS DOUBLE), 2.0)) AS avg_price_preference,
        count(DISTINCT l.business_city) AS num_cities_reviewed
        FROM loc l LEFT JOIN business b ON l.business_id = b.business_id GROUP BY l.user_id),
    urf AS (SELECT u.user_id, p.rating_variance, coalesce(p.local_review_ratio, 0.0) AS local_review_ratio,
        date_diff('day', p.last_d, (SELECT max(date) FROM loc)) AS days_since_last_review,
        u.review_count / CASE WHEN date_diff('day', p.first_d, p.last_d) = 0 THEN 1
                              ELSE date_diff('day', p.first_d, p.last_d) END AS review_frequency,
        p.avg_price_preference, coalesce(p.num_cities_reviewed, 1) AS num_cities_reviewed
        FROM users u LEFT JOIN per_user p ON u.user_id = p.user_id)
"""


def _urf(spark, d):
    r, b, u = fx.reviews(spark, d), fx.business(spark, d), fx.users(spark, d)
    loc = locality.reviews_with_locality(r, b, locality.base_city(r, b))
    return fu.user_review_features(loc, b, u)


for _name, _cols in [("a12_rating_variance", ["rating_variance"]),
                     ("a13_local_review_ratio", ["local_review_ratio"]),
                     ("a14_recency_frequency", ["days_since_last_review", "review_frequency"]),
                     ("a15_price_preference", ["avg_price_preference"]),
                     ("a16_num_cities_reviewed", ["num_cities_reviewed"])]:
    _dbl = [c for c in _cols if c not in ("days_since_last_review", "num_cities_reviewed")]
    _sql = USER_REVIEW_SQL + f"SELECT user_id, {', '.join(_cols)} FROM urf"
    query(_name, sql_round(_sql, _dbl) if _dbl else _sql)(
        (lambda cols: lambda spark, d: round_doubles(_urf(spark, d).select("user_id", *cols)))(_cols))
