"""Registered queries: scans, semi/anti joins, frequency tables, sorts and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from placerank.functions.expr import category_tokens, dot, elite_years, fill_zero, price_level
from placerank.operators import features_business as fb
from placerank.operators import features_user as fu
from placerank.operators import gem, locality
from placerank.plans.catalog_features import TOKENS, UCC
from placerank.plans.catalog_locality import BASE, GEM_SQL
from placerank.plans.catalog_models import HYBRID
from placerank.plans.catalog_scoring import MODEL, fixture_model, train_test
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources import io
from placerank.sources.fixture_sql import ctes

FOOD = ("categories IS NOT NULL AND (lower(categories) LIKE '%food%' OR lower(categories) LIKE '%restaurant%')")


@query("s5_table_counts", ctes("business", "users", "reviews") + """SELECT 'business' AS "table", count(*) AS n_rows
    FROM business UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'reviews', count(*) FROM reviews""")
def s5_table_counts(spark, d):
    return io.table_counts({"business": fx.business(spark, d), "users": fx.users(spark, d),
                            "reviews": fx.reviews(spark, d)})


@query("j1_reviews_of_food_places", ctes("business", "reviews") + f"""SELECT review_id, user_id, business_id, stars
    FROM reviews WHERE business_id IN (SELECT business_id FROM business WHERE {FOOD})""")
def j1_reviews_of_food_places(spark, d):
    food = fb.food_places(fx.business(spark, d)).select("business_id")
    return fx.reviews(spark, d).select("review_id", "user_id", "business_id", "stars").join(
        food, "business_id", "left_semi")


@query("j3_review_business_lookup", ctes("business", "reviews") + """SELECT r.review_id, r.business_id, b.city,
    b.categories FROM reviews r LEFT JOIN business b ON r.business_id = b.business_id""")
def j3_review_business_lookup(spark, d):
    b = fx.business(spark, d).select("business_id", "city", "categories").dropDuplicates(["business_id"])
    return fx.reviews(spark, d).select("review_id", "business_id").join(b, "business_id", "left")


@query("j5_subset_build", ctes("business", "reviews", "users") + """SELECT business_id, name, city FROM business
    WHERE business_id IN (SELECT business_id FROM reviews WHERE user_id IN (
        SELECT user_id FROM users WHERE (CASE WHEN length(elite) > 0 THEN len(string_split(elite, ',')) ELSE 0 END) > 0))""")
def j5_subset_build(spark, d):
    """Target users (here: elite reviewers) -> their reviews -> the businesses they reviewed."""
    targets = fx.users(spark, d).filter(elite_years("elite") > 0).select("user_id")
    their = fx.reviews(spark, d).join(targets, "user_id", "left_semi").select("business_id")
    return fx.business(spark, d).select("business_id", "name", "city").join(their, "business_id", "left_semi")


@query("a19_category_counts_top", ctes("business") + f"""SELECT category, count(*) AS n FROM (
    SELECT unnest({TOKENS}) AS category FROM business) GROUP BY category ORDER BY n DESC, category LIMIT 300""")
def a19_category_counts_top(spark, d):
    c = (fx.business(spark, d).select(F.explode(category_tokens("categories")).alias("category"))
         .groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    return c.orderBy(F.col("n").desc(), "category").limit(300)


@query("a19_distinct_categories", ctes("business") + f"""SELECT DISTINCT category FROM (
    SELECT unnest({TOKENS}) AS category FROM business)""")
def a19_distinct_categories(spark, d):
    return fx.business(spark, d).select(F.explode(category_tokens("categories")).alias("category")).distinct()


@query("a19_attribute_key_counts", ctes("business") + """SELECT key, count(*) AS n FROM (
    SELECT 'BusinessParking' AS key FROM business WHERE attr_businessparking IS NOT NULL
    UNION ALL SELECT 'Music' FROM business WHERE attr_music IS NOT NULL
    UNION ALL SELECT 'OutdoorSeating' FROM business WHERE attr_outdoorseating IS NOT NULL
    UNION ALL SELECT 'Ambience' FROM business WHERE attr_ambience IS NOT NULL
    UNION ALL SELECT 'DogsAllowed' FROM business WHERE attr_dogsallowed IS NOT NULL
    UNION ALL SELECT 'Open24Hours' FROM business WHERE attr_open24hours IS NOT NULL
    UNION ALL SELECT 'RestaurantsPriceRange2' FROM business WHERE attr_restaurantspricerange2 IS NOT NULL)
    GROUP BY key""")
def a19_attribute_key_counts(spark, d):
    kv = fx.business(spark, d).select(F.explode("attributes").alias("key", "value")).filter(F.col("value").isNotNull())
    return kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("a19_price_shares", sql_round(ctes("business") + """SELECT price, count(*) AS n,
    count(*) / sum(count(*)) OVER () AS share FROM (
        SELECT coalesce(TRY_CAST(price_raw AS DOUBLE), 2.0) AS price FROM business) GROUP BY price""", ["share"]))
def a19_price_shares(spark, d):
    c = fx.business(spark, d).groupBy(price_level("price_raw").alias("price")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).scalar()   # scalar subquery: no single-partition window
    return round_doubles(c.withColumn("share", F.col("n") / total))


@query("a19_top_category_top20", ctes("business", "reviews", extra=UCC) + """, top AS (SELECT user_id, category FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS rn FROM ucc) WHERE rn = 1)
    SELECT category AS top_category, count(*) AS n FROM top GROUP BY category ORDER BY n DESC, category LIMIT 20""")
def a19_top_category_top20(spark, d):
    top = fu.user_top_category(fu.user_category_counts(fx.reviews(spark, d), fx.business(spark, d)))
    c = top.groupBy("top_category").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), "top_category").limit(20)


@query("a19_date_range", ctes("reviews") + "SELECT min(date) AS first_date, max(date) AS last_date FROM reviews")
def a19_date_range(spark, d):
    return fx.reviews(spark, d).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("l1_top_gems", sql_round("SELECT business_id, name, hidden_gem_score FROM (" + GEM_SQL +
                                ") ORDER BY round(hidden_gem_score, 9) DESC, business_id LIMIT 20",
                                ["hidden_gem_score"]))
def l1_top_gems(spark, d):
    g = gem.gem_scores(fx.reviews(spark, d), fx.business(spark, d))
    return round_doubles(g.orderBy(F.round("hidden_gem_score", 9).desc(), "business_id").limit(20)
                         .select("business_id", "name", "hidden_gem_score"))


@query("u1_union_batches", ctes("reviews") + """SELECT review_id, stars FROM reviews WHERE year(date) < 1998
    UNION ALL SELECT review_id, stars FROM reviews WHERE year(date) >= 1998""")
def u1_union_batches(spark, d):
    r = fx.reviews(spark, d)
    early = r.filter(F.year("date") < 1998).select("review_id", "stars")
    late = r.filter(F.year("date") >= 1998).select("stars", "review_id")
    return early.unionByName(late)


@query("u2_intersect_users", ctes("reviews", "tips") + "SELECT user_id FROM reviews INTERSECT SELECT user_id FROM tips")
def u2_intersect_users(spark, d):
    """Users who wrote both reviews and tips."""
    return fx.reviews(spark, d).select("user_id").intersect(fx.tips(spark, d).select("user_id"))


@query("u2_except_users", ctes("reviews", "tips") + "SELECT user_id FROM reviews EXCEPT SELECT user_id FROM tips")
def u2_except_users(spark, d):
    return fx.reviews(spark, d).select("user_id").subtract(fx.tips(spark, d).select("user_id"))


@query("u3_distinct_ids", ctes("reviews") + "SELECT DISTINCT user_id, business_id FROM reviews")
def u3_distinct_ids(spark, d):
    return fx.reviews(spark, d).select("user_id", "business_id").dropDuplicates()


@query("p6_classified_only", ctes("business", "reviews", extra=BASE) + """SELECT r.review_id FROM reviews r
    JOIN business b ON r.business_id = b.business_id""")
def p6_classified_only(spark, d):
    r, b = fx.reviews(spark, d), fx.business(spark, d)
    c = locality.classify_reviews(r.select("review_id", "user_id", "business_id"), b, locality.base_city(r, b))
    return c.filter(F.col("location_classification").isNotNull() & (F.col("location_classification") != "")) \
        .select("review_id")


@query("p11_fill_zero", sql_round(ctes("reviews") + """SELECT user_id, business_id,
    CASE WHEN user_id % 9 = 0 THEN 0.0 ELSE coalesce(stddev_samp(stars), 0.0) END AS spread FROM reviews GROUP BY user_id, business_id""", ["spread"]))
def p11_fill_zero(spark, d):
    """The spread of one rating is null, and it is made NaN for every ninth user."""
    s = fx.reviews(spark, d).groupBy("user_id", "business_id").agg(F.stddev_samp("stars").alias("spread"))
    spread = F.when(F.col("user_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("spread"))
    return round_doubles(s.select("user_id", "business_id", fill_zero(spread).alias("spread")))


@query("p17_dot_product", sql_round(ctes("reviews", extra=MODEL) + """SELECT s.review_id,
    list_dot_product([u.u0, u.u1, u.u2, u.u3], [i.i0, i.i1, i.i2, i.i3]) AS dot
    FROM split s JOIN uf u ON s.user_id = u.user_id JOIN itf i ON s.business_id = i.business_id""", ["dot"]))
def p17_dot_product(spark, d):
    m = fixture_model(spark, d)
    s = train_test(spark, d).select("review_id", "user_id", "business_id")
    j = s.join(m.users.select("user_id", "uvec"), "user_id").join(m.items.select("business_id", "ivec"),
                                                                 "business_id")
    return round_doubles(j.select("review_id", dot("uvec", "ivec").alias("dot")))


@query("a32_model_info", ctes("reviews", extra=MODEL) + f"""SELECT {HYBRID.n_factors} AS n_factors, {HYBRID.n_epochs} AS n_epochs,
    count(DISTINCT user_id) AS n_users, count(DISTINCT business_id) AS n_items, count(*) AS n_ratings,
    true AS has_user_features, true AS has_item_features FROM split WHERE split = 'train'""")
def a32_model_info(spark, d):
    from placerank.models.hybrid import model_info
    train = train_test(spark, d).filter(F.col("split") == "train")
    return model_info(train, HYBRID, True, True)
