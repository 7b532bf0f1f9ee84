"""Business feature table.

Predicates over small word lists are array tests of the row; the review aggregates start from one
count by user and business.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.functions.expr import category_tokens, elite_years, price_level, text_to_bool
from placerank.models.common import materialize
from placerank.sources.reference_values import IMPUTED_ATTRIBUTES


def local_preference_ratio(reviews_loc: DataFrame) -> DataFrame:
    """A7 - share of a business's reviews written by locals (``is_local`` from
    ``locality.reviews_with_locality``)."""
    return reviews_loc.groupBy("business_id").agg(
        F.avg(F.col("is_local").cast("double")).alias("local_preference_ratio"))


def avg_sentiment(reviews_sent: DataFrame, key: str = "business_id",
                  score_col: str = "vader_compound") -> DataFrame:
    """A4 / A5 - mean compound sentiment per key."""
    return reviews_sent.groupBy(key).agg(F.avg(score_col).alias("avg_sentiment"))


def elite_user_ratio(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """J2 + A8 - share of a business's reviews written by elite users (elite years > 0)."""
    elite = users.filter(elite_years("elite") > 0).select("user_id", F.lit(1.0).alias("_e"))
    return (reviews.select("business_id", "user_id").join(elite, "user_id", "left")
            .groupBy("business_id").agg(F.avg(F.coalesce("_e", F.lit(0.0))).alias("elite_user_ratio")))


def tip_counts(tips: DataFrame) -> DataFrame:
    """A17 - tips per business."""
    return tips.groupBy("business_id").agg(F.count(F.lit(1)).alias("num_tips"))


def checkin_counts(checkins: DataFrame) -> DataFrame:
    """A18 - check-ins per business: number of comma-separated timestamps, summed over rows."""
    n = F.when(F.length("date") > 0, F.size(F.split("date", ","))).otherwise(F.lit(0))
    return checkins.groupBy("business_id").agg(F.sum(n).cast("long").alias("num_checkins"))


def food_places(business: DataFrame) -> DataFrame:
    """P1 - categories present and containing 'food' or 'restaurant' (case-insensitive substring)."""
    low = F.lower("categories")
    return business.filter(F.col("categories").isNotNull() & (low.contains("food") | low.contains("restaurant")))


def drop_blocked(business: DataFrame, blocked: DataFrame) -> DataFrame:
    """P2 - drop a business when any of its category tokens is in the ``blocked`` table.

    The blocklist is a small input table; it becomes one array (a scalar subquery), so the test is a predicate of
    the row and nothing is shuffled.
    """
    words = blocked.agg(F.collect_set(F.lower("category"))).scalar()
    return business.filter(~F.coalesce(F.arrays_overlap(category_tokens("categories"), words), F.lit(False)))


def group_flags(business: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """P3 - one column per category group: True when any token is in the group, else null.

    ``groups(group, category)`` is a small input table, read as one map from group to words (a scalar subquery).
    """
    words = groups.groupBy("group").agg(F.collect_set(F.lower("category")).alias("words"))
    by_group = words.agg(F.map_from_entries(F.collect_list(F.struct("group", "words")))).scalar()
    b = business.withColumn("_groups", by_group).withColumn("_tokens", category_tokens("categories"))
    return b.withColumns({n: F.when(F.arrays_overlap("_tokens", F.try_element_at("_groups", F.lit(n))), F.lit(True)) for n in names}).drop(
        "_groups", "_tokens")


def promote_attributes(business: DataFrame, keys: list[str], attr_col: str = "attributes") -> DataFrame:
    """P4 - copy chosen attribute keys to columns; text holding 'true' -> 'True', holding
    'false' -> 'False', otherwise the raw text (so the column stays STRING)."""
    return business.select("*", *[text_to_bool(F.col(attr_col)[k]).alias(k) for k in keys])


def impute(business: DataFrame, bool_cols: list[str], price_col: str = "RestaurantsPriceRange2") -> DataFrame:
    """P5 / P9 - missing flags -> False, price -> tolerant number with default 2."""
    out = business
    types = dict(business.dtypes)
    for c in bool_cols:
        if c in types:
            default = F.lit(False) if types[c] == "boolean" else F.lit("False")
            out = out.withColumn(c, F.coalesce(F.col(c), default))
    if price_col in out.columns:
        out = out.withColumn(price_col, price_level(price_col))
    return out


def user_business_counts(reviews: DataFrame, business: DataFrame) -> DataFrame:
    """(user_id, business_id, n, city) - reviews counted by user and business, with the business's city; the feature tables
    start from it, so the reviews are read once."""
    pairs = reviews.groupBy("user_id", "business_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(business.select("business_id", "city"), "business_id", "left")


def business_review_features(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """A7 + A8 from ``user_business_counts``: the user's base city (A1) and elite status meet the counts in one join, and
    one aggregation by business gives both ratios."""
    by_city = pairs.filter(F.col("city").isNotNull()).groupBy("user_id", "city").agg(F.sum("n").alias("n"))
    base = by_city.groupBy("user_id").agg(F.min_by("city", F.struct(-F.col("n"), F.col("city"))).alias("_base"))
    elite = users.filter(elite_years("elite") > 0).select("user_id", F.lit(1.0).alias("_elite"))
    who = base.join(elite, "user_id", "full")
    share = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    local = F.coalesce(F.col("city") == F.col("_base"), F.lit(False)).cast("double")
    return pairs.join(who, "user_id", "left").groupBy("business_id").agg(
        share(local).alias("local_preference_ratio"), share(F.coalesce("_elite", F.lit(0.0))).alias("elite_user_ratio"))


def business_feature_table(business: DataFrame, reviews: DataFrame, users: DataFrame, tips: DataFrame,
                           checkins: DataFrame, groups: DataFrame, blocked: DataFrame, group_names: list[str],
                           attribute_keys: list[str], sentiment: DataFrame | None = None) -> DataFrame:
    """The business feature table: P1 -> P2 -> P3 -> P4 -> P5, plus A17, A18 and the review aggregates.
    Counts default to 0, ratios stay null when a business has no reviews (as a left join leaves them)."""
    b = drop_blocked(food_places(business), blocked)
    b = promote_attributes(group_flags(b, groups, group_names), attribute_keys)
    b = impute(b, group_names + [k for k in attribute_keys if k in IMPUTED_ATTRIBUTES])
    pairs = materialize(user_business_counts(reviews, business))   # read for the base cities and for the ratios
    out = (b.join(tip_counts(tips), "business_id", "left")
           .join(checkin_counts(checkins), "business_id", "left")
           .join(business_review_features(pairs, users), "business_id", "left")
           .fillna(0, subset=["num_tips", "num_checkins"]))
    if sentiment is not None:
        scored = reviews.select("review_id", "business_id").join(sentiment.select("review_id", "vader_compound"), "review_id")
        out = out.join(avg_sentiment(scored), "business_id", "left")
    return out
