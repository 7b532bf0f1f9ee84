"""User feature table.

The whole table (``user_feature_table``) starts from the reviews summed by user and business; the single
statistics below it have functions of their own.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.functions.expr import bounded_broadcast, category_tokens, elapsed_days, elite_years, price_level
from placerank.models.common import materialize
from placerank.sources.reference_values import GENERIC_CATEGORIES


def user_category_counts(reviews: DataFrame, business: DataFrame,
                         generic: list[str] | None = None) -> DataFrame:
    """A9 - (user_id, category, n): category mentions over a user's reviews, without the
    generic categories."""
    generic = GENERIC_CATEGORIES if generic is None else generic
    cats = business.select("business_id", F.explode(category_tokens("categories")).alias("category"))
    return (reviews.select("user_id", "business_id")
            .join(cats, "business_id")
            .filter(~F.col("category").isin(*generic))
            .groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n")))


def user_group_ratios(counts: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """A10 - per user and group: mentions of the group's categories / all mentions.

    ``groups(group, category)`` is a small input table (broadcast after a size check); a category listed twice
    in a group counts twice, as in the reference.  -> (user_id, <group>_ratio ...).
    """
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("_total"))
    per_group = (counts.join(bounded_broadcast(groups.select("group", F.lower("category").alias("category"))),
                             "category")
                 .groupBy("user_id").pivot("group", names).agg(F.sum("n")))
    return (totals.join(per_group, "user_id", "left")
            .select("user_id", *[(F.coalesce(F.col(n), F.lit(0)) / F.col("_total")).alias(f"{n}_ratio")
                                 for n in names]))


def user_top_category(counts: DataFrame) -> DataFrame:
    """A11 - most mentioned category per user (ties: smallest name) and its share."""
    return counts.groupBy("user_id").agg(
        F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"),
        (F.max("n") / F.sum("n")).alias("top_category_ratio"))


def user_review_features(reviews_loc: DataFrame, business: DataFrame, users: DataFrame,
                         price_col: str = "price_raw") -> DataFrame:
    """A12-A16 in one aggregation per user.

    ``reviews_loc`` carries ``is_local`` and ``business_city`` (``locality.reviews_with_locality``).
    -> (user_id, rating_variance, local_review_ratio, days_since_last_review, review_frequency,
        avg_price_preference, num_cities_reviewed), one row per user of ``users``.
    """
    last_any = reviews_loc.agg(F.max("date")).scalar()
    price = business.select("business_id", price_level(price_col).alias("_price"))
    per_user = (reviews_loc.join(price, "business_id", "left")
                .groupBy("user_id").agg(
                    F.stddev_samp("stars").alias("rating_variance"),
                    F.avg(F.col("is_local").cast("double")).alias("local_review_ratio"),
                    F.min("date").alias("_first"), F.max("date").alias("_last"),
                    F.avg(F.coalesce("_price", F.lit(2.0))).alias("avg_price_preference"),
                    F.count_distinct("business_city").alias("num_cities_reviewed")))
    days_active = elapsed_days("_first", "_last")
    days_active = F.when(days_active == 0, F.lit(1)).otherwise(days_active)
    return (users.select("user_id", "review_count").join(per_user, "user_id", "left")
            .select("user_id", "rating_variance",
                    F.coalesce("local_review_ratio", F.lit(0.0)).alias("local_review_ratio"),
                    elapsed_days("_last", last_any).alias("days_since_last_review"),
                    (F.col("review_count") / days_active).alias("review_frequency"),
                    "avg_price_preference",
                    F.coalesce("num_cities_reviewed", F.lit(1)).alias("num_cities_reviewed")))


def user_feature_table(users: DataFrame, reviews: DataFrame, business: DataFrame, groups: DataFrame,
                       names: list[str], sentiment: DataFrame | None = None) -> DataFrame:
    """The full user feature table: users + A1 (``base_city``) + P8 + A5 + A10 + A11 + A12-A16 (left joins on
    user_id; missing ratios -> 0, missing top category -> null / 0).

    The reviews are read once: they are summed by user and business, the business is joined to the sums, and that
    table gives the statistics (by user and city, then by user) and the category counts. Sums of squares of ratings
    are exact for whole stars.
    """
    pairs = reviews.groupBy("user_id", "business_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stars").alias("s"), F.sum(F.col("stars") * F.col("stars")).alias("ss"),
        F.min("date").alias("first"), F.max("date").alias("last"))
    dim = business.select("business_id", "city", price_level("price_raw").alias("price"), category_tokens("categories").alias("tokens"))
    pairs = materialize(pairs.join(dim, "business_id", "left"))
    by_city = pairs.groupBy("user_id", "city").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum(F.col("n") * F.coalesce("price", F.lit(2.0))).alias("price"))
    rank = F.struct(F.col("city").isNull(), -F.col("n"), F.col("city"))
    st = by_city.groupBy("user_id").agg(
        F.min_by("city", rank).alias("base_city"), F.min_by(F.when(F.col("city").isNotNull(), F.col("n")).otherwise(0), rank).alias("_local"),
        *[F.sum(c).alias(f"_{c}") for c in ("n", "s", "ss", "price")], F.min("first").alias("_first"), F.max("last").alias("_last"),
        F.count("city").alias("num_cities_reviewed"))
    n, spread = F.col("_n").cast("double"), F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n").cast("double")
    st = st.select("user_id", "base_city", "_first", "_last", "num_cities_reviewed", (F.col("_local") / n).alias("local_review_ratio"),
                   (F.col("_price") / n).alias("avg_price_preference"),
                   F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("rating_variance"))

    counts = (pairs.select("user_id", "n", F.explode("tokens").alias("category")).filter(~F.col("category").isin(*GENERIC_CATEGORIES))
              .groupBy("user_id", "category").agg(F.sum("n").alias("n")))
    # how often a group lists a category: one map from "group, category" to the number
    listed = groups.groupBy("group", F.lower("category").alias("category")).agg(F.count("*").alias("c"))
    times = listed.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(", ", "group", "category"), "c")))).scalar()
    counts = counts.withColumn("_times", times)
    in_group = {g: F.coalesce(F.try_element_at("_times", F.concat(F.lit(f"{g}, "), F.col("category"))), F.lit(0)) for g in names}
    cats = counts.groupBy("user_id").agg(
        F.sum("n").alias("_mentions"), F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"), F.max("n").alias("_top"),
        *[F.sum(F.col("n") * c).alias(g) for g, c in in_group.items()])
    cats = cats.select("user_id", "top_category", (F.col("_top") / F.col("_mentions")).alias("top_category_ratio"),
                       *[(F.col(g) / F.col("_mentions")).alias(f"{g}_ratio") for g in names])

    days = elapsed_days("_first", "_last")
    last_any = pairs.agg(F.max("last")).scalar()
    out = users.withColumn("years_elite", elite_years("elite")).join(st, "user_id", "left").join(cats, "user_id", "left")
    out = (out.withColumn("days_since_last_review", elapsed_days("_last", last_any))
           .withColumn("review_frequency", F.col("review_count") / F.when(days == 0, F.lit(1)).otherwise(days))
           .withColumn("num_cities_reviewed", F.coalesce("num_cities_reviewed", F.lit(1))).drop("_first", "_last"))
    out = out.fillna(0.0, subset=[f"{g}_ratio" for g in names] + ["top_category_ratio", "local_review_ratio"])
    if sentiment is not None:
        scored = reviews.select("review_id", "user_id").join(sentiment.select("review_id", "vader_compound"), "review_id")
        out = out.join(scored.groupBy("user_id").agg(F.avg("vader_compound").alias("avg_sentiment")), "user_id", "left")
    return out
