"""Model-ready tables: activity filter, scaling, encoding, split, vectors.

Column statistics are scalar subqueries (``DataFrame.scalar()``) - Spark merges
the ones over the same input into one aggregate job and never cross-joins.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerank.functions.expr import elapsed_days, to_ts
from placerank.models.common import materialize


# ---------------------------------------------------------------- A20-A22
def filter_activity(reviews: DataFrame, min_user_reviews: int = 20, min_business_reviews: int = 50,
                    order: str = "business_first", step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A20 - keep reviews of popular businesses and active users.

    ``business_first`` (reference default): business counts on all reviews, then user counts
    on the reviews that are left.  ``independent``: both counts on the raw reviews.  ``step`` is applied to the reviews
    of popular businesses, which are read twice: ``materialize`` computes them once.
    """
    biz = (reviews.groupBy("business_id").agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") >= min_business_reviews).select("business_id"))
    kept = step(reviews.join(biz, "business_id", "left_semi"))
    base = kept if order == "business_first" else reviews
    usr = (base.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") >= min_user_reviews).select("user_id"))
    return kept.join(usr, "user_id", "left_semi")


def dataset_stats(reviews: DataFrame) -> DataFrame:
    """A21 - users, businesses, reviews and sparsity 1 - n / (users * businesses)."""
    s = reviews.agg(F.count_distinct("user_id").alias("n_users"),
                    F.count_distinct("business_id").alias("n_businesses"),
                    F.count(F.lit(1)).alias("n_reviews"))
    return s.withColumn("sparsity", F.lit(1.0) - F.try_divide(
        F.col("n_reviews").cast("double"), (F.col("n_users") * F.col("n_businesses")).cast("double")))


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """A22 - review count per star value."""
    return reviews.groupBy("stars").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- F1-F3
def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """F1 - (x - mean) / population std per column; a constant column becomes 0.

    All means and deviations come from one aggregate (a single scalar subquery).
    """
    if not cols:
        return df
    st = df.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                         *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])).scalar()
    scaled = {c: F.when(st[f"s{i}"] > 0, (F.col(c) - st[f"m{i}"]) / st[f"s{i}"]).otherwise(F.lit(0.0))
              for i, c in enumerate(cols)}
    return df.withColumns(scaled)


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """F1 - the statistics of a fit as a table (column, mean, std), one row a column, to be kept and applied to other
    rows; std is that of the population. Nulls count as 0, as in the prepared tables."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    st = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")) for c, v in x.items()]).alias("s"))
    return st.select(F.explode("s").alias("s")).select("s.*")


def _scaled(value, stats, col: str):
    """A value under stored statistics; a constant column becomes 0, one without statistics stays as it is."""
    st = F.try_element_at(stats, F.lit(col))
    return F.when(st.isNull(), value).when(st["std"] > 0, (value - st["mean"]) / st["std"]).otherwise(F.lit(0.0))


def _by_column(stats: DataFrame):
    entry = F.struct("column", F.struct("mean", "std"))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()   # one entry a column


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """F1 - (x - mean) / std with the statistics of an earlier fit (``fit_scaler``); nulls count as 0."""
    df = df.withColumn("_st", _by_column(stats))   # one subquery for all columns
    return df.withColumns({c: _scaled(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col("_st"), c) for c in cols}).drop("_st")


def dense_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rank (from 0) of every distinct non-null value of each column, in sorted order:
    -> (column, value, code); ``cols`` must share one data type.

    Distributed: the (column, value) pairs are range-partitioned and sorted; each partition
    numbers its values per column, and a per-(partition, column) offset table - bounded by
    partitions x columns rows, so it is broadcast - turns local numbers into global codes.
    No task ever holds a whole column domain.
    """
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]))
    d = (df.select(kv.alias("kv")).select("kv.column", "kv.value").filter(F.col("value").isNotNull())
         .distinct().repartitionByRange("column", "value").withColumn("_pid", F.spark_partition_id()))
    part = Window.partitionBy("_pid", "column")
    d = (d.withColumn("_local", F.row_number().over(part.orderBy("value")))
         .withColumn("_cnt", F.count(F.lit(1)).over(part)))
    d = materialize(d)   # partition numbers are read twice below and must be the same ones
    sizes = d.groupBy("_pid", "column").agg(F.max("_cnt").alias("_cnt"))
    offsets = sizes.select("_pid", "column", F.coalesce(F.sum("_cnt").over(
        Window.partitionBy("column").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offsets), ["_pid", "column"])
            .select("column", "value", (F.col("_off") + F.col("_local") - 1).cast("int").alias("code")))


def label_encode(df: DataFrame, cols: list[str], suffix: str = "", null_code: int = -1) -> DataFrame:
    """F2 - replace (or add ``<c><suffix>``) each categorical column by its dense code;
    null -> ``null_code``.  One code table per data type; each column is then looked up
    with an equi-join (AQE broadcasts the code table when it is small)."""
    types = dict(df.dtypes)
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(types[c], []).append(c)
    out = df
    for group in by_type.values():
        codes = materialize(dense_codes(df, group))   # small (distinct values); read once per column
        for c in group:
            look = codes.filter(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            out = (out.join(look, out[c].eqNullSafe(look["_v"]), "left")
                   .withColumn(f"{c}{suffix}", F.coalesce(F.col("_code"), F.lit(null_code))).drop("_v", "_code"))
    return out


def account_age_days(users: DataFrame, since_col: str = "yelping_since") -> DataFrame:
    """F3 - whole days from a user's start date to the latest start date; bad / null -> 0."""
    ts = to_ts(since_col)
    latest = users.agg(F.max(to_ts(since_col))).scalar()
    return users.withColumn("days_yelping", F.coalesce(elapsed_days(ts, latest), F.lit(0)).cast("double"))


# ---------------------------------------------------------------- F4, F5
def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """P7 - the wanted columns that exist, in wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def prepare_business_features(business: DataFrame, reviews: DataFrame, numeric: list[str],
                              categorical: list[str]) -> DataFrame:
    """F4 - businesses present in ``reviews``; numeric fill 0 + standardise; categorical
    label-encoded (null -> -1)."""
    num, cat = available(business, numeric), available(business, categorical)
    b = (business.join(reviews.select("business_id"), "business_id", "left_semi")
         .select("business_id", *[F.col(c).cast("double").alias(c) for c in num], *cat)
         .fillna(0.0, subset=num))
    b = materialize(b)   # statistics and codes below read it several times
    return label_encode(standardize(b, num), cat)


def prepare_user_features(user_feats: DataFrame, reviews: DataFrame, numeric: list[str],
                          categorical: list[str]) -> DataFrame:
    """F5 - users present in ``reviews``; numeric fill 0 + standardise; ``<c>_encoded`` codes;
    ``days_yelping`` (F3) standardised."""
    num, cat = available(user_feats, numeric), available(user_feats, categorical)
    u = user_feats.join(reviews.select("user_id"), "user_id", "left_semi")
    since = [F.col("yelping_since").cast("string").alias("yelping_since")] if "yelping_since" in u.columns else []
    u = u.select("user_id", *[F.col(c).cast("double").alias(c) for c in num], *cat, *[c for c in since if "yelping_since" not in num + cat])
    u = materialize(u.fillna(0.0, subset=num))   # the latest date, statistics and codes below read it
    extra = []
    if since:
        u, extra = account_age_days(u).drop("yelping_since"), ["days_yelping"]
    u = standardize(u, num + extra)
    return label_encode(u, cat, suffix="_encoded").drop(*cat)


# ---------------------------------------------------------------- F6-F8
def split_train_test(ratings: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                     id_col: str = "review_id") -> DataFrame:
    """F6 - adds ``split`` ('train' / 'test') from a hash of (id, seed): independent of
    partitioning and order, and reproducible in any engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8),
               16, 10).cast("bigint")
    return ratings.withColumn("split", F.when(h % 10000 < int(round(test_fraction * 10000)), F.lit("test"))
                              .otherwise(F.lit("train")))


def feature_vectors(ids: DataFrame, feats: DataFrame, key: str, cols: list[str],
                    out: str = "features") -> DataFrame:
    """F7 - one dense ``ARRAY<DOUBLE>`` per id in ``ids`` (table column order); ids without a
    feature row get zeros."""
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return (ids.select(key).distinct().join(feats.select(key, *cols), key, "left")
            .select(key, vec.alias(out)))


def new_user_vectors(new_users: DataFrame, order: list[str], stats: DataFrame | None = None) -> DataFrame:
    """F8 - feature vectors for new users in the fixed column order; absent or null -> 0.

    With ``stats(column, mean, std)`` (``fit_scaler`` on the training users) the values are standardised;
    without it they stay unscaled, as in the reference.
    """
    have = set(new_users.columns)
    vals = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in order}
    if stats is not None:
        new_users = new_users.withColumn("_st", _by_column(stats))
        vals = {c: _scaled(v, F.col("_st"), c) for c, v in vals.items()}
    return new_users.select("user_id", F.array(*vals.values()).alias("features"))
