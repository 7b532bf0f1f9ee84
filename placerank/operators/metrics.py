"""Prediction quality: error metrics, ranking metrics and chart tables.

``predictions`` columns: user_id, business_id, actual_rating, predicted_rating.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerank.models.common import materialize
from placerank.sources.reference_values import METRIC_KS, RELEVANCE_THRESHOLD


def with_error(predictions: DataFrame) -> DataFrame:
    """P16 - adds ``prediction_error = actual - predicted``."""
    return predictions.withColumn("prediction_error", F.col("actual_rating") - F.col("predicted_rating"))


def rmse_mae(predictions: DataFrame) -> DataFrame:
    """A27 - one row: rmse, mae, n."""
    e = F.col("actual_rating") - F.col("predicted_rating")
    return predictions.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                           F.count(F.lit(1)).alias("n"))


def mae_by_rating(predictions: DataFrame) -> DataFrame:
    """A28 - mean absolute error per actual rating."""
    return predictions.groupBy("actual_rating").agg(
        F.avg(F.abs(F.col("actual_rating") - F.col("predicted_rating"))).alias("mae"),
        F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """A29 - equal-width histogram between the column's min and max (nulls dropped) with empty bins:
    (bin, lo, hi, n, mean), mean being that of the whole column; the max value falls in the last bin. No value, no rows."""
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    st = x.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))).scalar()
    width = (st["hi"] - st["lo"]) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col("x") - st["lo"]) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = x.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # one row holding the counts of the (few) bins, laid out over all bins
    held = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")).filter(F.size("m") > 0)
    every = held.select("m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.select("bin", (st["lo"] + F.col("bin") * width).alias("lo"), (st["lo"] + (F.col("bin") + 1) * width).alias("hi"),
                        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("long").alias("n"), st["mean"].alias("mean"))


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """Exact median (mean of the two middle values for an even count), distributed.

    Values are counted per distinct value (partial aggregation), range-partitioned, and
    cumulative counts come from per-partition sums plus a broadcast offset table with one
    row per partition - no task sees more than its own range.  -> one row (median, n).
    """
    x = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = (x.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
              .repartitionByRange("v").withColumn("_pid", F.spark_partition_id()))
    local = counts.withColumn("_cum", F.sum("c").over(
        Window.partitionBy("_pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    local = materialize(local)   # partition numbers are read twice below and must be the same ones
    sizes = local.groupBy("_pid").agg(F.sum("c").alias("_s"))
    offs = sizes.select("_pid", F.coalesce(F.sum("_s").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    cum = local.join(F.broadcast(offs), "_pid").select("v", "c", (F.col("_off") + F.col("_cum")).alias("cum"))
    n = x.agg(F.count(F.lit(1))).scalar()
    lo_rank, hi_rank = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)   # 0-based ranks of the middle values
    # value at 0-based rank r is the v with cum - c <= r < cum
    at = lambda r: F.when((F.col("cum") - F.col("c") <= r) & (r < F.col("cum")), F.col("v"))
    return cum.agg(((F.max(at(lo_rank)) + F.max(at(hi_rank))) / 2).alias("median"), F.max(F.lit(n)).alias("n"))


def precision_recall_at_k(predictions: DataFrame, ks: list[int] | None = None,
                          threshold: float = RELEVANCE_THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    """W2 - mean precision@k and recall@k over users, all k (and all values of the columns ``by``) in one pass
    -> (*by, k, precision, recall).

    Per user: rank by predicted rating desc (ties: business_id, then actual rating); only the top max(k) rows
    per user are ranked (Spark prunes each partition to that many rows before the
    shuffle), while the relevant count uses all of the user's rows via a partial aggregate.
    """
    ks = sorted(ks or METRIC_KS)
    kmax, keys = ks[-1], [*by, "user_id"]
    w = Window.partitionBy(*keys).orderBy(F.col("predicted_rating").desc(), F.col("business_id"),
                                          F.col("actual_rating"))
    top = predictions.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= kmax)
    rec = F.col("predicted_rating") >= threshold
    rel = F.col("actual_rating") >= threshold
    per_user = top.groupBy(*keys).agg(
        *[F.count(F.when((F.col("_rn") <= k) & rec, 1)).alias(f"rec{k}") for k in ks],
        *[F.count(F.when((F.col("_rn") <= k) & rec & rel, 1)).alias(f"hit{k}") for k in ks])
    n_rel = predictions.groupBy(*keys).agg(F.count(F.when(rel, 1)).alias("n_rel"))
    j = per_user.join(n_rel, keys)
    aggs = []
    for k in ks:
        aggs.append(F.avg(F.when(F.col(f"rec{k}") > 0, F.col(f"hit{k}") / F.col(f"rec{k}"))
                          .otherwise(F.lit(0.0))).alias(f"p{k}"))
        aggs.append(F.avg(F.when(F.col("n_rel") > 0, F.col(f"hit{k}") / F.col("n_rel"))
                          .otherwise(F.lit(0.0))).alias(f"r{k}"))
    wide = j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("precision"), F.col(f"r{k}").alias("recall"))
        for k in ks])).alias("m")).select(*by, "m.k", "m.precision", "m.recall")


def evaluate(predictions: DataFrame, ks: list[int] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Metric table (*by, metric, value): RMSE, MAE and Precision@k / Recall@k. With ``by=("model",)`` it is the
    comparison of all models of a prediction table in one pass (M14)."""
    e = F.col("actual_rating") - F.col("predicted_rating")
    err = predictions.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    e = err.select(*by, F.explode(F.array(F.struct(F.lit("RMSE").alias("metric"), F.col("rmse").alias("value")),
                                          F.struct(F.lit("MAE").alias("metric"), F.col("mae").alias("value")))).alias("m"))
    pr = precision_recall_at_k(predictions, ks, by=by)
    p = pr.select(*by, F.explode(F.array(
        F.struct(F.concat(F.lit("Precision@"), F.col("k").cast("string")).alias("metric"),
                 F.col("precision").alias("value")),
        F.struct(F.concat(F.lit("Recall@"), F.col("k").cast("string")).alias("metric"),
                 F.col("recall").alias("value")))).alias("m"))
    return e.select(*by, "m.metric", "m.value").unionByName(p.select(*by, "m.metric", "m.value"))


def grid_pivot(results: DataFrame) -> DataFrame:
    """A30 - grid results (alpha, beta, rmse) as alpha rows x beta columns."""
    return results.groupBy("alpha").pivot("beta").agg(F.first("rmse"))


def compare_models(metrics: DataFrame) -> DataFrame:
    """A31 - (model, metric, value) -> per metric the best model (lowest RMSE/MAE, highest
    otherwise; ties: model name) and the heat-map score (1/(1+x) for error metrics)."""
    lower = F.col("metric").isin("RMSE", "MAE")
    key = F.when(lower, F.col("value")).otherwise(-F.col("value"))
    return metrics.groupBy("metric").agg(
        F.min_by("model", F.struct(key, F.col("model"))).alias("best_model"),
        F.min_by("value", F.struct(key, F.col("model"))).alias("best_value"))


def heat_scores(metrics: DataFrame) -> DataFrame:
    """A31 heat-map variant: error metrics mapped to 1 / (1 + x), others unchanged."""
    lower = F.col("metric").isin("RMSE", "MAE")
    return metrics.withColumn("score", F.when(lower, 1.0 / (1.0 + F.col("value"))).otherwise(F.col("value")))
