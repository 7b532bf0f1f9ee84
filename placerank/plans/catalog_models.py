"""Registered queries: model training jobs on the fixture split."""
from __future__ import annotations

from pyspark.sql import functions as F

from placerank.models import baseline
from placerank.plans.catalog_scoring import MODEL, split_rows
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources.fixture_sql import ctes

BASELINE_EPOCHS = 20   # the reference's comparison run


def _baseline_sql(epochs: int) -> str:
    parts = ["""r_ AS (SELECT user_id, business_id, CAST(stars AS DOUBLE) AS r FROM split WHERE split = 'train')""",
             "mu AS (SELECT avg(r) AS mu FROM r_)",
             "bu0 AS (SELECT DISTINCT user_id, 0.0 AS bu FROM r_)"]
    for e in range(1, epochs + 1):
        parts.append(f"""bi{e} AS (SELECT r_.business_id, sum(r_.r - (SELECT mu FROM mu) - b.bu) / (10.0 + count(*))
            AS bi FROM r_ JOIN bu{e - 1} b ON r_.user_id = b.user_id GROUP BY r_.business_id)""")
        parts.append(f"""bu{e} AS (SELECT r_.user_id, sum(r_.r - (SELECT mu FROM mu) - b.bi) / (15.0 + count(*))
            AS bu FROM r_ JOIN bi{e} b ON r_.business_id = b.business_id GROUP BY r_.user_id)""")
    return ",\n    ".join(parts)


@query("m9_bias_baseline", sql_round(ctes("reviews", extra=MODEL + ",\n    " + _baseline_sql(BASELINE_EPOCHS))
                                     + f"""SELECT s.user_id, s.business_id, CAST(s.stars AS DOUBLE) AS actual_rating,
    least(greatest((SELECT mu FROM mu) + coalesce(u.bu, 0.0) + coalesce(i.bi, 0.0), 1.0), 5.0) AS predicted_rating
    FROM split s LEFT JOIN bu{BASELINE_EPOCHS} u ON s.user_id = u.user_id
    LEFT JOIN bi{BASELINE_EPOCHS} i ON s.business_id = i.business_id WHERE s.split = 'test'""", ["predicted_rating"]))
def m9_bias_baseline(spark, d):
    tt = split_rows(spark, d)
    m = baseline.fit_baseline(tt.filter(F.col("split") == "train"), n_epochs=BASELINE_EPOCHS)
    return round_doubles(baseline.predict_baseline(m, tt.filter(F.col("split") == "test")))


# ---- hybrid model (rows-only checks: a different optimiser than the reference) ----
from placerank.models import als, hybrid  # noqa: E402
from placerank.models.common import materialize  # noqa: E402
from placerank.operators import metrics, prepare as pr, score  # noqa: E402
from placerank.plans.catalog_prepare import f4_business_features_prepared, f5_user_features_prepared  # noqa: E402
from placerank.plans.catalog_scoring import M3_SQL, fixture_model  # noqa: E402

HYBRID = hybrid.HybridParams(n_factors=50, n_epochs=5, reg=0.02, alpha=1e-3, beta=1e-3, seed=23)


def side_features(spark, d):
    """The prepared user and business tables (F5, F4) as one vector per id, of all columns but the id."""
    def vectors(t, key):
        cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in t.columns if c != key]
        return materialize(t.select(key, F.array(*cols).alias("features")))   # read several times by a fit

    return vectors(f5_user_features_prepared(spark, d), "user_id"), vectors(f4_business_features_prepared(spark, d), "business_id")


def fit_fixture_hybrid(spark, d, params=HYBRID, tt=None):
    tt = split_rows(spark, d) if tt is None else tt
    uf, bf = side_features(spark, d)
    return tt, hybrid.fit_hybrid(tt.filter(F.col("split") == "train"), params, uf, bf)


@query("m1_hybrid_test_metrics")
def m1_hybrid_test_metrics(spark, d):
    tt, m = fit_fixture_hybrid(spark, d)
    preds = score.predict_test(m.factor_model(), tt.filter(F.col("split") == "test"))
    return round_doubles(metrics.evaluate(preds))


@query("m2_hybrid_history")
def m2_hybrid_history(spark, d):
    _, m = fit_fixture_hybrid(spark, d)
    return m.history_frame(spark)


@query("m10_biased_mf_test_metrics")
def m10_biased_mf_test_metrics(spark, d):
    tt = split_rows(spark, d)
    fitted = als.fit_biased_mf(tt.filter(F.col("split") == "train"), rank=50, max_iter=20, reg=0.02, seed=23,
                               baseline_epochs=BASELINE_EPOCHS)
    return round_doubles(metrics.evaluate(als.predict_biased_mf(fitted, tt.filter(F.col("split") == "test"))))


@query("m12_nmf_test_metrics")
def m12_nmf_test_metrics(spark, d):
    tt = split_rows(spark, d)
    fitted = als.fit_nmf(tt.filter(F.col("split") == "train"), rank=50, max_iter=50, seed=23)
    return round_doubles(metrics.evaluate(als.predict_nmf(fitted, tt.filter(F.col("split") == "test"))))


# ---- what of these two SQL can follow: the residuals that ALS gets, and its last half step at rank 1 ----
@query("m10_residuals", sql_round(ctes("reviews", extra=MODEL + ",\n    " + _baseline_sql(10)) + """SELECT r_.user_id, r_.business_id,
    r_.r - (SELECT mu FROM mu) - u.bu - i.bi AS res FROM r_ JOIN bu10 u ON r_.user_id = u.user_id JOIN bi10 i ON r_.business_id = i.business_id""",
    ["res"]))
def m10_residuals(spark, d):
    train = split_rows(spark, d).filter(F.col("split") == "train")
    return round_doubles(als.residuals(baseline.fit_baseline(train, n_epochs=10), train).select("user_id", "business_id", "res"))


def _half_steps(spark, d, nonnegative):
    """(user_id, solved): whether a user's factor solves the last half step, to the precision of 32-bit factors."""
    train = split_rows(spark, d).filter(F.col("split") == "train")
    if nonnegative:
        _, model, users, items = als.fit_nmf(train, rank=1, max_iter=5, reg=0.06, seed=23)
        value = F.col("stars").cast("double")
    else:
        base, model, users, items = als.fit_biased_mf(train, rank=1, max_iter=5, reg=0.02, seed=23, baseline_epochs=5)
        train, value = als.residuals(base, train), F.col("res")
    rows = train.join(users, "user_id").join(items, "business_id").select("uix", "iix", value.alias("value"))
    gap = als.half_step_gap(model, rows, 0.06 if nonnegative else 0.02, nonnegative)
    return gap.join(users, "uix").select("user_id", (F.col("gap") < 1e-3).alias("solved"))


_SOLVED = ctes("reviews", extra=MODEL) + "SELECT DISTINCT user_id, true AS solved FROM split WHERE split = 'train'"


@query("m10_half_step", _SOLVED)
def m10_half_step(spark, d):
    return _half_steps(spark, d, False)


@query("m12_half_step", _SOLVED)
def m12_half_step(spark, d):
    return _half_steps(spark, d, True)


# ---- model comparison over the SQL-expressible models (exact oracle) ----
def _compare_predictions(spark, d):
    tt = split_rows(spark, d)
    test = tt.filter(F.col("split") == "test")
    base = baseline.fit_baseline(tt.filter(F.col("split") == "train"), n_epochs=BASELINE_EPOCHS)
    p1 = baseline.predict_baseline(base, test).withColumn("model", F.lit("Baseline"))
    p2 = score.predict_test(fixture_model(spark, d, tt), test).withColumn("model", F.lit("Fixed factors"))
    return materialize(p1.unionByName(p2))   # read once per model


def model_metrics(preds):
    """M14 - (model, metric, value) for a union of prediction tables keyed by model."""
    return metrics.evaluate(preds, by=("model",))


KS = [5, 10, 20, 30, 50]


def _per_user_ctes(src: str) -> str:
    """Ranking CTEs for one prediction table (same rules as metrics.precision_recall_at_k)."""
    cols = ", ".join(f"count(CASE WHEN rn <= {k} AND predicted_rating >= 3.5 THEN 1 END) AS rec{k}, "
                     f"count(CASE WHEN rn <= {k} AND predicted_rating >= 3.5 AND actual_rating >= 3.5 THEN 1 END)"
                     f" AS hit{k}" for k in KS)
    return f"""rk_{src} AS (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY predicted_rating DESC, business_id, actual_rating) AS rn FROM {src}),
    pu_{src} AS (SELECT user_id, {cols}, count(CASE WHEN actual_rating >= 3.5 THEN 1 END) AS n_rel
        FROM rk_{src} GROUP BY user_id)"""


def _metric_selects(name: str, src: str) -> list[str]:
    out = [f"SELECT '{name}' AS model, 'RMSE' AS metric, sqrt(avg(pow(actual_rating - predicted_rating, 2))) AS value"
           f" FROM {src}",
           f"SELECT '{name}', 'MAE', avg(abs(actual_rating - predicted_rating)) FROM {src}"]
    for k in KS:
        out.append(f"SELECT '{name}', 'Precision@{k}', avg(CASE WHEN rec{k} > 0 THEN hit{k} / rec{k} ELSE 0.0 END)"
                   f" FROM pu_{src}")
        out.append(f"SELECT '{name}', 'Recall@{k}', avg(CASE WHEN n_rel > 0 THEN hit{k} / n_rel ELSE 0.0 END)"
                   f" FROM pu_{src}")
    return out


def _cmp_full_sql():
    base = f"""SELECT s.user_id, s.business_id, CAST(s.stars AS DOUBLE) AS actual_rating,
        least(greatest((SELECT mu FROM mu) + coalesce(u.bu, 0.0) + coalesce(i.bi, 0.0), 1.0), 5.0) AS predicted_rating
        FROM split s LEFT JOIN bu{BASELINE_EPOCHS} u ON s.user_id = u.user_id
        LEFT JOIN bi{BASELINE_EPOCHS} i ON s.business_id = i.business_id WHERE s.split = 'test'"""
    extra = (MODEL + ",\n    " + _baseline_sql(BASELINE_EPOCHS) + f",\n    pb AS ({base}),\n    pf AS ({M3_SQL}),\n    "
             + _per_user_ctes("pb") + ",\n    " + _per_user_ctes("pf"))
    selects = _metric_selects("Baseline", "pb") + _metric_selects("Fixed factors", "pf")
    return ctes("reviews", extra=extra), "\n    UNION ALL ".join(selects)


_CMP_CTES, _CMP_UNION = _cmp_full_sql()


@query("m14_compare_models", sql_round(_CMP_CTES + _CMP_UNION, ["value"]))
def m14_compare_models(spark, d):
    return round_doubles(model_metrics(_compare_predictions(spark, d)))


@query("a31_best_model_per_metric", sql_round(_CMP_CTES + f""", mm AS ({_CMP_UNION}),
    keyed AS (SELECT *, CASE WHEN metric IN ('RMSE', 'MAE') THEN value ELSE -value END AS key FROM mm)
    SELECT metric, model AS best_model, value AS best_value FROM (
        SELECT *, row_number() OVER (PARTITION BY metric ORDER BY key, model) AS rn FROM keyed) WHERE rn = 1""",
    ["best_value"]))
def a31_best_model_per_metric(spark, d):
    mm = model_metrics(_compare_predictions(spark, d))
    return round_doubles(metrics.compare_models(mm))


# ---- all models of one prediction table: five given models, one of them without predictions for some users ----
FIVE = ["Baseline", "Hybrid", "NMF", "SVD", "SVD++"]


def five_predictions(spark, d):
    """Every review with the estimate of each of five models, (user_id * 31 + business_id * 17 * m) spread over about 1 to 5."""
    r = fx.reviews(spark, d)
    each = r.select("user_id", "business_id", F.col("stars").cast("double").alias("actual_rating"),
                    F.posexplode(F.array(*[F.lit(m) for m in FIVE])).alias("m", "model"))
    est = F.lit(1.0) + ((F.col("user_id") * 31 + F.col("business_id") * 17 * (F.col("m") + 1)) % 397) / F.lit(99.7)
    return each.filter(~((F.col("model") == "NMF") & (F.col("user_id") % 10 == 0))).select(
        "model", "user_id", "business_id", "actual_rating", est.alias("predicted_rating"))


FIVE_SQL = "preds AS (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, user_id, business_id, CAST(stars AS DOUBLE) AS actual_rating,
        1.0 + ((user_id * 31 + business_id * 17 * {i + 1}) % 397) / CAST(99.7 AS DOUBLE) AS predicted_rating FROM reviews"""
    + (" WHERE user_id % 10 <> 0" if m == "NMF" else "") for i, m in enumerate(FIVE)) + ")"
_HITS = ", ".join(f"count(CASE WHEN rn <= {k} AND predicted_rating >= 3.5 THEN 1 END) AS rec{k}, "
                  f"count(CASE WHEN rn <= {k} AND predicted_rating >= 3.5 AND actual_rating >= 3.5 THEN 1 END) AS hit{k}" for k in KS)
_FIVE_METRICS = " UNION ALL ".join(
    ["SELECT model, 'RMSE' AS metric, sqrt(avg(pow(actual_rating - predicted_rating, 2))) AS value FROM preds GROUP BY model",
     "SELECT model, 'MAE', avg(abs(actual_rating - predicted_rating)) FROM preds GROUP BY model"]
    + [f"SELECT model, 'Precision@{k}', avg(CASE WHEN rec{k} > 0 THEN hit{k} / rec{k} ELSE 0.0 END) FROM pu GROUP BY model" for k in KS]
    + [f"SELECT model, 'Recall@{k}', avg(CASE WHEN n_rel > 0 THEN hit{k} / n_rel ELSE 0.0 END) FROM pu GROUP BY model" for k in KS])
FIVE_CTES = ctes("reviews", extra=FIVE_SQL + f""",
    rk AS (SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY predicted_rating DESC, business_id, actual_rating) AS rn FROM preds),
    pu AS (SELECT model, user_id, {_HITS}, count(CASE WHEN actual_rating >= 3.5 THEN 1 END) AS n_rel FROM rk GROUP BY model, user_id),
    mm AS ({_FIVE_METRICS})""")


@query("m14_five_models", sql_round(FIVE_CTES + "SELECT * FROM mm", ["value"]))
def m14_five_models(spark, d):
    return round_doubles(model_metrics(five_predictions(spark, d)))


@query("a31_best_of_five_models", sql_round(FIVE_CTES + """, keyed AS (
        SELECT *, CASE WHEN metric IN ('RMSE', 'MAE') THEN value ELSE -value END AS key FROM mm)
    SELECT metric, model AS best_model, value AS best_value FROM (
        SELECT *, row_number() OVER (PARTITION BY metric ORDER BY key, model) AS rn FROM keyed) WHERE rn = 1""", ["best_value"]))
def a31_best_of_five_models(spark, d):
    return round_doubles(metrics.compare_models(model_metrics(five_predictions(spark, d))))


@query("a31_heat_scores", sql_round(FIVE_CTES + """SELECT model, metric, value,
    CASE WHEN metric IN ('RMSE', 'MAE') THEN 1.0 / (1.0 + value) ELSE value END AS score FROM mm""", ["value", "score"]))
def a31_heat_scores(spark, d):
    return round_doubles(metrics.heat_scores(model_metrics(five_predictions(spark, d))))


# ---- grid search over the reference's alpha x beta grid (rows-only) ----
GRID_ALPHAS, GRID_BETAS = [0.001, 0.01, 0.1], [0.003, 0.01]
GRID_BASE = hybrid.HybridParams(n_factors=50, n_epochs=10, reg=0.05, seed=23)


def _grid(spark, d):
    tt = split_rows(spark, d)
    uf, bf = side_features(spark, d)
    return hybrid.grid_search(tt.filter(F.col("split") == "train"), tt.filter(F.col("split") == "test"),
                              GRID_BASE, GRID_ALPHAS, GRID_BETAS, uf, bf)


@query("m8_grid_search")
def m8_grid_search(spark, d):
    return round_doubles(_grid(spark, d))


@query("a30_grid_pivot")
def a30_grid_pivot(spark, d):
    return round_doubles(metrics.grid_pivot(_grid(spark, d)))


# ---- SVD++ (rows-only) ----
from placerank.models import svdpp  # noqa: E402

SVDPP = svdpp.SvdppParams(n_factors=50, n_epochs=20, reg=0.02, seed=23)


@query("m11_svdpp_test_metrics")
def m11_svdpp_test_metrics(spark, d):
    tt = split_rows(spark, d)
    m = svdpp.fit_svdpp(tt.filter(F.col("split") == "train"), SVDPP)
    return round_doubles(metrics.evaluate(svdpp.predict_svdpp(m, tt.filter(F.col("split") == "test"))))


# ---- model comparison over the fitted models (rows-only; the queries with SQL twins compare what SQL can express) ----
def _fitted_predictions(spark, d):
    tt = split_rows(spark, d)
    train, test = tt.filter(F.col("split") == "train"), tt.filter(F.col("split") == "test")
    # the baseline of the comparison is the one that the matrix factorisation starts from: one fit serves both
    base = baseline.fit_baseline(train, n_epochs=BASELINE_EPOCHS)
    mf = als.fit_biased_mf(train, rank=50, max_iter=20, reg=0.02, seed=23, base=base)
    preds = {"Baseline": baseline.predict_baseline(base, test),
             "SVD": als.predict_biased_mf(mf, test),
             "SVD++": svdpp.predict_svdpp(svdpp.fit_svdpp(train, SVDPP), test),
             "NMF": als.predict_nmf(als.fit_nmf(train, rank=50, max_iter=50, seed=23), test),
             "Hybrid": score.predict_test(fit_fixture_hybrid(spark, d, tt=tt)[1].factor_model(), test)}
    out = None
    for name, p in preds.items():
        p = p.select("user_id", "business_id", "actual_rating", "predicted_rating", F.lit(name).alias("model"))
        out = p if out is None else out.unionByName(p)
    return materialize(out)   # read once per model


@query("m14_compare_fitted_models")
def m14_compare_fitted_models(spark, d):
    return round_doubles(model_metrics(_fitted_predictions(spark, d)))


@query("a31_best_fitted_model_per_metric")
def a31_best_fitted_model_per_metric(spark, d):
    return round_doubles(metrics.compare_models(model_metrics(_fitted_predictions(spark, d))))
