"""Registered queries: metrics on predictions, factor-model scoring and recommendations."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from placerank.models import hybrid
from placerank.models.common import discard, materialize, matvec
from placerank.operators import gem, metrics, prepare as pr, score
from placerank.plans.catalog_locality import GEM_SQL
from placerank.plans.catalog_prepare import FILTERED, MIN_BIZ, MIN_USER, filtered_reviews
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources.fixture_sql import ctes
from placerank.sources.reference_values import NEW_USER_VECTOR

K = 4            # factors of the fixture model
MU = 3.4         # its global mean
ALPHA = 0.5      # weight of the user-feature term for new users

# ---- synthetic predictions (FIXTURES.md): every review gets a deterministic estimate ----
PRED = """preds AS (SELECT user_id, business_id, CAST(stars AS DOUBLE) AS actual_rating,
        1.0 + ((user_id * 31 + business_id * 17) % 400) / 100.0 AS predicted_rating FROM reviews)"""


def synthetic_predictions(spark, d):
    r = fx.reviews(spark, d)
    est = F.lit(1.0) + ((F.col("user_id") * 31 + F.col("business_id") * 17) % 400) / F.lit(100.0)
    return r.select("user_id", "business_id", F.col("stars").cast("double").alias("actual_rating"),
                    est.alias("predicted_rating"))


@query("a27_rmse_mae", sql_round(ctes("reviews", extra=PRED) + """SELECT
    sqrt(avg(pow(actual_rating - predicted_rating, 2))) AS rmse, avg(abs(actual_rating - predicted_rating)) AS mae,
    count(*) AS n FROM preds""", ["rmse", "mae"]))
def a27_rmse_mae(spark, d):
    return round_doubles(metrics.rmse_mae(synthetic_predictions(spark, d)))


@query("p16_prediction_error", sql_round(ctes("reviews", extra=PRED) + """SELECT *,
    actual_rating - predicted_rating AS prediction_error FROM preds""", ["prediction_error", "predicted_rating"]))
def p16_prediction_error(spark, d):
    return round_doubles(metrics.with_error(synthetic_predictions(spark, d)))


@query("a28_mae_by_rating", sql_round(ctes("reviews", extra=PRED) + """SELECT actual_rating,
    avg(abs(actual_rating - predicted_rating)) AS mae, count(*) AS n FROM preds GROUP BY actual_rating""", ["mae"]))
def a28_mae_by_rating(spark, d):
    return round_doubles(metrics.mae_by_rating(synthetic_predictions(spark, d)))


@query("a29_error_histogram", sql_round(ctes("reviews", extra=PRED) + """, e AS (
        SELECT actual_rating - predicted_rating AS x FROM preds),
    st AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, (max(x) - min(x)) / 20.0 AS w FROM e),
    c AS (SELECT CAST(CASE WHEN w > 0 THEN least(floor((x - lo) / w), 19) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM e, st GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * w AS lo, lo + (b.bin + 1) * w AS hi, coalesce(c.n, 0) AS n, mean
    FROM (SELECT unnest(generate_series(0, 19)) AS bin) b CROSS JOIN st LEFT JOIN c ON c.bin = b.bin""", ["lo", "hi", "mean"]))
def a29_error_histogram(spark, d):
    p = metrics.with_error(synthetic_predictions(spark, d))
    return round_doubles(metrics.histogram(p, "prediction_error", 20))


@query("a29_error_median", sql_round(ctes("reviews", extra=PRED) + """SELECT
    median(actual_rating - predicted_rating) AS median, count(*) AS n FROM preds""", ["median"]))
def a29_error_median(spark, d):
    p = metrics.with_error(synthetic_predictions(spark, d))
    return round_doubles(metrics.exact_median(p, "prediction_error"))


def _prk_sql(src: str) -> str:
    ks = [5, 10, 20, 30, 50]
    per_k = "\n        UNION ALL ".join(
        f"""SELECT {k} AS k, avg(CASE WHEN rec{k} > 0 THEN hit{k} / rec{k} ELSE 0.0 END) AS precision,
            avg(CASE WHEN n_rel > 0 THEN hit{k} / n_rel ELSE 0.0 END) AS recall FROM per_user""" for k in ks)
    cols = ", ".join(f"count(CASE WHEN rn <= {k} AND predicted_rating >= 3.5 THEN 1 END) AS rec{k}, "
                     f"count(CASE WHEN rn <= {k} AND predicted_rating >= 3.5 AND actual_rating >= 3.5 THEN 1 END)"
                     f" AS hit{k}" for k in ks)
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY predicted_rating DESC, business_id, actual_rating) AS rn FROM {src}),
    per_user AS (SELECT user_id, {cols}, count(CASE WHEN actual_rating >= 3.5 THEN 1 END) AS n_rel
        FROM ranked GROUP BY user_id)
    {per_k}"""


@query("w2_precision_recall", sql_round(ctes("reviews", extra=PRED) + _prk_sql("preds"), ["precision", "recall"]))
def w2_precision_recall(spark, d):
    return round_doubles(metrics.precision_recall_at_k(synthetic_predictions(spark, d)))


# ---- fixture factor model: factors generated from ids of the training split ----
def _uvec(idc, k=K):
    return F.array(*[(((F.col(idc) * 31 + j * 17) % 200) - 100) / F.lit(1000.0) for j in range(k)])


def _ivec(idc, k=K):
    return F.array(*[(((F.col(idc) * 31 + j * 17 + 7) % 200) - 100) / F.lit(1000.0) for j in range(k)])


def train_test(spark, d):
    return pr.split_train_test(filtered_reviews(spark, d), 0.2, 42)


def split_rows(spark, d):
    """``train_test`` (user_id, business_id, stars, split) computed once, for jobs that read it several times. A review's split
    depends on its id alone, so the filter's joins move no ids of reviews."""
    rows = materialize(pr.split_train_test(fx.reviews(spark, d), 0.2, 42).select("user_id", "business_id", "stars", "split"))
    steps = [rows]

    def step(df):
        steps.append(materialize(df))
        return steps[-1]

    out = materialize(pr.filter_activity(rows, MIN_USER, MIN_BIZ, step=step))
    for table in steps:
        discard(table)
    return out


def fixture_model(spark, d, rows=None) -> score.FactorModel:
    """``rows``: ``train_test`` or ``split_rows``, if these are saved already."""
    train = (train_test(spark, d) if rows is None else rows).filter(F.col("split") == "train")
    users = train.select("user_id").distinct().select(
        "user_id", (((F.col("user_id") * 13) % 100 - 50) / F.lit(500.0)).alias("bias"), _uvec("user_id").alias("uvec"))
    items = train.select("business_id").distinct().select(
        "business_id", (((F.col("business_id") * 7) % 100 - 50) / F.lit(500.0)).alias("bias"),
        _ivec("business_id").alias("ivec"))
    return score.FactorModel(MU, users, items)


U_SQL = ", ".join(f"(((user_id * 31 + {j * 17}) % 200) - 100) / CAST(1000 AS DOUBLE) AS u{j}" for j in range(K))
I_SQL = ", ".join(f"(((business_id * 31 + {j * 17 + 7}) % 200) - 100) / CAST(1000 AS DOUBLE) AS i{j}"
                  for j in range(K))
DOT_SQL = " + ".join(f"u.u{j} * i.i{j}" for j in range(K))
MODEL = FILTERED + f""",
    split AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(review_id || '|42'), 1, 8) AS BIGINT) % 10000 < 2000
        THEN 'test' ELSE 'train' END AS split FROM fr),
    mu_ AS (SELECT {MU} AS mu),
    uf AS (SELECT user_id, ((user_id * 13) % 100 - 50) / CAST(500 AS DOUBLE) AS ubias, {U_SQL}
        FROM (SELECT DISTINCT user_id FROM split WHERE split = 'train')),
    itf AS (SELECT business_id, ((business_id * 7) % 100 - 50) / CAST(500 AS DOUBLE) AS ibias, {I_SQL}
        FROM (SELECT DISTINCT business_id FROM split WHERE split = 'train'))"""
SCORE_SQL = f"{MU} + u.ubias + i.ibias + {DOT_SQL}"


@query("m5_score_pairs", sql_round(ctes("reviews", extra=MODEL) + f"""SELECT s.user_id, s.business_id,
    CASE WHEN u.user_id IS NOT NULL AND i.business_id IS NOT NULL THEN {SCORE_SQL} END AS predicted_rating
    FROM split s LEFT JOIN uf u ON s.user_id = u.user_id LEFT JOIN itf i ON s.business_id = i.business_id
    WHERE s.split = 'test'""", ["predicted_rating"]))
def m5_score_pairs(spark, d):
    test = train_test(spark, d).filter(F.col("split") == "test").select("user_id", "business_id")
    return round_doubles(score.score_pairs(fixture_model(spark, d), test))


M3_SQL = f"""SELECT s.user_id, s.business_id, CAST(s.stars AS DOUBLE) AS actual_rating,
    CASE WHEN u.user_id IS NOT NULL AND i.business_id IS NOT NULL THEN least(greatest({SCORE_SQL}, 1.0), 5.0)
         ELSE {MU} END AS predicted_rating
    FROM split s LEFT JOIN uf u ON s.user_id = u.user_id LEFT JOIN itf i ON s.business_id = i.business_id
    WHERE s.split = 'test'"""


@query("m3_predict_test", sql_round(ctes("reviews", extra=MODEL) + M3_SQL, ["predicted_rating"]))
def m3_predict_test(spark, d):
    test = train_test(spark, d).filter(F.col("split") == "test")
    return round_doubles(score.predict_test(fixture_model(spark, d), test))


@query("m3_test_metrics", sql_round(ctes("reviews", extra=MODEL + ", mp AS (" + M3_SQL + ")") + """SELECT
    sqrt(avg(pow(actual_rating - predicted_rating, 2))) AS rmse, avg(abs(actual_rating - predicted_rating)) AS mae,
    count(*) AS n FROM mp""", ["rmse", "mae"]))
def m3_test_metrics(spark, d):
    test = train_test(spark, d).filter(F.col("split") == "test")
    return round_doubles(metrics.rmse_mae(score.predict_test(fixture_model(spark, d), test)))


@query("w2_test_precision_recall", sql_round(ctes("reviews", extra=MODEL + ", mp AS (" + M3_SQL + ")")
                                             + _prk_sql("mp"), ["precision", "recall"]))
def w2_test_precision_recall(spark, d):
    test = train_test(spark, d).filter(F.col("split") == "test")
    return round_doubles(metrics.precision_recall_at_k(score.predict_test(fixture_model(spark, d), test)))


@query("j11_exclude_rated", ctes("reviews", extra=MODEL) + """SELECT s.user_id, s.business_id FROM split s
    WHERE s.split = 'test'
      AND NOT EXISTS (SELECT 1 FROM split t WHERE t.split = 'train' AND t.user_id = s.user_id
                      AND t.business_id = s.business_id)
      AND s.business_id IN (SELECT business_id FROM itf)""")
def j11_exclude_rated(spark, d):
    tt = train_test(spark, d)
    pairs = tt.filter(F.col("split") == "test").select("user_id", "business_id")
    train = tt.filter(F.col("split") == "train")
    return score.exclude_rated(pairs, train, fixture_model(spark, d).items)


TOPN = ctes("business", "reviews", extra=MODEL) + f""",
    cand AS (SELECT u.user_id, i.business_id, {SCORE_SQL} AS predicted_rating FROM uf u CROSS JOIN itf i
        WHERE NOT EXISTS (SELECT 1 FROM fr r WHERE r.user_id = u.user_id AND r.business_id = i.business_id)),
    recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY round(predicted_rating, 9) DESC, business_id) AS rank
        FROM cand WHERE predicted_rating >= 3.5) WHERE rank <= 10)
"""


def fixture_recs(spark, d):
    return score.recommend_top_n(fixture_model(spark, d), filtered_reviews(spark, d), n=10, min_rating=3.5)


@query("m4_recommend_top_n", sql_round(TOPN + """SELECT r.user_id, r.business_id, r.predicted_rating,
    CAST(r.rank AS INTEGER) AS rank, b.name, b.city, b.state, b.stars, b.categories
    FROM recs r LEFT JOIN business b ON r.business_id = b.business_id""", ["predicted_rating"]))
def m4_recommend_top_n(spark, d):
    recs = fixture_recs(spark, d)
    return round_doubles(score.with_details(recs, fx.business(spark, d)))


@query("s11_page_recommendations", sql_round(TOPN + """SELECT user_id, business_id, predicted_rating,
    CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM recs) AS total,
    CAST(ceil((SELECT count(*) FROM recs) / 1000.0) AS BIGINT) AS total_pages
    FROM recs ORDER BY user_id, rank LIMIT 1000 OFFSET 1000""", ["predicted_rating"]))
def s11_page_recommendations(spark, d):
    return round_doubles(score.page(fixture_recs(spark, d), 2, 1000))


@query("s11_pages", sql_round(TOPN + """SELECT user_id, business_id, predicted_rating, CAST(rank AS INTEGER) AS rank,
    CAST(floor((row_number() OVER (ORDER BY user_id, rank) - 1) / 700) + 1 AS BIGINT) AS page FROM recs""", ["predicted_rating"]))
def s11_pages(spark, d):
    index = score.page_index(fixture_recs(spark, d))
    return round_doubles(index.select("user_id", "business_id", "predicted_rating", "rank",
                                      (F.floor(F.col("position") / 700) + 1).alias("page")))


@query("r1_rerank_by_gem", sql_round(TOPN.replace("rank <= 10", "rank <= 25") + ", gem AS (" + GEM_SQL + """)
    SELECT r.user_id, r.business_id, r.predicted_rating, CAST(r.rank AS INTEGER) AS rank, g.hidden_gem_score,
        CAST(row_number() OVER (PARTITION BY r.user_id ORDER BY g.hidden_gem_score DESC NULLS LAST,
            r.predicted_rating DESC, r.business_id) AS INTEGER) AS gem_rank
    FROM recs r LEFT JOIN gem g ON r.business_id = g.business_id""", ["predicted_rating", "hidden_gem_score"]))
def r1_rerank_by_gem(spark, d):
    recs = score.recommend_top_n(fixture_model(spark, d), filtered_reviews(spark, d), n=25, min_rating=3.5)
    gems = gem.gem_scores(fx.reviews(spark, d), fx.business(spark, d))
    gems = gems.withColumn("hidden_gem_score", F.round("hidden_gem_score", 6))
    return round_doubles(gem.rerank_by_gem(recs, gems, 25))


# ---- new users: cold-start users (dropped by the activity filter) scored from features ----
def _w(l, j):
    return ((l * 13 + j * 7) % 50 - 25) / 997.0


def project(x_col: str, alpha: float) -> F.Column:
    """x . W (fixed fixture W, f x K) scaled by alpha, as a K-array (one JVM expression)."""
    f = len(NEW_USER_VECTOR)
    w = np.array([[_w(l, j) for j in range(K)] for l in range(f)])
    return F.transform(matvec(x_col, w), lambda v: v * F.lit(alpha))


def cold_users(spark, d):
    u = fx.users(spark, d)
    fr = filtered_reviews(spark, d)
    cold = u.join(fr.select("user_id"), "user_id", "left_anti")
    return pr.new_user_vectors(cold.drop("elite", "city", "name", "friends", "yelping_since"), NEW_USER_VECTOR)


NUM_USER_COLS = fx.COMPLIMENT_COLUMNS + ["review_count", "useful", "funny", "cool", "fans", "average_stars"]
X_SQL = [f"coalesce(CAST({c} AS DOUBLE), 0.0)" if c in NUM_USER_COLS else "0.0" for c in NEW_USER_VECTOR]


def _xw_sql(j, alpha):
    terms = " + ".join(f"{x} * {_w(l, j)!r}" for l, x in enumerate(X_SQL) if x != "0.0")
    return f"({terms}) * {alpha}"


def _cold_sql(alpha):
    return MODEL + f""",
    cold AS (SELECT user_id, {', '.join(_xw_sql(j, alpha) + f' AS x{j}' for j in range(K))}
        FROM users WHERE user_id NOT IN (SELECT user_id FROM fr))"""


COLD = _cold_sql(ALPHA)


@query("m6_recommend_new_users", sql_round(ctes("reviews", "users", extra=COLD) + f"""SELECT * FROM (
    SELECT c.user_id, i.business_id, {MU} + i.ibias + {' + '.join(f'c.x{j} * i.i{j}' for j in range(K))}
        AS predicted_rating FROM cold c CROSS JOIN itf i) QUALIFY CAST(row_number() OVER (PARTITION BY user_id
        ORDER BY round(predicted_rating, 9) DESC, business_id) AS INTEGER) <= 100""", ["predicted_rating"]))
def m6_recommend_new_users(spark, d):
    m = fixture_model(spark, d)
    nu = cold_users(spark, d).select("user_id", project("features", ALPHA).alias("uvec"))
    return round_doubles(score.recommend_new_users(m.items, m.mu, nu, 100).drop("rank"))


@query("m7_score_new_user_pairs", sql_round(ctes("reviews", "users", extra=_cold_sql(1.0)) + f"""SELECT c.user_id, r.business_id,
    CASE WHEN i.business_id IS NOT NULL THEN {MU} + i.ibias + {' + '.join(f'c.x{j} * i.i{j}' for j in range(K))}
    END AS predicted_rating
    FROM cold c JOIN reviews r ON c.user_id = r.user_id LEFT JOIN itf i ON r.business_id = i.business_id""",
    ["predicted_rating"]))
def m7_score_new_user_pairs(spark, d):
    m = fixture_model(spark, d)
    nu = cold_users(spark, d).select("user_id", project("features", 1.0).alias("uvec"), F.lit(0.0).alias("bias"))
    pairs = fx.reviews(spark, d).select("user_id", "business_id").join(nu.select("user_id"), "user_id", "left_semi")
    return round_doubles(score.score_pairs(score.FactorModel(m.mu, nu, m.items), pairs))


# ---- the same from a fitted model with the bilinear term beta * (x W_u) . (y W_i), matrices given ----
BETA = 0.25
Y_COLS = ["latitude", "stars", "is_open"]


def _wi(l, j):
    return ((l * 17 + j * 5) % 40 - 20) / 991.0


def given_model(spark, d) -> hybrid.HybridModel:
    """A hybrid model with the fixture's item factors, its items' features and given projections."""
    b = fx.business(spark, d)
    y = b.select("business_id", F.array(*[F.col(c).cast("double") for c in Y_COLS]).alias("y"))
    items = fixture_model(spark, d).items.select("business_id", F.col("bias").alias("bi"), F.col("ivec").alias("q")).join(y, "business_id", "left")
    items = items.withColumn("y", F.coalesce("y", F.array(*[F.lit(0.0)] * len(Y_COLS))))
    w_u = np.array([[_w(l, j) for j in range(K)] for l in range(len(NEW_USER_VECTOR))])
    w_i = np.array([[_wi(l, j) for j in range(K)] for l in range(len(Y_COLS))])
    return hybrid.HybridModel(hybrid.HybridParams(n_factors=K, alpha=ALPHA, beta=BETA), MU, None, items, w_u, w_i)


YW = f""",
    yw AS (SELECT i.*, {', '.join(' + '.join(f'coalesce(CAST(b.{c} AS DOUBLE), 0.0) * {_wi(l, j)!r}' for l, c in enumerate(Y_COLS)) + f' AS y{j}' for j in range(K))}
        FROM itf i LEFT JOIN business b ON i.business_id = b.business_id)"""


def _bilinear(s):
    return (f"{MU} + i.ibias + {s} * (" + " + ".join(f"c.x{j} * i.i{j}" for j in range(K)) + f") + {BETA} * ("
            + " + ".join(f"c.x{j} * i.y{j}" for j in range(K)) + ")")


@query("m6_recommend_new_users_bilinear", sql_round(ctes("business", "reviews", "users", extra=_cold_sql(1.0) + YW) + f"""SELECT * FROM (
    SELECT c.user_id, i.business_id, {_bilinear(ALPHA)} AS predicted_rating FROM cold c CROSS JOIN yw i)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(predicted_rating, 9) DESC, business_id) <= 100""", ["predicted_rating"]))
def m6_recommend_new_users_bilinear(spark, d):
    m = given_model(spark, d).new_users(cold_users(spark, d))
    return round_doubles(score.recommend_new_users(m.items, m.mu, m.users.select("user_id", "uvec"), 100).drop("rank"))


@query("m7_score_new_user_pairs_bilinear", sql_round(ctes("business", "reviews", "users", extra=_cold_sql(1.0) + YW) + f"""SELECT c.user_id,
    r.business_id, CASE WHEN i.business_id IS NOT NULL THEN {_bilinear(1.0)} END AS predicted_rating
    FROM cold c JOIN reviews r ON c.user_id = r.user_id LEFT JOIN yw i ON r.business_id = i.business_id""", ["predicted_rating"]))
def m7_score_new_user_pairs_bilinear(spark, d):
    cold = cold_users(spark, d)
    m = given_model(spark, d).new_users(cold, alpha_on_user_term=False)
    pairs = fx.reviews(spark, d).select("user_id", "business_id").join(cold.select("user_id"), "user_id", "left_semi")
    return round_doubles(score.score_pairs(m, pairs))


@query("a29_prediction_histogram", sql_round(ctes("reviews", extra=PRED) + """, e AS (
        SELECT predicted_rating AS x FROM preds),
    st AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, (max(x) - min(x)) / 50.0 AS w FROM e),
    c AS (SELECT CAST(CASE WHEN w > 0 THEN least(floor((x - lo) / w), 49) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM e, st GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * w AS lo, lo + (b.bin + 1) * w AS hi, coalesce(c.n, 0) AS n, mean
    FROM (SELECT unnest(generate_series(0, 49)) AS bin) b CROSS JOIN st LEFT JOIN c ON c.bin = b.bin""", ["lo", "hi", "mean"]))
def a29_prediction_histogram(spark, d):
    return round_doubles(metrics.histogram(synthetic_predictions(spark, d), "predicted_rating", 50))


# values with a wide gap: most bins are empty
GAP = "CASE WHEN review_id LIKE '%1' THEN 100.0 + stars ELSE CAST(stars AS DOUBLE) END"


@query("a29_histogram_with_empty_bins", sql_round(ctes("reviews") + f""", e AS (SELECT {GAP} AS x FROM reviews),
    st AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, (max(x) - min(x)) / 20.0 AS w FROM e),
    c AS (SELECT CAST(CASE WHEN w > 0 THEN least(floor((x - lo) / w), 19) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM e, st GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * w AS lo, lo + (b.bin + 1) * w AS hi, coalesce(c.n, 0) AS n, mean
    FROM (SELECT unnest(generate_series(0, 19)) AS bin) b CROSS JOIN st LEFT JOIN c ON c.bin = b.bin""", ["lo", "hi", "mean"]))
def a29_histogram_with_empty_bins(spark, d):
    x = F.when(F.col("review_id").endswith("1"), F.lit(100.0) + F.col("stars")).otherwise(F.col("stars").cast("double"))
    return round_doubles(metrics.histogram(fx.reviews(spark, d).select(x.alias("x")), "x", 20))
