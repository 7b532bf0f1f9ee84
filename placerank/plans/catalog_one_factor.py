"""Registered queries: the hybrid fit and its grid at one factor and one feature a side, where SQL can follow every step.

The fixture start is a function of the ids; two epochs reach both projections' line searches.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from placerank.models import hybrid, svdpp
from placerank.operators import metrics, score
from placerank.plans.catalog_scoring import MODEL, split_rows
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources.fixture_sql import ctes

EPOCHS = 2
PARAMS = hybrid.HybridParams(n_factors=1, n_epochs=EPOCHS, reg=0.02, alpha=0.5, beta=0.25, reg_w=0.01)
GRID_ALPHAS, GRID_BETAS = [0.001, 0.01, 0.1], [0.003, 0.01]
W_U, W_I = 0.3, 0.2


def _start(spark, d):
    """(train and test rows, keyword arguments of the fit)."""
    tt = split_rows(spark, d)
    ids = tt.filter(F.col("split") == "train")
    start = ids.select("business_id").distinct().withColumn(
        "factors", F.array(((F.col("business_id") * 31 + 7) % 200 - 100) / F.lit(100.0)))
    users = ids.select("user_id").distinct().withColumn("features", F.array((F.col("user_id") % 7) / F.lit(10.0)))
    items = ids.select("business_id").distinct().withColumn("features", F.array((F.col("business_id") % 5) / F.lit(10.0)))
    return tt, {"user_feats": users, "item_feats": items, "item_start": start, "w_u": np.array([[W_U]]), "w_i": np.array([[W_I]])}


def _half(e: int, key: str, okey: str, src: str, own_feature: str, own_w: str, own_weight: str, search_weight: str) -> str:
    """CTEs of one half step: rows, solutions of the 2 x 2 systems, errors and their sums."""
    return f"""
    z{e} AS MATERIALIZED (SELECT r.{key} AS id, m.c, m.f, m.z, m.g, r.r - (SELECT mu FROM mu1) - m.b
            - cfg.{own_weight} * r.{own_feature} * w.w * m.f AS t
        FROM rr r JOIN {src} m ON r.{okey} = m.id JOIN cfg ON cfg.c = m.c JOIN {own_w} w ON w.c = m.c),
    n{e} AS MATERIALIZED (SELECT c, id, count(*) * 1.02 AS a11, sum(z) AS a12, sum(z * z) + 0.02 * count(*) AS a22, sum(t) AS h1,
            sum(z * t) AS h2 FROM z{e} GROUP BY c, id),
    s{e} AS MATERIALIZED (SELECT c, id, (h1 * a22 - a12 * h2) / (a11 * a22 - a12 * a12) AS b,
            greatest(least((a11 * h2 - a12 * h1) / (a11 * a22 - a12 * a12), 5.0), -5.0) AS f FROM n{e}),
    e{e} AS MATERIALIZED (SELECT z.c, z.id, z.f, z.t - s.b - s.f * z.z AS err, cfg.{search_weight} * s.f * z.g AS d
        FROM z{e} z JOIN s{e} s ON z.c = s.c AND z.id = s.id JOIN cfg ON cfg.c = z.c),
    t{e} AS MATERIALIZED (SELECT c, sum(err * d) AS ed, sum(d * d) AS dd, sqrt(avg(err * err)) AS rmse, avg(abs(err)) AS mae FROM e{e} GROUP BY c),
    g{e} AS MATERIALIZED (SELECT c, id, sum(err * f) AS e FROM e{e} GROUP BY c, id),"""


def _search(name: str, w: str, d: str, t: str) -> str:
    return f"""
    {name} AS MATERIALIZED (SELECT w.c, greatest(least(w.w - (0.01 * w.w * d.d - t.ed) / (t.dd + 0.01 * d.d * d.d) * d.d, 5.0), -5.0) AS w
        FROM {w} w JOIN {d} d ON w.c = d.c JOIN {t} t ON t.c = w.c),"""


def _fit_sql(configs: list[tuple[float, float]]) -> str:
    x, y = "(id % 7) / CAST(10 AS DOUBLE)", "(id % 5) / CAST(10 AS DOUBLE)"
    cfg = " UNION ALL ".join(f"SELECT {c} AS c, CAST({a} AS DOUBLE) AS alpha, CAST({b} AS DOUBLE) AS beta" for c, (a, b) in enumerate(configs))
    out = f"""
    cfg AS ({cfg}),
    rr AS MATERIALIZED (SELECT user_id, business_id, CAST(stars AS DOUBLE) AS r, (user_id % 7) / CAST(10 AS DOUBLE) AS x,
        (business_id % 5) / CAST(10 AS DOUBLE) AS y FROM split WHERE split = 'train'),
    mu1 AS MATERIALIZED (SELECT avg(r) AS mu FROM rr),
    wu0 AS (SELECT c, CAST({W_U} AS DOUBLE) AS w FROM cfg), wi0 AS (SELECT c, CAST({W_I} AS DOUBLE) AS w FROM cfg),
    im0 AS MATERIALIZED (SELECT c, id, CAST(0 AS DOUBLE) AS b, f, f + beta * {y} * {W_I} AS z, CAST(0 AS DOUBLE) AS g FROM (SELECT DISTINCT business_id AS id,
        ((business_id * 31 + 7) % 200 - 100) / CAST(100 AS DOUBLE) AS f FROM rr), cfg),"""
    wi = "wi0"
    for e in range(1, EPOCHS + 1):
        wu = f"wu{e - 1}"
        out += _half(2 * e - 1, "user_id", "business_id", f"im{e - 1}", "x", wu, "alpha", "beta")
        if e > 1:
            out += _search(f"wi{e}", wi, f"di{e - 1}", f"t{2 * e - 1}")
            wi = f"wi{e}"
        out += f"""
    du{e} AS MATERIALIZED (SELECT w.c, 0.01 * any_value(w.w) - any_value(cfg.alpha) * sum({x} * g.e) AS d
        FROM g{2 * e - 1} g JOIN cfg ON cfg.c = g.c JOIN {wu} w ON w.c = g.c GROUP BY w.c),
    um{e} AS MATERIALIZED (SELECT s.c, s.id, s.b, s.f, s.f + cfg.alpha * {x} * w.w AS z, {x} * d.d AS g
        FROM s{2 * e - 1} s JOIN cfg ON cfg.c = s.c JOIN {wu} w ON w.c = s.c JOIN du{e} d ON d.c = s.c),"""
        out += _half(2 * e, "business_id", "user_id", f"um{e}", "y", wi, "beta", "alpha")
        out += _search(f"wu{e}", wu, f"du{e}", f"t{2 * e}")
        out += f"""
    di{e} AS MATERIALIZED (SELECT w.c, 0.01 * any_value(w.w) - any_value(cfg.beta) * sum({y} * g.e) AS d
        FROM g{2 * e} g JOIN cfg ON cfg.c = g.c JOIN {wi} w ON w.c = g.c GROUP BY w.c),
    im{e} AS MATERIALIZED (SELECT s.c, s.id, s.b, s.f, s.f + cfg.beta * {y} * w.w AS z, {y} * d.d AS g
        FROM s{2 * e} s JOIN cfg ON cfg.c = s.c JOIN {wi} w ON w.c = s.c JOIN di{e} d ON d.c = s.c),"""
    last = 2 * EPOCHS
    out += f"""
    test AS (SELECT cfg.c, cfg.alpha, cfg.beta, t.user_id, t.business_id, CAST(t.stars AS DOUBLE) AS actual_rating,
        CASE WHEN u.id IS NOT NULL AND i.id IS NOT NULL THEN least(greatest((SELECT mu FROM mu1) + u.b + i.b + u.f * i.f
            + cfg.alpha * (t.user_id % 7) / 10.0 * wu.w * i.f + cfg.beta * u.f * (t.business_id % 5) / 10.0 * wi.w, 1.0), 5.0)
            ELSE (SELECT mu FROM mu1) END AS predicted_rating
        FROM (SELECT * FROM split WHERE split = 'test') t CROSS JOIN cfg JOIN wu{EPOCHS} wu ON wu.c = cfg.c JOIN {wi} wi ON wi.c = cfg.c
        LEFT JOIN s{last - 1} u ON u.c = cfg.c AND u.id = t.user_id LEFT JOIN s{last} i ON i.c = cfg.c AND i.id = t.business_id)"""
    return out


ONE = ctes("reviews", extra=MODEL + "," + _fit_sql([(PARAMS.alpha, PARAMS.beta)]))
GRID = ctes("reviews", extra=MODEL + "," + _fit_sql([(a, b) for a in GRID_ALPHAS for b in GRID_BETAS]))


def _model(spark, d):
    tt, start = _start(spark, d)
    return tt, hybrid.fit_hybrid(tt.filter(F.col("split") == "train"), PARAMS, **start)


@query("m1_hybrid_one_factor", sql_round(ONE + " SELECT user_id, business_id, actual_rating, predicted_rating FROM test", ["predicted_rating"]))
def m1_hybrid_one_factor(spark, d):
    tt, m = _model(spark, d)
    return round_doubles(score.predict_test(m.factor_model(), tt.filter(F.col("split") == "test")))


@query("m2_hybrid_one_factor_history", sql_round(ONE + " " + " UNION ALL ".join(
    f"SELECT {e} AS epoch, rmse AS train_rmse, mae AS train_mae FROM t{2 * e}" for e in range(1, EPOCHS + 1)), ["train_rmse", "train_mae"]))
def m2_hybrid_one_factor_history(spark, d):
    return round_doubles(_model(spark, d)[1].history_frame(spark))


GRID_RESULT = "SELECT alpha, beta, sqrt(avg(pow(actual_rating - predicted_rating, 2))) AS rmse, avg(abs(actual_rating - predicted_rating)) AS mae " \
              "FROM test GROUP BY alpha, beta"


def _grid(spark, d):
    tt, start = _start(spark, d)
    return hybrid.grid_search(tt.filter(F.col("split") == "train"), tt.filter(F.col("split") == "test"), PARAMS, GRID_ALPHAS, GRID_BETAS, **start)


@query("m8_grid_one_factor", sql_round(GRID + " " + GRID_RESULT, ["rmse", "mae"]))
def m8_grid_one_factor(spark, d):
    return round_doubles(_grid(spark, d))


@query("a30_grid_pivot_one_factor", sql_round(GRID + f", res AS ({GRID_RESULT}) SELECT alpha, " + ", ".join(
    f'max(CASE WHEN beta = {b} THEN rmse END) AS "{b}"' for b in GRID_BETAS) + " FROM res GROUP BY alpha", [f'"{b}"' for b in GRID_BETAS]))
def a30_grid_pivot_one_factor(spark, d):
    return round_doubles(metrics.grid_pivot(_grid(spark, d)))


# ---- SVD++ with one factor: two epochs reach the line search of the implicit factors ----
def _svdpp_sql() -> str:
    f, y = "((id * 31 + 7) % 200 - 100) / CAST(100 AS DOUBLE)", "((id * 17 + 3) % 100 - 50) / CAST(500 AS DOUBLE)"
    out = f"""
    rr AS MATERIALIZED (SELECT user_id, business_id, CAST(stars AS DOUBLE) AS r FROM split WHERE split = 'train'),
    mu1 AS MATERIALIZED (SELECT avg(r) AS mu FROM rr),
    i0 AS MATERIALIZED (SELECT id, CAST(0 AS DOUBLE) AS b, {f} AS q, {y} AS y, CAST(0 AS DOUBLE) AS g
        FROM (SELECT DISTINCT business_id AS id FROM rr)),"""

    def solve(name: str, rows: str) -> str:
        return f"""
    {name} AS MATERIALIZED (SELECT id, (h1 * a22 - a12 * h2) / (a11 * a22 - a12 * a12) AS b, (a11 * h2 - a12 * h1) / (a11 * a22 - a12 * a12) AS f
        FROM (SELECT id, count(*) * 1.02 AS a11, sum(z) AS a12, sum(z * z) + 0.02 * count(*) AS a22, sum(t) AS h1, sum(z * t) AS h2
              FROM {rows} GROUP BY id)),"""

    for e in range(1, EPOCHS + 1):
        out += f"""
    p{e} AS MATERIALIZED (SELECT r.user_id AS id, sum(i.y) / sqrt(count(*)) AS imp, sum(i.g) / sqrt(count(*)) AS h, count(*) AS n
        FROM rr r JOIN i{e - 1} i ON i.id = r.business_id GROUP BY r.user_id),
    zu{e} AS MATERIALIZED (SELECT r.user_id AS id, i.q AS z, r.r - (SELECT mu FROM mu1) - i.b - i.q * p.imp AS t, p.h
        FROM rr r JOIN i{e - 1} i ON i.id = r.business_id JOIN p{e} p ON p.id = r.user_id),"""
        out += solve(f"u{e}", f"zu{e}")
        out += f"""
    eu{e} AS MATERIALIZED (SELECT z.id, z.z, z.t - u.b - u.f * z.z AS err, z.z * z.h AS d FROM zu{e} z JOIN u{e} u ON u.id = z.id),
    st{e} AS MATERIALIZED (SELECT CASE WHEN below > 0 THEN (0.02 * yg - ed) / below ELSE 0.0 END AS s FROM (
        SELECT sum(err * d) AS ed, sum(d * d) + 0.02 * (SELECT sum(g * g) FROM i{e - 1}) AS below, (SELECT sum(y * g) FROM i{e - 1}) AS yg FROM eu{e})),
    m{e} AS MATERIALIZED (SELECT u.id, u.b, u.f + p.imp - (SELECT s FROM st{e}) * p.h AS f, x.e / sqrt(p.n) AS gs
        FROM u{e} u JOIN p{e} p ON p.id = u.id JOIN (SELECT id, sum(err * z) AS e FROM eu{e} GROUP BY id) x ON x.id = u.id),
    zi{e} AS MATERIALIZED (SELECT r.business_id AS id, m.f AS z, r.r - (SELECT mu FROM mu1) - m.b AS t, m.gs FROM rr r JOIN m{e} m ON m.id = r.user_id),"""
        out += solve(f"q{e}", f"zi{e}")
        out += f"""
    i{e} AS MATERIALIZED (SELECT o.id, q.b, q.f AS q, o.y - (SELECT s FROM st{e}) * o.g AS y,
            0.02 * (o.y - (SELECT s FROM st{e}) * o.g) - x.gs AS g
        FROM i{e - 1} o JOIN q{e} q ON q.id = o.id JOIN (SELECT id, sum(gs) AS gs FROM zi{e} GROUP BY id) x ON x.id = o.id),"""
    return out + f"""
    test AS (SELECT t.user_id, t.business_id, CAST(t.stars AS DOUBLE) AS actual_rating, least(greatest((SELECT mu FROM mu1)
            + coalesce(m.b, 0.0) + coalesce(i.b, 0.0) + coalesce(m.f * i.q, 0.0), 1.0), 5.0) AS predicted_rating
        FROM (SELECT * FROM split WHERE split = 'test') t LEFT JOIN m{EPOCHS} m ON m.id = t.user_id LEFT JOIN i{EPOCHS} i ON i.id = t.business_id)"""


@query("m11_svdpp_one_factor", sql_round(ctes("reviews", extra=MODEL + "," + _svdpp_sql())
                                         + " SELECT user_id, business_id, actual_rating, predicted_rating FROM test", ["predicted_rating"]))
def m11_svdpp_one_factor(spark, d):
    tt = split_rows(spark, d)
    train = tt.filter(F.col("split") == "train")
    b = F.col("business_id")
    start = train.select("business_id").distinct().select(
        "business_id", F.array((b * 31 + 7) % 200 - 100).cast("array<double>").alias("q"), F.array((b * 17 + 3) % 100 - 50).cast("array<double>").alias("y"))
    start = start.select("business_id", F.transform("q", lambda v: v / 100.0).alias("q"), F.transform("y", lambda v: v / 500.0).alias("y"))
    m = svdpp.fit_svdpp(train, svdpp.SvdppParams(n_factors=1, n_epochs=EPOCHS, reg=0.02), start)
    return round_doubles(svdpp.predict_svdpp(m, tt.filter(F.col("split") == "test")))
