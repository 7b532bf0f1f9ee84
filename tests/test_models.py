"""Scoring and model jobs against brute force on small inputs; model properties on planted data."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from placerank.models import baseline, blocks, hybrid, svdpp
from placerank.operators import score


def _factor_model(spark, n_users=40, n_items=60, k=3, seed=0):
    rng = np.random.default_rng(seed)
    U = rng.normal(size=(n_users, k))
    V = rng.normal(size=(n_items, k))
    bu, bi = rng.normal(size=n_users) * 0.1, rng.normal(size=n_items) * 0.1
    users = spark.createDataFrame(pd.DataFrame({"user_id": np.arange(n_users), "bias": bu, "uvec": list(U)}))
    items = spark.createDataFrame(pd.DataFrame({"business_id": np.arange(n_items), "bias": bi, "ivec": list(V)}))
    return score.FactorModel(3.0, users, items), U, V, bu, bi


def test_recommend_top_n_matches_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(score, "BLOCK_USERS", 15)
    monkeypatch.setattr(score, "BLOCK_ITEMS", 20)
    model, U, V, bu, bi = _factor_model(spark)
    rng = np.random.default_rng(3)
    rated = pd.DataFrame({"user_id": rng.integers(0, 40, 400), "business_id": rng.integers(0, 60, 400)})
    rated_df = spark.createDataFrame(rated)
    got = score.recommend_top_n(model, rated_df, n=5, min_rating=2.5).toPandas()
    S = 3.0 + bu[:, None] + bi[None, :] + U @ V.T
    seen = set(zip(rated.user_id, rated.business_id))
    for u in range(40):
        cands = [(round(S[u, i], 9), i) for i in range(60) if (u, i) not in seen and S[u, i] >= 2.5]
        best = [i for _, i in sorted(cands, key=lambda t: (-t[0], t[1]))[:5]]
        mine = got[got.user_id == u].sort_values("rank").business_id.tolist()
        assert mine == best, u


def test_bound_on_norms_keeps_the_best(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(score, "STEP_ITEMS", 16)
    rng = np.random.default_rng(11)
    v, u = rng.normal(size=(300, 4)) * rng.exponential(size=(300, 1)), rng.normal(size=(25, 4))
    bias, u_bias = rng.normal(size=300) * 0.1, rng.normal(size=25) * 0.1
    users = pa.table({"user_id": np.arange(25), "u_bias": u_bias, "uvec": list(u), "n_rated": np.arange(25) % 3})
    items = pa.table({"business_id": np.arange(300), "i_bias": bias, "ivec": list(v)})
    schema = pa.schema([("user_id", pa.int64()), ("business_id", pa.int64()), ("predicted_rating", pa.float64())])
    s = 3.0 + u_bias[:, None] + bias[None, :] + u @ v.T
    for floor in (None, 4.0):
        got = score._block_scores(3.0, 5, floor, schema)(users, items).to_pandas()
        for i in range(25):
            best = [j for j in np.argsort(-s[i])[:5 + i % 3] if floor is None or s[i, j] >= floor]
            assert set(got[got.user_id == i].business_id) == set(best)


def test_score_pairs_null_for_unknown(spark):
    model, *_ = _factor_model(spark)
    pairs = spark.createDataFrame([(0, 0), (999, 0), (0, 999)], "user_id long, business_id long")
    got = {(r.user_id, r.business_id): r.predicted_rating for r in score.score_pairs(model, pairs).collect()}
    assert got[(0, 0)] is not None and got[(999, 0)] is None and got[(0, 999)] is None


def _planted(spark, n_users=60, n_items=50, k=2, seed=1):
    rng = np.random.default_rng(seed)
    P, Q = rng.normal(size=(n_users, k)), rng.normal(size=(n_items, k))
    rows = [(u, i, float(np.clip(3 + P[u] @ Q[i] + rng.normal() * 0.1, 1, 5)))
            for u in range(n_users) for i in range(n_items) if rng.random() < 0.5]
    return spark.createDataFrame(rows, "user_id long, business_id long, stars double")


def test_hybrid_beats_baseline_and_is_reproducible(spark):
    r = _planted(spark)
    p = hybrid.HybridParams(n_factors=2, n_epochs=4, reg=0.01, seed=3)
    m1 = hybrid.fit_hybrid(r, p)
    m2 = hybrid.fit_hybrid(r, p)
    hist = [h[1] for h in m1.history]
    assert hist[-1] < hist[0]
    assert m1.history == m2.history
    base = baseline.fit_baseline(r, n_epochs=10)
    test = r.withColumnRenamed("stars", "stars")
    b_err = baseline.predict_baseline(base, test).select(
        F.sqrt(F.avg((F.col("actual_rating") - F.col("predicted_rating")) ** 2))).first()[0]
    assert hist[-1] < b_err


def test_hybrid_with_features_runs_and_round_trips(spark, tmp_path):
    r = _planted(spark, 30, 20)
    uf = spark.range(30).select(F.col("id").alias("user_id"),
                                F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("features"))
    bf = spark.range(20).select(F.col("id").alias("business_id"), F.array((F.col("id") % 2).cast("double"))
                                .alias("features"))
    m = hybrid.fit_hybrid(r, hybrid.HybridParams(n_factors=2, n_epochs=2, alpha=0.1, beta=0.1, seed=1), uf, bf)
    assert m.w_u.shape == (2, 2) and m.w_i.shape == (1, 2)
    hybrid.save_model(m, str(tmp_path / "bundle"))
    m2, _ = hybrid.load_model(spark, str(tmp_path / "bundle"))
    pairs = r.select("user_id", "business_id")
    a = score.score_pairs(m.factor_model(), pairs).orderBy("user_id", "business_id").toPandas()
    b = score.score_pairs(m2.factor_model(), pairs).orderBy("user_id", "business_id").toPandas()
    assert np.allclose(a.predicted_rating, b.predicted_rating)


def _side_features(spark, n_users, n_items):
    uf = spark.range(n_users).select(F.col("id").alias("user_id"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("features"))
    return uf, spark.range(n_items).select(F.col("id").alias("business_id"), F.array((F.col("id") % 2).cast("double")).alias("features"))


def _tables(m, user_cols, item_cols):
    out = []
    for df, key, cols in ((m.users, "user_id", user_cols), (m.items, "business_id", item_cols)):
        pdf = df.orderBy(key).toPandas()
        out += [np.stack([np.atleast_1d(v) for v in pdf[c]]) for c in cols]
    return out


def test_one_user_step_is_the_ridge_solution(spark):
    r = _planted(spark, 12, 10)
    start = spark.range(10).select(F.col("id").alias("business_id"), F.array(F.col("id") / 10.0, 1.0 - F.col("id") / 7.0).alias("factors"))
    m = hybrid.fit_hybrid(r, hybrid.HybridParams(n_factors=2, n_epochs=1, reg=0.1, alpha=0, beta=0), item_start=start)
    rows = r.toPandas()
    mu = rows.stars.mean()
    for u in m.users.collect():
        mine = rows[rows.user_id == u.user_id]
        z = np.array([[1.0, i / 10.0, 1.0 - i / 7.0] for i in mine.business_id])
        w = np.linalg.solve(z.T @ z + 0.1 * len(z) * np.eye(3), z.T @ (mine.stars.to_numpy() - mu))
        assert np.allclose([u.bu, *u.p], [w[0], *np.clip(w[1:], -5, 5)])


def test_hot_ids_give_the_same_fits(spark, monkeypatch):
    r = _planted(spark, 40, 30)
    uf, bf = _side_features(spark, 40, 30)
    p = hybrid.HybridParams(n_factors=2, n_epochs=3, alpha=0.1, beta=0.1, seed=1)
    plain, plain_pp = hybrid.fit_hybrid(r, p, uf, bf), svdpp.fit_svdpp(r, svdpp.SvdppParams(n_factors=2, n_epochs=3))
    monkeypatch.setattr(blocks, "CELL_ROWS", 16)      # about half of the ids have more ratings
    assert blocks.Exchange(r.withColumnRenamed("stars", "r")).sides["user_id"].any_hot
    hot, hot_pp = hybrid.fit_hybrid(r, p, uf, bf), svdpp.fit_svdpp(r, svdpp.SvdppParams(n_factors=2, n_epochs=3))
    assert np.allclose(plain.history, hot.history) and np.allclose(plain_pp.history, hot_pp.history)
    for a, b in zip(_tables(plain, ["bu", "p"], ["bi", "q"]), _tables(hot, ["bu", "p"], ["bi", "q"])):
        assert np.allclose(a, b)
    for a, b in zip(_tables(plain_pp, ["bu", "p", "imp"], ["bi", "q", "y"]), _tables(hot_pp, ["bu", "p", "imp"], ["bi", "q", "y"])):
        assert np.allclose(a, b)
    assert np.allclose(plain.w_u, hot.w_u) and np.allclose(plain.w_i, hot.w_i)


def test_grid_equals_single_fits(spark):
    from placerank.operators import metrics
    r = _planted(spark, 30, 20)
    uf, bf = _side_features(spark, 30, 20)
    train, test = r.filter((F.col("user_id") + F.col("business_id")) % 4 != 0), r.filter((F.col("user_id") + F.col("business_id")) % 4 == 0)
    test = test.unionByName(spark.createDataFrame([(999, 1, 2.0), (1, 999, 4.0)], r.schema))
    base = hybrid.HybridParams(n_factors=2, n_epochs=2, seed=1)
    got = {(x.alpha, x.beta): (x.rmse, x.mae) for x in hybrid.grid_search(train, test, base, [0.01, 0.5], [0.02, 0.3], uf, bf).collect()}
    for (a, b), values in got.items():
        m = hybrid.fit_hybrid(train, hybrid.HybridParams(n_factors=2, n_epochs=2, seed=1, alpha=a, beta=b), uf, bf)
        one = metrics.rmse_mae(score.predict_test(m.factor_model(), test)).first()
        assert np.allclose(values, (one.rmse, one.mae))
    assert len(got) == 4


def test_user_factors_solve_their_half_step(spark):
    from placerank.models import als
    r = _planted(spark, 20, 15)
    _, model, users, items = als.fit_nmf(r, rank=1, max_iter=3, reg=0.1)
    rows = r.join(users, "user_id").join(items, "business_id").select("uix", "iix", F.col("stars").alias("value"))
    gaps = [x.gap for x in als.half_step_gap(model, rows, 0.1, True).collect()]
    assert len(gaps) == 20 and max(gaps) < 1e-4
    wrong = [x.gap for x in als.half_step_gap(model, rows, 0.3, True).collect()]
    assert max(wrong) > 1e-3


def test_svdpp_training_error_falls(spark):
    r = _planted(spark, 40, 30)
    m = svdpp.fit_svdpp(r, svdpp.SvdppParams(n_factors=2, n_epochs=3, reg=0.01, seed=2))
    hist = [h[1] for h in m.history]
    assert hist[-1] < hist[0] and all(np.isfinite(hist))
    preds = svdpp.predict_svdpp(m, r).toPandas()
    assert preds.predicted_rating.between(1, 5).all()


def test_fixture_models_have_the_references_size(spark):
    from placerank.plans import catalog, catalog_models as cm
    from placerank.plans.registry import QUERIES

    catalog.load_all()
    h, g, v = cm.HYBRID, cm.GRID_BASE, cm.SVDPP
    assert (h.n_factors, h.n_epochs, h.reg, h.alpha, h.beta) == (50, 5, 0.02, 1e-3, 1e-3)
    assert (g.n_factors, g.n_epochs, g.reg) == (50, 10, 0.05) and (v.n_factors, v.n_epochs, v.reg) == (50, 20, 0.02)
    d = "/root/testdata/sf0.001"
    for (got, name, key) in zip(cm.side_features(spark, d), ("f5_user_features_prepared", "f4_business_features_prepared"),
                                ("user_id", "business_id"), strict=True):
        table = QUERIES[name](spark, d)
        want = {r[key]: [float(r[c] or 0) for c in table.columns if c != key] for r in table.collect()}
        assert want and {r[key]: r["features"] for r in got.collect()} == want
    assert {"m14_compare_fitted_models", "a31_best_fitted_model_per_metric"} <= set(QUERIES)


def test_vectors_are_never_broadcast(spark):
    r = _planted(spark, 30, 20).withColumnRenamed("stars", "r")
    uf, bf = _side_features(spark, 30, 20)
    ex = blocks.Exchange(r)
    w, kernel = np.zeros((1, 2, 2)), hybrid._HalfStep(2, ex.mu, [0.1], [0.1], [0.1], np.zeros((1, 2, 2)), np.zeros((1, 1, 2)))
    items = bf.select(F.col("business_id").alias("id"), F.concat(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), "features").alias("v"))
    users = uf.select(F.col("user_id").alias("id"), F.col("features").alias("v"))
    out = ex._pass(ex.sides["user_id"], kernel, "all", items, users, w.shape[1])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    ex.close()


def test_fits_leave_only_their_results(spark, tmp_path, monkeypatch):
    """Tables of finished half steps are deleted: what stays does not grow with the epochs."""
    from placerank.models import common
    monkeypatch.setattr(common, "ensure_checkpoint_dir", lambda s: str(tmp_path))
    r = _planted(spark, 30, 20)
    left = []
    for epochs in (2, 4):
        hybrid.fit_hybrid(r, hybrid.HybridParams(n_factors=2, n_epochs=epochs, seed=1))
        svdpp.fit_svdpp(r, svdpp.SvdppParams(n_factors=2, n_epochs=epochs))
        baseline.fit_baseline(r, n_epochs=epochs, checkpoint_every=1)
        left.append(len(list(tmp_path.iterdir())) - sum(left))
    assert left[0] == left[1]


def test_baseline_of_hot_ids_equals_plain_loops(spark, monkeypatch):
    r = _planted(spark, 40, 30)
    rows = r.toPandas()
    mu = rows.stars.mean()
    bu, bi = {u: 0.0 for u in rows.user_id}, {}
    for _ in range(3):
        for b, key, own, reg in ((bi, "business_id", bu, 10.0), (bu, "user_id", bi, 15.0)):
            other = "user_id" if key == "business_id" else "business_id"
            b.update({k: float((g.stars - mu - g[other].map(own)).sum() / (reg + len(g))) for k, g in rows.groupby(key)})
    for hot in (10 ** 6, 15):      # with the second about half of the ids are spread over all parts
        monkeypatch.setattr(baseline, "HOT_ROWS", hot)
        m = baseline.fit_baseline(r, n_epochs=3)
        assert np.allclose([bu[x.user_id] for x in m.users.collect()], [x.bias for x in m.users.collect()])
        assert {x.business_id: round(x.bias, 9) for x in m.items.collect()} == {k: round(v, 9) for k, v in bi.items()}


def test_users_meet_only_item_blocks_within_reach(spark):
    rng = np.random.default_rng(4)
    v, bias = rng.normal(size=(60, 3)) * 0.1, np.repeat([2.0, 0.5, 0.4, -3.0], 15)
    u = rng.normal(size=(30, 3))
    items = spark.createDataFrame(pd.DataFrame({"business_id": range(60), "i_bias": bias, "ivec": list(v), "ib": np.arange(60) // 15,
                                                "norm": np.sqrt((v * v).sum(axis=1))}))
    users = spark.createDataFrame(pd.DataFrame({"user_id": range(30), "u_bias": 0.1, "uvec": list(u), "floor": 3.65}))
    s = 3.1 + bias[None] + u @ v.T
    got = {x.user_id: set(x.wanted) for x in score._within_reach(users, items, 3.0).collect()}
    for i in range(30):
        need = {j // 15 for j in range(15, 60) if s[i, j] >= 3.65}
        assert need <= got[i] and 3 not in got[i]
