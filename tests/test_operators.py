import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from placerank.operators import features_business as fb
from placerank.operators import features_user as fu
from placerank.operators import gem, locality, metrics, prepare as pr, score, sentiment


def test_base_city_tie_smallest_and_unknown_business(spark):
    reviews = spark.createDataFrame([(1, 10), (1, 11), (2, 99)], "user_id long, business_id long")
    business = spark.createDataFrame([(10, "B"), (11, "A")], "business_id long, city string")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = {r.user_id: r.base_city for r in locality.users_with_base_city(users, reviews, business).collect()}
    assert got == {1: "A", 2: None}


def test_classify_null_cities_local_unknown_business_null(spark):
    reviews = spark.createDataFrame([(1, 1, 10), (2, 1, 99)], "review_id long, user_id long, business_id long")
    business = spark.createDataFrame([(10, None)], "business_id long, city string")
    bases = spark.createDataFrame([(1, None)], "user_id long, base_city string")
    got = {r.review_id: r.location_classification
           for r in locality.classify_reviews(reviews, business, bases).collect()}
    assert got == {1: "local", 2: None}


def test_food_filter_and_blocklist(spark):
    b = spark.createDataFrame([(1, None), (2, "Seafood"), (3, "Restaurants, Automotive"), (4, "Cafes")],
                              "business_id long, categories string")
    kept = sorted(r.business_id for r in fb.food_places(b).collect())
    assert kept == [2, 3]
    blocked = spark.createDataFrame([("automotive",)], "category string")
    assert sorted(r.business_id for r in fb.drop_blocked(fb.food_places(b), blocked).collect()) == [2]


def test_group_ratio_counts_duplicate_list_entry_twice(spark):
    counts = spark.createDataFrame([(1, "tea rooms", 2), (1, "pubs", 2)], "user_id long, category string, n long")
    groups = spark.createDataFrame([("g", "tea rooms"), ("g", "tea rooms")], "group string, category string")
    r = fu.user_group_ratios(counts, groups, ["g"]).first()
    assert r.g_ratio == 1.0     # (2 + 2) / 4, as the reference's duplicated list entry does


def test_top_n_ties_and_short_lists(spark):
    df = spark.createDataFrame([(1, 5, 4.0), (1, 3, 4.0), (1, 9, 1.0), (2, 1, 2.0)],
                               "user_id long, business_id long, predicted_rating double")
    got = [(r.user_id, r.business_id, r["rank"]) for r in score.top_n(df, 2).orderBy("user_id", "rank").collect()]
    assert got == [(1, 3, 1), (1, 5, 2), (2, 1, 1)]


def test_precision_recall_edge_cases(spark):
    preds = spark.createDataFrame(
        [(1, 1, 1.0, 4.0), (1, 2, 2.0, 4.0),      # user 1: no relevant item -> recall 0, precision 0
         (2, 1, 5.0, 1.0), (2, 2, 4.0, 2.0)],     # user 2: nothing predicted relevant -> precision 0
        "user_id long, business_id long, actual_rating double, predicted_rating double")
    rows = {r.k: r for r in metrics.precision_recall_at_k(preds, [1, 5]).collect()}
    assert rows[1].precision == 0.0 and rows[5].recall == 0.0


def test_recall_non_decreasing_in_k(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"user_id": rng.integers(0, 20, 500), "business_id": np.arange(500),
                        "actual_rating": rng.integers(1, 6, 500).astype(float),
                        "predicted_rating": rng.uniform(1, 5, 500)})
    rows = metrics.precision_recall_at_k(spark.createDataFrame(pdf)).orderBy("k").collect()
    recalls = [r.recall for r in rows]
    assert recalls == sorted(recalls) and all(0 <= r.precision <= 1 for r in rows)


def test_exact_median_matches_numpy(spark):
    vals = np.random.default_rng(1).normal(size=1001).tolist() + [0.5] * 7
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    assert abs(metrics.exact_median(df, "x").first()["median"] - float(np.median(vals))) < 1e-12


def test_standardize_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 3.0)], "id long, c double, v double")
    rows = pr.standardize(df, ["c", "v"]).orderBy("id").collect()
    assert [r.c for r in rows] == [0.0, 0.0] and [r.v for r in rows] == [-1.0, 1.0]


def test_label_encode_sorted_codes_null_minus_one(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else f"v{i % 37:02d}") for i in range(200)],
                               "id long, c string").repartition(5)
    got = {r.id: r.c for r in pr.label_encode(df, ["c"]).collect()}
    expect = sorted({f"v{i % 37:02d}" for i in range(200) if i % 10})
    assert all(got[i] == (-1 if i % 10 == 0 else expect.index(f"v{i % 37:02d}")) for i in range(200))


def test_split_is_deterministic_and_complete(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("review_id"))
    a = pr.split_train_test(df.repartition(3), 0.2, 7)
    b = pr.split_train_test(df.repartition(11), 0.2, 7)
    assert a.exceptAll(b).count() == 0 and a.count() == 5000
    frac = a.filter(F.col("split") == "test").count() / 5000
    assert 0.17 < frac < 0.23


def test_activity_filter_business_first(spark):
    rows = [(u, b) for u, b in [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 3)]]
    r = spark.createDataFrame(rows, "user_id long, business_id long")
    kept = pr.filter_activity(r, min_user_reviews=2, min_business_reviews=2)
    assert sorted((x.user_id, x.business_id) for x in kept.collect()) == [(1, 1), (1, 2), (3, 1), (3, 2)]


def test_gem_score_at_exactly_three_and_a_half(spark):
    m = spark.createDataFrame([(1, 4, 3.5, 4, 0)], "business_id long, total_reviews long, avg_rating double, "
                                                   "local_reviews long, tourist_reviews long")
    r = gem.hidden_gem_score(m).first()
    assert abs(r.sentiment_score - 0.4) < 1e-12
    expect = 0.3 * 0.4 + 0.25 * np.exp(-4 / 200) + 0.2 * 1.0 + 0.25 * 1.0
    assert abs(r.hidden_gem_score - expect) < 1e-12


def test_sentiment_rules(spark):
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    docs = spark.createDataFrame([(1, None), (2, "good"), (3, "not good"), (4, "very good"),
                                  (5, "good but bad"), (6, "good!!"), (7, "nothing here")],
                                 "review_id long, text string")
    got = {r.review_id: r for r in sentiment.review_sentiment(docs, lex).collect()}
    norm = lambda s: s / np.sqrt(s * s + 15)
    assert got[1].vader_compound == 0 and got[1].vader_neu == 0
    assert abs(got[2].vader_compound - norm(1.9)) < 1e-12
    assert abs(got[3].vader_compound - norm(1.9 * -0.74)) < 1e-12
    assert abs(got[4].vader_compound - norm(1.9 + 0.293)) < 1e-12
    assert abs(got[5].vader_compound - norm(1.9 * 0.5 - 2.5 * 1.5)) < 1e-12
    assert abs(got[6].vader_compound - norm(1.9 + 2 * 0.292)) < 1e-12
    assert got[7].vader_neu == 1.0 and got[7].vader_compound == 0


def test_checkins_sum_comma_parts(spark):
    c = spark.createDataFrame([(1, "a,b"), (1, "c"), (2, "")], "business_id long, date string")
    assert {r.business_id: r.num_checkins for r in fb.checkin_counts(c).collect()} == {1: 3, 2: 0}


def test_codes_and_median_without_exchange_reuse(spark):
    """Partition numbers are written before they are read twice: right also when no exchange is reused."""
    from placerank.operators import prepare

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(400_000).select((F.xxhash64("id") % 50_000_000).cast("double").alias("x"))
        vals = sorted(r.x for r in df.collect())
        codes = {r.value: r.code for r in prepare.dense_codes(df, ["x"]).collect()}
        assert codes == {v: i for i, v in enumerate(sorted(set(vals)))}
        assert metrics.exact_median(df, "x").first()["median"] == np.median(vals)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_top_n_bounds_ties_and_keeps_string_ids(spark):
    items = spark.createDataFrame([(f"b{i:03}", 0.0, [1.0]) for i in range(300)], "business_id string, bias double, ivec array<double>")
    users = spark.createDataFrame([(f"u{i}", 0.0, [0.5]) for i in range(3)], "user_id string, bias double, uvec array<double>")
    rated = spark.createDataFrame([("u0", "b000"), ("u0", "b002")], "user_id string, business_id string")
    model = score.FactorModel(3.0, users, items)
    out = score.recommend_top_n(model, rated, n=4).collect()
    best = {u: [r.business_id for r in sorted(out, key=lambda r: r["rank"]) if r.user_id == u] for u in ("u0", "u1", "u2")}
    assert best == {"u0": ["b001", "b003", "b004", "b005"], "u1": ["b000", "b001", "b002", "b003"],
                    "u2": ["b000", "b001", "b002", "b003"]}
    below = score.FactorModel(2.9999999996, users, items)      # 3.4999999996 does not reach 3.5
    assert score.recommend_top_n(below, rated, n=4).count() == 0


def test_classified_only_takes_all_businesses(spark, monkeypatch):
    from placerank.plans import catalog_misc
    r = spark.createDataFrame([(f"r{i}", i % 3, i) for i in range(1, 22)], "review_id string, user_id long, business_id long")
    b = spark.createDataFrame([(i, f"c{i % 2}") for i in range(1, 21)], "business_id long, city string")
    monkeypatch.setattr(catalog_misc.fx, "reviews", lambda *_: r)
    monkeypatch.setattr(catalog_misc.fx, "business", lambda *_: b)
    got = {x.review_id for x in catalog_misc.p6_classified_only(spark, "").collect()}
    assert got == {f"r{i}" for i in range(1, 21)}   # only the review of an unknown business has no label
