"""Scalar expressions on hand-made edge rows (FIXTURES.md section 4)."""
import math
from datetime import datetime

from pyspark.sql import functions as F

from placerank.functions import expr as X


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_elite_years(spark):
    got = one(spark, [(None,), ("",), ("2015",), ("2010,2011",)], "e string", X.elite_years("e"))
    assert got == [0, 0, 1, 2]


def test_price_level(spark):
    got = one(spark, [(None,), ("None",), ("3",)], "p string", X.price_level("p"))
    assert got == [2.0, 2.0, 3.0]


def test_text_to_bool(spark):
    rows = [("{'garage': False, 'street': True}",), ("False",), ("u'free'",), (None,)]
    assert one(spark, rows, "a string", X.text_to_bool("a")) == ["True", "False", "u'free'", None]


def test_strip_tab_and_blanks(spark):
    assert one(spark, [("\tToronto  ",)], "c string", X.strip_ws("c")) == ["Toronto"]


def test_category_tokens(spark):
    got = one(spark, [("Beer, Wine & Spirits, Pubs",), (None,)], "c string", X.category_tokens("c"))
    assert got == [["beer", "wine & spirits", "pubs"], None]


def test_elapsed_days_counts_24h_units(spark):
    rows = [(datetime(2020, 1, 1, 23), datetime(2020, 1, 2, 1))]
    got = one(spark, rows, "a timestamp_ntz, b timestamp_ntz", X.elapsed_days("a", "b"))
    assert got == [0]


def test_haversine(spark):
    got = one(spark, [(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double",
              X.haversine_miles("a", "b", "c", "d"))
    assert math.isclose(got[0], 2 * math.pi * 3959.0 / 360, rel_tol=1e-9)


def test_dot_and_clip(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -4.0])], "a array<double>, b array<double>")
    assert df.select(X.dot("a", "b")).first()[0] == -5.0
    assert df.select(X.clip(X.dot("a", "b"), 1.0, 5.0)).first()[0] == 1.0


def test_null_safe_eq_not_local(spark):
    rows = [(None, None), ("a", "a"), ("a", None)]
    assert one(spark, rows, "x string, y string", X.null_safe_eq("x", "y")) == [False, True, False]


def test_to_ts_tolerant(spark):
    got = one(spark, [("2015-01-02",), ("n/a",)], "s string", X.to_ts("s"))
    assert got[0] == datetime(2015, 1, 2) and got[1] is None


def test_fill_zero_nan(spark):
    got = one(spark, [(float("nan"),), (None,), (1.5,)], "x double", X.fill_zero("x"))
    assert got == [0.0, 0.0, 1.5]
