"""Hard negatives against brute force, with nulls, ties, repeated rows, several tiles and components of any size."""
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from placerank.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, score string, uid int"


def brute(rows, every=100):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(good):
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        same = sorted(((-score(w), j) for m, (j, lab, w) in enumerate(good) if m != k and lab == label))[:5]
        other = sorted((-score(w), j) for j, lab, w in good if lab != label)
        for p, j in same:
            found = [(-s, n) for s, n in other if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, r, n, -p, s) for r, (s, n) in enumerate(found, 1)]
    return sorted(out)


def table(n, seed, dims=12, ids=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2])
        v = [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) + (0.25 if d % 3 == label else 0) for d in range(dims)]
        rows.append((i if ids is None else ids[i], label, v, "x", 1))
    return rows


def got(df, **options):
    return sorted(tuple(r) for r in hn.hard_negatives(df, **options).collect())


def test_matches_brute_force_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE_ROWS", (37, 64))
    monkeypatch.setattr(hn, "TILE_ANCHORS", 3)
    rows = table(400, 3)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), anchor_every=25) == brute(rows, 25)


def test_edge_rows(spark):
    rows = table(220, 4)
    rows[5] = (5, None, *rows[5][2:])
    rows[6] = (6, 0, None, "x", 1)
    rows[7] = (None, 0, *rows[7][2:])
    rows[8] = (8, 0, [None] + rows[8][2][1:], "x", 1)
    rows[9] = (9, 0, [float("nan")] + rows[9][2][1:], "x", 1)
    rows[10] = (10, 0, [float("inf")] + rows[10][2][1:], "x", 1)
    rows[11] = (11, 1, [1.0, 0.5], "x", 1)             # shorter, as if filled with 0
    rows[12] = (12, 2, [], "x", 1)
    df = spark.createDataFrame(rows, SCHEMA)
    filled = [(i, lab, v + [0.0] * (12 - len(v)) if v is not None else v) for i, lab, v, *_ in rows]
    assert got(df) == brute(filled)
    assert got(df.limit(0)) == [] and got(df.filter("vec_id < 0")) == []
    one_label = df.filter("label = 0")
    assert got(one_label) == []                          # no row of another label


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(0, 0, [1.0, 0.0], "x", 1)] * 2 + [(7, 1, [0.9, 0.0], "x", 1), (8, 1, [0.9, 0.0], "x", 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == sorted(
        [(0, 0, r, n, 65536, 256 * 230) for r, n in ((1, 7), (2, 8))] * 2)


def test_large_components_are_exact(spark):
    big = 2.0 ** 20
    rows = [(0, 0, [big, 1.0, 1.0]), (1, 0, [big, 1.0, 0.5]), (2, 1, [big, 1.0, 0.25]), (3, 1, [big, 0.5, 0.25]), (4, 1, [big * 0.5, 0.5, 0.25])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(df) == brute(rows)


def test_scan_keeps_what_can_reach_the_result():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (500, 40)).astype(np.int64)
    tile = hn.Tile(pa.table({"uid": np.arange(500), "vec_id": np.arange(500), "label": np.zeros(500, np.int64), "v": list(v)}), 40)
    a = rng.integers(-50, 50, 40)
    exact, dropped = v @ a, []

    def useful(least, most):
        keep = most >= 4000
        dropped.append(int((~keep).sum()))
        return keep

    at, score = tile.scan(a, np.arange(500), useful)
    assert set(np.flatnonzero(exact >= 4000)) == set(at) and (score == exact[at]).all()
    assert sum(dropped[:-1]) > 0                           # some leave before all dimensions are read


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_matches_its_sql(spark, sf):
    import duckdb

    from placerank.llm.queries import QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hn.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, sf).collect()) == sorted(want) != []
