"""Hard negatives of anchors by a vertical scan of the dimensions (BOND).

All rows and the anchors are dealt into tiles; a task has one tile of rows against one of anchors. There the rows lie
by dimension. An anchor reads the dimensions from its largest component down. What is not yet read can add no more and
no less than the least and largest component of the tile allow, so after each step the rows that cannot reach the
result any more leave the anchor's candidates. A first pass gives the positives, a second one searches the windows of
scores that they set.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import saved

STEP = 8                         # dimensions read at a time
TILE_ROWS = (2_048, 65_536)      # rows of a tile: a 64th of the table within these bounds
TILE_ANCHORS = 4_096
EXACT = 2.0 ** 53
LONG = (-(1 << 63), (1 << 63) - 1)


def _vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """Rows that take part -> (vec_id, label, v array<long>)."""
    x = F.col("embedding")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    top = float(1 << 62)
    v = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), F.lit(scale) * c.cast("double")))).cast("long"))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & good).select("vec_id", "label", v.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as an array (dimension, row), shorter ones filled with 0."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ascontiguousarray(out.T)


class Tile:
    """Rows by dimension, with the bounds of each dimension."""

    def __init__(self, rows: pa.Table, width: int):
        self.uid, self.vec_id, self.label = (rows.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        ints = _matrix(rows.column("v"), width)
        self.size = np.abs(ints.astype(float)).max(axis=1)
        self.ints, self.floats = ints, ints.astype(float)
        self.low, self.high = ints.min(axis=1), ints.max(axis=1)

    def scan(self, a: np.ndarray, rows: np.ndarray, useful):
        """Exact scores of the candidates among ``rows`` that ``useful(least, most)`` keeps to the end."""
        exact = float(np.abs(a.astype(float)) @ self.size) < EXACT / 4
        kind = float if exact else object        # sums beyond 2^53 are made of Python's integers
        a, data = a.astype(kind), self.floats if exact else self.ints.astype(object)
        order = np.argsort(-np.abs(a.astype(float)), kind="stable")
        one, two = a * self.low.astype(kind), a * self.high.astype(kind)
        least, most = np.minimum(one, two)[order], np.maximum(one, two)[order]
        rest = lambda x, k: x[k:].sum() if k < len(x) else 0
        score = np.zeros(len(rows), kind)
        for k in range(0, len(order), STEP):
            dims = order[k:k + STEP]
            part = data[dims] if len(rows) == data.shape[1] else data[np.ix_(dims, rows)]
            score = score + a[dims] @ part
            keep = useful(score + rest(least, k + STEP), score + rest(most, k + STEP))
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score


def _best(score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((uid, vec_id, -score))[:n]


def _positives(width: int, n: int):
    """Best n other rows of the anchor's label in a tile."""
    schema = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            tile, vectors = Tile(rows, width), _matrix(anchors.column("v"), width)
            same = {}
            for i, (uid, label) in enumerate(zip(anchors.column("uid").to_numpy(), anchors.column("label").to_numpy())):
                if label not in same:
                    same[label] = np.flatnonzero(tile.label == label)
                cand = same[label][tile.uid[same[label]] != uid]

                def useful(least, most):
                    return np.ones(len(most), bool) if len(least) <= n else most >= np.partition(least, len(least) - n)[len(least) - n]

                at, score = tile.scan(vectors[:, i], cand, useful)
                for j in _best(score, tile.vec_id[at], tile.uid[at], n):
                    out.append((int(uid), int(tile.uid[at[j]]), int(tile.vec_id[at[j]]), min(max(int(score[j]), LONG[0]), LONG[1])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)

    return run


def _negatives(width: int, n: int, low: int, high: int):
    """Best n rows of other labels in a tile for each window low * p <= 100 * score <= high * p of an anchor."""
    schema = pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("negative", pa.int64()), ("negative_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            tile, vectors = Tile(rows, width), _matrix(anchors.column("v"), width)
            other = {}
            for i, (uid, label, found) in enumerate(zip(anchors.column("uid").to_numpy(), anchors.column("label").to_numpy(),
                                                        anchors.column("positives").to_pylist())):
                if label not in other:
                    other[label] = np.flatnonzero(tile.label != label)
                windows = [(p["k"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in found]
                windows = [w for w in windows if w[1] <= w[2]]

                def useful(least, most):
                    keep = np.zeros(len(most), bool)
                    for _, a, b in windows:
                        may = (most >= a) & (least <= b)
                        sure = least[(least >= a) & (most <= b)]
                        if len(sure) > n:
                            may &= most >= np.partition(sure, len(sure) - n)[len(sure) - n]
                        keep |= may
                    return keep

                if not windows:
                    continue
                at, score = tile.scan(vectors[:, i], other[label], useful)
                for k, a, b in windows:
                    inside = np.flatnonzero((score >= a) & (score <= b))
                    for j in inside[_best(score[inside], tile.vec_id[at[inside]], tile.uid[at[inside]], n)]:
                        out.append((int(uid), k, int(tile.uid[at[j]]), int(tile.vec_id[at[j]]), min(max(int(score[j]), LONG[0]), LONG[1])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)

    return run


def _ranked(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame, *, anchor_every: int = 100, scale: int = 256, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    Components become floor(scale * x), scores are their integer inner products; ties go by the smaller vec_id. Anchors
    are rows whose vec_id is divisible by ``anchor_every``. Positives are an anchor's best other rows of its label; for
    each of them the best rows of other labels with low % to high % of the positive's score.

    Edge cases: rows with a null vec_id, label or vector, or a component that is null or not finite, take no part. Rows
    that repeat a vec_id are rows of their own (each anchor row has its results, the other row may be its positive).
    Vectors of different lengths are compared as if filled with 0. Components beyond 2^62 count as 2^62; scores beyond
    the long range are given as its ends. Empty tables give empty results; other columns are ignored.
    """
    rows = saved(_vectors(embeddings, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    n, m, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    tiles = math.ceil(max(n, 1) / min(max(n // 64, TILE_ROWS[0]), TILE_ROWS[1]))
    packs = math.ceil(max(m, 1) / TILE_ANCHORS)

    def spread(col: str, into: int):
        return F.explode(F.sequence(F.lit(0), F.lit(into - 1))).alias(col)

    def dealt(of: int):
        return F.pmod(F.xxhash64("uid"), F.lit(of)).cast("int")

    placed = rows.select("*", dealt(tiles).alias("tile"), spread("pack", packs)).groupBy("tile", "pack")
    anchors = rows.filter(is_anchor)

    def against(anchors: DataFrame, run, schema: str) -> DataFrame:
        cells = anchors.select("*", dealt(packs).alias("pack"), spread("tile", tiles)).groupBy("tile", "pack")
        return placed.cogroup(cells).applyInArrow(run, schema)

    pos = against(anchors, _positives(width, positives), "uid long, other long, other_id long, score long")
    pos = _ranked(pos, ["uid"], [F.desc("score"), "other_id", "other"], positives)
    found = pos.groupBy("uid").agg(F.collect_list(F.struct(F.col("rank").alias("k"), F.col("other_id").alias("id"), "score")).alias("positives"))
    armed = saved(anchors.join(found, "uid"), "anchors")
    neg = against(armed, _negatives(width, negatives, low, high), "uid long, k int, negative long, negative_id long, score long")
    neg = _ranked(neg, ["uid", "k"], [F.desc("score"), "negative_id", "negative"], negatives)
    told = armed.select("uid", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select(
        "uid", "anchor_id", F.col("p.k").alias("k"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return neg.join(told, ["uid", "k"]).select(F.col("anchor_id").cast("long"), F.col("positive_id").cast("long"), F.col("rank").cast("int"),
                                               "negative_id", "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM pair WHERE same) WHERE k <= 5),
neg AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM pos p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
