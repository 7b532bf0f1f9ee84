"""Scoring with a factor model.

A model is three things: the global mean ``mu``, a user table
``(user_id, bias, uvec ARRAY<DOUBLE>)`` and an item table
``(business_id, bias, ivec ARRAY<DOUBLE>)``, with
``score = mu + bias_u + bias_i + uvec . ivec``.  Plain matrix factorisation uses
``uvec = p, ivec = q``; the hybrid model folds its feature terms in as
``uvec = [p + alpha*xWu, p]`` and ``ivec = [q, beta*yWi]`` (same prediction).

Top-N for all users is a block join: users and items are dealt into blocks of bounded size, and
a task has one block of users against one of items. The Cauchy-Schwarz bound ``|u| |i| + bias`` tells which item
blocks, and within a block which rest of it, cannot reach a user's best any more: the items that can add most are in
the first block, which every user meets. Each block pair
keeps a user's best ``n + (items the user already rated)``, which is enough after the rated items are
taken out; ``row_number`` is cut per partition before its shuffle.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from placerank.functions.expr import clip, dot
from placerank.models.common import materialize

BLOCK_USERS = 8_192
BLOCK_ITEMS = 65_536
# Users of a block for the item blocks after the first, which few users meet.
LATE_USERS = 32_768
# Bands of norms in the description of an item block.
BANDS = 8
# Users and items of one matrix product inside a task (bounds the score block in memory).
STEP_USERS, STEP_ITEMS = 256, 4_096


@dataclass
class FactorModel:
    mu: float
    users: DataFrame   # user_id, bias, uvec
    items: DataFrame   # business_id, bias, ivec


def _score(mu) -> F.Column:
    return F.lit(mu) + F.col("u_bias") + F.col("i_bias") + dot("uvec", "ivec")


def _u(model: FactorModel) -> DataFrame:
    return model.users.select("user_id", F.col("bias").alias("u_bias"), "uvec")


def _i(model: FactorModel) -> DataFrame:
    return model.items.select("business_id", F.col("bias").alias("i_bias"), "ivec")


def score_pairs(model: FactorModel, pairs: DataFrame) -> DataFrame:
    """J13 / M5 - predicted rating for given (user_id, business_id) pairs; null when either
    id is unknown to the model; not clipped."""
    j = pairs.join(_u(model), "user_id", "left").join(_i(model), "business_id", "left")
    return j.withColumn("predicted_rating", F.when(F.col("uvec").isNotNull() & F.col("ivec").isNotNull(),
                                                   _score(model.mu))).drop("u_bias", "i_bias", "uvec", "ivec")


def predict_test(model: FactorModel, test: DataFrame, lo: float = 1.0, hi: float = 5.0,
                 clip_scores: bool = True) -> DataFrame:
    """M3 - test rows (user_id, business_id, stars) -> predictions; unknown user or item ->
    global mean; known pairs clipped to [lo, hi] unless ``clip_scores`` is False."""
    s = score_pairs(model, test)
    est = F.coalesce(F.col("predicted_rating"), F.lit(float(model.mu)))
    if clip_scores:
        est = F.when(F.col("predicted_rating").isNotNull(), clip(est, lo, hi)).otherwise(est)
    return s.select("user_id", "business_id", F.col("stars").cast("double").alias("actual_rating"),
                    est.alias("predicted_rating"))


def top_n(scored: DataFrame, n: int, key: str = "user_id", score: str = "predicted_rating",
          item: str = "business_id") -> DataFrame:
    """W3 - the best ``n`` rows per key by score desc (ties: item id); adds ``rank``.

    ``row_number <= n`` lets Spark cut every partition to ``n`` rows per key before the
    shuffle, so a key with a huge share of rows costs no more than any other.
    """
    w = Window.partitionBy(key).orderBy(F.round(F.col(score), 9).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _arrays(rows: pa.Table, vec: str) -> np.ndarray:
    col = rows.column(vec).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _block_scores(mu: float, n: int, min_rating: float | None, schema: pa.Schema, floors: bool = False):
    """The Arrow function of one block pair: per user the best ``n + n_rated`` items by (score, smallest id), of those that
    reach the user's ``floor`` if there is such a column. With ``floors`` each user gets one more row, without an item, whose
    score is the floor for items of other blocks."""

    def run(users: pa.Table, items: pa.Table) -> pa.Table:
        out = []
        if users.num_rows and items.num_rows:
            v, bias, ids = _arrays(items, "ivec"), items.column("i_bias").to_numpy(), items.column("business_id").to_numpy()
            norms = np.sqrt((v * v).sum(axis=1))
            u, u_bias = _arrays(users, "uvec"), users.column("u_bias").to_numpy()
            u_norm, uid = np.sqrt((u * u).sum(axis=1)), users.column("user_id").to_numpy()
            want = n + users.column("n_rated").to_numpy()
            low = np.full(len(u), -np.inf if min_rating is None else min_rating)
            given = users.column("floor").to_numpy() if "floor" in users.column_names else low
            by_norm = np.argsort(u_norm, kind="stable")
            for s in range(0, len(u), STEP_USERS):
                rows = by_norm[s:s + STEP_USERS]
                best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in rows]
                floor = given[rows].copy()
                # what an item can add for the longest of these vectors; by falling reach, so that a rest can be left out
                reach = bias + np.nan_to_num(u_norm[rows]).max() * norms
                order = np.argsort(-reach, kind="stable")
                for i in range(0, len(v), STEP_ITEMS):
                    take = order[i:i + STEP_ITEMS]
                    # rounding is to 9 places, so the bound has some room
                    live = np.flatnonzero(mu + u_bias[rows] + reach[take[0]] + 1e-6 >= floor)
                    if not len(live):
                        break
                    raw = mu + u_bias[rows[live]][:, None] + bias[take][None, :] + u[rows[live]] @ v[take].T
                    good = raw >= floor[live][:, None] - 1e-6
                    if min_rating is not None:
                        good &= raw >= min_rating
                    for j in np.flatnonzero(good.any(axis=1)):
                        at, scores = best[live[j]]
                        at, scores = np.r_[at, take[good[j]]], np.r_[scores, raw[j, good[j]]]
                        most = want[rows[live[j]]]
                        if len(at) >= most:
                            first = np.lexsort((ids[at], -np.round(scores, 9)))[:most]
                            at, scores = at[first], scores[first]
                            floor[live[j]] = max(floor[live[j]], scores.min() - 1e-6)
                        best[live[j]] = (at, scores)
                out += [(np.full(len(at), r), at, scores) for r, (at, scores) in zip(rows, best) if len(at)]
                if floors:
                    out.append((rows, np.full(len(rows), -1), floor))
        if not out:
            return schema.empty_table()
        row, at, scores = (np.concatenate(c) for c in zip(*out))
        return pa.Table.from_arrays([pa.array(uid[row], schema.field(0).type), pa.array(ids[np.maximum(at, 0)], schema.field(1).type, mask=at < 0),
                                     pa.array(scores)], schema=schema)

    return run


def _numbered(rows: DataFrame, *order) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their ``position`` (from 0) in a total order, saved, and the sizes of the partitions (one row each)."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    local = materialize(ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = local.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_at"))
    return out.drop("_part", "_at", "_before"), sizes


def _within_reach(users: DataFrame, items: DataFrame, mu: float) -> DataFrame:
    """``users(u_bias, uvec, floor)`` with ``wanted``, the item blocks (ib, 1 and up) with an item whose score may reach their floor.

    A block is described by the largest bias and norm of its items of each of ``BANDS`` bands of norms.
    """
    top = items.agg(F.max("norm")).first()[0] or 1.0
    band = F.least(F.lit(BANDS - 1), F.floor(F.col("norm") / F.lit(top) * BANDS))
    bands = items.filter("ib > 0").groupBy("ib", band.alias("band")).agg(F.max("i_bias").alias("bias"), F.max("norm").alias("norm"))
    # one entry of a few numbers for each item block
    blocks = bands.groupBy("ib").agg(F.collect_list(F.struct("bias", "norm")).alias("bands")).agg(F.collect_list(F.struct("ib", "bands")))
    reach = lambda x: F.lit(mu) + F.col("u_bias") + x["bias"] + F.col("u_norm") * x["norm"] + F.lit(1e-6)
    users = users.withColumn("u_norm", F.sqrt(dot("uvec", "uvec"))).withColumn("_blocks", blocks.scalar())
    wanted = F.filter("_blocks", lambda b: F.exists(b["bands"], lambda x: reach(x) >= F.col("floor")))
    return users.withColumn("wanted", F.transform(wanted, lambda b: b["ib"])).drop("u_norm", "_blocks")


def _candidates(users: DataFrame, items: DataFrame, mu: float, n: int, min_rating: float | None) -> DataFrame:
    """Best ``n + n_rated`` items for ``users(user_id, u_bias, uvec, n_rated)``, and more.

    Items are numbered by what they can add for a user with a vector of usual length, and cut into blocks. All users meet the
    first block, which gives each a floor; of the others they meet those that hold an item that may reach it.
    """
    n_users, n_items = users.count(), items.count()
    types = {"user_id": users.schema["user_id"].dataType, "business_id": items.schema["business_id"].dataType}
    schema = pa.schema([(c, to_arrow_type(t)) for c, t in types.items()] + [("predicted_rating", pa.float64())])
    ddl = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", predicted_rating double"

    def dealt(df: DataFrame, size: int) -> DataFrame:
        return df.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(math.ceil(max(n_users, 1) / size))).cast("int"))

    def scored(left: DataFrame, right: DataFrame, floors: bool = False) -> DataFrame:
        """``left`` and ``right`` with the columns ub and ib of their block pair."""
        return left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInArrow(_block_scores(mu, n, min_rating, schema, floors), ddl)

    def first_block(right: DataFrame, floors: bool = False) -> DataFrame:
        left = dealt(users, BLOCK_USERS)
        blocks = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(max(n_users, 1) / BLOCK_USERS) - 1)))
        return scored(left.withColumn("ib", F.lit(0)), right.withColumn("ib", F.lit(0)).withColumn("ub", blocks), floors)

    if n_items <= BLOCK_ITEMS:
        return first_block(items)
    usual = users.agg(F.avg(F.sqrt(dot("uvec", "uvec")))).first()[0] or 0.0
    items = items.withColumn("norm", F.sqrt(dot("ivec", "ivec"))).withColumn("reach", F.col("i_bias") + F.lit(usual) * F.col("norm"))
    placed, _ = _numbered(items, F.col("reach").desc(), F.col("business_id"))
    placed = materialize(placed.drop("reach").withColumn("ib", F.floor(F.col("position") / BLOCK_ITEMS).cast("int")).drop("position"))
    first = materialize(first_block(placed.filter("ib = 0"), floors=True))
    floors = first.filter("business_id is null").groupBy("user_id").agg(F.min("predicted_rating").alias("floor"))
    low = F.lit(float("-inf") if min_rating is None else float(min_rating))
    late = dealt(users.join(floors, "user_id", "left").withColumn("floor", F.coalesce("floor", low)), LATE_USERS)
    late = materialize(_within_reach(late, placed, mu))
    left = late.withColumn("ib", F.explode("wanted")).drop("wanted")
    met = late.select(F.col("ub").alias("ub"), F.explode("wanted").alias("ib")).distinct()
    return first.filter("business_id is not null").unionByName(scored(left, placed.join(met, "ib")))


def recommend_top_n(model: FactorModel, rated: DataFrame, n: int = 10, min_rating: float | None = 3.5,
                    users: DataFrame | None = None) -> DataFrame:
    """M4 / J11 / J12 / W3 - top ``n`` unrated items with score >= ``min_rating`` for every known
    user (or those in ``users``) -> (user_id, business_id, predicted_rating, rank).

    Candidates are the model's items (trained items) minus anything the user rated in
    ``rated`` (all reviews, train and test).  Scores are not clipped.
    """
    u = _u(model)
    if users is not None:
        u = u.join(users.select("user_id"), "user_id", "left_semi")
    n_rated = (rated.select("user_id", "business_id").join(model.items.select("business_id"), "business_id",
                                                             "left_semi")
               .distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rated")))
    # counted and read by each item block: once to the shared folder
    u = materialize(u.join(n_rated, "user_id", "left").fillna(0, subset=["n_rated"]))
    cand = _candidates(u, materialize(_i(model)), model.mu, n, min_rating)
    cand = cand.join(rated.select("user_id", "business_id"), ["user_id", "business_id"], "left_anti")
    return top_n(cand, n)


def recommend_new_users(model_items: DataFrame, mu: float, new_users: DataFrame, n: int = 100) -> DataFrame:
    """M6 - top ``n`` items for users known only by their vectors
    ``new_users(user_id, uvec)`` (bias 0): score = mu + b_i + uvec . ivec."""
    items = model_items.select("business_id", F.col("bias").alias("i_bias"), "ivec")
    u = new_users.select("user_id", F.lit(0.0).alias("u_bias"), "uvec", F.lit(0).cast("long").alias("n_rated"))
    return top_n(_candidates(materialize(u), materialize(items), mu, n, None), n)


def with_details(recs: DataFrame, business: DataFrame,
                 cols: tuple[str, ...] = ("name", "city", "state", "stars", "categories")) -> DataFrame:
    """J9 - recommendations left-joined with the business columns that exist."""
    have = [c for c in cols if c in business.columns]
    return recs.join(business.select("business_id", *have), "business_id", "left")


def exclude_rated(pairs: DataFrame, rated: DataFrame, trained_items: DataFrame) -> DataFrame:
    """J11 - drop pairs the user already rated; keep only items the model was trained on."""
    return (pairs.join(rated.select("user_id", "business_id"), ["user_id", "business_id"], "left_anti")
            .join(trained_items.select("business_id"), "business_id", "left_semi"))


def page_index(recs: DataFrame) -> DataFrame:
    """S11 - recommendations with their ``position`` (from 0) in the order (user_id, rank), and ``total``; saved in that
    order, so a page is a range of positions that Parquet's statistics find.

    Rows are range-partitioned and sorted once; a position is the row's place in its partition plus the rows of the
    partitions before it (one row a partition).
    """
    out, sizes = _numbered(recs, F.col("user_id"), F.col("rank"))
    return materialize(out.withColumn("total", sizes.agg(F.sum("_n")).scalar()))


def read_page(index: DataFrame, page_no: int = 1, per_page: int = 1000) -> DataFrame:
    """S11 - one page of a ``page_index``, with tolerant numeric casts; adds ``total_pages``."""
    first = (page_no - 1) * per_page
    rows = index.filter((F.col("position") >= first) & (F.col("position") < first + per_page)).drop("position")
    return (rows.withColumn("predicted_rating", F.col("predicted_rating").try_cast("double"))
            .withColumn("total_pages", F.ceil(F.col("total") / F.lit(per_page))))


def page(recs: DataFrame, page_no: int = 1, per_page: int = 1000) -> DataFrame:
    """S11 - one page of recommendations ordered by (user_id, rank); for several pages keep the ``page_index``."""
    return read_page(page_index(recs), page_no, per_page)
