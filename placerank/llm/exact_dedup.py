"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

The digests of a few texts may make up a large part of all rows. A Misra-Gries style frequent-items
sketch (``approx_top_k``: map-side counters, merged) names at most ``max_heavy`` candidate digests;
their exact counts and winners are aggregated, those confirmed as heavy form a table of at most
``max_heavy`` rows that is broadcast, and their rows are settled on the map side. All other digests,
each with few rows by the sketch's bound, use an ordinary shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import saved, whole_text

BLANKS = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = 1000,
                counters: int = 10_000, heavy_rows: int = 64) -> DataFrame:
    """One row per input row -> (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical without blanks (``[\\x20\\x09-\\x0D]``). Of equal texts the row
    with the most code points, then the smallest id, stays. ``max_heavy`` bounds the broadcast table
    (64 bytes a row); ``counters`` is the sketch's size; a candidate counts as heavy with at least
    ``heavy_rows`` rows. These shape the plan only, never the result.

    Edge cases: a null text counts as empty and all empty texts are one group. A null id never wins
    against another id of the same length. Rows that repeat id and text are counted one by one in
    ``group_size``; each row whose id is the winner's has ``kept`` true. An empty table gives an
    empty result. Other columns of the input, whatever their names, are ignored.
    """
    text = whole_text(F.col(f"`{text_col}`"))
    rows = saved(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.length(text).cast("long").alias("n"),
        F.unhex(F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256)).alias("d")), "digests")
    best = [F.max(F.struct("n", (-F.col("doc_id")).alias("neg"))).alias("w"), F.count(F.lit(1)).alias("group_size")]

    tops = rows.agg(F.expr(f"approx_top_k(hex(d), {int(max_heavy)}, {int(max(counters, max_heavy))})").alias("t"))
    candidates = tops.select(F.explode("t").alias("t")).select(F.unhex("t.item").alias("d"))   # at most max_heavy rows
    heavy = saved(rows.join(F.broadcast(candidates), "d").groupBy("d").agg(*best)
                  .filter(F.col("group_size") >= heavy_rows), "heavy")

    marked = rows.join(F.broadcast(heavy), "d", "left")
    light = marked.filter("group_size is null").select("doc_id", "n", "d")
    settled = marked.filter("group_size is not null")
    rest = light.join(light.groupBy("d").agg(*best), "d")
    out = settled.select("doc_id", "w", "group_size", "d").unionByName(rest.select("doc_id", "w", "group_size", "d"))
    keep = -F.col("w.neg")
    return out.select("doc_id", keep.alias("keep_id"), "group_size",
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("d")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS d FROM documents),
     w AS (SELECT d, doc_id AS keep_id, row_number() OVER (PARTITION BY d ORDER BY n DESC, doc_id) AS k,
                  count(*) OVER (PARTITION BY d) AS group_size FROM t)
SELECT t.doc_id, w.keep_id, w.group_size, t.doc_id = w.keep_id AS kept, t.d AS text_sha256
FROM t JOIN w ON t.d = w.d AND w.k = 1
"""
