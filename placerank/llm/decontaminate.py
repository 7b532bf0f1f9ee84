"""Benchmark decontamination by greedy string tiling.

Seeds are hashes of ``SEED_WORDS`` consecutive words. Documents' seeds first pass a bitmap of the
benchmark's seed hashes (2^22 bits, whatever the benchmark's size), so only a few need the exact join
on the hash. All matches of a document and an item of at least ``SEED_WORDS`` words are runs of seeds on
one diagonal, so the tiles are found from the joined seeds alone: take the longest match whose words are
unmarked on both sides, mark it, cut what overlaps, repeat. A document is contaminated when the tiles
cover at least ``COVERAGE`` of an item's words, in whatever order its passages stand.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from placerank.llm.common import saved, whole_text
from placerank.llm.wordhash import U, grams, pieces, word_hashes

SEED_WORDS = 5
COVERAGE = 0.8
BITS = 22


def seeds_of(rows: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """(id, key, text) -> (id, key, n_words, seed, pos), seeds whose slot is set in ``bitmap`` (all if None)."""
    names = ["id", "key", "n_words", "seed", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, buf, off in pieces(batch.column(2)):
                h, first = word_hashes(buf, off)
                g, doc, pos = grams(h, first, SEED_WORDS)
                if bitmap is not None:
                    slot = (g >> U(64 - BITS)).astype(np.int64)
                    hit = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    g, doc, pos = g[hit], doc[hit], pos[hit]
                at = pa.array(doc + i)
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.diff(first)[doc]),
                                       pa.array(g.astype(np.int64)), pa.array(pos)], names=names)

    return rows.mapInArrow(run, "id long, key long, n_words long, seed long, pos long")


def tile(matches: list[tuple[int, int]], least: int = SEED_WORDS) -> int:
    """Words of the item covered by greedy string tiling, from seed matches (document word, item word)."""
    runs: list[list[int]] = []
    for diagonal, b in sorted((p - b, b) for p, b in set(matches)):
        if runs and runs[-1][0] == diagonal and b == runs[-1][2] + 1:
            runs[-1][2] = b
        else:
            runs.append([diagonal, b, b])
    heap = [(-(hi - lo + least), lo, diagonal) for diagonal, lo, hi in runs]
    heapq.heapify(heap)
    item: set[int] = set()
    document: set[int] = set()
    while heap:
        size, lo, diagonal = heapq.heappop(heap)
        free, piece, whole = [], [], True
        for b in range(lo, lo - size):
            if b in item or b + diagonal in document:
                whole = False
                free.append(piece)
                piece = []
            else:
                piece.append(b)
        if whole:
            item.update(piece)
            document.update(b + diagonal for b in piece)
        else:
            for part in (*free, piece):
                if len(part) >= least:
                    heapq.heappush(heap, (-len(part), part[0], diagonal))
    return len(item)


@F.arrow_udf(LongType())
def covered_words(matches: pa.Array) -> pa.Array:
    """Covered item words for each list of seed matches struct(pos, at)."""
    out = []
    for row in matches:
        v = row.values
        out.append(tile(list(zip(v.field(0).to_pylist(), v.field(1).to_pylist(), strict=True))))
    return pa.array(out, pa.int64())


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def contamination(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """Pairs (doc_id, key, item_id, covered) with coverage of the item's words >= ``coverage``.

    ``key`` is a hash of the text, so that rows which share an id are told apart."""
    text = whole_text()
    items = benchmark.select(F.col("item_id").cast("long"), F.lit(0).cast("long"), whole_text())
    items = saved(seeds_of(items).select(F.col("id").alias("item_id"), F.col("n_words").alias("n"), "seed",
                                         F.col("pos").alias("at")), "items")
    slots = items.select(F.shiftrightunsigned("seed", 64 - BITS).alias("s")).distinct()   # at most 2^22 rows
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    slot = slots.toPandas()["s"].to_numpy(np.int64)
    np.bitwise_or.at(bitmap, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
    found = seeds_of(docs.select(F.col("doc_id").cast("long"), _key(text), text), bitmap)
    pairs = (found.select(F.col("id").alias("doc_id"), "key", "seed", "pos").join(items, "seed")
             .groupBy("doc_id", "key", "item_id", "n")
             .agg(F.collect_set(F.struct("pos", "at")).alias("m"), F.count_distinct("at").alias("places"))
             # places seeds cover at most 5 words each: too few can't reach the threshold
             .filter(F.col("places") * SEED_WORDS >= coverage * F.col("n")))
    covered = pairs.select("doc_id", "key", "item_id", (covered_words("m") / F.col("n")).alias("covered"))
    return covered.filter(F.col("covered") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items``, ``item_ids`` (array, sorted) and ``covered`` (best coverage, else 0).

    Edge cases: words as in the near-duplicate operator; an item or document of fewer than five words never
    matches. Items with equal texts are all reported; a null item text is empty; items that share an id count
    as one where they have as many words. A null or empty document is clean. Rows that repeat id and text get the
    same verdict. Columns of ``docs`` with the added names are replaced; empty tables on either side leave
    every document clean.
    """
    found = contamination(docs, benchmark, coverage=coverage).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set("item_id")).alias("_items"), F.max("covered").alias("_covered"))
    found = saved(found, "contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_items", "_covered")
    base = docs.drop("contaminated", "n_items", "item_ids", "covered")
    out = base.withColumn("_k", _key(whole_text())).join(
        found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    keep = [F.col(f"`{c}`") for c in base.columns]
    return out.select(*keep, F.col("_items").isNotNull().alias("contaminated"),
                      F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("_items", F.array().cast("array<long>")).alias("item_ids"),
                      F.coalesce("_covered", F.lit(0.0)).alias("covered"))
