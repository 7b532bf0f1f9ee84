"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set: its five-word shingles, each weighted by its count. Every unit of weight
of every possible shingle owns a stream of hashed darts: arrival times of a Poisson process, each dart
aimed at one of ``k`` coordinates. A document sees the darts of its own units up to a rank limit of about
(k ln k + 2k) darts in total, and keeps the earliest dart of each coordinate. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Runs of ``r`` coordinates form bands;
documents that share a band are compared exactly on their shingle counts.

The work goes in this order: signatures (one pass over the texts, vectorised over a batch); classes of
equal word sequences, so copies cost one representative; band buckets linked by ``linking.link`` without
forming a bucket's pairs; exact verification of the pairs that it asks for; membership of every document.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import saved, whole_text
from placerank.llm.linking import few, link
from placerank.llm.wordhash import U, grams, mix, pieces, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# 26 bands of 5: a pair at similarity 0.8 shares a band with probability 0.99997
BANDS, BAND_ROWS = 26, 5
DARTS = BANDS * BAND_ROWS
# One bit of each of 128 coordinates sketches a text; at similarity 0.8 a bit differs with probability 0.1, and
# more than MAX_SKETCH_BITS differ with probability 3e-6. Pairs beyond are not compared exactly.
MAX_SKETCH_BITS = 30


def _shingles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text index), grouped by text; a text of one to four words is one shingle."""
    g, doc, _ = grams(h, first, SHINGLE_WORDS)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE_WORDS))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(SHINGLE_WORDS):
                has = n[short] > i
                extra[has] = mix(extra[has] * U(0xA24BAED4963EE407) + h[first[short[has]] + i])
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def _content(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    n = np.diff(first)
    nth = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
    out = []
    for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
        with np.errstate(over="ignore"):
            c = np.concatenate([[U(0)], np.cumsum(mix(h ^ mix(nth + salt)))])
            out.append(mix(c[first[1:]] - c[first[:-1]] + n.astype(np.uint64)))
    return out[0], out[1]


def _units(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One seed for each unit of weight: the i-th occurrence of a shingle in its text."""
    key = mix(g ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key)
    key, g, doc = key[order], g[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
    with np.errstate(over="ignore"):
        return mix(g + U(0x2545F4914F6CDD1D) * nth.astype(np.uint64)), doc


def dart_signatures(seeds: np.ndarray, doc: np.ndarray, texts: int, k: int = DARTS) -> np.ndarray:
    """texts x k signature of units (seed, text); 0 in every coordinate of a text without units."""
    sig = np.zeros(texts * k, np.uint64)
    weight = np.bincount(doc, minlength=texts)
    goal = k * np.log(k) + 2 * k
    todo = weight > 0
    while todo.any():
        limit = goal / np.maximum(weight, 1)
        use = np.flatnonzero(todo[doc])
        s, d, t, nth = seeds[use], doc[use], np.zeros(len(use)), 0
        ranks, cells, ids = [], [], []
        while len(s):
            with np.errstate(over="ignore"):
                x = mix(s + U(2 * nth + 1) * U(0x9E6C63D0676A9A99))
            t = t - np.log1p(-(x >> U(11)).astype(np.float64) * 2.0 ** -53)
            go = t < limit[d]
            s, d, t, x = s[go], d[go], t[go], mix(x[go])
            ranks.append(t)
            cells.append(d * k + (x % U(k)).astype(np.int64))
            ids.append(x | U(1))
            nth += 1
        rank, cell, dart = np.concatenate(ranks), np.concatenate(cells), np.concatenate(ids)
        late = np.argsort(-rank, kind="stable")
        found = np.zeros(texts * k, np.uint64)
        found[cell[late]] = dart[late]              # the earliest dart is written last
        found = found.reshape(texts, k)
        full = todo & (found != 0).all(1)
        sig.reshape(texts, k)[full] = found[full]
        todo &= ~full                               # a coordinate without a dart: throw twice as many
        goal *= 2
    return sig.reshape(texts, k)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, key, c1, c2, m1, m2, bands array<long>): a hash of the text, of its words, the sketch and
    band keys; no bands without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, buf, off in pieces(batch.column(2)):
                n = len(off) - 1
                h, first = word_hashes(buf, off)
                c1, c2 = _content(h, first)
                sig = dart_signatures(*_units(*_shingles(h, first)), n).reshape(n, BANDS, BAND_ROWS)
                bit = np.ascontiguousarray(((sig.reshape(n, DARTS)[:, :128] >> U(17)) & U(1)).astype(np.uint8))
                sketch = np.packbits(bit, axis=1).reshape(-1).view(np.int64).reshape(n, 2)
                keys = np.repeat(mix(np.arange(BANDS, dtype=np.uint64))[None], n, 0)
                with np.errstate(over="ignore"):
                    for r in range(BAND_ROWS):
                        keys = mix(keys * U(0xD1342543DE82EF95) + sig[:, :, r])
                some = np.diff(first) > 0
                keys = keys[some].astype(np.int64).ravel()
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), keys)
                yield pa.record_batch([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(c1.astype(np.int64)),
                                       pa.array(c2.astype(np.int64)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), bands],
                                      names=["doc_id", "key", "c1", "c2", "m1", "m2", "bands"])

    text = whole_text(F.col(f"`{text_col}`"))
    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("t"))
            .mapInArrow(run, "doc_id long, key long, c1 long, c2 long, m1 long, m2 long, bands array<long>"))


def _shingle_counts(docs: DataFrame) -> DataFrame:
    """(node, c1, c2, t) -> (node, s array<long>): the unit seeds of the text whose content hash is (c1, c2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w1, w2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "c2"))
            for i, buf, off in pieces(batch.column("t")):
                n = len(off) - 1
                h, first = word_hashes(buf, off)
                c1, c2 = (c.astype(np.int64) for c in _content(h, first))
                seeds, doc = _units(*_shingles(h, first))
                order = np.argsort(doc, kind="stable")
                seeds, cut = seeds[order].view(np.int64), np.searchsorted(doc[order], np.arange(n + 1))
                same = np.flatnonzero((c1 == w1[i:i + n]) & (c2 == w2[i:i + n]))
                yield pa.record_batch([batch.column("node").slice(i, n).take(pa.array(same)),
                                       pa.array([seeds[cut[j]:cut[j + 1]] for j in same], pa.list_(pa.int64()))],
                                      names=["node", "s"])

    return docs.mapInArrow(run, "node long, s array<long>")


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two texts from their unit seeds, of which a text has none twice."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def alike_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``nodes (node, root, t)`` with different roots, among them all whose weighted Jaccard similarity reaches ``similarity``.

    Prefix filter: two such texts differ in few units, so they share one of the first units of either in an order common to
    all, rare units first. A unit that stands under one root only has no match in another text; a text with more of these
    than it may differ in has no pair and goes, which may leave more such units. The first unit shared bounds how
    many more can be. Texts under the root that most texts with a unit have are not joined with each other.
    """
    units = nodes.select("node", "root", F.size("t").alias("size"), F.explode("t").alias("s"))
    miss = F.floor(F.col("size") * F.lit(1 - similarity) + 1e-6).cast("int")
    left = None
    while True:
        shared = units.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
        shared = few(saved(shared.filter("low < high").select("s", "m"), "shared-units"))
        held = units.join(shared, "s").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("m", "s"))).alias("u"))
        held = saved(held.withColumn("alone", F.col("size") - F.size("u")).filter(F.col("alone") <= miss), "held")
        n = held.count()
        if n == 0 or (left is not None and n > 0.9 * left):
            break
        left, units = n, held.select("node", "root", "size", F.explode("u.s").alias("s"))
    first = held.select("node", "root", "size", "alone", F.posexplode(F.slice("u", F.lit(1), miss - F.col("alone") + 1)["s"]).alias("i", "s"))
    first = saved(first.select("node", "root", "size", "s", (F.col("size") - F.col("alone") - F.col("i")).alias("rest")), "first-units")
    most = first.groupBy("s", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("s").agg(
        F.max_by("root", F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("s", "most")
    first = first.join(most, "s")
    x = first.filter("root <> most").select("s", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("na"), F.col("rest").alias("la"))
    y = first.select("s", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.col("rest").alias("lb"), "most")
    once = (F.col("rb") == F.col("most")) | (F.col("a") < F.col("b"))
    enough = F.least("la", "lb") >= (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - 1e-6
    pairs = x.join(y, "s").filter((F.col("ra") != F.col("rb")) & once & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row -> (doc_id, key, class_id, group_id, group_size, kept).

    ``key`` is a hash of the text, ``class_id`` is the smallest id with the same word sequence, ``group_id`` the smallest id of the
    connected group of texts whose weighted Jaccard similarity reaches ``similarity``; ``group_size``
    counts its rows and ``kept`` marks the row to keep: the one whose id is ``group_id``.

    Edge cases: words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. A text of
    one to four words is one shingle. Null, empty and wordless texts are no duplicates of anything: each
    forms a group of its own with its own id. A row with a null id is grouped, but never names a group
    unless all its rows lack an id. Large band buckets are searched by central texts first; of what these leave in
    different groups all pairs that ``alike_pairs`` leaves are compared (see ``linking``). Rows that repeat
    an id with the same text are one document: each is marked kept or none. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = saved(signatures(docs, id_col=id_col, text_col=text_col), "signatures")
    wordy = rows.filter(F.size("bands") > 0)
    classes = saved(wordy.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"),
                                                  F.first(F.struct("m1", "m2")).alias("mark"), F.first("bands").alias("bands"))
                    .withColumn("node", F.monotonically_increasing_id()), "classes")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(F.col(f"`{text_col}`")).alias("t"))

    def details(nodes: DataFrame) -> DataFrame:
        need = few(saved(classes.join(nodes, "node").select("node", "c1", "c2", "class_id"), "need"))
        found = texts.join(need, F.col("doc_id").eqNullSafe(F.col("class_id"))).select("node", "c1", "c2", "t")
        return _shingle_counts(found).dropDuplicates(["node"]).withColumnRenamed("s", "t")

    def close(a: Column, b: Column) -> Column:
        return sum(F.bit_count(a[m].bitwiseXOR(b[m])) for m in ("m1", "m2")) <= MAX_SKETCH_BITS

    def check(pairs: DataFrame) -> DataFrame:
        return pairs.filter(weighted_jaccard(F.col("t_a"), F.col("t_b")) >= similarity).select("a", "b")

    def order(mark: Column, bucket: Column) -> Column:
        """The sketch from another bit on in each bucket."""
        turn = F.pmod(bucket, F.lit(64)).cast("int")
        return F.struct(F.call_function("shiftleft", mark["m1"], turn), F.call_function("shiftleft", mark["m2"], turn))

    groups = link(classes.select(F.explode("bands").alias("bucket"), "node", "mark"), close, details, check, order,
                  sieve=lambda nodes: alike_pairs(nodes, similarity))
    named = classes.join(groups, "node", "left").select("c1", "c2", "class_id", "n", F.coalesce("root", "node").alias("root"))
    total = named.groupBy("root").agg(F.min("class_id").alias("group_id"), F.sum("n").alias("group_size"))
    named = named.join(total, "root").select("c1", "c2", "class_id", "group_id", "group_size")
    out = rows.select("doc_id", "key", "c1", "c2", (F.size("bands") > 0).alias("w")).join(
        named.withColumn("w", F.lit(True)), ["c1", "c2", "w"], "left")
    alone = F.col("group_size").isNull()
    own = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(c))
    return out.select("doc_id", "key", own("class_id").alias("class_id"), own("group_id").alias("group_id"),
                      F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      (alone | F.col("doc_id").eqNullSafe(F.col("group_id"))).alias("kept"))
