"""Removal of repeated 100-byte strings by a distributed, sparse suffix sort.

A byte is removed when a string of ``LENGTH`` = 100 bytes that covers it starts earlier, too (in a smaller
document, or earlier in the same). Sorting every suffix of the corpus would move many times the input, so
only suffixes at *anchors* are sorted: in each window of 100 bytes the ``GRAM``-byte run with the smallest
hash. Equal windows have equal anchors, so no repeat is missed, and one anchor stands for all windows
(``lo`` .. ``hi``) that choose it.

1. Anchors of a task are sorted first by themselves, which settles copies inside the task.
2. The rest is range-partitioned by the leading 16 bytes of the suffix with splitters from a sample, so
   suffixes with an equal start always share a bucket and no comparison crosses a bucket's border.
   Buckets sort by multikey quicksort: by one key word, then by the next inside ties only.
3. Of anchors whose whole stretch of windows is equal, all but the earliest are repeats. Where
   stretches with an equal anchor differ (the ends of a repeat), their windows are compared one by one,
   but for those whose neighbourhood of 80 bytes differs already: they are routed by their own 96-bit hash, so even a passage in a third of all documents spreads out.
4. Spans of a document are merged and cut from its bytes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import saved, whole_text
from placerank.llm.wordhash import _RAW, U, mix, pieces, prefix_sums, range_hash

LENGTH = 100
GRAM = 24
SPREAD = LENGTH - GRAM + 1
LEAD = 16
FLUSH_BYTES = 32 << 20          # text whose anchors a task sorts at once before it sends them on
SAMPLE_DOCS = 1000
FLUSH_WINDOWS = 400_000
# Windows that choose an anchor, by how many bytes before it they start: (fewest, most). All windows of
# a part share the bytes from ``fewest`` before the anchor to ``LENGTH - most`` after it.
PARTS = [(0, 18), (19, 37), (38, 56), (57, SPREAD - 1)]
_RAW2 = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

ROUTED = ("bucket int, a array<int>, b array<int>, h array<int>, s array<long>, ids array<long>, "
          "pos array<int>, dl array<byte>, dh array<byte>, q array<long>")
SETTLED = "ends boolean, ids array<long>, a array<int>, b array<int>"
PACK = 20_000                   # ranges in a row


def anchors(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of the texts in ``buf``: text, position in the buffer, first and last window, the hashes of the gram
    and of the stretch, and (q) 16 bits of hash of what the windows of each of the four PARTS share."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return {"doc": empty, "at": empty, "lo": empty, "hi": empty, "h": empty.astype(U), "s": empty.astype(U),
                "q": empty.astype(U)}
    c = prefix_sums(buf, _RAW)
    start = np.arange(n - GRAM + 1)
    h = range_hash(c, start, start + GRAM)
    best = (h & U(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        best = np.minimum(best[:len(best) - width], best[width:])
        width *= 2
    rest = SPREAD - width
    if rest:
        best = np.minimum(best[:len(best) - rest], best[rest:])
    ok = np.zeros(n + 1, np.int32)                   # windows that lie inside one text
    long_ = np.diff(off) >= LENGTH
    np.add.at(ok, off[:-1][long_], 1)
    np.add.at(ok, off[1:][long_] - LENGTH + 1, -1)
    win = np.flatnonzero(np.cumsum(ok[:len(best)]) > 0)
    at = (best[win] & U(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return {"doc": empty, "at": empty, "lo": empty, "hi": empty, "h": empty.astype(U), "s": empty.astype(U),
                "q": empty.astype(U)}
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lo, hi, at = win[new], win[np.append(new[1:], len(win)) - 1], at[new]
    with np.errstate(over="ignore"):
        s = mix(range_hash(c, lo, hi + LENGTH) + (at - lo).astype(np.uint64))
    q = np.zeros(len(at), np.uint64)
    for i, (few, most) in enumerate(PARTS):     # out of the buffer: no window of this part
        shared = range_hash(c, np.maximum(at - few, 0), np.minimum(at - most + LENGTH, n))
        q |= (shared >> U(48)) << U(16 * i)
    return {"doc": np.searchsorted(off, at, "right") - 1, "at": at, "lo": lo, "hi": hi, "h": h[at], "s": s, "q": q}


def leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leading bytes of suffixes, as strings that sort by bytes."""
    cells = np.empty((len(at), LEAD), np.uint8)
    for i in range(LEAD):
        cells[:, i] = buf[at + i]
    return cells.reshape(-1).view(f"S{LEAD}")


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Order by several key words: sort by the first, then by the next only where all so far tie."""
    order = np.argsort(keys[0], kind="stable")
    k = keys[0][order]
    same = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.zeros(0, bool)
    for key in keys[1:]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(~same[at])
        sub = order[at]
        order[at] = sub[np.lexsort((key[sub], run))]
        k = key[order]
        same[1:] &= k[1:] == k[:-1]
    return order


def _runs(sorted_key: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(sorted_key) else np.zeros(0, bool)


def _join_ranges(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merge ranges that touch, per document -> (id, starts, ends)."""
    if not len(ids):
        return
    order = np.lexsort((lo, ids))
    ids, lo, hi = ids[order], lo[order], hi[order]
    head = _runs(ids)
    # a running maximum per document: shift each document beyond all before it
    step = np.int64(hi.max()) + 2
    base = (np.cumsum(head) - 1) * step
    reach = np.maximum.accumulate(hi + base)
    new = np.concatenate([[True], (lo + base)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    owner, starts, ends = ids[first], lo[first], reach[last] - base[last]
    cut = np.flatnonzero(_runs(owner))
    for i, j in zip(cut, np.append(cut[1:], len(owner)), strict=True):
        yield int(owner[i]), starts[i:j], ends[i:j]


class _Records:
    """Suffix records as columns, sorted so that the earliest of equal ones comes first."""

    def __init__(self, h, s, ids, pos, dl, dh, q):
        order = multikey_order(h, s, ids, pos)
        self.h, self.s, self.ids, self.pos, self.dl, self.dh, self.q = (x[order] for x in (h, s, ids, pos, dl, dh, q))
        self.order = order
        self.first = _runs(self.h) | _runs(self.s) if len(h) else np.zeros(0, bool)

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = ~self.first
        return self.ids[r], self.pos[r] - self.dl[r], self.pos[r] - self.dh[r] + LENGTH

    def ends(self):
        """Windows of first records whose anchor meets a different stretch that may hold the same window."""
        at = np.flatnonzero(self.first)
        if not len(at):
            return at, at, at
        group = np.cumsum(_runs(self.h[at]))
        at = at[np.bincount(group)[group] > 1]
        ids, lo, hi = [], [], []
        for i, (few, most) in enumerate(PARTS):
            part = (self.q[at].view(np.uint64) >> U(16 * i)) & U(0xFFFF)
            order = np.lexsort((part, self.h[at]))
            new = _runs(self.h[at][order]) | _runs(part[order])
            run = np.cumsum(new)
            k = at[order][np.bincount(run)[run] > 1] if len(order) else at
            low, high = self.pos[k] - np.minimum(most, self.dl[k]), self.pos[k] - np.maximum(few, self.dh[k]) + 1
            some = low < high
            ids.append(self.ids[k][some])
            lo.append(low[some])
            hi.append(high[some])
        return np.concatenate(ids), np.concatenate(lo), np.concatenate(hi)


def _merged(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = list(_join_ranges(ids, lo, hi))
    if not got:
        return ids, lo, hi
    return (np.repeat([d for d, _, _ in got], [len(a) for _, a, _ in got]), np.concatenate([a for _, a, _ in got]),
            np.concatenate([b for _, _, b in got]))


def _packed(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(0, len(ids), PACK):
        yield ids[i:i + PACK], lo[i:i + PACK].astype(np.int32), hi[i:i + PACK].astype(np.int32)


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
             pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int8()), pa.list_(pa.int64())]
    names = ["bucket", "a", "b", "h", "s", "ids", "pos", "dl", "dh", "q"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _send(h, s, ids, pos, dl, dh, q, bucket) -> Iterator[pa.RecordBatch]:
    """Settle what repeats inside the task; send the earliest record of each kind to its bucket."""
    r = _Records(h, s, ids, pos, dl, dh, q)
    rows = [(i, a, b, None, None, ids, *[None] * 4) for i, (ids, a, b) in enumerate(_packed(*_merged(*r.repeats())))]
    keep = np.flatnonzero(r.first)
    where = bucket[r.order][keep]
    keep = keep[np.lexsort((r.pos[keep], r.ids[keep], where))]
    where = bucket[r.order][keep]
    cut = np.flatnonzero(_runs(where))
    for i, j in zip(cut, np.append(cut[1:], len(keep)), strict=True):
        k = keep[i:j]
        rows.append((int(where[i]), None, None, (r.h[k] >> U(32)).astype(np.uint32).view(np.int32), r.s[k].view(np.int64),
                     r.ids[k], r.pos[k].astype(np.int32), r.dl[k].astype(np.int8), r.dh[k].astype(np.int8), r.q[k].view(np.int64)))
    for i in range(0, len(rows), 500):
        yield _routed(rows[i:i + 500])


def _flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if held:
        yield from _send(*[np.concatenate(x) for x in zip(*held, strict=True)])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All records of a bucket: mark repeats, name the windows at the ends of repeats."""
    held = []

    def out(ends: bool, rows) -> Iterator[pa.RecordBatch]:
        for ids, a, b in rows:
            yield pa.record_batch([pa.array([ends]), pa.array([ids], pa.list_(pa.int64())), pa.array([a], pa.list_(pa.int32())),
                                   pa.array([b], pa.list_(pa.int32()))], names=["ends", "ids", "a", "b"])

    kinds = {"h": np.int32, "s": np.int64, "ids": np.int64, "pos": np.int32, "dl": np.int8, "dh": np.int8, "q": np.int64}
    for batch in batches:
        done = batch.filter(batch.column("a").is_valid())
        if done.num_rows:
            yield pa.record_batch([pa.array(np.zeros(done.num_rows, bool)), done.column("ids"), done.column("a"), done.column("b")],
                                  names=["ends", "ids", "a", "b"])
        sent = batch.filter(batch.column("a").is_null())
        if sent.num_rows:
            held.append([np.array(sent.column(c).flatten().to_numpy(zero_copy_only=False), t) for c, t in kinds.items()])
    if held:
        h, s, ids, pos, dl, dh, q = (np.concatenate(x) for x in zip(*held, strict=True))
        r = _Records(h, s, ids, pos.astype(np.int64), dl.astype(np.int64), dh.astype(np.int64), q)
        yield from out(False, _packed(*r.repeats()))
        yield from out(True, _packed(*r.ends()))


def _splitters(docs: DataFrame, buckets: int) -> np.ndarray:
    """Leading bytes that cut the anchors of ``SAMPLE_DOCS`` documents (by a hash of the id) in equal parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in pieces(batch.column(0)):
                lead = np.sort(leading(buf, anchors(buf, off)["at"]))
                yield pa.record_batch([pa.array(lead[::max(1, len(lead) // 2000)].tolist(), pa.binary())], names=["lead"])

    some = docs.orderBy(F.xxhash64("id")).limit(SAMPLE_DOCS).select("text")
    lead = np.sort(np.array([bytes(r.lead) for r in some.mapInArrow(run, "lead binary").collect()], f"S{LEAD}"))
    return lead[np.linspace(0, len(lead), buckets + 1)[1:-1].astype(int)] if len(lead) else lead


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs (id long unique, text)`` -> (id, a, b): byte ranges to remove, not yet merged."""
    spark = docs.sparkSession
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = _splitters(docs, buckets)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, buf, off in pieces(batch.column(1)):
                x = anchors(buf, off)
                here = off[x["doc"]]
                bucket = np.searchsorted(splitters, leading(buf, x["at"]), "right") if len(splitters) else np.zeros(len(here), np.int64)
                held.append((x["h"], x["s"], ids[i + x["doc"]], x["at"] - here, x["at"] - x["lo"], x["at"] - x["hi"], x["q"], bucket))
                size += len(buf)
                if size >= FLUSH_BYTES:
                    yield from _flush(held)
                    held, size = [], 0
        yield from _flush(held)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            held, size = [], 0
            for i, buf, off in pieces(batch.column("text")):
                c1, c2 = prefix_sums(buf, _RAW), prefix_sums(buf, _RAW2)
                for j in range(len(off) - 1):
                    a, b = (np.asarray(batch.column(k)[i + j].as_py(), np.int64) for k in "ab")
                    n = b - a
                    p = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    h, s = (range_hash(c, p + off[j], p + off[j] + LENGTH) for c in (c1, c2))
                    zero = np.zeros(len(p), np.int64)
                    held.append((h, s, np.full(len(p), ids[i + j]), p, zero, zero, zero.view(np.uint64),
                                 (h % U(buckets)).astype(np.int64)))
                    size += len(p)
                    if size >= FLUSH_WINDOWS:
                        yield from _flush(held)
                        held, size = [], 0
            yield from _flush(held)

    settle = lambda df: saved(df.repartition(buckets, "bucket").mapInArrow(_settle, SETTLED), "repeats")
    ranges = lambda df: df.select(F.explode(F.arrays_zip("ids", "a", "b")).alias("r")).select(
        F.col("r.ids").alias("id"), "r.a", "r.b")
    first = settle(docs.select("id", "text").mapInArrow(send_anchors, ROUTED))
    ends = ranges(first.filter("ends")).groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    second = settle(ends.join(docs.select("id", "text"), "id").mapInArrow(send_windows, ROUTED)).filter("not ends")
    return ranges(first.filter("not ends").unionByName(second))


def remove_repeats(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """One row per input row -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]).

    Texts are UTF-8 bytes; ``n_spans`` counts maximal removed runs. What is cut may split a character, so
    ``kept`` is binary.

    Edge cases: a null text is empty; texts under 100 bytes lose nothing. Rows without an id come after
    all others; rows that share an id are ordered by a hash of their text; rows equal in id and text are one
    document and get the same result. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    if again:       # ids don't tell rows apart: number the different rows in order
        rows = rows.withColumn("key", F.xxhash64("text"))
        order = rows.select("doc_id", "key").distinct().repartitionByRange(
            F.col("doc_id").asc_nulls_last(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "key")
        order = saved(order.withColumn("id", F.monotonically_increasing_id()), "numbers") \
            .withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
        rows = rows.join(order, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))) \
            .select("doc_id", "id", "text")
        rows = saved(rows, "numbered")
        one = rows.dropDuplicates(["id"])
    else:
        rows = rows.withColumn("id", F.col("doc_id"))
        one = rows
    spans = repeated_spans(one).groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    kept = ", kept binary" if with_text else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rest, removed, runs = data, 0, 0
                if a.is_valid:
                    a, b = np.asarray(a.as_py(), np.int64), np.asarray(b.as_py(), np.int64)
                    rest, at = b"", 0
                    parts = []
                    for _, lo, hi in _join_ranges(np.zeros(len(a), np.int64), a, b):
                        runs = len(lo)
                        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                            parts.append(data[at:x])
                            at = y
                            removed += y - x
                    rest = b"".join([*parts, data[at:]])
                out.append((len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][:5 if with_text else 4]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return rows.join(spans, "id", "left").select("doc_id", "text", "a", "b").mapInArrow(
        cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")
