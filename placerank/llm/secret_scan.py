"""Secrets in texts, also where they hide under layers of encoding.

A worklist of layers: the text is the first; each layer is scanned with the patterns and unwrapped into further
ones (URL and Unicode escapes, base64, gzip, zlib, bzip2, xz), which are the next round's worklist, until a round
leaves none. Each character of a layer knows the span of the text that it stands for, so a find in any depth is
reported where it lies in the text. A layer remembers the contents it came through, and one that comes again ends.
"""
from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from placerank.llm.common import saved, whole_text

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
# no find and no encoded token goes beyond such a run
REGION = re.compile(r"""[A-Za-z0-9+/_.="':%\\{}\x20-]+""")
# the shortest secret has 16 characters, 22 in base64
TOKENS = (re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{20,}={0,2}"),
          re.compile(r"(?:[A-Za-z0-9+/]{20,}\r?\n)+[A-Za-z0-9+/]+={0,2}"))
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
MAX_LAYER = 16 << 20
BATCH_BYTES = 32 << 20     # layers written at a time

SPAN = "struct<start:int,kind:int,end:int>"
LAYER = "struct<text:string,lo:binary,hi:binary,start:int,end:int,chain:array<long>,over:boolean>"
PA_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
PA_LAYER = pa.struct([("text", pa.string()), ("lo", pa.binary()), ("hi", pa.binary()), ("start", pa.int32()), ("end", pa.int32()),
                      ("chain", pa.list_(pa.int64())), ("over", pa.bool_())])


def _mark(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret, leftmost and non-overlapping by kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _inflate(raw: bytes, limit: int) -> tuple[bytes, bool] | None:
    """What compressed bytes hold (at most ``limit``) and whether there was more; None if not compressed."""
    if raw[:2] == b"\x1f\x8b":
        box = zlib.decompressobj(31)
    elif len(raw) > 6 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        box = zlib.decompressobj()
    elif raw[:3] == b"BZh":
        box = bz2.BZ2Decompressor()
    elif raw[:6] == b"\xfd7zXZ\0":
        box = lzma.LZMADecompressor(memlimit=1 << 28)
    else:
        return None
    try:
        out = box.decompress(raw, limit + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    return out[:limit], len(out) > limit


def _readable(raw: bytes, whole: bool = True) -> tuple[str, int] | None:
    """Bytes as a text of characters without controls and the bytes that a character takes (0: they differ)."""
    wide = 0
    if len(raw) >= 8 and (not any(raw[1::2]) or not any(raw[::2])):
        wide = 2
        code = "utf-16-le" if not any(raw[1::2]) else "utf-16-be"
        raw = raw[:len(raw) // 2 * 2]
    else:
        code = "utf-8"
    try:
        text = raw.decode(code, "strict" if whole else "ignore")
    except UnicodeDecodeError:
        return None
    return None if CONTROL.search(text) else (text, wide or int(text.isascii()))


def _peel(raw: bytes, chain: list[int], limit: int) -> tuple[str, int, list[int], bool, bool] | None:
    """Compressed layers taken off: (text, bytes a character, chain, was compressed, cut at the limit)."""
    packed = over = False
    while True:
        here = _mark(raw)
        if here in chain:
            return None
        chain = chain + [here]
        inner = _inflate(raw, limit)
        if inner is None:
            text = _readable(raw, not over)
            return None if text is None or not text[0] else (*text, chain, packed, over)
        raw, packed, over = inner[0], True, over or inner[1]


def _unescape(run: str) -> Iterator[tuple[str, int, int]]:
    """Characters of an escape with their places in it."""
    if run[0] != "%":
        code = int(run[2:].strip("{}"), 16)
        yield chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", 0, len(run)
        return
    raw, at = binascii.unhexlify(run.replace("%", "")), 0
    try:
        chars = raw.decode()
        sizes = [len(c.encode()) for c in chars]
    except UnicodeDecodeError:
        chars, sizes = raw.decode("latin-1"), [1] * len(raw)
    for c, n in zip(chars, sizes):
        yield c, 3 * at, 3 * (at + n)
        at += n


class Layer:
    """A text and, for each of its characters, the span of the document that it stands for."""

    def __init__(self, text: str, lo=None, hi=None, span: tuple[int, int] | None = None, chain: list[int] | None = None, over=False):
        self.text, self.lo, self.hi, self.span, self.over = text, lo, hi, span, over
        self.chain = [_mark(text.encode())] if chain is None else chain

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.span:
            return self.span
        return (start, end) if self.lo is None else (int(self.lo[start]), int(self.hi[end - 1]))

    def _inner(self, text: str, lo: np.ndarray, hi: np.ndarray, chain: list[int]) -> "Layer":
        """A layer whose characters come from [lo, hi) of this one."""
        if self.span:
            return Layer(text, span=self.span, chain=chain)
        if self.lo is not None:
            lo, hi = self.lo[lo], self.hi[hi - 1]
        return Layer(text, lo.astype(np.int32), hi.astype(np.int32), chain=chain)

    def unwrap(self, limit: int) -> Iterator["Layer"]:
        yield from self._escapes(limit)
        yield from self._base64(limit)

    def _escapes(self, limit: int) -> Iterator["Layer"]:
        if "%" not in self.text and "\\" not in self.text:
            return
        for region in REGION.finditer(self.text):
            if not ESCAPE.search(region[0]):
                continue
            text, lo, hi, at = [], [], [], region.start()
            for m in ESCAPE.finditer(self.text, *region.span()):
                text.append(self.text[at:m.start()])
                lo.extend(range(at, m.start()))
                hi.extend(range(at + 1, m.start() + 1))
                for c, s, e in _unescape(m[0]):
                    text.append(c)
                    lo.append(m.start() + s)
                    hi.append(m.start() + e)
                at = m.end()
                if m[0][0] == "%":
                    inner = _peel(binascii.unhexlify(m[0].replace("%", "")), self.chain, limit)
                    if inner and inner[3]:
                        yield Layer(inner[0], span=self.place(*m.span()), chain=inner[2], over=inner[4])
            text.append(self.text[at:region.end()])
            lo.extend(range(at, region.end()))
            hi.extend(range(at + 1, region.end() + 1))
            out = "".join(text)
            here = _mark(out.encode())
            if here not in self.chain:
                yield self._inner(out, np.array(lo), np.array(hi), self.chain + [here])

    def _base64(self, limit: int) -> Iterator["Layer"]:
        seen = set()
        for pattern in TOKENS:
            for m in pattern.finditer(self.text):
                if m.span() in seen:
                    continue
                seen.add(m.span())
                body = m[0].rstrip("=")
                at = None
                if "\n" in body:
                    at = np.flatnonzero(~np.isin(np.frombuffer(body.encode(), np.uint8), (10, 13)))
                    body = body.replace("\r", "").replace("\n", "")
                if len(body) % 4 == 1:
                    continue
                raw = base64.b64decode(body + "=" * (-len(body) % 4), b"-_" if "-" in body or "_" in body else None)
                inner = _peel(raw, self.chain, limit)
                if inner is None:
                    continue
                text, wide, chain, packed, over = inner
                if packed:
                    yield Layer(text, span=self.place(*m.span()), chain=chain, over=over)
                    continue
                sizes = np.full(len(text), wide) if wide else np.array([len(c.encode()) for c in text])
                ends = np.cumsum(sizes)
                first, last = (ends - sizes) * 4 // 3, -(-ends * 4 // 3) - 1
                if at is not None:
                    first, last = at[first], at[last]
                yield self._inner(text, m.start() + first, m.start() + last + 1, chain)

    def row(self) -> dict:
        pack = lambda a: None if a is None else a.tobytes()
        start, end = self.span or (None, None)
        return {"text": self.text, "lo": pack(self.lo), "hi": pack(self.hi), "start": start, "end": end, "chain": self.chain, "over": self.over}

    @staticmethod
    def of(row: dict) -> "Layer":
        read = lambda b: None if b is None else np.frombuffer(b, np.int32)
        return Layer(row["text"], read(row["lo"]), read(row["hi"]), None if row["start"] is None else (row["start"], row["end"]),
                     row["chain"], row["over"])


def _rows(schema: pa.Schema, each):
    """Batches of the rows that ``each`` makes of input rows; it gives the row and the size of its layers."""
    def run(batches):
        out, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)]):
                made, layers = each(*[v.as_py() for v in row])
                out.append({**made, "layers": layers})
                size += 200 + sum(len(x["text"]) * 9 for x in layers)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _texts(id_type: pa.DataType, limit: int):
    """(doc_id, text) -> (doc_id, key, base spans, layers below)."""
    schema = pa.schema([("doc_id", id_type), ("key", pa.string()), ("base", pa.list_(PA_SPAN)), ("layers", pa.list_(PA_LAYER))])

    def each(doc_id, text):
        layer = Layer(text)
        base = [dict(zip(("start", "kind", "end"), s)) for s in find(text)]
        key = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
        return {"doc_id": doc_id, "key": key, "base": base}, [inner.row() for inner in layer.unwrap(limit)]

    return _rows(schema, each)


def _round(limit: int):
    """(key, layer) -> (key, spans, layers below): one step of the worklist."""
    schema = pa.schema([("key", pa.string()), ("spans", pa.list_(PA_SPAN)), ("layers", pa.list_(PA_LAYER))])

    def each(key, row):
        layer = Layer.of(row)
        placed = {(*layer.place(s, e), k) for s, k, e in find(layer.text)}
        spans = [{"start": s, "kind": k, "end": e} for s, e, k in sorted(placed)]
        return {"key": key, "spans": spans}, [inner.row() for inner in layer.unwrap(limit)]

    return _rows(schema, each)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, *, max_layer: int = MAX_LAYER) -> DataFrame:
    """One row per input row -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans, found array<struct<start, kind,
    end>>, n_layers, n_over). Kinds in ``found`` are numbered as in ``KINDS``; positions are code points of the text, ends
    exclusive. ``base_sha256`` and the counts are of secrets in plain sight, ``spans`` and ``found`` of all. A find in a
    base64 token or an escape has the characters that hold it, one in compressed data the whole token.

    ``max_layer`` bounds the bytes that one compressed layer may unfold to (a bomb of some kilobytes unfolds to
    terabytes); a layer that holds more is scanned up to there and counted in ``n_over``. Texts have no such bound.

    Edge cases: a null text is empty and has no finds; null and repeated ids are ids like others; equal texts
    have equal finds. Base64 that is no such text (UTF-8 or UTF-16 without control characters) or compressed data is no layer. Empty tables give empty
    results; other columns, whatever their names, are ignored.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType
    first = saved(rows.mapInArrow(_texts(to_arrow_type(id_type), max_layer), f"doc_id {id_type.simpleString()}, key string, "
                                  f"base array<{SPAN}>, layers array<{LAYER}>"), "layers")
    work = first.filter(F.size("layers") > 0).dropDuplicates(["key"]).select("key", F.explode("layers").alias("layer"))
    work = work.repartition("key", F.xxhash64("layer.text"))
    rounds = []
    while not rounds or not work.isEmpty():
        done = saved(work.mapInArrow(_round(max_layer), f"key string, spans array<{SPAN}>, layers array<{LAYER}>"), "layers")
        over = F.size(F.filter("layers", lambda x: x["over"]))
        rounds.append(done.select("key", "spans", F.size("layers").alias("below"), over.alias("over")))
        work = done.select("key", F.explode("layers").alias("layer"))
    hidden = reduce(DataFrame.unionByName, rounds).groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("hidden"), F.sum("below").alias("below"), F.sum("over").alias("o"))
    plain = first.select("doc_id", "key", "base", F.size("layers").alias("n"), F.size(F.filter("layers", lambda x: x["over"])).alias("no"))
    none = F.array().cast(f"array<{SPAN}>")
    with_layers = plain.filter("n > 0").join(hidden, "key", "left")
    without = plain.filter("n = 0").select("*", none.alias("hidden"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("o"))
    out = with_layers.unionByName(without).withColumn("found", F.array_sort(F.array_distinct(F.concat("base", F.coalesce("hidden", none)))))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"),
                      "found", (F.col("n") + F.coalesce("below", F.lit(0))).cast("long").alias("n_layers"),
                      (F.col("no") + F.coalesce("o", F.lit(0))).cast("long").alias("n_over"))
