"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded by numbers that
a few passes over its bytes give (how byte classes follow each other, word lengths, repeated words);
a hidden layer, gated attention over the bag's passages and a logistic output are trained together
from document labels alone, so the model learns which passages decide a label. Training uses a bounded
sample of labelled documents; scoring reads every passage of every document inside an Arrow UDF,
without a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import whole_text
from placerank.llm.wordhash import FOLDED, pieces, prefix_sums, range_hash

PASSAGE_WORDS = 64
HELD_OUT_FOLDS = 5
THRESHOLD = 0.3
# byte classes: 0 blank, 1 line break, 2 a-z, 3 A-Z, 4 digit, 5 sentence mark, 6 other ASCII, 7 not ASCII
_b = np.arange(256)
CLASS = np.full(256, 6, np.int64)
CLASS[_b <= 32] = 0
CLASS[10] = 1
CLASS[97:123] = 2
CLASS[65:91] = 3
CLASS[48:58] = 4
CLASS[[33, 34, 39, 44, 45, 46, 58, 59, 63]] = 5
CLASS[_b >= 128] = 7
WIDTH = 64 + 5
# bytes of text encoded at a time; a byte takes some 60 bytes of arrays
CHUNK = 1 << 18


def encode(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encode all passages of the texts in ``buf`` -> (passages x WIDTH, text index of each passage).

    Words are runs of bytes that are not blank. A text without words has no passage."""
    cls = CLASS[buf]
    solid = cls > 1
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    before[cut], after[cut - 1] = False, False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    if not len(start):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    doc = np.searchsorted(off, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(off)))
    nth = np.arange(len(start)) - first[doc]
    heads = np.flatnonzero(nth % PASSAGE_WORDS == 0)            # first word of each passage
    passage = np.cumsum(nth % PASSAGE_WORDS == 0) - 1
    n = len(heads)
    words = np.bincount(passage, minlength=n)
    owner = doc[heads]
    # bytes from a passage's first word up to the next passage or the end of its text
    lo = start[heads]
    hi = np.append(lo[1:], len(buf))
    hi = np.minimum(hi, off[1:][owner])
    at = np.repeat(np.arange(n), hi - lo)
    pos = np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    follow = np.where(pos + 1 < np.repeat(hi, hi - lo), cls[np.minimum(pos + 1, len(buf) - 1)], 0)
    pairs = np.bincount(at * 64 + cls[pos] * 8 + follow, minlength=n * 64).reshape(n, 64)
    h = range_hash(prefix_sums(buf, FOLDED), start, end)
    same = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((h, passage))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    size = (end - start).astype(np.float64)
    mean = np.bincount(passage, size, n) / words
    spread = np.sqrt(np.maximum(np.bincount(passage, size ** 2, n) / words - mean ** 2, 0))
    x = np.concatenate([
        np.sqrt(pairs / np.maximum(hi - lo, 1)[:, None]),
        np.stack([np.log(mean), np.log1p(spread), np.bincount(passage[order][new], minlength=n) / words,
                  np.bincount(passage[1:][same], minlength=n) / words, np.log(words)], 1)], 1)
    return x.astype(np.float32), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """z = W-encoded passages, a = softmax over the bag of w.(tanh(Vz) * sigmoid(Uz)), score = sigmoid(o.sum(a z) + c)."""
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def _forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        p = self.weights
        z = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(z @ p["V"]), _sigmoid(z @ p["U"])
        s = (v * u) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, s)
        e = np.exp(s - top[bag])
        a = e / np.bincount(bag, e, bags)[bag]
        m = np.zeros((bags, z.shape[1]))
        np.add.at(m, bag, a[:, None] * z)
        return {"z": z, "v": v, "u": u, "a": a, "m": m, "y": _sigmoid(m @ p["o"] + p["c"])}

    def score(self, x: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Score of each text; one without passages gets the share of label 1 in training."""
        out = np.full(texts, self.prior)
        if len(x):
            have, bag = np.unique(owner, return_inverse=True)
            out[have] = self._forward((x - self.mean) / self.scale, bag, len(have))["y"]
        return out


def fit(bags: list[np.ndarray], labels: np.ndarray, *, hidden: int = 24, gate: int = 12, epochs: int = 60,
        rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Train on bags of passages (each of one or more rows) by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    prior = float(np.mean(labels)) if len(labels) else 0.5
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, WIDTH))
    mean = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(WIDTH)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    p = {"W": draw(WIDTH, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate),
         "w": draw(gate), "o": draw(hidden), "c": np.array(np.log((prior + 1e-3) / (1 - prior + 1e-3)))}
    model = AttentionModel(mean, scale, p, prior)
    if not bags or len(set(labels.tolist())) < 2:
        p["o"] = np.zeros(hidden)
        return model
    scaled = [(b - mean) / scale for b in bags]
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for part in np.array_split(order, max(1, len(order) // 128)):
            xs = np.concatenate([scaled[i] for i in part])
            bag = np.repeat(np.arange(len(part)), [len(scaled[i]) for i in part])
            f = model._forward(xs, bag, len(part))
            dy = (f["y"] - labels[part]) / len(part)
            dm = dy[:, None] * p["o"]
            da = (dm[bag] * f["z"]).sum(1)
            ds = f["a"] * (da - np.bincount(bag, f["a"] * da, len(part))[bag])
            gv = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
            gu = ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
            dz = f["a"][:, None] * dm[bag] + gv @ p["V"].T + gu @ p["U"].T
            dh = dz * (1 - f["z"] ** 2)
            grads = {"W": xs.T @ dh, "b": dh.sum(0), "V": f["z"].T @ gv, "U": f["z"].T @ gu,
                     "w": (f["v"] * f["u"]).T @ ds, "o": f["m"].T @ dy, "c": dy.sum()}
            step += 1
            for k, g in grads.items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, *, max_documents: int = 4000, **options) -> AttentionModel:
    """Fit on a bounded sample: the ``max_documents`` labelled, not held-out documents with the smallest
    hash of their id, with all their passages. A passage of 64 words reaches the driver as 69 floats, less than
    its text takes. A document with several labels counts with
    its lowest; null ids and null labels are left out; a label without a document has no effect."""
    picked = (labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_documents))
    rows = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text")).join(F.broadcast(picked), "_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, y, ids = batch.column("_text"), batch.column("_y"), batch.column("_id")
            for i, buf, off in pieces(text, CHUNK):
                n = len(off) - 1
                x, owner = encode(buf, off)
                first = np.searchsorted(owner, np.arange(n + 1))
                out = [x[first[k]:first[k + 1]].tobytes() for k in range(n)]
                yield pa.record_batch([ids.slice(i, n), y.slice(i, n).cast(pa.int32()), pa.array(out, pa.binary())],
                                      names=["_id", "_y", "x"])

    got = rows.select("_id", F.col("_y").cast("int").alias("_y"), "_text").mapInArrow(bags, "_id long, _y int, x binary")
    got = sorted((r["_id"], bytes(r["x"]), r["_y"]) for r in got.collect())
    got = [(np.frombuffer(x, np.float32).reshape(-1, WIDTH), y) for _, x, y in got if x]
    return fit([x for x, _ in got], np.array([float(y > 0) for _, y in got]), **options)


def quality_score(text: Column, model: AttentionModel) -> Column:
    """Score in [0, 1] of each text, higher where label 1 is likelier; all its passages are read."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.score(*encode(buf, off), len(off) - 1) for _, buf, off in pieces(texts, CHUNK)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 if score >= threshold).

    Scores see the text only. Edge cases: a null or empty text, or one of blanks only, scores the share
    of label 1 among the training documents (0.5 without any); without two kinds of labels every text
    does. A null id is not held out. Columns of ``docs`` with these three names are replaced. Rows are
    scored one by one, so repeated rows get equal scores; an empty table gives an empty result.
    """
    model = train(docs, labels, **options)
    out = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    out = out.withColumn("score", quality_score(whole_text(), model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
