"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Token counts are summed per cell of source, language and topic. Values that a target does not list
share one rest value, so there are at most (sources + 1) x (languages + 1) x (topics + 1) cells, a bound
set by the parameters. Raking scales the cells' tokens in turn to the targets of each margin; it runs as
one SQL expression over the array of cells. Weights are trimmed in each round: a cell is raised to at most
``max_weight`` times its tokens, and the others take up what it leaves, so a target that the tokens cannot meet
does not cost nearly all other documents. A document's calibrated weight is its cell's raked share over
its actual one; weights are scaled so that the largest keeps all its documents, and a document stays when
a hash of its id falls below that probability.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import saved, whole_text

REST = "*"
# topic: marks of which a text holds at least one; the first topic that fits counts, else "prose"
TOPIC_MARKS: Mapping[str, Sequence[str]] = {"legal": ("icense",), "contact": ("@",), "table": (" | ",)}
SOURCE_TARGETS: Mapping[str, float] = {"src0": 0.25, REST: 0.75}
LANG_TARGETS: Mapping[str, float] = {"en": 0.53, "de": 0.15, "fr": 0.15, "es": 0.15, REST: 0.02}
TOPIC_TARGETS: Mapping[str, float] = {"prose": 0.90, "legal": 0.04, "contact": 0.03, "table": 0.03}
ITERATIONS = 100
MAX_WEIGHT = 5.0


def tokens(text: Column) -> Column:
    """Number of words (runs without blanks) of a text."""
    return F.regexp_count(text, F.lit(r"[^\x00-\x20]++")).cast("long")


def topic(text: Column, marks: Mapping[str, Sequence[str]] = TOPIC_MARKS, other: str = "prose") -> Column:
    out = F.lit(other)
    for name, words in reversed(list(marks.items())):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(text, F.lit(w))
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def _listed(value: Column, targets: Mapping[str, float]) -> Column:
    names = [k for k in targets if k != REST]
    return F.when(value.isin(names), value).otherwise(F.lit(REST))


def _rake_sql(targets: Sequence[Mapping[str, float]], iterations: int, max_weight: float | None) -> str:
    """SQL expression: raked tokens of each cell of ``cells`` (array of struct k0, k1, k2, w), in its order."""
    # raking keeps the total, but trimming does not: each margin is scaled to the total of the cells
    all_ = "aggregate(cells, 0.0D, (a, c) -> a + c.w)"

    def step(x: str, margin: int) -> str:
        t = targets[margin]
        goal = "map(" + ", ".join(f"'{k}', {float(v)!r}D" for k, v in t.items()) + ")"
        if REST not in t:
            goal = f"map_concat({goal}, map('{REST}', 0.0D))"
        k = f"k{margin}"
        sums = (f"aggregate(sequence(0, size(cells) - 1), cast(map() as map<string,double>), (m, i) -> "
                f"map_concat(map_filter(m, (a, b) -> a <> cells[i].{k}), "
                f"map(cells[i].{k}, coalesce(m[cells[i].{k}], 0.0D) + x{margin}[i])))")
        # the targets of values without tokens are spread over the others in proportion
        share = f"aggregate(map_keys(s{margin}), 0.0D, (a, b) -> a + if(s{margin}[b] > 0, g{margin}[b], 0.0D))"
        out = (f"transform(x{margin}, (v, i) -> if(v > 0 and f{margin}[0] > 0, v * g{margin}[cells[i].{k}] * f{margin}[1] / "
               f"(f{margin}[0] * s{margin}[cells[i].{k}]), v))")
        bind = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
        return bind(f"x{margin}", x, bind(f"s{margin}", sums, bind(f"g{margin}", goal, bind(
            f"f{margin}", f"array({share}, {all_})", out))))

    turn = "x"
    for m in range(3):
        turn = step(turn, m)
    if max_weight is not None:
        turn = f"transform({turn}, (v, i) -> least(v, {float(max_weight)!r}D * cells[i].w))"
    return f"aggregate(sequence(1, {int(iterations)}), transform(cells, c -> cast(c.w as double)), (x, r) -> {turn})"


def rake(cells: DataFrame, targets: Sequence[Mapping[str, float]], iterations: int = ITERATIONS,
         max_weight: float | None = None) -> DataFrame:
    """``cells (k0, k1, k2, w)`` (at most the product of the targets' sizes) -> (k0, k1, k2, w, raked), with
    raked at most ``max_weight`` times w."""
    row = cells.agg(F.array_sort(F.collect_list(F.struct("k0", "k1", "k2", "w"))).alias("cells")).filter("size(cells) > 0")
    row = row.withColumn("raked", F.expr(_rake_sql(targets, iterations, max_weight)))
    return row.select(F.explode(F.arrays_zip("cells", "raked")).alias("z")).select("z.cells.*", "z.raked")


def mix_sources(docs: DataFrame, *, sources: Mapping[str, float] = SOURCE_TARGETS, langs: Mapping[str, float] = LANG_TARGETS,
                topics: Mapping[str, float] = TOPIC_TARGETS, marks: Mapping[str, Sequence[str]] = TOPIC_MARKS,
                iterations: int = ITERATIONS, max_weight: float | None = MAX_WEIGHT, seed: int = 11) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``weight`` (raked share / share), ``probability`` and ``kept``.

    Edge cases: null or unlisted sources, languages and topics count as the rest value; without a target
    for it their weight is 0. A target that would need weights over ``max_weight`` is met as far as that
    bound allows (None: no bound). Targets need not sum to 1; those of values without tokens are spread over
    the others. A null text is empty; documents without a token do not move the margins and take their
    cell's weight, or 1 in a cell without tokens. The draw hashes the id, so rows that repeat an id share
    their fate, and a null id is a value like any other. Columns of ``docs`` with the added names are
    replaced. An empty table gives an empty result.
    """
    text = whole_text()
    targets = (sources, langs, topics)
    topic_ = topic(text, marks)
    k = [_listed(F.col("source"), sources), _listed(F.col("lang"), langs), _listed(topic_, topics)]
    cells = docs.select(k[0].alias("k0"), k[1].alias("k1"), k[2].alias("k2"), tokens(text).alias("n")) \
        .groupBy("k0", "k1", "k2").agg(F.sum("n").alias("w"))
    raked = rake(saved(cells, "cells"), targets, iterations, max_weight)
    # a cell's raked tokens over its tokens are its share over its actual share
    table = raked.withColumn("_weight", F.when(F.col("w") > 0, F.col("raked") / F.col("w")).otherwise(F.lit(1.0)))
    table = saved(table.select("k0", "k1", "k2", "_weight"), "weights")
    top = table.agg(F.max("_weight")).first()[0] or 1.0
    table = F.broadcast(table)      # at most (sources + 1) x (languages + 1) x (topics + 1) rows
    base = docs.drop("topic", "n_tokens", "weight", "probability", "kept")
    out = base.select(*[F.col(f"`{c}`") for c in base.columns], topic_.alias("topic"), tokens(text).alias("n_tokens"),
                      *[c.alias(f"_k{i}") for i, c in enumerate(k)])
    out = out.join(table, (F.col("_k0") == F.col("k0")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
    out = out.withColumn("weight", F.col("_weight")).withColumn("probability", F.col("_weight") / F.lit(float(top)))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) * F.lit(2.0 ** -53)
    return out.withColumn("kept", draw < F.col("probability")).drop("_k0", "_k1", "_k2", "k0", "k1", "k2", "_weight")
