"""License scan by diagonal voting (DataFrame functions only).

Every run of ``GRAM`` words of every document is hashed and joined with the runs of the templates (a
parameter, broadcast; the words themselves are compared too). A hit at document word i and template word p votes for the diagonal i - p.
A phrase stands at word d exactly when diagonal d holds a vote from each of its runs. For longer templates,
diagonals at most ``GAP`` apart are merged, so dropped or added words split no match, and the merged span
is verified by the share of the template's words that it covers.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import NOT_WORD, ascii_lower, whole_text

GRAM = 3
GAP = 3
COVERAGE = 0.8

# fixed values: phrases whose places are counted, with their labels
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# fixed values: notices that name or grant a license, with their labels
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]


def license_scan(docs: DataFrame, *, phrases: Sequence[tuple[str, str]] = PHRASES,
                 notices: Sequence[tuple[str, str]] = NOTICES, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """One row per input row -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    places array<struct<label, start, end, covered>>).

    ``n_base`` counts the places of ``phrases`` (each of at least three words), ``first_word`` and
    ``last_word`` are their smallest and largest start; ``labels`` adds those of verified notices;
    ``score`` is 1 with a base place, else the best share of a notice that a place covers.

    Edge cases: A-Z is lower-cased, no other character; a null text is empty and has no words. A text
    shorter than a phrase has no places. Rows are scanned one by one, also such as repeat an id or have
    a null one. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = [(i, t.split(), label, i < len(phrases)) for i, (t, label) in enumerate([*phrases, *notices])]
    if any(len(w) < GRAM for _, w, _, _ in texts):
        raise ValueError(f"templates need at least {GRAM} words")
    # the last row, met by word -1 of every document, keeps documents without a hit
    runs = [(i, p, *w[p:p + GRAM], len(w), label, base) for i, w, label, base in texts for p in range(len(w) - GRAM + 1)]
    runs = spark.createDataFrame([*runs, (-1, 0, "", "", "", 0, "", False)],
                                 "template int, p int, g0 string, g1 string, g2 string, size int, label string, base boolean")
    runs = runs.withColumn("h", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("g0", "g1", "g2")))

    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        F.array_remove(F.split(ascii_lower(whole_text()), NOT_WORD), "").alias("w"))
    at = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w",
                      F.explode(F.expr(f"sequence(-1, greatest(size(w) - {GRAM}, -1))")).alias("i"))
    g = [F.get(F.col("w"), F.col("i") + j) for j in range(GRAM)]
    seed = F.when(F.col("i") < 0, F.lit(0)).otherwise(F.xxhash64(*g))
    equal = (g[0] == F.col("g0")) & (g[1] == F.col("g1")) & (g[2] == F.col("g2"))
    hits = at.join(F.broadcast(runs), (seed == F.col("h")) & ((F.col("i") < 0) & (F.col("template") < 0) | equal))

    keys = ["row", "doc_id", "n_words", "template", "size", "label", "base"]
    diagonals = hits.groupBy(*keys, (F.col("i") - F.col("p")).alias("d")).agg(F.collect_set("p").alias("ps"))
    by_template = Window.partitionBy("row", "template").orderBy("d")
    jump = F.coalesce((F.col("d") - F.lag("d").over(by_template) > gap).cast("int"), F.lit(0))
    merged = diagonals.withColumn("jump", F.when(F.col("base"), F.lit(1)).otherwise(jump)) \
        .withColumn("run", F.sum("jump").over(by_template))
    spans = merged.groupBy(*keys, "run").agg(
        F.min(F.col("d") + F.array_min("ps")).alias("start"), F.max(F.col("d") + F.array_max("ps") + GRAM).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("ps"))).alias("ps"), F.min("d").alias("d"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(p, p + GRAM - 1)))))
    spans = spans.withColumn("covered", F.when(F.col("template") < 0, F.lit(0.0)).otherwise(covered / F.col("size")))

    is_base = F.col("base") & (F.size("ps") == F.col("size") - GRAM + 1)
    is_notice = ~F.col("base") & (F.col("template") >= 0) & (F.col("covered") >= coverage)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("d"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("d"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"), joined(is_base | is_notice).alias("labels"),
        F.max(F.when(is_base, F.lit(1.0)).when(~F.col("base"), F.col("covered")).otherwise(F.lit(0.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(is_base | is_notice, F.struct("label", "start", "end", "covered")))).alias("places"),
    ).drop("row")
