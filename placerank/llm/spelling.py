"""Spelling variants: words one edit apart, found by walking a relational trie.

The trie is a table of edges. A node is a prefix (a hash of it) after which the words go on in more than one way; an
edge has the text up to the next node, or to the end of a word. Words are kept forwards and backwards, since an edit
leaves one half of a word as it is: an edit in the last half is looked for forwards, one in the first half backwards, so
the crowded nodes near the root are never needed. A word's states (word, position, node, edits) enter where its own
path has nodes beyond the untouched half, as an edit can leave the path only there. The frontier is joined with the
edges level by level: the first edge takes the edit, the others are read as they are, and a state that ends a word
after one edit is a neighbour.

All joins have a merge hint: Spark judges a table by the size of its files or of what it is made of, here compressed
words, one a row, while prefixes and edges are rows of their own for most letters of a word.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import ascii_lower, saved, whole_text

LETTERS = "[A-Za-zÀ-ÿ]"
AHEAD = 2              # code points that are looked ahead
SPREAD = 100_000       # words below a node for each copy of its edges


def word_counts(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): runs of letters with A-Z lowered; where crc32 of ``doc_id:run`` is a multiple of ``every``, the
    run loses the code point at that number modulo its length. Null texts have no runs, a null id is empty."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(
        ascii_lower(whole_text()), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))).alias("w"))
    runs = runs.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("w")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _prefixes(words: DataFrame) -> DataFrame:
    """(word, side, depth, node): the prefixes of each word and of its reverse, from the longest that a word one
    code point shorter is entered at. Nodes are hashes of them."""
    n = F.length("word")
    sides = words.select("word", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("s"), F.floor((n - 1) / 2).cast("int").alias("from")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s"), F.floor(n / 2).cast("int").alias("from")))).alias("x"))
    each = sides.select("word", "x.*", F.explode(F.sequence(F.col("x.from"), F.length("word"))).alias("depth"))
    return each.select("word", "side", "depth", F.xxhash64("side", F.substring("s", F.lit(1), F.col("depth"))).alias("node"),
                       F.substring("s", F.col("depth") + 1, F.lit(AHEAD)).alias("next"))


def _bits(after: Column) -> Column:
    """A mark of the next code point (low half of the number) and of the next AHEAD ones (high half)."""
    def bit(c: Column, shift: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(32)).cast("int") + shift)

    return bit(F.substring(after, 1, 1), 0).bitwiseOR(bit(after, 32))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, entries). Edges: node, salt, label, child, copies, ahead, near, near_n; child is null where the word ``near``
    ends, ``ahead`` marks what follows the child, so a state that cannot go on is not kept.
    Entries: word, n, s, pos, node, salt. A node with many words below has copies of its edges, one a salt."""
    prefixes = _prefixes(words)
    after = F.when(F.col("next") == "", 0).otherwise(F.ascii("next"))
    nodes = (prefixes.select("node", after.alias("a"), _bits(F.col("next")).alias("m")).groupBy("node").agg(
        F.min("a").alias("a"), F.max("a").alias("b"), F.bit_or("m").alias("ahead"), F.count("*").alias("n"))
        .filter(F.col("a") != F.col("b")).select("node", "ahead", (1 + F.floor(F.col("n") / SPREAD)).cast("int").alias("copies")))
    path = Window.partitionBy("word", "side").orderBy("depth")
    steps = prefixes.drop("next").join(nodes.hint("merge"), "node").repartition("word").select(
        "*", *[F.lead(c).over(path).alias(f"next_{c}") for c in ("depth", "node", "copies", "ahead")])
    steps = steps.join(words.hint("merge"), "word").withColumn("s", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
    steps = saved(steps, "steps")

    ends = F.col("next_node").isNull()
    label = F.substring("s", F.col("depth") + 1, F.coalesce(F.col("next_depth"), F.length("s")) - F.col("depth"))
    edges = steps.select("node", "copies", label.alias("label"), F.col("next_node").alias("child"), F.coalesce("next_copies", F.lit(0)).alias("next"),
                         F.col("next_ahead").alias("ahead"), F.when(ends, F.col("word")).alias("near"), F.when(ends, F.col("n")).alias("near_n"))
    inner = edges.filter("child is not null").dropDuplicates(["node", "child"])
    edges = inner.unionByName(edges.filter("child is null")).select(
        "node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "label", "child", F.col("next").alias("copies"), "ahead", "near", "near_n")

    half = F.floor(F.length("s") / 2).cast("int")
    own = F.col("depth") >= F.when(F.col("side") == 0, half).otherwise(F.length("s") - half)
    entries = steps.filter(own & (F.col("depth") < F.length("s"))).select(
        "word", "n", "s", F.col("depth").alias("pos"), "node", F.pmod(F.xxhash64("word"), "copies").cast("int").alias("salt"))
    return saved(edges, "edges"), entries


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs (word, n, near, near_n) of words with exactly one code point inserted, deleted or replaced; each pair
    both ways. ``words``: (word, n), words distinct. The walk replaces a code point or leaves one out of the word; a
    word that is one longer finds the shorter one."""
    edges, frontier = trie(words)
    s, pos, label, m = F.col("s"), F.col("pos"), F.col("label"), F.length("label")
    left = F.length(s) - pos
    off = F.substring(label, F.lit(1), F.lit(1)) != F.substring(s, pos + 1, F.lit(1))
    replaced = off & (m > 0) & (m <= left) & (F.substring(s, pos + 2, m - 1) == F.substring(label, F.lit(2), m - 1))
    left_out = off & (m < left) & (F.substring(s, pos + 2, m) == label)
    as_is = (m <= left) & (F.substring(s, pos + 1, m) == label)
    found, first = [], True
    while True:
        on = frontier.join(edges.hint("merge"), ["node", "salt"])
        if first:
            on = on.filter(replaced | left_out).select("word", "n", "s", "child", "copies", "ahead", "near", "near_n", F.explode(F.array(
                F.when(replaced, pos + m), F.when(left_out, pos + m + 1))).alias("pos")).filter("pos is not null")
        else:
            on = on.filter(as_is).select("word", "n", "s", "child", "copies", "ahead", "near", "near_n", (pos + m).alias("pos"))
        mark = _bits(F.substring(s, pos + 1, F.lit(AHEAD)))
        goes_on = F.col("child").isNotNull() & (F.col("ahead").bitwiseAND(mark) == mark)
        step = saved(on.filter(goes_on | (F.col("child").isNull() & (pos == F.length(s)))).drop("ahead"), "frontier")
        found.append(step.filter("child is null").select("word", "n", "near", "near_n"))
        frontier = step.filter("child is not null").select(
            "word", "n", "s", "pos", F.col("child").alias("node"), F.pmod(F.xxhash64("word"), F.greatest("copies", F.lit(1))).cast("int").alias("salt")).distinct()
        first = False
        if frontier.isEmpty():
            break
    # nodes are hashes, so the words themselves are compared
    pairs = reduce(DataFrame.unionByName, found).filter(F.levenshtein("word", "near", 1) == 1)
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*").repartition("word").dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): pointers are doubled until none moves. Forms grow in n by a factor each
    step, so chains are as short as the logarithm of the largest n."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = saved(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                        F.col("further").isNotNull().alias("moved")), "roots")
        if nxt.filter("moved").isEmpty():
            return nxt.drop("moved")
        now = nxt.drop("moved")


def spelling_variants(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """One row per word -> (word, form, root, n, n_near, form_n). ``form`` is the near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``ratio`` times the word's; ``root`` follows forms to the end.

    Edge cases: null and empty texts have no words, a null doc_id counts as an empty one, repeated rows count again;
    without words the result is empty. Words of any length are taken whole. Other columns are ignored. Only
    words are shuffled; edges of a node with many words below are copied and the states spread over the copies.
    """
    words = saved(word_counts(docs, min_length=min_length, min_count=min_count, every=every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    out = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(
        -F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"), (-F.col("best.less")).alias("best_n"))
    out = saved(out.select("word", "form", "n", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(out.filter(F.col("form").isNotNull()))
    return out.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
