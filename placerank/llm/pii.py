"""Personal data: patterns, and information-theoretic sanitisation of terms that disclose it
(DataFrame functions only).

Matches of the patterns are the protected entities. From the corpus it is estimated how strongly a term
reveals an entity: PMI(t; e) = log2(N n(t, e) / (n(t) n(e))), where n counts documents and t counts with e
when it stands within ``WINDOW`` characters of it. IC(e) = log2(N / n(e)) is all there is to learn about e,
so PMI / IC is the share that the term discloses. Near an entity, terms at or over ``REMOVE`` are removed and
those at or over ``GENERALISE`` replaced by a general word.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import NOT_WORD, WORD, ascii_lower, saved, whole_text

KINDS = ("email", "ip", "card", "phone")
# The given patterns, written so that no run of characters is tried twice (possessive, started only at its
# first character or where the last match ended); they match the same spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WINDOW = 64
MIN_TERM = 4
MIN_DOCS = 3
REMOVE, GENERALISE = 0.95, 0.8
PLACE = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "", "general": "[TERM]"}


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def _luhn(v: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(v))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(v), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: Column, v: Column) -> Column:
    n = F.length(_digits(v))
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", v.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
            .when(kind == "card", F.when(n.between(13, 19), _luhn(_digits(v))).otherwise(F.lit(False)))
            .otherwise(n.between(9, 15)))


def _hits(kind: str, text: Column) -> Column:
    """All matches of a kind with what stands between them: array of (kind, i, gap, value, before, after)."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    pattern = F.lit(PATTERNS[kind])
    between, values = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.transform(F.arrays_zip(values.alias("v"), between.alias("b"), F.slice(between, 2, F.size(between) + 1).alias("c")),
                         lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(z["b"]).alias("gap"), z["v"].alias("value"),
        F.right(z["b"], F.lit(WINDOW + 1)).alias("before"), F.left(z["c"], F.lit(WINDOW + 1)).alias("after")))
    zipped = F.filter(zipped, lambda z: z["value"].isNotNull())
    return F.when(may, zipped).otherwise(F.array().cast(
        "array<struct<kind:string,i:int,gap:int,value:string,before:string,after:string>>"))


def _near_words(side: Column, shift: Column, before: bool) -> Column:
    """Whole words of a window as (term, start, end); a word that the window cuts is left out."""
    low = ascii_lower(side)
    words, gaps = F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.split(low, WORD, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(words), F.lit(0))), words, lambda g, w: F.length(g) + F.length(w))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("term"), (
        F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b) - F.length(w)).alias("s")))
    cut = F.length(side) > WINDOW
    inside = F.filter(placed, lambda p: ~cut | ((p["s"] > 0) if before else (p["s"] + F.length(p["term"]) <= WINDOW)))
    return F.transform(inside, lambda p: F.struct(p["term"].alias("term"), (shift + p["s"]).alias("start"),
                                                  (shift + p["s"] + F.length(p["term"])).alias("end")))


def find_pii(docs: DataFrame, *, remove: float = REMOVE, generalise: float = GENERALISE, min_docs: int = MIN_DOCS,
             min_term: int = MIN_TERM) -> DataFrame:
    """One row per input row -> (doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term,
    found array<struct<rank, kind, start, end>>).

    Positions are code points, ends exclusive. Patterns give leftmost non-overlapping matches per kind;
    an ip needs parts of at most 255, a card 13 to 19 digits that pass Luhn, a phone 9 to 15 digits.
    Kinds ``term`` (to remove) and ``general`` (to generalise) are terms of ``min_term`` characters or more
    without a digit that stand with the entity in at least ``min_docs`` documents and touch no base span.

    Edge cases: a null text is empty. Documents without an entity get no span. Rows that repeat id and text
    have the same spans and count as one document for the estimates; null ids are an id like any other.
    An entity in all documents has nothing to disclose. Empty tables give empty results; other columns,
    whatever their names, are ignored.
    """
    text = whole_text()
    rows = saved(docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.xxhash64("t").alias("key"), F.concat(*[_hits(k, F.col("t")) for k in KINDS]).alias("hits")), "hits")
    one = rows.filter(F.size("hits") > 0).dropDuplicates(["doc_id", "key"])
    doc = ["doc_id", "key"]
    order = Window.partitionBy(*doc, "kind").orderBy("i")
    placed = one.select(*doc, F.explode("hits").alias("h")).select(*doc, "h.*")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    base = placed.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    base = saved(base.filter(_valid(F.col("kind"), F.col("value"))).drop("gap", "i"), "base")

    near = F.concat(_near_words(F.col("before"), F.col("start") - F.length("before"), True),
                    _near_words(F.col("after"), F.col("end"), False))
    terms = base.select(*doc, "kind", "value", F.explode(near).alias("w")).select(
        *doc, "kind", "value", "w.term", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    terms = terms.filter((F.length("term") >= min_term) & ~F.col("term").rlike("[0-9]"))
    # terms that touch a base span are part of it
    both = base.select(*doc, "kind", "value", F.lit(None).cast("string").alias("term"), "start", "end").unionByName(terms)
    is_base = F.col("term").isNull()
    line = Window.partitionBy(*doc).orderBy("start", F.col("term").isNotNull())
    both = both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(line)) \
        .withColumn("ahead", F.min(F.when(is_base, F.col("start"))).over(line.rowsBetween(0, Window.unboundedFollowing)))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    terms = saved(both.filter(~is_base & free).drop("reach", "ahead"), "terms")

    joint = terms.select(*doc, "kind", "value", "term").distinct().groupBy("kind", "value", "term") \
        .agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= min_docs)
    entity = base.select(*doc, "kind", "value").distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_e"))
    total = rows.agg(F.count(F.lit(1))).first()[0]
    # document frequency of every word of the corpus, aggregated on the map side
    words = docs.select(F.explode(F.array_distinct(F.split(ascii_lower(text), NOT_WORD))).alias("term"))
    spread = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    share = (F.log2(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
             / F.nullif(F.log2(F.lit(float(total)) / F.col("n_e")), F.lit(0.0)))
    told = joint.join(entity, ["kind", "value"]).join(spread, "term").withColumn("share", share) \
        .filter(F.col("share") >= generalise).select("kind", "value", "term", "share")
    marked = terms.join(told, ["kind", "value", "term"]).groupBy(*doc, "start", "end").agg(F.max("share").alias("share"))
    marked = marked.select(*doc, F.when(F.col("share") >= remove, "term").otherwise("general").alias("kind"), "start", "end")

    spans = base.select(*doc, "kind", "start", "end").unionByName(marked)
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term", "general")]), F.col("kind"))
    found = spans.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct(
        rank.alias("rank"), "start", "end", "kind"))).alias("found"))
    out = rows.select("doc_id", "key").join(found.withColumnsRenamed({"doc_id": "_id", "key": "_key"}),
                                            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    out = out.withColumn("found", F.coalesce("found", F.array().cast(
        "array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>")))
    as_text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", "key", *[count(k).alias(f"n_{k}") for k in KINDS],
                      F.sha2(as_text(F.filter("found", lambda s: s["rank"] <= len(KINDS))).cast("binary"), 256).alias("base_sha256"),
                      as_text(F.col("found")).alias("spans"), (count("term") + count("general")).alias("n_term"), "found")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``clean_text``: base spans replaced by their kind, disclosing terms removed or generalised.

    Of overlapping spans the one that starts first is replaced and the overlap goes with it. A null text
    gives an empty one; the cases of ``find_pii`` hold. A column ``clean_text`` of ``docs`` is replaced.
    """
    found = find_pii(docs, **options).filter(F.size("found") > 0).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "found").dropDuplicates(["_id", "_key"])
    text = whole_text()
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    spans = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    labels = F.create_map(*[F.lit(x) for kv in PLACE.items() for x in kv])

    def put(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["out"], piece, F.element_at(labels, s["kind"]))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["end"].cast("long")).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(spans, start, put, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return out.withColumn("clean_text", F.when(F.col("found").isNull(), text).otherwise(done)).drop("_id", "_key", "found")
