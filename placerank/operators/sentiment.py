"""T1 / A4-A6 - rule-based review sentiment as one Spark job over one scan.

Per review: tokens (runs of letters, marks and digits of any script, joined by inner apostrophes and hyphens, case
kept) stay an array inside the row, and every token's context - negation or booster words up to three tokens
back, its side of the first "but" - is read with array functions, so no window and no shuffle is
needed for context. The tokens are then exploded together with the row's own counts and left-joined to the lexicon
(an input table, broadcast once its size is checked), and added up by a row key made in the scan, so ids may
be null or repeated and the texts are read once. Whole texts are processed, however long.

Scores follow the published VADER method: valence sum with negation (x -0.74), boosters (+-0.293, damped by
distance; boosters of two words and hyphened ones are matched as phrases), emphasis of words in capitals (0.733, if
the text is not all in capitals), "but" weighting (0.5 before / 1.5 after), exclamation emphasis (+0.292 each, at
most 4), question marks (0.18 each for 2-3, 0.96 above), compound = s / sqrt(s^2 + 15) and pos/neg/neu
shares. A null or empty text scores 0 everywhere.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.sources.reference_values import (
    BOOSTER_DOWN, BOOSTER_UP, NEGATION_WORDS, SENT_BOOST_DECAY, SENT_BOOST_INCREMENT, SENT_BUT_AFTER,
    SENT_BUT_BEFORE, SENT_CAPS_INCREMENT, SENT_EXCLAMATION_MAX, SENT_EXCLAMATION_STEP, SENT_NEGATION_SCALAR, SENT_NORMALIZATION_ALPHA,
    SENT_QUESTION_MAX, SENT_QUESTION_STEP)

TOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"
LEXICON_MAX_ROWS = 1_000_000


def tokens(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def _in_capitals(token: Column) -> Column:
    return token.rlike("[A-Z]") & ~token.rlike("[a-z]")


def _word_flags(w: Column, before: Column, decay: float, emphasis: Column) -> tuple[Column, Column]:
    """(is-negation 0/1, booster increment) of one context word and the word before it (null -> 0, 0)."""
    low, phrase = F.lower(w), F.concat(F.lower(before), F.lit(" "), F.lower(w))

    def listed(words: list[str]) -> Column:
        two = [x for x in words if " " in x]
        hit = F.coalesce(low.isin(words), F.lit(False))
        return hit | F.coalesce(phrase.isin(two), F.lit(False)) if two else hit

    is_neg = F.coalesce(low.isin(NEGATION_WORDS) | low.endswith("n't"), F.lit(False))
    sign = F.when(listed(BOOSTER_UP), 1.0).when(listed(BOOSTER_DOWN), -1.0).otherwise(0.0)
    caps = F.when(emphasis & F.coalesce(_in_capitals(w), F.lit(False)), SENT_CAPS_INCREMENT).otherwise(0.0)
    return F.when(is_neg, 1).otherwise(0), F.when(sign == 0.0, 0.0).otherwise(sign * (SENT_BOOST_INCREMENT + caps) * decay)


def review_sentiment(reviews: DataFrame, lexicon: DataFrame, text_col: str = "text",
                     id_col: str = "review_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """-> (id, columns of ``keep``, vader_neg, vader_neu, vader_pos, vader_compound), one row per review row.

    ``lexicon(word, valence)``; its size is checked before it is broadcast.  Each token is exploded together with the
    four tokens before it (shifted copies of the token array, zipped), so context costs O(tokens) per
    text - never a lookup per position.
    """
    small = lexicon.limit(LEXICON_MAX_ROWS + 1).count() <= LEXICON_MAX_ROWS
    lex = lexicon.select(F.lower("word").alias("_word"), F.col("valence").cast("double").alias("_valence"))
    lex = F.broadcast(lex) if small else lex
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [id_col, *[c for c in keep if c != id_col]]
    base = reviews.select(
        F.struct(*own).alias("_own"), F.monotonically_increasing_id().alias("_row"), tokens(text).alias("_toks"),
        (F.length(text) - F.length(F.regexp_replace(text, "!", ""))).alias("_bang"),
        (F.length(text) - F.length(F.regexp_replace(text, "[?]", ""))).alias("_qm"))
    n = F.size("_toks")

    def shifted(k):
        """The tokens k places on, after the empty entry of the row itself."""
        return F.concat(F.array_repeat(F.lit(None).cast("string"), F.least(n, F.lit(k)) + 1),
                        F.slice("_toks", 1, F.greatest(n - k, F.lit(0))))

    n_caps = F.size(F.filter("_toks", _in_capitals))
    lows = F.transform("_toks", lambda t: F.lower(t))
    facts = F.struct("_own", n.alias("n"), "_bang", "_qm")
    shifts = base.select("_row", facts.alias("_facts"), ((n_caps > 0) & (n_caps < n)).alias("_emphasis"), F.array_position(lows, "but").alias("_fb"),
                         *[shifted(k).alias(f"p{k}") for k in range(5)])
    # place 0 is the row itself; of the tokens, only those of the lexicon go on
    each = (shifts.select("_row", "_facts", "_emphasis", "_fb", F.posexplode(F.arrays_zip(*[f"p{k}" for k in range(5)])).alias("pos", "e"))
            .select("_row", "_facts", "_emphasis", "_fb", "pos", F.lower("e.p0").alias("_word"), "e.*")
            .join(lex, "_word", "left").filter((F.col("pos") == 0) | F.col("_valence").isNotNull()))
    for k, decay in zip((1, 2, 3), SENT_BOOST_DECAY):
        neg, add = _word_flags(F.col(f"p{k}"), F.col(f"p{k + 1}"), decay, F.col("_emphasis"))
        each = each.withColumns({f"_neg{k}": neg, f"_add{k}": add})
    each = each.withColumns({"_negs": F.col("_neg1") + F.col("_neg2") + F.col("_neg3"), "_boost": F.col("_add1") + F.col("_add2") + F.col("_add3")})
    negs, boost = F.col("_negs"), F.col("_boost")
    but_w = (F.when(F.col("_fb") == 0, F.lit(1.0)).when(F.col("pos") < F.col("_fb"), F.lit(SENT_BUT_BEFORE))
             .when(F.col("pos") > F.col("_fb"), F.lit(SENT_BUT_AFTER)).otherwise(F.lit(1.0)))
    v = F.col("_valence")
    caps = F.when(F.col("_emphasis") & _in_capitals(F.col("p0")), SENT_CAPS_INCREMENT).otherwise(0.0)
    v = v + F.when(v > 0, boost + caps).when(v < 0, -boost - caps).otherwise(F.lit(0.0))
    v = v * F.pow(F.lit(SENT_NEGATION_SCALAR), negs) * but_w
    scored = each.select("_row", "_facts", F.when(F.col("_valence").isNotNull(), v).alias("v"))
    j = scored.groupBy("_row", "_facts").agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("v") + 1.0)), F.lit(0.0)).alias("_pos"),
        F.coalesce(F.sum(F.when(F.col("v") < 0, F.col("v") - 1.0)), F.lit(0.0)).alias("_negs"),
        F.count(F.when(F.col("v") != 0, 1)).alias("_scored"))
    j = j.select("_facts._own.*", F.col("_facts.n").alias("_n"), F.col("_facts._bang").alias("_bang"), F.col("_facts._qm").alias("_qm"),
                 "_s", "_pos", "_negs", "_scored")
    qm = (F.when(F.col("_qm") > 3, F.lit(SENT_QUESTION_MAX))
          .when(F.col("_qm") > 1, F.col("_qm") * SENT_QUESTION_STEP).otherwise(F.lit(0.0)))
    ep = F.least(F.col("_bang"), F.lit(SENT_EXCLAMATION_MAX)) * SENT_EXCLAMATION_STEP + qm
    j = j.withColumn("_ep", ep)
    ep = F.col("_ep")
    s = F.when(F.col("_s") > 0, F.col("_s") + ep).when(F.col("_s") < 0, F.col("_s") - ep).otherwise(F.lit(0.0))
    compound = F.when(s != 0, s / F.sqrt(s * s + SENT_NORMALIZATION_ALPHA)).otherwise(F.lit(0.0))
    j = j.select(*own, F.when(F.col("_pos") > F.abs("_negs"), F.col("_pos") + ep).otherwise(F.col("_pos"))
                 .alias("_p2"),
                 F.when(F.col("_pos") < F.abs("_negs"), F.col("_negs") - ep).otherwise(F.col("_negs")).alias("_n2"),
                 (F.col("_n") - F.col("_scored")).cast("double").alias("_neu"), compound.alias("vader_compound"))
    total = F.col("_p2") + F.abs("_n2") + F.col("_neu")
    share = lambda x: F.when(total > 0, F.abs(x / total)).otherwise(F.lit(0.0))
    return j.select(*own, share(F.abs("_n2")).alias("vader_neg"), share(F.col("_neu")).alias("vader_neu"),
                    share(F.col("_p2")).alias("vader_pos"), "vader_compound")


def sentiment_summary(scored: DataFrame, key: str) -> DataFrame:
    """A6 - per key: compound mean/min/max/count and mean pos/neg/neu, rounded to 3 places."""
    return scored.groupBy(key).agg(
        F.round(F.avg("vader_compound"), 3).alias("compound_mean"),
        F.round(F.min("vader_compound"), 3).alias("compound_min"),
        F.round(F.max("vader_compound"), 3).alias("compound_max"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("vader_pos"), 3).alias("pos_mean"),
        F.round(F.avg("vader_neg"), 3).alias("neg_mean"),
        F.round(F.avg("vader_neu"), 3).alias("neu_mean"))
