"""Registered queries: review sentiment (T1) and its aggregates."""
from __future__ import annotations

from pyspark.sql import functions as F

from placerank.operators import features_business as fb
from placerank.operators import sentiment
from placerank.plans.registry import query, round_doubles, sql_round
from placerank.sources import fixtures as fx
from placerank.sources.reference_values import (
    BOOSTER_DOWN, BOOSTER_UP, NEGATION_WORDS, SENT_BOOST_DECAY, SENT_BOOST_INCREMENT, SENT_CAPS_INCREMENT)

# fixture lexicon (input data): frequent tokens of the invented documents with made-up valences
FIXTURE_LEXICON = [("the", 1.5), ("of", -1.1), ("is", 0.8), ("and", 0.6), ("to", -0.4), ("de", 0.9), ("la", -1.3),
                   ("der", 1.1), ("que", -0.6), ("that", 2.0), ("le", 0.7), ("it", -0.9), ("was", 1.2),
                   ("die", -2.1), ("with", 0.5), ("und", 0.3), ("this", -1.5), ("are", 0.4), ("et", -0.3),
                   ("les", 1.0)]


# the operator's token pattern as an SQL string
TOKEN_SQL = sentiment.TOKEN.replace("'", "''")


def lexicon(spark):
    return spark.createDataFrame(FIXTURE_LEXICON, "word string, valence double")


def _l(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sentiment_sql(source: str) -> str:
    lex = ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in FIXTURE_LEXICON)
    neg_terms, boost_terms = [], []
    caps = "(regexp_matches({w}, '[A-Z]') AND NOT regexp_matches({w}, '[a-z]'))"
    for back, decay in zip((1, 2, 3), SENT_BOOST_DECAY):
        w, two = f"lower(w{back})", f"lower(w{back + 1}) || ' ' || lower(w{back})"
        neg_terms.append(f"(CASE WHEN list_contains({_l(NEGATION_WORDS)}, {w}) OR {w} LIKE '%n''t' THEN 1 ELSE 0 END)")
        listed = "coalesce(list_contains({l}, {w}), false) OR coalesce(list_contains({l}, {two}), false)"
        boost_terms.append(f"(CASE WHEN {listed.format(l=_l(BOOSTER_UP), w=w, two=two)} THEN 1.0 "
                           f"WHEN {listed.format(l=_l(BOOSTER_DOWN), w=w, two=two)} THEN -1.0 ELSE 0.0 END) * ({SENT_BOOST_INCREMENT} + "
                           f"CASE WHEN emphasis AND {caps.format(w=f'w{back}')} THEN {SENT_CAPS_INCREMENT} ELSE 0.0 END) * {decay}")
    return f"""WITH lex AS (SELECT * FROM (VALUES {lex}) t(token, valence)),
    src AS ({source}),
    b2 AS (SELECT review_id, keep, toks, len(toks) AS n, coalesce(list_position(list_transform(toks, lambda x: lower(x)), 'but'), 0) AS fb, bang, qm,
        len(list_filter(toks, lambda x: {caps.format(w='x')})) BETWEEN 1 AND len(toks) - 1 AS emphasis FROM (
        SELECT row_number() OVER () AS review_id, struct_pack(id := id, keep := keep) AS keep,
            regexp_extract_all(text, '{TOKEN_SQL}') AS toks,
            length(text) - length(replace(text, '!', '')) AS bang,
            length(text) - length(replace(text, '?', '')) AS qm FROM src)),
    x0 AS (SELECT review_id, fb, emphasis, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS i FROM b2),
    x1 AS (SELECT *, lag(token, 1) OVER w AS w1, lag(token, 2) OVER w AS w2, lag(token, 3) OVER w AS w3, lag(token, 4) OVER w AS w4
        FROM x0 WINDOW w AS (PARTITION BY review_id ORDER BY i)),
    x AS (SELECT review_id, lower(token) AS token, CASE WHEN emphasis AND {caps.format(w='token')} THEN {SENT_CAPS_INCREMENT} ELSE 0.0 END AS caps,
        {' + '.join(neg_terms)} AS negs, {' + '.join(boost_terms)} AS boost,
        CASE WHEN fb = 0 THEN 1.0 WHEN i < fb THEN 0.5 WHEN i > fb THEN 1.5 ELSE 1.0 END AS but_w FROM x1),
    sc AS (SELECT x.review_id, (l.valence + CASE WHEN l.valence > 0 THEN x.boost + x.caps WHEN l.valence < 0 THEN -x.boost - x.caps
            ELSE 0.0 END) * pow(-0.74, x.negs) * x.but_w AS v FROM x JOIN lex l ON x.token = l.token),
    per AS (SELECT review_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1.0 END) AS pos,
        sum(CASE WHEN v < 0 THEN v - 1.0 END) AS negs, count(CASE WHEN v <> 0 THEN 1 END) AS scored
        FROM sc GROUP BY review_id),
    j AS (SELECT b.keep, b.n, coalesce(p.s, 0.0) AS s, coalesce(p.pos, 0.0) AS pos,
        coalesce(p.negs, 0.0) AS negs, coalesce(p.scored, 0) AS scored,
        least(b.bang, 4) * 0.292 + CASE WHEN b.qm > 3 THEN 0.96 WHEN b.qm > 1 THEN b.qm * 0.18 ELSE 0.0 END AS ep
        FROM b2 b LEFT JOIN per p ON b.review_id = p.review_id),
    k AS (SELECT keep, CASE WHEN s > 0 THEN s + ep WHEN s < 0 THEN s - ep ELSE 0.0 END AS s2,
        CASE WHEN pos > abs(negs) THEN pos + ep ELSE pos END AS pos2,
        CASE WHEN pos < abs(negs) THEN negs - ep ELSE negs END AS negs2, CAST(n - scored AS DOUBLE) AS neu FROM j),
    scores AS (SELECT keep.id AS review_id, keep.keep AS keep,
        CASE WHEN pos2 + abs(negs2) + neu > 0 THEN abs(abs(negs2) / (pos2 + abs(negs2) + neu)) ELSE 0.0 END
            AS vader_neg,
        CASE WHEN pos2 + abs(negs2) + neu > 0 THEN abs(neu / (pos2 + abs(negs2) + neu)) ELSE 0.0 END AS vader_neu,
        CASE WHEN pos2 + abs(negs2) + neu > 0 THEN abs(pos2 / (pos2 + abs(negs2) + neu)) ELSE 0.0 END AS vader_pos,
        CASE WHEN s2 <> 0 THEN s2 / sqrt(s2 * s2 + 15.0) ELSE 0.0 END AS vader_compound FROM k)
"""


DOCS = "SELECT doc_id AS id, source AS keep, coalesce(text, '') AS text FROM documents"
SCORE_COLS = ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]


def doc_scores(spark, d):
    """Sentiment of the documents as reviews, with the business they belong to."""
    return sentiment.review_sentiment(fx.review_texts(spark, d), lexicon(spark), keep=("business_id",))


@query("t1_review_sentiment", sql_round(_sentiment_sql(DOCS) + f"SELECT review_id, {', '.join(SCORE_COLS)} FROM scores", SCORE_COLS))
def t1_review_sentiment(spark, d):
    return round_doubles(sentiment.review_sentiment(fx.review_texts(spark, d), lexicon(spark)))


# the same texts with a phrase booster, a hyphened one, capitals and a negation before words of the lexicon; every third
# row has no id and every fifth repeats one
EDITED = """SELECT CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 1 ELSE doc_id END AS id, source AS keep,
    replace(replace(replace(coalesce(text, ''), ' the ', ' kind of the '), ' is ', ' sort-of IS '), ' of ', ' never SO of ') AS text FROM documents"""


@query("t1_phrases_and_capitals", sql_round(_sentiment_sql(EDITED) + f"SELECT review_id, {', '.join(SCORE_COLS)} FROM scores", SCORE_COLS))
def t1_phrases_and_capitals(spark, d):
    k, t = F.col("review_id"), F.coalesce("text", F.lit(""))
    for old, new in ((" the ", " kind of the "), (" is ", " sort-of IS "), (" of ", " never SO of ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    rows = fx.review_texts(spark, d).select(F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, 1).otherwise(k).alias("review_id"), t.alias("text"))
    return round_doubles(sentiment.review_sentiment(rows, lexicon(spark)))


@query("a4_business_sentiment", sql_round(_sentiment_sql(DOCS) + """SELECT keep AS business_id,
    avg(vader_compound) AS avg_sentiment FROM scores GROUP BY keep""", ["avg_sentiment"]))
def a4_business_sentiment(spark, d):
    return round_doubles(fb.avg_sentiment(doc_scores(spark, d), "business_id"))


CONV = "SELECT conv_id * 1000 + turn AS id, conv_id AS keep, coalesce(text, '') AS text FROM conversations"


@query("a5_user_sentiment", sql_round(_sentiment_sql(CONV) + """SELECT keep AS user_id, avg(vader_compound) AS avg_sentiment
    FROM scores GROUP BY keep""", ["avg_sentiment"]))
def a5_user_sentiment(spark, d):
    conv = fx.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"), F.col("conv_id").alias("user_id"), "text")
    return round_doubles(fb.avg_sentiment(sentiment.review_sentiment(conv, lexicon(spark), keep=("user_id",)), "user_id"))


@query("a6_sentiment_summary", _sentiment_sql(DOCS) + """SELECT keep AS source,
    round(avg(vader_compound), 3) AS compound_mean, round(min(vader_compound), 3) AS compound_min,
    round(max(vader_compound), 3) AS compound_max, count(*) AS n, round(avg(vader_pos), 3) AS pos_mean,
    round(avg(vader_neg), 3) AS neg_mean, round(avg(vader_neu), 3) AS neu_mean FROM scores GROUP BY keep""")
def a6_sentiment_summary(spark, d):
    return sentiment.sentiment_summary(doc_scores(spark, d).withColumnRenamed("business_id", "source"), "source")
