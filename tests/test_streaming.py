"""The streaming scorer appends the same scores as the batch job."""
import json

from placerank.operators.sentiment import review_sentiment
from placerank.streaming.sentiment_stream import start_review_scoring


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for f in range(3):
        with open(src / f"part{f}.json", "w") as fh:
            for i in range(5):
                rid = f"{f}-{i}"
                fh.write(json.dumps({"review_id": rid, "user_id": "u", "business_id": "b", "stars": 4,
                                     "text": "good good" if i % 2 else "not good"}) + "\n")
    lex = spark.createDataFrame([("good", 1.9)], "word string, valence double")
    q = start_review_scoring(spark, str(src), lex, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                             files_per_batch=1, once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = review_sentiment(spark.read.json(str(src)), lex)
    assert out.count() == 15
    a = {r.review_id: round(r.vader_compound, 12) for r in out.collect()}
    b = {r.review_id: round(r.vader_compound, 12) for r in batch.collect()}
    assert a == b
