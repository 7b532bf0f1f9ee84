"""Incremental review scoring with Structured Streaming.

The reference scores its review file in batches of a few thousand lines and
appends each batch to the output.  Here new review files (JSON lines) are picked
up by a file-source stream and each micro-batch is scored with the batch job
(``operators.sentiment.review_sentiment``). A batch is stored under its id, so one that is replayed after a
failure replaces itself (``io.append_batch``). No state is kept between batches (the scoring is per review).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from placerank.operators.sentiment import review_sentiment
from placerank.sources.io import REVIEW_SCHEMA, append_batch


def start_review_scoring(spark: SparkSession, source_dir: str, lexicon: DataFrame, output_dir: str,
                         checkpoint_dir: str, files_per_batch: int = 10, schema: str = REVIEW_SCHEMA,
                         once: bool = False) -> StreamingQuery:
    """Stream ``source_dir`` (JSON lines with review_id and text) into scored parquet rows.

    ``checkpoint_dir`` must be a shared, reliable folder on a cluster.
    """
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source_dir))

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        keep = tuple(c for c in batch.columns if c not in ("review_id", "text"))
        append_batch(review_sentiment(batch, lexicon, keep=keep), output_dir, batch_id, "parquet")

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()
