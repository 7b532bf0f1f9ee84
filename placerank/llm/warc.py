"""WARC archives with one shared Zstandard dictionary, written and read by Spark.

Layout of each archive file: a skippable frame that holds the dictionary (magic 0x184D2A5D), then
one Zstandard frame per record, so every record can be decompressed alone with the dictionary. The
frames are parted by ``SEPARATOR``, an empty skippable frame; decoders skip it. Spark's text sink and
source write and read these files with that separator as line end: task commits, retries and splits
are Spark's, the path may be any Hadoop file system, and no archive passes through one task as a whole.
"""
from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.llm.common import shared_path

# fixed values: magic numbers of Zstandard's skippable frames, little-endian
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
SEPARATOR = (0x184D2A50).to_bytes(4, "little") + bytes(4)

RECORDS = ("page_id long, url string, digest string, payload_bytes long, record_type string, "
           "refers_to long, payload binary")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, *, min_payload: int = 0) -> DataFrame:
    """Decide for each page whether it is archived as response or revisit -> (page_id, url, payload,
    digest, payload_bytes, record_type, refers_to).

    Of pages with equal payloads of at least ``min_payload`` bytes the smallest page_id is the
    response. Digests are counted by a partial aggregate; only digests that repeat are joined back.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    page = page.withColumn("digest", F.unhex(F.sha1("payload"))) \
               .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = (page.filter(F.col("payload_bytes") >= min_payload)
             .groupBy(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"))
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (page.join(again, (page.digest == again.d) & (page.payload_bytes == again.b), "left")
            .select("page_id", "url", "payload", "digest", "payload_bytes",
                    F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first_id")).alias("refers_to")))


def train_dictionary(pages: DataFrame, *, size: int = 64 << 10, samples: int = 1000,
                     max_sample_bytes: int = 32 << 10) -> bytes:
    """A dictionary trained on at most ``samples`` records of at most ``max_sample_bytes`` each (chosen
    by a hash of the id, so at most 32 MB reach the driver). With too few records for training their
    plain bytes serve as a raw dictionary; with none it is empty."""
    rows = (pages.select(F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("p"), F.xxhash64("page_id").alias("h"))
            .filter(F.octet_length("p").between(1, max_sample_bytes)).orderBy("h", "p").limit(samples).select("p").collect())
    picked = [bytes(r.p) for r in rows]
    try:
        return zstandard.train_dictionary(size, picked).as_bytes() if len(picked) >= 8 else b"".join(picked)[:size]
    except zstandard.ZstdError:
        return b"".join(picked)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _record(row: dict) -> bytes:
    """One WARC/1.1 record; header values never hold line breaks."""
    digest = base64.b32encode(row["digest"]).decode()
    body = row["payload"] if row["record_type"] == "response" else b""
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(row['page_id']))}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if row["url"] is None else "".join(row["url"].splitlines()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": row["payload_bytes"],
        "X-Page-ID": row["page_id"],
        "WARC-Refers-To": None if row["refers_to"] is None else
        f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(row['refers_to']))}>",
        "X-Refers-To-Page": row["refers_to"],
        "WARC-Profile": REVISIT_PROFILE if row["record_type"] == "revisit" else None,
        "Content-Type": "text/html",
        "Content-Length": len(body),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def _frame(packers: list[zstandard.ZstdCompressor], data: bytes) -> bytes:
    """Compress one record; a frame that happens to hold the separator is packed at another level."""
    for packer in packers:
        frame = packer.compress(data)
        if SEPARATOR not in frame and not SEPARATOR.startswith(frame[-1:]):
            return frame
    half = len(data) // 2
    return _frame(packers, data[:half]) + _frame(packers, data[half:])


def write_archive(records: DataFrame, path: str, dictionary: bytes) -> None:
    """Write planned records below ``path``, one archive file per partition."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(dictionary)
        packers = [zstandard.ZstdCompressor(level=n, dict_data=d, write_checksum=True) for n in (6, 3, 1, 9, 12, 15)]
        opened = False
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                frames = [] if opened else [DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary]
                opened = True
                frames += [_frame(packers, _record(r)) for r in rows]
                yield pa.record_batch([pa.array(frames, pa.binary())], names=["frame"])

    if SEPARATOR in DICTIONARY_MAGIC + dictionary:
        raise ValueError("the dictionary holds the record separator; train it with another size")
    (records.mapInArrow(pack, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR.decode("ascii")).text(path))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Read archives back -> RECORDS. The dictionary is taken from the archives' leading frame; splits
    of a file are decoded independently. ``payload`` is empty for revisits; ``digest`` of a response
    is computed from the payload that was read, and must agree with its header."""
    frames = (spark.read.schema("value string").option("lineSep", SEPARATOR.decode("ascii")).text(path)
              .select(F.col("value").cast("binary").alias("frame")))
    leading = F.substring("frame", 1, 4) == F.lit(DICTIONARY_MAGIC)
    first = frames.filter(leading).limit(1).collect()     # one dictionary, of a size fixed at writing
    dictionary = bytes(first[0].frame)[8:] if first else b""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        names = ("page_id", "url", "digest", "payload_bytes", "record_type", "refers_to", "payload")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: dict[str, list] = {n: [] for n in names}
                for frame in batch.column(0).slice(at, 256):
                    stream = reader.stream_reader(frame.as_py(), read_across_frames=True)
                    head, _, rest = stream.readall().partition(b"\r\n\r\n")
                    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
                    if lines[0] != "WARC/1.1":
                        raise ValueError("not a WARC/1.1 record")
                    h = dict(x.split(": ", 1) for x in lines[1:])
                    payload = rest[:int(h["Content-Length"])]
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        again = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if again != digest or len(payload) != size:
                            raise ValueError(f"record of page {h.get('X-Page-ID')} is damaged")
                    number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                    row = (number("X-Page-ID"), h.get("WARC-Target-URI"), digest, size, h["WARC-Type"],
                           number("X-Refers-To-Page"), payload)
                    for n, v in zip(names, row, strict=True):
                        out[n].append(v)
                yield pa.record_batch([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=list(names))

    return frames.filter(~leading & (F.octet_length("frame") > 0)).mapInArrow(unpack, RECORDS)


def archive_pages(pages: DataFrame, path: str | None = None, **plan_options) -> DataFrame:
    """Write ``pages (page_id, url, html)`` as dictionary-compressed archives and read them back -> RECORDS.

    Edge cases: a null html is an empty payload; a null url is left out of the record; line breaks in
    a url are dropped. A null page_id never serves as the response of a group that has an id; rows that
    repeat page_id and payload are each a response if that id is the smallest. An empty table writes
    no record and reads back as an empty result. Other columns of ``pages`` are ignored. Records are
    compressed in slices of 256, so memory holds a few pages at a time; one page must fit in memory.
    """
    path = path or shared_path(pages.sparkSession, "warc")
    write_archive(plan_records(pages, **plan_options), path, train_dictionary(pages))
    return read_archive(pages.sparkSession, path)
