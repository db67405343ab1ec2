"""Token-id files with a shared zstandard dictionary and one frame per document.

A file set is a folder of two tables that any Spark storage can hold:

* ``dictionary``: one row with the dictionary bytes (empty where there was too little to train on)
  and their SHA-256.
* ``segments``: rows of some megabytes. ``payload`` is a run of zstandard frames, one per document,
  each compressed by itself with the dictionary, so a short document is read and decompressed alone;
  ``doc_ids``, ``offsets`` and ``counts`` are the index of the segment, ``dictionary_sha256`` names the
  dictionary. ``range`` and ``number`` give the order of segments; documents ascend through them.

The dictionary is trained on the serialized ids of at most ``SAMPLE_DOCS`` documents of at most
``SAMPLE_CHARS`` characters, those with the least hash: a bounded sample of short documents, which
are what a dictionary helps. Everything else covers every document.

Documents are ordered by quantile ranges of their ids; each range is a task and sorted on its own.

Defined cases: null and empty texts are the end id alone; null ids come first; rows with equal ids
are separate documents in the order of their text hashes; an empty table gives a file set without
segments; other columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbrera.llm.sharding import range_of
from lumbrera.llm.shared import written

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 8192, 64 << 10
SEGMENT_BYTES, LEVEL = 4 << 20, 3
SEGMENT = "range bigint, number bigint, n_docs bigint, n_tokens bigint, dictionary_sha256 string, doc_ids array<{id}>, offsets array<bigint>, counts array<bigint>, payload binary"


def train_dictionary(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    """Dictionary bytes, trained in one task on the bounded sample; empty if zstandard finds too little.

    Hashes choose the sample, and only rows below a bound on the hash are looked at: texts are
    fetched for the chosen hashes alone. Equal rows have one hash and count once.
    """
    least, greatest = -(1 << 63), (1 << 63) - 1
    n = max(docs.count(), 1)
    bound = least + (greatest - least) * min(4 * SAMPLE_DOCS, n) // n
    short = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where((F.length("text") <= SAMPLE_CHARS) & (F.col("h") <= bound))
    chosen = short.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)
    sample = short.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))  # at most SAMPLE_DOCS hashes

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        from lumbrera.llm.tokens import encoder

        encode = encoder(tokenizer)
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, [encode.ids(t, end).tobytes() for t in rows["text"]]).as_bytes()
        except zstandard.ZstdError:
            made = b""
        return pd.DataFrame({"dictionary": [made]})

    rows = sample.select("text").groupBy().applyInPandas(train, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _frames(tokenizer: str, end: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumbrera.llm.tokens import encoder

        encode, press = encoder(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(dictionary))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encode.ids(t, end) for t in part.column("text").to_pylist()]
                frames = pa.array([press.compress(i.tobytes()) for i in ids], pa.binary())
                keep = [i for i, n in enumerate(part.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array([len(i) for i in ids], pa.int64()), frames],
                                                 names=[*(part.schema.names[i] for i in keep), "n_tokens", "frame"])

    return run


def _segments(sha: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, frames, offsets, now, number = [], [], [], [0], None, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([sha]),
                 pa.array([ids], pa.list_(id_type)), pa.array([offsets], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary())],
                names=["range", "number", "n_docs", "n_tokens", "dictionary_sha256", "doc_ids", "offsets", "counts", "payload"])

        for batch in batches:
            for span, doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "n_tokens", "frame")), strict=True):
                if ids and (span != now or offsets[-1] >= SEGMENT_BYTES):
                    yield close()
                    number = number + 1 if span == now else 0
                    ids, counts, frames, offsets = [], [], [], [0]
                now = span
                ids.append(doc)
                counts.append(n)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
        if ids:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """A file set of all documents at ``path``, which Spark and every executor can reach."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dictionary = train_dictionary(docs, tokenizer, end)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8) * 4
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * n)).alias("cuts")).first()["cuts"] or []  # at most n - 1 values
    ranged = docs.withColumns({"range": range_of(F.col("doc_id"), sorted(set(cuts))).cast("long"), "tie": F.xxhash64("text")})
    frames = ranged.mapInArrow(_frames(tokenizer, end, dictionary), f"doc_id {kind}, range bigint, tie bigint, n_tokens bigint, frame binary")
    laid = frames.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "tie")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    laid.mapInArrow(_segments(sha, arrow), SEGMENT.format(id=kind)).write.option("compression", "none").parquet(f"{path}/segments")


def _opened(dictionary: bytes, id_type: pa.DataType, wanted: set | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                starts = row["base"] + np.concatenate([[0], np.cumsum(row["counts"])])
                at = [j for j, d in enumerate(row["doc_ids"]) if wanted is None or d in wanted]
                for first in range(0, len(at), 1000):
                    some = at[first : first + 1000]
                    ids = [open_.decompress(row["payload"][row["offsets"][j] : row["offsets"][j + 1]]) for j in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["doc_ids"][j] for j in some], id_type), pa.array(starts[some], pa.int64()), pa.array([row["counts"][j] for j in some], pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of ``doc_ids`` alone; ids are little-endian 16-bit numbers.

    Only the index columns are read to find documents; of a segment that holds a wanted document only
    the wanted frames are decompressed.
    """
    dictionary = spark.read.parquet(f"{path}/dictionary").first()
    segments = spark.read.parquet(f"{path}/segments")
    if segments.where(F.col("dictionary_sha256") != dictionary["sha256"]).select("range").limit(1).count():
        raise ValueError("a segment was written with another dictionary")
    inside = Window.partitionBy("range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    totals = segments.groupBy("range").agg(F.sum("n_tokens").alias("all"))
    before = totals.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a range
    bases = segments.select("range", "number", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within")).join(before, "range")
    bases = written(bases.select("range", "number", (F.col("before") + F.col("within")).alias("base")), "bases")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    rows = segments.join(bases, ["range", "number"])
    if doc_ids is not None:
        rows = rows.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast(kind) for d in doc_ids])))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return rows.select("doc_ids", "counts", "offsets", "payload", "base").mapInArrow(
        _opened(bytes(dictionary["dictionary"]), arrow, set(doc_ids) if doc_ids is not None else None), f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
