"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on ``doc_id``.

``write`` deals the documents out by ranges of ``doc_id``, sorts each range, encodes it and writes
one file per range, whose stripes carry run-length encoded ids, an index entry every
``row_index_stride`` rows and a Bloom filter on ``doc_id``. A filter on ``doc_id`` so skips
files' stripes by their statistics, and Spark deals a file's stripes out to several tasks.

Defined cases: null and empty texts have the end id alone; documents stand in ascending
``doc_id`` order, nulls first, equal ids in order of their texts, equal rows as often as they
came; an empty table gives files without rows; other columns are not looked at; a very long text is encoded whole by one
task, which holds some 20 bytes for each byte of it, and its ids are one row of the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumfold.llm.common import texts
from sumfold.llm.tokens import encoder

ROWS = "part long, doc_id long, part_start long, n_tokens long, ids array<int>"
_SCHEMA = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_FLUSH = 4 << 20  # bytes of ids in an Arrow batch


def _batch(part: int, at: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    n = np.array([len(x) // 4 for x in ids], "i8")
    ends = np.cumsum(n)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, "i8")), pa.array(doc_ids, pa.int64()), pa.array(at + ends - n), pa.array(n), lists], schema=_SCHEMA)


def encode_ranges(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents in ranges of ``doc_id``: their ids, and the ids before them in their range."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, at = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py()) + end
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size > _FLUSH:
                    yield _batch(part, at, doc_ids, held)
                    doc_ids, held, at, size = [], [], at + size // 4, 0
        if held:
            yield _batch(part, at, doc_ids, held)

    return texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, ROWS)


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000, bloom_fpp: float = 0.01) -> str:
    """Write the ids of ``docs`` (doc_id, text) to ORC files at ``path``."""
    (
        encode_ranges(docs, tokenizer, end_id)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )
    return path


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the files at ``path``, or those of ``doc_ids``, found by the files' metadata."""
    rows = spark.read.schema(ROWS).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def positions(rows: DataFrame) -> DataFrame:
    """Per document of the files: ``start``, the ids of all documents before it, and digests of its own."""
    # a row per file: their running sum is metadata, not data
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = files.select(F.col("part").alias("of_part"), (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<i4", copy=False)
            sums = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype("i8")), pa.array(sums, pa.int64())], names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    summed = rows.select("part", "doc_id", "part_start", "ids").mapInArrow(crc, "part long, doc_id long, part_start long, n_tokens long, ids_crc32 long")
    return summed.join(before, F.col("part") == F.col("of_part")).select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
