"""Token-id files: documents as arrays of token ids in ORC.

Documents are dealt to ranges of ids, sorted, encoded where they are sorted, and written as ORC, one file a range: ids
are stored by the format's integer run-length encoding, every ROW_INDEX rows have an entry in the row index (least and
largest document id) and a Bloom filter of their document ids. Stripes of a file are read in parallel; a filter on
document ids reaches the reader, which leaves out files' stripes and groups of rows by those statistics and filters.

Each file numbers its tokens from 0, so tasks write without waiting for those before them; a small table of parts
(one row for each file: first and last id, rows, tokens) says how many tokens precede a part, and reading adds that.

Defined results: a null or empty text is the end id alone; rows of one id, null ids included, stand in the order of their text's SHA-256,
null ids before all others; equal rows are each written; very long texts lie in one row and one slice each; an empty table
gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path
from . import kernels as K
from .bpe import vocabulary_path
from .pieces import SLICE_BYTES, encoder_of
from .tables import text_of

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
#: Rows of an entry of the row index, bytes of a stripe, and wrong passes of a Bloom filter.
ROW_INDEX, STRIPE_BYTES, WRONG = 1_000, 64 << 20, 0.01
SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
PARTS_SCHEMA = "part int, first_id long, last_id long, n_docs long, n_tokens long"
#: The most parts whose first tokens are sent to all tasks (24 bytes each); more are joined by shuffle.
SENT_PARTS = 100_000


def encoded_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, text) -> rows of the files."""
    encoder, part, at = encoder_of(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for i, j, buf, where in K.text_slices(batch.column("text"), SLICE_BYTES):
            ids, first = encoder.encoded(buf, where)
            ids = np.insert(ids, first[1:], end_id)
            first = first + np.arange(j - i + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], pa.array(np.full(j - i, part, np.int32)), pa.array(at + first[:-1]), pa.array(np.diff(first)), pa.ListArray.from_arrays(first.astype(np.int32), ids.astype(np.int32))],
                ["doc_id", "part", "at", "n_tokens", "ids"],
            )
            at += int(first[-1])


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode documents and write `folder`/tokens and `folder`/parts. Equal rows are told apart by the partition
    that they come from, so that no range has to hold all copies of a row."""
    path = path or vocabulary_path(VOCABULARY)
    named = text_of(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.spark_partition_id().alias("source"), "text")
    order = ["doc_id", "sha", "source"]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = dealt.mapInArrow(lambda batches: encoded_rows(batches, path, end_id), SCHEMA)
    layout = {
        "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(ROW_INDEX), "orc.stripe.size": str(STRIPE_BYTES),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(WRONG),
    }
    rows.write.options(**layout).orc(f"{folder}/tokens")
    stored = rows_of(docs.sparkSession, folder)
    parts = stored.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    parts.write.orc(f"{folder}/parts")


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(f"{folder}/tokens")


def with_start(rows: DataFrame, folder: str) -> DataFrame:
    """Adds `start`, the tokens of all documents before, to rows that have `part` and `at`."""
    parts = rows.sparkSession.read.schema(PARTS_SCHEMA).orc(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if parts.count() <= SENT_PARTS else bases.hint("merge")
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("at")).drop("base", "part", "at")


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, start); of the given ids alone, or of a range of ids: the reader then leaves out what its
    statistics and Bloom filters exclude."""
    rows = rows_of(spark, folder)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    if least is not None:
        rows = rows.filter(F.col("doc_id") >= least)
    if most is not None:
        rows = rows.filter(F.col("doc_id") <= most)
    return with_start(rows, folder)


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        data = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4").tobytes()
        ends = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
        view = memoryview(data)
        crc = pa.array([zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "at", "n_tokens")] + [crc], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents written to files and read back from them."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    write_token_files(docs, folder, path)
    read = rows_of(spark, folder).select("doc_id", "part", "at", "n_tokens", "ids")
    found = read.mapInArrow(checksums, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return with_start(found, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
