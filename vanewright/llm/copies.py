"""Equal texts: one representative of each, so that what compares texts looks at distinct ones alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import with_grouped_running
from . import sketches
from .tables import text_of, written

FILTER_BITS = 25
#: Bits of a number (see numbered()) that tell the texts of one id apart.
TEXT_BITS = 31


def addressed(docs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(doc_id, text, sha) of the rows that have an id and so many bytes of text."""
    return text_of(docs).filter((F.octet_length("text") >= least_bytes) & F.col("doc_id").isNotNull()).select("doc_id", "text", F.sha2("text", 256).alias("sha"))


def representatives(docs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(sha, kept, copies): the smallest id of every distinct text and how many rows hold it. No text moves."""
    named = addressed(docs, least_bytes)
    return written(named.groupBy("sha").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")), "distinct-texts")


def all_copies(docs: DataFrame, chosen: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(doc_id, kept) of the rows whose text occurs more than once."""
    named = addressed(docs, least_bytes).select("doc_id", "sha")
    return named.join(chosen.filter("copies > 1").select("sha", "kept").hint("merge"), "sha").select("doc_id", "kept")


def numbered(docs: DataFrame) -> DataFrame | None:
    """(doc_id, number, text) with a number for each distinct pair of id and text, so that what is found in one text is
    not laid over another of the same id: ids by rank, then the texts of an id by SHA-256 in the last TEXT_BITS. Null ids
    have none. None where no id has several texts, as then the id itself will do; finding that out moves 24 bytes a document."""
    named = addressed(docs).select("doc_id", "sha")
    short = F.substring("sha", 1, 16)
    if named.groupBy("doc_id").agg(F.min(short).alias("a"), F.max(short).alias("b")).filter("a <> b").isEmpty():
        return None
    pairs = written(named.distinct().withColumn("one", F.lit(1).cast("long")), "texts-of-ids")
    ids = written(pairs.select("doc_id", "one", F.lit(0).alias("all")).distinct(), "ids")
    ranks = with_grouped_running(ids, ["all"], "doc_id", {"rank": "one"}).select("doc_id", "rank")
    places = with_grouped_running(pairs, ["doc_id"], "sha", {"place": "one"}).select("doc_id", "sha", "place")
    numbers = places.join(ranks.hint("merge"), "doc_id").select("doc_id", "sha", (F.shiftleft("rank", TEXT_BITS) + F.col("place")).alias("number"))
    numbers = written(numbers, "numbers-of-texts")
    texts = text_of(docs).withColumn("sha", F.sha2("text", 256))
    return written(texts.join(numbers.hint("merge"), ["doc_id", "sha"], "left").select("doc_id", "number", "text"), "numbered-texts")


def by_number(docs: DataFrame, work) -> DataFrame:
    """work(docs, bits), where ids name texts alone; with numbers in place of ids where they don't, and the ids put back."""
    rows = numbered(docs)
    if rows is None:
        return work(docs, 0)
    done = work(rows.select(F.col("number").alias("doc_id"), "text"), TEXT_BITS)
    ids = written(rows.select("number", "doc_id").filter("number is not null").distinct(), "ids-of-numbers")
    other = [c for c in done.columns if c != "doc_id"]
    return done.withColumnRenamed("doc_id", "number").join(ids.hint("merge"), "number", "left").select("doc_id", *other)


def filter_of(frame: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of a long column: 4 * 2^bits bits, however many values there are. With more values than it
    is made for it lets more through in error; it never loses one."""

    def keys_of(batch):
        yield batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)

    parts = sketches.sketch_tasks(frame.select(column), keys_of, 4, bits)
    return sketches.collected(sketches.merged(parts), "once", 4, bits)
