"""Substring dedup of word windows behind a count-min prefilter.

First pass: every task counts its windows in a count-min sketch, saturating at two, and the merged sketch gives an
overestimate of each window's count over the corpus. A window is counted by its anchor, the least of its short
grams: equal windows have equal anchors at the same place, so an anchor's count is no less than its window's, and a
quarter as many keys are counted. Second pass: only windows estimated to occur twice or more are grouped, exactly, by
128 bits of the SHA-256 of their words; none that repeats is lost. A window repeats an earlier one if it starts in a
document with a smaller id as well; the words that such windows cover go.

The exact grouping takes two steps. Consecutive windows with one anchor form a run, and runs are grouped first: all
windows of a run that a smaller document has as well are repeats. What is left are distinct runs in the first document
that has them; where an anchor has several, their windows are grouped one by one.

Equal texts are found first, by SHA-256; only the one with the smallest id is counted and grouped, and the others
repeat it throughout.

Defined results: a null or empty text has no words and its kept text is empty; equal ids are one document for
"smaller", but each of their texts loses only what itself repeats; rows that repeat are each returned; a null id is never smaller than another and loses no words; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import copies, sketches
from . import kernels as K
from .spans import covered
from .tables import text_of, written

WINDOW, GRAM = 13, 7


class Windows:
    """The windows of a slice: each one's first word, row and anchor code, in runs of one anchor."""

    def __init__(self, buf: np.ndarray, where: np.ndarray, window: int, gram: int):
        self.buf, self.spaced = buf, None
        self.s, self.e, self.first = K.words(buf, where)
        within = K.starts_within(self.first, len(self.s), window)
        self.start = np.flatnonzero(within)
        if not len(self.start):
            self.anchor, self.count = np.zeros(0, K.U64), self.start
            return
        grams = K.gram_codes(K.word_codes(buf, self.s, self.e), gram)
        at = K.anchors(grams, window - gram + 1)[self.start]
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.count = np.diff(np.concatenate((new, [len(at)])))
        self.start, self.anchor = self.start[new], grams[at[new]]

    def rows(self, use: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, self.start[use], "right") - 1

    def digests(self, start: np.ndarray, words: np.ndarray) -> np.ndarray:
        """128 bits of the SHA-256 of so many words from each start, joined by single spaces: two columns of longs."""
        if self.spaced is None:
            # what is in words, and one space for what stands after each
            keep = ~K.SEPARATORS[self.buf]
            inner = self.e[self.e < len(self.buf)]
            keep[inner[K.SEPARATORS[self.buf[inner]]]] = True
            self.spaced = np.where(K.SEPARATORS[self.buf], np.uint8(32), self.buf)[keep].tobytes()
            self.to = np.concatenate(([0], np.cumsum(keep)))
        return digests(self.spaced, self.to[self.s[start]], self.to[self.e[start + words - 1]])


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sha = hashlib.sha256
    raw = b"".join([sha(data[a:b]).digest()[:16] for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, depth: int = sketches.DEPTH, bits: int = sketches.BITS, text_bits: int = 0) -> DataFrame:
    """(doc_id, starts array<struct<start, n>>): n windows from a word on that also start in a document with a smaller
    id; start -1 for all windows. Ids name one text each; their last `text_bits` don't count for which one is smaller."""
    smaller = lambda x, y: F.shiftright(x, text_bits) < F.shiftright(y, text_bits)
    texts = text_of(docs).filter(F.col("doc_id").isNotNull())
    share = texts.sparkSession.sparkContext.broadcast
    chosen = copies.representatives(docs)
    first_copies = share(copies.filter_of(chosen, "kept"))

    def distinct_texts(batch):
        return batch.filter(pa.array(sketches.contains(first_copies.value, batch.column("doc_id").to_numpy().view(np.uint64))))

    def keys_of(batch):
        for _, _, buf, where in K.text_slices(distinct_texts(batch).column("text")):
            yield Windows(buf, where, window, gram).anchor

    sketch = sketches.merged(sketches.sketch_tasks(texts, keys_of, depth, bits))
    planes = share(sketches.collected(sketch, "twice", depth, bits))

    def runs(batches: Iterator[pa.RecordBatch]):
        """(windows, which runs may repeat, the ids of those, their digests)."""
        for batch in map(distinct_texts, batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, buf, where in K.text_slices(batch.column("text")):
                own = Windows(buf, where, window, gram)
                use = np.flatnonzero(sketches.contains(planes.value, own.anchor))
                if len(use):
                    yield own, use, ids[i:j][own.rows(use)], own.digests(own.start[use], own.count[use] + window - 1)

    def run_rows(batches):
        for own, use, ids, sha in runs(batches):
            begin = own.start[use] - own.first[own.rows(use)]
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(own.anchor[use])), pa.array(sha[:, 0]), pa.array(sha[:, 1]), pa.array(ids), pa.array(begin.astype(np.int32)), pa.array(own.count[use].astype(np.int32))], ["anchor", "a", "b", "doc_id", "start", "n"])

    rows = written(texts.mapInArrow(run_rows, "anchor long, a long, b long, doc_id long, start int, n int"), "window-runs")
    groups = written(rows.groupBy("a", "b").agg(F.first("anchor").alias("anchor"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "distinct-runs")
    several = share(copies.filter_of(groups.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "anchor"))
    # a run's digest is random, so its id may be mixed in by XOR
    firsts = share(copies.filter_of(groups.select(F.col("a").bitwiseXOR(F.col("least")).alias("key")), "key"))

    def window_rows(batches):
        for own, use, ids, sha in runs(batches):
            some = sketches.contains(several.value, own.anchor[use]) & sketches.contains(firsts.value, (sha[:, 0] ^ ids).view(np.uint64))
            if some.any():
                use, ids = use[some], ids[some]
                n = own.count[use]
                each = K.ragged(own.start[use], n)
                one = own.digests(each, np.full(len(each), window))
                begin = each - np.repeat(own.first[own.rows(use)], n)
                yield pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1]), pa.array(np.repeat(ids, n)), pa.array(begin.astype(np.int32))], ["a", "b", "doc_id", "start"])

    later = repeats_of(rows, groups.filter(smaller("least", "most")), smaller, "n")
    alone = written(texts.mapInArrow(window_rows, "a long, b long, doc_id long, start int"), "windows-of-distinct-runs")
    least = written(alone.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter(smaller("least", "most")), "repeated-windows")
    later = later.unionByName(repeats_of(alone.withColumn("n", F.lit(1)), least, smaller, "n"))
    whole = copies.all_copies(docs, chosen).filter(smaller("kept", "doc_id")).select("doc_id", F.lit(-1).alias("start"), F.lit(0).alias("n"))
    return later.unionByName(whole).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("starts"))


def repeats_of(rows: DataFrame, groups: DataFrame, smaller, *also: str) -> DataFrame:
    """Rows whose digest a smaller document has. Both sides are written tables, so that adaptive execution can split
    the rows of a digest that very many documents share."""
    return rows.join(groups.select("a", "b", "least").hint("merge"), ["a", "b"]).filter(smaller("least", "doc_id")).select("doc_id", "start", *also)


def with_starts(docs: DataFrame, starts: DataFrame) -> DataFrame:
    texts = text_of(docs)
    return texts.join(starts.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.coalesce("starts", F.expr("cast(array() as array<struct<start:int,n:int>>)")).alias("starts"))


def _kept(batches: Iterator[pa.RecordBatch], window: int):
    """(batch part, words, removed, kept bytes) by row."""
    for batch in batches:
        starts = batch.column("starts")
        bounds, begin, windows = starts.offsets.to_numpy(), *(starts.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        for i, j, buf, where in K.text_slices(batch.column("text")):
            s, e, first = K.words(buf, where)
            data = buf.tobytes()
            n, gone, kept = [], [], []
            for r in range(j - i):
                a, b = int(first[r]), int(first[r + 1])
                own = slice(bounds[i + r], bounds[i + r + 1])
                at, end = begin[own], begin[own] + windows[own] + window - 1
                if len(at) and at.min() < 0:
                    at, end = np.zeros(1, np.int64), np.array([b - a if b - a >= window else 0])
                keep = ~covered(at, end, b - a) if len(at) else np.ones(b - a, bool)
                ss, ee = s[a:b][keep].tolist(), e[a:b][keep].tolist()
                n.append(b - a)
                gone.append(b - a - len(ss))
                kept.append(b" ".join([data[x:y] for x, y in zip(ss, ee)]))
            yield batch.column("doc_id")[i:j], n, gone, kept


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text): the kept words joined by single spaces."""

    def run(batches):
        for ids, _, _, kept in _kept(batches, window):
            yield pa.RecordBatch.from_arrays([ids, pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "text"])

    work = lambda rows, bits: with_starts(rows, repeated_windows(rows, window, gram, text_bits=bits)).mapInArrow(run, "doc_id long, text string")
    return copies.by_number(docs, work)


def repeat_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what without_repeats() keeps, as digests."""

    def run(batches):
        for ids, n, gone, kept in _kept(batches, window):
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return copies.by_number(docs, lambda rows, bits: with_starts(rows, repeated_windows(rows, window, gram, text_bits=bits)).mapInArrow(run, schema))
