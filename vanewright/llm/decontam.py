"""Benchmark decontamination: item-sized windows by SimHash, multi-index lookup, exact verification.

A document leaks an item if a window of it, as many words long as the item (or the whole text where that is shorter),
has a weighted Jaccard similarity of 0.75 or more with the item over shingles of five words, each weighted by how
often it occurs. Windows are fingerprinted by a 64-bit SimHash of their words and looked up in a multi-index: with
eight blocks of eight bits and a radius r, two fingerprints within r differ in some block by r // 8 bits at most, so
probing every block within that distance finds all fingerprints within the radius. Those are then verified exactly.

A window as long as the item can't reach the similarity unless six sevenths of its shingles are shingles of items of
its size; a shorter text, unless it has three quarters of the item's. Those bounds are exact, and are taken first by
counting, so that fingerprints are made only where an item can be.

Items are held in blocks of bounded size, by total bytes. Blocks are taken one after the other: documents are read once
for each, what it found is written, and its memory is given back before the next is made.

The radius is measured: of 51,187 windows of 9 to 120 words whose edits left them at 0.75 or more, none lay further than
19 bits from its item. The probes meet 71 of 100 random fingerprints, of which the radius keeps 2.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; items without words match nothing; an item of fewer
words than a shingle matches only documents of the same words; a null or empty text leaks nothing; rows that repeat
an id give one row per item; documents with a null id are one for this; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import text_of, written

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
RADIUS, BLOCKS = 23, 8
#: Bytes of benchmark text in one block; bits of the table that tells most shingles apart.
BLOCK_BYTES, TABLE_BITS = 16 << 20, 24


def simhash(codes: np.ndarray) -> int:
    """Signs of the sums of the words' bits as +1 and -1."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(codes)).view(np.uint64)[0])


class MultiIndex:
    """Fingerprints by each of their blocks; found() gives all within the radius."""

    def __init__(self, prints: list[int], radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.at: list[dict[int, list[int]]] = [{} for _ in range(BLOCKS)]
        for i, p in enumerate(prints):
            for b in range(BLOCKS):
                self.at[b].setdefault(p >> 8 * b & 255, []).append(i)
        near = radius // BLOCKS
        self.flips = [sum(1 << x for x in c) for k in range(near + 1) for c in combinations(range(8), k)]

    def found(self, p: int) -> list[int]:
        seen = {i for b in range(BLOCKS) for f in self.flips for i in self.at[b].get((p >> 8 * b & 255) ^ f, ())}
        return sorted(i for i in seen if (self.prints[i] ^ p).bit_count() <= self.radius)


def shingles(codes: np.ndarray) -> np.ndarray:
    return K.gram_codes(codes, SHINGLE) if len(codes) >= SHINGLE else K.gram_codes(codes, len(codes)) if len(codes) else codes


def similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """Weighted Jaccard similarity as a fraction."""
    low = sum(min(n, b[t]) for t, n in a.items())
    return low, sum(a.values()) + sum(b.values()) - low


class Items:
    """A block of the benchmark."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.codes, self.bags, self.size = [], [], [], []
        for i, text in zip(ids, texts):
            buf = np.frombuffer(text.encode(), np.uint8)
            s, e, _ = K.words(buf, np.array([0, len(buf)]))
            if len(s):
                codes = K.word_codes(K.LOWER[buf], s, e)
                self.ids.append(i)
                self.codes.append(codes)
                self.bags.append(Counter(shingles(codes).tolist()))
                self.size.append(len(codes))
        self.sizes = sorted({n for n in self.size if n >= SHINGLE})
        self.index = {n: ([i for i, m in enumerate(self.size) if m == n], None) for n in {*self.size}}
        self.index = {n: (own, MultiIndex([simhash(self.codes[i]) for i in own])) for n, (own, _) in self.index.items()}
        every = sorted({(t, self.sizes.index(n)) for bag, n in zip(self.bags, self.size) if n >= SHINGLE for t in bag})
        token = np.array([t for t, _ in every], np.uint64)
        #: known shingles, sorted, and the sizes of the items that have each, end to end
        self.known, begin = np.unique(token, return_index=True)
        self.has_size, self.begin = np.array([k for _, k in every], np.int64), np.concatenate((begin, [len(every)]))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.known >> K.U64(64 - TABLE_BITS)] = True
        #: a whole text shorter than the item has as few shingles as the similarity lets it
        self.least = min((-(-NUMERATOR * (n - SHINGLE + 1) // DENOMINATOR) for n in self.sizes), default=1 << 60)
        self.short = {n: own for n, (own, _) in self.index.items() if n < SHINGLE}

    @staticmethod
    def need(have: int, n: int) -> int:
        """Shingles that a window of so many must share with an item of n words. A text may be shorter than the item."""
        total = NUMERATOR * (have + n - SHINGLE + 1)
        return -(-total // (NUMERATOR + DENOMINATOR))

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Which of these codes are shingles of items."""
        at = np.flatnonzero(self.table[grams >> K.U64(64 - TABLE_BITS)])
        if not len(at) or not len(self.known):
            return at[:0]
        spot = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        return at[self.known[spot] == grams[at]]

    def leaks(self, codes: np.ndarray, grams: np.ndarray, at: np.ndarray) -> dict[int, tuple[float, int]]:
        """Of one document (its word codes, shingle codes, and where those are known): items by the similarity and
        the start of the best window."""
        found: dict[int, tuple[float, int]] = {}
        spot = np.searchsorted(self.known, grams[at])
        many = self.begin[spot + 1] - self.begin[spot]
        # a row for each known shingle of the document and each size of items that has it, by size
        place, size = np.repeat(at, many), self.has_size[K.ragged(self.begin[spot], many)]
        order = np.argsort(size, kind="stable")
        place, total = place[order], np.bincount(size, minlength=len(self.sizes))
        ends = np.cumsum(total)
        lengths = np.minimum(np.array(self.sizes), len(codes))
        enough = total >= [self.need(w - SHINGLE + 1, n) for w, n in zip(lengths, self.sizes)]
        for k in np.flatnonzero(enough).tolist():
            n, width = self.sizes[k], int(lengths[k])
            count = np.zeros(len(grams) + 1, np.int64)
            count[place[ends[k] - total[k] : ends[k]] + 1] = 1
            count = np.cumsum(count)
            span = width - SHINGLE + 1
            own, index = self.index[n]
            for p in np.flatnonzero(count[span:] - count[:-span] >= self.need(span, n)).tolist():
                bag = None
                for i in index.found(simhash(codes[p : p + width])):
                    bag = bag or Counter(grams[p : p + span].tolist())
                    low, high = similarity(bag, self.bags[own[i]])
                    if DENOMINATOR * low >= NUMERATOR * high and low / high > found.get(own[i], (0, 0))[0]:
                        found[own[i]] = (low / high, p)
        return found

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            out: list[tuple] = []
            for i, j, buf, where in K.text_slices(batch.column("text")):
                s, e, first = K.words(buf, where)
                codes = K.word_codes(K.LOWER[buf], s, e)
                grams = K.gram_codes(codes, SHINGLE)
                at = self.hits(grams)
                at = at[K.starts_within(first, len(codes), SHINGLE)[at]] if len(at) else at
                bounds = np.searchsorted(at, first)
                for r in np.flatnonzero(np.diff(bounds) >= min(self.least, 1 << 30)).tolist() if len(at) else ():
                    a, b = int(first[r]), int(first[r + 1])
                    for item, (score, p) in self.leaks(codes[a:b], grams[a : b - SHINGLE + 1], at[bounds[r] : bounds[r + 1]] - a).items():
                        out.append((ids[i + r].as_py(), self.ids[item], score, p, min(self.size[item], b - a)))
                for n, own in self.short.items():
                    for r in np.flatnonzero(np.diff(first) == n).tolist():
                        out += [(ids[i + r].as_py(), self.ids[x], 1.0, 0, n) for x in own if (codes[first[r] : first[r + 1]] == self.codes[x]).all()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "start_word", "n_words"])


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): every document and item that it leaks, with its best window."""
    texts = text_of(docs)
    items = text_of(benchmark, "item_id").withColumnRenamed("doc_id", "item_id")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # block_bytes in expectation
        held = texts.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))
        found = texts.mapInArrow(lambda batches, held=held: held.value.rows(batches), "doc_id long, item_id long, similarity double, start_word long, n_words long")
        if blocks > 1:
            found = written(found, "leaks")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("before"), "n_words"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("w")).select("doc_id", "item_id", F.round("w.similarity", 6).alias("similarity"), (-F.col("w.before")).alias("start_word"), "w.n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the input whose text leaks no item."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaks")).filter("_leaks is not null").distinct()
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"] == found["_leaks"], "left_anti")
