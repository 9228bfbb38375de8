"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, long ones further at sentence ends, and what is still long after words that
a hash of their last letters picks (so that the same passage is cut alike wherever it stands). Each paragraph gives a 64-bit key:
48 bits of its hash (with its ordinal among equal ones) and its length in bytes; a paragraph of more bytes than the
length can say is cut every LONGEST bytes. A key is added to three cells; a cell
holds a count, the XOR of its keys and the XOR of their checks. Two sketches of one size subtract cell by cell, which
leaves the keys in which they differ. Peeling takes keys from cells that hold a single one until none is left; where
it gets stuck, the sketches were too small for the difference and both are made anew with twice as many cells; past
MOST_TRIES times as many cells as keys, more cells can't help (two paragraphs of a text share a key), and the lists of
keys themselves are compared.

A fingerprint is the sketch with the base number of cells, as text; equal texts have equal fingerprints. The likeness
of two texts is one less the share of bytes in the paragraphs that differ, recovered by peeling.

Defined results: a null text is an empty one; an empty text has an empty sketch; two empty texts have likeness 1;
ties of ids are ordered by text; rows that repeat are each compared with the row after; a null id comes first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import text_of

CELLS, HASHES, LONG, LONGEST, MOST_TRIES = 16, 3, 120, 0xFFFF, 16
#: Ranges of ids dealt to each shuffle partition.
RANGES_PER_TASK = 4


def paragraphs(buf: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the paragraphs of texts laid end to end."""
    n = len(buf)
    line = buf == 10
    stop = np.zeros(n, bool)
    stop[:-1] = ((buf[:-1] == 46) | (buf[:-1] == 33) | (buf[:-1] == 63)) & (buf[1:] == 32)
    cut = line.copy()
    cut[where[1:][np.diff(where) > 0] - 1] = True
    picked = np.zeros(n, bool)
    if n > 3:
        picked[3:] = (K.rolling_codes(K.BYTE_CODES[buf], 4) & K.U64(7) == 0) & (buf[3:] == 32)
    for mark in (stop, picked):
        size = np.diff(np.concatenate(([0], np.flatnonzero(cut) + 1)))
        cut |= mark & np.repeat(size > LONG, size)
    start = np.concatenate(([0], np.flatnonzero(cut)[:-1] + 1))
    size = np.diff(np.concatenate((start, [n])))
    parts = -(-size // LONGEST)
    start = np.repeat(start, parts) + LONGEST * K.ragged(np.zeros(len(parts), np.int64), parts)
    return start, np.concatenate((start[1:], [n]))


def paragraph_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the paragraphs of each text, end to end, and where each text's begin."""
    where = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf):
        return np.zeros(0, K.U64), np.zeros(len(texts) + 1, np.int64)
    start, end = paragraphs(buf, where)
    codes = K.span_codes(buf, start, end)
    row = np.searchsorted(where, start, "right") - 1
    # the ordinal of each among equal ones of its text
    order = np.lexsort((start, codes, row))
    c, r = codes[order], row[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (r[1:] != r[:-1])))
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    keys = (K.mix(codes + nth.astype(np.uint64) * K.BASE) & ~K.U64(0xFFFF)) | (end - start).astype(np.uint64)
    return keys, np.searchsorted(row, np.arange(len(texts) + 1))


def checks(keys: np.ndarray) -> np.ndarray:
    return K.mix(keys ^ K.BASE) >> K.U64(32)


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each key (HASHES rows): one in each third, so they never meet."""
    third = cells // HASHES
    parts = [third, third, cells - 2 * third]
    return np.stack([sum(parts[:h]) + (K.mix(keys + K.U64((h + 1) << 48)) % K.U64(parts[h])).astype(np.int64) for h in range(HASHES)])


def sketch(keys: np.ndarray, row: np.ndarray, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, key XORs, check XORs) of every row's sketch, rows * cells each."""
    at = (places(keys, cells) + row * cells).ravel()
    count = np.bincount(at, minlength=rows * cells)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0))) if len(at) else at
    xors = []
    for values in (keys, checks(keys)):
        out = np.zeros(rows * cells, K.U64)
        if len(at):
            out[at[order][first]] = np.bitwise_xor.reduceat(np.tile(values, HASHES)[order], first)
        xors.append(out)
    return count, *xors


def as_text(count: np.ndarray, key: np.ndarray, check: np.ndarray, cells: int) -> list[str]:
    """Each sketch as `cells:` and its cells (count 4 bytes, key 8, check 4) in base 64."""
    raw = np.empty(len(count), np.dtype([("n", "<u4"), ("k", "<u8"), ("c", "<u4")]))
    raw["n"], raw["k"], raw["c"] = count, key, check
    data, size = raw.tobytes(), raw.itemsize * cells
    return [f"{cells}:{base64.b64encode(data[i : i + size]).decode()}" for i in range(0, len(data), size)]


def peeled(count: np.ndarray, key: np.ndarray, check: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys recovered from differences of sketches, the row of each, and which rows came out empty. All rows are
    peeled at once, in rounds."""
    rows = len(count) // cells
    keys_out, rows_out = [], []
    live = np.arange(len(count))
    while len(live):
        pure = live[(np.abs(count[live]) == 1)]
        pure = pure[checks(key[pure]) == check[pure]]
        if not len(pure):
            break
        row = pure // cells
        _, one = np.unique(np.stack((row.astype(np.uint64), key[pure])), axis=1, return_index=True)
        k, r, sign = key[pure][one], row[one], count[pure][one]
        keys_out.append(k)
        rows_out.append(r)
        at = (places(k, cells) + r * cells).ravel()
        np.subtract.at(count, at, np.tile(sign, HASHES))
        np.bitwise_xor.at(key, at, np.tile(k, HASHES))
        np.bitwise_xor.at(check, at, np.tile(checks(k), HASHES))
        live = np.unique(at)
    empty = ~((count != 0) | (key != 0)).reshape(rows, cells).any(1)
    none = np.zeros(0, np.int64)
    return np.concatenate(keys_out) if keys_out else none.view(K.U64), np.concatenate(rows_out) if rows_out else none, empty


def differing_bytes(keys: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """For each pair of texts (a[i], b[i]), the bytes of the paragraphs that only one of them has: subtract, peel,
    and again with twice the cells for the pairs that got stuck."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        sides = []
        for side in (a[left], b[left]):
            size = first[side + 1] - first[side]
            at = K.ragged(first[side], size)
            sides.append(sketch(keys[at], np.repeat(np.arange(len(left)), size), len(left), cells))
        (n1, k1, c1), (n2, k2, c2) = sides
        found, row, done = peeled(n1 - n2, k1 ^ k2, c1 ^ c2, cells)
        ok = done[row]
        out[left] = np.where(done, np.bincount(row[ok], (found[ok] & K.U64(0xFFFF)).astype(float), minlength=len(left)), 0).astype(np.int64)
        left, cells = left[~done], cells * 2
        if len(left) and cells > MOST_TRIES * max(CELLS, int((first[a + 1] - first[a] + first[b + 1] - first[b]).max())):
            out[left] = [listed_difference(keys[first[i] : first[i + 1]], keys[first[j] : first[j + 1]]) for i, j in zip(a[left], b[left])]
            break
    return out


def listed_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Bytes of the paragraphs that only one of two lists of keys has."""
    every, which = np.unique(np.concatenate((a, b)), return_inverse=True)
    more = np.bincount(which[: len(a)], minlength=len(every)) - np.bincount(which[len(a) :], minlength=len(every))
    return int((np.abs(more) * (every & K.U64(0xFFFF)).astype(np.int64)).sum())


def total_bytes(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum((keys & K.U64(0xFFFF)).astype(np.int64))))[first])


def likeness(keys: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = total_bytes(keys, first)
    both = size[a] + size[b]
    return np.where(both > 0, 1 - differing_bytes(keys, first, a, b) / np.maximum(both, 1), 1.0)


def edited_text(text: str, after: str) -> str:
    """The last half of the text (rounded down) replaced by the start of the one after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(pairs: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """Consecutive rows -> a result for all but the last."""
    ids, texts = [i for i, _ in pairs[:-1]], [t for _, t in pairs]
    n = len(ids)
    edited = [edited_text(a, b).encode() for a, b in zip(texts[:-1], texts[1:])]
    keys, first = paragraph_keys([t.encode() for t in texts] + edited)
    own, new = np.arange(n), np.arange(n) + n + 1
    row = np.repeat(np.arange(len(texts) + n), np.diff(first))
    prints = as_text(*sketch(keys, row, len(texts) + n, CELLS), CELLS)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            pa.array(prints[:n]),
            pa.array(prints[n + 1 :]),
            pa.array(likeness(keys, first, own, new)),
            pa.array(likeness(keys, first, own, own + 1)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _ranges(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, order): within a range each row is compared with the next; the last row of a range is
    the first of the next range and only closes it."""
    held: list[tuple[int | None, str]] = []
    size, current = 0, None
    for batch in batches:
        for g, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text"))):
            if g != current or size > most:
                if len(held) > 1:
                    yield compared(held)
                held = held[-1:] if g == current else []
                size = sum(len(t) for _, t in held)
                current = g
            held.append((doc, text))
            size += len(text)
    if len(held) > 1:
        yield compared(held)


def bounds_below(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are less than the key, by bisection."""
    if not bounds:
        return F.lit(0)
    have, at = F.lit(bounds), lambda acc: F.floor((acc["low"] + acc["high"]) / 2).cast("int")

    def halve(acc, _):
        less = F.try_element_at(have, at(acc) + 1) < key
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & less, at(acc) + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~less, at(acc)).otherwise(acc["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda acc: acc["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of ids, each range followed by a copy of the first row after it (after the last, of the
    first row of all). Range bounds are approximate quantiles of the ids; only bounds and one id for each range come
    to the driver."""
    texts = text_of(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "doc_id", "text")
    spark = docs.sparkSession
    ranges = RANGES_PER_TASK * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = texts.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    named = texts.withColumn("range", bounds_below(F.col("key"), bounds))
    firsts = {r["range"]: r["k"] for r in named.groupBy("range").agg(F.min("key").alias("k")).collect()}  # one row for each range
    order = sorted(firsts)
    rows = named.withColumn("closes", F.lit(0))
    if not order:
        return rows
    # the first row of each range, by id and then text, closes the range before
    heads = named.filter(F.col("key").isin([firsts[g] for g in order])).groupBy("range", "key").agg(F.min(F.struct("text", "doc_id")).alias("h"))
    previous = dict(zip(order, [order[-1], *order[:-1]]))
    before = F.element_at(F.lit([previous.get(g, g) for g in range(len(bounds) + 1)]), F.col("range") + 1)
    closing = heads.select("key", "h.doc_id", "h.text", before.alias("range"), F.lit(1).alias("closes"))
    return rows.unionByName(closing)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likeness to that and to the next document's."""
    dealt = with_next(docs).repartition("range").sortWithinPartitions("range", "closes", "key", "text")
    return dealt.select("range", "doc_id", "text").mapInArrow(_ranges, COLUMNS)
