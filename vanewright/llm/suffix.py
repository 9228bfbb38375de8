"""Suffix-array dedup with longest-previous-factor arrays.

A text's bytes are removed where a string of `length` bytes that covers them also starts elsewhere. Which ones those
are follows from the suffixes in order, cut at `length` bytes, and the common prefixes of neighbours: of each suffix,
the previous and next ones in that order with a smaller place in the corpus give its longest earlier match (longest
previous factor), and, mirrored, those with a larger place its longest later one. Where a factor has `length` bytes,
the suffix's string is a repeat.

Spark deals suffixes to tasks by content: every string of `length` bytes has an anchor, the least of its k-byte
grams, at the same place in all of its copies, so suffixes with long common prefixes share their anchor's code.

1. Every distinct text yields its anchors; codes that occur once are done with (an aggregate of longs).
2. Consecutive suffixes with one repeated anchor form a piece of text. Equal pieces, told by 128 bits of SHA-256, have
   equal suffixes, so each distinct one is kept once, with its first and its last place and how often it occurs.
3. The distinct pieces of an anchor meet in one task, which orders their suffixes (each with both places) and computes
   the factors. Copies between the first and the last have the first before and the last after them, so they take
   the last one's earlier and the first one's later factors.
4. Anchors with more distinct pieces than a task should hold are cut further, into pieces of one suffix, which are
   made distinct in the same way, and dealt by their own digests. They go through the same ordering.

Equal texts are found first, by SHA-256, and represented by the smallest id; others of them are repeats throughout.
Rolling hashes and Bloom filters of fixed size tell which codes and places to look at; what they let through in error
costs time, not exactness.

Defined results: a null or empty text, or one of fewer than `length` bytes, loses nothing; documents with a null id
lose nothing and repeat nothing; rows that repeat an id and its text count as copies of each other; matches may
overlap themselves, as in runs of one character; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import copies, sketches
from . import kernels as K
from .spans import merged_runs
from .substring import digests
from .tables import text_of, written

LENGTH, GRAM = 200, 64
#: Anchors with more distinct pieces than this are cut into pieces of one suffix; suffixes ordered at once in a task.
OFTEN, BATCH_SUFFIXES, FILTER_BITS = 2000, 120_000, copies.FILTER_BITS


def anchor_runs(buf: np.ndarray, where: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor: (first suffix, suffixes, anchor's place, anchor's code), places in the slice."""
    within = K.starts_within(where, len(buf), length)
    none = np.zeros(0, np.int64)
    if not within.any():
        return none, none, none, np.zeros(0, K.U64)
    codes = K.rolling_codes(K.BYTE_CODES[buf], gram)
    at = K.anchors(codes, length - gram + 1)
    start = np.flatnonzero(within)
    own = at[start]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.concatenate((new, [len(start)])))
    return start[new], count, own[new], codes[own[new]]


def ranked(text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each suffix (by where it starts in `text`) in the order of its first `length` bytes, equal ones
    having one rank; and each rank's common prefix with the rank before."""
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    # a rolling hash guesses which are equal, so that each is sorted once; the bytes are then compared
    _, shown, which = np.unique(K.rolling_codes(K.BYTE_CODES[text], length)[start], return_index=True, return_inverse=True)
    rows = np.ascontiguousarray(view[start[shown]])
    if not (view[start] == rows[which]).all():
        which, rows = np.arange(len(start)), np.ascontiguousarray(view[start])
    order = np.argsort(rows.view(f"V{length}").ravel(), kind="stable")
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(1), length, same.argmin(1))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(common < length)))
    return rank[which], np.concatenate(([0], common[common < length]))


def nearest_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry, the length of its common prefix with the nearest entry before it that has a smaller place (0:
    none). common: the common prefix of each entry with the one before. All entries climb at once: whoever stands
    between an entry and the one it looks at has a larger place than the entry."""
    at, common = np.arange(len(place)) - 1, common.copy()
    common[:1] = 0
    live = np.arange(1, len(place))
    while len(live):
        live = live[(place[at[live]] > place[live]) & (common[live] > 0)]
        up = at[live]
        common[live], at[live] = np.minimum(common[live], common[up]), at[up]
        out = at[live] < 0
        common[live[out]] = 0
        live = live[~out]
    return common


def factors(rank: np.ndarray, common: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix (its rank and its place in the corpus) the length of its longest previous factor, and of its
    longest later one, both cut at `length`. Of equal suffixes, the first in place takes the nearest rank before or
    after that has a smaller place; the others match the one before them."""
    back = np.concatenate(([0], common[:0:-1]))
    found = []
    for p in (place, -place):
        least = np.full(len(common), np.iinfo(np.int64).max)
        np.minimum.at(least, rank, p)
        longest = np.maximum(nearest_smaller(least, common), nearest_smaller(least[::-1], back)[::-1])
        found.append(np.where(p == least[rank], longest[rank], length))
    return found[0], found[1]


SPANS = "doc_id long, start int, end int, earlier boolean"


def span_batch(doc: np.ndarray, position: np.ndarray, earlier: np.ndarray, length: int) -> pa.RecordBatch | None:
    """Runs of matched suffixes of one document as spans of bytes, apart for those with and without an earlier match."""
    if not len(doc):
        return None
    order = np.lexsort((position, doc))
    doc, position, earlier = doc[order], position[order], earlier[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (position[1:] != position[:-1] + 1) | (earlier[1:] != earlier[:-1])))
    last = np.concatenate((new[1:], [True]))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[new]), pa.array(position[new].astype(np.int32)), pa.array((position[last] + length).astype(np.int32)), pa.array(earlier[new])], ["doc_id", "start", "end", "earlier"]
    )


#: A distinct piece is two rows, one with its places (n > 0) and one with its bytes, or one row with both.
DEALT = "key long, a long, b long, n long, count int, doc_id long, begin int, last_doc long, last_begin int, piece binary"


def matched_spans(rows: list[pa.RecordBatch], length: int) -> pa.RecordBatch | None:
    """Whole keys of DEALT rows, sorted by (key, a, b) -> the matched spans of first and last places."""
    table = pa.Table.from_batches(rows).combine_chunks()
    has_piece = table.column("piece").is_valid().to_numpy()
    buf, where = K.flat(table.column("piece"))
    key, a, b, n, count, doc, begin, last_doc, last_begin = (table.column(c).to_numpy() for c in ("key", "a", "b", "n", "count", "doc_id", "begin", "last_doc", "last_begin"))
    group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) - 1
    places, text = (np.full(group[-1] + 1, -1) for _ in range(2))
    places[group[n > 0]] = np.flatnonzero(n > 0)
    text[group[has_piece]] = np.flatnonzero(has_piece)
    known = (places >= 0) & (text >= 0)  # bytes that a filter let through in error have no places
    places, text = places[known], text[known]
    if not len(places):
        return None
    count = count[places].astype(np.int64)
    piece = np.repeat(np.arange(len(places)), count)
    offset = K.ragged(np.zeros(len(places), np.int64), count)
    rank, common = ranked(buf, where[text][piece] + offset, length)
    # every suffix stands at its piece's first place and, where there are several, at its last place
    more = n[places][piece] > 1
    rank = np.concatenate((rank, rank[more]))
    doc = np.concatenate((doc[places][piece], last_doc[places][piece][more]))
    position = np.concatenate((begin[places][piece] + offset, last_begin[places][piece][more] + offset[more]))
    place = np.empty(len(doc), np.int64)
    place[np.lexsort((position, doc))] = np.arange(len(doc))
    previous, later = factors(rank, common, place, length)
    hit = (previous >= length) | (later >= length)
    return span_batch(doc[hit], position[hit], previous[hit] >= length, length)


def ordered_pieces(length: int):
    """DEALT rows sorted by (key, a, b) -> spans; whole keys are ordered together, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        suffixes = 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            count = batch.column("count").to_numpy()
            i = 0
            while i < len(key):
                room = BATCH_SUFFIXES - suffixes
                j = max(i + 1, int(np.searchsorted(np.cumsum(count[i:]), room, "right")) + i)
                if j < len(key):  # to where a key ends
                    ends = np.flatnonzero(key[j:] != key[j - 1])
                    j = j + int(ends[0]) if len(ends) else len(key)
                ready = j < len(key)
                held.append(batch.slice(i, j - i))
                suffixes += int(count[i:j].sum())
                if ready:
                    if (out := matched_spans(held, length)) is not None:
                        yield out
                    held, suffixes = [], 0
                i = j
        if held and (out := matched_spans(held, length)) is not None:
            yield out

    return run


def anchor_rows(length: int, gram: int):
    """(text, sha) -> (code, unit) of every anchor; the unit tells apart places in distinct texts."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            shas = K.flat(batch.column("sha"))
            shas = shas[0][shas[1][0] : shas[1][-1]].reshape(-1, 64)
            for i, j, buf, where in K.text_slices(batch.column("text")):
                _, _, at, code = anchor_runs(buf, where, length, gram)
                if len(at):
                    row = np.searchsorted(where, at, "right") - 1
                    own = np.ascontiguousarray(shas[i:j, :16]).view(np.uint64)
                    unit = K.joint(K.joint(own[:, 0], own[:, 1])[row], (at - where[row]).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(code)), pa.array(K.signed(unit))], ["code", "unit"])

    return run


def candidate_runs(length: int, gram: int, reps, some):
    """Batches of (doc_id, text) -> for each slice (bytes, start, doc, begin, count, code, digests) of the runs of
    representatives with a repeated anchor."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            chosen = sketches.contains(reps.value, ids.view(np.uint64))
            for i, j, buf, where in K.text_slices(batch.column("text")):
                start, count, _, code = anchor_runs(buf, where, length, gram)
                row = np.searchsorted(where, start, "right") - 1
                use = chosen[i:j][row] if len(row) else np.zeros(0, bool)
                use[use] = sketches.contains(some.value, code[use])
                if use.any():
                    start, count, code, row = start[use], count[use], code[use], row[use]
                    yield buf, start, ids[i:j][row], (start - where[row]).astype(np.int32), count.astype(np.int32), code, digests(buf.tobytes(), start, start + count + length - 1)

    return run


def place_key(a: Column, place: str) -> Column:
    """What a filter of places holds: half a digest, which is random, with the place mixed in."""
    return a.bitwiseXOR(F.col(f"{place}.doc_id")).bitwiseXOR(F.shiftleft(F.col(f"{place}.begin").cast("long"), 20)).alias("key")


def place_keys(a: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return (a ^ doc ^ (begin.astype(np.int64) << 20)).view(np.uint64)


def distinct(rows: DataFrame, *keys: str, also: tuple = ()) -> DataFrame:
    """One row for each digest: its first and last place and how many there are."""
    place = F.struct("doc_id", "begin")
    return rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.first("count").alias("count"), *also)


def between(rows: DataFrame, groups: DataFrame, length: int) -> DataFrame:
    """Spans of the copies between the first and the last one. Both sides are written tables, so that adaptive
    execution can split the rows of a piece that very many documents share."""
    many = groups.filter("n > 2").select("a", "b", "first", "last")
    place = F.struct("doc_id", "begin")
    inner = rows.join(many.hint("merge"), ["a", "b"]).filter((place != F.col("first")) & (place != F.col("last")))
    return inner.select("doc_id", F.col("begin").alias("start"), (F.col("begin") + F.col("count") + (length - 1)).alias("end"), F.lit(True).alias("earlier"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, often: int = OFTEN, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, start, end, earlier): bytes covered by strings of `length` bytes that start elsewhere too; earlier:
    also at an earlier place (a smaller id, or before in the document). Spans may overlap. Copies of whole texts have
    one span over all (end null)."""
    texts = text_of(docs).filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    share = texts.sparkSession.sparkContext.broadcast
    chosen = copies.representatives(docs, length)
    reps = share(copies.filter_of(chosen, "kept", bits))
    counts = copies.addressed(docs, length).select("text", "sha").mapInArrow(anchor_rows(length, gram), "code long, unit long")
    counts = counts.groupBy("code").agg(F.min("unit").alias("u"), F.max("unit").alias("v")).filter("u <> v").select("code")
    some = share(copies.filter_of(written(counts, "repeated-anchors"), "code", bits))
    runs = candidate_runs(length, gram, reps, some)

    def piece_rows(batches):
        for _, _, doc, begin, count, code, sha in runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (K.signed(code), sha[:, 0], sha[:, 1], doc, begin, count)], ["anchor", "a", "b", "doc_id", "begin", "count"])

    rows = written(texts.mapInArrow(piece_rows, "anchor long, a long, b long, doc_id long, begin int, count int"), "pieces")
    groups = written(distinct(rows, "anchor", "a", "b"), "distinct-pieces")
    totals = groups.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("n").alias("t")).filter("t > 1").select("anchor", "m")
    totals = written(totals, "anchors-of-several")
    frequent = share(copies.filter_of(totals.filter(F.col("m") > often), "anchor", bits))
    groups = groups.join(totals.hint("merge"), "anchor").drop("m")

    def marked(batches):
        """With the column `cut`: what the filter says, right or in error, as it does to the tasks that send bytes."""
        for batch in batches:
            yield batch.append_column("cut", pa.array(sketches.contains(frequent.value, batch.column("anchor").to_numpy().view(np.uint64))))

    kinds = ", ".join(f"{c} {kind}" for c, kind in groups.dtypes)
    groups = written(groups.mapInArrow(marked, f"{kinds}, cut boolean"), "pieces-to-order")
    a = F.col("a")
    wanted = share(copies.filter_of(groups.select(place_key(a, "first")).union(groups.filter("cut and n > 1").select(place_key(a, "last"))), "key", bits))

    def sent_rows(batches):
        """Bytes of the wanted places: pieces, or suffixes of the frequent anchors' pieces."""
        for buf, start, doc, begin, count, code, sha in runs(batches):
            use = sketches.contains(wanted.value, place_keys(sha[:, 0], doc, begin))
            cut = sketches.contains(frequent.value, code)
            for fine, own in ((False, use & ~cut), (True, use & cut)):
                if not own.any():
                    continue
                s, d, p, c, k, h = start[own], doc[own], begin[own], count[own], K.signed(code[own]), sha[own]
                if fine:
                    s, d, p, k = K.ragged(s, c), np.repeat(d, c), K.ragged(p.astype(np.int64), c).astype(np.int32), np.repeat(k, c)
                    c = np.ones(len(s), np.int32)
                    h = digests(buf.tobytes(), s, s + length)
                size = c + length - 1
                data, offsets = buf[K.ragged(s, size)], np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                piece = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), fine)), *(pa.array(x) for x in (k, h[:, 0], h[:, 1], d, p, c)), piece], ["fine", "anchor", "a", "b", "doc_id", "begin", "count", "piece"])

    sent = written(texts.mapInArrow(sent_rows, "fine boolean, anchor long, a long, b long, doc_id long, begin int, count int, piece binary"), "pieces-sent")
    suffixes = sent.filter("fine").select("a", "b", "doc_id", "begin", "count", "piece")
    fine = written(distinct(suffixes, "a", "b", also=(F.first("piece").alias("piece"),)), "distinct-suffixes")
    places = ("first.doc_id", "first.begin", F.col("last.doc_id").alias("last_doc"), F.col("last.begin").alias("last_begin"))
    none = lambda kind: F.lit(None).cast(kind)
    dealt = groups.filter("not cut").select(F.col("anchor").alias("key"), "a", "b", "n", "count", *places, none("binary").alias("piece"))
    dealt = dealt.union(sent.filter("not fine").select("anchor", "a", "b", F.lit(0).cast("long"), "count", none("long"), none("int"), none("long"), none("int"), "piece"))
    dealt = dealt.union(fine.select("a", "a", "b", "n", "count", *places, "piece"))
    dealt = dealt.select(*(F.coalesce(c, F.lit(0)).alias(c) if c in ("doc_id", "begin", "last_doc", "last_begin") else c for c in dealt.columns))
    out = dealt.repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(ordered_pieces(length), SPANS)
    out = out.unionByName(between(rows, groups, length)).unionByName(between(suffixes, fine, length))
    whole = copies.all_copies(docs, chosen, length)
    return out.unionByName(whole.select("doc_id", F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"), (F.col("doc_id") > F.col("kept")).alias("earlier")))


def with_spans(docs: DataFrame, spans: DataFrame, keep_first: bool) -> DataFrame:
    """(doc_id, text, spans) of every row of the input."""
    chosen = spans.filter("earlier") if keep_first else spans
    by_doc = chosen.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return text_of(docs).join(by_doc.hint("shuffle_hash"), "doc_id", "left")


def _kept(batches: Iterator[pa.RecordBatch]):
    """(ids, bytes, removed, runs removed, kept bytes) by row."""
    for batch in batches:
        data, where = K.flat(batch.column("text"))
        spans = batch.column("spans")
        n, gone, runs, kept = [], [], [], []
        bounds, values = spans.offsets.to_numpy(), spans.values
        start, end = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        valid = spans.is_valid().to_numpy(zero_copy_only=False)
        for r in range(batch.num_rows):
            text = data[where[r] : where[r + 1]]
            n.append(len(text))
            a, b = bounds[r], bounds[r + 1]
            if not valid[r] or a == b:
                gone.append(0), runs.append(0), kept.append(text.tobytes())
                continue
            e = np.nan_to_num(end[a:b].astype(float), nan=len(text)).astype(np.int64)
            x, y = merged_runs(start[a:b].astype(np.int64), e)
            gone.append(int((y - x).sum())), runs.append(len(x))
            raw = text.tobytes()
            edges = [0, *np.stack((x, y), 1).ravel().tolist(), len(raw)]
            kept.append(b"".join([raw[p:q] for p, q in zip(edges[::2], edges[1::2])]))
        yield batch.column("doc_id"), n, gone, runs, kept


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """(doc_id, kept binary): the bytes of every text without repeats; the first copy stays unless keep_first is False."""

    def run(batches):
        for ids, _, _, _, kept in _kept(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary())], ["doc_id", "kept"])

    work = lambda rows, _: with_spans(rows, repeated_spans(rows, length), keep_first).mapInArrow(run, "doc_id long, kept binary")
    return copies.by_number(docs, work)


def repeat_digests(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): what without_repeats() keeps, as digests."""

    def run(batches):
        for ids, n, gone, runs, kept in _kept(batches):
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return copies.by_number(docs, lambda rows, _: with_spans(rows, repeated_spans(rows, length), keep_first).mapInArrow(run, schema))
