"""Prefix trie of conversations by truncation peeling.

A conversation is its turns in order, each turn a code of fixed size (SHA-256 of role and text, and the text's bytes),
so a prefix of so many turns is a prefix of bytes. Conversations of equal turns are one row, with their number and
least id. Rows are dealt to ranges of paths and sorted, which puts the members of every node side by side.

A chunk of sorted rows is peeled from its greatest depth up: at depth d the rows that end there join what survives from
d + 1, neighbours that agree in their first d turns are one node, and node counts, least members, children, leaves and
saved tokens are added up from what was merged. That finds the nodes and their totals in the same pass. Only nodes on
the paths of a chunk's first and last row can have members in other chunks. They are not finished: what was added up for
them so far is kept by depth in two rows, one for each of these paths, and the next round peels those rows in the same
way, until one chunk is left. Rounds so shrink by thousands, whatever the depth, and no task holds more than a chunk; a
first turn that a third of all conversations share costs no more than others.

Ids that end at a node are hashed in ascending order from sorted runs that were joined to long pieces beforehand, as a stream.

Defined results: a null role or text is an empty one; rows with a null conv_id are left out; turns are ordered by number,
null first, then by the SHA-256 of their role and text, and equal rows are each a turn; an empty table gives an empty result; a conversation's turns
(CODE bytes each) lie in one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Bytes of a turn's code: 16 of its digest, 4 of its text's length.
CODE = 20
#: Conversations of one family share turns of its first; at most HEAD - 1 of them.
FAMILY, HEAD = 5, 9
#: Rows of a chunk (or CHUNK_BYTES of paths, but LEAST_ROWS rows at least), and chunks of a range.
CHUNK, CHUNK_BYTES, LEAST_ROWS, RANGE_CHUNKS = 4096, 16 << 20, 16, 8
#: Ids of a piece that is joined before hashing.
PIECE = 20_000


def turn_code(role: Column, text: Column) -> Column:
    """40 hexadecimal digits: the digest of role and text, and the text's bytes."""
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 2 * CODE - 8), F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"))


def turns_by_conversation(turns: DataFrame) -> DataFrame:
    """(conv_id, codes): the codes of a conversation's turns in order."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    coded = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), turn_code(text("role"), text("text")).alias("code")).alias("t"))
    # sort_array puts null turns first
    return coded.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["code"]).alias("codes"))


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """(conv_id, path): a conversation's first h turns are those of its family's first, h being the CRC-32 of its id
    modulo `head`; the path is all codes in order."""
    own = written(turns_by_conversation(turns), "conversations")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head)).cast("int")
    ask = own.select("conv_id", "codes", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first"))
    heads = own.select(F.col("conv_id").alias("first"), F.slice("codes", 1, head - 1).alias("head"))
    met = ask.join(heads.hint("merge"), "first", "left")
    turned = F.coalesce("head", F.expr("cast(array() as array<string>)"))
    path = F.concat(F.slice(turned, F.lit(1), F.col("h")), F.slice("codes", F.col("h") + 1, F.size("codes")))
    return written(met.select("conv_id", F.unhex(F.array_join(path, "")).alias("path")), "conversation-paths")


#: What is added up at a node: conversations that end there and the least of them, members, their least, and of its
#: finished children the number, leaves and saved tokens.
VALUES = ("ends", "end_id", "members", "least", "children", "leaves", "saved")
LEAST = ("end_id", "least")
NONE = np.iinfo(np.int64).max
#: A path and what is to be added at its prefixes of `low` turns and more; or a finished node (its path null).
ROW_COLUMNS = ("path", "low", *VALUES)
ROW_SCHEMA = "path binary, low int, " + ", ".join(f"{v} array<long>" for v in VALUES)
#: A node's key is there where several conversations end at it or others ask for it; its parent's where that wasn't finished.
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "node_ends", "node_end_id")
NODE_SCHEMA = ", ".join(f"{c} long" for c in NODE_COLUMNS) + ", key binary, parent_key binary"


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // CODE
    differ = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(differ.argmax()) // CODE


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of every 1, 2, 4, ... consecutive values."""
    out, step = [values], 1
    while 2 * step <= len(values):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


def least_between(minima: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum over places a+1 .. b (a < b), for each pair."""
    level = np.frexp(b - a)[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(minima[k][a[at] + 1], minima[k][b[at] - (1 << k) + 1])
    return out


class Chunk:
    """Sorted distinct paths, and what is to be added at their prefixes; peeled from the greatest depth to the root."""

    def __init__(self, paths: list[bytes], low: list[int], values: dict[str, np.ndarray], final: bool, known: bool):
        """final: no other chunk has members of these nodes; known: the nodes have a key that others ask for."""
        self.paths, self.low, self.values, self.final, self.known = paths, np.array(low, np.int64), values, final, known
        self.size = np.array([len(p) // CODE for p in paths], np.int64)
        self.common = np.array([0] + [common_turns(a, b) for a, b in zip(paths, paths[1:])], np.int64)
        self.begin = np.cumsum(self.size - self.low + 1) - (self.size - self.low + 1)
        self.last = len(paths) - 1
        self.shared = int(self.common[1:].min()) if self.last else int(self.size[0])
        self._keys: dict[int, list[bytes]] = {}
        #: finished nodes column by column, and unfinished ones by (row, depth)
        self.nodes: list[tuple] = []
        self.open: dict[tuple[int, int], list[int]] = {}

    def key(self, row: int, depth: int) -> bytes:
        """SHA-256 of the first `depth` turns of a row's path."""
        if not self.known and depth == self.size[row]:
            return hashlib.sha256(self.paths[row]).digest()
        if row not in self._keys:
            running = hashlib.sha256()
            self._keys[row] = [running.digest()]
            for i in range(0, len(self.paths[row]), CODE):
                running.update(self.paths[row][i : i + CODE])
                self._keys[row].append(running.copy().digest())
        return self._keys[row][depth]

    def text_bytes(self, row: int, depth: int) -> int:
        return int.from_bytes(self.paths[row][CODE * depth - 4 : CODE * depth]) if depth else 0

    def peel(self) -> None:
        size, minima = self.size, range_minima(self.common)
        by_size = np.argsort(size, kind="stable")
        from_size = np.searchsorted(size[by_size], np.arange(int(size.max()) + 2))
        # the runs of rows that survive from the depth below: their first rows, and what they hand to the node above
        start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
        up = {v: start for v in VALUES}
        waiting: tuple | None = None
        for depth in range(int(size.max()), -1, -1):
            ended = np.sort(by_size[from_size[depth] : from_size[depth + 1]])
            row = np.concatenate((start, ended))
            order = np.argsort(row, kind="stable")
            survives = order < len(start)
            row, stop = row[order], np.concatenate((end, ended + 1))[order]
            new = np.ones(len(row), bool)
            new[1:] = least_between(minima, row[:-1], row[1:]) < depth
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            above = node[survives]
            holders = np.flatnonzero((size >= depth) & (self.low <= depth))
            at = node[np.searchsorted(row, holders, "right") - 1]
            place = self.begin[holders] + depth - self.low[holders]
            total = {}
            for v in VALUES:
                add = np.minimum if v in LEAST else np.add
                total[v] = np.full(len(first), NONE if v in LEAST else 0, np.int64)
                add.at(total[v], at, self.values[v][place])
                add.at(total[v], above, up[v])
            start, end = row[first], np.maximum.reduceat(stop, first)
            owner = self.owners(start, end, depth)
            self.finish(waiting, depth, total, owner, above)
            up, waiting = self.handed(depth, start, total, owner)
        self.finish(waiting, -1, None, None, np.zeros(1, np.int64))

    def owners(self, start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """The boundary row on whose path an unfinished node lies (the last where it lies on both); -1: finished."""
        owner = np.full(len(start), -1, np.int64)
        if not self.final:
            owner[start == 0] = 0
            owner[end == self.last + 1] = self.last
        return owner

    def handed(self, depth: int, start: np.ndarray, total: dict[str, np.ndarray], owner: np.ndarray) -> tuple[dict, tuple]:
        """What finished nodes hand up; and those nodes, which wait for their parent's least member."""
        for i in np.flatnonzero(owner >= 0).tolist():
            self.open[int(owner[i]), depth] = [int(total[v][i]) for v in VALUES]
        done = owner < 0
        n = total["members"]
        leaves = np.where(total["children"] == 0, 1, total["leaves"])
        saved = total["saved"].copy()
        for i in np.flatnonzero(done & (n > 1)).tolist():
            saved[i] += (int(n[i]) - 1) * self.text_bytes(int(start[i]), depth)
        zero = np.zeros(len(n), np.int64)
        none = zero + NONE
        up = {"ends": zero, "end_id": none, "members": np.where(done, n, 0), "least": np.where(done, total["least"], NONE), "children": done.astype(np.int64), "leaves": np.where(done, leaves, 0), "saved": np.where(done, saved, 0)}
        return up, (done, start, total, leaves, saved)

    def finish(self, waiting: tuple | None, depth: int, parents: dict | None, owner: np.ndarray | None, above: np.ndarray) -> None:
        """Put down the finished nodes of depth + 1, now that their parents (`above`, by number) are known."""
        if waiting is None:
            return
        done, start, total, leaves, saved = waiting
        which = np.flatnonzero(done)
        if not len(which):
            return
        parent = np.full(len(which), NONE, np.int64)
        parent_keys: list[bytes | None] = [None] * len(which)
        if parents is not None:
            own = above[which]
            parent = np.where(owner[own] < 0, parents["least"][own], NONE)
            parent_keys = [self.key(o, depth) if o >= 0 else None for o in owner[own].tolist()]
        wanted = np.ones(len(which), bool) if self.known else total["ends"][which] > 1
        keys = [self.key(r, depth + 1) if w else None for r, w in zip(start[which].tolist(), wanted.tolist())]
        columns = (total["least"], None, None, total["members"], total["children"], leaves, saved, total["ends"], total["end_id"])
        given = [c[which] if c is not None else None for c in columns]
        given[1], given[2] = np.full(len(which), depth + 1, np.int64), parent
        self.nodes.append((given, keys, parent_keys))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Finished nodes, then a row for each boundary path that has unfinished ones."""
        names = [*NODE_COLUMNS, "key", "parent_key", *ROW_COLUMNS]
        kinds = [pa.int64()] * len(NODE_COLUMNS) + [pa.binary(), pa.binary(), pa.binary(), pa.int32()] + [pa.list_(pa.int64())] * len(VALUES)
        if self.nodes:
            columns = [np.concatenate(c) for c in zip(*(given for given, _, _ in self.nodes))]
            arrays = [pa.array(c, mask=c == NONE) for c in columns]
            arrays += [pa.array([k for part in self.nodes for k in part[which]], pa.binary()) for which in (1, 2)]
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays(arrays + [pa.nulls(n, t) for t in kinds[len(arrays) :]], names)
        rows = []
        for r, low in ((0, self.shared + 1), (self.last, 0)) if self.last else ((0, 0),):
            if not self.final and low <= self.size[r]:
                held = [self.open[r, d] for d in range(low, int(self.size[r]) + 1)]
                rows.append([self.paths[r], low, *([h[i] for h in held] for i in range(len(VALUES)))])
        if rows:
            given = [pa.array(c, t) for c, t in zip(zip(*rows), kinds[len(NODE_COLUMNS) + 2 :])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for t in kinds[: len(NODE_COLUMNS) + 2]] + given, names)


def peeled(batches: Iterator[pa.RecordBatch], final: bool, known: bool, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Sorted rows, chunk by chunk."""
    paths, low, values, held = [], [], {v: [] for v in VALUES}, 0

    def chunk():
        made = Chunk(paths, low, {v: np.concatenate(x) for v, x in values.items()}, final, known)
        made.peel()
        return made.batches()

    for batch in batches:
        lists = {v: batch.column(v) for v in VALUES}
        flat = {v: (a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)) for v, a in lists.items()}
        for i, (path, least) in enumerate(zip(batch.column("path").to_pylist(), batch.column("low").to_pylist())):
            if not final and (len(paths) >= most or held > CHUNK_BYTES and len(paths) >= LEAST_ROWS):
                yield from chunk()
                paths, low, values, held = [], [], {v: [] for v in VALUES}, 0
            paths.append(path)
            low.append(least)
            held += len(path)
            for v, (bounds, every) in flat.items():
                values[v].append(every[bounds[i] : bounds[i + 1]])
    if paths:
        yield from chunk()


def peel_rounds(rows: DataFrame, chunk: int = CHUNK) -> list[DataFrame]:
    """Peel rows (ROW_SCHEMA) round by round; each round's finished nodes. A chunk leaves two rows, so rounds shrink."""
    if chunk < 4:
        raise ValueError("a chunk has four rows at least")
    out: list[DataFrame] = []
    while True:
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
        if not n:
            return out
        final = n <= chunk and (size <= CHUNK_BYTES or n <= LEAST_ROWS)
        ranges = max(1, min(n // 16, max(n // (chunk * RANGE_CHUNKS), size // (CHUNK_BYTES * RANGE_CHUNKS), rows.sparkSession.sparkContext.defaultParallelism)))
        dealt = rows.repartition(1) if final else rows.repartitionByRange(ranges, "path")
        known = bool(out)
        work = lambda batches, final=final, known=known: peeled(batches, final, known, chunk)
        done = written(dealt.sortWithinPartitions("path").mapInArrow(work, f"{NODE_SCHEMA}, {ROW_SCHEMA}"), "peeled")
        out.append(done.filter("path is null").drop(*ROW_COLUMNS))
        if final:
            return out
        rows = done.filter("path is not null").select(*ROW_COLUMNS)


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv_id) -> (key, first, ids): up to PIECE ids of a key joined by commas."""
    key, ids = None, []

    def piece():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != key or len(ids) >= PIECE):
                yield piece()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield piece()


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, first) -> (key, ends_sha256)."""
    key, running = None, None

    def done():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [running.hexdigest()]})

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                running.update(b"," + ids.encode())
                continue
            if running is not None:
                yield done()
            key, running = k, hashlib.sha256(ids.encode())
    if running is not None:
        yield done()


def end_digests(ended: DataFrame) -> DataFrame:
    """(conv_id, key) -> (key, ends_sha256)."""
    pieces = ended.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined_ids, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed_ids, "key binary, ends_sha256 string")


def prefix_trie(paths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, path) -> a row for each node."""
    by_path = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("id"))
    grouped = written(by_path, "distinct-conversations")
    at_end = {"ends": "n", "end_id": "id", "members": "n", "least": "id"}
    depth = (F.octet_length("path") / CODE).cast("int").alias("low")
    rows = grouped.select("path", depth, *(F.array(F.col(at_end[v]) if v in at_end else F.lit(0).cast("long")).alias(v) for v in VALUES))
    rounds = peel_rounds(rows, chunk)
    key = lambda c: F.unhex(F.sha2(c, 256)).alias("key")
    repeated = written(paths.select("conv_id", "path").join(grouped.filter("n > 1").select("path").hint("merge"), "path", "left_semi").select("conv_id", key("path")), "ended-together")
    digests = written(end_digests(repeated), "end-digests")
    if not rounds:
        empty = grouped.sparkSession.createDataFrame([], f"{NODE_SCHEMA}")
        rounds = [empty]
    nodes = rounds[0]
    for later in rounds[1:]:
        nodes = nodes.unionByName(later)
    if len(rounds) > 1:
        unfinished = rounds[1]
        for later in rounds[2:]:
            unfinished = unfinished.unionByName(later)
        unfinished = written(unfinished.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent")), "unfinished-nodes")
        asking = written(nodes.filter("parent_key is not null"), "children-of-unfinished")
        met = asking.join(unfinished.hint("merge"), "parent_key").withColumn("parent_conv_id", F.col("of_parent")).drop("of_parent")
        nodes = nodes.filter("parent_key is null").unionByName(met)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ids = F.when(F.col("node_ends") == 1, F.col("node_end_id").cast("string")).otherwise("")
    few = nodes.filter("node_ends <= 1").select(*columns, F.sha2(ids, 256).alias("ends_sha256"))
    many = nodes.filter("node_ends > 1").join(digests.hint("merge"), "key").select(*columns, "ends_sha256")
    return few.unionByName(many)


def conversation_nodes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the
    rebuilt conversations."""
    return prefix_trie(rebuilt(turns), chunk)
