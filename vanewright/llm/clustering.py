"""Centroid clustering (Lloyd's rounds, exact in integers) with geometric drift tightening.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to all others.
While the upper one is less, its cluster can't change and no distance is taken. When centroids move, the upper bound
grows by its centroid's drift. The lower bound need not fall by the largest drift of the others: all members of a
cluster lie in a sphere around its old centroid, and for x in that sphere

    d(x, from) - d(x, to) <= |to - from| * cos(angle at the midpoint of the move between x and the move),

as the points where the difference is as much as 2a lie inside a hyperbola's branch, and so between its asymptotes. The least such angle over a
sphere is found in the plane of its centre and the move: the centre's angle less what the sphere spans, seen from the
midpoint. A sphere beside or behind the move loses little or nothing.

Vectors whose bounds don't settle them (ties included) are first held against their own centroid, then scanned against
all, in exact integer arithmetic; bounds carry a margin for rounding. Vectors are packed in blocks; a round's bounds are
written as a table bucketed by block like the vectors themselves, so that rounds join them without a shuffle. What comes to the driver
are centroids, counts and radii: k rows of a fixed size.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out;
components count as at most LIMIT in size, so that squared distances fit in 64 bits; ties go to the smaller cluster
number; repeated rows are vectors of their own; a null id is a vector like others but no starting centroid; starting vectors of one id
stand in the order of their components; with fewer vectors than clusters there are as many clusters as vectors with an id (with none,
an empty result); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bucketed
from .tables import written

K_CLUSTERS, ROUNDS, DIMENSIONS, SEED, SCALE = 8, 10, 64, 3, 1024
#: Vectors of a block, and blocks of a bucket (one task).
BLOCK, BUCKET_BLOCKS = 1024, 64
#: The largest component that counts: with it, squared distances of 64 components stay below 2^63.
LIMIT = 1 << 27
#: Up to this size, doubles hold all products and sums of 64 components exactly.
EXACT = 1 << 22
#: Relative and absolute margin of bounds, far above the rounding of single and double precision.
MARGIN, LEAST_MARGIN = 1e-6, 1e-6


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors (rows) to centroids (columns)."""
    if not len(x):
        return np.zeros((0, len(centroids)), np.int64)
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centroids], 1)


def tightened_loss(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer each moved centroid (columns) can have come to any point of each cluster's sphere (rows: around
    its old centroid); never more than the centroid's drift."""
    out = np.zeros((len(old), len(old)))
    for j, (start, end) in enumerate(zip(old.astype(np.float64), new.astype(np.float64))):
        drift = np.linalg.norm(end - start)
        if not drift:
            continue
        from_middle = old - (start + end) / 2
        reach = np.linalg.norm(from_middle, axis=1)
        along = from_middle @ (end - start) / drift
        angle = np.arctan2(np.sqrt(np.maximum(reach**2 - along**2, 0)), along)
        spans = np.arcsin(np.minimum(radius / np.maximum(reach, LEAST_MARGIN), 1))
        least = np.where(radius >= reach, 0, np.maximum(angle - spans, 0))
        out[:, j] = np.minimum(drift * (np.maximum(np.cos(least), 0) + MARGIN), drift * (1 + MARGIN))
    return out


@dataclass
class Move:
    """Centroids of a round, and how bounds of each cluster's members change on the way to them."""

    centroids: np.ndarray
    drift: np.ndarray
    loss: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
        others = tightened_loss(old, new, radius)
        np.fill_diagonal(others, 0)
        return cls(new, np.linalg.norm((new - old).astype(np.float64), axis=1), others.max(1, initial=0))


@dataclass
class State:
    """Clusters and bounds of a block's vectors."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def unknown(cls, n: int) -> State:
        return cls(np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros(n))

    @classmethod
    def read(cls, cluster: bytes, upper: bytes, lower: bytes) -> State:
        return cls(np.frombuffer(cluster, "<i4").copy(), np.frombuffer(upper, "<f8").copy(), np.frombuffer(lower, "<f8").copy())

    def moved(self, move: Move) -> None:
        self.upper += move.drift[self.cluster] * (1 + MARGIN)
        self.lower = np.maximum(self.lower - move.loss[self.cluster], 0)

    def ambiguous(self) -> np.ndarray:
        return self.upper >= self.lower * (1 - MARGIN) - LEAST_MARGIN

    def assign(self, x: np.ndarray, centroids: np.ndarray) -> int:
        """Nearest centroids of all vectors; says how many had to be scanned."""
        open_ = np.flatnonzero(self.ambiguous())
        known = open_[self.cluster[open_] >= 0]
        own = centroids[self.cluster[known]]
        self.upper[known] = np.sqrt(((x[known].astype(np.int64) - own) ** 2).sum(1)) * (1 + MARGIN)
        scan = open_[self.ambiguous()[open_]]
        found = squared(x[scan], centroids)
        nearest = found.argmin(1) if len(scan) else np.zeros(0, np.int64)
        at = np.arange(len(scan))
        self.cluster[scan] = nearest
        self.upper[scan] = np.sqrt(found[at, nearest]) * (1 + MARGIN)
        found[at, nearest] = np.iinfo(np.int64).max
        self.lower[scan] = np.sqrt(found.min(1, initial=np.iinfo(np.int64).max)) * (1 - MARGIN)
        return len(scan)


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, embedding) of the vectors that count."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == dimensions) & finite)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int32)


def starting_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors of the least SHA-256 of `seed:vec_id`, in that order."""
    named = vectors.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    rows = named.orderBy("h", "embedding").limit(k).collect()  # k rows
    return np.stack([integers(np.array(r["embedding"], np.float64), scale) for r in rows]).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def pack(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK vectors: (ids, kind, x), x in the smallest integers that hold it."""
    for batch in batches:
        flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
        for i in range(0, len(flat), BLOCK):
            x = integers(flat[i : i + BLOCK], scale)
            kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4"
            ids = batch.column("vec_id")[i : i + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())], ["ids", "kind", "x"])


STATE_SCHEMA = "block long, cluster binary, upper binary, lower binary, moved long, scanned long, counts binary, sums binary, radius binary"


def blocks_of(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[dict, np.ndarray, State]]:
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["x"], row["kind"]).reshape(-1, dimensions).astype(np.int32)
            yield row, x, State.read(row["cluster"], row["upper"], row["lower"]) if row.get("cluster") is not None else State.unknown(len(x))


def round_rows(batches: Iterator[pa.RecordBatch], move: Move, dimensions: int) -> Iterator[pa.RecordBatch]:
    """Assign all vectors of each block; sums and counts are changes since the last round."""
    k = len(move.centroids)
    for row, x, state in blocks_of(batches, dimensions):
        before = state.cluster.copy()
        if before[0] >= 0:
            state.moved(move)
        scanned = state.assign(x, move.centroids)
        changed = np.flatnonzero(before != state.cluster)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for clusters, sign in ((state.cluster[changed], 1), (before[changed], -1)):
            some = clusters >= 0
            np.add.at(counts, clusters[some], sign)
            np.add.at(sums, clusters[some], sign * x[changed][some].astype(np.int64))
        radius = np.zeros(k)
        np.maximum.at(radius, state.cluster, state.upper)
        values = [row["block"], state.cluster.astype("<i4").tobytes(), state.upper.tobytes(), state.lower.tobytes(), len(changed), scanned, counts.tobytes(), sums.tobytes(), radius.tobytes()]
        names = ["block", "cluster", "upper", "lower", "moved", "scanned", "counts", "sums", "radius"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)


def partial_rows(batches: Iterator[pa.RecordBatch], k: int, dimensions: int) -> Iterator[pa.RecordBatch]:
    """One task's sums, a row a cluster: its radius, and values of which the first `dimensions` are sums, then the count,
    and (in the first cluster's row) how many vectors moved and were scanned."""
    sums, radius = np.zeros((k, dimensions + 3), np.int64), np.zeros(k)
    for batch in batches:
        for row in batch.to_pylist():
            sums[:, :dimensions] += np.frombuffer(row["sums"], np.int64).reshape(k, dimensions)
            sums[:, dimensions] += np.frombuffer(row["counts"], np.int64)
            sums[0, dimensions + 1 :] += row["moved"], row["scanned"]
            radius = np.maximum(radius, np.frombuffer(row["radius"], np.float64))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(radius), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "radius", "sums"])


class Totals:
    """Exact sums and counts of clusters on the driver: k rows of sums."""

    def __init__(self, k: int, dimensions: int):
        self.k, self.dimensions = k, dimensions
        self.counts, self.sums = [0] * k, [[0] * dimensions for _ in range(k)]

    def add(self, state: DataFrame) -> tuple[np.ndarray, int, int]:
        """Take a round's changes; returns its radii, and how many vectors moved and were scanned."""
        k, d = self.k, self.dimensions
        partial = state.select("counts", "sums", "radius", "moved", "scanned").mapInArrow(lambda b: partial_rows(b, k, d), "cluster int, radius double, sums array<long>")
        values = partial.select("cluster", "radius", F.posexplode("sums").alias("at", "value"))
        rows = values.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.max("radius").alias("radius")).collect()
        radius, moved, scanned = np.zeros(k), 0, 0
        for c, at, value, most in rows:
            radius[c] = most
            if at < d:
                self.sums[c][at] += int(value)
            elif at == d:
                self.counts[c] += int(value)
            elif at == d + 1:
                moved += int(value)
            else:
                scanned += int(value)
        return radius, moved, scanned

    def means(self, centroids: np.ndarray) -> np.ndarray:
        """Floors of the means; empty clusters stay where they are."""
        return np.array([[s // n for s in sums] if n else c.tolist() for sums, n, c in zip(self.sums, self.counts, centroids)], np.int64)


@dataclass
class Clustering:
    """What clustering() returns: (vec_id, cluster, distance) rows, centroids in order, and vectors scanned in each
    round (the first scans all)."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def distance_rows(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dimensions: int) -> Iterator[pa.RecordBatch]:
    for row, x, state in blocks_of(batches, dimensions):
        distance = ((x.astype(np.int64) - centroids[state.cluster]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(state.cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])


def clustering(vectors: DataFrame, k: int = K_CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, scale: int = SCALE) -> Clustering:
    """Cluster (vec_id, embedding) rows: so many rounds of assigning and moving, then one more assignment."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions)
    centroids = starting_centroids(kept, k, seed, scale)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, [])
    k = len(centroids)
    packed = written(kept.mapInArrow(lambda b: pack(b, dimensions, scale), "ids array<long>, kind string, x binary"), "vector-blocks")
    n = packed.count()
    buckets = max(-(-n // BUCKET_BLOCKS), min(n, spark.sparkContext.defaultParallelism))
    numbered = packed.withColumn("block", F.monotonically_increasing_id())
    blocks = bucketed(numbered.repartition(buckets, "block"), "vectors", "block", buckets)
    totals, scanned, state = Totals(k, dimensions), [], None
    move = Move(centroids, np.zeros(k), np.zeros(k))
    for r in range(rounds + 1):
        had = blocks.select("block", "kind", "x")
        if state is not None:
            had = had.join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block")
        state = bucketed(had.mapInArrow(lambda b, m=move: round_rows(b, m, dimensions), STATE_SCHEMA), "cluster-bounds", "block", buckets)
        radius, moved, scans = totals.add(state)
        scanned.append(scans)
        if r == rounds:
            break
        new = totals.means(move.centroids)
        if (new == move.centroids).all():
            break  # nothing moves any more
        move = Move.between(move.centroids, new, radius)
    final = blocks.select("block", "ids", "kind", "x").join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block")
    rows = written(final.mapInArrow(lambda b: distance_rows(b, move.centroids, dimensions), "vec_id long, cluster int, distance long"), "clustered-vectors")
    return Clustering(rows, move.centroids, scanned)


def cluster_digests(vectors: DataFrame, k: int = K_CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    done = clustering(vectors, k, rounds, dimensions, seed, scale)
    spark = vectors.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in done.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    about = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(done.centroids.tolist())]
    clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.rows.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
