"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Each vector keeps the distance to its own centroid as an upper bound, lower bounds
for its nearest other centroids in order, and one remainder bound for all the rest.
When centroids have moved, bounds are widened by the moves; the first place from
which on every lower bound lies above the upper bound says how many centroids have
to be measured again: none, those before it, or, if there is no such place, all.
The number of bounds shrinks to what a round has needed.

Distances between integers are exact; bounds are rounded outwards, so a vector whose
order is certified by its bounds has the same centroid as under a full scan, ties
(smaller number) included.  The centroids are broadcast: ``k`` times ``dims`` numbers,
whatever the input.  Sums for each centroid are partial aggregates of whole numbers.

A row of the state is a vector with its bounds, written to the shared folder in each
round, so a lost executor costs a round's tasks at most.

Defined results: a vector that is null, of another length, with a null or non-finite
component, or beyond ``LARGEST`` once scaled (squared distances wouldn't fit a long)
has no row; repeated rows and null ids are vectors of their own, null ids are first
centroids last; of vectors with one hash the smaller is first; with fewer than ``k``
vectors each starts a centroid; an empty table gives an empty table; other columns
aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.llm.shared import Shelf

#: Largest component, once scaled.
LARGEST = 1 << 26
#: Bounds are single floats, rounded outwards by this share.
SLACK = 1e-6
#: Distances that are held at a time.
HELD = 1 << 21


@dataclass(frozen=True)
class CentroidRule:
    """``bounds`` lower bounds a vector at first (a quarter of ``k``, if not given), an eighth of ``k`` at least."""

    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    seed: str = "2:"
    bounds: int | None = None


def vectors(table: DataFrame, rule: CentroidRule, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): the vectors that count, in whole numbers."""
    x = F.col(column)
    scaled = F.transform(x, lambda y: F.floor(y.cast("double") * rule.scale))
    counts = (F.size(x) == rule.dims) & F.forall(x, lambda y: y.isNotNull() & (F.abs(y.cast("double") * rule.scale) < LARGEST))
    return table.select(F.col(key).alias("vec_id"), F.when(counts, scaled.cast("array<int>")).alias("v")).filter("v IS NOT NULL")


def first_centroids(kept: DataFrame, rule: CentroidRule) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes: ``k`` rows reach the driver."""
    ranked = kept.select("v", F.sha2(F.concat(F.lit(rule.seed), F.col("vec_id").cast("string")), 256).alias("h"))
    rows = ranked.orderBy(F.col("h").asc_nulls_last(), "v").limit(rule.k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), rule.dims)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    most = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    # products of small whole numbers are exact in doubles, and faster
    kind = np.float64 if 4 * v.shape[1] * float(most) ** 2 < 2**52 else np.int64
    a, b = v.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def above(d: np.ndarray) -> np.ndarray:
    return (np.sqrt(d.astype(np.float64)) * (1 + SLACK)).astype(np.float32)


def below(d: np.ndarray) -> np.ndarray:
    return (np.sqrt(d.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


@dataclass
class Bounds:
    """For each vector: its centroid, the upper bound, the next nearest centroids with lower bounds, the remainder bound, how many were measured again (-1: all)."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    again: np.ndarray


def scanned(v: np.ndarray, c: np.ndarray, n: int) -> Bounds:
    """Bounds from distances to all centroids, ``n`` lower ones."""
    d = squared(v, c)
    order = np.argsort(d, axis=1, kind="stable")  # of equal distances the smaller number
    ordered = np.take_along_axis(d, order, 1)
    rest = below(ordered[:, n + 1]) if n + 1 < len(c) else np.full(len(v), np.inf, np.float32)
    return Bounds(order[:, 0], above(ordered[:, 0]), order[:, 1 : n + 1], below(ordered[:, 1 : n + 1]), rest, np.full(len(v), -1))


def moved(b: Bounds, drift: np.ndarray, n: int) -> Bounds:
    """Bounds widened by what each centroid has moved, ``n`` lower ones kept; each lower bound also holds for all after it."""
    upper = ((b.upper + drift[b.own]) * (1 + SLACK)).astype(np.float32)
    lower = np.concatenate([b.lower - drift[b.near], (b.rest - drift.max(initial=0))[:, None]], axis=1) * (1 - SLACK)
    lower = np.minimum.accumulate(np.maximum(lower, 0)[:, ::-1], axis=1)[:, ::-1].astype(np.float32)
    return Bounds(b.own, upper, b.near[:, :n], lower[:, :n], lower[:, min(n, lower.shape[1] - 1)], np.zeros(len(b.own), np.int64))


def measured(v: np.ndarray, c: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to its own choice of centroids."""
    return np.stack([((v - c[numbers[:, j]]) ** 2).sum(1) for j in range(numbers.shape[1])], axis=1)


def reassigned(v: np.ndarray, c: np.ndarray, b: Bounds) -> Bounds:
    """The nearest centroid of each vector, whose bounds have been moved."""
    n = b.near.shape[1]

    def certified(rows: np.ndarray) -> np.ndarray:
        """How many of the next nearest can't be ruled out; more than ``n``: any may be nearer."""
        clear = b.upper[rows, None] < np.concatenate([b.lower[rows], b.rest[rows, None]], axis=1)
        return np.where(clear.any(1), clear.argmax(1), n + 1)

    open_ = np.flatnonzero(certified(np.arange(len(v))) > 0)
    b.upper[open_] = above(measured(v[open_], c, b.own[open_, None])[:, 0])
    needed = certified(open_)
    for z in np.unique(needed[(needed > 0) & (needed <= n)]).tolist():
        rows = open_[needed == z]
        numbers = np.concatenate([b.own[rows, None], b.near[rows, :z]], axis=1)
        d = measured(v[rows], c, numbers)
        order = np.lexsort((numbers, d), axis=1)
        numbers, d = np.take_along_axis(numbers, order, 1), np.take_along_axis(d, order, 1)
        b.own[rows], b.upper[rows], b.again[rows] = numbers[:, 0], above(d[:, 0]), z
        b.near[rows, :z], b.lower[rows, :z] = numbers[:, 1:], below(d[:, 1:])
    rows = open_[needed > n]
    if len(rows):
        new = scanned(v[rows], c, n)
        for name in ("own", "upper", "near", "lower", "rest", "again"):
            getattr(b, name)[rows] = getattr(new, name)
    return b


STATE = "v array<int>, own int, upper float, near array<int>, lower array<float>, rest float, again int, distance bigint"


def assign(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, n: int) -> DataFrame:
    """The state with every vector at its nearest centroid; without ``drift`` from a full scan of (vec_id, v)."""
    out = T.StructType([state.schema["vec_id"], *T._parse_datatype_string(STATE)])
    rows_at_a_time = max(1, HELD // max(len(centroids), 1))

    def part(batch):
        import pyarrow as pa

        def matrix(name, kind):
            flat = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind)
            return flat.reshape(batch.num_rows, -1)

        v = matrix("v", np.int64)
        if drift is None:
            b = scanned(v, centroids, n)
        else:
            one = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            b = Bounds(one("own").astype(np.int64), one("upper"), matrix("near", np.int64), matrix("lower", np.float32), one("rest"), None)
            b = moved(b, drift, n)
            b = reassigned(v, centroids, b)

        def lists(m, kind):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1), kind))

        columns = [
            batch.column("vec_id"),
            batch.column("v"),
            pa.array(b.own, pa.int32()),
            pa.array(b.upper, pa.float32()),
            lists(b.near, pa.int32()),
            lists(b.lower, pa.float32()),
            pa.array(b.rest, pa.float32()),
            pa.array(b.again, pa.int32()),
            pa.array(measured(v, centroids, b.own[:, None])[:, 0], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_a_time):
                yield part(batch.slice(at, rows_at_a_time))

    return state.mapInArrow(run, out)


def clustered(table: DataFrame, rule: CentroidRule = CentroidRule(), column: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, v, own, distance and bounds), final centroids) after ``rounds`` of assigning and moving and a last assignment."""
    shelf = Shelf(table.sparkSession)
    kept = shelf.put("vectors", vectors(table, rule, column, key))
    centroids = first_centroids(kept, rule)
    least = min(max(rule.k // 8, 1), max(len(centroids) - 1, 0))
    n = min(rule.bounds or max(rule.k // 4, 1), max(len(centroids) - 1, 0))
    state = shelf.put("centroid-state", assign(kept, centroids, None, n))
    shelf.drop("vectors")
    for _ in range(rule.rounds):
        # one row for each centroid and component
        parts = state.select("own", "again", F.posexplode("v").alias("i", "x")).groupBy("own", "i")
        sums = parts.agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).collect()
        before = centroids.copy()
        for r in sums:
            centroids[r["own"], r["i"]] = r["s"] // r["n"]
        drift = above(((centroids - before) ** 2).sum(1)).astype(np.float64)
        needed = max((r["again"] for r in sums), default=0)
        n = n if needed < 0 else min(n, max(least, needed))
        state = shelf.put("centroid-state", assign(state, centroids.copy(), drift, n))
    return state, centroids.tolist()


def report(table: DataFrame, rule: CentroidRule = CentroidRule()) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, and the hash of the cluster's centroid."""
    state, centroids = clustered(table, rule)
    names = state.sparkSession.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "own int, written string")
    per_cluster = state.groupBy("own").agg(F.sum("distance").alias("cluster_inertia"))
    held = per_cluster.collect()  # a row for each centroid
    total = sum(r["cluster_inertia"] for r in held)
    sums = state.sparkSession.createDataFrame([(r["own"], r["cluster_inertia"]) for r in held], "own int, cluster_inertia bigint")
    # two tables of k rows
    joined = state.join(F.broadcast(sums), "own").join(F.broadcast(names), "own")
    return joined.select(
        "vec_id",
        F.col("own").alias("cluster"),
        "distance",
        "cluster_inertia",
        F.lit(total).cast("bigint").alias("inertia"),
        F.sha2("written", 256).alias("centroid_sha256"),
    )
