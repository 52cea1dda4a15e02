"""Exact integer k-means whose assignments search a vantage-point tree of the centroids.

Vectors become whole numbers once. In every round the centroids' tree is built anew and broadcast; each
vector opens the node with the least bound among its open ones (best first) until that bound lies beyond
its best distance. A bound equal to it is still opened, so ties go to the smaller number as in a full scan.
Distances to centroids are exact whole numbers; only bounds are floating-point, with room for rounding.
Tasks hand back one sum per centroid, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices, written

CLUSTERS = 8
ROUNDS = 10
SEED = 3
LENGTH = 64
SCALE = 1024
LEAF = 2  # centroids of a leaf
SLICE = 2_048  # vectors searched together
# Whole numbers up to it have squared distances that fit 63 bits.
LARGEST = 1 << 27
_SUMS = "cluster int, n long, sums array<long>"
_ASSIGNED = "vec_id long, cluster int, distance long"


class VantageTree:
    """Nodes in arrays. An inner node has a centroid as its vantage point, and a range of distances from it for
    either half of the others; a leaf has its centroids."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.members: list[np.ndarray] = []  # of a leaf; of an inner node its vantage point alone
        self.children: list[list[tuple[int, float, float]]] = []  # node, least and largest distance from the vantage point
        waiting = [(np.arange(len(points)), None)]
        while waiting:
            ids, parent = waiting.pop()
            node = len(self.members)
            if parent is not None:
                above, low, high = parent
                self.children[above].append((node, low, high))
            self.children.append([])
            if len(ids) <= leaf:
                self.members.append(ids)
                continue
            self.members.append(ids[:1])
            gaps = np.sqrt(self.squared(points[ids[:1]], ids[1:])[0].astype(float))
            order = np.argsort(gaps, kind="stable")
            half = len(order) // 2
            for side in (order[:half], order[half:]):
                if len(side):
                    waiting.append((ids[1:][side], (node, float(gaps[side].min()), float(gaps[side].max()))))

    def squared(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to some of the centroids."""
        gap = x[:, None, :] - self.points[ids][None, :, :]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest centroid, the smallest at ties, and the squared distance."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        own = np.full(len(x), len(self.points))
        bounds = np.full((len(x), len(self.members)), np.inf)
        bounds[:, 0] = 0.0
        rows = np.arange(len(x))
        while len(rows):
            node = bounds[rows].argmin(axis=1)
            bound = bounds[rows, node]
            radius = np.sqrt(best[rows].astype(float))
            going = np.isfinite(bound) & (bound <= radius * (1 + 1e-12) + 1e-6)
            rows, node = rows[going], node[going]
            for k in np.unique(node):
                here = rows[node == k]
                ids = self.members[k]
                gap = self.squared(x[here], ids)
                least = gap.min(axis=1)
                number = np.where(gap == least[:, None], ids[None, :], len(self.points)).min(axis=1)
                better = (least < best[here]) | ((least == best[here]) & (number < own[here]))
                best[here[better]], own[here[better]] = least[better], number[better]
                above = bounds[here, k]
                bounds[here, k] = np.inf
                if self.children[k]:
                    away = np.sqrt(gap[:, 0].astype(float))
                    for child, low, high in self.children[k]:
                        bounds[here, child] = np.maximum(above, np.maximum(away - high, low - away))
        return own, best


def whole_numbers(
    table: DataFrame, length: int = LENGTH, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(vec_id, c): floor(scale * component) of the vectors of the given length without null or non-finite components."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x * scale) < LARGEST), F.lit(False))
    kept = rows.where(F.coalesce((F.size("v") == length) & F.forall("v", fits), F.lit(False)))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("c"))


def first_centroids(rows: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors whose id has the smallest hash; of equal ids the smaller vector comes first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    taken = rows.select(F.sha2(name, 256).alias("hash"), "c").orderBy("hash", "c").limit(count).collect()
    return np.array([r["c"] for r in taken], np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("c").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)


def cluster(
    table: DataFrame,
    count: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    length: int = LENGTH,
    scale: int = SCALE,
    **columns: str,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector as a stored table, and the final centroids.

    Kept are the vectors of ``length`` components, none null or non-finite; each component x becomes floor(scale * x).
    Vectors with a whole number beyond 2^27, whose squared distances no long holds, are left out. With fewer
    kept vectors than ``count`` there are as many centroids, with none no rows and no centroids.
    Repeated rows count each, rows without an id hash as an empty one. Equal centroids are told apart by their
    number: the smaller one takes all. Other columns are ignored. The driver holds ``count`` centroids and their sums.
    """
    spark = table.sparkSession
    rows = written(whole_numbers(table, length, scale, **columns), "whole-vectors")
    points = first_centroids(rows, count, seed)
    if not len(points):
        return spark.createDataFrame([], _ASSIGNED), points.reshape(0, length)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(VantageTree(points))
        points = moved(rows, shared, points)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(VantageTree(points))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            own, gap = shared.value.nearest(_matrix(batch))
            yield pa.record_batch([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(gap, pa.int64())], names=["vec_id", "cluster", "distance"])

    return written(rows.mapInArrow(assign, _ASSIGNED), "clusters"), points


def moved(rows: DataFrame, shared, points: np.ndarray) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    count, length = points.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((count, length), np.int64), np.zeros(count, np.int64)
        for batch in slices(batches, SLICE):
            x = _matrix(batch)
            own, _ = shared.value.nearest(x)
            np.add.at(sums, own, x)
            n += np.bincount(own, minlength=count)
        seen = np.flatnonzero(n)
        yield pa.record_batch(
            [pa.array(seen, pa.int32()), pa.array(n[seen]), pa.array(list(sums[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(length)]
    found = rows.mapInArrow(add, _SUMS).groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()
    new = points.copy()
    for r in found:
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(length)]
    return new


def described(assigned: DataFrame, points: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and the digest of each row's centroid; a sum no long holds is null."""
    spark = assigned.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(total).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    inertia = fits(sum(sums.values()))
    facts = [
        (k, fits(n), inertia, hashlib.sha256(",".join(map(str, points[k].tolist())).encode()).hexdigest()) for k, n in sums.items()
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return assigned.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
