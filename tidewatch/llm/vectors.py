"""Approximate nearest neighbours by posting lists around centroids.

Centroids come from a balanced clustering of a sample of at most ``SAMPLE`` vectors; every vector of the
table is listed under its nearest centroid, and vectors near a boundary under further ones. The
centroids nearest to a vector are found by a beam search over a neighbour graph held in memory. A query
reads all lists whose centroids are at most a ratio further than its nearest one: where the beam ends
within that ratio, the distances to all centroids are computed. Neighbouring lists form a shard, read in
pieces of about ``PIECE`` vectors; what is read is ranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

SAMPLE = 20_000
LIST_ROWS = 200  # vectors per centroid aimed at
MOST_CENTROIDS = 4_096  # bounds what is broadcast; lists get longer beyond it, their pieces don't
PIECE = 8_000
QUERIES = 20_000  # of one shard that are held at once
DEGREE = 16
BEAM = 64
REPLICAS = 4
BOUNDARY = 1.15  # a vector is listed where the centroid is at most so much further than its nearest
RATIO = 1.35  # a query reads a list under the same condition
LEAST_LISTS = 8
_BATCH = 1_000
_BLOCK = 256  # queries compared at once with a piece


class Centroids:
    """Unit vectors, a graph of each one's nearest others, where a search enters it, and each one's shard."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        random = np.random.default_rng(2)
        near = min(DEGREE * 3 // 4, n - 1)
        links = np.empty((n, 0), np.int64)
        if n > 1:
            blocks = []
            for at in range(0, n, 512):
                d = -points[at : at + 512] @ points.T
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
                blocks.append(np.argpartition(d, near - 1, axis=1)[:, :near])
            # A few links anywhere keep the graph in one piece.
            far = (np.arange(n)[:, None] + random.integers(1, n, (n, DEGREE - near))) % n
            links = np.concatenate([np.concatenate(blocks), far], axis=1)
        self.links = links
        self.entries = random.permutation(n)[:16]
        self.shards = _nearest(points, points[random.permutation(n)[: int(np.ceil(np.sqrt(n)))]])

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest centroids found for each row of unit vectors, nearest first."""
        n, rows = len(self.points), np.arange(len(x))[:, None]
        beam = min(beam, n)
        distance = lambda ids: np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", self.points[ids], x), 0))
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries))).copy()
        dist, done = distance(ids), np.zeros(ids.shape, bool)
        while self.links.size:
            open_ = np.where(done, np.inf, dist)
            pick = open_.argmin(axis=1)[:, None]
            live = np.isfinite(open_[rows, pick]).ravel()
            if not live.any():
                break
            done[rows, pick] = True
            near = np.sort(self.links[ids[rows, pick].ravel()], axis=1)
            fresh = (near[:, :, None] != ids[:, None, :]).all(axis=2) & live[:, None]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            gap = np.where(fresh, distance(near), np.inf)
            ids, dist = np.concatenate([ids, near], axis=1), np.concatenate([dist, gap], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
            keep = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = ids[rows, keep], dist[rows, keep], done[rows, keep]
        order = np.argsort(dist, axis=1, kind="stable")
        return ids[rows, order], dist[rows, order]

    def lists(self, x: np.ndarray) -> list[list[int]]:
        """For each vector the lists that hold it: its nearest centroid, and others not nearer to a chosen one."""
        ids, dist = self.search(x)
        out = []
        for own, d in zip(ids, dist, strict=True):
            chosen = [own[0]]
            for c, gap in zip(own[1:], d[1:], strict=True):
                if len(chosen) == REPLICAS or gap > BOUNDARY * d[0] or not np.isfinite(gap):
                    break
                if all(np.linalg.norm(self.points[c] - self.points[k]) > gap for k in chosen):
                    chosen.append(c)
            out.append([int(c) for c in chosen])
        return out

    def probes(self, x: np.ndarray) -> list[list[int]]:
        """For each query the lists to read: within the ratio, and some in any case."""
        ids, dist = self.search(x)
        out = self._within(ids, dist)
        ended = np.isfinite(dist[:, -1]) & (dist[:, -1] > RATIO * dist[:, 0])
        wide = np.flatnonzero(~ended)  # lists beyond the beam may lie within the ratio
        gaps = np.sqrt(np.maximum(2 - 2 * x[wide] @ self.points.T, 0))
        order = np.argsort(gaps, axis=1, kind="stable")
        for i, own in zip(wide, self._within(order, np.take_along_axis(gaps, order, axis=1)), strict=True):
            out[i] = own
        return out

    @staticmethod
    def _within(ids: np.ndarray, dist: np.ndarray) -> list[list[int]]:
        wanted = (dist <= RATIO * dist[:, :1]) | (np.arange(ids.shape[1]) < LEAST_LISTS)
        return [own[w].tolist() for own, w in zip(ids, wanted & np.isfinite(dist), strict=True)]

    def everything(self, x: np.ndarray) -> list[list[int]]:
        return [list(range(len(self.points)))] * len(x)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def balanced_centroids(sample: np.ndarray, count: int, rounds: int = 8) -> Centroids:
    """Spherical k-means on unit vectors; clusters twice the mean are halved, empty ones go."""
    random = np.random.default_rng(1)
    sample = np.unique(sample, axis=0)
    centers = sample[random.permutation(len(sample))[:count]]
    for _ in range(rounds):
        own = _nearest(sample, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(centers))
        own_ids = np.flatnonzero(size)
        centers = [unit(s[None])[0] if np.linalg.norm(s) > 1e-6 else c for s, c, n in zip(sums, centers, size, strict=True) if n]
        for k in np.flatnonzero(size[own_ids] > 2 * len(sample) / count):  # halves along the line between two of its members
            members = sample[own == own_ids[k]]
            a = members[0]
            b = members[(members @ a).argmin()]
            side = members @ b > members @ a
            if side.any() and not side.all():
                centers[k] = unit(members[~side].mean(axis=0)[None])[0]
                centers.append(unit(members[side].mean(axis=0)[None])[0])
        centers = np.array(centers[:MOST_CENTROIDS], np.float32)
    return Centroids(centers)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[at : at + 1_000] @ centers.T).argmax(axis=1) for at in range(0, len(x), 1_000)])


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): vectors as doubles, without those that are null, zero, or hold null or non-finite numbers."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    v = F.col("v")
    good = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & good & F.exists(v, lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def nearest(
    table: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest found for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id. The
    score is the cosine in double precision on the given vectors; ties go to the smaller id. Rows without an
    id, and vectors that are null, zero or not finite take no part, nor do those of another length than
    most have. Repeated rows of one id count once, by their first vector in order. A query for which fewer than
    ``k`` were found reads all lists. Other columns are ignored.
    """
    spark = table.sparkSession
    rows = usable(table, id_column, vector_column)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes["d"])
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    total = rows.count()
    place = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(place < min(1.0, SAMPLE / total)).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        sample = rows.limit(1).select("v").toArrow().column("v").combine_chunks()
    count = max(1, min(MOST_CENTROIDS, total // LIST_ROWS, len(sample)))
    shared = spark.sparkContext.broadcast(balanced_centroids(unit(_matrix(sample)), count))

    def listing(choose: str):
        """One row for each shard that has lists of the vector, with these lists."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _BATCH):
                    part = batch.slice(at, _BATCH)
                    found = getattr(shared.value, choose)(unit(_matrix(part.column("v"))))
                    own = np.repeat(np.arange(len(found)), [len(f) for f in found])
                    lists = np.array([c for f in found for c in f], np.int32)
                    shard = shared.value.shards[lists].astype(np.int32)
                    order = np.lexsort((lists, shard, own))
                    own, lists, shard = own[order], lists[order], shard[order]
                    new = (own[1:] != own[:-1]) | (shard[1:] != shard[:-1])
                    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), new]))
                    ends = np.append(starts[1:], len(own))[: len(starts)]
                    for first in range(0, len(starts), _BATCH):
                        some, last = starts[first : first + _BATCH], ends[min(first + _BATCH, len(starts)) - 1]
                        offsets = np.append(some, last) - some[0]
                        rows_ = pa.array(own[some])
                        yield pa.record_batch(
                            [
                                pa.array(shard[some]),
                                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists[some[0] : last])),
                                part.column("vec_id").take(rows_),
                                part.column("v").take(rows_),
                            ],
                            names=["shard", "lists", "vec_id", "v"],
                        )

        return run

    schema = "shard int, lists array<int>, vec_id long, v array<double>"
    postings = written(rows.mapInArrow(listing("lists"), schema), "postings")
    queries = rows.where(F.col("vec_id") % every == 0)
    pieces = postings.groupBy("shard").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    keys = ["shard", "piece", "block"]

    def read(probes: DataFrame) -> DataFrame:
        """The nearest in each piece of a shard; many queries of one shard are taken in blocks, each with all pieces."""
        blocks = probes.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        sizes = F.broadcast(pieces.join(F.broadcast(blocks), "shard"))
        asked = probes.join(sizes, "shard").withColumn("block", dealt("blocks")).withColumn("piece", numbers("pieces"))
        held = postings.join(sizes, "shard").withColumn("piece", dealt("pieces")).withColumn("block", numbers("blocks"))
        columns = [*keys, "lists", "vec_id", "v"]
        near = asked.select(*columns).groupBy(*keys).cogroup(held.select(*columns).groupBy(*keys)).applyInArrow(
            lambda q, c: _top(q, c, k), "query_id long, vec_id long, score double"
        )
        return near.distinct()

    first = written(read(written(queries.mapInArrow(listing("probes"), schema), "probes")), "neighbours")
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
    short = queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti")
    found = first.union(read(written(short.mapInArrow(listing("everything"), schema), "short"))).distinct()
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def cosines(q: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines of one vector with many, each summed up the same way whatever stands beside it."""
    return (rows * q).sum(axis=1) / (norms * np.sqrt((q * q).sum()))


def _top(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The nearest candidates of each query among those listed where it reads; no candidate comes twice."""
    out = []
    if len(queries) and len(candidates):
        ids, rows = candidates["vec_id"].to_numpy(), _matrix(candidates["v"].combine_chunks())
        asking, wanted = queries["vec_id"].to_numpy(), _matrix(queries["v"].combine_chunks())
        norms = np.sqrt((rows * rows).sum(axis=1))
        held, read = candidates["lists"].combine_chunks(), queries["lists"].combine_chunks()
        names, slots = np.unique(held.flatten().to_numpy(), return_inverse=True)
        sizes = held.value_lengths().to_numpy()
        own = np.full((len(rows), sizes.max()), len(names))  # the last slot is read by nobody
        own[np.arange(own.shape[1]) < sizes[:, None]] = slots
        with np.errstate(divide="ignore", invalid="ignore"):
            directions = rows / norms[:, None]
            pointing = wanted / np.sqrt((wanted * wanted).sum(axis=1))[:, None]
        for at in range(0, len(asking), _BLOCK):
            part = read.slice(at, _BLOCK)
            asked = np.zeros((len(part), len(names) + 1), bool)
            asked[np.repeat(np.arange(len(part)), part.value_lengths().to_numpy()), _slots(names, part.flatten().to_numpy())] = True
            asked[:, -1] = False
            open_ = asked[:, own[:, 0]]
            for j in range(1, own.shape[1]):
                open_ |= asked[:, own[:, j]]
            open_ &= ids != asking[at : at + _BLOCK, None]
            rough = np.nan_to_num(pointing[at : at + _BLOCK] @ directions.T, nan=-2.0)
            for i, own_rough in enumerate(rough):
                pick = np.flatnonzero(open_[i])
                if len(pick) > k:  # those that rounding could have put below the k-th are ranked too
                    least = np.partition(own_rough[pick], len(pick) - k)[len(pick) - k]
                    pick = pick[own_rough[pick] >= least - 1e-9]
                score = cosines(wanted[at + i], rows[pick], norms[pick])
                order = np.lexsort((ids[pick], -score))[:k]
                out.append((np.full(len(order), asking[at + i]), ids[pick][order], score[order]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
    types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    return pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _slots(names: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Places of the lists in the sorted names; one past the end for others."""
    at = np.minimum(np.searchsorted(names, lists), len(names) - 1)
    return np.where(names[at] == lists, at, len(names))
