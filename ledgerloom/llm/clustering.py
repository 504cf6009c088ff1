"""Operator 11, centroid clustering: Lloyd's rounds over kd-trees by the filtering rule.

Each partition's vectors are dealt into kd-trees of at most ``BLOCK`` points, made once and stored. A node holds its count, its
componentwise sum and its bounding box, all in integers. A round walks each tree with the list of centroids that may be nearest: a
centroid strictly farther than another one at every point of the box is pruned; a node with one centroid left gives its
count and sum as a whole; leaves are resolved point by point. Tasks add up their trees, Spark adds up the tasks' (centroid, count, sum), and the
driver gets one row for each centroid.

Kept are vectors of exactly ``width`` components without null or non-finite ones; all others give no row. Repeated rows count each and are
returned each. Of rows with equal ids the smaller vector sorts first among the starts; a null id sorts last. Fewer than k kept
vectors give fewer centroids, an empty table gives no row. Only the id and the vector are read of the columns. Scaled components may
reach ``LIMIT`` in size, so that all distances are exact in 64 bits; larger ones raise ValueError. A sum of distances
beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, settled
from .topk import quantise

BLOCK, LEAF = 2048, 16
LIMIT = 1 << 25


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, and for each node: (start, end, first child or -1), its sum, its box (lowest, highest)."""
    order, nodes, sums, boxes = np.arange(len(points)), [(0, len(points))], [], []
    shape: list[tuple[int, int, int]] = []
    for a, b in nodes:  # grows meanwhile
        own = points[order[a:b]]
        low, high = own.min(0), own.max(0)
        at = int(np.argmax(high - low))
        child = -1
        if b - a > LEAF and high[at] > low[at]:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, at], half)]
            child = len(nodes)
            nodes += [(a, a + half), (a + half, b)]
        shape.append((a, b, child))
        sums.append(own.sum(0))
        boxes.append((low, high))
    return order, np.array(shape, np.int64), np.array(sums), np.array(boxes)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each centroid."""
    return (points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)


def walk(shape: np.ndarray, boxes: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: nodes with one centroid left and that centroid, and leaves that are still open."""
    norm = (centroids * centroids).sum(1)
    at, live = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(at):
        low, high = boxes[at, 0], boxes[at, 1]
        near = np.where(live, distances(low + high, 2 * centroids), np.iinfo(np.int64).max).argmin(1)
        toward = centroids[None] - centroids[near][:, None]
        corner = np.where(toward > 0, high[:, None], low[:, None])
        live &= norm - norm[near][:, None] - 2 * (corner * toward).sum(2) <= 0
        whole = live.sum(1) == 1
        leaf = ~whole & (shape[at, 2] < 0)
        yield at[whole], live[whole].argmax(1), at[leaf]
        inner = ~whole & ~leaf
        first = shape[at[inner], 2]
        at, live = np.concatenate([first, first + 1]), np.concatenate([live[inner]] * 2)


def _spans(shape: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of the nodes' points."""
    return np.concatenate([np.arange(a, b) for a, b in shape[nodes, :2]]) if len(nodes) else np.empty(0, np.int64)


def totals(points: np.ndarray, shape: np.ndarray, sums: np.ndarray, boxes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points of each centroid."""
    n, s = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for nodes, own, leaves in walk(shape, boxes, centroids):
        np.add.at(n, own, shape[nodes, 1] - shape[nodes, 0])
        np.add.at(s, own, sums[nodes])
        rest = points[_spans(shape, leaves)]
        nearest = distances(rest, centroids).argmin(1)
        np.add.at(n, nearest, 1)
        np.add.at(s, nearest, rest)
    return n, s


def nearest(points: np.ndarray, shape: np.ndarray, boxes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid of each point."""
    out = np.empty(len(points), np.int64)
    for nodes, own, leaves in walk(shape, boxes, centroids):
        for node, c in zip(nodes, own):
            out[shape[node, 0] : shape[node, 1]] = c
        at = _spans(shape, leaves)
        out[at] = distances(points[at], centroids).argmin(1)
    return out


def trees(vectors: DataFrame, width: int) -> DataFrame:
    """A row for each kd-tree: ids and points in its order, and its nodes. vectors: id, w."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), BLOCK):
                some = b.slice(i, BLOCK)
                points = some.column("w").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), width)
                if np.abs(points).max() > LIMIT:
                    raise ValueError(f"a scaled component is larger than {LIMIT}")
                order, *parts = grow(points)
                ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column("id").take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (points[order], *parts)]], ["ids", "points", "shape", "sums", "boxes"])

    return vectors.mapInArrow(run, f"ids array<{kind}>, points binary, shape binary, sums binary, boxes binary")


def _arrays(b: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, ...]:
    points, shape, sums, boxes = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in ("points", "shape", "sums", "boxes"))
    return points.reshape(-1, width), shape.reshape(-1, 3), sums.reshape(-1, width), boxes.reshape(-1, 2, width)


def moved(grown: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors; those without any stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for i in range(len(b)):
                dn, ds = totals(*_arrays(b, i, width), centroids)
                n, s = n + dn, s + ds
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(list(s[own]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    added = grown.select("points", "shape", "sums", "boxes").mapInArrow(run, "cluster int, n long, s array<long>")
    total = added.groupBy("cluster").agg(F.sum("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(width)]))
    out = centroids.copy()
    for c, n, s in total.collect():
        out[c] = [int(x) // n for x in s]
    return out


def assigned(grown: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """key, cluster, distance of each vector."""
    width, kind = centroids.shape[1], grown.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                points, shape, _, boxes = _arrays(b, i, width)
                own = nearest(points, shape, boxes, centroids)
                far = ((points - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(own, pa.int32()), pa.array(far)], [key, "cluster", "distance"])

    return grown.select("ids", "points", "shape", "sums", "boxes").mapInArrow(run, f"`{key}` {kind}, cluster int, distance long")


def clusters(df: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, key: str = "vec_id", vector: str = "embedding", start: Column | None = None) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    The first centroids are the k kept vectors that sort first by ``start``, by default the SHA-256 of ``3:<id>``.
    """
    spark = df.sparkSession
    first = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256) if start is None else start
    vectors = df.select(F.col(key).alias("id"), quantise(F.col(vector), scale).alias("w")).where(F.col("w").isNotNull() & (F.size("w") == width))
    centroids = np.array([r["w"] for r in vectors.orderBy(first.asc_nulls_last(), "w").limit(k).collect()], np.int64).reshape(-1, width)
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def last() -> DataFrame:
        nonlocal centroids
        grown = cut(trees(vectors, width), "trees", row_group=16 << 20)
        for _ in range(rounds):
            after = moved(grown, centroids)
            if (after == centroids).all():
                break  # all later rounds would give the same
            centroids = after
        return assigned(grown, centroids, key)

    found = settled(spark, last, "assigned")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(x), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in inertia.items()]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
