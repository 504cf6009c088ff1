"""Operator 12, embedding whitening: a covariance in tiles, its eigenvectors, and the rows projected on them.

Rows are dealt into row blocks, their dimensions into column blocks of ``TILE``. A pair of column blocks is a tile key: the column
blocks are shuffled by row block, each task multiplies the pairs of blocks that meet, adds up its products tile by tile, Spark sums
each tile over the tasks, and the driver assembles the matrix (width * width numbers) and decomposes it.

Entries are longs, x = floor(scale * c) + shift. They are centred at the integer below their mean before they are multiplied, all
products and sums are exact, and what the integer leaves of the mean is taken out in exact arithmetic too; so the matrix is
rounded once, and is the same however rows are dealt.

Rows whose vector is null or holds null or non-finite entries give no row. Of unequal lengths, the missing entries count as c = 0. Repeated
rows count each and are returned each; a null id is returned as null. An empty table gives no row, nor does one whose vectors have no
entries. Components are numbered to the smaller of 8 and the width. A component whose variance is zero (below 1e-13 of the trace) is whitened to 0 and
left out of identity_error. A deviation beyond 64 bits is null. Only the id and the vector are read of the columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .topk import quantise

TILE, ROWS = 16, 1024
#: Tiles whose sums a task holds before it hands them on.
HELD = 256
FLAT = 1e-13


def centred(b: pa.RecordBatch, base: np.ndarray, lack: int) -> np.ndarray:
    """Entries less base; those that a vector lacks are ``lack`` before that."""
    own = b.column("x")
    lengths = own.value_lengths().to_numpy(zero_copy_only=False)
    flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == len(base)).all():
        return flat.reshape(len(b), len(base)) - base
    out = np.full((len(b), len(base)), lack, np.int64)
    out[np.arange(len(base)) < lengths[:, None]] = flat
    return out - base


def column_blocks(rows: DataFrame, base: np.ndarray, lack: int, small: bool) -> DataFrame:
    """row_block, tile, z: so many rows' centred entries of TILE dimensions, row by row."""
    kind = "<i4" if small else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for i in range(0, len(b), ROWS):
                z = centred(b.slice(i, ROWS), base, lack).astype(kind)
                parts = [z[:, at : at + TILE].tobytes() for at in range(0, len(base), TILE)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["row_block", "tile", "z"])
                number += 1

    return rows.select("x").mapInArrow(run, "row_block long, tile int, z binary")


def products(blocks: DataFrame, width: int, small: bool, exact: bool) -> DataFrame:
    """a, b, r, cells: row r of the tile (a, b) of the sum of z z^T, exact."""
    kind = "<i4" if small else "<i8"
    size = lambda t: min(TILE, width - t * TILE)
    left, right = (blocks.select("row_block", F.col("tile").alias(t), F.col("z").alias(f"z{t}")) for t in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def told() -> pa.RecordBatch:
            keys = [(a, b, r) for (a, b), m in held.items() for r in range(len(m))]
            cells = [[Decimal(x) for x in row] + [Decimal(0)] * (TILE - len(row)) for m in held.values() for row in m.tolist()]
            columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.list_(pa.decimal128(38, 0)))], ["a", "b", "r", "cells"])

        for batch in batches:
            for a, b, za, zb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "za", "zb"))):
                # In doubles only where every product and sum is below 2^53.
                x, y = (np.frombuffer(z, kind).reshape(-1, size(t)).astype(np.float64 if exact else object) for t, z in ((a, za), (b, zb)))
                one = (x.T @ y).astype(np.int64).astype(object) if exact else x.T @ y
                held[a, b] = held[a, b] + one if (a, b) in held else one
            if len(held) > HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    met = left.join(right, "row_block").where("a <= b").select("a", "b", "za", "zb").mapInArrow(run, "a int, b int, r int, cells array<decimal(38,0)>")
    return met.groupBy("a", "b", "r").agg(F.array(*[F.sum(F.col("cells")[i]) for i in range(TILE)]).alias("cells"))


def covariance(tiles: DataFrame, n: int, rest: list[int]) -> np.ndarray:
    """The matrix of the tiles; rest: sums of the centred entries."""
    width = len(rest)
    out = np.zeros((width, width))
    for a, b, r, cells in tiles.collect():
        i = a * TILE + r
        for j, x in enumerate(cells[: width - b * TILE], b * TILE):
            out[i, j] = out[j, i] = (n * int(x) - rest[i] * rest[j]) / (n * n)
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1, 1)


def whiten(df: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.transform(quantise(F.col(vector), scale), lambda x: x + F.lit(shift)).alias("x")).where("x is not null")
    kind = rows.schema["id"].dataType.simpleString()
    n = rows.count()
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.min("v"), F.max("v")).collect()
    if not sums:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    total, reach = [0] * len(sums), 0
    base = np.zeros(len(sums), np.int64)
    for i, count, s, low, high in sums:
        total[i] = int(s) + (n - count) * shift
        base[i] = total[i] // n
        reach = max(reach, *(abs(x - int(base[i])) for x in ([low, high] if count == n else [low, high, shift])))
    width, rest = len(total), [s - n * int(b) for s, b in zip(total, base)]
    small, exact = reach < 1 << 31, ROWS * reach * reach < 1 << 53
    v = covariance(products(column_blocks(rows, base, shift, small), width, small, exact), n, rest)
    e, u = components(v, most)
    trace = float(np.trace(v))
    alive = e > FLAT * max(trace, 0)
    onto = np.where(alive, u / np.sqrt(np.where(alive, e, 1)), 0)
    mean, sure = np.array([r / n for r in rest]), width * (n * (reach + 1)) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = centred(b, base, shift)
            apart = z.astype(np.int64 if sure else object) * n - np.array(rest, np.int64 if sure else object)
            far = (apart * apart).sum(1).tolist()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x if x < 1 << 63 else None for x in far], pa.int64()), pa.array(list((z - mean) @ onto), pa.list_(pa.float64()))], [key, "deviation", "w"])

    told = cut(rows.mapInArrow(run, f"`{key}` {kind}, deviation long, w array<double>"), "whitened")
    live = [i for i in range(len(e)) if alive[i]]
    pairs = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - (1.0 if i == j else 0.0)) for i in live for j in live if i <= j]
    error = float(told.select(F.array_max(F.array(*pairs))).first()[0]) if pairs else 0.0
    share = F.array(*[F.lit(float(x / trace) if trace > 0 else 0.0) for x in e])
    each = told.select(key, "deviation", F.posexplode("w").alias("_i", "whitened"))
    return each.select(key, (F.col("_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("_i")].alias("explained"), F.lit(error).alias("identity_error"))
