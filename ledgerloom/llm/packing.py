"""Operator 6, packing: shortest-pack-first over the length histogram.

Each document's tokens (its words' tokens, then the end id) are cut into full sequences and a rest. Lengths, at most
``size`` of them, make a histogram; on it, lengths are placed longest first, each into the open packs with the
most room, and what is kept are patterns (which lengths share a sequence) with counts. Patterns then meet the pieces by the
rank of a piece among those of its length. The histogram and patterns are bounded by ``size``, whatever the input.

Null texts are empty: one piece that holds the end id. Repeated rows and repeated ids are packed each.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, running_total

END_ID = 1


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: one row for each piece of at most size ids."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end = words.ids(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            row, rows = 0, []
            for part in words.by_bytes(texts):
                split, kept = library.look_up(part)
                for ws in split:
                    ids = b"".join(map(kept.__getitem__, ws)) + end
                    n = len(ids) // 4
                    for at in range(0, n, size):
                        piece = ids[4 * at : 4 * (at + size)]
                        rows.append((row, at, len(piece) // 4, zlib.crc32(piece), n))
                    row += 1
            found = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found[:, 0])), *(pa.array(found[:, i]) for i in range(1, 5))], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(cut_up, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("key", key)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of a pack) of all packs: lengths longest first, each to the open packs with the most room."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    open_rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(left: int, pack: tuple[int, ...], n: int) -> None:
        if left == 0:
            done.append((n, pack))
        else:
            if left not in room:
                bisect.insort(open_rooms, left)
            room[left][pack] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not open_rooms or open_rooms[-1] < length:
                per = 1 if length * 2 > size else size // length  # what starts anew fills up with its own length
                full, rest = divmod(n, per)
                if full:
                    put(size - per * length, (length,) * per, full)
                if rest:
                    put(size - rest * length, (length,) * rest, 1)
                n = 0
                continue
            most = open_rooms[-1]
            pack, there = next(iter(room[most].items()))
            fit = most // length
            if n >= fit:
                take, used = min(there, n // fit), fit
            else:
                take, used = 1, n
            room[most][pack] -= take
            if not room[most][pack]:
                del room[most][pack]
            if not room[most]:
                del room[most]
                open_rooms.pop()
            put(most - used * length, (*pack, *(length,) * used), take)
            n -= take * used
    return done + [(n, pack) for packs in room.values() for pack, n in packs.items()]


def pack(cut_up: DataFrame, size: int = 2048, key: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut_up = cut(cut_up, "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    places: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length: first rank, first sequence, offset, step
    seen: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, lengths in sorted(patterns(histogram, size), key=lambda x: (x[1], x[0])):
        at = 0
        for length in lengths:
            places[length].append((seen[length], sequence, at))
            seen[length] += n
            at += length
        sequence += n
    table = {k: np.array(v, np.int64) for k, v in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            out = np.empty((2, len(rank)), np.int64)
            for x in np.unique(length):
                at, own = np.flatnonzero(length == x), table[int(x)]
                k = np.searchsorted(own[:, 0], rank[at], "right") - 1
                out[0, at] = own[k, 1] + rank[at] - own[k, 0]
                out[1, at] = own[k, 2]
            kept = [i for i, c in enumerate(b.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(out[0]), pa.array(out[1])], [*(b.schema.names[i] for i in kept), "sequence_id", "offset"])

    ranked = running_total(cut_up, ["length"], [key, "start", "ids_crc32"], name="rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema)
    return ranked.select(*cut_up.columns, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
