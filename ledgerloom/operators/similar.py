"""Exact similarity of files by their chunks, names that texts mention, and digests of what a sheet says.

"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import lasting

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Of a dictionary that one automaton holds; a larger one is split, and texts are read once for each part.
PART_NAMES, PART_CHARS = 100_000, 4_000_000


# --- near-duplicate files -----------------------------------------------------


def print_classes(prints: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(files: key, node; sets: node, n, prints) of key, print: files of one set of prints are a node, named by the smallest key.

    A set's prints stand rarest first, by the number of files that have them and then by the print.
    """
    common = prints.groupBy("print").agg(F.count("*").alias("files"))
    sets = prints.join(common, "print").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("files", "print"))).alias("prints"))
    sets = lasting(sets.select(key, F.col("prints.print").alias("prints")))
    nodes = sets.groupBy("prints").agg(F.min(key).alias("node"))
    files = lasting(sets.join(nodes, "prints").select(key, "node", "prints"))
    return files.select(key, "node"), files.where(F.col(key) == F.col("node")).select("node", F.size("prints").alias("n"), "prints")


def alike_sets(sets: DataFrame, least: tuple[int, int] = (3, 5)) -> DataFrame:
    """[J12] a, b, both, either: the pairs of sets (node, n, prints) whose Jaccard similarity is at least least[0] / least[1], each once with a < b.

    An exact join by prefixes: sets that are alike share a print among the first n - ceil(t n) + 1 of each, rarest first. Only those
    are joined, by print; before a pair's sets are compared, their sizes and what can still follow the shared print must leave
    room for the similarity. All bounds are in whole numbers. Prints that one set alone has are joined with nothing.
    """
    up, of = least
    need = F.ceil(F.col("n") * up / F.lit(of)).cast("int")
    prefix = sets.select("node", "n", F.posexplode(F.slice("prints", F.lit(1), F.col("n") - need + 1)).alias("place", "print"))
    shared = prefix.groupBy("print").agg(F.count("*").alias("sets")).where("sets > 1").select("print")
    prefix = lasting(prefix.join(shared, "print"))
    x, y = (prefix.select("print", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "place")]) for s in "ab")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    follow = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + F.least("place_a", "place_b")
    room = (of * small >= up * large) & ((of + up) * follow >= up * (F.col("n_a") + F.col("n_b")))
    pairs = x.join(y, "print").where((F.col("node_a") < F.col("node_b")) & room).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    of_side = lambda s: sets.select(F.col("node").alias(s), F.col("prints").alias(f"prints_{s}"))
    both = F.size(F.array_intersect("prints_a", "prints_b"))
    told = pairs.join(of_side("a"), "a").join(of_side("b"), "b").select("a", "b", both.alias("both"), (F.size("prints_a") + F.size("prints_b") - both).alias("either"))
    return told.where(of * F.col("both") >= up * F.col("either"))


def near_duplicate_files(prints: DataFrame, key: str, least: tuple[int, int] = (3, 5)) -> DataFrame:
    """[J12] key, node, links of each file with prints: its class of equal sets, and how many other classes are near duplicates of it."""
    files, sets = print_classes(prints, key)
    pairs = lasting(alike_sets(sets, least))
    links = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    return files.join(links, "node", "left").select(key, "node", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def sheet_digest(cells: DataFrame, key: str) -> DataFrame:
    """[H02] key, digest of what a workbook says, whatever its formatting, version or order of rows: sheets by place, each with its cells by row and column.

    cells: key, place (of the sheet), sheet, row, col (from 1), value (null: empty, which does not count).
    """
    said = cells.where("value is not null").groupBy(key, "place", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("cells"))
    sheets = cells.select(key, "place", "sheet").distinct().join(said, [key, "place", "sheet"], "left")
    no_cell = F.from_json(F.lit("[]"), "array<struct<row:int,col:int,value:string>>")
    line = F.to_json(F.struct("sheet", F.coalesce("cells", no_cell).alias("cells")))
    return sheets.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n"), 256).alias("digest"))


# --- mentions -----------------------------------------------------------------


def mentions(texts: DataFrame, names: DataFrame, key: str, text: Column, name: Column, name_id: str, least: int = 1, whole: int = 2) -> DataFrame:
    """[J08 J10] key, name_id: the names that occur in each text, each once.

    text and name are compared as they come out of these columns (fold or sign them there). Names below ``least`` characters are left out; those of
    at most ``whole`` must stand as a word of their own ([a-z0-9_], as in folded texts), longer ones anywhere. Names are put into automata of bounded
    size, so a text is read once for each part of the dictionary; where there are more parts than sizes of names (``_maybe_names``), texts are
    read once a size instead. Equal names all count.
    """
    from itertools import chain

    kind, of = texts.schema[key].dataType.simpleString(), names.schema[name_id].dataType.simpleString()
    asked = names.select(name.alias("name"), F.col(name_id).alias("id")).where((F.char_length("name") >= max(1, least)) & F.col("id").isNotNull())
    # Distinct names in parts of bounded numbers and characters, told apart by a hash.
    size = asked.agg(F.count_distinct("name").alias("n"), F.count("*").alias("ids"), F.sum(F.char_length("name")).alias("c")).first()
    parts = 1 + max(size["n"] // PART_NAMES, (size["c"] or 0) // PART_CHARS)
    rows = texts.select(F.col(key).alias("key"), text.alias("text")).where("text is not null")

    def found(own: list[str]) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            tree = ahocorasick.Automaton()
            for i, n in enumerate(held.value):
                tree.add_word(n, (i, len(n)))
            if held.value:
                tree.make_automaton()
            word = lambda c: c == "_" or (c.isascii() and c.isalnum())
            for b in batches:
                keys, hits = [], []
                for k, t in zip(b.column("key"), b.column("text")):
                    t = t.as_py()
                    seen = {i for end, (i, n) in tree.iter(t) if n > whole or not ((end >= n and word(t[end - n])) or (end + 1 < len(t) and word(t[end + 1])))} if held.value else ()
                    keys.append([k] * len(seen))
                    hits.append([held.value[i] for i in seen])
                yield pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(keys)), b.schema.field("key").type), pa.array(list(chain.from_iterable(hits)), pa.string())], ["key", "name"])

        return rows.mapInArrow(run, f"key {kind}, name string")

    if parts > 1:
        sizes = [r[0] for r in asked.select(F.octet_length("name")).distinct().collect()]
        if parts > len({n.bit_length() for n in sizes}):
            maybe = _maybe_names(rows, asked.select("name").distinct(), size["n"], sizes, whole)
            return maybe.join(asked.distinct(), F.col("bytes") == F.col("name").cast("binary")).select(F.col("key").alias(key), F.col("id").cast(of).alias(name_id)).distinct()
    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    hits = None
    for i in range(parts):
        own = sorted(r[0] for r in asked.where(part == i).select("name").distinct().collect())  # of bounded size
        hits = found(own) if hits is None else hits.union(found(own))
    # A frequent name would be one task's join; ids of a dictionary that one automaton holds go to the texts instead.
    ids = asked.distinct()
    ids = F.broadcast(ids) if parts == 1 and size["ids"] <= PART_NAMES else ids
    return hits.join(ids, "name").select(F.col("key").alias(key), F.col("id").cast(of).alias(name_id)).distinct()


def _maybe_names(rows: DataFrame, names: DataFrame, n: int, sizes: list[int], whole: int) -> DataFrame:
    """key, bytes: the parts of each text (key, text) that may be one of the names, each once; all that are, and few others.

    Two marks of each name are broadcast as bits of their crc32, at most 16 MB whatever the dictionary: of the name, and of its end, as long as
    the largest power of two that the name has room for. A text is read once for each such power; only where an end fits are whole names tried.
    """
    bits = 1 << min(27, max(20, (16 * n).bit_length()))
    whole_name, end = F.col("name").cast("binary"), F.expr("substr(cast(name as binary), -shiftleft(1, length(bin(octet_length(name))) - 1))")
    marks = names.select(F.explode(F.array(*[F.crc32(c) % bits + 1 for c in (whole_name, end)])).alias("at"))
    marks = marks.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b"))
    filled = bytearray(bits // 8)
    for k, b in marks.collect():  # 4096 bytes each
        filled[4096 * (k - 1) : 4096 * k] = b
    powers: dict[int, list[int]] = {}
    for x in sorted(sizes):
        powers.setdefault(1 << (x.bit_length() - 1), []).append(x)
    held = rows.sparkSession.sparkContext.broadcast((bytes(filled), powers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        told, powers = held.value
        most = 8 * len(told) - 1

        def marked(part: bytes) -> int:
            h = crc32(part) & most
            return told[h >> 3] >> (h & 7) & 1

        word = lambda c: c == 95 or (c < 128 and chr(c).isalnum())

        def stands(t: bytes, a: int, b: int) -> bool:
            if b - a > 4 * whole or len(t[a:b].decode("utf-8", "ignore")) > whole:
                return True
            return not ((a and word(t[a - 1])) or (b < len(t) and word(t[b])))

        for b in batches:
            at, hits = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                seen = set()
                for power, own in powers.items():
                    for end in range(power, len(t) + 1):
                        h = crc32(t[end - power : end]) & most
                        if told[h >> 3] >> (h & 7) & 1:
                            seen.update(t[end - n : end] for n in own if n <= end and marked(t[end - n : end]) and stands(t, end - n, end))
                at += [i] * len(seen)
                hits += seen
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(hits, pa.binary())], ["key", "bytes"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"key {kind}, bytes binary")


def longest_mentions(found: DataFrame, key: str, name: str) -> DataFrame:
    """[J09] Of the names that a text mentions, those that are no part of a longer one that it mentions; found: key, name."""
    longer = found.select(key, F.col(name).alias("_longer"))
    inside = found.join(longer, key).where((F.char_length("_longer") > F.char_length(name)) & F.contains("_longer", F.col(name))).select(key, name).distinct()
    return found.join(inside, [key, name], "left_anti")
