"""Operator 4, mixing sources to target weights.

Each source's documents, in order of id, are one stream of words, cut into blocks of ``block`` words. Output shards of
``shard_blocks`` slots draw their sources in proportion to the targets: a shard's counts are a multinomial draw, conditional on what all
shards together take of a source being its target (draws without replacement from the planned number of each). Independent draws
would leave a source of m draws sqrt(m) off its target. A source's draws are numbered over shards; draw j reads block
p(j mod n) of the source's n, where p is a pseudorandom permutation of its own for each pass. Draws and blocks meet by (source, block).
No block is read more than ``most`` times.

Sources sort by code point, null last, and weigh 1, 2, 3, repeating. A null text has no words. A source without words has
target 0. Repeated rows are documents of their own. All draws come from hashes of the seed: reruns agree. Of other columns,
``taken`` reads none; ``mixed_texts`` carries them along whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_total

BLOCK = 64
SHARD_BLOCKS = 4096
#: Draws that a task expands, about.
TASK_DRAWS = 500_000
MOST = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, src, row, size: words of each row; row tells repeated rows apart, and is that of docs if docs has a column _row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64())], ["key", "src", "row", "size"])

    kind = docs.schema[key].dataType.simpleString()
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("src"), row.alias("row"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, src string, row long, size long")


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """src, source_size, target: weights share all words; what is above ``most`` times a source's words is reshared.

    Sources stand in line by limit over weight. The first k of them are full if the share that a weight of 1 gets of what
    they leave is above the ratio of each; the share is that of the smallest k whose next source isn't above its ratio.
    """
    s = sized.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("src").isNull())
    s = running_total(s, [], ["last", "src"], name="place").withColumn("weight", F.col("place") % 3 + 1).withColumn("limit", F.col("source_size") * most)
    s = cut(s.withColumn("ratio", F.col("limit") / F.col("weight")), "sources")
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    line = running_total(running_total(s, [], ["ratio", "place"], F.col("limit"), "full"), [], ["ratio", "place"], F.col("weight"), "closed")
    share = line.withColumn("share", (F.lit(float(total)) - F.col("full")) / (F.lit(weights) - F.col("closed"))).where("share <= ratio").agg(F.min_by("share", "closed")).first()[0]
    return s.select("src", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(float("inf") if share is None else share)).alias("target"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """index through a pseudorandom permutation of 0 .. n-1: a Feistel network over the next power of four, walked until below n."""
    half = np.uint64(max(1, math.ceil(max(1, (n - 1).bit_length()) / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & mask
        for r in range(4):
            a, b = b, a ^ (_mix(b + np.uint64((seed * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        out[todo] = a << half | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def drawn(line: DataFrame, seed: int, shard_blocks: int) -> DataFrame:
    """src, n, shard, k: how many of its slots each shard gives to each source; line: src, n, planned (all draws of the source).

    Draw i is point p(i) of the line of planned draws, p a pseudorandom permutation of the line.
    """
    line = cut(running_total(line.withColumn("last", F.col("src").isNull()), [], ["last", "src"], F.col("planned"), "at"), "line")
    length, sources = line.agg(F.coalesce(F.sum("planned"), F.lit(0)), F.count("*")).first()
    cell = max(1, math.ceil(length / max(1, sources)))  # a point meets the few sources of its cell of the line
    cells = line.where("planned > 0").select("src", "n", "at", "planned", F.explode(F.sequence(F.floor(F.col("at") / cell), F.floor((F.col("at") + F.col("planned") - 1) / cell))).alias("cell"))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(i // shard_blocks), pa.array(permuted(i, length, seed))], ["shard", "u"])

    at = line.sparkSession.range(0, length, 1, max(1, math.ceil(length / TASK_DRAWS))).mapInArrow(points, "shard long, u long")
    met = at.withColumn("cell", F.floor(F.col("u") / cell)).join(cells, "cell").where("u >= at and u < at + planned")
    return met.groupBy("src", "n", "shard").agg(F.count("*").alias("k"))


def slots(plan: DataFrame, seed: int, block: int, shard_blocks: int, most: int) -> DataFrame:
    """src, block, shard, slot of all draws; plan: src, source_size, target."""
    plan = plan.where("source_size > 0").select("src", "source_size", "target", F.ceil(F.col("source_size") / block).alias("n"))
    expected = F.round(F.col("target") / (F.col("source_size") / F.col("n"))).cast("long")
    plan = cut(plan.withColumn("planned", F.least(expected, F.col("n") * most)), "plan")
    total = plan.agg(F.coalesce(F.sum("planned"), F.lit(0))).first()[0]
    counts = running_total(drawn(plan.select("src", "n", "planned"), seed, shard_blocks), ["src"], ["shard"], F.col("k"), "before")
    kinds = "src string, block long, shard long, slot long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for src, n, shard, k, start, own in zip(b["src"], b["n"], b["shard"], b["k"], b["before"], b["own_seed"]):
                j = np.arange(start, start + k)
                at = np.empty(len(j), np.int64)
                for turn in np.unique(j // n):
                    now = j // n == turn
                    at[now] = permuted(j[now] - turn * n, int(n), int(own) * most + int(turn))
                yield pd.DataFrame({"src": pd.Series([src] * len(j), dtype=object), "block": at, "shard": shard, "slot": j})

    own = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("src", F.lit("")), F.col("src").isNull()), F.lit(2**40))
    tasks = max(1, math.ceil(total / TASK_DRAWS))  # a number of its own: Spark would merge what grows a thousandfold here
    return counts.select("src", "n", "shard", "k", "before", own.alias("own_seed")).repartition(tasks, "src", "shard").mapInPandas(run, kinds)


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, most: int = MOST, text: str = "text", key: str = "doc_id", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: key, src, row, size, source_size, target. spans: key, row, shard, slot, start, words: which words of which row a slot reads.
    """
    sized = cut(sizes(docs, text, key, source), "sizes")
    plan = cut(targets(sized, most), "targets")
    named = sized.join(plan, sized["src"].eqNullSafe(plan["src"])).drop(plan["src"])
    stream = running_total(sized.where("size > 0"), ["src"], ["key", "row"], F.col("size"), "at")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = stream.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("at"), F.col("size"))
    parts = parts.select("key", "row", F.col("src").alias("of"), F.col("block").alias("b"), start.alias("start"), (end - start).alias("words"))
    draws = slots(plan, seed, block, shard_blocks, most)
    # Spark knows the sizes of counts and of documents, not what they grow to here: either side would pass for small and go through the driver.
    spans = draws.hint("merge").join(parts, draws["src"].eqNullSafe(parts["of"]) & (F.col("block") == F.col("b")))
    return named, spans.select("key", "row", "shard", "slot", "start", "words")


def taken(docs: DataFrame, **options) -> DataFrame:
    """key, size, source_size, target, taken: of each row, how many words the mix takes, repeats counted."""
    named, spans = mix(docs, **options)
    used = spans.groupBy("row").agg(F.sum("words").alias("taken"))
    return named.join(used, "row", "left").select("key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", length: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: for each pass over a row that reads some of its words, a row with these words.

    Words keep the blanks between them; where words were left out, a line break stands. length, if docs has it, is that of the new text.
    """
    rest = [F.col(c) for c in docs.columns if c != text]
    held = cut(docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("_doc"), F.col(text).cast("string").alias("_text"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.monotonically_increasing_id().alias("_row")), "rows")
    named, spans = mix(held, text="_text", key="_key", source="_source", **options)
    n = named.select("row", F.ceil(F.col("source_size") / options.get("block", BLOCK)).alias("n")).where("n > 0")
    passes = spans.join(n, "row").select("row", F.floor(F.col("slot") / F.col("n")).alias("turn"), "start", "words")
    parts = passes.groupBy("row", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("_parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                t, ps = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                places = [m.span() for m in WORD.finditer(t)]
                runs: list[list[int]] = []
                for p in ps:
                    if runs and runs[-1][1] == p["start"]:
                        runs[-1][1] += p["words"]
                    else:
                        runs.append([p["start"], p["start"] + p["words"]])
                out.append("\n".join(t[places[x][0] : places[y - 1][1]] for x, y in runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["_doc", "_text"])

    kind = held.schema["_doc"].dataType.simpleString()
    made = held.join(parts, held["_row"] == parts["row"]).select("_doc", "_text", "_parts").mapInArrow(run, f"_doc {kind}, _text string")
    new = {text: F.col("_text"), length: F.char_length("_text").cast("long")}
    return made.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
