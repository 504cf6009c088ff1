"""Operator 3, MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct 5-word shingles (A-Z in lower case; fewer words: the whole sequence as one; none: the
empty set, which is linked with nothing). One hash of each shingle falls into one of 160 bins, the least value of a bin is
its signature, empty bins borrow from a full bin named by a fixed sequence of their own. 40 bands of 4 bins give buckets; at
similarity 0.75 a pair misses all 40 with probability 3e-7.

Documents of equal sets are one class, a node, held by its smallest id. In a bucket, the smallest class is the centre of a star, so
a bucket of n classes gives n-1 candidate edges. Where members of a bucket still lie in different components, further members
become centres, 64 times as many each round, until all such pairs have met; those of the bucket's largest component need not, as
the others meet them. So no link between classes that share a bucket is lost, and none within a component is asked for. Each set
has a mask, the bits that its shingles hash to. A bit that two masks differ in stands for a shingle that one of the sets lacks, so
pairs with more such bits than a seventh of their sizes' sum, the most that similarity 0.75 leaves room for, are left out by the join itself, without loss: of a large
group of near copies, this spares members the copies that are edited too much to be linked with them. Candidates are confirmed on
full sets of 64-bit shingle hashes, whatever their size; only texts of candidates are read and shuffled for that, each once. Components
come from rounds of large-star and small-star joins.

A row without id takes no part: no component, and it is kept. Classes that share an id (rows of one id with different
texts) are linked; each row is returned. Columns other than the id and the text are not read, so their names may clash with any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_in, running_total, settled

WORDS = 5
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Bytes of text that are hashed together.
BATCH_BYTES = 1_000_000
#: Copies of a bucket's centres, so that a hot bucket meets them in several tasks.
SALTS = 8
#: How many times more centres a bucket of mixed components gets each round.
GROWTH = 64
#: 64-bit words of a mask.
MASK_WORDS = 32

_r = np.random.default_rng(20240229)
_LETTER = _r.integers(0, 2**64, 256, np.uint64)
_LETTER[[32, *range(9, 14)]] = 0
_PLACE = _r.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: The bins that an empty bin asks, in turn.
_ASKED = _r.integers(0, BINS, (4000, BINS))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Factors of a byte by its place in the word, without a pattern: powers of one number would collide on some words whatever the number.
_WEIGHT = _mixed(np.arange(1 << 12, dtype=np.uint64) + np.uint64(int(_r.integers(0, 2**62)))) | np.uint64(1)


def _weights(place: np.ndarray) -> np.ndarray:
    out = _WEIGHT[np.minimum(place, len(_WEIGHT) - 1)]
    far = np.flatnonzero(place >= len(_WEIGHT))
    out[far] = _mixed(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return out


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if len(starts):
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        sums = np.add.reduceat(_LETTER[raw[starts[0] :]] * _weights(place), starts - starts[0])  # blanks add nothing
    else:
        sums = np.empty(0, np.uint64)
    word = _mixed(sums + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, ends_at - [len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends_at)
    n = len(word)
    shingle = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        shingle += word[k : n - WORDS + 1 + k] * _PLACE[k] if n >= WORDS else shingle
    shingle = _mixed(shingle)
    out = []
    for a, b in zip(first, last):
        if b - a >= WORDS:
            out.append(np.unique(shingle[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mixed((word[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_digest(s: np.ndarray) -> str:
    """The class of a set."""
    return f"{len(s)}-{int(s.sum(dtype=np.uint64)):x}-{int(_mixed(s + np.uint64(1)).sum(dtype=np.uint64)):x}"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The densified signature of each set that isn't empty; zeros for an empty one."""
    sig, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)  # grows with the hash: the first of a bin is its least
        at = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
        sig[i, bins[at].astype(np.int64)] = s[at]
        full[i, bins[at].astype(np.int64)] = True
    row, bin_ = np.nonzero(~full & full.any(1, keepdims=True))
    turn = 0
    while len(row):
        asked = _ASKED[turn % len(_ASKED)][bin_]
        found = full[row, asked]
        sig[row[found], bin_[found]] = sig[row[found], asked[found]]
        row, bin_ = row[~found], bin_[~found]
        turn += 1
    return sig


def masks(sets: list[np.ndarray]) -> np.ndarray:
    """MASK_WORDS words of bits for each set: those that its shingles hash to."""
    out = np.zeros((len(sets), MASK_WORDS * 8), np.uint8)
    for i, s in enumerate(sets):
        bits = np.zeros(MASK_WORDS * 64, np.uint8)
        bits[(s % np.uint64(MASK_WORDS * 64)).astype(np.int64)] = 1
        out[i] = np.packbits(bits)
    return out.view(np.int64)


def _batches(it: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of about equal bytes."""
    for b in it:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
        for at, end in zip(edges, edges[1:]):
            held = b.slice(at, end - at)
            yield held, [t or b"" for t in held.column(column).cast(pa.binary()).to_pylist()]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)))


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, class (a digest of the set), buckets, mask."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _batches(it, 1):
            sets = shingle_sets(texts)
            sig = signatures(sets)
            band = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                band = _mixed(band + sig[:, r::ROWS] + np.uint64(r + 1))
            band = _mixed(band + np.arange(1, BANDS + 1, dtype=np.uint64))
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array([set_digest(s) for s in sets], pa.string()), _lists(list(band)), _lists(list(masks(sets)))], ["doc_id", "n_shingles", "class", "buckets", "mask"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, class string, buckets array<long>, mask array<long>")


def full_sets(docs: DataFrame, asked: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """node, shingles (64-bit hashes) of each asked (node, rep, class); texts of other documents are left out before the shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _batches(it, 1):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_digest(s) for s in sets], pa.string()), _lists(sets)], ["rep", "class", "shingles"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.col(text).cast("string"))
    sets = maybe_in(rows, "rep", asked).mapInArrow(run, "rep long, class string, shingles array<long>")
    return sets.join(asked, ["rep", "class"]).dropDuplicates(["rep", "class"]).select("node", "shingles")


def may_be_alike(n: Column, mask: Column, m: Column, other: Column) -> Column:
    """Whether masks leave it open that sets of n and m shingles have a similarity of 0.75."""
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    first = sum((differ(F.get(mask, F.lit(i)), F.get(other, F.lit(i))) for i in range(MASK_WORDS // 4)), F.lit(0))  # leaves few pairs to the whole masks
    return (7 * first <= n + m) & (7 * F.aggregate(F.zip_with(mask, other, differ), F.lit(0), lambda total, x: total + x) <= n + m)


def alike(x: Column, y: Column) -> Column:
    """Whether 100 * intersection >= 75 * union of two sets."""
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= 75 * (F.size(x) + F.size(y) - both)


class Sets:
    """The full sets of the nodes asked for so far; each text is read for it once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, text: str, key: str):
        self.docs, self.nodes, self.text, self.key, self.sets = docs, nodes, text, key, None

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are alike."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            asked = asked.join(self.sets.select("node"), "node", "left_anti")
        asked = cut(self.nodes.join(asked, "node", "left_semi"), "asked")
        more = cut(full_sets(self.docs, asked, self.text, self.key), "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        of = lambda c: self.sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
        # b spreads; a may be a hot centre, whose pairs adaptive execution splits.
        return cut(pairs.join(of("b"), "b").join(of("a"), "a").where(alike(F.col("s_a"), F.col("s_b"))).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, component of every node of links (a, b): the smallest node that it reaches."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # Done when each node with an edge to a smaller one has no other edge.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v"), F.lit(0)))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)").take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    return settled(docs.sparkSession, lambda: _near_duplicates(docs, text, key), "near_duplicates")


def _near_duplicates(docs: DataFrame, text: str, key: str) -> DataFrame:
    rows = cut(sketches(docs, text, key), "sketches")
    live = rows.where("n_shingles > 0 and doc_id is not null")
    classes = cut(live.groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    first = classes.groupBy("rep").agg(F.min("class").alias("first"))
    # A node's number is its smallest id; of classes with the same smallest id, all but one are numbered by a hash.
    nodes = cut(classes.join(first, "rep").select("class", "rep", F.when(F.col("class") == F.col("first"), F.col("rep")).otherwise(F.xxhash64("class")).alias("node")), "nodes")
    same = live.groupBy("doc_id").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other")
    numbers = lambda c, n: nodes.select(F.col("class").alias(c), F.col("node").alias(n))
    same = live.select("doc_id", "class").join(same.select("doc_id", "one"), "doc_id").where("class <> one").select("one", "class").distinct()
    same = same.join(numbers("one", "a"), "one").join(numbers("class", "b"), "class").select("a", "b")

    held = live.join(nodes, [live["doc_id"] == nodes["rep"], live["class"] == nodes["class"]]).dropDuplicates(["node"])
    held = cut(held.select("node", "n_shingles", "buckets", "mask"), "held")
    members = held.select("node", "n_shingles", F.explode(F.array_distinct("buckets")).alias("bucket"))
    centres = members.groupBy("bucket").agg(F.count("*").alias("k"), F.min(F.struct("node", "n_shingles")).alias("c")).where("k > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    centres = centres.select("bucket", F.col("c.node").alias("a"), F.col("c.n_shingles").alias("n_a"), salts.alias("salt"))
    stars = cut(members.withColumn("salt", salt).join(centres, ["bucket", "salt"]).drop("salt"), "stars")
    size = lambda x, y: 100 * F.least(x, y) >= 75 * F.greatest(x, y)
    met = stars.where((F.col("a") != F.col("node")) & size(F.col("n_shingles"), F.col("n_a"))).select("a", F.col("node").alias("b")).distinct()
    side = lambda c: held.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("mask").alias(f"m_{c}"))
    pairs = cut(met.join(side("b"), "b").join(side("a"), "a").where(may_be_alike(F.col("n_a"), F.col("m_a"), F.col("n_b"), F.col("m_b"))).select("a", "b"), "pairs")
    sets = Sets(docs, nodes, text, key)
    links = sets.confirm(pairs).union(same)
    found = cut(components(links), "components")

    of_each = lambda df: df.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = of_each(stars)
    # The largest component of each bucket that holds several.
    largest = told.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "component"))["component"].alias("largest"), F.count("*").alias("parts"))
    apart = cut(told.join(largest.where("parts > 1").select("bucket", "largest"), "bucket").select("bucket", "node", "n_shingles", "a", (F.col("component") != F.col("largest")).alias("outside")), "apart")
    places = running_total(apart.where("outside").select("bucket", "node"), ["bucket"], ["node"], name="place").select("bucket", "node", (F.col("place") + 1).alias("place"))
    ranked = cut(apart.drop("outside").join(held.select("node", "mask"), "node").join(places, ["bucket", "node"], "left"), "ranked")
    last, turn = ranked.agg(F.max("place")).first()[0] or 0, 0
    while turn < last:
        told = of_each(ranked).withColumn("salt", salt)
        then, turn = turn, GROWTH * max(turn, 1)
        heads = told.where((F.col("place") > then) & (F.col("place") <= turn) & (F.col("node") != F.col("a")))
        heads = heads.select(F.col("bucket").alias("of"), F.col("node").alias("h"), F.col("n_shingles").alias("n_h"), F.col("mask").alias("mask_h"), F.col("component").alias("of_h"), F.col("place").alias("at_h"), salts.alias("salt_h"))
        apart = (told["bucket"] == heads["of"]) & (told["salt"] == heads["salt_h"]) & (F.col("component") != F.col("of_h")) & (F.coalesce("place", F.lit(last + 1)) > F.col("at_h"))
        met = told.join(heads, apart & size(F.col("n_shingles"), F.col("n_h")) & may_be_alike(F.col("n_shingles"), F.col("mask"), F.col("n_h"), F.col("mask_h")))
        fresh = cut(met.select(F.least("h", "node").alias("a"), F.greatest("h", "node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not fresh.take(1):
            continue
        pairs = pairs.union(fresh)
        more = sets.confirm(fresh)
        if more.take(1):
            links = links.union(more)
            found = cut(components(links), "components")

    label = found.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = nodes.join(found, "node", "left").join(label, "component", "left").select("class", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "class").join(cut(named, "named"), "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
