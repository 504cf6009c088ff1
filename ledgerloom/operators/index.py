"""A stored inverted index with a manifest, and pointers into JSON facts.

"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SCHEMA = "inverted-index/v1"
BUCKETS, SALTS = 64, 8
K1, B = 1.5, 0.75
#: Postings that a task hands on at a time.
LOT = 100_000


class StaleIndex(ValueError):
    """The index was made from other documents."""


def input_state(docs: DataFrame, key: str, text: str) -> tuple[str, int]:
    """[K05] A digest of the rows' ids and texts, whatever their order: sums of two hashes, and their number; that number."""
    row = [F.xxhash64(F.lit(i), key, text).cast("decimal(38,0)") for i in (1, 2)]
    sums = docs.agg(F.count("*"), *[F.sum(r) for r in row]).first()
    return hashlib.sha256(",".join(str(s) for s in sums).encode()).hexdigest(), sums[0]


_WORD = re.compile("[a-z0-9]+")


def counted_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, dl, term, tf: each document's distinct words, how often they occur in it, and its number of words; counted where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, dl, term, tf = [], [], [], []

            def lot(b: pa.RecordBatch = b) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(dl, pa.int32()), pa.array(term, pa.string()), pa.array(tf, pa.int64())], ["doc", "dl", "term", "tf"])

            for i, t in enumerate(b.column(1)):
                n = Counter(_WORD.findall(t.as_py()))
                at += [i] * len(n)
                dl += [n.total()] * len(n)
                term += n
                tf += n.values()
                if len(at) >= LOT:
                    yield lot()
                    at, dl, term, tf = [], [], [], []
            yield lot()

    # Spark lowers the letters, as its SQL does.
    said = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.lower(text).alias("text"))
    return said.mapInArrow(run, f"doc {docs.schema[key].dataType.simpleString()}, dl int, term string, tf long")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, path: str, doc: str) -> DataFrame:
    return spark.read.schema(f"term string, doc {doc}, dl int, tf long, bucket int").parquet(f"{path}/postings")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> dict:
    """[K03 K05] Write postings (term, doc, tf, dl) by buckets of terms, sorted by term, and the manifest; returns the manifest.

    A bucket lies in several files, so that a frequent term is no single task's. Each row of docs has postings of its own. Documents without text have no postings but count.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
    postings = counted_words(docs, key, text).select("term", "doc", "dl", "tf", bucket_of(F.col("term")).alias("bucket"))
    postings.repartition("bucket", salt).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{path}/postings")
    kind = docs.schema[key].dataType.simpleString()
    words = stored(spark, path, kind).agg(F.sum("tf")).first()[0]
    digest, n = input_state(docs, key, text)
    manifest = {"schema": SCHEMA, "input": digest, "documents": n, "words": words or 0, "doc": kind}
    spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.text(f"{path}/manifest")  # last: without it there is no index
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    try:
        told = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:  # no file, or no JSON in it
        raise StaleIndex(f"no index at {path}") from e
    if told.get("schema") != SCHEMA:
        raise StaleIndex(f"{path} is of another schema")
    return told


def search(spark: SparkSession, path: str, words: Sequence[str], keep: int, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """[R04 R05 F21] doc, score of the best documents for the words; only their terms' buckets are read.

    With docs, an index of other documents is refused. With allowed (doc), the best are sought among the first 8 * keep.
    """
    told = manifest_of(spark, path)
    if docs is not None and input_state(docs, key, text)[0] != told["input"]:
        raise StaleIndex(f"{path} was made from other documents")
    terms = sorted({w.lower() for w in words})
    if not terms or not told["words"]:
        return spark.createDataFrame([], f"doc {told['doc']}, score double")
    buckets = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"))).collect()})
    held = stored(spark, path, told["doc"]).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    # Rows of one id and length count as one document, as in the search without an index; only the asked words' postings are shuffled for it.
    held = held.groupBy("term", "doc", "dl").agg(F.sum("tf").alias("tf"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = told["documents"], told["words"] / told["documents"]
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    best = held.join(df, "term").groupBy("doc").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc")
    if allowed is None:
        return best.limit(keep)
    return best.limit(8 * keep).join(allowed.select("doc").distinct(), "doc", "left_semi").orderBy(F.desc("score"), "doc").limit(keep)


def dereferenced(pointers: DataFrame, payloads: DataFrame, pointer: str) -> DataFrame:
    """[S19] All columns of pointers, verdict and value of ``file#a.b.c``.

    payloads: file, json, current. The path starts in the payload's ``facts``, where it has such an object, else at its root. ``found`` with the scalar
    there; ``node`` where an object or array lies there (value null); ``superseded`` where the file is not current; ``missing`` otherwise.
    """
    leaves = files.leaves(payloads.where("current"), "file", "json")
    rooted = leaves.groupBy("file").agg(F.bool_or(F.col("path").startswith("$.facts.")).alias("facts"))
    # Every place on the way to a leaf, so that a pointer meets a leaf or a node by one join.
    steps = F.regexp_extract_all("path", F.lit(r"(\.[^.\[]+|\[\d+\])"), F.lit(1))
    ways = leaves.join(rooted, "file").select("file", "value", F.when(F.col("facts"), F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))).otherwise(steps).alias("steps"), (~F.col("facts") | F.col("path").startswith("$.facts.")).alias("inside")).where("inside")
    places = ways.select("file", "value", F.size("steps").alias("n"), F.posexplode(F.transform("steps", lambda x, i: F.array_join(F.slice("steps", F.lit(1), i + 1), ""))).alias("i", "way"))
    at = places.groupBy("file", "way").agg(F.bool_or(F.col("i") + 1 < F.col("n")).alias("node"), F.max(F.when(F.col("i") + 1 == F.col("n"), F.col("value"))).alias("value"))
    asked = pointers.withColumn("_file", F.substring_index(pointer, "#", 1)).withColumn("_way", F.concat(F.lit("."), F.regexp_replace(pointer, "^[^#]*#", "")))
    known = payloads.groupBy("file").agg(F.bool_or("current").alias("_current"))
    j = asked.join(known, F.col("_file") == known["file"], "left").drop("file").join(at, (F.col("_file") == at["file"]) & (F.col("_way") == at["way"]), "left")
    verdict = F.when(~F.col("_current"), "superseded").when(F.col("node"), "node").when(F.col("way").isNotNull(), "found").otherwise("missing")
    return j.select(*pointers.columns, verdict.alias("verdict"), F.when(verdict == "found", F.col("value")).alias("value"))
