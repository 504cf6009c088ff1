"""Helpers that the operators share: tables, cut lineage, distributed running totals."""

from __future__ import annotations

import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of the filter that ``maybe_in`` broadcasts: 2 MB of bits, as at most 2^18 rows of two numbers.
BITS = 1 << 24


#: Bytes that a Python worker gets at a time: a session that names no size of its own would send up to 64 MB to each.
ARROW = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, and bound Arrow batches where the session leaves their size open."""
    sc = spark.sparkContext
    if ARROW[0] not in spark.conf.getAll:
        spark.conf.set(*ARROW)
    if not any("ledgerloom-pkg" in str(f) for f in sc.listFiles):
        root = Path(__file__).resolve().parents[2]
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/ledgerloom-pkg", "zip", root, "ledgerloom")
        sc.addPyFile(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; also ships this package to the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local master may do without a named one; a cluster may not."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ledgerloom.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("ledgerloom.shared.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Seconds between two collections of the driver's garbage, and when the last one was.
RELEASE_S = 15
_released = 0.0


def release(spark: SparkSession) -> None:
    """Let the driver give back what plans of tables already written hold: its heap grows with them, and Spark drops their shuffles and broadcasts only once they are collected.

    At most once in RELEASE_S. What ``spark.cleaner.periodicGC.interval`` does twice an hour, and can't be set on a running session.
    """
    global _released
    if time.monotonic() - _released >= RELEASE_S:
        gc.collect()  # Python's frames hold their plans in the JVM
        # What Python let go is told to the JVM by a thread that sleeps up to a second; it would come too late.
        client = spark.sparkContext._gateway._gateway_client
        waiting = getattr(client, "finalizer_deque", None)
        while waiting:
            try:
                task = waiting.pop()
            except IndexError:  # that thread took the last one
                break
            if not isinstance(task, tuple):  # the word to end
                waiting.append(task)
                break
            task[0].garbage_collect_object(task[1], False)
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


#: Tables that ``cut`` has written inside of the innermost ``settled``.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("_WRITTEN", default=None)


def cut(df: DataFrame, what: str = "cut", row_group: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    row_group: bytes of a row group, for tables of large rows, as a reader holds that much at a time.
    """
    path = new_path(df.sparkSession, what)
    held = _WRITTEN.get()
    if held is not None:
        held.append(path)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], what: str = "cut") -> DataFrame:
    """``cut(make(), what)``; all other tables that make has cut are deleted then, so nothing but its result may read them."""
    outer = _WRITTEN.set([])
    try:
        path, df = new_path(spark, what), make()
        df.write.parquet(path)
    finally:
        inner = _WRITTEN.get()
        _WRITTEN.reset(outer)
        for old in inner:
            delete(spark, old)
    held = _WRITTEN.get()
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sample_rows(docs: DataFrame, labels: DataFrame, most: dict[int, int], row_bytes: int, all_bytes: int, held_out=None, text: str = "text", key: str = "doc_id", label: str = "label") -> tuple[DataFrame, float]:
    """(id, y, t of a bounded sample, share of label 1 among all labels), by ids whose label is 0 or 1 and that are not held out.

    In an order by hash, at most most[y] ids of each label; of their rows those with a text of at most row_bytes, until all_bytes
    of that label are reached. A row is used whole or not at all.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
    if held_out is not None:
        known = known.where(~held_out(F.col("id")))
    counts = dict(known.groupBy("y").agg(F.count("*")).collect())
    spread, size = F.xxhash64("id"), F.octet_length("t").cast("long")
    first = [known.where(F.col("y") == y).orderBy(spread, "id").limit(n) for y, n in most.items()]
    some = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    some = some.join(F.broadcast(first[0].union(first[1])), "id").where(size <= row_bytes)
    # The sample's rows stand in two lines, as many as their ids, but for ids that repeat.
    line = Window.partitionBy("y").orderBy(spread, "id", "t")
    rows = some.withColumn("so_far", F.sum(size).over(line)).withColumn("place", F.row_number().over(line))
    limit = F.when(F.col("y") == 1, most[1]).otherwise(most[0])
    kept = rows.where((F.col("so_far") <= all_bytes) & (F.col("place") <= limit)).select("id", "y", "t")
    return kept, counts.get(1, 0) / sum(counts.values()) if counts else 0.0


def labelled_sample(*args, **named) -> tuple[list[tuple[bytes, int]], float]:
    """((text, label) in the order of ids, share): ``sample_rows`` as a list."""
    kept, share = sample_rows(*args, **named)
    return [(t, y) for _, y, t in sorted((r["id"], r["y"], r["t"].encode()) for r in kept.collect())], share


def maybe_in(rows: DataFrame, key: str, asked: DataFrame, bits: int = BITS, name: str | None = None) -> DataFrame:
    """Rows whose key may be among asked's: all that are, and few others while asked has far fewer keys than bits.

    A filter before a shuffle, never instead of the join. Its broadcast has ``bits`` bits at most, whatever the
    input: with more keys it lets more through. With ``name``, all rows stay and get a boolean.
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    words = asked.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_slot % 64))")).alias("_bits"))
    told = rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(words), "_word", "left" if name else "inner")
    hit = F.expr("coalesce((shiftright(_bits, int(_slot % 64)) & 1) = 1, false)")
    told = told.withColumn(name, hit) if name else told.where(hit)
    return told.drop("_slot", "_word", "_bits")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | None = None, name: str = "before") -> DataFrame:
    """Add ``name``: the sum of value (default: the count) over the rows of the same keys that sort earlier.

    No key is gathered in one task: rows are dealt by range of (keys, order), summed within their range, and only
    the totals of (range, key) are put in line, at most one row of a key for each range.
    order must set rows apart, or tied rows get their totals in any order.
    """
    v = F.lit(1).cast("long") if value is None else value.cast("long")
    cols = [*keys, *order]
    dealt = cut(df.withColumn("_v", F.coalesce(v, F.lit(0))).repartitionByRange(*[F.col(c) for c in cols]).withColumn("_p", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    totals = dealt.groupBy("_p", *keys).agg(F.sum("_v").alias("_t"))
    line = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_p").alias("_p2"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_t").over(line), F.lit(0)).alias("_s"))
    on = rows["_p"] == starts["_p2"]
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(starts[f"_k{i}"])
    return rows.join(starts, on).withColumn(name, F.col("_in") + F.col("_s")).drop("_v", "_p", "_in", "_p2", "_s", *[f"_k{i}" for i in range(len(keys))])
