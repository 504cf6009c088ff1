"""A stored table that streams write into: the latest row of each key, in versions, by copy on write.

Rows lie in buckets by a hash of their key. A batch reads and rewrites only the buckets that its keys fall into, beside the old
ones; then one small manifest, put in place by a rename, names the folder of every bucket. Readers follow the newest manifest, so
they see a batch whole or not at all. A batch that failed before its manifest leaves no trace but unnamed files, and one that
is run again after it changes nothing, as its number is not above the newest manifest's.

"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text

BUCKETS = 64


class Store:
    """[K09 ST10 ST22] One writer at a time; ``order`` (unique within a key, or rows are compared whole) says which row of a key is the latest."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """batch, schema and folders (by bucket) of the newest version."""
        p, fs = self._fs(f"{self.path}/versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        name = f"{self.path}/versions/{manifest['batch']:020d}.json"
        (draft, fs), (final, _) = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._fs(name)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"another writer has made {name}")

    def _folders(self, manifest: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [manifest["folders"][b] for b in buckets if b in manifest["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All columns of the merged rows, and ``created``: the order of the first row of the key."""
        manifest = self.manifest()
        if manifest is None:
            raise ValueError(f"nothing has been merged into {self.path}")
        return self._folders(manifest, sorted(manifest["folders"])).drop("_batch")

    def changes(self, after: int | None = None) -> tuple[int | None, DataFrame | None]:
        """[ST12] (newest batch, rows that batches above ``after`` wrote and none overwrote since); without ``after``, the whole backlog.

        Who asks with no batch and from then on with the last one it got, and upserts what it gets, holds what the table holds, without gap,
        however many batches came between. Only buckets written since are read, whatever has been vacuumed. Nothing merged yet: two Nones.
        """
        manifest = self.manifest()
        if manifest is None:
            return None, None
        least = -1 if after is None else after
        # A folder's name begins with the batch that wrote it.
        touched = sorted(b for b, f in manifest["folders"].items() if int(f.rsplit("/", 2)[1].split("-")[0]) > least)
        return manifest["batch"], self._folders(manifest, touched).where(F.col("_batch") > least).drop("_batch")

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, self.order, "created", "_batch")]
        best = rows.groupBy(self.key).agg(F.max(F.struct(self.order, *rest, "_batch")).alias("_row"), F.min(F.struct("created", "_batch")).alias("_first"))
        # A late and older row changes what the key's row says of its first one.
        batch = F.greatest("_row._batch", "_first._batch").alias("_batch")
        return best.select(self.key, *[F.col(f"_row.{c}").alias(c) for c in (self.order, *rest)], batch, F.col("_first.created").alias("created"))

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Upsert a batch; False if it has been merged before."""
        manifest = self.manifest()
        if manifest is not None and batch <= manifest["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = self._latest(rows.withColumn("_batch", F.lit(batch).cast("long")).withColumn("created", F.col(self.order)))
        schema = fresh.schema
        if manifest is not None and StructType.fromJson(manifest["schema"]).fieldNames() != schema.fieldNames():
            raise ValueError("the batch has other columns than the stored table")
        touched = [str(r[0]) for r in fresh.select(bucket).distinct().collect()]  # at most as many as there are buckets
        old = self._folders(manifest, touched) if manifest else self.spark.createDataFrame([], schema)
        folder = f"{self.path}/data/{batch:020d}-{uuid.uuid4().hex}"
        self._latest(old.unionByName(fresh)).withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        folders = {**(manifest["folders"] if manifest else {}), **{b: f"{folder}/_bucket={b}" for b in touched}}
        self._commit({"batch": batch, "schema": json.loads(schema.json()), "folders": folders})
        return True

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge all that the stream has now, batch by batch."""
        stream.writeStream.foreachBatch(lambda rows, batch: self.merge(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def vacuum(self) -> int:
        """Delete the folders of data that the newest version does not name; how many."""
        p, fs = self._fs(f"{self.path}/data")
        named = {f.rsplit("/", 2)[1] for f in (self.manifest() or {"folders": {}})["folders"].values()}
        gone = [s.getPath() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName() not in named]
        for old in gone:
            fs.delete(old, True)
        return len(gone)


def messages(events: DataFrame, scope: Column) -> DataFrame:
    """[ST18] message_key, thread, seq, role, text, edited, deleted of a thread's events; those outside of the thread ``scope`` are left out.

    events: channel, ts, thread_ts, text, bot (boolean), subtype, edited (boolean), seq (order of arrival). A thread's first message has no
    thread_ts and belongs to it by its own ts. A deletion is an event of that subtype and stays as a row; texts lose their secrets.
    """
    of = F.coalesce(F.nullif(F.trim("thread_ts"), F.lit("")), F.trim("ts"))
    inside = events.where((F.coalesce(F.trim("ts"), F.lit("")) != "") & (of == scope))
    said = text.redact(F.coalesce("text", F.lit("")))
    return inside.select(
        F.concat_ws(":", "channel", F.trim("ts")).alias("message_key"),
        F.concat_ws(":", "channel", of).alias("thread"),
        "seq",
        F.when(F.coalesce("bot", F.lit(False)), "assistant").otherwise("user").alias("role"),
        said.alias("text"),
        F.coalesce("edited", F.lit(False)).alias("edited"),
        (F.coalesce("subtype", F.lit("")) == "message_deleted").alias("deleted"),
    )
