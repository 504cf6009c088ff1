"""Live streams with keyed state and event-time timers: pairing of two streams, throttles, idle flushes, items that expire.

All go by the rows' own times (milliseconds), so a replay gives what the live run gave, however rows are dealt into batches: what is due
before a row is emitted before it, and a timer emits it where no further row of the key comes. State holds one key's open
items alone. Rows of a key must come in order of batches, as a channel keeps its order; within a batch they are sorted.

"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

IDLE, INTERIM, PREVIEW, PREVIEW_CHARS, PENDING = 2500, 350, 1200, 8, 3_600_000
#: How far rows of different keys may lie apart between batches. Timers wait so much longer; the times that they tell do not change.
LATENESS = "10 seconds"


def _rows(parts: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """All rows of the key's batch, sorted."""
    return sorted((r for p in parts for r in zip(*(p[c] for c in columns))), key=lambda r: r[:2])


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns.split())


class Pairing(StatefulProcessor):
    """Two queues of a key; heads without a partner wait, over batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queues = [handle.getListState(name, "place long, value string") for name in ("lefts", "rights")]
        self.met = handle.getValueState("met", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[list[tuple]] = [[], []]
        for place, right, value in _rows(rows, "place", "is_right", "value"):
            new[int(right)].append((int(place), value))
        both = [[tuple(x) for x in q.get()] + more for q, more in zip(self.queues, new)]
        n, before = min(map(len, both)), self.met.get()[0] if self.met.exists() else 0
        for queue, held in zip(self.queues, both):
            queue.put(held[n:]) if held[n:] else queue.clear()
        self.met.update((before + n,))
        yield _frame([(key[0], before + i + 1, both[0][i][1], both[1][i][1]) for i in range(n)], "key n left right")


class Throttle(StatefulProcessor):
    """A row passes if it is forced, or long enough and late enough after the last one that passed."""

    def __init__(self, every: int, least: int):
        self.every, self.least = every, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for at, row, text, forced in _rows(rows, "at", "row", "text", "forced"):
            if forced or (len((text or "").strip()) >= self.least and (last is None or at - last >= self.every)):
                last = int(at)
                out.append((key[0], last, int(row), text))
        if last is not None:
            self.last.update((last,))
        yield _frame(out, "key at row text")


class Expiry(StatefulProcessor):
    """An item that is asked for and answered; asking again does not give it more time."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.item = handle, handle.getValueState("item", "asked long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, told = self.item.get() if self.item.exists() else (None, False)
        out, first = [], asked
        for at, _, kind in _rows(rows, "at", "row", "kind"):
            at = int(at)
            if asked is not None and not told and at > asked + self.limit:
                out.append((key[0], asked, asked + self.limit, "expired"))
                told = True
            if kind == "ask" and asked is None:
                asked, told = at, False
            elif kind == "answer" and asked is not None:
                out.append((key[0], asked, at, "late" if at > asked + self.limit else "accepted"))
                asked, told = None, False
        if first != asked or told:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if asked is None:
            self.item.clear()
        else:
            self.item.update((asked, told))
            if not told:
                self.handle.registerTimer(asked + self.limit + 1)
        yield _frame(out, "key asked at verdict")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, told = self.item.get() if self.item.exists() else (None, True)
        if not told:
            self.item.update((asked, True))
        yield _frame([] if told else [(key[0], asked, asked + self.limit, "expired")], "key asked at verdict")


class Idle(StatefulProcessor):
    """Open text of final tokens, flushed when none has come for a while and no interim tail is forming."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "text string, last long, tail string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, last, tail, n = self.open.get() if self.open.exists() else ("", 0, "", 0)
        out = []
        for at, _, final, token in _rows(rows, "at", "row", "final", "token"):
            at, token = int(at), token or ""
            if text.strip() and not tail.strip() and at - last > self.idle:
                out.append((key[0], n, last, text.strip()))
                text, n = "", n + 1
            if final:
                text, last, tail = text + token, at, ""
            else:
                tail = token
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if text.strip() and not tail.strip():
            self.handle.registerTimer(last + self.idle + 1)
        self.open.update((text, last, tail, n))
        yield _frame(out, "key n last text")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, last, tail, n = self.open.get()
        self.open.update(("", last, tail, n + 1))
        yield _frame([(key[0], n, last, text.strip())], "key n last text")


class Precedence(StatefulProcessor):
    """A key's polled segments pass as they are new or changed, until its direct source speaks; from then on only that one does.

    The state is asked once a segment and batch and told what changed once at the batch's end, as each call crosses to the JVM.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.direct = handle.getValueState("direct", "on boolean")
        self.seen = handle.getMapState("seen", "idx long", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, out = self.direct.exists(), []
        direct, known, now, changed = before, not before and self.seen.exists(), {}, {}
        for at, row, own, idx, text in _rows(rows, "at", "row", "direct", "idx", "text"):
            idx, text = int(idx), text or ""
            direct = direct or bool(own)
            if direct:
                passes = bool(own)
            else:
                if idx not in now:
                    now[idx] = self.seen.getValue((idx,))[0] if known and self.seen.containsKey((idx,)) else None
                passes = now[idx] != text
                if passes:
                    now[idx] = changed[idx] = text
            if passes:
                out.append((key[0], int(at), int(row), idx, text))
        if direct and not before:
            self.direct.update((True,))
            if known:
                self.seen.clear()  # nothing is polled any more
        elif not direct:
            for idx, text in changed.items():
                self.seen.updateValue((idx,), (text,))
        yield _frame(out, "key at row idx text")


class Fresh(StatefulProcessor):
    """Results of slow work on a text that goes on growing: one counts while the text still begins with what it was made for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", "text string, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (now, version), out = self.text.get() if self.text.exists() else ("", 0), []
        for at, row, result, text, made_for in _rows(rows, "at", "row", "result", "text", "made_for"):
            if result:
                out.append((key[0], int(at), int(row), version, now.startswith(made_for or ""), text))
                continue
            version += not (text or "").startswith(now)
            now = text or ""
        self.text.update((now, version))
        yield _frame(out, "key at row version fresh text")


def _keyed(stream: DataFrame, processor: StatefulProcessor, out: str, lateness: str | None = None) -> DataFrame:
    """lateness: for timers by the column ``at``, how far a batch's rows may lie behind those of earlier batches; Spark leaves out rows that lie further."""
    if lateness:
        stream = stream.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", lateness)
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime" if lateness else "None")


def paired(stream: DataFrame) -> DataFrame:
    """[ST09 ST05 ST08] key, n, left, right: the n-th left row of a key with its n-th right one, whichever side comes first.

    stream: key long, place long (order on its side), is_right boolean, value string. The sides are cut into rows apart from each
    other, so neither may be cut by gaps, idle time or length alone; what has no partner yet waits in the key's queue.
    """
    return _keyed(stream.select("key", "place", "is_right", "value"), Pairing(), "key long, n long, left string, right string")


def throttled(stream: DataFrame, every: int = INTERIM, least: int = 1) -> DataFrame:
    """[ST07 ST14] key, at, row, text of the rows that pass; stream: key long, at long, row long (order at equal times), text string, forced boolean.

    Previews of a translation are throttled with PREVIEW and PREVIEW_CHARS.
    """
    return _keyed(stream.select("key", "at", "row", "text", "forced"), Throttle(every, least), "key long, at long, row long, text string")


def expiring(stream: DataFrame, limit: int = PENDING, lateness: str = LATENESS) -> DataFrame:
    """[ST19] key, asked, at, verdict; stream: key long, at long, row long, kind string (ask, answer, or else: only tells the time).

    An answer within ``limit`` of the first asking is ``accepted``, a later one ``late``; either ends the item. An item open for longer is once
    ``expired``. An answer without an item gives nothing.
    """
    return _keyed(stream.select("key", "at", "row", "kind"), Expiry(limit), "key long, asked long, at long, verdict string", lateness)


def idle_flushed(stream: DataFrame, idle: int = IDLE, lateness: str = LATENESS) -> DataFrame:
    """[ST04] key, n, last, text of segments that ended by silence; stream: key long, at long, row long, final boolean, token string.

    A token that isn't final is the interim tail, which the next one replaces and a final one ends: while there is one, nothing is flushed.
    """
    return _keyed(stream.select("key", "at", "row", "final", "token"), Idle(idle), "key long, n long, last long, text string", lateness)


def preferred(stream: DataFrame) -> DataFrame:
    """[ST11] key, at, row, idx, text that pass; stream: key long, at long, row long (order at equal times), direct boolean, idx long, text string.

    All direct rows pass. Polled ones pass if their segment is new or its text another one, and none once the key has a direct row.
    """
    return _keyed(stream.select("key", "at", "row", "direct", "idx", "text"), Precedence(), "key long, at long, row long, idx long, text string")


def fresh_results(stream: DataFrame) -> DataFrame:
    """[ST13] key, at, row, version, fresh, text of every result; stream: key long, at long, row long, result boolean, text string, made_for string.

    A row that isn't a result sets its key's text (null or empty: it is gone). A result is fresh while that text begins with ``made_for``, so
    growth alone does not outdate it. version counts the texts that did not continue the one before; results are told with the one they met.
    """
    return _keyed(stream.select("key", "at", "row", "result", "text", "made_for"), Fresh(), "key long, at long, row long, version long, fresh boolean, text string")


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table as a stream; files: at most so many a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    # A stream reads a folder or a glob; for a single file, a glob matches its name alone.
    return reader.parquet(path if files else f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame) -> DataFrame:
    """What the stream gives for all that is there now, as a table."""
    spark = stream.sparkSession
    run = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stream.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{run}/out")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
