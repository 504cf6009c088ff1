"""What a change leads to: lines that differ between two versions, and plans that move when a task is late.

"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lookup import forget, lasting

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

DAY_MINUTES = 480


# --- versions -----------------------------------------------------------------


def _prefixes(a: list, b: list) -> list[int]:
    """For each i, the length of the longest common subsequence of a[:i] and b; a bit of one number for each line of a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    out, n = [0], 0
    for c in reversed(bin(row | 1 << len(a))[3:]):
        n += c == "0"
        out.append(n)
    return out


def kept_lines(a: list, b: list) -> Iterator[tuple[int, int]]:
    """Places in a and in b of a longest common subsequence, in order: halves of b meet where both sides' lengths add up to most.

    Memory is linear in the lines; the time is their product over the machine's word, less what both have in common at the ends.
    """
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        tail = 0
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            yield a0, b0
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1, tail = a1 - 1, b1 - 1, tail + 1
        if tail:
            work.append((a1, a1 + tail, b1, b1 + tail))  # alike throughout: given after what lies before it
        if a0 == a1 or b0 == b1:
            continue
        if b1 - b0 == 1:
            if b[b0] in a[a0:a1]:
                yield a.index(b[b0], a0, a1), b0
            continue
        half, part = (b0 + b1) // 2, a[a0:a1]
        left, right = _prefixes(part, b[b0:half]), _prefixes(part[::-1], b[half:b1][::-1])
        cut = max(range(len(part) + 1), key=lambda i: left[i] + right[len(part) - i])
        work += [(a0 + cut, a1, half, b1), (a0, a0 + cut, b0, half)]


def changed_lines(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """[J06] key, added (boolean), place (from 1, in its own version), line: what must be removed from the old text and added to make the new one.

    As few lines as can be; of several such choices, one that reruns repeat. Files are matched by key, one row each (two of them with one key are
    an error, as is a null key); a file of one side alone, or with a null text, counts as empty there. Equal texts give no rows.
    """
    for side in (old, new):
        if side.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).take(1):
            raise ValueError(f"files without {key} of their own")
    pairs = old.select(key, F.col(text).alias("old")).join(new.select(key, F.col(text).alias("new")), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, before, after in zip(batch.column("key"), batch.column("old"), batch.column("new")):
                a, b = (before.as_py() or "").splitlines(), (after.as_py() or "").splitlines()
                same = list(kept_lines(a, b))
                gone, come = sorted(set(range(len(a))) - {i for i, _ in same}), sorted(set(range(len(b))) - {j for _, j in same})
                columns = [[k.as_py()] * (len(gone) + len(come)), [False] * len(gone) + [True] * len(come), [i + 1 for i in gone + come], [a[i] for i in gone] + [b[j] for j in come]]
                kinds = (batch.schema.field("key").type, pa.bool_(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "added", "place", "line"])

    kind = old.schema[key].dataType.simpleString()
    return pairs.select(F.col(key).alias("key"), "old", "new").mapInArrow(run, f"key {kind}, added boolean, place long, line string").withColumnRenamed("key", key)


def version_diffs(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """[J06] key, added_lines, removed_lines of the files whose lines differ."""
    return changed_lines(old, new, key, text).groupBy(key).agg(F.count_if("added").alias("added_lines"), F.count_if(~F.col("added")).alias("removed_lines"))


# --- plans --------------------------------------------------------------------


def working_day(monday: Column, k: Column) -> Column:
    """The date of the k-th working day from a Monday on."""
    return F.date_add(monday, (k + 2 * F.floor(k / 5)).cast("int"))


def _in_order(tasks: DataFrame, per_day: int) -> DataFrame:
    """task, blocker, begins, ends, release of tasks whose persons and groups are of one sheet each: a sheet's tasks are read once, in the order of their places."""
    line = Window.partitionBy("sheet").orderBy("place")
    role = lambda r: F.coalesce(F.col("role") == r, F.lit(False))
    # The window deals rows by sheet and sorts them, if they don't lie so already; its number tells where a sheet begins.
    rows = tasks.withColumn("_n", F.row_number().over(line)).select("task", "release", "_n", "person", "grp", role("BE").alias("_be"), role("FE").alias("_fe"), "minutes", F.coalesce("done", F.lit(False)).alias("_done"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict = {}
        back: dict = {}
        for b in batches:
            blockers, begins, ends = [], [], []
            for task, release, n, person, grp, be, fe, minutes, done in zip(*(c.to_pylist() for c in b.columns)):
                if n == 1:
                    free, back = {}, {}  # when a person's last open task ends, and a group's last back end with the morning after it
                blocker, morning = back.get(grp, (None, None)) if fe else (None, None)
                at = release
                if not done:
                    for x in (morning, free.get(person)):
                        if x is not None and (at is None or x > at):
                            at = x
                end = None if at is None or minutes is None else at + minutes
                if not done and end is not None:
                    free[person] = end
                if be:
                    back[grp] = task, None if end is None else -(-end // per_day) * per_day
                blockers.append(blocker)
                begins.append(at)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blockers, b.column(0).type), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), b.column(1)], ["task", "blocker", "begins", "ends", "release"])

    kind = tasks.schema["task"].dataType.simpleString()
    return rows.withColumn("release", F.col("release").cast("long")).mapInArrow(run, f"task {kind}, blocker {kind}, begins long, ends long, release long")


def rescheduled(tasks: DataFrame, monday: Column, per_day: int = DAY_MINUTES) -> DataFrame:
    """[G14] task, blocker, begins, ends, first_day, last_day, moved of all tasks once late ones have pushed the others, to the fixpoint.

    tasks: task, place long (a sheet's order, told apart within a person and a group), person, grp, role, release long (planned or actual start, in working
    minutes from the Monday's morning), minutes long (needed, as last estimated), done boolean (stays where it is, and holds nobody up but by its end).
    An FE task waits for the nearest BE task before it in its group and begins the working day after that one ends; a person's open tasks follow one
    another in the order of their places, without a gap but for waiting or a later planned start. Both kinds of waiting point back in place, so it ends: a round
    passes on what the last one moved, by one join and one window, until nothing moves; there are as many as people wait for one another in a row.

    With a column sheet, a person and a group are of one sheet (the same name in another is somebody else): one shuffle by sheet and one reading in
    place of the rounds, and no tables between them.
    """
    if "sheet" in tasks.columns:
        t = _in_order(tasks, per_day)
    else:
        t = _in_rounds(tasks, per_day)
    first = F.floor(F.col("begins") / per_day)
    last = F.greatest(F.ceil(F.col("ends") / per_day) - 1, first)
    return t.select("task", "blocker", "begins", "ends", working_day(monday, first).alias("first_day"), working_day(monday, last).alias("last_day"), (F.col("begins") > F.col("release")).alias("moved"))


def _in_rounds(tasks: DataFrame, per_day: int) -> DataFrame:
    """As ``_in_order``, of any tasks; two tables at a time are kept."""
    of_group, so_far = Window.partitionBy("grp").orderBy("place"), Window.partitionBy("person", "done").orderBy("place")
    back_end = F.last(F.when(F.col("role") == "BE", F.col("task")), ignorenulls=True).over(of_group.rowsBetween(Window.unboundedPreceding, -1))
    t = tasks.select("task", "place", "person", "grp", "role", "release", "minutes", F.coalesce("done", F.lit(False)).alias("done"))
    t = t.withColumn("blocker", F.when(F.col("role") == "FE", back_end))
    # Hours of a person's open tasks before this one: a task ends at the latest of (release - hours before it) so far, and all hours up to it.
    t = lasting(t.withColumn("before", F.when(F.col("done"), 0).otherwise(F.sum("minutes").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) - F.col("minutes"))).withColumn("ready", F.col("release")))
    while True:
        held, old = t.where("not done").select(F.col("blocker").alias("_on")).where("_on is not null").distinct(), t
        begins = F.when(F.col("done"), F.col("release")).otherwise(F.max(F.col("ready") - F.col("before")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
        t = t.withColumn("begins", begins).withColumn("ends", F.col("begins") + F.col("minutes"))
        morning = t.join(held, F.col("task") == F.col("_on"), "left_semi").select(F.col("task").alias("_on"), (F.ceil(F.col("ends") / per_day) * per_day).cast("long").alias("_ready"))
        # Tasks without a blocker have keys of their own, as rows with a null key would all go to one task.
        own = F.when(F.col("blocker").isNull(), F.struct(F.lit(True).alias("none"), F.col("task").alias("on"))).otherwise(F.struct(F.lit(False).alias("none"), F.col("blocker").alias("on")))
        now = t.withColumn("_own", own).join(morning.select("_ready", F.struct(F.lit(False).alias("none"), F.col("_on").alias("on")).alias("_on")), F.col("_own") == F.col("_on"), "left").drop("_on", "_own")
        waits = ~F.col("done") & (F.col("_ready") > F.col("ready"))
        t = lasting(now.withColumn("_up", F.coalesce(waits, F.lit(False))).withColumn("ready", F.when(waits, F.col("_ready")).otherwise(F.col("ready"))).drop("_ready"))
        forget(old)
        if not t.where("_up").take(1):
            break
        t = t.drop("_up", "begins", "ends")
    return t
