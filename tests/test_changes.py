"""Diffs against a plain table of common subsequences, plans against the worked example and one task after the other."""

import random
import time

import pytest
from ledgerloom.operators import changes
from pyspark.sql import functions as F


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_kept_lines_are_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(1500):
        a, b = ([r.choice("abcde"[: r.randrange(1, 6)]) for _ in range(r.randrange(12))] for _ in "ab")
        got = list(changes.kept_lines(a, b))
        assert len(got) == common(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))


def test_long_texts_of_repeated_lines():
    r = random.Random(6)
    a = [str(r.randrange(40)) for _ in range(20000)]
    b = [x for x in a if r.random() > 0.1]
    began = time.time()
    assert len(list(changes.kept_lines(a, b))) == len(b) and time.time() - began < 60


def test_diffs_of_files(spark):
    kind = "id long, text string"
    old = spark.createDataFrame([(1, "a\nb\nc\n"), (2, "same"), (3, "gone\n\n"), (4, None), (5, ""), (7, "x\n")], kind)
    new = spark.createDataFrame([(1, "a\nc\nd"), (2, "same"), (4, "n"), (5, None), (6, "come\r\nin"), (7, "x")], kind)
    got = sorted(tuple(x) for x in changes.changed_lines(old, new, "id", "text").collect())
    assert got == [(1, False, 2, "b"), (1, True, 3, "d"), (3, False, 1, "gone"), (3, False, 2, ""), (4, True, 1, "n"), (6, True, 1, "come"), (6, True, 2, "in")]
    assert sorted(tuple(x) for x in changes.version_diffs(old, new, "id", "text").collect()) == [(1, 1, 1), (3, 0, 2), (4, 1, 0), (6, 2, 0)]
    assert changes.changed_lines(old.limit(0), new.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError, match="of their own"):
        changes.changed_lines(old.union(old), new, "id", "text")


TASKS = "task string, place long, person string, grp string, role string, release long, minutes long, done boolean"


def moved(spark, rows):
    got = changes.rescheduled(spark.createDataFrame(rows, TASKS), F.lit("2026-07-27").cast("date")).collect()
    return {x.task: x for x in got}


def test_the_worked_example(spark):
    hours = {5: 8, 6: 8, 7: 12, 8: 8, 9: 8}
    got = moved(spark, [(f"NEX-{k}", k, "kien", "g", None, (k - 5) * 480, h * 60, None) for k, h in hours.items()])
    days = {k: (str(x.first_day)[5:], str(x.last_day)[5:], x.moved) for k, x in got.items()}
    assert days == {"NEX-5": ("07-27", "07-27", False), "NEX-6": ("07-28", "07-28", False), "NEX-7": ("07-29", "07-30", False), "NEX-8": ("07-30", "07-31", True), "NEX-9": ("07-31", "08-03", True)}


def test_a_late_back_end_moves_other_people(spark):
    rows = [
        ("b1", 1, "an", "g", "BE", 0, 720, False),  # half a day over
        ("f0", 2, "chi", "g", "FE", 480, 480, False),  # waits for b1: Wednesday
        ("f1", 3, "binh", "g", "FE", 0, 480, True),  # done before its back end: stays, and does not hold its person
        ("b2", 4, "chi", "h", "BE", 960, 480, False),  # chi's next: Thursday
        ("f2", 5, "binh", "h", "FE", 960, 480, False),  # waits for b2: Friday
        ("x", 6, "binh", "i", "FE", 0, 60, False),  # no back end, but behind f2
        ("late", 7, "dung", "g", "FE", 4800, 480, False),  # planned later than all that
    ]
    got = moved(spark, rows)
    assert {k: x.blocker for k, x in got.items()} == {"b1": None, "f0": "b1", "f1": "b1", "b2": None, "f2": "b2", "x": None, "late": "b1"}
    assert {k: x.begins for k, x in got.items()} == {"b1": 0, "f0": 960, "f1": 0, "b2": 1440, "f2": 1920, "x": 2400, "late": 4800}
    assert str(got["x"].first_day) == "2026-08-03" and not moved(spark, rows[:0])


def test_chains_against_one_task_after_the_other(spark):
    r = random.Random(8)
    rows = [(f"t{i}", i, f"p{r.randrange(6)}", f"g{r.randrange(8)}", r.choice(["BE", "FE", "FE"]), r.randrange(12) * 480, r.randrange(1, 20) * 60, r.random() < 0.2) for i in range(200)]
    person, back, want = {}, {}, {}
    for task, _, who, group, role, release, minutes, done in rows:
        begins = release if done else max(release, person.get(who, 0), -(-back.get(group, 0) // 480) * 480 if role == "FE" else 0)
        want[task] = begins
        if not done:
            person[who] = begins + minutes
        if role == "BE":
            back[group] = begins + minutes
    assert {k: x.begins for k, x in moved(spark, r.sample(rows, len(rows))).items()} == want


def test_tasks_without_a_blocker_are_many_tasks_work(spark):
    rows = [(i, i % 3, i // 3, i // 3, "FE", 0, 60, False) for i in range(300)]
    tasks = spark.createDataFrame(rows, "task long, place long, person long, grp long, role string, release long, minutes long, done boolean")
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        out = changes.rescheduled(tasks, F.lit("2026-07-27").cast("date"))
        assert out.where("blocker is null").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_sheets_are_read_once_in_order(spark):
    """Persons and groups have the same names in all sheets; sheets go on in the next batch."""
    r = random.Random(9)
    rows = [(f"t{i}", i, f"p{r.randrange(3)}", f"g{r.randrange(3)}", r.choice(["BE", "FE", "FE", None]), r.randrange(12) * 480, r.randrange(1, 20) * 60, r.choice([True, False, False, None]), r.choice(["x", "y", "z", None])) for i in range(300)]
    person, back, want = {}, {}, {}
    for task, _, who, group, role, release, minutes, done, sheet in rows:
        blocker, end = back.get((sheet, group), (None, 0)) if role == "FE" else (None, 0)
        begins = release if done else max(release, person.get((sheet, who), 0), -(-end // 480) * 480)
        want[task] = blocker, begins, begins + minutes, begins > release
        if not done:
            person[sheet, who] = begins + minutes
        if role == "BE":
            back[sheet, group] = task, begins + minutes
    df = spark.createDataFrame(r.sample(rows, len(rows)), "task string, place long, person string, grp string, role string, release long, minutes long, done boolean, sheet string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = changes.rescheduled(df, F.lit("2026-07-27").cast("date")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {x.task: (x.blocker, x.begins, x.ends, x.moved) for x in got} == want and len(got) == 300


def test_late_tasks_shuffles_its_lines_once_and_writes_no_table(spark, tmp_path, monkeypatch):
    from ledgerloom.plans import changes as plans

    written = []
    monkeypatch.setattr(changes, "lasting", lambda df: written.append(df) or df.localCheckpoint())
    out = plans.late_tasks(spark, "/root/testdata/sf0.001")
    assert not written and str(out._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1


def test_rounds_keep_no_older_table(spark, monkeypatch):
    made = []
    lasting = changes.lasting
    monkeypatch.setattr(changes, "lasting", lambda df: made.append(lasting(df)) or made[-1])
    rows = [(f"{k}{i}", i, f"{k}{i}", f"g{i if k == 'b' else i - 1}", "BE" if k == "b" else "FE", 0, 480, False) for i in range(1, 4) for k in "fb"]
    rows = [(t, 2 * p + (t[0] == "b"), f"p{p}", g, role, a, m, d) for t, p, _, g, role, a, m, d in rows]  # b1, then f2 and b2 of p2, then f3 and b3 of p3
    out = moved(spark, rows)
    assert out["b3"].begins == 2400 and len(made) > 3
    there = [spark._jvm.java.io.File(spark._jvm.java.net.URI(f)).exists() for df in made for f in df.inputFiles()[:1]]
    assert there == [False] * (len(there) - 1) + [True]
