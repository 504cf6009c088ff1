from ledgerloom.operators import reports
from pyspark.sql import functions as F


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_chunks_end_only_at_boundaries(spark):
    texts = ["a" * 12, "aaaa\n\nbbbb\n\ncc", "aaaa\r\n\r\nbbbb\r\n[[page 2]]\r\ncc", "", "aaaaaaa  b", "\n\n\n\n\n\n\n\n"]

    def brute(text, limit=5):
        starts, at = [0], 0
        for line in text.splitlines(keepends=True):
            marker = line.strip().startswith("[[page ") and line.strip().endswith("]]")
            if (marker or not line.strip()) and at - starts[-1] >= limit:
                starts.append(at)
            at += len(line)
        return starts

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(reports.chunk_starts(F.col("t"), 5)).collect()] == [brute(t) for t in texts]
    assert brute(texts[2]) == [0, 6, 14]


def test_chapters_keep_the_last_of_each_number_in_increasing_order(spark):
    heads = spark.createDataFrame([("d", 1, 5, "toc"), ("d", 1, 100, "one"), ("d", 3, 300, "three"), ("d", 2, 350, "back"), ("d", 4, 400, "four"), ("e", 7, 1, "only")], "doc string, number int, start long, title string")
    marks = reports.chapter_marks(heads)
    assert rows(marks.select("doc", "number", "title"), "doc", "start") == [("d", 1, "one"), ("d", 3, "three"), ("d", 4, "four"), ("e", 7, "only")]
    docs = spark.createDataFrame([("d", "x" * 100 + "y" * 200 + "z" * 100 + "w" * 7), ("e", "abc")], "doc string, text string")
    said = [(r.start, r.title, r.body) for r in reports.sections(docs, marks, 50).orderBy("start").collect()]
    assert said == [(0, None, "x" * 100), (100, "one", "y" * 200), (300, "three", "z" * 100), (400, "four", "w" * 7)]
    assert reports.sections(docs, marks).where("title is null").count() == 0


def test_guards_and_their_order(spark):
    logs = spark.createDataFrame([(1, "Done", 4.0, 5.0, 3.0, 9.0, 8.0), (2, " done", 8.0, 6.0, 5.0, 9.0, 8.0), (3, "Open", 8.0, 6.0, 5.0, 9.0, 8.0), (4, "Open", None, 6.0, 5.0, 8.005, 8.0), (5, None, None, None, None, None, None)], "i int, status string, estimate double, re_estimate double, actual double, total_today double, allocated double")
    assert rows(reports.log_guards(logs).select("i", "guard", "diff"), "i") == [(1, "overtime", 1.0), (2, "done_mismatch", 1.0), (3, "allocation_mismatch", -1.0), (4, None, None), (5, None, None)]


def test_verdicts_need_every_line_valid(spark):
    people = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "person string")
    lines = spark.createDataFrame([("a", True, True), ("a", False, None), ("b", True, True), ("b", True, None), ("c", None, True)], "person string, is_log boolean, valid boolean")
    assert rows(reports.report_verdicts(people, lines), "person") == [("a", "reported"), ("b", "bad_format"), ("c", "bad_format"), ("d", "not_reported")]
    assert {r.verdict for r in reports.report_verdicts(people, lines.where("false")).collect()} == {"not_reported"}


def test_current_versions(spark):
    registry = spark.createDataFrame([("a", 2)], "doc string, current int")
    given = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 2), (4, "a", None), (5, "b", 2)], "i int, doc string, version int")
    assert [r.i for r in reports.current(given, registry, "doc", "version").orderBy("i").collect()] == [1]
    assert [r.i for r in reports.current(given, registry, "doc", "version", pages=True).orderBy("i").collect()] == [1, 3, 4]


def test_reuse_override_and_context(spark):
    old = spark.createDataFrame([("h", "c", 5, "open"), ("h", "c", 3, "failed"), ("h", "", 1, "open")], "sha string, channel string, id int, status string")
    new = spark.createDataFrame([("h", "c"), ("h", ""), ("x", None)], "sha string, channel string")
    assert sorted((str(r.channel), r.reuse) for r in reports.reusable_requests(new, old, ["sha", "channel"]).collect()) == [("", None), ("None", None), ("c", 5)]
    blocks = spark.createDataFrame([("t", "old", True), ("u", "old", False), ("gone", "old", True)], "title string, block string, fixed boolean")
    made = spark.createDataFrame([("t", "new"), ("u", "new")], "title string, block string")
    assert rows(reports.overridden(made, blocks), "title") == [("gone", "old", "missing"), ("t", "old", "reused"), ("u", "new", "generated")]
    lines = spark.createDataFrame([("a", i, "0123456789") for i in range(20)] + [("b", 1, "short"), ("c", 1, None)], "thread string, seq int, line string")
    got = {r.thread: r.context for r in reports.thread_context(lines, 60).collect()}
    assert got["b"] == "short" and "c" not in got and len(got["a"]) == 60 and got["a"] == "\n".join(["0123456789"] * 6)[:40] + "\n[history truncated]"
    # What comes after exactly as many characters as may stand is a cut as well; a line that is all there is none.
    full = spark.createDataFrame([("a", 1, "x" * 20), ("a", 2, "y" * 39), ("a", 3, ""), ("b", 1, "z" * 60)], "thread string, seq int, line string")
    got = {r.thread: r.context for r in reports.thread_context(full, 60).collect()}
    assert got == {"a": "x" * 20 + "\n" + "y" * 19 + "\n[history truncated]", "b": "z" * 60}


def test_wide_lists_and_confidence(spark):
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "k int, v array<string>")
    assert rows(reports.widened(lists, "k", "v", "file"), "k") == [(1, "a", "b"), (2, None, None), (3, None, None)]
    assert reports.widened(lists.where("false"), "k", "v", "file").columns == ["k", "file_1"]
    c = spark.createDataFrame([(1, 1.0), (1, None), (2, None), (3, 0.0)], "k int, c double").groupBy("k").agg(reports.mean_log(F.col("c")).alias("m"))
    assert [round(r.m, 4) for r in c.orderBy("k").collect()] == [0.0, -0.1, -13.8155]


def test_tasks_are_made_once_for_all_rules(spark):
    from ledgerloom.operators import rules

    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    kind = "ref string, assignee string, category string, status string, is_done boolean, plan_start date, plan_end date, estimate double, actual double, remaining double, sprint string"
    tasks = spark.sql("SELECT 'a' AS ref, CAST(NULL AS string) AS assignee, 'c' AS category, 'Verify bug' AS status, false AS is_done, DATE '2026-01-01' AS plan_start, DATE '2026-01-02' AS plan_end, 2D AS estimate, 4D AS actual, 1D AS remaining, 'S 1' AS sprint").mapInArrow(run, kind)
    calendar = spark.createDataFrame([("p", None, 8.0)], "person string, day date, hours double")
    overtime = spark.createDataFrame([], "person string, day date, hours double")
    day = F.lit("2026-01-10").cast("date")
    got = {(r.rule, r.ref, r.score) for r in rules.run_rules(tasks, calendar, overtime, day, day, "S 1", 9).collect()}
    assert got == {("T1", "a", 9), ("T2", "a", 4), ("M1", "c", 3), ("M2", "c", 6), ("P3", "a", 6)} and made.value == 1
