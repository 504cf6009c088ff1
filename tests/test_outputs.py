"""Cells that are written and read back, risks with running ids, manifests, items, handbooks and objects in replies, by cases."""

import datetime
import json

from ledgerloom.operators import outputs
from pyspark.sql import functions as F


def test_cells_are_read_back(spark):
    reports = spark.createDataFrame([("a", 2, "8,0h", " 01-01-2026 ", "Chưa", "7,5", " Done ", None), ("a", 3, "x", None, None, "1.234,5", "Open", "n"), ("b", 2, "1", "s", "e", "3", "Open", "n")], "sheet string, row int, re_est string, start string, end string, actual string, status string, note string")
    layout = spark.createDataFrame([("a", f, i + 1) for i, f in enumerate(("re_est", "start", "end", "actual", "status"))] + [("b", "actual", 9), ("b", "note", 1)], "sheet string, field string, col int")
    updates = outputs.report_cells(reports, layout)
    got = {(r.sheet, r.row, r.field): r.value for r in updates.collect()}
    assert got == {
        ("a", 2, "re_est"): "8.0", ("a", 2, "start"): "01-01-2026", ("a", 2, "end"): "", ("a", 2, "actual"): "7.5", ("a", 2, "status"): "Done",
        ("a", 3, "re_est"): "x", ("a", 3, "end"): "", ("a", 3, "actual"): "1234.5", ("a", 3, "status"): "Open", ("b", 2, "actual"): "3.0", ("b", 2, "note"): "n",
    }
    cells = spark.createDataFrame([("a", 2, 4, "old"), ("a", 9, 9, "kept"), ("c", 1, 1, None)], "sheet string, row int, col int, value string")
    now = outputs.written(cells, updates)
    assert {tuple(r) for r in now.where("row <> 3 and (col = 4 or row = 9 or sheet = 'c')").collect()} == {("a", 2, 4, "7.5"), ("a", 9, 9, "kept"), ("c", 1, 1, None)} and now.count() == 13
    shown = now.withColumn("value", F.when(F.col("sheet") == "b", "").when(F.col("value") == "7.5", "7,505").when(F.col("value") == "1234.5", "12345").otherwise(F.col("value")))
    assert sorted(map(tuple, outputs.unconfirmed(updates, shown).collect())) == [("a", 3, "1234.5", "12345"), ("b", 2, "3.0", "")]
    assert outputs.unconfirmed(updates, shown.limit(0)).count() == 3


def test_risks_run_on(spark):
    risks = spark.createDataFrame([("t", 2, "R-07"), ("t", 5, " R-98x"), ("t", 4, "Q-999"), ("u", 1, None)], "tab string, row int, id string")
    overs = spark.createDataFrame([("t", "X-1", "An", None, " a ", 4.0, None, None, 1), ("t", "X-2", "", "Bi", "b", 3.75, "Low", "call", 2), ("t", "X-3", None, "", "c", None, None, None, 3), ("u", "X-4", "An", None, "d", 12.0, None, None, 1), ("new", "X-5", "An", None, "e", 1.0, None, None, 1)], "tab string, task string, assignee string, reporter string, reason string, hours double, priority string, next_action string, at int")
    got = outputs.appended_risks(risks, overs, F.lit(datetime.date(2026, 7, 3)), ["at"]).orderBy("tab", "row").collect()
    note = "Ghi tự động từ report Slack ngày 03-07-2026"
    assert [tuple(r) for r in got] == [
        ("new", 2, "R-01", "An vượt 1h ở task X-5: e", "Medium", "An/X-5", "PM review giờ vượt", "Open", note),
        ("t", 6, "R-99", "An vượt 4h ở task X-1: a", "High", "An/X-1", "PM review giờ vượt", "Open", note),
        ("t", 7, "R-100", "Dev vượt 3.75h ở task X-2: b", "Low", "X-2", "call", "Open", note + ", người report Bi"),
        ("t", 8, "R-101", "Dev vượt 0h ở task X-3: c", "Medium", "X-3", "PM review giờ vượt", "Open", note),
        ("u", 2, "R-01", "An vượt 12h ở task X-4: d", "High", "An/X-4", "PM review giờ vượt", "Open", note),
    ]


def test_manifests(spark):
    files = spark.createDataFrame([("a", "x", "1", 2), ("a", "d/y", "2", 3), ("b", "x", "1", 2), ("z", "x", "1", 1)], "release string, path string, sha256 string, size long")
    releases = spark.createDataFrame([("a", "h", "h"), ("b", "h", "h"), ("c", "h", "h"), ("d", None, None), ("e", "h", "i")], "release string, told_sha256 string, input_sha256 string")
    got = {r.release: (r.status, r.missing, r.files, r.bytes) for r in outputs.release_manifests(files, releases, ("x",), ("d/",)).collect()}
    assert got == {"a": ("ready", [], 2, 5), "b": ("incomplete", ["d/"], 1, 2), "c": ("incomplete", ["x", "d/"], 0, 0), "d": ("incomplete", ["x", "d/"], 0, 0), "e": ("stale", ["x", "d/"], 0, 0)}


def test_modules(spark):
    pages = [("p1", "An", "a.md", "entity-person", "nexus an", None, "internal"), ("p2", "An", "a.md", "entity-person", "other", None, "internal"), ("h", "CHƯƠNG 3: x", "van--chuong-3.md", "source", "handbook nexus", "nexus", "public"), ("o", "x", "van.md", "source", "x", None, "internal"), ("n", "x", "plan.md", "source", "x", "NEXUS", "public"), ("q", "x", "x", "source", "x", None, None)]
    df = spark.createDataFrame(pages, "page string, title string, relative string, page_type string, searchable string, project string, visibility string")
    got = lambda role: {(r.page, r.module) for r in outputs.modules(df, "Nexus", role).collect()}
    base = {("h", "workplace-practice"), ("o", "company-basics"), ("n", "project-context"), ("p1", "team-workflow"), ("p1", "first-delivery"), ("n", "first-delivery")}
    assert got("developer") == base | {("p1", "role-readiness"), ("n", "role-readiness")}
    assert got("project-manager") == base | {("n", "role-readiness")} and got("hr-operations") == base | {("o", "role-readiness")}


def test_handbook(spark):
    good = "## 1. Hồ sơ đào tạo\n## 2.\n### 2.1 A\n### 2.12 B\n## 3.\n## 4.\n## 5.\n## 6.\n" + "".join(f"- **Scope:** `{s}`\n" for s in ("role_guidance", "policy_fixed", "policy_fixed", "project_dynamic", "project_dynamic")) + "- **Coverage:** `partial`\nNguồn: a\nFreshness KB [Chưa có trong KB]"
    texts = [good, good.replace("Nguồn: a", "Nguồn: wiki/a"), good + "\nNguồn: `chưa xác định`", good.replace("- **Coverage", " - **Coverage"), "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(outputs.handbook_quality(F.col("t")).alias("q")).collect()
    assert [(r.q.score, r.q.passed, r.q.modules, r.q.citations) for r in got] == [(100, True, 2, 1), (86, False, 2, 1), (86, False, 2, 2), (86, False, 2, 1), (0, False, 0, 0), (0, False, 0, 0)]
    assert sum(got[0].q.checks.values()) == 7


def test_objects_and_items(spark):
    cases = {' {"a": 1}\n': {"a": 1}, 'x {"a": {"b": 2}} y': {"a": {"b": 2}}, '[{"a": 1}]': {"a": 1}, "[1]": None, '{"a": 1} {"b": 1}': None, '{"a": 1': None, "": None, '{"a": 1}, {"b": 2}': None, "{}": {}}
    got = spark.createDataFrame([(c,) for c in cases], "r string").select("r", outputs.json_object(F.col("r")).alias("o")).collect()
    assert {r.r: r.o and json.loads(r.o) for r in got} == cases
    df = spark.createDataFrame([("r", ["a", "b"], ""), ("s", None, "An"), ("t", [], None)], "ref string, o array<string>, w string")
    got = outputs.described(df, F.lit("2026-07-03").cast("date"), F.lit("d"), F.col("o"), F.col("w")).select("ref", "related", "next_action", "options").collect()
    assert [tuple(r) for r in got] == [("r", "r", "a", ["a", "b"]), ("s", "An", "", []), ("t", "t", "", [])]
