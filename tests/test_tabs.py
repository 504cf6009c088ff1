"""Tabs by their headers, contracts, uploads, reuse and metadata, by cases."""

import datetime

from ledgerloom.operators import tabs
from pyspark.sql import functions as F

CELLS = "sheet string, row int, col int, value string"


def grid(spark, sheets):
    return spark.createDataFrame([(s, i + 1, j + 1, v) for s, rows in sheets.items() for i, row in enumerate(rows) for j, v in enumerate(row)], CELLS)


def test_person_grid(spark):
    a = [
        ["x"],
        ["Name", "Member", "slack_id", "June", None, "jul", None, "Slack Name", "Role"],
        [None, None, None, "29", "30", "1", "30"],
        ["N1", "An", "U1234567", "8", "8", "8", " 7,5 ", "an", "qa"],
        ["N2", "", "W1234567", "8", "8", "8", "OFF", "bi"],
        ["N3", "Dup", "U1234567"],
        ["N4", "Cy", "u1234567"],
        ["N5", "August", ""],
        ["N6", "Grand Total", None],
        ["N7", "", ""],
        ["N8", "", "U7654321", None, None, None, "8h"],
        ["N9", "Du", "U7654322"],
    ]
    got = tabs.person_grid(grid(spark, {"a": a, "b": [["x"]], "c": [["Slack ID"], ["30"], ["U1234567"]]}), F.lit(datetime.date(2026, 7, 30)))
    assert got.columns == ["sheet", "row", "state", "id", "name", "slack_name", "role", "hours"]
    assert {tuple(r) for r in got.collect()} == {
        ("a", 4, "present", "U1234567", "An", "an", "qa", 7.5),
        ("a", 5, "off", "W1234567", "bi", "bi", "", None),
        ("a", 7, "no_id", None, "Cy", "", "", None),
        ("a", 11, "present", "U7654321", "U7654321", "", "", None),
        ("a", 12, "off", "U7654322", "Du", "", "", None),  # an empty cell is a day off
        ("b", None, "no_header", None, None, None, None, None),
        ("c", 3, "present", "U1234567", "U1234567", "", "", None),  # no month, so no day's column
    }


def test_issue_rows(spark):
    heads = ["Date Detected", "Description", "Priority", "Next Action", "Status", "Notes"]
    sheets = {
        "both": [["ID ", *heads, "Related Assignee/Task", "Task"], ["1", "d", None, "High", "", "Open", "n", " An / x ", "y"], [" ", "d"], []],
        "pair": [["Task", *heads, "Related Assignee", "ID"], ["t", *"      ", "An", "2"], ["t", *"      ", "", "3"], ["", *"      ", " ", "4"]],
        "lacks": [["ID", *heads[1:], "Related Assignee"], ["9"]],
    }
    got = {(r.sheet, r.row): (r.fault, r.id, r.priority, r.related) for r in tabs.issue_rows(grid(spark, sheets)).collect()}
    assert got == {
        ("both", 2): (None, "1", "High", "An / x"),
        ("pair", 2): (None, "2", "", "An / t"),
        ("pair", 3): (None, "3", "", "t"),
        ("pair", 4): (None, "4", "", ""),
        ("lacks", None): ("Date Detected, Related Assignee/Task", None, None, None),
    }


def test_contract(spark):
    ids = ["ok", "gone", "none", "lost", "extra", "formula", "cached", "value", "other"]
    registry = spark.createDataFrame([(d, 1, "spreadsheet", "h", None if d == "gone" else "h") for d in ids], "doc_id string, version int, extractor string, sha256 string, original_sha256 string")
    files = spark.createDataFrame([(d, k, f"wiki/sources/{d}.md" if k == "page" else "r", d, 1, "b", ["r"], True) for d in ids for k in ("raw", "page", "facts")], "doc_id string, kind string, path string, said_doc string, said_version int, body_sha256 string, raw_paths array<string>, machine boolean")
    fact = {"ok": [("A1", "1", None)], "lost": [("A1", "1", None)], "extra": [("A1", "1", None), ("A2", "1", None)], "formula": [("A1", "1", "=B")], "cached": [("A1", "=B", "=B")], "value": [("A1", "1", None)], "other": [("A1", "1", None)], "gone": [("A1", "1", None)]}
    seen = {"lost": [("A1", "1", None), ("A2", None, None)], "extra": [("A1", "1", None)], "formula": [("A1", "1", "=C")], "cached": [("A1", None, "=B")], "value": [("A1", "2", None)], "other": [("A1", "1", None)]}
    facts = spark.createDataFrame([(d, *c) for d, cs in fact.items() for c in cs], "doc_id string, place string, value string, formula string")
    review = spark.createDataFrame([(d, *c, "x" if d == "other" else "h") for d, cs in seen.items() for c in cs], "doc_id string, place string, value string, formula string, sha256 string")
    got = {r.doc_id: (r.status, r.cells, r.reviewed) for r in tabs.sheet_contract(registry, files, facts, review).collect()}
    assert got == {
        "ok": ("pass", 1, None), "gone": ("original changed", 1, None), "none": ("no cells", 0, None), "lost": ("cells missing", 1, 2), "extra": ("cells extra", 2, 1),
        "formula": ("cells differ", 1, 1), "cached": ("pass", 1, 1), "value": ("cells differ", 1, 1), "other": ("review of another file", 1, 1),
    }


def test_uploads_and_gate(spark):
    r = [("U1", "/s/a", False, 5, "pdf", "reingest"), (" U1 ", "/kb/raw", False, 5, "pdf", "reingest"), ("U1", "/kb/rawer/a", False, 104857600, "csv", "new"), ("U1", "/s/a", False, 104857601, "csv", "new"), ("U1", "/s/a", False, 1, None, "no_op"), ("U1", None, None, None, None, None), ("U2", "/s/a", False, 1, "pdf", "no_op"), (None, "/s/a", False, 1, "pdf", "no_op"), ("U1", "/s/a", True, 1, "pdf", "no_op"), ("U1", "/s/a", False, 1, "pdf", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "i int, actor string, path string, is_link boolean, size long, kind string, flow string")
    got = tabs.uploads(df, spark.createDataFrame([("U1",), ("U1",)], "actor string"), "/kb").orderBy("i").collect()
    assert [x.status for x in got] == ["ready_to_ingest", "guarded", "blocked", "too_large", "kind", "missing", "not_allowed", "no_actor", "link", "blocked"]
    a = spark.createDataFrame([("A", ["m"]), ("B", []), ("C", None), (" ", ["m"])], "actor string, roles array<string>")
    gate = lambda v: [(x.allowed, x.reason) for x in tabs.project_gate(a, v, {"internal": ["m"]}).collect()]
    assert gate("internal") == [(True, "role"), (False, "no_role"), (False, "no_role"), (False, "no_actor")] and gate("public") == [(True, "public")] * 4 and gate("odd")[0] == (False, "no_role")


def test_reuse(spark):
    own = "wiki/sources/d.md"
    pages = [("k", False, "s", own, True, False), ("a", True, "s", own, True, True), ("b", True, "t", own, True, True), ("c", True, "u", own, True, False), ("e", True, None, None, True, False), ("f", False, "v", "else", True, True), ("g", False, "w", own, False, True)]
    df = spark.createDataFrame([(p, r, "source", "d", 1, "x", None, ["raw"], s, o, v, c) for p, r, s, o, v, c in pages], "path string, rejected boolean, page string, doc_id string, version int, domain string, visibility string, raw_paths array<string>, section string, part_of string, valid boolean, complete boolean")
    scopes = spark.createDataFrame([(s or "whole", "d", 1, "x", None, "raw", s) for s in ("s", "t", "u", "v", "w", None)] + [("old", "d", 2, "x", None, "raw", "s")], "id string, doc_id string, version int, domain string, visibility string, raw_path string, section string")
    got = lambda drafts: {x.id: x.path for x in tabs.reusable_pages(scopes, df, "id", drafts).collect()}
    assert got(False) == {"s": "k", "t": None, "u": None, "v": None, "w": None, "whole": "e", "old": None}
    assert got(True) == {**got(False), "t": "b"}


def test_metadata(spark):
    df = spark.createDataFrame([("a", [("token=abc", {"password: x": ["secret: y"]})], "secret", 3), (None, None, "s", None)], "subtype string, files array<struct<n:string,m:map<string,array<string>>>>, blocks string, reply_count int")
    got = df.select(tabs.safe_metadata(df).alias("s")).collect()
    assert got[0].s.asDict(True) == {"subtype": "a", "reply_count": 3, "files": [{"n": "token=[REDACTED]", "m": {"password: x": ["secret: [REDACTED]"]}}]}
    assert got[1].s.asDict(True) == {"subtype": None, "reply_count": None, "files": None}
