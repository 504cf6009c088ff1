"""Report lines, exact numbers, letters, decisions, overtime and file kinds, case by case."""

import pytest
from ledgerloom.functions import text
from ledgerloom.operators import lookup, reports, shapes
from ledgerloom.sources import files
from pyspark.sql import functions as F

# The rules' own examples.
VALID = """NEX-123 | 8 | 01-08-2026 | 03-08-2026 | 7.5 | Done | xong sớm
  nex-45 | 5 | 03-08-2026 |  | 2 | In progress |
4 | 16 | 28-07-2026 | 03-08-2026 | 18 | đã hoàn thành | không có
DWM-2222| 8 | 03-08-2026 |  | 8 | đang tiến hành |
100 | 4 | 03-08-2026 |  | 4h | đang làm | đổi figma | +14h
- NEX-9 | 8 | 03-08-2026 |  | 8 | đang làm |
|NEX-9|8|03-08-2026||8|đang làm|
NEX-9 | 8 | 03-08-2026 | - | 8 | đang làm |
NEX-9 | 8 | 03-08-2026 |  | 8 | hoàn thành 90% |
NEX-9 | 8 | 03-08-2026 | 05-08-2026 | 8 | done ✅ | ok
NEX-214 | 8 | 03-08-2026 | 04-08-2026 | 7.5 | Done | xong sớm nửa buổi""".split("\n")
WRONG = {
    "NEX-123 | 8 | 01-08-2026 | 03-08-2026 | 7.5 | Done": "fields",
    "NEX-123 | 8 | 1-8-2026 |  | 2 | In progress |": "start",
    "NEX-123 | 8 | 2026-08-01 |  | 2 | In progress |": "start",
    "NEX-123 | 8 | 01-08-2026 |  | 7.5 | Done | xong rồi": "end",
    "NEX-123 |  | 01-08-2026 |  | 2 | In progress |": "estimate",
    "NEX-123 | 8 | 01-08-2026 |  |  | In progress |": "actual",
    "NEX-9 | 8 | 03-08-2026 |  | 8 | đã hoàn thành |": "end",
    "NEX-9 | 8 | 03-08-2026 | - | 8 | Done | xong": "end",
}
IGNORED = ["em báo cáo ạ", "Id task | Re-estimate (h) | Start date | ...", "xong hết việc rồi nhé | 8 | 03-08-2026 |  | 8 | đang làm |", "", None]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_report_lines(spark):
    more = {"**NEX-1 | 8 | 03-08-2026 | 3/8/2026 | 8 | đang làm | x**": "end", "1. NEX-1 | 8 | 03-08-2026 | chưa xong | 8 |  | ": "status", "2) > `12 | 8 | 03-08-2026 | mai | 0 | not done |`": ""}
    given = {**{x: "" for x in VALID}, **WRONG, **{x: None for x in IGNORED}, **more}
    df = spark.createDataFrame(list(enumerate(given)), "i int, line string")
    got = {r.line: r.f for r in df.select("line", lookup.log_line_faults(F.col("line")).alias("f")).collect()}
    assert got == given
    assert one(spark, lookup.log_line_faults(F.lit("- " + VALID[10]), example=VALID[10])) is None


def test_numbers_keep_all_digits(spark):
    want = {1e-12: "0.000000000001", 0.12345678901: "0.12345678901", 1e20: "1" + "0" * 20, 1.5e300: "15" + "0" * 299, 148.0: "148", -45.5: "-45.5", 0.0: "0", 5e-324: "0." + "0" * 323 + "49"[:1], 0.1: "0.1", 123456789.125: "123456789.125"}
    want[5e-324] = one(spark, shapes.plain_decimal(F.lit(5e-324)))  # the shortest digits of the least double differ by runtime: 4.9 or 5
    df = spark.createDataFrame([(x,) for x in want], "x double")
    assert {r.x: r.s for r in df.select("x", shapes.plain_decimal(F.col("x")).alias("s")).collect()} == want and want[5e-324].startswith("0." + "0" * 323)
    assert one(spark, shapes.numeric_forms(F.lit(0.5125), F.lit("ratio"))) == ["0.5125", "51.25"]
    assert one(spark, shapes.numeric_forms(F.lit(1e-12), F.lit("ratio"))) == ["0.000000000001", "0.0000000001"]
    assert one(spark, shapes.numeric_forms(F.lit(float("nan")), F.lit("ratio"))) == [] and one(spark, shapes.numeric_forms(F.lit(7), F.lit(None))) == ["7"]


def test_letters_of_any_length(spark):
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702, 18277, 18278, 2**62)], "i long")
    got = [r[0] for r in df.select(text.column_letter(F.col("i"))).collect()]
    assert got[:7] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    n = 0
    for c in got[7]:
        n = n * 26 + ord(c) - 64
    assert n - 1 == 2**62 and one(spark, text.column_letter(F.lit(-1))) is None


def test_intake_decisions(spark):
    registry = spark.createDataFrame([("a", 1, False, "x", "s1"), ("a", 2, True, "y", "s2"), ("b", 1, True, "z", "s"), ("c", 1, True, "z", "s")], "doc string, version int, current boolean, digest string, semantic string")
    given = [("a", "x", "s2", True, "duplicate"), ("q", "y", "s", False, "duplicate"), ("a", "z", "s2", True, "review"), ("n", "new", "s", True, "initial_ingest"), ("a", "new", "s2", False, "identity_review"), ("a", "new1", "s2", True, "no_op"), ("a", "new2", "s1", True, "reingest")]
    df = spark.createDataFrame([g[:4] for g in given], "doc string, digest string, semantic string, confirmed boolean")
    assert sorted(tuple(r) for r in lookup.intake(df, registry, "doc").collect()) == sorted((g[0], g[4]) for g in given)


def test_overtime_needs_person_day_hours_and_task(spark):
    kind = "person string, task string, day string, hours double"
    excess = spark.createDataFrame([("p", "t1", "d1", 2.0), ("p", "t2", "d1", 2.0), ("p", "t1", "d2", 2.0), ("p", "t1", "d3", 3.0), ("q", "t1", "d1", 2.0), ("p", "t9", "d1", 2.0)], kind)
    paid = spark.createDataFrame([("p", "d1", 2.005), ("p", "d3", 2.0)], "person string, day string, hours double")
    risks = spark.createDataFrame([("p", "t1", "Done"), ("p", "t2", "Open"), ("q", "t1", "Done")], "person string, task string, status string")
    got = {(r.person, r.task, r.day): r.verdict for r in lookup.reconciled(excess, paid, risks).collect()}
    assert got == {("p", "t1", "d1"): "match", ("p", "t2", "d1"): "open", ("p", "t1", "d2"): "unknown", ("p", "t1", "d3"): "unknown", ("q", "t1", "d1"): "unknown", ("p", "t9", "d1"): "unknown"}


def test_fallback_gives_ties_of_a_high_share(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "alpha beta gamma"), (4, "delta"), (5, "x alpha betas"), (6, None)], "id int, t string")
    ask = lambda *a, **k: sorted(r.id for r in lookup.fallback(rows, "id", F.coalesce("t", F.lit("")), *a, **k).collect())
    assert ask(["alpha", "beta"]) == [1, 3, 5] and ask(["beta", "delta", "zeta"]) == [] and ask(["alpha", "day"], ["day"]) == []
    assert ask(["gamma", "alpha", "day"], ["day"]) == [3]


def test_front_counts_without_white_space(spark):
    docs = spark.createDataFrame([(1, "\n" * 500 + "abAB"), (2, "x" * 450 + " \nAB")], "doc int, text string")
    marks = spark.createDataFrame([(1, 502, "A"), (1, 503, "B"), (2, 452, "A"), (2, 453, "B")], "doc int, start long, title string")
    assert sorted((r.doc, r.title or "") for r in reports.sections(docs, marks).collect()) == [(1, "A"), (1, "B"), (2, ""), (2, "A"), (2, "B")]


def test_kinds_of_files(spark, tmp_path):
    given = {"a.bin": (b"%PDF-1.7", "pdf"), "b.xlsx": (b"PK\x03\x04abc", "xlsx"), "b.dat": (b"PK\x03\x04abc", "zip"), "c.TXT": (b"hi", "text/plain"), "d.md": (b"# x", "text/markdown"), "e": (b"\x00", "binary"), "f.x": (b"\x89PNG\r\n\x1a\n", "image"), "g.png": (b"\xff\xd8\xff\xe0", "image"), "h.json": (b"{}", "application/json")}
    for name, (raw, _) in given.items():
        (tmp_path / name).write_bytes(raw)
    assert {r.file: r.kind for r in files.inventory(spark, str(tmp_path)).collect()} == {k: v for k, (_, v) in given.items()}


def test_leaves_at_any_depth(spark):
    deep = '{"a":' * 60 + "1" + "}" * 60
    got = files.leaves(spark.createDataFrame([(1, deep)], "id int, j string"), "id", "j").collect()
    assert [(r.path, r.value) for r in got] == [("$" + ".a" * 60, "1")]


@pytest.mark.parametrize("name", ["row_search_top", "row_search_ties", "cell_fallback", "intake_decision", "overtime_reconciliation", "log_line_check", "column_letters", "discount_forms", "document_sections"])
def test_not_empty_and_as_sql_at_another_size(spark, name):
    from compare import same
    from ledgerloom.plans import catalogue, gates, lookup, reports, rules, shapes  # noqa: F401

    assert not same(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_fallback_tells_all_rows_with_a_hit(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (4, "delta"), (5, "x alpha betas"), (6, None)], "id int, t string")
    ask = lambda *a: sorted((r.id, r.found) for r in lookup.fallback_shares(rows, "id", F.coalesce("t", F.lit("")), *a).collect())
    assert ask(["alpha", "beta"]) == [(1, True), (2, False), (5, True)]
    assert ask(["beta", "delta", "zeta"]) == [(1, False), (4, False), (5, False)] and ask(["alpha", "day"], ["day"]) == [(1, False), (2, False), (5, False)]


def test_a_line_is_cut_once(spark):
    plan = spark.createDataFrame([("1 | 2",)], "line string").select(lookup.log_line_faults(F.col("line")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
