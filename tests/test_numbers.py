"""Numbers in texts: golden cases of masks, units and spellings, the two gates, and the one pass against a plain version over documents."""

import random
import re

import pytest
from ledgerloom.operators import numbers
from pyspark.sql import functions as F


@pytest.mark.parametrize("token, want", [("29,3.", "29.3"), ("29,3", "29.3"), ("1.234.", "1234"), ("45.5.", "45.5"), ("12.", "12"), ("2.000.000", "2000000"), ("43,5", "43.5"), ("1.234", "1234"), ("007", "7"), ("0.50", "0.5"), ("1,234,567.5", "12345675"), ("9" * 60, "9" * 60), ("0.000000000001", "0.000000000001"), ("2026-07-27", "date:2026-07-27"), ("3/4/26", "date:3/4/26")])
def test_spellings(token, want):
    assert numbers.worth(token) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Điều 7: 8 ký tự", [("8", "char")]),
        ("Sprint 1 có 20 task", [("20", "task")]),
        ("các Điều 3, 4, 5 và 7", []),
        ("theo Điều 12, 30 ngày báo trước", [("30", "day")]),
        ("29,3. Quy trình\n43,5 giờ", [("43.5", "hour")]),
        ("- 2.1 Người lao động", []),
        ("2. Bản thân\n40 giờ mỗi tuần", [("40", "hour")]),
        ("86/2015/QH13 và ISO 9001, B3:B11, AU-1, §5.3, v2.1, MOR.BO.PRO.01", []),
        ("CHƯƠNG 2. HỢP ĐỒNG", []),
        ("Lần ban hành: 1.0\n\nNgày ban hành", []),
        ("03 (ba) ngày làm việc", [("3", "day")]),
        ("12\nngày", [("12", None)]),
        ("ngày 2026-07-27 lúc 10 hours", [("date:2026-07-27", None), ("10", "hour")]),
        ("raw/a1.md wiki/x-2.md [[page 3]] [[n 4]] 5 lần", [("5", "time")]),
        ("x7 7x .7 7.x", []),
        ("", []),
    ],
)
def test_numbers_and_units(text, want):
    assert [(v, u) for kind, _, _, v, u in numbers.tokens(text) if kind == "number"] == want


def faults(spark, before, after, summary=False):
    pairs = spark.createDataFrame([(1, before, after)], "id long, b string, a string")
    return sorted((x.level, x.fault, x.value) for x in numbers.transform_faults(pairs, "id", F.col("b"), F.col("a"), summary).collect())


def test_rewritten_texts(spark):
    hard = [("Thời hạn 385 ngày.", "Thời hạn 365 ngày.", "365"), ("Tỉ lệ 45.5 giờ.", "Tỉ lệ 46 giờ.", "46"), ("Nghỉ 30 phút.", "Nghỉ 30 giờ.", "30"), ("Nghỉ 45 ngày báo trước.", "Nghỉ báo trước.", "45")]
    for before, after, value in hard:
        assert value in {v for level, _, v in faults(spark, before, after) if level == "error"}
    for before, after in [("Làm 40 gid mỗi tuan.", "Làm 40 giờ mỗi tuần."), ("Làm 40 giờ mỗi tuần.", "| Số | Đơn vị |\n| 40 | giờ |")]:
        assert {level for level, *_ in faults(spark, before, after)} == {"warning"}
    once = "Diễn tập mỗi năm 1 lần theo mục 23. Nghỉ 12 ngày phép."
    assert not [x for x in faults(spark, once, "Diễn tập mỗi năm 1 lần. Ghi chú: tần suất 1 lần/năm.", True) if x[0] == "error"]
    assert ("error", "invented", "2") in faults(spark, once, "Diễn tập mỗi năm 2 lần.", True)
    assert ("error", "invented", "1") in faults(spark, once, "Diễn tập mỗi năm 1 lần. Lại 1 lần nữa. Nghỉ 12 ngày phép.")
    clauses = "Điều 37. Mức bồi thường.\n37.4. Khấu trừ tối đa 30% lương.\n37.5. Trường hợp khác.\nLàm 40 giờ/tuần."
    assert not [x for x in faults(spark, clauses, "Điều 37 xen kẽ 37.4–37.5. Làm 40 giờ/tuần.", True) if x[0] == "error"]
    assert ("error", "invented", "45") in faults(spark, clauses, "Điều 37 xen kẽ 37.4–37.5. Làm 45 giờ/tuần.", True)
    bare = "Hợp đồng 36 tháng theo mẫu 36 của Bộ. Phụ lục 36 kèm theo."
    assert faults(spark, bare, "Hợp đồng 36 tháng theo mẫu 36 của Bộ.") == [("warning", "dropped", "36")]
    assert faults(spark, "Nghỉ 36 tháng.", "Nghỉ theo quy định.") == [("error", "dropped", "36")]
    assert faults(spark, "29,3. Quy trình xác minh.\n03 (ba) ngày làm việc.", "Quy trình 29.3.\n03 ngày làm việc.", True) == []
    assert faults(spark, "Không có ngưỡng.", "Xem Điều 33.\n\n- `doc_id`: `abc`\n- `version`: 1\n", True) == []
    assert faults(spark, None, "Thêm 3 giờ.") == [("error", "invented", "3")] and faults(spark, None, None) == []


def test_declared_facts(spark):
    body = "# Quy định\nĐiều 7. Mật khẩu\nÍt nhất 8 ký tự.\nĐổi sau 3 tháng.\nĐiều 8. Lưu log 12 tháng, từ 2026-07-27. Tỉ lệ 51.25 %\n"
    documents = spark.createDataFrame([("r", body, True, False), ("old", body, False, False), ("ocr", body, True, True), ("null", None, True, None)], "doc string, body string, current boolean, ocr boolean")
    cases = [
        ((3.0, None, "tháng", "r", "Điều 7"), []),
        ((3.0, None, "tháng", "r", "điều   7"), []),
        ((12.0, None, "tháng", "r", "Điều 7"), ["not_there"]),
        ((12.0, None, "tháng", "r", None), []),
        ((8.0, None, "ngày", "r", "Điều 7"), ["other_unit"]),
        ((8.0, None, " ", "r", "Điều 7"), ["no_unit"]),
        ((8.0, None, None, None, "Điều 7"), ["no_unit", "no_source"]),
        ((None, "tám", "ký tự", "r", "Điều 7"), ["not_a_number"]),
        ((None, "2026-07-27", "date", "r", "Điều 8"), []),
        ((0.5125, None, "ratio", "r", "Điều 8"), []),
        ((8.0, None, "ký tự", "r", "Điều 70"), ["no_section"]),
        ((8.0, None, "ký tự", "gone", "Điều 7"), ["unknown_source"]),
        ((8.0, None, "ký tự", "old", "Điều 7"), ["old_source"]),
        ((8.0, None, "ký tự", "ocr", "Điều 7"), ["ocr_source"]),
        ((8.0, None, "ký tự", "null", None), ["not_there"]),
    ]
    declared = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(cases)], "id int, number double, day string, unit string, doc string, place string")
    got = {x.id: x.faults for x in numbers.declaration_faults(declared, documents, "id", "doc", F.col("body")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_a_section_ends_where_the_next_begins():
    assert numbers.windows("Điều 1. a 5\n## B\nĐiều 1 b", "điều 1") == ["Điều 1. a 5\n", "Điều 1 b"]
    assert numbers.windows("x" * 9 + "Khoản 2" + "y" * 9000, "khoản 2") == ["Khoản 2" + "y" * 3993]
    assert numbers.windows("abc", " ") == [] and numbers.windows("a.c abc", "a.c") == ["a.c abc"]


def test_stretches_hide_no_name():
    """Names whose parts lie on lines of their own, blank lines between, far from other digits."""
    r = random.Random(7)
    parts = ["Lần", "ban", "hành", ":", "1.0", "2.1", "Điều", "và", ",", "5", "giờ", "x", "[[a", "b]]", "raw/q", "7.4.", "Phiên", "bản", "v2"]
    for _ in range(3000):
        t = "".join(r.choice(parts) + r.choice(["\n", "\n \n", "\n\n\n", " ", "\r\n"]) + "y\n" * r.choice([0, 0, 0, 0, 9]) for _ in range(r.randrange(1, 14)))
        spans = numbers.masked(t)
        want = [(m.start(), m[0]) for m in re.finditer(numbers.TOKEN, t) if not any(m.start() < b and a < m.end() for a, b in spans)]
        found = list(numbers.tokens(t))
        assert [x[1:3] for x in found if x[0] == "number"] == want, t
        named = sorted({(m.start(), m[0]) for a, b in spans for m in re.compile(numbers.DOTTED).finditer(t, a, b)})
        assert sorted({x[1:3] for x in found if x[0] == "identifier"}) == named, t


def test_one_pass_against_a_plain_version(spark):
    """Spans kept apart and each token held against all of them; documents, with lines that begin with numbers put in between."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat(F.lit("2.1 Text\n3. x\n4,5 giờ\n"), F.coalesce("text", F.lit("")), F.lit("\nĐiều 3, 4 và 5 ngày")).alias("text"))
    want = []
    for r in docs.collect():
        t, spans = r.text, numbers.masked(r.text)
        for m in re.finditer(numbers.TOKEN, t):
            if not any(m.start() < b and a < m.end() for a, b in spans):
                want.append((r.doc_id, m.start(), m[0], numbers.unit_at(t[m.end() :], 0)))
    got = numbers.number_tokens(docs, "doc_id", F.col("text")).where("kind = 'number'").collect()
    assert len(want) > 200 and sorted((x.doc_id, x.at, x.token, x.unit or "") for x in got) == sorted((*w[:3], w[3] or "") for w in want)
    assert not numbers.number_tokens(docs.limit(0), "doc_id", F.col("text")).collect()


def test_facts_without_a_document_are_not_joined(spark):
    documents = spark.createDataFrame([(1, "Điều 1. 5 giờ", True, False)], "doc long, body string, current boolean, ocr boolean")
    declared = spark.createDataFrame([(i, 5.0, None, "hour", None if i else 1, None) for i in range(200)], "id long, number double, day string, unit string, doc long, place string")
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        plan = numbers.declaration_faults(declared, documents, "id", "doc", F.col("body"))
        assert {r.id: r.faults for r in plan.collect()} == {i: ["no_source"] if i else [] for i in range(200)}
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_masks_are_left_out_only_where_they_cannot_match():
    """Texts made of parts of all masks, in the cases and with the letters that count as others: the spans are those of every mask."""
    parts = ["ĐIỀU ", "điều\n4", " và 5", ", 6", " hoặc 7-8", "MỤC 1.2", "Khoản 9", "iſo 9", "ISO/IEC 2:3", "ıso 5", "İSO 7", "tcVn 12", "QcvN1", "iEc 3", "Phiên bản: 1.2", "Lan  banhanh4", "VerSion` : 1.2", "verſion 3", "§1.2.", "v1.2", "AB12:C3", "NEX-12", "Sprint 4 - 5", "bậc 3", "1.2.", "12.34, ", "2.5.Sprint", "[[page 3]]", "[[x 5]]", "`raw/1`", "raw/3", "12/2023/AB-CD1", "A.B1.C", "007", "1,000", "\n", " ", "x", "."]
    rnd = random.Random(7)
    every = [re.compile(p) for p in numbers.MASKS]
    for _ in range(3000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 12)))
        assert {m.span() for p in every for m in p.finditer(text)} <= set(numbers.masked(text)), text
    tried = [p.pattern for p, need in numbers._MASKS if any(n in "Rule 7 in 5 days" for n in need)]
    assert len(tried) == 1 and tried[0].startswith(r"\b[A-Z]{1,3}\d+")
    assert [numbers.worth(t) for t in ("007", "000", "٣٤", "1.50")] == ["7", "0", "34", "1.5"]
