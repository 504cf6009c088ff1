"""Clauses, noise, faults of answers, lists and cells, by cases and against plain Python."""

import json
import random
import re

from ledgerloom.operators import wording
from pyspark.sql import functions as F


def test_clauses(spark):
    cases = {
        "Điều 3\n3.1 a\nxem Điều 35 và khoản 3.02, 7.7": ["3", "3.1", "3.2"],
        "## điều 03: x\n- **3.1** y\n> 3.10) z\n3.2.1.\n3.4567 no\n3.1a no": ["3", "3.1", "3.2.1", "3.10"],
        "MỤC LỤC\nĐiều 1\n1.1\nĐiều 2": [],
        "Mục Lục \r\nĐiều 9\r\n9.9\r\n[[Page 2]]\r\n1.0 ban hành\r\nĐiều 1\r\n1.2": ["1", "1.2"],
        "Điều 1\nĐiều 2\nĐiều 3\n" + "x\n" * 8 + "3.1": ["3", "3.1"],  # nine lines on
        "Điều 1\nĐiều 2\n" + "x\n" * 9 + "2.1": ["1", "2", "2.1"],  # ten lines on: from the first article
        "4.2 trước\nĐiều 12\n1.2 khác": ["1.2", "12"],
        "1234.5 x\n1.2345\nthe khoản\n5.6; mụcx 1.1": ["5.6"],
        "": [],
        None: [],
        "Điều 1\n" + "1.1 x\n" * 3000: ["1", "1.1"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    got = {r.id: r.c for r in wording.with_clauses(df, "t", "c").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_coverage(spark):
    source = "Điều 2\n2.1\n2.2\n2.10"
    pages = {
        1: ("Điều 2\n2.1\n2.2\n2.10", ("pass", True, [], [], [])),
        2: ("Điều 2\n2.1\n[Chưa bao phủ: 2.2] <!-- NOT_COVERED: 2.10 -->", ("pass", False, [], [], [])),
        3: ("Điều 2\n2.1\n9.9\n[not covered: 8.8]\n# Nguồn\n2.2\n2.10", ("fail", False, ["2.2", "2.10"], ["9.9"], ["8.8"])),
        4: (None, ("fail", False, ["2", "2.1", "2.2", "2.10"], [], [])),
    }
    df = spark.createDataFrame([(k, source, p) for k, (p, _) in pages.items()] + [(5, None, None)], "id int, source string, page string")
    got = {r.id: (r.status, r.complete, r.missing, r.unexpected, r.marked_unexpected) for r in wording.clause_coverage(df, "id").collect()}
    assert got == {k: w for k, (_, w) in pages.items()} | {5: ("pass", True, [], [], [])}


def test_noise(spark):
    rows = [
        (1, 1, "vi", "hôm nay chúng ta bàn tiến trình thanh toán", None),
        (1, 2, "ja", "thanh toán desu", None),  # a word of the segment before
        (1, 3, "en", "red apples", "language"),
        (1, 4, "vi", "Thanks for watching!", "canned"),
        (1, 5, "vi", "ừ", "repeated"),
        (1, 6, "vi", "Ừ.", "repeated"),
        (1, 7, "vi", "ừ!", "repeated"),
        (1, 8, "en", "a b c d e f g h", None),  # eight words
        (1, 9, None, "xin", None),
        (1, 10, "en", None, None),
        (1, 11, "en", "", None),
        (2, 1, "en", "one", None),  # told to be spoken
        (2, 2, "vi", "hai", None),
        (2, 3, "fr", "trois", "language"),
    ]
    df = spark.createDataFrame([(*r[:4], "x") for r in rows], "meeting int, at int, lang string, text string, _extra string")
    told = spark.createDataFrame([(2, "en"), (2, "vi"), (2, "en"), (3, "en")], "meeting int, lang string")
    got = wording.noise(df, "meeting", "at", told)
    assert got.columns == [*df.columns, "noise"]
    assert sorted((r.meeting, r["at"], r.noise) for r in got.collect()) == [(m, a, n) for m, a, _, _, n in rows]
    assert wording.noise(df.limit(0), "meeting", "at").count() == 0


def test_style(spark):
    cases = {
        ("in_kb", "8 giờ", 1): [],
        ("in_kb", " \n", 1): ["empty"],
        ("in_kb", None, 1): ["empty"],
        ("in_kb", "probably\x1b[1m", 0): ["control", "escape", "uncited", "unsure"],
        ("in_kb", "\n".join("abcdefgh"), 1): [],
        ("in_kb", "\n".join("abcdefghi") + "\n", 1): ["long"],
        ("not_in_kb", "Không tìm thấy", None): [],
        ("not_in_kb", "Không ai làm", 0): ["too_sure", "no_notice"],
        ("confident_no", "Có", 0): ["no_denial"],
        ("confident_no", "CHƯA, undefined", 0): ["trace"],
        ("in_kb", "nano, todos", 2): [],
    }
    df = spark.createDataFrame(list(cases), "s string, a string, c int")
    got = [r.f for r in df.select("s", "a", "c", wording.style_faults(F.col("s"), F.col("a"), F.col("c")).alias("f")).collect()]
    assert got == list(cases.values())


def test_lists(spark):
    cases = [
        ('["a", "b"]', 2, ["a", "b"]),
        ('x [1, true, null, 1.50, "true", {"k": [2]}] y', 6, ["1", "True", "None", "1.5", "true", '{"k":[2]}']),
        ('```json\n["a"]\n``` or [b]', 1, ["a"]),
        ('["a"]', 2, None),
        ('["a", ]', 1, None),
        ("['a']", 1, None),
        ('{"a": 1}', 1, None),
        ('] ["a"', 1, None),
        ("[]", 0, []),
        ("", 0, None),
        (None, 0, None),
        ('["a"] and ["b"]', 1, None),
    ]
    got = spark.createDataFrame([c[:2] for c in cases], "r string, n int").select(wording.listed_strings(F.col("r"), F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [c[2] for c in cases]


def test_cells(spark):
    r = random.Random(1)
    numbers = [0.0, -0.0, 1.0, -3.0, 0.1 + 0.2, 1e-5, 1.5e-5, 0.00012, -2e-6, 3e-9, -3e-9, 12345678.25, 1e15, 1 / 3, 99.9999999] + [r.uniform(-1, 1) * 10 ** r.randint(-8, 8) for _ in range(200)]

    def plain(x, shown):
        return f"{x * 100:g}%" if shown else str(int(x)) if x.is_integer() else str(round(x, 6))

    df = spark.createDataFrame([(x, p) for x in numbers for p in (None, "0.0%")], "x double, p string")
    no = F.lit(None)
    got = df.select("x", "p", wording.cell_text(F.col("x"), F.col("p"), no.cast("date"), no.cast("boolean"), no.cast("string")).alias("t")).collect()
    assert not [(g.x, g.p, g.t, plain(g.x, g.p)) for g in got if g.t != plain(g.x, g.p)]
    one = spark.range(1).select(*[wording.cell_text(no.cast("double"), no, d, b, s).alias(n) for n, d, b, s in (("d", F.lit("2026-07-03").cast("date"), no, no), ("b", no.cast("date"), F.lit(False), no), ("s", no.cast("date"), no.cast("boolean"), F.lit(" a\nb ")), ("e", no.cast("date"), no.cast("boolean"), F.lit("")), ("n", no.cast("date"), no.cast("boolean"), no.cast("string")))]).first()
    assert tuple(one) == ("2026-07-03", "False", "a b", None, None)


def test_clauses_against_python(spark):
    r = random.Random(9)
    bits = ["Điều 1", "Điều 2", "# Điều 12", "1.1", "2.1 x", "**1.2** y", "- 12.3", "text", "khoản 2.4", "[[page 3]]", "MỤC LỤC", "1.10.2:", "x 1.1"]
    texts = ["\n".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(300)]
    article, clause = re.compile(r"\s*#{0,6}\s*Điều\s+(\d{1,3})(?=\D|$)", re.I), re.compile(r"\s*#{0,6}\s*(?:[-*]\s*)?(?:>\s*)?(?:\*\*)?(\d{1,3}(?:\.\d{1,3})+)(?:\*\*)?(?=[\s.),:;—–-]|$)")
    of = lambda p, x: (m := p.match(x)) and m[1]

    def plain(t):
        ls = t.split("\n")
        if "MỤC LỤC" in ls:
            i = ls.index("MỤC LỤC")
            ls = ls[:i] + (ls[ls.index("[[page 3]]", i) :] if "[[page 3]]" in ls[i:] else [])
        heads = [i for i, x in enumerate(ls) if of(article, x)]
        own = [i for i in heads if any((of(clause, x) or "").startswith(of(article, ls[i]) + ".") for x in ls[i + 1 : i + 10])]
        ls = ls[(own or heads or [0])[0] :]
        found = {of(article, x) or of(clause, x) for x in ls} | ({"2.4"} if "khoản 2.4" in ls else set())
        return sorted(found - {None}, key=lambda x: [int(p) for p in x.split(".")])

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {x.id: x.c for x in wording.with_clauses(df, "t", "c").collect()}
    bad = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not bad, json.dumps(bad[0], ensure_ascii=False)


def test_clauses_are_found_in_one_reading_of_a_text(spark):
    text = "Mục lục Điều 9\x0b9.9 x 3.1 early\r\n## ĐIỀU 03  - **03.010** 3.2.1: x see MỤC 3.7, khoản\n3.8; no_khoản 3.9 and 3.11x"
    contents = "[[page 4]]\n"
    assert wording.clauses(text) == []
    assert wording.clauses(text.replace("3.1 early", contents + "3.1 early")) == ["3", "3.2.1", "3.7", "3.8", "3.10"]
    df = spark.createDataFrame([(1, "Điều 1\n1.1 x", "[Not covered: 01.1]")], "k long, source string, page string")
    d = wording.clause_coverage(df, "k")
    assert "ArrowEvalPython" in d._jdf.queryExecution().executedPlan().toString()
    assert tuple(d.first())[1:] == ("fail", False, [], ["1.1"], ["1"], [], [])
