"""Scopes, columns and closed values of questions, and tiers that each get what is left open."""

from ledgerloom.functions import text
from ledgerloom.operators import answers
from pyspark.sql import functions as F


def test_scopes(spark):
    cases = {
        "Sprint 0-7": ([0, 1, 2, 3, 4, 5, 6, 7], []),
        "sprint 3 đến Sprint 1": ([1, 2, 3], []),
        "sprint 2 và sprint5, sprint 2": ([2, 5], []),
        "Sprint 0 -> 1, sprint 4": ([0, 1, 4], []),
        "tháng 7, Quý 2 năm 2026, tuần 3": ([], ["tháng", "quý", "năm", "tuần"]),
        "": ([], []),
    }
    got = spark.createDataFrame([(q,) for q in cases], "q string").select("q", answers.scope(text.fold(F.col("q"))).alias("s")).collect()
    assert {x.q: (x.s.sprints, x.s.others) for x in got} == cases


def test_columns_and_closed_values(spark):
    q = spark.createDataFrame([(1, "Trạng thái của API login là gì"), (2, "Task nào còn lại?"), (3, "ưu tiên high hay highest"), (4, "ngày bắt đầu Sprint 3"), (5, "open")], "id int, q string")
    plain = text.fold(F.col("q"))
    got = {x.id: x for x in q.select("id", answers.asked_columns(plain).alias("c"), answers.row_terms(plain).alias("t"), answers.wanted(plain).alias("w")).collect()}
    assert got[1].c == ["status"] and got[1].t == ["api", "login"] and got[1].w is None
    assert got[2].w.column == "remaining" and got[2].w.value is None and got[3].w.value == "Highest" and got[5].w is None
    assert got[4].c == ["date", "start"] and got[4].t == ["sprint"]
    cells = spark.sql("select array(named_struct('label', 'Status', 'value', 'done'), named_struct('label', 'Remaining(h)', 'value', '0')) as cells")
    want = lambda q: answers.wanted(F.lit(q))
    row = cells.select(*[answers.has_wanted(want(w), F.col("cells")).alias(n) for n, w in (("a", "status done"), ("b", "status open"), ("c", "con lai"), ("d", "x"))]).first()
    assert tuple(row) == (True, False, False, True)


def test_tiers(spark):
    said = {
        1: ("Cập nhật task của An", 1, "action", "missing", None),
        2: ("effort An sprint 1-2", 1, "several_sprints", "missing", None),
        3: ("An có bao nhiêu task", 2, "fact", "found", "7"),
        4: ("An có bao nhiêu task sprint 3", 2, "fact", "found", "4"),
        5: ("An có bao nhiêu task sprint 4", 2, "fact", "no", None),
        6: ("An và Binh có bao nhiêu task", 4, "nothing", "missing", None),  # two people
        7: ("bao nhiêu giờ của Binh", 4, "nothing", "missing", None),  # not signed: unknown is not no
        8: ("trạng thái shopping cart", 3, "cells", "found", "20"),
        9: ("note shopping cart", 4, "nothing", "missing", None),  # no row has that column
        10: ("shopping wagon licence", 4, "nothing", "missing", None),  # too little of it
        11: (None, 4, "nothing", "missing", None),
        12: ("vì sao An có bao nhiêu task", 4, "nothing", "missing", None),
    }
    q = spark.createDataFrame([(k, v[0]) for k, v in said.items()], "id long, q string")
    facts = spark.createDataFrame([("An", None, "tasks", 7), ("An", 3, "tasks", 4)], "person string, sprint int, measure string, value long")
    people = spark.createDataFrame([("An",), ("Binh",)], "name string")
    rows = spark.createDataFrame([(20, "Shopping cart Done", ["status"]), (21, "Shopping cart Open", ["status", "date"]), (22, "Login Open", ["note"])], "id long, blob string, labels array<string>")
    tiers = lambda: [answers.guard_tier("id"), answers.fact_tier("id", facts, people, "name", {"tasks": "bao nhieu task", "hours": "bao nhieu gio"}, ("tasks",)), answers.cell_tier("id", rows, "id", text.fold(F.col("blob")), F.col("labels"))]
    got = answers.tiered(q, "id", "q", tiers()).collect()
    assert {x.id: (x.tier, x.rule, x.outcome, x.answer) for x in got} == {k: v[1:] for k, v in said.items()} and len(got) == len(said)
    assert next(x.hits for x in got if x.id == 8) == 2
    assert answers.tiered(q.limit(0), "id", "q", tiers()).count() == 0 and answers.tiered(q, "id", "q", []).count() == len(said)
