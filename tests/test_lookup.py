import random

from ledgerloom.functions import text
from ledgerloom.operators import core, lookup, rules
from pyspark.sql import functions as F


def test_action_requests(spark):
    given = ["Cập nhật task 3", "không tự tạo số", "Summary ghi gì?", "Log thêm 2 giờ", "không được sửa, hãy tạo mới", "vì sao trễ?", "ai làm task nào", "hello"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, q string").orderBy("i")
    assert [r[0] for r in df.select(lookup.route(F.col("q"), text.fold(F.col("q")))).collect()] == ["action", "document", "document", "action", "action", "open", "structured", "document"]


def test_risk_scores(spark):
    d = F.lit("2026-07-27").cast("date")
    df = spark.createDataFrame([("a", "2026-07-17", False), ("b", "2026-07-24", False), ("c", "2026-07-26", False), ("d", "2026-07-01", True), ("e", "2026-07-27", False), ("f", None, False)], "ref string, e string, is_done boolean").withColumn("plan_end", F.to_date("e"))
    assert [(r.ref, r.score, r.priority) for r in core.overdue(df, d).orderBy("ref").collect()] == [("a", 9, "Highest"), ("b", 6, "Highest"), ("c", 3, "Medium")]
    cal = spark.createDataFrame([("p", "2026-07-27", 8.0), ("p", "2026-07-28", 8.0), ("p", "2026-07-29", 0.0), ("p", "2026-07-30", None), ("q", "2026-07-01", 8.0)], "person string, d string, hours double").select("person", F.to_date("d").alias("day"), "hours")
    ot = spark.createDataFrame([("p", "2026-07-27", 2.0)], "person string, d string, hours double").select("person", F.to_date("d").alias("day"), "hours")
    end = F.lit("2026-07-31").cast("date")
    got = lambda hour: {r.person: r.capacity for r in rules.capacity(cal, ot, d, end, hour).collect()}
    assert got(9) == {"p": 18.0, "q": 0.0} and got(18) == {"p": 10.0, "q": 0.0}
    assert rules.gap_days(cal, d, end).collect()[0].gaps == "2026-07-29,2026-07-30"


def test_ledger_of_old_entries_and_drift(spark):
    rows = [("u", "t1", 1, 2.0, 5.0), ("u", "t1", 2, 1.0, 4.0), ("u", "t2", 1, 2.0, None), ("u", "t2", 2, 3.0, 9.0), ("u", "t3", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "u string, t string, at int, delta double, actual double")
    live = spark.createDataFrame([("u", "t3", 2.0), ("u", "t1", 4.005)], "u string, t string, live double")
    r = core.logged_today(df, ["u"], "t", "at", "delta", "actual", live).collect()[0]
    assert (r.logged, r.tasks) == (1.0 + 5.0, 2)


def test_pins_come_first(spark):
    lists = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), ("c", 3)], "item string, rank int")
    pins = spark.createDataFrame([("z", 1), ("c", 2)], "item string, pin int")
    assert [r.item for r in core.fused(lists, 3, pins=pins).collect()] == ["z", "c", "b"]


def test_next_id_starts_at_one(spark):
    assert lookup.next_id(spark.createDataFrame([], "id string"), "id").collect()[0].next_id == "R-01"


def test_a_registry_can_be_registered_into_again(spark):
    registry = spark.createDataFrame([("a", 1, True, None, "x")], "doc string, version int, current boolean, supersedes int, digest string")
    come = lambda *rows: spark.createDataFrame(list(rows), "doc string, from_version int, digest string")
    first = come(("a", 1, "y"), ("b", None, "z"), ("c", 3, "w"))
    then = lookup.registered(registry, first, "doc")
    assert lookup.refused(registry, first, "doc").collect() == []
    second = come(("a", 1, "q"), ("b", 1, "z2"), ("c", 1, "w"))
    assert [tuple(r) for r in lookup.refused(then, second, "doc").collect()] == [("a", 1, 2)]
    after = lookup.registered(then, second, "doc")
    assert sorted(tuple(r) for r in after.where("current").collect()) == [("a", 2, True, 1, "y"), ("b", 2, True, 1, "z2"), ("c", 1, True, None, "w")] and after.count() == 5


def test_dangling_and_one_way_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "nowhere")], "a string, b string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "b string")
    assert sorted(tuple(r) for r in core.mutual(edges, pages).collect()) == [("a", "c", "one_way"), ("c", "nowhere", "dangling")]


def test_effort_is_compared_as_rounded(spark):
    cases = [
        ([18.17, 2.97, 8.64, 17.66, 4.09], [7.24, 13.13, 16.82, 3.47, 10.86], "even"),  # 51.53 and 51.52, whose sums as they are lie farther apart
        ([19.09, 9.64, 11.0, 6.9, 13.61], [19.91, 14.61, 10.23, 6.18, 9.3], "over"),
        ([10.99, 12.07, 11.61, 10.48, 6.51], [7.05, 3.73, 19.88, 1.78, 19.23], "under"),
    ]
    rows = lambda side: spark.createDataFrame([(k, h) for k, c in enumerate(cases) for h in c[side]], "k int, hours double").coalesce(1)
    got = {r.k: r.verdict for r in lookup.effort_against_allocation(rows(0), rows(1), ["k"]).collect()}
    assert got == {k: c[2] for k, c in enumerate(cases)}


def reached(edges, seeds, hops):
    """The rows of neighbours, by a plain search from each seed."""
    out = [(s, s, 0) for s in seeds]
    for s in {s for s in seeds if s is not None}:
        seen, last = {s}, {s}
        for hop in range(1, hops + 1):
            last = {y for a, b in edges for x, y in ((a, b), (b, a)) if x is not None and x in last} - seen
            seen |= last
            out += [(s, n, hop) for n in last]
    return sorted(out, key=str)


def test_neighbours_against_a_plain_search(spark, monkeypatch):
    for k, v in {"SEEDS": 5, "EDGES": 40, "NODES": 3}.items():
        monkeypatch.setattr(lookup, k, v, raising=False)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # nodes go on in the next batch
    try:
        r = random.Random(3)
        edges = [(f"c{r.randrange(60)}", r.choice(["y1", "y2", "y3", "y4", "y5", None, f"c{r.randrange(60)}"])) for _ in range(110)] + [(None, "y1"), ("c1", "c1")]
        seeds = ["c1", "c2", "c2", "c59", "y1", "nowhere", None] + [f"c{i}" for i in range(20, 45)]
        asked = spark.createDataFrame([(s,) for s in seeds], "node string")
        for hops in (0, 1, 2, 4):
            got = lookup.neighbours(spark.createDataFrame(edges, "a string, b string"), asked, hops).collect()
            assert sorted(map(tuple, got), key=str) == reached(edges, seeds, hops), hops
        none = spark.createDataFrame([], "node string")
        assert not lookup.neighbours(spark.createDataFrame(edges, "a string, b string"), none, 2).collect()
        assert lookup.neighbours(spark.createDataFrame([], "a string, b string"), asked, 2).count() == len(seeds)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_pairs_that_many_edges_make_are_not_rows(spark):
    """200 seeds and 300 others meet in 20 nodes: each pair twenty times over."""
    edges = spark.range(500).select(F.concat(F.lit("c"), "id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("b")).select("a", F.concat(F.lit("y"), "b").alias("b"))
    out = lookup.neighbours(edges, spark.range(200).select(F.concat(F.lit("c"), "id").alias("node")), 2)
    assert out.count() == out.distinct().count() == 200 + 200 * 20 + 200 * 499
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
