"""Near-duplicate files and mentions against all pairs, in plain Python."""

import random

import pytest
from compare import same
from ledgerloom.operators import similar
from ledgerloom.plans import catalogue
from ledgerloom.plans import similar as plans  # noqa: F401
from pyspark.sql import functions as F


@pytest.mark.parametrize("least", [(3, 5), (1, 2), (9, 10), (1, 1)])
def test_prefixes_lose_no_pair(spark, least):
    r = random.Random(least[1])
    groups = [[f"{g}-{i}" for i in range(r.randint(1, 24))] for g in range(12)]
    sets = {}
    for i in range(160):
        own = r.choice(groups)
        s = {x for x in own if r.random() < 0.85} | {f"s{r.randrange(30)}" for _ in range(r.randrange(3))} | ({"everywhere"} if r.random() < 0.7 else set())
        sets[i] = frozenset(s or {"alone"})
    df = spark.createDataFrame([(i, p) for i, s in sets.items() for p in s], "id int, print string")
    node = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    alike = lambda a, b: least[1] * len(a & b) >= least[0] * len(a | b)
    want = {(i, node[i], sum(alike(sets[node[i]], sets[j]) for j in set(node.values()) if j != node[i])) for i in sets}
    got = similar.near_duplicate_files(df, "id", least).collect()
    assert {(r.id, r.node, r.links) for r in got} == want and len(got) == len(sets)
    assert least == (1, 1) or any(n for *_, n in want)


def test_no_files(spark):
    assert similar.near_duplicate_files(spark.createDataFrame([], "id int, print string"), "id").collect() == []


def test_mentions_equal_every_pair(spark, monkeypatch):
    r = random.Random(8)
    names = {i: "".join(r.choice("ab ") for _ in range(r.randint(1, 6))).strip() or "a" for i in range(120)}
    names[500], names[501] = names[3], "zz top"  # an equal name, and one that is nowhere
    texts = {i: "".join(r.choice("ab _") for _ in range(r.randint(0, 60))) for i in range(90)}
    texts[90] = "b" * 5000 + " a"

    def has(t, n):
        if len(n) > 2:
            return n in t
        word = set("ab_")
        return any(t.startswith(n, k) and (k == 0 or t[k - 1] not in word) and (k + len(n) == len(t) or t[k + len(n)] not in word) for k in range(len(t)))

    want = {(k, i) for k, t in texts.items() for i, n in names.items() if has(t, n)}
    t = spark.createDataFrame([*texts.items(), (99, None)], "k int, t string")
    n = spark.createDataFrame([*names.items(), (600, None), (601, "")], "id int, n string")
    ask = lambda **o: {tuple(x) for x in similar.mentions(t, n, "k", F.col("t"), F.col("n"), "id", **o).collect()}
    assert ask() == want and len(want) > 500
    assert ask(least=4) == {(k, i) for k, i in want if len(names[i]) >= 4}
    monkeypatch.setattr(similar, "PART_NAMES", 30)  # the dictionary in several automata
    assert ask() == want
    assert similar.mentions(t, n.limit(0), "k", F.col("t"), F.col("n"), "id").collect() == []


def test_longest_mentions(spark):
    found = spark.createDataFrame([(1, "plan"), (1, "resource plan"), (1, "sprint"), (2, "plan")], "k int, name string")
    assert sorted(tuple(r) for r in similar.longest_mentions(found, "k", "name").collect()) == [(1, "resource plan"), (1, "sprint"), (2, "plan")]


def test_sheet_digest_sees_values_alone(spark):
    kind = "k int, place int, sheet string, row int, col int, value string"
    a = [(0, "S", 1, 1, "x"), (0, "S", 2, 1, "y"), (1, "T", 1, 1, None)]
    given = {1: a, 2: a[::-1], 3: [*a, (0, "S", 9, 9, None)], 4: a[:2], 5: [(0, "S", 1, 1, "x"), (0, "S", 1, 2, "y"), a[2]]}
    got = {r.k: r.digest for r in similar.sheet_digest(spark.createDataFrame([(k, *c) for k, cs in given.items() for c in cs], kind), "k").collect()}
    assert got[1] == got[2] == got[3] and len({got[1], got[4], got[5]}) == 3


@pytest.mark.parametrize("name", ["near_duplicate_files", "mentioned_names", "sheet_digests"])
def test_as_sql(spark, name):
    assert not same(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_ids_of_few_names_are_sent_to_the_texts(spark):
    texts = spark.createDataFrame([(i, "a the x") for i in range(50)], "doc long, t string")
    names = spark.createDataFrame([("the", 1), ("the", 2), ("zed", 3)], "name string, id int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = similar.mentions(texts, names, "doc", F.col("t"), F.col("name"), "id")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == [(i, k) for i in range(50) for k in (1, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_text_is_read_once_a_size_of_names(spark, monkeypatch):
    names = [f"customer#{i:04d}" for i in range(300)] + ["a", "ab", "đức", "đ", "é#", "zz"]
    texts = {1: "customer#0007customer#0299 customer#0300", 2: "ab-a_ đức xđ", 3: "đ é#zz", 4: "", 5: None, 6: "zcustomer#0001", 7: "_a ab"}
    whole = lambda n, t: any(t[i : i + len(n)] == n and not (t[max(0, i - 1) : i] + t[i + len(n) : i + len(n) + 1]).strip("-# đéức") for i in range(len(t)))
    want = {(k, n) for k, t in texts.items() if t for n in names if (n in t if len(n) > 2 else whole(n, t))}
    t, n = spark.createDataFrame(list(texts.items()), "k int, t string"), spark.createDataFrame([(x,) for x in names], "n string")
    monkeypatch.setattr(similar, "PART_NAMES", 10)
    found = similar.mentions(t, n, "k", F.col("t"), F.col("n"), "n")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in found.collect()} == want and len(want) > 8


def test_what_lasts_is_made_once(spark):
    from ledgerloom.operators.lookup import lasting

    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    got = lasting(spark.range(7).mapInArrow(run, "id long"))
    assert sorted(r.id for r in got.collect()) == list(range(7)) and made.value == 7
