import random

from ledgerloom.operators import core
from pyspark.sql import functions as F


def test_cosine_top_meets_in_matrices(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)] if i % 7 else [1.0, 2.0, 3.0, float(i)]) for i in range(400)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec long, v array<float>")
    top = core.cosine_top(df.where("vec % 20 = 0").select(F.col("vec").alias("id"), F.col("v").alias("q")), df, 5, block=64, query_block=8)
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for i, q in rows[::20]:
        best = sorted((-round(sum(a * b for a, b in zip(q, v)) / (norm(q) * norm(v)), 6), j) for j, v in rows if j != i)[:5]
        want |= {(i, j, -c, n + 1) for n, (c, j) in enumerate(best)}
    assert {(x.id, x.vec, x.cosine, x["rank"]) for x in top.collect()} == want


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.5, 0.5]), (3, [1.0]), (4, [1.0, None])], "vec long, v array<double>")
    top = core.cosine_top(df.where("vec = 0").select(F.col("vec").alias("id"), F.col("v").alias("q")), df, 5)
    assert sorted((x["rank"], x.vec, x.cosine) for x in top.collect()) == [(1, 2, 0.707107), (2, 1, None), (3, 3, None), (4, 4, None)]
