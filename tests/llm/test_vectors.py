"""Clustering and whitening against brute force in plain Python integers and numpy, and against SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from compare import same
from ledgerloom.llm import clustering, common, queries, whitening

SMALL = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, id long, w int, x string"


def lloyd(rows, k=8, rounds=10):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha) of each row of (id, integers), by the rule as it is written."""
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in start]
    near = lambda v: min(range(len(c)), key=lambda i: (d(v, c[i]), i))
    for _ in range(rounds):
        own = [near(v) for _, v in rows]
        for i in range(len(c)):
            mine = [v for (_, v), o in zip(rows, own) if o == i]
            if mine:
                c[i] = [math.floor(sum(x) / 1) // len(mine) for x in zip(*mine)]
    own = [near(v) for _, v in rows]
    far = [d(v, c[o]) for (_, v), o in zip(rows, own)]
    return sorted(((i, o, f, sum(x for x, p in zip(far, own) if p == o), sum(far), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, f in zip(rows, own, far)), key=str)


def test_clusters_equal_brute_force(spark):
    r = random.Random(5)
    centre = [[r.uniform(-2, 2) for _ in range(4)] for _ in range(5)]
    rows = [(i, [x + r.choice([0.0, 0.25, -0.125, r.gauss(0, 0.5)]) for x in r.choice(centre)]) for i in range(2600)]
    rows += [(7, rows[7][1])] * 60 + [(None, [0.5, -0.5, 0.25, 9.0])] + [(3000 + i, [1.0, 1.0, -1.0, 0.0]) for i in range(300)]
    odd = [(5000, None), (5001, []), (5002, [1.0, 2.0, 3.0]), (5003, [1.0, None, 0.0, 0.0]), (5004, [float("nan"), 0.0, 0.0, 0.0]), (5005, [float("inf"), 0.0, 0.0, 0.0]), (5006, [0.0] * 5)]
    common.ship(spark)
    df = spark.createDataFrame([(*x, 1, 2, "c") for x in rows + odd], ROWS).repartition(3)
    got = sorted((tuple(x) for x in clustering.clusters(df, width=4).collect()), key=str)
    exact = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    assert got == lloyd(exact)


def test_filtering_is_exact_at_ties():
    """Integer points with many ties: the trees' owners are the first nearest centroids, whole nodes or not."""
    r = np.random.default_rng(2)
    for width, n in ((1, 700), (2, 500), (5, 900)):
        points = r.integers(-6, 7, (n, width))
        c = np.unique(r.integers(-6, 7, (9, width)), axis=0)
        c = np.concatenate([c, c[:2]])  # equal centroids: the smaller number wins
        order, shape, sums, boxes = clustering.grow(points)
        want = np.array([min(range(len(c)), key=lambda i: (((p - c[i]) ** 2).sum(), i)) for p in points[order]])
        assert (clustering.nearest(points[order], shape, boxes, c) == want).all()
        counts, total = clustering.totals(points[order], shape, sums, boxes, c)
        assert (counts == np.bincount(want, minlength=len(c))).all()
        assert all((total[i] == points[order][want == i].sum(0)).all() for i in range(len(c)))
    whole = sum(len(nodes) for nodes, *_ in clustering.walk(shape, boxes, np.array([[0] * 5, [1000] * 5])))
    assert whole == 1  # the far centroid is pruned at the root


def test_clusters_of_few_rows(spark):
    common.ship(spark)
    none = spark.createDataFrame([], ROWS)
    assert clustering.clusters(none).collect() == [] and clustering.clusters(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    two = spark.createDataFrame([(1, [1.0] * 64, 0, 0, ""), (2, [3.0] * 64, 0, 0, "")], ROWS)
    assert sorted((r.vec_id, r.distance) for r in clustering.clusters(two).collect()) == [(1, 0), (2, 0)]
    with pytest.raises(Exception, match="scaled component"):
        clustering.clusters(spark.createDataFrame([(1, [1e9] * 64, 0, 0, "")], ROWS)).collect()


def test_clusters_equal_sql(spark):
    assert not same(spark, "op11_clusters", queries.op11_clusters, queries.ORACLE_SQL["op11_clusters"], SMALL)


def whitened_by_hand(rows, most=8):
    """n, {id: deviation}, eigenvalues' shares and |whitened| by exact sums and one numpy decomposition; rows: (id, integers)."""
    n, width = len(rows), len(rows[0][1])
    s = [sum(v[i] for _, v in rows) for i in range(width)]
    y = [[n * a - b for a, b in zip(v, s)] for _, v in rows]
    cov = np.array([[float(sum(a[i] * a[j] for a in y) / n**3) for j in range(width)] for i in range(width)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    w = (np.array(y, dtype=float) / n) @ u / np.sqrt(e)
    return n, [sum(a * a for a in r) for r in y], e / np.trace(cov), w


@pytest.mark.parametrize("width", [3, 20, 37])
def test_whitening_equals_brute_force(spark, width):
    r = random.Random(width)
    scale = [r.uniform(0.1, 3) for _ in range(width)]
    rows = [(i, [r.gauss(5 * (k % 3), s) for k, s in enumerate(scale)]) for i in range(230)]
    common.ship(spark)
    odd = [(900, None), (901, [float("nan")] * width), (902, [None] * width)]
    df = spark.createDataFrame([(*x, 1, 2, "c") for x in rows + odd], ROWS).repartition(3)
    got = whitening.whiten(df).collect()
    n, deviation, share, w = whitened_by_hand([(i, [math.floor(1024 * float(np.float32(x))) + 100000 for x in v]) for i, v in rows])
    most = min(8, width)
    assert len(got) == 230 * most and {g.component for g in got} == set(range(1, most + 1)) and {g.n for g in got} == {230}
    assert max(g.identity_error for g in got) < 1e-8
    sign = {g.component: math.copysign(1, g.whitened * w[0, g.component - 1]) for g in got if g.vec_id == 0}
    for g in got:
        assert g.deviation == deviation[g.vec_id]
        assert g.explained == pytest.approx(share[g.component - 1], rel=1e-9)
        assert g.whitened == pytest.approx(sign[g.component] * w[g.vec_id, g.component - 1], abs=1e-7)


def test_whitening_in_small_blocks_and_large_numbers(spark, monkeypatch):
    """Many row blocks and held tiles that are handed on give the same; so does arithmetic beyond doubles."""
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(40)]) for i in range(300)]
    common.ship(spark)
    df = spark.createDataFrame([(*x, 1, 2, "c") for x in rows], ROWS).repartition(2)
    usual = sorted(map(tuple, whitening.whiten(df).collect()))
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "HELD", 1)
    assert sorted(map(tuple, whitening.whiten(df).collect())) == usual
    large = spark.createDataFrame([(i, [x * 2**22 for x in v], 1, 2, "c") for i, v in rows], ROWS)
    for a, b in zip(usual, sorted(map(tuple, whitening.whiten(large).collect()))):
        assert a[:2] == b[:2] and abs(abs(a[4]) - abs(b[4])) < 1e-2 and b[6] < 1e-7


def test_whitening_of_few_rows(spark):
    common.ship(spark)
    assert whitening.whiten(spark.createDataFrame([], ROWS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, 0, "")], ROWS)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 0, 0, "")], ROWS)).collect()
    assert [(g.vec_id, g.component, g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(None, c, 0, 0.0, 0.0, 0.0) for c in (1, 2)]
    # Unequal lengths: what is missing counts as 0. The second dimension never varies: whitened to 0, and no error.
    got = whitening.whiten(spark.createDataFrame([(1, [1.0], 0, 0, ""), (2, [-1.0, 0.0], 0, 0, ""), (2, [-1.0, 0.0], 0, 0, ""), (3, [], 0, 0, "")], ROWS)).collect()
    x = np.array([1.0, -1, -1, 0])
    want = (x - x.mean()) / x.std()
    assert sorted(round(abs(g.whitened), 9) for g in got if g.component == 1) == sorted(np.abs(want).round(9)) and all(g.whitened == 0 for g in got if g.component == 2)
    assert {round(g.explained, 12) for g in got} == {0.0, 1.0} and max(g.identity_error for g in got) < 1e-9
