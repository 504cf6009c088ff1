"""The quality classifier: a plain-loop forward pass, gradients by differences, held-out labels, edge cases."""

import random

import numpy as np
import pytest
from ledgerloom.llm import common, quality, queries
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"


def by_hand(net, text):
    """The logit of a text, one span, chunk and filter after the other."""
    p = {k: a.astype(np.float64) for k, a in net.p.items()}
    places = max(1, len(text))
    symbols = [*text, *[quality.END] * (quality.SPAN + quality.PIECE)]
    value = [sum(p["E"][symbols[i + k]] @ p["W"][k] for k in range(quality.SPAN)) for i in range(places)]
    size, step = quality.PIECE * quality.CHUNK, quality.PIECE * quality.STEP
    pools, at = [], 0
    while True:
        pools.append(np.maximum(np.max(value[at : at + size], axis=0) + p["c"], 0))
        at += step
        if at + size - step >= -(-(places + quality.SPAN - 1) // quality.PIECE) * quality.PIECE:
            break
    x = np.concatenate([np.max(pools, axis=0), np.mean(pools, axis=0)])
    return float(np.tanh(x @ p["H"] + p["h"]) @ p["o"] + p["s"][0])


def test_forward_pass_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 256)
    net, r = quality.Network(3), random.Random(3)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 7, 8, 63, 64, 65, 127, 128, 129, 255, 256, 257, 320, 385, 1000, 2049)]
    assert np.allclose(net.logits(texts), [by_hand(net, t) for t in texts], atol=1e-4)
    assert np.allclose(net.logits(texts[5:6]), net.logits(texts)[5:6], atol=1e-6)


def test_gradients():
    net, r = quality.Network(1), np.random.default_rng(1)
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    texts, y = [bytes(r.integers(97, 105, n).astype(np.uint8)) for n in (3, 90, 300, 700)], np.array([0, 1, 1, 0])

    def loss():
        q = 1 / (1 + np.exp(-net.logits(texts).astype(np.float64)))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    g = net.step(texts, y)
    for name, a in net.p.items():
        flat = np.flatnonzero(np.abs(g[name].ravel()) > 1e-3)
        for i in r.permutation(flat)[:4]:
            at, old = np.unravel_index(i, a.shape), a.ravel()[i]
            a[at] = old + 2e-3
            up = loss()
            a[at] = old - 2e-3
            down = loss()
            a[at] = old
            assert abs((up - down) / 4e-3 - g[name][at]) < 0.03 * abs(g[name][at]) + 2e-3, name


def test_any_part_of_a_text_counts():
    """The mark of label 0 stands at one place of an otherwise plain text: first, middle or last."""
    r = random.Random(9)
    plain = lambda n: " ".join(r.choice("alpha beta gamma delta omega".split()) for _ in range(n)).encode()
    marked = lambda: (lambda a, b: a + b" #@#@#@ " + b)(plain(r.randrange(0, 200)), plain(r.randrange(0, 200)))
    net = quality.fit([(marked(), 0) for _ in range(150)] + [(plain(r.randrange(2, 400)), 1) for _ in range(150)], 0.5)
    p = quality.scores(net, [plain(3000) + b" #@#@#@", b"#@#@#@ " + plain(3000), plain(1500) + b" #@#@#@ " + plain(1500), plain(3000), plain(5)])
    assert (p[:3] < 0.3).all() and (p[3:] > 0.7).all()


def test_held_out_documents(spark):
    common.ship(spark)
    labels = common.table(spark, SMALL, "labels")
    rows = queries.op13_quality(spark, SMALL).join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    low = [r for r in rows if r.quality == 0]
    assert len(low) >= 5 and sum(r.predicted == 0 for r in low) >= 0.8 * len(low)
    assert sum(r.predicted == 0 for r in rows if r.quality == 1) <= 0.03 * len(rows)


def test_edge_cases(spark, monkeypatch):
    common.ship(spark)
    kind = "doc_id long, text string, score string, lang string"
    docs = spark.createDataFrame([(1, None, "s", "en"), (2, "", None, None), (3, "ab", "s", "en"), (3, "ab", "s", "en"), (4, "x" * 30_000, "s", "en"), (None, "ab", "s", "en")], kind)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, 0), (2, None)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "STEPS", 20)
    net = quality.train(docs, labels)
    got = quality.score(docs, net).collect()
    assert len(got) == 6 and quality.score(docs, net).columns == ["doc_id", "text", "lang", "score"]
    assert len({r.score for r in got if r.text == "ab"}) == 1 and len({r.score for r in got if not r.text}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), net).collect() == []
    assert quality.train(docs, labels.where("quality = 1")) == 1.0 and quality.train(docs, labels.limit(0)) == 0.0
    assert {r.score for r in quality.score(docs, 0.5).collect()} == {0.5}
    # Above the bound in bytes a row is not used in part: with one label left, no network is trained.
    assert len({r.score for r in quality.score(spark.createDataFrame([(5, "xy " * 200_000, "", "")] * 2, kind), net).collect()}) == 1
    monkeypatch.setattr(quality, "ROW_BYTES", 1000)
    assert quality.train(docs, labels.where("doc_id in (3, 4)")) == pytest.approx(0.5)
    assert quality.train(docs.where(F.lit(False)), labels) == pytest.approx(1 / 3)
