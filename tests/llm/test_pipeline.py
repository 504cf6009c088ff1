"""Each stage of the pipeline, on what its predecessor kept, against a brute-force version."""


from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
from ledgerloom.llm import common, queries, toxicity
from test_operators import SMALL, components, personal, pii_terms, sets
from tokenizers import Tokenizer


def clean(text, terms):
    """text without personal data and the words at terms (start, end)."""
    spans = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (p.split(":") for p in personal(text).split(",") if p)]
    spans += [(a, b, "[NUMBER]" if text[a:b].isascii() and text[a:b].isdigit() else "") for a, b in terms]
    out, at = [], 0
    for a, b, label in sorted(spans):
        out += [text[at : max(a, at)], label if b > at else ""]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    docs = common.table(spark, SMALL, "documents")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    net = toxicity.train(docs, common.table(spark, SMALL, "labels"), queries.held_out)
    docs = common.cut(stages["toxicity"](spark, docs, SMALL))
    got = {r.doc_id for r in docs.collect()}
    s = toxicity.scores(net, [(r.text or "").encode() for r in rows.values()])
    assert got == {i for i, x in zip(rows, s) if x < queries.THRESHOLD} and 0 < len(got) < len(rows) and docs.columns == columns

    c = components(sets([(i, rows[i].text) for i in got]))
    docs = common.cut(stages["near_dedup"](spark, docs, SMALL))
    kept = sorted(r.doc_id for r in docs.collect())
    assert kept == sorted(i for i in got if c[i] == i) and docs.columns == columns

    docs = common.cut(stages["pii"](spark, docs, SMALL))
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = dict(zip(kept, pii_terms([rows[i].text for i in kept])))
    assert texts == {i: clean(rows[i].text, told[i]) for i in kept} and docs.columns == columns
    assert sum(texts[i] != rows[i].text for i in kept) > 3

    docs = common.cut(stages["mixing"](spark, docs, SMALL))
    mixed = docs.collect()
    size = Counter()
    for i in kept:
        size[rows[i].source] += len(texts[i].encode().split())
    taken, own = Counter(), defaultdict(int)
    for r in mixed:
        ws = Counter(r.text.encode().split())
        assert not ws - Counter(texts[r.doc_id].encode().split()) and r.n_chars == len(r.text)
        taken[r.source] += ws.total()
        own[r.doc_id] += ws.total()
    assert all(n <= 3 * len(texts[i].encode().split()) for i, n in own.items()) and docs.columns == columns
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda x: x.encode()))}
    full = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        want = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in size if x not in full) for s in size}
        over = {s for s in size if s not in full and want[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 200 for s in size)

    library = Tokenizer.from_file(queries.vocabulary())
    out = stages["packing"](spark, docs, SMALL).collect()
    assert sum(r.length for r in out) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(by) * 2048 < 1.02 * sum(r.length for r in out) + 2048


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, extra columns, empty tables, stage by stage."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, `_may` int"
    words = [f"{a}{b}" for a in "klmnprstvw" for b in ("ara", "eno", "ilu", "opi", "uma")]
    long = " ".join(words)
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (3, long + " zz", "en", "s", 1), (4, long, "en", "t", 1), (None, long, "fr", "s", 1), (None, None, None, "s", None), (5, " ".join(reversed(words)), "en", None, 1)]
    docs = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], kind)
    columns = list(pipeline.COLUMNS)
    stages = dict(pipeline.STAGES)
    docs = stages["toxicity"](spark, docs, SMALL)
    assert docs.columns == columns
    kept = stages["near_dedup"](spark, common.cut(docs), SMALL)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == columns and got == Counter({(1, None): 1, (2, ""): 1, (3, long): 1, (None, long): 1, (None, None): 1, (5, rows[-1][1]): 1})
    kept = common.cut(kept)
    clean = common.cut(stages["pii"](spark, kept, SMALL))
    assert clean.count() == 6 and clean.columns == columns and {r.doc_id: r.text for r in clean.where("doc_id <= 2").collect()} == {1: None, 2: ""}
    mixed = common.cut(stages["mixing"](spark, clean, SMALL))
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {3, 5, None} and all(r.text for r in mixed.collect())
    assert stages["packing"](spark, mixed, SMALL).count() >= mixed.count()
    none = spark.createDataFrame([], kind)
    for name, stage in pipeline.STAGES:
        none = common.cut(stage(spark, none, SMALL))
        assert none.count() == 0, name


def test_cutting_lets_the_driver_collect_its_garbage(spark, monkeypatch):
    """What only weak references hold is gone once a table is cut, but not again within RELEASE_S."""
    from ledgerloom.llm import common

    def kept() -> bool:
        held = spark._jvm.java.lang.Object()
        weak = spark._jvm.java.lang.ref.WeakReference(held)
        del held
        common.cut(spark.range(3)).count()
        return weak.get() is not None

    monkeypatch.setattr(common, "_released", -1e9, raising=False)
    assert not kept()
    common._released = common.time.monotonic()
    before = common._released
    common.cut(spark.range(3))
    assert common._released == before


def test_the_mix_of_few_long_texts_does_not_go_through_the_driver(spark):
    """What draws and texts grow to is joined where it is; both are small before."""
    docs = spark.createDataFrame([(i, "w " * 20_000, "en", "ab"[i % 2], 40_000) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = dict(pipeline.STAGES)["mixing"](spark, docs, SMALL)
    assert sum(len(r.text.split()) for r in mixed.collect()) >= 80_000 - 4 * 64
    plan = mixed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = plan.split("MapInPandas")[0].splitlines()
    last = next(x for x in reversed(above) if "Join" in x)
    assert "SortMergeJoin" in last


def test_what_python_let_go_is_collected_at_once(spark, monkeypatch):
    from ledgerloom.llm import common

    monkeypatch.setattr(common, "_released", common._released)
    for _ in range(5):  # the thread that tells the JVM sleeps a second between
        held = spark._jvm.java.lang.Object()
        weak = spark._jvm.java.lang.ref.WeakReference(held)
        del held
        common._released = -1e9
        common.release(spark)
        assert weak.get() is None
