import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from ledgerloom.llm import chat, common, mixing, near_dedup, ogg, packing, pii, queries, token_counts, topk, toxicity, warc, words
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame([(1, None, None, None, None, "k"), (2, "", "en", "", 0, "k"), (3, "a b c d e f g h i j", "en", "s", 1, None), (3, "a b c d e f g h i j", "en", "s", 1, None), (4, "A B C D E F G H I J", "en", None, 1, "x"), (5, "w" * 9000 + " " + "x y " * 3000, "de", "t", 1, "y"), (None, "a b c d e", "fr", "s", 1, "z")], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    odd = ["a<|endoftext|>b", "İstanbul's ÅNGSTRÖM é café a\x1cb", "ΣΣ Σ. don't I'LL 12.5% x²½ªß", "日本語 á́ ́b foo\x85bar", "", "   ", "don't'll", "x" * 5000]
    split, kept = words.ids(queries.vocabulary()).look_up([t.encode() for t in odd])
    for t, ws in zip(odd, split):
        assert np.frombuffer(b"".join(map(kept.__getitem__, ws)), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    split, kept = words.counts(queries.vocabulary()).look_up([t.encode() for t in odd])
    assert [sum(map(kept.__getitem__, ws)) for ws in split] == [len(whole.encode(t, add_special_tokens=False).ids) for t in odd]


def test_token_counts(docs, none):
    rows = token_counts.token_counts(docs, queries.vocabulary()).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows)[:2] == [(0, 0), (0, 0)] and len(rows) == 7
    assert any(r.over_limit for r in rows) and not token_counts.token_counts(none, queries.vocabulary()).collect()


def test_packing(docs, none):
    rows = packing.pack(packing.pieces(docs, queries.vocabulary())).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows if r.doc_id == 5) == next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert not packing.pack(packing.pieces(none, queries.vocabulary())).collect()


def test_patterns():
    r = random.Random(3)
    h = {r.randint(1, 2048): r.randint(1, 60) for _ in range(700)}
    found, used = packing.patterns(h, 2048), Counter()
    for n, p in found:
        assert sum(p) <= 2048
        for x in p:
            used[x] += n
    assert used == Counter(h)


def test_ogg(docs, none):
    packets = [(b"x", 0), (bytes(70000), 5), (b"", 5), (b"y" * 255, 9)]
    assert [p for p in ogg.decode(b"".join(ogg.pages(7, packets)))[7]["packets"]] == [p for p, _ in packets]
    media = ogg.encode(b"z" * 192, 5)
    for i in range(0, len(media), 7):
        with pytest.raises((ValueError, IndexError)):
            ogg.read(media[:i] + bytes([media[i] ^ 1]) + media[i + 1 :])
    for r in ogg.features(ogg.encode_column(docs)).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), None)
    assert not ogg.features(ogg.encode_column(none)).collect()


def test_warc(spark):
    common.ship(spark)
    big = "é\r\n\r\nWARC/1.1 " * 200
    pages = spark.createDataFrame([(1, "u", big, "x"), (2, "u\r\nv", big, "x"), (3, None, "small", "x"), (4, "u", "small", None), (5, "", None, None), (6, "u", "ß" * 600, None), (7, "u", big, "x")], "page_id long, url string, html string, payload string")
    path = common.new_path(spark, "warc")
    warc.write_archives(pages, path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    for p in pages.collect():
        raw = (p.html or "").encode()
        again = p.page_id in (1, 2)
        assert got[p.page_id] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 7 if again else None)
    path = common.new_path(spark, "warc")
    warc.write_archives(pages.limit(0), path)
    assert not warc.read_archives(spark, path).collect()


def test_top_k(spark):
    common.ship(spark)
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, 0.1]) for _ in range(r.choice([3, 4]))]) for i in range(230)] + [(300, None), (301, [float("nan")]), (302, [None, 1.0]), (303, []), (7, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).withColumn("w", F.lit(2))
    got = [tuple(x) for x in topk.top_k(df.where("vec_id % 50 = 0"), df, query_block=2, row_block=30).collect()]
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows[:230]}
    every = [(i, q[i]) for i in range(230)] + [(303, []), (7, [256] * 3)]
    want = []
    for i in range(0, 230, 50):
        s = sorted(((sum(a * b for a, b in zip(q[i], v)), j) for j, v in every if j != i), key=lambda x: (-x[0], x[1]))[:5]
        want += [(i, k + 1, j, x) for k, (x, j) in enumerate(s)]
    assert sorted(got) == sorted(want)
    # Where no partitions are put together, a block's two sides must still meet.
    was = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert sorted(tuple(x) for x in topk.top_k(df.where("vec_id % 50 = 0"), df, query_block=2, row_block=30).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def components(s):
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i in ids:
        for j in ids:
            if i < j and s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def test_near_dedup(spark, docs, none):
    r = random.Random(5)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(n)] for n in (8, 30, 60, 120)]
    rows = []
    for k in range(240):  # chains of near copies, short and long
        b = list(base[k % 4])
        for _ in range(r.choice([0, 1, 1, 2])):
            b[r.randrange(len(b))] = f"v{r.randint(0, 9)}"
        rows.append((1000 - k, " ".join(b)))
    s = sets(rows)
    want = components(s)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(df).collect()}
    assert got == {i: (len(s[i]), want[i], want[i] == i) for i in s}
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True)]
    assert not near_dedup.near_duplicates(none).collect()


def test_mixing(spark, docs, none):
    rows = mixing.taken(docs).collect()
    assert len(rows) == 7 and all(r.taken <= 3 * r.size for r in rows)
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, rows))
    assert not mixing.taken(none).collect()
    x = np.arange(1000)
    assert sorted(mixing.permuted(x, 1000, 9).tolist()) == x.tolist() != mixing.permuted(x, 1000, 9).tolist()
    big = common.table(spark, SMALL, "documents")
    rows = mixing.taken(big).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert r.taken <= 3 * r.size
        by[r.source_size, r.target][0] += r.taken
    assert all(abs(t - target) <= 0.1 * target + 130 for (_, target), (t, _) in by.items())
    assert abs(sum(t for _, t in by) - sum(r.size for r in rows)) < 1
    texts = mixing.mixed_texts(big).agg(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")))).first()[0]
    assert texts == sum(r.taken for r in rows)


def test_draws_do_not_go_through_the_driver(spark):
    """Counts and documents are few and small here, by Spark's sizes, and would be broadcast with what they grow to."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * 5000) for i in range(8)], "doc_id long, source string, text string")
    _, spans = mixing.mix(docs, block=4)
    assert sum(r.words for r in spans.collect()) >= 40_000 - 8
    plan = spans._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan.split("MapInPandas")[0] and "BroadcastHashJoin" not in plan.split("MapInPandas")[0]


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def personal(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark, none):
    r = random.Random(2)
    odd = ["a@b.c.@d.e f@@g.h a@b a@b@c.d.e", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 00000000256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111-1 4111111111111111", "+1 (555) 010-9999 +12 +1-2 +1 555 010 9999 8888 7777", "😀 x@y.zz 😀 +15550109999 é 10.0.0.1", None, "", "1" * 5000 + " " + "1-" * 3000, "a." * 4000 + "@" + "b-" * 300 + ".c"]
    odd += ["".join(r.choice("aB1.@+- 45(") for _ in range(60)) for _ in range(300)]
    odd += [f"text {w} call smith at x@y.zz {w} now" for w in ("one", "two", "six")] + ["plain words with nothing else in them"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.digest(*pii.disclosures(df), "doc_id").collect()}
    for i, t in enumerate(odd):
        assert got[i].base_sha256 == hashlib.sha256(personal(t or "").encode()).hexdigest(), t
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert "smith" not in clean[309] and "[EMAIL]" in clean[309] and clean[340] == odd[340]
    assert not pii.digest(*pii.disclosures(none), "doc_id").collect()


def test_pii_counts_texts_not_copies(spark):
    """An entity of three distinct texts, one of them in 200 copies: copies change no count, so its only term is still found."""
    rows = [f"call smith at x@y.zz {w} now" for w in ("one", "two", "six")] + ["call smith at x@y.zz one now"] * 200 + [f"call now at one two six plain{i}" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert all("smith" not in clean[i] and "call" in clean[i] for i in range(203))


def pii_terms(rows):
    """Brute force: {row: spans of terms}, with distinct texts as the unit and every word of a text as a candidate."""
    texts = {t: ([p.split(":") for p in personal(t).split(",") if p]) for t in {t or "" for t in rows}}
    words, named = {}, {}
    for t, spans in texts.items():
        cuts = [(int(a), int(b)) for _, a, b in spans]
        words[t] = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W]+", t) if not any(a < m.end() and m.start() < b for a, b in cuts)]
        named[t] = {f"{k}:{t[int(a):int(b)].lower()}" for k, a, b in spans}
    has = lambda f: Counter(x for t in texts for x in f(t))
    n, n_t, n_e = len(texts), has(lambda t: {w for *_, w in words[t]}), has(lambda t: named[t])
    n_te = has(lambda t: {(w, e) for *_, w in words[t] for e in named[t]})
    told = {w for (w, e), k in n_te.items() if k >= 2 and np.log2(n / n_e[e]) >= 3 and np.log2(k * n / (n_t[w] * n_e[e])) >= 0.9 * np.log2(n / n_e[e])}
    return [[(a, b) for a, b, w in words[t or ""] if w in told] for t in rows]


def test_pii_marks_terms_anywhere(spark):
    """The name far from the address, before it, twice, and in a text without it; copies of a text; against brute force."""
    far = "filler words in between that every text has, more than a hundred characters of them, so that no window reaches over " * 2
    rows = [f"mail x@y.zz {far} yours Smith {w}" for w in ("one", "two", "six", "ten")] + [f"Smith, smith. {far} x@y.zz and 10.0.0.1"] + [f"only SMITH is named here {far}", None, ""]
    rows += [f"{far} one two six ten only is named here yours mail and plain{i}" for i in range(70)] + [rows[0]] * 30
    r = random.Random(5)
    rows += [" ".join([f"w{r.randint(0, 60)}", f"u{i % 7}@h.org", "é\uffffx", f"Q{i % 7}", f"z{r.randint(0, 9)}"]) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: [tuple(map(int, p.split(":")[1:])) for p in x.spans.split(",") if p.startswith("term:")] for x in pii.digest(*pii.disclosures(df), "doc_id").collect()}
    want = pii_terms(rows)
    assert [sorted(got[i]) for i in range(len(rows))] == want and len(want[4]) >= 2 and want[5]
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert not any("smith" in (clean[i] or "").lower() for i in range(len(rows))) and clean[6] is None and clean[8] == rows[8]


def test_chat(spark):
    c = spark.createDataFrame([(1, 0, "user", "Hello there\nHow are you?", 1), (1, 1, "assistant", "> how  are you?\nFine.", 1), (1, 2, "user", "On Monday X wrote:\n> > How are you?\n> Fine.\nGood", 1), (1, 3, "user", None, 1), (2, 0, "user", "> never said\nok", 1), (1, 4, "user", ">Good", 1), (None, 0, None, "> Good\nx", 1)], "conv_id long, turn long, role string, text string, row int")
    got = sorted((x.conv_id or 0, x.turn, x.n_linked, -1 if x.reply_to is None else x.reply_to, x.root_turn, x.depth, x.text) for x in chat.link(c).collect())
    assert got == [(0, 0, 0, -1, 0, 0, "x"), (1, 0, 0, -1, 0, 0, "Hello there\nHow are you?"), (1, 1, 1, 0, 0, 1, "Fine."), (1, 2, 2, 1, 0, 2, "Good"), (1, 3, 0, -1, 3, 0, ""), (1, 4, 1, 2, 0, 3, ""), (2, 0, 0, -1, 0, 0, "ok")]
    assert not chat.link(c.limit(0)).collect()


def test_toxicity(spark, docs):
    r = random.Random(4)
    say = lambda bad: " ".join(["vile" if bad and i % 30 == 7 else f"w{r.randint(0, 300)}" for i in range(90)])
    rows = [(say(i % 4 == 0).encode(), int(i % 4 == 0)) for i in range(240)]
    net = toxicity.fit(rows[:160], 0.25, steps=60)
    s, y = toxicity.scores(net, [t for t, _ in rows[160:]]), np.array([v for _, v in rows[160:]])
    assert s[y == 1].min() > s[y == 0].max()
    assert ((s >= 0.3) == y).all()
    out = toxicity.score(docs, net).collect()
    assert len(out) == 7 and all(0 <= x.score <= 1 for x in out)
    assert toxicity.fit(rows[:1], 1.0) == 1.0


def test_masks_lose_no_link(spark):
    """Pairs at or above the similarity always pass the masks' bound, at sizes from a few shingles to more than a mask has bits."""
    rng, rows = np.random.default_rng(7), []
    for n in (1, 4, 60, 150, 900, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.concatenate([a[: max(1, int(len(a) * rng.uniform(0.6, 1)))], rng.integers(0, 2**64, n // 8, np.uint64)]))
            both = len(np.intersect1d(a, b))
            x, y = near_dedup.masks([a, b]).tolist()
            rows.append((len(a), x, len(b), y, 100 * both >= 75 * (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "n long, x array<long>, m long, y array<long>, linked boolean")
    got = df.select("linked", near_dedup.may_be_alike(df.n, df.x, df.m, df.y).alias("kept")).collect()
    assert any(r.linked for r in got) and all(r.kept for r in got if r.linked)
    assert not all(r.kept for r in got)


def test_near_dedup_of_long_sets_and_a_hot_bucket(spark):
    """Sets of 300 and more shingles around the similarity, and a family of copies whose members are not all alike to one centre."""
    r = random.Random(11)
    rows = []
    for k in range(6):
        base = [f"w{r.randint(0, 9000)}" for _ in range(r.choice([350, 700, 1500]))]
        for _ in range(12):
            b = list(base)
            for _ in range(int(len(b) * r.choice([0.005, 0.02, 0.028, 0.03, 0.035, 0.05]))):
                b[r.randrange(len(b))] = f"v{r.randint(0, 99)}"
            rows.append((len(rows), " ".join(b)))
    base = [f"q{i}" for i in range(100)]
    for k in range(150):  # each edit changes 5 of 96 shingles, so links form chains in buckets that many share
        b = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            b[r.randrange(100)] = f"e{r.randint(0, 3)}"
        rows.append((len(rows), " ".join(b)))
    s = sets(rows)
    want = components(s)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 10


def test_near_dedup_of_ids_with_several_texts(spark):
    """Texts under one id are linked, and each keeps its own links."""
    say = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(5, say("a")), (5, say("b")), (77, say("b")), (78, say("b") + " more"), (9, say("c")), (80, say("a") + " x")]
    got = {x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id <> 9").collect()}
    assert got == {5}


def test_near_dedup_recall_on_documents(spark):
    """All links of the documents at the smallest scale, against exact links."""
    docs = common.table(spark, SMALL, "documents")
    s = sets([(x.doc_id, x.text) for x in docs.collect()])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(s[i]), c) for i, c in components(s).items()}


def test_maybe_in(spark):
    rows, asked = spark.range(3000).selectExpr("id", "id as _bits0"), spark.range(0, 3000, 7)
    got = {x.id for x in common.maybe_in(rows, "id", asked).collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 500
    told = common.maybe_in(rows, "id", asked, name="hit").collect()
    assert len(told) == 3000 and {x.id for x in told if x.hit} == got
    assert len(common.maybe_in(rows, "id", asked, bits=64).collect()) == 3000


def test_pii_keeps_other_columns_and_long_lists(spark):
    """Columns named as the operator's own stay; a text of thousands of entities gives all of them."""
    many = " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.{i % 7}" for i in range(3000))
    rows = [(1, "mail a@b.cc", "s", 1, "k", 0), (2, "plain", "t", 2, None, 1), (3, None, "u", 3, "k", 2), (4, many, "v", 4, "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, text_key long, found string, row int")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).schema == df.schema and got[1].text == "mail [EMAIL]" and got[1].spans == "s" and got[3].text is None
    assert got[4].text == " ".join(["[EMAIL] [IP]"] * 3000)
    own = {r.doc_id: r for r in pii.digest(*pii.disclosures(df), "doc_id").collect()}
    assert (own[4].n_email, own[4].n_ip) == (3000, 3000) and own[4].base_sha256 == hashlib.sha256(personal(many).encode()).hexdigest()


def test_mixing_targets_draws_and_permutations(spark):
    """Targets against a plain loop, one multinomial count for each shard, each block read in each pass once."""
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", "c", "d", None, "é", "tiny"]), r.randint(0, 90)) for i in range(900)]
    rows = [(i, s, 2 if s == "tiny" else n) for i, s, n in rows]
    df = spark.createDataFrame([(i, s, " ".join(["w"] * n), 1, 2, "x") for i, s, n in rows], "doc_id long, source string, text string, row int, turn int, parts string")
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight, full, want = {s: i % 3 + 1 for i, s in enumerate(order)}, set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        want = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if want[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    assert full
    named, spans = mixing.mix(df, block=4, shard_blocks=500)
    for x in named.select("src", "target").distinct().collect():
        assert abs(x.target - want[x.src]) < 1e-6 * want[x.src]
    plan = named.select("src", "source_size", "target").distinct()
    drawn = mixing.slots(plan, 1, 4, 500, 3).collect()
    assert sorted(map(str, drawn)) == sorted(map(str, mixing.slots(plan, 1, 4, 500, 3).collect()))
    by, shards = defaultdict(list), defaultdict(Counter)
    for x in drawn:
        by[x.src].append((x.slot, x.block))
        shards[x.shard][x.src] += 1
    for s, own in by.items():
        n = -(-size[s] // 4)
        assert sorted(j for j, _ in own) == list(range(len(own))) and len(own) <= 3 * n
        for turn in range(3):
            blocks = [b for j, b in own if j // n == turn]
            assert len(set(blocks)) == len(blocks) and all(0 <= b < n for b in blocks)
    whole = [c for k, c in shards.items() if k < max(shards)]
    assert len(whole) > 5 and all(sum(c.values()) == 500 for c in whole)
    for s in ("a", "c"):  # the spread over shards is that of draws: no fixed counts, no more than chance
        p = want[s] / sum(want.values())
        z = [(c[s] - 500 * p) / (500 * p * (1 - p)) ** 0.5 for c in whole]
        assert 0.3 < sum(x * x for x in z) / len(z) < 2.5
    took = Counter()
    for x in named.join(spans.groupBy("row").agg(F.sum("words").alias("t")), "row").collect():
        took[x.src] += x.t
        assert x.t <= 3 * x.size
    assert all(abs(took[s] - want[s]) <= 13 for s in order)
    out = mixing.mixed_texts(df)
    assert out.schema == df.schema and {(x.row, x.turn, x.parts) for x in out.collect()} == {(1, 2, "x")}


def chat_by_hand(rows):
    """Brute force of chat.link: rows of (conv, turn, text), turns unique; {(conv, turn): (n_quoted, n_linked, reply_to, root, depth, position)}."""
    plain = lambda t: " ".join(t.lower().split())

    def paragraphs(text):
        out, level, held = [], None, []
        for line in re.split("\r\n|\n|\r", text or ""):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            n, body = marks.count(">"), plain(line[len(marks):])
            if (n != level or not body) and held:
                out.append((level, held))
                held = []
            level = n
            if body:
                held.append(body)
        return out + ([(level, held)] if held else [])

    def runs(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}

    out, by = {}, defaultdict(dict)
    for c, t, text in rows:
        by[c][t] = paragraphs(text)
    for c, turns in by.items():
        first = {}
        for t in sorted(turns):
            for level, lines in turns[t]:
                if level == 0:
                    whole = " ".join(lines)
                    for h in runs(whole.split()) | {tuple(s.split()) for s in [*lines, *re.split(r"(?<=[.!?…。！？])\s+", whole)] if 0 < len(s.split()) < 5}:
                        first.setdefault(h, t)
        up = {}
        for t, ps in turns.items():
            score, n_linked, quoted = Counter(), 0, [p for p in ps if p[0] > 0]
            for level, lines in quoted:
                own = runs(" ".join(lines).split())
                votes = Counter(first[h] for h in own if first.get(h, t) < t)
                if votes:
                    k, o = max((k, o) for o, k in votes.items())
                    if 2 * k >= len(own):
                        n_linked += 1
                        score[level, o] += k
            if score:
                up[t] = min((level, -k, -o) for (level, o), k in score.items())[2] * -1
            out[c, t] = [len(quoted), n_linked, up.get(t)]
        kids = defaultdict(list)
        for t in sorted(up):
            kids[up[t]].append(t)
        place = 0
        for root in sorted(t for t in turns if t not in up):
            todo = [(root, 0)]
            while todo:
                t, d = todo.pop()
                out[c, t] += [root, d, place]
                place += 1
                todo += [(k, d + 1) for k in reversed(kids[t])]
    return {k: tuple(v) for k, v in out.items()}


def test_chat_against_brute_force(spark):
    """Nested, re-wrapped, partial, repeated and unknown quotes, and threads with many branches."""
    r = random.Random(6)
    rows = []
    for c in range(25):
        told = []
        for t in range(r.choice([1, 5, 30, 60])):
            own = [" ".join(f"w{r.randint(0, 40)}" for _ in range(r.choice([1, 2, 4, 7, 15]))) + r.choice([".", "!", ""]) for _ in range(r.randint(1, 4))]
            text = r.choice(["\n", " ", "\n\n"]).join(own)
            if told and r.random() < 0.8:
                quoted, body = r.choice(told)
                words = body.split()
                part = words[: max(1, r.randint(len(words) // 2, len(words)))] if r.random() < 0.5 else words
                width = r.choice([3, 8, 100])
                lines = [" ".join(part[i : i + width]) for i in range(0, len(part), width)]
                if r.random() < 0.3:
                    lines += [""] + ["> " + x for x in quoted.split("\n")[:3]]
                mark = r.choice([">", "> ", " > "])
                text = "\n".join(["On Monday X wrote:"] * (r.random() < 0.5) + [(mark + x.upper() if r.random() < 0.3 else mark + x) for x in lines] + [text])
            if r.random() < 0.1:
                text += "\n> words of nobody that were never said before " + str(t)
            told.append((text, " ".join(own)))
            rows.append((c, t, text))
    df = spark.createDataFrame([(c, t, "user", x, 1, 2) for c, t, x in rows], "conv_id long, turn long, role string, text string, place int, position int")
    got = {(x.conv_id, x.turn): (x.n_quoted, x.n_linked, x.reply_to, x.root_turn, x.depth, x.position) for x in chat.link(df).collect()}
    want = chat_by_hand(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len(got) == len(rows) and max(v[4] for v in want.values()) >= 4 and sum(v[2] is not None for v in want.values()) > 200


def test_gradient():
    """Each gradient against differences of the loss."""
    r = np.random.default_rng(3)
    words = [b"alpha", b"beta", b"gamma", b"delta", b"xi"]
    net = toxicity.Network(words[:4], np.array([0.5, -0.5, 0.2, 0.0], np.float32))
    net.p = {k: (v + 0.1 * r.standard_normal(v.shape)).astype(np.float64) for k, v in net.p.items()}
    index, within = r.integers(0, 5, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW), bool)
    within[1, 9:] = False
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        x = net.run(net.projected(net.inputs(words).astype(np.float64)), index, within)
        return float(np.mean(np.logaddexp(0, x) - y * x))

    g = net.step(words, index, within, y)
    for k, a in net.p.items():
        spots = [tuple(r.integers(0, n) for n in a.shape) for _ in range(4)] + [tuple(np.unravel_index(np.argmax(np.abs(g[k])), a.shape))]
        for at in spots:
            old = a[at]
            a[at] = old + 3e-2
            up = loss()
            a[at] = old - 3e-2
            down = loss()
            a[at] = old
            assert abs((up - down) / 6e-2 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), (k, at)


def test_the_network_reads_order():
    """Equal words in both classes, only their order tells them apart: a list of words is at chance here."""
    r = random.Random(9)

    def say(bad):
        ws = [f"n{r.randint(0, 30)}" for _ in range(14)]
        i = r.randint(0, 11)
        ws[i : i + 2] = ["red", "blue"] if bad else ["blue", "red"]
        return " ".join(ws).encode()

    rows = [(say(i % 2), i % 2) for i in range(900)]
    net = toxicity.fit(rows[:700], 0.5, steps=250)
    s, y = toxicity.scores(net, [t for t, _ in rows[700:]]), np.array([v for _, v in rows[700:]])
    assert ((s >= 0.5) == y).mean() > 0.9


def test_training_uses_no_held_out_label_and_reads_long_texts(spark):
    """Flipped labels of held-out rows change no score; a long text's toxic part counts in the fit; null labels, repeated ids, an empty table."""
    r = random.Random(4)
    say = lambda bad, n=90: " ".join(["vile" if bad and i % 30 == 7 else f"w{r.randint(0, 300)}" for i in range(n)])
    rows = [(i, say(i % 4 == 0, 30_000 if i == 8 else 90), "own") for i in range(160)] + [(3, say(False), "own"), (900, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = [(i, None, int(i % 4 == 0)) for i in range(160)] + [(900, 1, None), (901, 1, 1), (None, 1, 1)]
    out = zlib.crc32
    flipped = [(i, q, 1 - t if i is not None and t is not None and out(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    nets = [toxicity.train(docs, spark.createDataFrame(x, kind), queries.held_out) for x in (labels, flipped)]
    got = [{(x.doc_id, x.score) for x in toxicity.score(docs, net).collect()} for net in nets]
    assert got[0] == got[1] and len(got[0]) > 150
    assert all((s >= 0.3) == (i % 4 == 0) for i, s in got[0] if i < 160 and queries.THRESHOLD)
    assert toxicity.train(docs, spark.createDataFrame([], kind), queries.held_out) == 0.0
    assert not toxicity.score(docs.limit(0), nets[0]).collect()


def test_training_is_not_the_drivers(spark, monkeypatch):
    """The sample's fit runs in a task: its texts and arrays stay out of the driver's memory."""
    import os

    monkeypatch.setattr(toxicity, "fit", lambda rows, share: float(os.getpid()) + len(rows) / 1000)
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(8)], "doc_id long, text string")
    told = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int"))
    assert int(told) != os.getpid() and round(told % 1 * 1000) == 8


def test_warc_ties_and_sizes(spark):
    """Null ids, repeated rows, ties on the largest id, files of bounded size, clashing columns."""
    common.ship(spark)
    big = "x" * 1500
    rows = [(None, "u", big, 1), (1, "u", big, 1), (1, "u", big, 1), (7, "u", big, 1), (7, "v", big, 1)] + [(100 + i, "u", f"{i} " * 400, 1) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, revisit int").withColumn("may", F.lit(1)).coalesce(1)
    path = common.new_path(spark, "warc")
    warc.write_archives(pages, path, file_bytes=20_000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and sorted((x.page_id or 0, x.record_type, x.refers_to) for x in got if x.payload_bytes == 1500) == [(0, "revisit", 7), (1, "revisit", 7), (1, "revisit", 7), (7, "response", None), (7, "response", None)]
    sizes = [len(b"".join(warc.inflate(f.content))) for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()]
    assert len(sizes) >= 4 and max(sizes) < 60_000


def test_words_of_other_vocabularies_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, odd = Tokenizer.from_file(path), ["a  b\n c", "Don't STOP", "", "日本 x", "<|endoftext|> y"]
    split, kept = words.counts(path).look_up([t.encode() for t in odd])
    assert not words.by_words(path) and words.by_words(queries.vocabulary())
    assert [sum(map(kept.__getitem__, ws)) for ws in split] == [len(whole.encode(t, add_special_tokens=False).ids) for t in odd]


def test_packing_ids(spark, docs):
    """Each id of the library in one piece, its digest and place, and little padding."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    texts = [(x.doc_id, x.text) for x in common.table(spark, SMALL, "documents").collect()]
    rows = packing.pack(packing.pieces(common.table(spark, SMALL, "documents"), queries.vocabulary())).collect()
    by = defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for x in sorted(by[i], key=lambda x: x.start):
            assert (x.start, x.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + x.length].tobytes()) == x.ids_crc32
            at += x.length
        assert at == len(ids)
    n = len({x.sequence_id for x in rows})
    assert n * 2048 < 1.02 * sum(x.length for x in rows) + 2048


def test_word_hashes_of_patterned_words():
    """Words of one length that differ by a pattern in which sums of powers modulo 2^64 collide."""
    word = "a"
    while len(word) < 8192:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (1024, 4096, 8192):
        a, b = near_dedup.shingle_sets([word[:n].encode(), other[:n].encode()])
        assert a.tolist() != b.tolist()
    # A word's hash does not depend on where it stands or on blanks around it.
    one = near_dedup.shingle_sets([b"  a bc\td ef  ghi", b"a bc d ef ghi ", b"x a bc d ef ghi"])
    assert one[0].tolist() == one[1].tolist() and set(one[0].tolist()) < set(one[2].tolist())


def test_settled_tables_are_deleted(spark):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    df = spark.range(10)
    out = common.settled(spark, lambda: common.settled(spark, lambda: common.cut(df).union(common.cut(df)), "inner"), "outer")
    assert out.count() == 20 and {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"outer"}
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, lambda: (common.cut(df), 1 // 0))
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"outer"}


def test_a_new_table_takes_over_the_words_that_still_occur(monkeypatch):
    from ledgerloom.llm import queries, words

    monkeypatch.setattr(words, "KEPT", 3)
    library, parts = words.Words(queries.vocabulary(), b"".join, False), [b"one two three four", b"one five", b"one six's", b"two one x1", b"\xc4\x91 one three"]
    sought, encode = [], library.encode_pieces
    monkeypatch.setattr(library, "encode_pieces", lambda new: (sought.extend(new), encode(new)))
    for p in parts:
        split, kept = library.look_up([p])
        whole = library.whole.encode(p.decode(), add_special_tokens=False).ids
        assert b"".join(kept[w] for w in split[0]) == library.of(whole)
    assert sought.count("one") == 1


def test_the_old_table_of_words_is_asked_but_never_run_through():
    class Asked(dict):
        def __iter__(self):
            raise AssertionError("run through")

    library = words.Words(queries.vocabulary(), b"".join, False)
    split, kept = library.look_up([b"one two,"])
    kept.old = Asked({b"one": b"x"})
    assert [kept[w] for w in split[0]] == [b"x", library.of(library.whole.encode("two,", add_special_tokens=False).ids)]
