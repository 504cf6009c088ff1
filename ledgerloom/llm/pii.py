"""Operator 7, PII: information-theoretic sanitisation, by DataFrame functions alone.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers of a text. A term is a word that touches
none. Over all documents, I(e) = log2(N / n(e)) is what naming e tells, and PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) what t
tells of it; N, n(t), n(e) and n(t, e) all count distinct texts, n(t, e) those that have both, however far apart. A term is a
disclosure where n(t, e) >= 2, I(e) >= 3 bits and PMI(t, e) >= 0.9 I(e) for some e. Each of its occurrences, in texts with or
without an entity, becomes a span of kind ``term``. In the clean text, entities become their kind, disclosing numbers are
generalised to [NUMBER], other disclosing terms are removed. Texts with neither stay as they are.

Pairs are counted only where they can pass: as n(t) is at least the number m(t) of texts with a supported entity that have t,
a pair needs m(t) <= n(e) (N / n(e))^0.1. This loses no pair, and leaves the common words out before pairs are made.

Null texts are empty: no spans. Spans depend on the text alone, so repeated rows and copies get the same. Where spans
overlap, the clean text masks what they cover once. Columns other than the id and the text are only carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_in, settled

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive and bounded forms: linear time on any text. A number's chain is taken only where 14 to 19 digits end it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Stands for each character of an entity, so that places stay and a word that touches one is no term.
MASK = "\uffff"
TERM = rf"(?<![\p{{L}}\p{{N}}_{MASK}])[\p{{L}}\p{{N}}_]++(?!{MASK})"
LEAST_TEXTS, LEAST_BITS, LEAST_SHARE = 2, 3.0, 0.9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(steps: Column) -> Column:
    """The sums of an array's first 1, 2, ... numbers. Two levels, so that n numbers cost n^1.5 copies at most."""

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))

    def put(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(block["out"], lambda x: x + acc["at"]))).alias("out"))

    def blocks(all_: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(all_))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_) / n).cast("int") - 1), lambda i: F.slice(all_, i * n + 1, n))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.aggregate(F.transform(parts, lambda p: F.aggregate(p, zero, add)), whole, put, lambda acc: F.flatten(acc["out"]))

    return let(steps, lambda all_: F.when(F.size(all_) > 0, blocks(all_)).otherwise(F.array().cast("array<int>")))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of the matches, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match")), lambda w: w["match"].isNotNull()), lambda w: F.char_length(w["gap"]) + F.char_length(w["match"]))
    return F.transform(F.arrays_zip(running(steps).alias("end"), matches.alias("match")), lambda w: F.struct((w["end"] - F.char_length(w["match"])).alias("start"), w["end"].alias("end"), w["match"].alias("match")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(_digits(m)), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def in_range(m: Column) -> Column:
    """Each part of a dotted number is at most 255."""
    return m.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)){3}$")


def entities(text: Column) -> Column:
    """array<struct<start,place,end,kind,match>> of the base spans, by start and then kind as listed."""

    def of(k: int, pattern: str, there: Column, good: Callable[[Column], Column]) -> Column:
        spans = F.filter(found(text, pattern), lambda s: good(s["match"]))
        named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("place"), s["end"].alias("end"), F.lit(KINDS[k]).alias("kind"), s["match"].alias("match")))
        return F.when(there, named).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,place:int,end:int,kind:string,match:string>>"))

    n = lambda m: F.length(_digits(m))
    return F.array_sort(
        F.concat(
            of(0, EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
            of(1, IP, text.rlike(IP), in_range),
            of(2, CARD, text.rlike(CARD), luhn),
            of(3, PHONE, F.contains(text, F.lit("+")), lambda m: n(m).between(10, 15)),
        )
    )


def blanked(text: Column, spans: Column) -> Column:
    """text with MASK for each character of the spans (sorted by start), which may overlap; MASK in the text itself becomes a blank."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def whole(plain: Column) -> Column:
        def put(acc: Column, s: Column) -> Column:
            gap = F.substring(plain, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            covered = F.repeat(F.lit(MASK), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, covered).alias("out"))

        return F.aggregate(spans, zero, put, lambda acc: F.concat(acc["out"], F.substring(plain, acc["at"] + 1, F.char_length(plain))))

    plain = F.translate(text, MASK, " ")
    return F.when(F.size(spans) > 0, let(plain, whole)).otherwise(plain)


def text_key(text: Column) -> Column:
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))


def base(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text_key, found: the base spans of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, t.alias("_t")).select(*keep, text_key(F.col("_t")).alias("text_key"), entities(F.col("_t")).alias("found"))


class Texts:
    """The texts of docs without what their base spans cover, made anew from docs wherever they are read: no copy of them is written.

    Entities are sought again only in texts that may hold some, by a bounded filter over the keys of those that do.
    """

    def __init__(self, docs: DataFrame, rows: DataFrame, text: str):
        t = F.coalesce(F.col(text), F.lit(""))
        self.docs, self.named = docs.select(t.alias("_t")).select(text_key(F.col("_t")).alias("text_key"), "_t"), rows.where(F.size("found") > 0).select("text_key")

    def rest(self, asked: DataFrame | None = None) -> DataFrame:
        """text_key, rest; with asked, of texts that may be among its keys."""
        some = self.docs if asked is None else maybe_in(self.docs, "text_key", asked)
        plain = F.translate("_t", MASK, " ")
        return maybe_in(some, "text_key", self.named, name="_may").select("text_key", F.when(F.col("_may"), blanked(F.col("_t"), entities(F.col("_t")))).otherwise(plain).alias("rest"))


def terms(rest: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def places(texts: DataFrame) -> DataFrame:
    """text_key, start, end, match of each term in texts, one row for each text_key; places in code points."""
    both = F.arrays_zip(F.split("rest", TERM, -1).alias("gap"), F.regexp_extract_all("rest", F.lit(TERM), F.lit(0)).alias("match"))
    each = texts.select("text_key", F.posexplode(both).alias("i", "w")).select("text_key", "i", F.char_length("w.gap").alias("g"), F.col("w.match").alias("match")).where("match is not null")
    before = F.sum(F.col("g") + F.char_length("match")).over(Window.partitionBy("text_key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return each.withColumn("end", before.cast("int")).select("text_key", (F.col("end") - F.char_length("match")).alias("start"), "end", "match")


def terms_of_texts(rows: DataFrame, texts: Texts) -> DataFrame:
    """term: each distinct text's distinct terms. Only texts that may occur more than once are shuffled to count them once."""
    repeated = cut(rows.groupBy("text_key").agg(F.count("*").alias("k")).where("k > 1").select("text_key"), "repeated")
    told = maybe_in(texts.rest(), "text_key", repeated, name="_may").select("text_key", "_may", terms(F.col("rest")).alias("terms"))
    return told.where("not _may").select("terms").union(told.where("_may").dropDuplicates(["text_key"]).select("terms")).select(F.explode("terms").alias("term"))


def disclosing(rows: DataFrame, texts: Texts) -> DataFrame:
    """entity, term of each disclosure; rows as base() gives them."""
    total = float(max(rows.select("text_key").distinct().count(), 1))
    named = F.array_distinct(F.transform("found", lambda s: F.concat_ws(":", s["kind"], F.lower(s["match"]))))
    of = cut(rows.where(F.size("found") > 0).select("text_key", F.explode(named).alias("entity")).distinct(), "entities")
    n_e = of.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= LEAST_TEXTS) & (F.log2(F.lit(total) / F.col("n_e")) >= LEAST_BITS))
    of = cut(of.join(n_e, "entity"), "supported")
    keys = of.select("text_key").distinct()
    held = texts.rest(keys).select("text_key", terms(F.col("rest")).alias("terms"))
    words = cut(held.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"]), "words").select("text_key", F.explode("terms").alias("term"))
    # A little more than the bound, for rounding; the exact test comes below.
    most = of.agg(F.max(F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - LEAST_SHARE))).alias("most")).first()["most"] or 0.0
    m_t = cut(words.groupBy("term").agg(F.count("*").alias("m_t")).where((F.col("m_t") >= LEAST_TEXTS) & (F.col("m_t") <= most * 1.000001)), "rare")
    rare = maybe_in(words, "term", m_t).join(m_t, "term")
    may = F.col("m_t") <= F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - LEAST_SHARE)) * 1.000001
    enough = F.col("n_te") >= F.col("m_t") * F.pow(F.col("n_e") / F.lit(total), F.lit(1 - LEAST_SHARE)) * 0.999999
    both = cut(rare.join(of, "text_key").where(may).groupBy("entity", "term", "n_e", "m_t").agg(F.count("*").alias("n_te")).where((F.col("n_te") >= LEAST_TEXTS) & enough).drop("m_t"), "pairs")
    sought = cut(both.select("term").distinct(), "sought")
    # Words that are not sought go before they are counted, and counts are made within tasks first.
    n_t = maybe_in(terms_of_texts(rows, texts), "term", sought).groupBy("term").agg(F.count("*").alias("n_t"))
    tells = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e")))
    return both.join(n_t, "term").where(tells >= LEAST_SHARE * F.log2(F.lit(total) / F.col("n_e"))).select("entity", "term")


def marked(rows: DataFrame, texts: Texts) -> DataFrame:
    """text_key, terms (array<struct<start,end,match>>) of texts with a disclosing term."""
    told = cut(disclosing(rows, texts).select("term").distinct(), "told")
    each = texts.rest().select("text_key", F.explode(terms(F.col("rest"))).alias("term"))
    risky = cut(maybe_in(each, "term", told).join(told, "term", "left_semi").select("text_key").distinct(), "risky")
    held = texts.rest(risky).join(risky, "text_key", "left_semi").dropDuplicates(["text_key"])
    spans = places(held).withColumn("term", F.lower("match")).join(told, "term", "left_semi")
    return spans.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "match"))).alias("terms"))


def disclosures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, terms): keep, text_key, found of each row; text_key, terms (array<struct<start,end,match>>) of texts that have any."""
    rows = cut(base(docs, text, keep), "spans")
    return rows, settled(docs.sparkSession, lambda: marked(rows, Texts(docs, rows, text)), "terms")


def digest(rows: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """keep, counts by kind, base_sha256, spans."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    whole = F.array_sort(F.concat(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))), F.transform(F.coalesce("terms", F.from_json(F.lit("[]"), "array<struct<start:int,end:int,match:string>>")), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("place"), s["end"].alias("end"), F.lit("term").alias("kind")))))
    joined = rows.join(terms, "text_key", "left")
    return joined.select(*keep, *map(n, KINDS[:4]), F.sha2(F.array_join(F.transform("found", said), ","), 256).alias("base_sha256"), F.array_join(F.transform(whole, said), ",").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each span (start, end, label, sorted) replaced by its label."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(s["end"] > acc["at"], s["label"]).otherwise("")).alias("out"))

    return F.aggregate(spans, zero, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def _labels(docs: DataFrame, text: str, key: str) -> DataFrame:
    """_of, _spans: start, end and label of all spans of each text that has any."""
    rows, told = disclosures(docs, text, (key,))
    no_span = F.from_json(F.lit("[]"), "array<struct<start:int,place:int,end:int,kind:string,match:string>>")
    labels = F.transform(F.coalesce("found", no_span), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    no_term = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,match:string>>")
    of_terms = F.transform(F.coalesce("terms", no_term), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["match"].rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("")).alias("label")))
    spans = rows.where(F.size("found") > 0).select("text_key", "found").dropDuplicates(["text_key"]).join(told, "text_key", "full_outer")
    return spans.select(F.col("text_key").alias("_of"), F.array_sort(F.concat(labels, of_terms)).alias("_spans"))


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with text sanitised, all other columns kept whatever their names; rows without a span are unchanged."""
    spans = settled(docs.sparkSession, lambda: _labels(docs, text, key), "labels")
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text"), text_key(F.coalesce(F.col(text), F.lit(""))).alias("_of"))
    keyed = maybe_in(keyed, "_of", spans, name="_may")
    # Only texts that may hold a span are shuffled.
    held = keyed.where("_may").join(spans, "_of", "left")
    clean = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(masked(F.col("_text"), F.col("_spans")))
    changed = held.select(*[clean.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
    return keyed.where("not _may").select("_doc.*").unionByName(changed)
