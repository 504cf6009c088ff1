"""Numbers in texts: what they are worth and in which unit, which of them only name something, and gates that hold texts against their sources.

Python finds tokens within a text, in one pass of each; whatever compares texts is grouping and joins by (key, value).
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shapes import numeric_forms

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# What names a thing and measures nothing.
MASKS = (
    r"\[\[[^\]\n]+\]\]",
    r"`(?:raw|wiki)/[^`\n]+`",
    r"\b(?:raw|wiki)/[^\s)>\],]+",
    r"\b\d+/\d{4}/[A-ZĐ]+\d*(?:[-–][A-ZĐ]+\d*)*",
    r"\b[A-Z]{2,}(?:\.[A-Z0-9]+)+",
    r"(?i:Điều|Chương|Mục|Khoản|Điểm)\s*\d+(?:\s*[-–]\s*\d+)?",
    r"(?i:ISO/IEC|ISO|IEC|TCVN|QCVN)\s*\d+(?::\d{4})?",
    r"\[\[page \d+\]\]",
    r"\bv\d+(?:\.\d+)*",
    r"(?:Phiên|Phien)\s*(?:bản|ban)\s*:?\s*[\d.]+",
    r"(?:Lần|Lan)\s*(?:ban\s*hành|ban\s*hanh)\s*:?\s*[\d.]+",
    r"(?i:version)`?\s*:?\s*\d+(?:\.\d+)*",
    r"§[\d.]+",
    r"\b[A-Z]{1,3}\d+(?::[A-Z]{1,3}\d+)?",
    r"\b[A-Z]{1,10}-\d+\b",
    r"[Ss]print\s*\d+(?:\s*[-–]\s*\d+)?",
    r"\bbậc\s*\d",
    r"\b\d+\.\d+\.",
    r"\b\d{1,2}\.\d{1,2},(?=\s|$)",
    r"\b2\.\d+\.Sprint",
)
#: For each mask, texts of which one is in all that it can match, in every case that counts; without any, it is not tried. Clauses are found with their rows.
NEEDS = (
    ("[[",), ("`",), ("raw/", "wiki/"), ("/",), (".",), (), ("o", "O", "ec", "Ec", "eC", "EC", "cv", "Cv", "cV", "CV"), ("[[page ",), ("v",), ("Phi",),
    ("ban",), ("ve", "Ve", "vE", "VE"), ("§",), ("",), ("-",), ("print",), ("bậc",), (".",), (",",), (".Sprint",),
)
# Numbers of clauses and of list items that begin a line, and rows of clause numbers.
LINE_MARKS = (r"(?m)^[ \t>|*\-#]*\*{0,2}(\d+(?:[.,]\d+){1,3})\*{0,2}[.):]?(?=\s|$)", r"(?m)^[ \t>|*\-#]*\*{0,2}(\d{1,3})\*{0,2}[.)](?=\s|$)")
CLAUSES = r"(?i:Điều|Chương|Mục|Khoản|Điểm)\s*(\d+(?:\s*[-–]\s*\d+)?)((?:\s*(?:,|và|hoặc)\s*\d+(?:\s*[-–]\s*\d+)?)*)"
# Dates, number tokens, dotted names, where a section begins, and the most that is read of one.
DATE = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
TOKEN = DATE + r"|(?<![\w.])\d[\d.,]*(?![\w.])"
DOTTED = r"\d+(?:[.,]\d+){1,3}"
SECTION = r"(?m)^\s{0,3}#{1,6}\s|(?:Điều|Chương|Mục|Khoản|Điểm)\s*\d+|\[\[page\s*\d+\]\]"
SECTION_MOST = 4000
# The unit that words after a number stand for.
UNITS = {
    "hour": "hour", "hours": "hour", "h": "hour", "hrs": "hour", "giờ": "hour", "tiếng": "hour",
    "task": "task", "tasks": "task", "việc": "task", "công việc": "task",
    "phút": "minute", "minute": "minute", "minutes": "minute", "min": "minute",
    "ngày": "day", "day": "day", "days": "day",
    "tuần": "week", "week": "week", "weeks": "week",
    "tháng": "month", "month": "month", "months": "month",
    "năm": "year", "year": "year", "years": "year",
    "lần": "time", "lượt": "time",
    "đồng": "vnd", "vnd": "vnd", "vnđ": "vnd",
    "ký tự": "char", "ký-tự": "char", "char": "char", "character": "char", "characters": "char",
}
# The units that declarations use.
DECLARED_UNITS = {"hour": "hour", "task": "task", "ratio": "ratio", "ký tự": "char", "phút": "minute", "tháng": "month", "năm": "year", "ngày": "day", "tuần": "week", "lần": "time", "đồng": "vnd"}
UNIT_WORDS = r"[^\S\n]*(?:\([^\n)]{1,32}\)[^\S\n]*)?([^\W\d_]+)(?:[^\S\n]+([^\W\d_]+))?"

#: Places that are sought in one reading of a document; further ones are sought in another.
PLACES = 1000

FOUND = "side int, kind string, at long, token string, value string, unit string"


_UNIT_WORDS, _TOKEN, _DATE, _DOTTED, _CLAUSES, _SECTION, _DIGITS = map(re.compile, (UNIT_WORDS, TOKEN, DATE, DOTTED, CLAUSES, SECTION, r"\d+"))
_MASKS, _LINE_MARKS = [(re.compile(p), need) for p, need in zip(MASKS, NEEDS, strict=True) if need], [re.compile(p) for p in LINE_MARKS]


def unit_at(text: str, at: int) -> str | None:
    """[X08] The unit that stands at a place, on the same line: of two words if they are one, else of the first."""
    m = _UNIT_WORDS.match(text, at)
    if not m:
        return None
    first = m[1].lower()
    return UNITS.get(f"{first} {m[2].lower()}" if m[2] else first, UNITS.get(first))


def worth(token: str) -> str:
    """One spelling of a number or a date; a number as a plain decimal with all its digits."""
    if token.isdigit() and token.isascii():
        return token.lstrip("0") or "0"
    if _DATE.fullmatch(token):
        return f"date:{token}"
    bare = token.strip().rstrip(".,")
    marks = [c for c in bare if c in ".,"]
    groups = len(marks) > 1 or (marks and len(bare) - bare.index(marks[0]) == 4)
    try:
        plain = format(Decimal(bare.replace(",", "").replace(".", "") if groups else bare.replace(",", ".")), "f")
    except InvalidOperation:
        return token
    return plain.rstrip("0").rstrip(".") if "." in plain else plain


def stretches(text: str) -> list[list[int]]:
    """Lines with digits, joined where they meet, each with the five lines of text before it, from where a name of up to five parts can reach into it."""
    out: list[list[int]] = []
    m = _DIGITS.search(text)
    while m:
        a, b, back = m.start(), text.find("\n", m.end()), 0
        b = len(text) if b < 0 else b
        floor = out[-1][1] if out else 0
        while a > floor and back < 6:
            begin = text.rfind("\n", 0, a) + 1
            back += not text[begin:a].isspace() and begin < a
            a = begin if back > 5 or begin == 0 else begin - 1
        a = text.rfind("\n", 0, a) + 1
        if out and a <= out[-1][1] + 1:
            out[-1][1] = b
        else:
            out.append([a, b])
        m = _DIGITS.search(text, b)
    return out


def masked(text: str, a: int = 0, b: int | None = None) -> list[tuple[int, int]]:
    """[X09] Spans that name things: by pattern, numbers of lines that no unit follows, and rows of clause numbers up to the first with a unit."""
    b = len(text) if b is None else b
    spans = []
    for p, need in _MASKS:
        for n in need:
            if text.find(n, a, b) >= 0:
                spans += [m.span() for m in p.finditer(text, a, b)]
                break
    spans += [m.span(1) for p in _LINE_MARKS for m in p.finditer(text, a, b) if unit_at(text, m.end()) is None]
    for m in _CLAUSES.finditer(text, a, b):
        spans += [(m.start(), m.end(1)), m.span(1)]
        for n in _DIGITS.finditer(text, *m.span(2)):
            if unit_at(text, n.end()) is not None:
                break
            spans.append(n.span())
    return spans


def tokens(text: str) -> Iterator[tuple]:
    """[X10] (kind, at, token, value, unit): numbers outside the masked spans, and as ``identifier`` the dotted ones inside.

    Only stretches with digits are searched, as a span without any hides no number.
    """
    for begin, end in stretches(text):
        spans = masked(text, begin, end)
        joined: list[list[int]] = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        starts = [a for a, _ in joined]
        for m in _TOKEN.finditer(text, begin, end):
            # Of spans that lie apart, the last one to begin before the token's end is the only one that can reach into it.
            i = bisect_right(starts, m.end() - 1) - 1
            if i < 0 or joined[i][1] <= m.start():
                yield "number", m.start(), m[0], worth(m[0]), unit_at(text, m.end())
        for a, b in set(spans):
            if text.find(".", a, b) < 0 and text.find(",", a, b) < 0:
                continue
            for m in _DOTTED.finditer(text, a, b):
                yield "identifier", m.start(), m[0], worth(m[0]), None


def number_tokens(texts: DataFrame, key: str, *columns: Column) -> DataFrame:
    """[X10 X09 X08] key, side, kind, at, token, value, unit of every number in the columns' texts; side: the column's place.

    Positions are code points. Null texts hold none. Each text is read once, whole, and nothing is shuffled.
    """
    rows = texts.select(F.col(key).alias("key"), F.array(*[c.cast("string") for c in columns]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for k, sides in zip(b.column("key"), b.column("texts").to_pylist()):
                new = [(side, *t) for side, text in enumerate(sides) if text for t in tokens(text)]
                keys += [k.as_py()] * len(new)
                out += new
            cells = [list(c) for c in zip(*out)] or [[]] * 6
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(keys, b.schema.field("key").type)] + [pa.array(c, t) for c, t in zip(cells, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "side", "kind", "at", "token", "value", "unit"])

    return rows.mapInArrow(run, f"key {texts.schema[key].dataType.simpleString()}, {FOUND}").withColumnRenamed("key", key)


def transform_faults(pairs: DataFrame, key: str, before: Column, after: Column, summary: bool = False) -> DataFrame:
    """[G04] key, value, level (error, warning), fault, lost, gained: where the numbers of a rewritten text part from the first one's.

    First by value: ``invented`` ones (more of them than before; of a summary, which may repeat and leave out, those not there before), and
    ``dropped`` ones, an error if ones with a unit went and else a warning. Then by unit, of values on both sides: ``unit_changed`` is an error,
    ``unit_gained`` and ``unit_lost`` (not of summaries) warnings. What the first text uses as an identifier is one in the second too.
    A key must be one row; lost and gained are sorted units.
    """
    found = number_tokens(pairs, key, before, after)
    of = lambda side, kind: F.count_if((F.col("side") == side) & (F.col("kind") == kind))
    units = found.groupBy(key, "value", "unit").agg(of(0, "number").alias("b"), of(1, "number").alias("a"), of(0, "identifier").alias("i"))
    # A value has few units, so its list is short; an identifier's numbers in the second text do not count.
    values = units.groupBy(key, "value").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.max(F.col("i") > 0).alias("known"), F.collect_list(F.struct("unit", "b", "a")).alias("units"))
    values = values.withColumn("a", F.when(F.col("known"), 0).otherwise(F.col("a"))).withColumn("units", F.when(F.col("known"), F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), u["b"].alias("b"), F.lit(0).cast("long").alias("a")))).otherwise(F.col("units")))
    named = lambda rule: F.array_sort(F.transform(F.filter("units", lambda u: u["unit"].isNotNull() & rule(u)), lambda u: u["unit"]))
    values = values.withColumn("lost", named(lambda u: u["b"] > u["a"])).withColumn("gained", named(lambda u: u["a"] > u["b"]))
    a, b, lost, gained = F.col("a"), F.col("b"), F.size("lost") > 0, F.size("gained") > 0
    told = lambda when, level, fault: F.when(when, F.struct(level.alias("level"), F.lit(fault).alias("fault")))
    error, warning = F.lit("error"), F.lit("warning")
    faults = [told((a > 0) & (b == 0) if summary else a > b, error, "invented")]
    if not summary:
        faults.append(told(b > a, F.when(lost, error).otherwise(warning), "dropped"))
    both = (a > 0) & (b > 0)
    faults += [told(both & gained & lost, error, "unit_changed"), told(both & gained & ~lost, warning, "unit_gained")]
    if not summary:
        faults.append(told(both & lost & ~gained, warning, "unit_lost"))
    return values.withColumn("f", F.explode(F.array_compact(F.array(*faults)))).select(key, "value", "f.level", "f.fault", "lost", "gained")


def windows(text: str, place: str) -> list[str]:
    """[X18] From each occurrence of a place, whatever its case and blanks, to where the next section begins."""
    words = place.split()
    if not words:
        return []
    out = []
    for m in re.finditer(r"\s+".join(map(re.escape, words)), text, re.I):
        end = _SECTION.search(text, m.end())
        out.append(text[m.start() : min(end.start() if end else len(text), m.start() + SECTION_MOST)])
    return out


def placed_numbers(documents: DataFrame, places: DataFrame, doc: str, text: Column) -> DataFrame:
    """[X18 X10] doc, place, found, value, unit: the distinct numbers at each place of a document (places: doc, place; null: all of it).

    A place without numbers gives one row with a null value; ``found`` tells whether the document has the place at all. Places of a document
    are sought together, PLACES at a time, so that its text is not sent along with each of them.
    """
    asked = places.select(doc, "place").distinct()
    lots = asked.groupBy(doc).agg(F.ceil(F.count("*") / PLACES).alias("lots"))
    asked = asked.join(lots, doc).groupBy(doc, F.pmod(F.xxhash64("place"), F.col("lots")).alias("lot")).agg(F.collect_list(F.struct("place")).alias("places"))
    rows = documents.select(F.col(doc), text.alias("text")).join(asked, doc).select(F.col(doc).alias("key"), "text", F.col("places.place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for k, body, wanted in zip(b.column("key"), b.column("text").to_pylist(), b.column("places").to_pylist()):
                for place in wanted:
                    parts = [body or ""] if place is None else windows(body or "", place)
                    got = {(t[3], t[4]) for part in parts for t in tokens(part) if t[0] == "number"} or {(None, None)}
                    new = [(place, bool(parts), *g) for g in got]
                    keys += [k.as_py()] * len(new)
                    out += new
            cells = [list(c) for c in zip(*out)] or [[]] * 4
            arrays = [pa.array(keys, b.schema.field("key").type)] + [pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "place", "found", "value", "unit"])

    kind = documents.schema[doc].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, place string, found boolean, value string, unit string").withColumnRenamed("key", doc)


def declaration_faults(declared: DataFrame, documents: DataFrame, id_: str, doc: str, text: Column) -> DataFrame:
    """[G02] id, faults of each declared fact: an array that is empty where the fact stands at the place that it cites, in its unit.

    declared: id, number double or day string, unit, doc (null: none cited), place (null: anywhere in the document). documents: doc, current,
    ocr, and the text's columns; one row a document. ``no_unit`` may stand beside one of: no_source, not_a_number, unknown_source, old_source,
    ocr_source (facts must not come from guessed text), no_section, not_there, other_unit. A number without a unit that is known fits any.
    """
    unit = F.lower(F.trim("unit"))
    canon = F.coalesce(F.create_map(*[F.lit(x) for kv in DECLARED_UNITS.items() for x in kv])[unit], unit)
    day = F.when(F.trim("day").rlike(f"^(?:{DATE})$"), F.array(F.concat(F.lit("date:"), F.trim("day"))))
    d = declared.select(id_, doc, F.trim("place").alias("place"), F.when(unit != "", canon).alias("wanted"), F.coalesce(day, numeric_forms(F.col("number"), canon), F.array().cast("array<string>")).alias("forms"))
    d = d.withColumn("place", F.when(F.col("place") != "", F.col("place")))
    state = documents.select(F.col(doc).alias("_doc"), F.coalesce("current", F.lit(False)).alias("current"), F.coalesce("ocr", F.lit(False)).alias("ocr"))
    # Facts that cite no document meet none; in the join, their null keys would all go to one task.
    cited = d.where(F.col(doc).isNotNull()).join(state, F.col(doc) == F.col("_doc"), "left")
    d = cited.unionByName(d.where(F.col(doc).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema]))
    fit = d.where("size(forms) > 0 and current and not ocr")
    seen = placed_numbers(documents, fit, doc, text).select(F.col(doc).alias("_d"), F.col("place").alias("_p"), "found", F.col("value").alias("_v"), F.col("unit").alias("_u"))
    # Every number of a place meets its declarations; a place's numbers are distinct, and the join is by document and place.
    met = fit.join(seen, (F.col(doc) == F.col("_d")) & F.col("place").eqNullSafe(F.col("_p")))
    here = F.coalesce(F.array_contains("forms", F.col("_v")), F.lit(False))
    told = met.groupBy(id_).agg(F.max("found").alias("found"), F.max(here).alias("here"), F.max(here & (F.col("_u").isNull() | F.col("wanted").isNull() | (F.col("_u") == F.col("wanted")))).alias("fits"))
    one = F.when(F.col(doc).isNull(), "no_source").when(F.size("forms") == 0, "not_a_number").when(F.col("_doc").isNull(), "unknown_source")
    one = one.when(~F.col("current"), "old_source").when(F.col("ocr"), "ocr_source").when(~F.col("found"), "no_section").when(~F.col("here"), "not_there").when(~F.col("fits"), "other_unit")
    no_unit = F.when(F.col("wanted").isNull(), "no_unit")
    return d.join(told, id_, "left").select(id_, F.array_compact(F.array(no_unit, one)).alias("faults"))
