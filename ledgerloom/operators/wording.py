"""Clauses of documents and what pages cover of them, noise in transcripts, faults of answers, lists that a model gave back, and cells as text.

"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .lookup import lasting

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# Line ends, articles and clauses at a line's start, clauses within a line, the table of contents, page marks, marked gaps, the sources' heading.
S, LINE_END = r"[\s\x1c-\x1f\x85\p{Z}]", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NUMBER = r"[0-9]{1,3}(?:\.[0-9]{1,3})+"
ARTICLE = r"(?i)\s*#{0,6}\s*Điều\s+([0-9]{1,3})(?![0-9])"
CLAUSE = rf"\s*#{{0,6}}\s*(?:[-*]\s*)?(?:>\s*)?(?:\*\*)?({NUMBER})(?:\*\*)?(?=\s|[.),:;—–-]|$)"
INLINE = rf"(?i)(?<!\w)(?:mục|khoản)\s+({NUMBER})"
MARKED = rf"(?i)(?:\[\s*(?:chưa\s+bao\s+phủ|not\s+covered|không\s+có\s+trong\s+trích\s+đoạn)\s*:\s*|<!--\s*NOT_COVERED\s*:\s*)({NUMBER})"
CONTENTS, PAGE_MARK = r"(?i)\s*#{0,6}\s*MỤC\s*LỤC\s*$", r"(?i)\s*\[\[page\s+[0-9]+\]\]\s*$"
SOURCES = rf"(?iumd)^{S}*#{{1,6}}{S}*Nguồn{S}*$[\s\S]*"
# Phrases that are heard in silence, folded.
CANNED = r"thanks for watching|subscribe to (?:the|my|our) channel|cam on cac ban da theo doi|hay subscribe cho kenh|see you next time"
# What answers say where nothing is found, that something is not so, and where they guess; traces; the faults' names.
NOT_FOUND = "không tìm thấy|không thấy|kho không biết|kho chưa có|không thể|chưa thể|không phải câu hỏi|yêu cầu ghi/cập nhật"
NEGATIVE, UNSURE, TOO_SURE = "không|chưa|0 task|0 công việc", "có thể|hình như|có lẽ|tôi đoán|probably", "chắc chắn không|không ai"
TRACE = r"(?U)\b(?:traceback|todo|undefined|nan)\b"

_LINE_END, _ARTICLE, _CLAUSE, _INLINE, _MARKED, _CONTENTS, _PAGE_MARK = map(re.compile, (LINE_END, ARTICLE, CLAUSE, INLINE, MARKED, CONTENTS, PAGE_MARK))


# --- clauses ----------------------------------------------------------------------


def _by_number(found: Iterable[str]) -> list[str]:
    """Each once, ``03.1`` as ``3.1``, part by part in order."""
    return [".".join(map(str, n)) for n in sorted({tuple(map(int, x.split("."))) for x in found})]


def clauses(text: str | None) -> list[str]:
    """[X17] Articles and clauses that a text holds, as with_clauses tells."""
    lines = _LINE_END.split(text or "")
    toc = next((i for i, x in enumerate(lines) if _CONTENTS.match(x)), None)
    if toc is not None:
        end = next((i for i in range(toc + 1, len(lines)) if _PAGE_MARK.match(lines[i])), len(lines))
        lines = lines[:toc] + lines[end:]
    begin = [(_ARTICLE.match(x), _CLAUSE.match(x)) for x in lines]
    heads = [i for i, (a, _) in enumerate(begin) if a]
    own = (i for i in heads if any(c and int(c[1].split(".")[0]) == int(begin[i][0][1]) for _, c in begin[i + 1 : i + 10]))
    first = next(own, heads[0] if heads else 0)
    return _by_number([(a or c)[1] for a, c in begin[first:] if a or c] + _INLINE.findall("\n".join(lines[first:])))


def _lists(of: Callable[[str | None], list[str]], c: Column) -> Column:
    return F.arrow_udf(lambda texts: pa.array([of(t) for t in texts.to_pylist()], pa.list_(pa.string())), "array<string>")(c)


def with_clauses(rows: DataFrame, of: str, to: str) -> DataFrame:
    """[X17] rows with ``to``, the array of articles and clauses that a text holds, each once, by number.

    Lines count that begin with one, and clauses that a line refers to by word; not the table of contents (up to the next page mark, or the end), nor
    what stands before the first article, which is one with a clause of its own in the nine lines after it, if any has. A null text has none.
    """
    return rows.withColumn(to, _lists(clauses, F.col(of)))


def marked_clauses(page: Column) -> Column:
    """[X17] Clauses that a page says it does not cover, each once, by number."""
    return _lists(lambda t: _by_number(_MARKED.findall(t or "")), page)


def clause_coverage(pairs: DataFrame, key: str) -> DataFrame:
    """[U03 X17] key, status, complete, covered, marked, missing, unexpected, marked_unexpected of pairs (key, source, page: its body without front matter).

    A page passes if it holds or marks all that its source holds and holds and marks nothing else; it is complete if it passes over nothing. What stands
    from the heading of its sources on is no part of it.
    """
    body = F.regexp_replace(F.coalesce("page", F.lit("")), SOURCES, "")
    d = with_clauses(with_clauses(pairs.select(key, "source", body.alias("_body")), "source", "_want"), "_body", "_has").withColumn("_mark", marked_clauses(F.col("_body")))
    both, less = F.array_intersect, F.array_except  # in the order of their first array
    d = d.select(key, "_mark", "_want", both("_has", "_want").alias("covered"), both("_mark", "_want").alias("marked"), less(F.array_except("_want", "_has"), F.col("_mark")).alias("missing"), less("_has", "_want").alias("unexpected"), less("_mark", "_want").alias("marked_unexpected"))
    good = (F.size("missing") == 0) & (F.size("unexpected") == 0) & (F.size("marked_unexpected") == 0)
    return d.select(key, F.when(good, "pass").otherwise("fail").alias("status"), ((F.size("missing") == 0) & (F.size("_mark") == 0)).alias("complete"), "covered", "marked", "missing", "unexpected", "marked_unexpected")


# --- transcripts ------------------------------------------------------------------


def noise(segments: DataFrame, meeting: str, at: str, expected: DataFrame | None = None, short: int = 8, times: int = 3) -> DataFrame:
    """segments with ``noise``: why a segment is left out (canned, language, repeated), null for those to keep.

    segments: meeting, at (unique in it), lang, text. expected: meeting, lang, the languages that were told for meetings; a meeting without any has its most
    frequent one (of equal ones the first by name). Language and repetition count only for segments of fewer than ``short`` words that share no word of
    four or more letters with the segment before or after them: a second, third language that joins the talk stays. Repeated: the same letters
    and digits ``times`` times or more in the meeting. In doubt a segment stays; so do null and empty ones. A meeting's order is one task's window, to which
    only each segment's distinct words go.
    """
    plain = text.fold(F.coalesce("text", F.lit("")))
    d = segments.select(F.col(meeting).alias("_m"), F.col(at).alias("_at"), "lang", plain.alias("_plain"))
    d = d.withColumn("_n", F.size(F.regexp_extract_all("_plain", F.lit(r"[^\s\p{Z}]+"), F.lit(0))))
    sign = F.when(F.col("_n") < short, F.regexp_replace("_plain", r"[^\p{L}\p{N}]", ""))
    d = d.select("_m", "_at", "lang", "_n", F.col("_plain").rlike(CANNED).alias("_canned"), sign.alias("_sign"), F.array_distinct(F.regexp_extract_all("_plain", F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("_words"))
    w = Window.partitionBy("_m").orderBy("_at")
    # A neighbour that says the same is no talk that the phrase belongs to.
    apart = [F.coalesce(side("_sign").over(w) == F.col("_sign"), F.lit(False)) | F.coalesce(~F.arrays_overlap("_words", side("_words").over(w)), F.lit(True)) for side in (F.lag, F.lead)]
    d = lasting(d.select("_m", "_at", "lang", "_canned", "_sign", (F.col("_n").between(1, short - 1) & apart[0] & apart[1]).alias("_odd")))
    counts = d.where("lang is not null").groupBy("_m", "lang").agg(F.count("*").alias("n"))
    usual = counts.groupBy("_m").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang")).select("_m", F.array("lang").alias("_langs"))
    if expected is not None:
        told = expected.groupBy(F.col(meeting).alias("_m")).agg(F.collect_set("lang").alias("_langs"))
        usual = told.unionByName(usual.join(told, "_m", "left_anti"))
    again = d.where("_odd").groupBy("_m", "_sign").agg(F.count("*").alias("_again"))
    why = F.when(F.col("_canned"), "canned").when(F.col("_odd") & ~F.array_contains("_langs", F.col("lang")), "language").when(F.col("_odd") & (F.col("_again") >= times), "repeated")
    noisy = d.where("_canned or _odd").join(usual, "_m", "left").join(again, ["_m", "_sign"], "left").select("_m", "_at", why.alias("noise")).where("noise is not null")
    return segments.join(noisy, F.col(meeting).eqNullSafe(F.col("_m")) & F.col(at).eqNullSafe(F.col("_at")), "left").select(*[segments[c] for c in segments.columns], "noise")


# --- answers and lists ------------------------------------------------------------


def style_faults(status: Column, answer: Column, citations: Column) -> Column:
    """[X25] array<string> of an answer's faults: empty, control, escape, trace, long (over 8 lines), uncited, unsure, too_sure, no_notice, no_denial; citations: their number."""
    said = F.regexp_replace(F.coalesce(answer, F.lit("")), rf"^{S}+|{S}+$", "")
    low = F.lower(said)
    lines = F.size(F.split(F.regexp_replace(said, rf"(?:{LINE_END})\z", ""), LINE_END, -1))
    faults = F.array_compact(F.array(
        F.when(said.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control"),
        F.when(F.contains(said, F.lit("\x1b[")), "escape"),
        F.when(low.rlike(TRACE), "trace"),
        F.when(lines > 8, "long"),
        F.when((status == "in_kb") & (F.coalesce(citations, F.lit(0)) == 0), "uncited"),
        F.when((status == "in_kb") & low.rlike(UNSURE), "unsure"),
        F.when((status == "not_in_kb") & low.rlike(TOO_SURE), "too_sure"),
        F.when((status == "not_in_kb") & ~low.rlike(NOT_FOUND), "no_notice"),
        F.when((status == "confident_no") & ~low.rlike(NEGATIVE), "no_denial"),
    ))
    return F.when(said == "", F.array(F.lit("empty"))).otherwise(faults)


def listed_strings(raw: Column, n: Column) -> Column:
    """[X29] The n strings of the JSON list that a model's reply holds, fenced or among other words; null unless it is a list of just n.

    Numbers are by their values, booleans True and False, null None; lists and objects within are JSON text.
    """
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.regexp_like(raw, F.lit(r"(?s)```(?:json)?\s*.*?```")), fenced).otherwise(raw)
    # From the first to the last bracket, within one more list: what follows a list's end would else be passed over.
    span = F.concat(F.lit("["), F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.lit("]"))
    whole = F.from_json(span, "array<array<string>>", {"allowSingleQuotes": "false"})
    parts = F.try_variant_get(F.try_parse_json(span), "$", "array<variant>")
    got, kinds = F.get(whole, F.lit(0)), F.try_variant_get(F.get(parts, F.lit(0)), "$", "array<variant>")
    said = F.transform(got, lambda x, i: F.when(x.isNull(), "None").when(F.schema_of_variant(F.get(kinds, i)) == "BOOLEAN", F.initcap(x)).otherwise(x))
    return F.when((F.size(parts) == 1) & (F.size(whole) == 1) & (F.size(kinds) == n) & (F.size(got) == n), said)


def short_number(x: Column) -> Column:
    """A double by at most six significant digits."""
    e = F.format_string("%.5e", x)
    power = F.regexp_extract(e, r"e([+-][0-9]+)$", 1).cast("int")
    bare = F.regexp_replace(F.regexp_extract(e, "^([^e]+)e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(e.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when(x == 0, F.when(F.startswith(x.cast("string"), F.lit("-")), "-0").otherwise("0")).when((power < -4) | (power >= 6), F.concat(bare, F.regexp_extract(e, r"(e[+-][0-9]+)$", 1))).otherwise(plain)


def cell_text(number: Column, shown_as: Column, day: Column, flag: Column, said: Column) -> Column:
    """[X13] A cell's value, of one of four kinds, as text: days as YYYY-MM-DD, True or False, percents by their format, whole numbers without a point, others
    to 6 decimals, and words trimmed on one line; null if empty. Halves are rounded as their decimals read."""
    r = F.bround(number, 6)
    tiny = F.round(F.abs(r) * 1000000).cast("long")
    small = F.concat(F.when(r < 0, "-").otherwise(""), F.when(tiny < 10, F.concat(tiny.cast("string"), F.lit("e-06"))).otherwise(F.concat(F.regexp_replace((tiny / 10).cast("string"), r"\.0$", ""), F.lit("e-05"))))
    part = F.when(r == 0, F.when(number < 0, "-0.0").otherwise("0.0")).when(F.abs(r) < 0.0001, small).otherwise(F.regexp_replace(F.regexp_replace(r.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", ".0"))
    digits = F.when(F.contains(F.coalesce(shown_as, F.lit("")), F.lit("%")), F.concat(short_number(number * 100), F.lit("%"))).when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(part)
    words = F.replace(F.regexp_replace(said, rf"^{S}+|{S}+$", ""), F.lit("\n"), F.lit(" "))
    return F.when(day.isNotNull(), F.date_format(day, "yyyy-MM-dd")).when(flag.isNotNull(), F.initcap(flag.cast("string"))).when(number.isNotNull(), digits).when(said != "", words)
