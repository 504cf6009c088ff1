"""Answers, citations, segments and page versions, as functions over DataFrames and columns.

"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words

# What a done task's status says, what stands for a missing teaser, what is unknown of a source, and what telemetry never holds.
DONE_WORDS = ("done", "completed", "finished", "xong", "hoàn thành", "hoan thanh", "hoàn tất", "hoan tat")
NO_TEASER = "Nội dung chi tiết được lập chỉ mục tại trang chương tương ứng."
NOT_NOTED, NOT_KNOWN = "chưa ghi nhận", "chưa xác định"
FORBIDDEN = ("query", "question", "answer", "actor", "content")
# Meeting addresses.
MEET = r"(?i)meet\.google\.com/([a-z]{3}-[a-z]{4}-[a-z]{3})"
ZOOM = r"(?i)zoom\.us/(?:j|wc/join)/([0-9]+)"

BLANK = r"(?U)[\s\x1c-\x1f]+"


def one_line(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANK, " "))


def first_filled(*parts: Column) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*[F.when(p != "", p) for p in parts])


# --- values -------------------------------------------------------------------


def cell(row: Column, letter: str) -> Column:
    """[P02] The cell of an array under a column letter A to Z; an empty one, or one beyond the row, is null."""
    if not re.fullmatch("[A-Za-z]", letter):
        raise ValueError(f"not a column letter: {letter}")
    return F.nullif(F.get(row, F.lit(ord(letter.upper()) - ord("A"))), F.lit(""))


def is_done(status: Column) -> Column:
    """[X19] The status is a word for done, whatever its case, marks and leading ``đã``; null is not."""
    t = F.trim(F.regexp_replace(F.lower(one_line(F.coalesce(status, F.lit("")))), r"[^0-9a-zà-ỹ\s]", ""))
    return F.trim(F.regexp_replace(t, r"^đã\s+", "")).isin(*DONE_WORDS)


def role(said: Column, aliases: Mapping[str, str], profiles: Sequence[str]) -> Column:
    """[X23] The role that an alias stands for, or a profile's own name, else ``general``."""
    slug = F.replace(ascii_words(F.coalesce(said, F.lit(""))), F.lit(" "), F.lit("-"))
    known = F.when(slug.isin(*profiles), slug).otherwise("general")
    for alias, name in aliases.items():
        known = F.when(slug == alias, name).otherwise(known)
    return known


def meeting(url: Column) -> Column:
    """[X28] struct<platform,id> of a meeting's address, null where it is none."""
    at = lambda platform, p: F.when(url.rlike(p), F.struct(F.lit(platform).alias("platform"), F.regexp_extract(url, p, 1).alias("id")))
    return F.coalesce(at("google_meet", MEET), at("zoom", ZOOM))


def plain_decimal(value: Column, shift: int = 0) -> Column:
    """The shortest decimal text that stands for value * 10^shift, without exponent or closing zeros; never rounded. Null unless finite."""
    parts = F.split(F.upper(value.cast("string")), "E")
    head = F.split(F.regexp_replace(parts[0], "^-", ""), r"\.")
    digits = F.concat(head[0], F.coalesce(F.get(head, F.lit(1)), F.lit("")))
    point = F.char_length(head[0]) + F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0)) + shift
    whole = F.when(point <= 0, F.lit("0")).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.repeat(F.lit("0"), F.greatest(point - F.char_length(digits), F.lit(0)))))
    rest = F.concat(F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.char_length(digits)))
    text = F.regexp_replace(F.regexp_replace(F.concat(whole, F.lit("."), rest), r"\.?0*$", ""), r"^0+(?=\d)", "")
    return F.when(parts[0].rlike(r"^-?\d"), F.concat(F.regexp_extract(parts[0], "^-?", 0), text))


def numeric_forms(value: Column, unit: Column) -> Column:
    """[X07] array<string>: the number as a plain decimal and, of a ratio, as a percentage too; all its digits, however many."""
    return F.array_distinct(F.array_compact(F.array(plain_decimal(value), F.when(unit == "ratio", plain_decimal(value, 2)))))


def closed_value(values: Sequence[str], text: Column) -> Column:
    """The longest of a closed set's values that stands in text as a word of its own, else null."""
    tries = [F.when(text.rlike(rf"(?U)(?<!\w)\Q{v}\E(?!\w)"), v) for v in sorted(values, key=len, reverse=True)]
    return F.coalesce(*tries, F.lit(None).cast("string"))


def answer_shape(outcome: Column, tier: Column) -> Column:
    """[P11] struct<status,confidence>; outcome: found, no or missing, any other is an error."""
    status = F.when(outcome == "found", "in_kb").when(outcome == "no", "confident_no").when(outcome == "missing", "not_in_kb").otherwise("error")
    sure = F.when((outcome == "no") | ((outcome == "found") & (tier == 1)), "high").when(outcome == "found", "medium").otherwise("none")
    return F.struct(status.alias("status"), sure.alias("confidence"))


def shown_date(c: Column) -> Column:
    """[P09] dd/mm/yyyy of an ISO date or time; other text stays, blank text is not noted."""
    t = F.trim(F.coalesce(c, F.lit("")))
    day = F.substring_index(t, "T", 1)
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    return F.when(t == "", NOT_NOTED).when(day.rlike(iso), F.regexp_replace(day, iso, "$3/$2/$1")).otherwise(t)


def citation(cite: Column, origin: Column, name: Column, updated_at: Column, updated_by: Column, scope: Column, known: Column) -> Column:
    """[P09] A source as readers see it: origin else name of a known document, else the last part of the cited path."""
    source = F.when(known, first_filled(F.trim(origin), name)).otherwise(first_filled(F.substring_index(cite, "/", -1), F.lit(NOT_KNOWN)))
    day = F.when(known, shown_date(updated_at)).otherwise(NOT_NOTED)
    by = F.when(known, first_filled(updated_by, F.lit(NOT_NOTED))).otherwise(NOT_NOTED)
    said = F.concat(F.lit("Nguồn: `"), F.coalesce(source, F.lit("")), F.lit("` · cập nhật ngày "), day, F.lit(" · bởi "), by)
    return F.when(scope != "", F.concat(said, F.lit(" · phạm vi "), scope)).otherwise(said)


# --- texts --------------------------------------------------------------------


def source_points(bullets: Column, paragraphs: Column, most: int = 5) -> Column:
    """[P14] array: the first distinct bullets of 18 characters or more, then paragraphs of 35 or more, ``most`` in all."""
    least = lambda parts, n: F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.char_length(x) >= n)
    return F.slice(F.array_distinct(F.concat(least(bullets, 18), least(paragraphs, 35))), 1, most)


def teaser(text: Column, most: int = 280) -> Column:
    """[X27] The first paragraph of 40 characters or more, without page marks and chapter titles, cut at ``most``."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\[page\s+[0-9]+\]\]", " ")
    bare = F.regexp_replace(bare, r"(?imudU)^\s*#{0,6}\s*CHƯƠNG\s+[0-9]+\.[^\n]*$", "")
    lines = F.transform(F.split(bare, r"\n\s*\n"), one_line)
    good = F.filter(lines, lambda x: (F.char_length(x) >= 40) & ~x.startswith("---") & ~x.startswith("doc_id:"))
    first = F.replace(F.get(good, F.lit(0)), F.lit("|"), F.lit("\\|"))
    short = F.concat(F.regexp_replace(F.left(first, F.lit(most)), r"\s+$", ""), F.lit("…"))
    return F.when(first.isNull(), NO_TEASER).when(F.char_length(first) > most, short).otherwise(first)


def chunk_prints(files: DataFrame, key: str, content: str, size: int = 4096) -> DataFrame:
    """[H03] key, print: the distinct 8-byte digests of a file's chunks of ``size`` bytes; an empty or null file has none."""
    b = F.col(content).cast("binary")
    starts = F.sequence(F.lit(0), F.floor((F.length(b) - 1) / size).cast("int"))
    each = files.where(F.length(b) > 0).select(key, b.alias("_b"), F.explode(starts).alias("_k"))
    return each.select(key, F.left(F.sha2(F.substring("_b", F.col("_k") * size + 1, F.lit(size)), 256), F.lit(16)).alias("print")).distinct()


# --- tables -------------------------------------------------------------------


def transcript_segments(raw: DataFrame) -> DataFrame:
    """[P08] room, idx, speaker, language, text, start, end: alias columns folded, segments without text left out.

    raw: room, idx, text and any of speaker, speaker_name, language, lang, start, start_time, end, end_time.
    """
    has = lambda *names: [F.col(n) for n in names if n in raw.columns]
    said = lambda *names: first_filled(*[c.cast("string") for c in has(*names)], F.lit("Speaker" if names[0] == "speaker" else ""))
    when = lambda *names: F.coalesce(*[c.cast("double") for c in has(*names)], F.lit(None).cast("double"))
    kept = raw.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    language = F.coalesce(F.lower(said("language", "lang")), F.lit(""))
    return kept.select("room", "idx", said("speaker", "speaker_name").alias("speaker"), language.alias("language"), "text", when("start", "start_time").alias("start"), when("end", "end_time").alias("end"))


def kept_telemetry(events: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """[K08] The events of the last ``days`` days, without the columns that may name a question, an answer or a person."""
    return events.drop(*[c for c in events.columns if c in FORBIDDEN]).where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def retired(pages: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """[K19] pages with retired_in and retired_by where their identity is gone from the new version; pages: page, doc."""
    gone = F.col("_new").isNull()
    told = pages.join(new.select("page").distinct().withColumn("_new", F.lit(True)), "page", "left")
    told = told.withColumn("retired_in", F.when(gone, F.lit(version))).withColumn("retired_by", F.when(gone, F.concat(F.lit("wiki/sources/"), F.col("doc").cast("string"), F.lit(".md"))))
    return told.drop("_new")


def closed_versions(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """[K18] pages with page as page@vN and superseded_by where the plan replaces them; refused where that name is taken.

    pages: page, version; plan: page, by (one row for each page). Pages outside the plan, and refused ones, keep their name.
    """
    taken = pages.select(F.col("page").alias("_to")).distinct().withColumn("_taken", F.lit(True))
    told = pages.join(plan.select("page", F.col("by").alias("_by")), "page", "left")
    told = told.withColumn("_to", F.when(F.col("_by").isNotNull(), F.concat("page", F.lit("@v"), F.col("version").cast("string")))).join(taken, "_to", "left")
    refused = F.col("_by").isNotNull() & F.coalesce("_taken", F.lit(False))
    moved = F.col("_by").isNotNull() & ~refused
    told = told.withColumn("superseded_by", F.when(moved, F.col("_by"))).withColumn("refused", refused).withColumn("page", F.when(moved, F.col("_to")).otherwise(F.col("page")))
    return told.drop("_by", "_to", "_taken")
