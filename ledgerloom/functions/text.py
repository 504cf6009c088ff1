"""Scalar functions over text, numbers and dates, as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folds() -> tuple[str, str]:
    """Letters whose decomposition is one letter and marks, and that letter; Hangul syllables, which decompose into several letters, stay."""
    found = {}
    for i in range(0xC0, 0x10000):
        if unicodedata.category(chr(i))[0] == "L":
            base = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn")
            if len(base) == 1 and base != chr(i):
                found[chr(i)] = base
    found["đ"] = "d"
    return "".join(found), "".join(found.values())


FOLD_FROM, FOLD_TO = _folds()

# Secrets and what stands in their place, in order.
SECRETS = (
    (r"(?i)\bxox[baprs]-[A-Za-z0-9-]+", "[REDACTED_SLACK_TOKEN]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(?i)\b(sk-[A-Za-z0-9_-]{12,})\b", "[REDACTED_API_KEY]"),
    (r"(?i)(\b(?:password|passwd|secret|token)\s*[:=]\s*)[^\s,;]+", "$1[REDACTED]"),
)

# Words that a question's terms leave out.
STOP_WORDS = tuple("la gi co khong ko cua va cho nao bao nhieu the nhung mot cac o trong du an hay duoc nay do ai lam".split())

# What a cell of a day off says.
OFF_WORDS = ("", "-", "--", "0", "0.0", "0,0", "x", "p", "off", "nghỉ", "nghi", "nghỉ phép", "nghi phep")


def fold(c: Column) -> Column:
    """Lower case without accents, composed or combining; punctuation stays and đ becomes d."""
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def ascii_words(c: Column) -> Column:
    """Runs of other than a-z and 0-9 become one blank; a letter that has no ASCII base, such as đ, is dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(F.translate(F.lower(c), "đ", "")), r"[^\x00-\x7F]", ""), "[^a-z0-9]+", " "))


def signature(c: Column) -> Column:
    """The folded text's letters and digits alone."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def slug(c: Column, most: int | None = None) -> Column:
    """Words joined by dashes; with ``most``, cut there and back to a whole word."""
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if most is None:
        return s
    return F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(F.left(s, F.lit(most)), "-[^-]*$", ""))


def redact(c: Column) -> Column:
    """Secrets masked, each pattern in its turn."""
    for pattern, mask in SECRETS:
        c = F.regexp_replace(c, pattern, mask)
    return c


def canonical_number(c: Column) -> Column:
    """One spelling of a number: several separators, or one before three digits, part thousands; another one is the decimal point."""
    s = F.regexp_replace(c, "[.,]+$", "")
    marks = F.length(F.regexp_replace(s, "[^.,]", ""))
    whole = F.regexp_replace(s, "[.,]", "")
    number = F.when((marks >= 2) | s.rlike("[.,][0-9]{3}$"), whole).otherwise(F.regexp_replace(s, ",", "."))
    plain = F.regexp_replace(number, "^0+(?=[0-9])", "")
    return F.when(s.rlike("^[0-9][0-9.,]*$"), F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain))


def local_number(c: Column) -> Column:
    """X11: ``480,0``, ``32,88%``, ``8h`` and ``1.234,5`` as doubles; null if none."""
    s = F.regexp_replace(F.trim(c), r"[%hH\s]+$", "")
    both = F.contains(s, F.lit(",")) & F.contains(s, F.lit("."))
    return F.when(both, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(s, ",", ".")).try_cast("double")


def day_month_year(c: Column) -> Column:
    """``27-7-2026`` as a date; other shapes and days that no calendar has are null."""
    return F.when(F.trim(c).rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(F.trim(c), "d-M-yyyy"))


def sprint_end(c: Column) -> Column:
    """The date ``yyyy/M/d`` in a cell; a Sunday means the Friday before."""
    d = F.try_to_date(F.regexp_extract(c, r"(\d{4}/\d{1,2}/\d{1,2})", 1), "yyyy/M/d")
    return F.when(F.dayofweek(d) == 1, F.date_sub(d, 2)).otherwise(d)


def terms(c: Column) -> Column:
    """A question's words of more than two characters, without stop words, in order; repeated words stay."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def is_off(c: Column) -> Column:
    """a day off: blank, a word for leave, or a number not above 0; other words are working days."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return t.isin(*OFF_WORDS) | F.coalesce(F.regexp_replace(t, ",", ".").try_cast("double") <= 0, F.lit(False))


def file_identity(c: Column) -> Column:
    """A file name without its suffix and its version marks, which follow a separator; words joined by dashes."""
    stem = F.regexp_replace(F.lower(c), r"(?<=.)\.[^.]*$", "")
    bare = F.regexp_replace(stem, r"(?:[-_. ]+(?:final|copy|rev|revision|v)?\d*)+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def thread_id(channel: Column, ts: Column) -> Column:
    """``channel:ts`` of two parts that aren't blank and hold no white space, else null."""
    c, t = F.trim(channel), F.trim(ts)
    return F.when((c != "") & (t != "") & ~c.rlike(r"\s") & ~t.rlike(r"\s"), F.concat_ws(":", c, t))


def synthetic_id(*parts: Column) -> Column:
    """The first 24 hex digits of the parts' digest."""
    return F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(24))


def digest(lines: Column) -> Column:
    """Of a collected array of lines, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(lines), "\n"), 256)


def column_letter(i: Column) -> Column:
    """A for 0, Z for 25, AA for 26, AAA for 702 and so on; a long has at most 14 letters."""

    def put(acc: Column, _: Column) -> Column:
        more = F.concat(F.char(F.pmod(acc["n"] - 1, F.lit(26)) + 65), acc["s"])
        return F.struct(F.when(acc["n"] > 0, F.call_function("div", acc["n"] - 1, F.lit(26))).otherwise(0).cast("long").alias("n"), F.when(acc["n"] > 0, more).otherwise(acc["s"]).alias("s"))

    zero = F.struct((i + 1).cast("long").alias("n"), F.lit("").alias("s"))
    return F.when(i >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), zero, put, lambda acc: acc["s"]))
