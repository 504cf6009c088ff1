"""Retrieval, sets, versions, histories and checks, as functions over DataFrames.

"""

from __future__ import annotations

import math
import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shapes import is_done

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package



def lasting(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names; only a local master may do without one.

    It is made once and written as a table; a checkpoint makes it a second time to write it, which is left to what no table can hold.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    if "void" in df.schema.simpleString() or len({c.lower() for c in df.columns}) < len(df.columns):
        return df.checkpoint()
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table that ``lasting`` wrote for df; nothing may read it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:  # a checkpoint has none
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# --- aggregates ---------------------------------------------------------------


def counter(rows: DataFrame, *names: str) -> DataFrame:
    """[A02 A28] name, value, n: how often each value of each named column occurs; one scan for all of them."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))


def totals(tasks: DataFrame) -> DataFrame:
    """[A03] tasks, estimate, actual, remaining (all hours rounded to 4 places), one row."""
    t = tasks.agg(F.count("*").alias("tasks"), F.coalesce(F.sum("estimate"), F.lit(0.0)).alias("e"), F.coalesce(F.sum("actual"), F.lit(0.0)).alias("a"))
    return t.select("tasks", F.round("e", 4).alias("estimate"), F.round("a", 4).alias("actual"), F.round(F.col("e") - F.col("a"), 4).alias("remaining"))


def rolled_up(parts: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """[A04] Final sums of partial rollups, with the distinct sources in order."""
    return parts.groupBy(key).agg(F.round(F.sum(value), 4).alias("total"), F.array_join(F.array_sort(F.collect_set(source)), "; ").alias("sources"))


def ranked_value(rows: DataFrame, keys: Sequence[str], value: str, place: Column, name: str) -> DataFrame:
    """The value at a place (from 0; a column over _n, the group's count) of each group. Equal values are counted before they meet."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys)
    each = each.withColumn("_to", F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_k").over(w))
    at = F.least(place.cast("long"), F.col("_n") - 1)
    return each.where((at < F.col("_to")) & (at >= F.col("_to") - F.col("_k"))).select(*keys, F.col(value).alias(name))


def telemetry(events: DataFrame, key: str, value: str, hit: Column) -> DataFrame:
    """[A16] key, events, hits, p50, p95: counts, cache hits and the values at floor(n * share)."""
    n = events.groupBy(key).agg(F.count("*").alias("events"), F.count_if(hit).alias("hits"))
    for p in (50, 95):
        n = n.join(ranked_value(events, [key], value, F.floor(F.col("_n") * p / 100), f"p{p}"), key, "left")
    return n


def benchmark_percentile(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """[A17] The value at round((n - 1) * share), a half going to the even place."""
    return ranked_value(rows, keys, value, F.bround((F.col("_n") - 1) * share), "value")


def multiset_difference(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """[A21] keys, value, lost, added: by how much counts fell or rose."""
    both = old.select(*keys, value, F.lit(1).alias("_c")).union(new.select(*keys, value, F.lit(-1)))
    d = both.groupBy(*keys, value).agg(F.sum("_c").alias("_d")).where("_d <> 0")
    return d.select(*keys, value, F.greatest("_d", F.lit(0)).alias("lost"), F.greatest(-F.col("_d"), F.lit(0)).alias("added"))


def passed(cases: DataFrame, key: str, ok: Column) -> DataFrame:
    """[A22 A29] key, passed, total, pct."""
    c = cases.groupBy(key).agg(F.count_if(ok).alias("passed"), F.count("*").alias("total"))
    return c.withColumn("pct", F.round(100.0 * F.col("passed") / F.col("total"), 2))


def evidence(posts: DataFrame, user: str, at: str, file: str) -> DataFrame:
    """[A24] user, first_at, files in order of time."""
    files = F.array_sort(F.collect_list(F.when(F.col(file).isNotNull(), F.struct(at, file))))
    return posts.groupBy(user).agg(F.min(at).alias("first_at"), F.array_join(files[file], ",").alias("files"))


def coverage_audit(cells: DataFrame, covered: DataFrame, sheet: str, cell: Sequence[str]) -> DataFrame:
    """[A26] sheet, cells, covered: cells that aren't empty, and those that some fact covers; a null sheet is the total."""
    j = cells.join(covered.select(sheet, *cell).distinct().withColumn("_c", F.lit(1)), [sheet, *cell], "left")
    return j.rollup(sheet).agg(F.count("*").alias("cells"), F.count("_c").alias("covered"))


def effort_against_allocation(logged: DataFrame, allocation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[A31] keys, logged, allocated, verdict: over, under or even, of hours rounded to 4 places; who is in one table only has 0 hours in the other."""
    total = lambda df, name: df.groupBy(*keys).agg(F.round(F.sum("hours"), 4).alias(name))
    j = total(logged, "logged").join(total(allocation, "allocated"), list(keys), "full_outer").fillna(0.0, ["logged", "allocated"])
    d = F.col("logged") - F.col("allocated")
    return j.withColumn("verdict", F.when(d > 0.01, "over").when(d < -0.01, "under").otherwise("even"))


# --- search -------------------------------------------------------------------


def term_masks(rows: DataFrame, key: str, blob: Column, terms: Sequence[str]) -> DataFrame:
    """key, mask: the terms (up to 63) that a row holds as substrings, a bit for each; blob is computed once a row, and once for all that follows."""
    mask = F.transform(F.array(blob), lambda b: sum((F.when(F.contains(b, F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(terms)), F.lit(0).cast("long")))
    return lasting(rows.select(key, F.get(mask, F.lit(0)).alias("mask")))


def shares(masks: DataFrame, key: str, n_terms: int) -> DataFrame:
    """[A20 T01] key, share: the idf of the terms that a row holds over that of all, idf = ln((1 + N) / (1 + df)); rows with a hit."""
    holds = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    n = masks.agg(F.count("*").alias("n"), *[F.count_if(holds(i)).alias(f"d{i}") for i in range(n_terms)]).first()  # one row of counts
    idf = [F.log((F.lit(1.0) + n["n"]) / (1 + n[f"d{i}"])) for i in range(n_terms)]
    total = F.coalesce(F.nullif(sum(idf, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return masks.where("mask <> 0").select(key, F.round(sum((F.when(holds(i), x).otherwise(0.0) for i, x in enumerate(idf)), F.lit(0.0)) / total, 9).alias("share"))


def row_search(rows: DataFrame, key: str, blob: Column, terms: Sequence[str], keep: int | None) -> DataFrame:
    """[A20 T01] key, share of the best rows by share, ties by key; without keep, all rows with a hit."""
    some = shares(term_masks(rows, key, blob, terms), key, len(terms))
    return some if keep is None else some.orderBy(F.desc("share"), key).limit(keep)


def fallback_shares(rows: DataFrame, key: str, blob: Column, terms: Sequence[str], column_words: Sequence[str] = (), least: float = 0.6) -> DataFrame:
    """[R10] key, share, found of all rows with a hit: found are those of the highest share, if that is at least ``least``; column_words are no terms, and below two terms nothing is found."""
    asked = [t for t in terms if t not in column_words]
    scored = row_search(rows, key, blob, asked, None)
    if len(asked) < 2:
        return scored.withColumn("found", F.lit(False))
    top = F.broadcast(scored.agg(F.max("share").alias("_top")))  # one row
    return scored.join(top).select(key, "share", ((F.col("share") == F.col("_top")) & (F.col("_top") >= least)).alias("found"))


def fallback(rows: DataFrame, key: str, blob: Column, terms: Sequence[str], column_words: Sequence[str] = (), least: float = 0.6) -> DataFrame:
    """[R10] key, share of the rows that ``fallback_shares`` finds."""
    return fallback_shares(rows, key, blob, terms, column_words, least).where("found").drop("found")


def top_ties(scored: DataFrame, score: str) -> DataFrame:
    """[T02] Only the rows of the highest score."""
    return scored.join(F.broadcast(scored.agg(F.max(score).alias(score))), score)  # one row


def overfetched(hits: DataFrame, allowed: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The k best of the 8 k best hits of positive score that may be read."""
    best = hits.where(F.col(score) > 0).orderBy(F.desc(score), key).limit(8 * k)
    return best.join(allowed.select(key), key, "left_semi").orderBy(F.desc(score), key).limit(k)


def hash_embedding(texts: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """[R01] key, i, x: the places of a text's vector that aren't 0. A word's digest names a place (4 bytes) and a sign (bit 0 of the next); length 1."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))).alias("w"))
    words = words.groupBy(key, "w").agg(F.count("*").alias("c")).withColumn("d", F.sha2("w", 256))
    at = (F.conv(F.substring("d", 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring("d", 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    v = words.groupBy(key, at.alias("i")).agg(F.sum(sign * F.col("c")).alias("x")).where("x <> 0")
    norm = v.groupBy(key).agg(F.sqrt(F.sum((F.col("x") * F.col("x")).cast("double"))).alias("n"))
    return v.join(norm, key).select(key, "i", (F.col("x") / F.col("n")).alias("x"))


# Verbs of a request to change data, words that name open, document and structured questions.
ACTIONS = "cap nhat|sua|tao|doi|update|create|delete|remove|add|xoa"
OPEN = "vì sao|tại sao|nguyên nhân|đánh giá|nhận xét|giải thích"
DOCUMENT = "tài liệu|sheet|wiki|master schedule|resource plan|summary"
STRUCTURED = "ai |task|sprint|effort|giờ|status|trạng thái|bao nhiêu|ngày"


def is_action(plain: Column) -> Column:
    """[F16] Whether folded text asks for a change: one of the verbs that no "khong" stands before, with two words between at most; or it begins with ghi or log."""
    bare = F.regexp_replace(plain, rf"\bkhong(?:\s+\w+){{0,2}}\s*\b(?:{ACTIONS})\b", " ")
    return bare.rlike(rf"\b({ACTIONS})\b") | plain.rlike(r"^\s*(ghi|log)\b")


def route(question: Column, plain: Column) -> Column:
    """[R11] action, open, document or structured; document where nothing tells."""
    q = F.lower(question)
    return F.when(is_action(plain), "action").when(q.rlike(OPEN), "open").when(q.rlike(DOCUMENT), "document").when(q.rlike(STRUCTURED), "structured").otherwise("document")


# --- sets, versions, histories ------------------------------------------------


def except_both(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """[U03 U06] key, side: expected but missing, or extra."""
    j = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(actual.select(key).distinct().withColumn("_a", F.lit(1)), key, "full_outer")
    return j.where("_e is null or _a is null").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))


def union_in_order(lists: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """[U05] Each item at its first place."""
    return lists.groupBy(item).agg(F.min(F.struct(*order)).alias("first")).select(item, *[F.col("first")[o].alias(o) for o in order])


def expanded_ranges(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """[U08] key, cell: the cells of ranges such as A3 to B16, of one-letter columns."""
    letter = lambda c: F.ascii(F.substring(c, 1, 1))
    row = lambda c: F.regexp_extract(c, r"([0-9]+)$", 1).cast("int")
    each = ranges.select(key, F.explode(F.sequence(letter(start), letter(end))).alias("l"), F.sequence(row(start), row(end)).alias("rs"))
    return each.select(key, "l", F.explode("rs").alias("r")).select(key, F.concat(F.char(F.col("l").cast("long")), F.col("r").cast("string")).alias("cell"))


def impacted(pages: DataFrame, key: str, sources: str, changed: DataFrame, path: str) -> DataFrame:
    """[J24] key, strategy: pages with a changed source; all if all of its sources changed, else part."""
    each = pages.select(key, F.explode(F.array_distinct(sources)).alias(path)).join(changed.select(path).distinct().withColumn("_c", F.lit(1)), path, "left")
    n = each.groupBy(key).agg(F.count("*").alias("n"), F.count("_c").alias("c")).where("c > 0")
    return n.select(key, F.when(F.col("n") == F.col("c"), "all").otherwise("part").alias("strategy"))


def write_set(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """[U07 J28] key, action: new, write (changed), removed or keep."""
    j = old.select(key, F.col(digest).alias("_o"), F.lit(1).alias("_io")).join(new.select(key, F.col(digest).alias("_n"), F.lit(1).alias("_in")), key, "full_outer")
    act = F.when(F.col("_io").isNull(), "new").when(F.col("_in").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "write").otherwise("keep")
    return j.select(key, act.alias("action"))


def found_by_id(rows: DataFrame, asked: DataFrame, key: str, place: str) -> DataFrame:
    """[J23] key, verdict, place: of an id in several tabs: found (and where), not_found or ambiguous."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(place).alias("p"))
    j = asked.select(key).join(n, key, "left")
    return j.select(key, F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("verdict"), F.when(F.col("n") == 1, F.col("p")).alias(place))


def registered(registry: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """[K20] key, version, current, supersedes, digest of the registry after incoming rows (key, from_version, digest); the next registry.

    A row whose from_version is the current version closes it and opens the next, unless the digest is the same; a row of an unknown
    key opens version 1; a row that expects another version changes nothing and is among ``refused``.
    """
    now = registry.where("current").select(key, F.col("version").alias("_v"), F.col("digest").alias("_d"))
    known = registry.select(key).distinct().withColumn("_k", F.lit(1))
    j = incoming.join(now, key, "left").join(known, key, "left")
    fresh = j.where(F.col("_k").isNull() | ((F.col("from_version") == F.col("_v")) & ~F.col("digest").eqNullSafe(F.col("_d"))))
    made = fresh.select(key, (F.coalesce("_v", F.lit(0)) + 1).alias("version"), F.lit(True).alias("current"), F.col("_v").alias("supersedes"), "digest")
    old = registry.join(made.select(key).withColumn("_m", F.lit(1)), key, "left").select(key, "version", (F.col("current") & F.col("_m").isNull()).alias("current"), "supersedes", "digest")
    return old.union(made)


def refused(registry: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """[K20] key, from_version, now of incoming rows of known keys that expect another version than the current one (``now``, null if none is)."""
    now = registry.groupBy(key).agg(F.max(F.when(F.col("current"), F.col("version"))).alias("now"))
    return incoming.join(now, key).where(~F.col("from_version").eqNullSafe(F.col("now"))).select(key, "from_version", "now").distinct()


def intake(incoming: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """[G09] key, decision of incoming (key, digest, semantic, confirmed) against registry (key, version, current, digest, semantic).

    In this order: the digest is that of several versions (``review``) or of one, whatever document's (``duplicate``); the key is unknown
    (``initial_ingest``); it is known but nobody has confirmed it (``identity_review``); the semantic digest is that of the current
    version (``no_op``); else ``reingest``.
    """
    now = registry.where("current").select(key, F.col("semantic").alias("_s"))
    known = registry.select(key).distinct().withColumn("_k", F.lit(1))
    held = registry.groupBy("digest").agg(F.count("*").alias("_n"))
    j = incoming.join(known, key, "left").join(now, key, "left").join(held, "digest", "left")
    d = F.when(F.col("_n") > 1, "review").when(F.col("_n") == 1, "duplicate").when(F.col("_k").isNull(), "initial_ingest").when(~F.col("confirmed"), "identity_review")
    return j.select(key, d.when(F.col("_s") == F.col("semantic"), "no_op").otherwise("reingest").alias("decision"))


def history_faults(registry: DataFrame, key: str) -> DataFrame:
    """[G07 G08] key, version, fault: what it supersedes does not exist, or is not smaller; an old version that nothing supersedes."""
    own = registry.select(key, F.col("version").alias("supersedes"), F.lit(1).alias("_e"))
    after = registry.select(key, F.col("supersedes").alias("version"), F.lit(1).alias("_s")).where("version is not null").distinct()
    j = registry.join(own, [key, "supersedes"], "left").join(after, [key, "version"], "left")
    f = F.when(F.col("supersedes").isNotNull() & F.col("_e").isNull(), "missing").when(F.col("supersedes") >= F.col("version"), "not_smaller").when(~F.col("current") & F.col("_s").isNull(), "dangling")
    return j.withColumn("fault", f).where("fault is not null").select(key, "version", "fault")


def retained(rows: DataFrame, key: str, order: str, n: int, fresh: Column) -> DataFrame:
    """[W09 K08] Rows that are fresh and among the newest n of their key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.where(fresh).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def before_blank_run(rows: DataFrame, sheet: str, row: str, blank: Column, run: int) -> DataFrame:
    """[W17] Rows that aren't blank, up to the first run of so many blank ones."""
    w = Window.partitionBy(sheet).orderBy(row)
    full = F.sum((~blank).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("_b", blank).withColumn("_g", full)
    ends = r.where("_b").groupBy(sheet, "_g").agg(F.count("*").alias("k")).where(F.col("k") >= run).groupBy(sheet).agg(F.min("_g").alias("_end"))
    return r.where("not _b").join(ends, sheet, "left").where(F.col("_end").isNull() | (F.col("_g") <= F.col("_end"))).drop("_b", "_g", "_end")


def header_dates(header: DataFrame, sheet: str, col: str, month: str, day: str, year: int) -> DataFrame:
    """[W02 W03] sheet, col, date: a month's name holds for the columns to its right; columns without a day have no date."""
    w = Window.partitionBy(sheet).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    m = header.withColumn("_m", F.last(month, ignorenulls=True).over(w)).where(F.col("_m").isNotNull() & F.col(day).isNotNull())
    return m.select(sheet, col, F.make_date(F.lit(year), F.col("_m"), F.col(day)).alias("date"))


def unpivoted(grid: DataFrame, key: str, hours: str, dates: DataFrame, sheet: str, col: str) -> DataFrame:
    """[U02 J19] key, date, hours: an array of cells by column, laid out by date; a cell that is no number is null, not 0."""
    each = grid.select(sheet, key, F.posexplode(hours).alias(col, "_h"))
    return each.join(dates, [sheet, col]).select(key, "date", F.regexp_replace(F.trim("_h"), ",", ".").try_cast("double").alias("hours"))


def cascade(tasks: DataFrame, person: str, order: Sequence[str], hours: str, start: Column, per_day: float = 8.0) -> DataFrame:
    """[W12 W10] person, order, first_day, last_day: each task begins where the one before ends, hours left over in a day go on, weekends are skipped.

    start is a Monday. Working day k is k days and two more for each five of them after it.
    """
    to = F.sum(hours).over(Window.partitionBy(person).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    t = tasks.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col(hours))
    date = lambda k: F.date_add(start, (k + 2 * F.floor(k / 5)).cast("int"))
    return t.select(person, *order, date(F.floor(F.col("_from") / per_day)).alias("first_day"), date(F.greatest(F.ceil(F.col("_to") / per_day) - 1, F.floor(F.col("_from") / per_day))).alias("last_day"))


def past_sprint_end(planned: DataFrame, end: Column) -> DataFrame:
    """[W19] Tasks whose new end is after the sprint's, with the days over."""
    return planned.withColumn("days_over", F.datediff("last_day", end)).where("days_over > 0")


def last_of_local_day(messages: DataFrame, key: str, at: str, day: Column, offset_hours: int = 7) -> DataFrame:
    """[W20] A key's last message of the local day; none, no row."""
    local = (F.col(at) + F.make_dt_interval(hours=F.lit(offset_hours))).cast("date")
    return messages.where(local == day).groupBy(key).agg(F.max(at).alias("last_at"))


def next_id(rows: DataFrame, id_: str, prefix: str = "R-") -> DataFrame:
    """[W18 K12] next_id: the prefix and one more than the largest number, of two digits at least."""
    n = F.coalesce(F.max(F.regexp_extract(id_, rf"^{prefix}(\d+)$", 1).try_cast("long")), F.lit(0)) + 1
    return rows.agg(n.alias("n")).select(F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(2), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("next_id"))


# --- checks -------------------------------------------------------------------


def measure_faults(measures: DataFrame, key: str) -> DataFrame:
    """[G01] key, missing: measures (value, unit, src) that lack a finite number, a unit or a source."""
    bad = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    missing = F.concat_ws(",", F.when(F.col("value").isNull() | F.isnan("value"), "value"), F.when(bad("unit"), "unit"), F.when(bad("src"), "src"))
    return measures.select(key, missing.alias("missing")).where("missing <> ''")


def unsupported_numbers(answers: DataFrame, sources: DataFrame, key: str, number: str) -> DataFrame:
    """[G03] key, number: numbers of an answer that none of its cited sources says."""
    return answers.select(key, number).distinct().join(sources.select(key, number).distinct(), [key, number], "left_anti")


def enum_faults(rows: DataFrame, key: str, required: Sequence[str], enums: dict[str, Sequence[str]]) -> DataFrame:
    """[G06] key, fault: a required field that is blank, or a value that its enumeration does not have."""
    blank = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"{c}: missing")) for c in required]
    other = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"{c}: not allowed")) for c, v in enums.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*blank, *other))).alias("fault"))


def inconsistent(tasks: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """[G17] key, fault: progress that isn't actual over estimate, or hours that remain that aren't their difference."""
    off = lambda a, b: F.abs(a - b) > tolerance
    faults = F.array(F.when(off(F.col("progress"), F.try_divide("actual", "estimate")), "progress"), F.when(off(F.col("remaining"), F.col("estimate") - F.col("actual")), "remaining"))
    return tasks.select(key, F.explode(F.array_compact(faults)).alias("fault"))


def subset_faults(needed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """[G18 J21] What is needed and not there."""
    return needed.select(key).distinct().join(there.select(key), key, "left_anti")


def compliance(people: DataFrame, off: DataFrame, replied: DataFrame, logged: DataFrame, key: str) -> DataFrame:
    """[J29 A25] key, verdict: people who aren't off and no bots: reported, proven (by the ledger) or missing."""
    p = people.where("not is_bot").select(key).join(off.select(key), key, "left_anti")
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    j = p.join(mark(replied, "_r"), key, "left").join(mark(logged, "_l"), key, "left")
    return j.select(key, F.when(F.col("_r").isNotNull(), "reported").when(F.col("_l").isNotNull(), "proven").otherwise("missing").alias("verdict"))


def reconciled(excess: DataFrame, overtime: DataFrame, risks: DataFrame) -> DataFrame:
    """[J26] person, task, day, hours, verdict of hours to be explained.

    overtime: person, day, hours; risks: person, task, status. ``match``: overtime of this person, day and number of hours, and a risk of this
    person and task that is Done; ``open``: such overtime, and a risk that isn't Done; ``unknown``: all else.
    """
    paid = overtime.select("person", "day", F.col("hours").alias("_h")).distinct()
    known = excess.join(paid, ["person", "day"], "left").groupBy("person", "task", "day", "hours").agg(F.bool_or(F.abs(F.col("hours") - F.col("_h")) <= 0.01).alias("_paid"))
    risk = risks.groupBy("person", "task").agg(F.bool_or(F.col("status") == "Done").alias("_done"))
    verdict = F.when(F.col("_paid") & F.col("_done"), "match").when(F.col("_paid") & F.col("_done").isNotNull(), "open").otherwise("unknown")
    return known.join(risk, ["person", "task"], "left").select("person", "task", "day", "hours", verdict.alias("verdict"))


def decided(risks: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[K21] Risks after decisions (keys, action): an open risk that matches takes the action's status; overtime leaves it open, a reschedule closes it. Decisions without a risk become open ones."""
    d = decisions.groupBy(*keys).agg(F.max(F.col("action") == "reschedule").alias("_done")).withColumn("_d", F.lit(1))
    open_ = risks.where("status <> 'Done'").join(d, list(keys), "full_outer")
    status = F.when(F.col("_done"), "Done").otherwise("Open")
    return risks.where("status = 'Done'").select(*keys, "status").union(open_.select(*keys, F.when(F.col("_d").isNull(), F.col("status")).otherwise(status)))


def calendar_late(tasks: DataFrame, at: Column) -> DataFrame:
    """Open tasks whose planned end is past, or is today from 17 o'clock on."""
    day = at.cast("date")
    return tasks.where(~F.col("is_done") & ((day > F.col("plan_end")) | ((day == F.col("plan_end")) & (F.hour(at) >= 17))))


# What an open task's empty end is written as, and what may stand before a line.
NO_END = ("", "-", "--", "x", "?", "n/a", "chưa", "chưa xong", "tbd")
BEFORE_LINE = r"^(?:\s+|[-–*•>`]+|\d+[.)]\s+)+"


def clean_line(line: Column) -> Column:
    """A report's line without list marks, emphasis and a leading bar; a bar at its end stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\s+$", ""), r"(?<=[^*`])[*`]+$", ""), BEFORE_LINE, ""), r"^\s*\|\s*", "")


def log_line_faults(line: Column, example: str | None = None) -> Column:
    """The faults of a line ``id | re-estimate | start | end | actual | status | note``, joined by commas: none for a valid line.

    Null where the line is no log line: without a bar, without a digit in its first field, or the example itself. Faults: ``fields`` (fewer than
    six bars), ``estimate``, ``actual``, ``status`` (empty), ``start`` (not of the shape DD-MM-YYYY), ``end`` (not of that shape where the status is
    done; where it isn't, a date of another shape).
    """
    date = r"^\d{2}-\d{2}-\d{4}$"
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def told(whole: Column, p: Column) -> Column:
        at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
        empty = lambda name, i: F.when((F.size(p) > i) & (at(i) == ""), name)
        late = F.when(is_done(at(5)), ~at(3).rlike(date)).otherwise(~F.lower(at(3)).isin(*NO_END) & at(3).rlike(r"\d\s*[-/.]\s*\d") & ~at(3).rlike(date))
        faults = F.concat_ws(",", F.when(F.size(p) < 7, "fields"), empty("estimate", 1), empty("actual", 4), empty("status", 5), F.when(~at(2).rlike(date), "start"), F.when(late, "end"))
        is_line = F.contains(whole, F.lit("|")) & at(0).rlike(r"\d")
        return F.when(is_line if example is None else is_line & (whole != clean_line(F.lit(example))), faults)

    fields = lambda whole: F.transform(F.split(whole, r"\|"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    # A line is cleaned and cut once, whatever looks at its fields.
    return once(clean_line(line), lambda whole: once(fields(whole), lambda p: told(whole, p)))


def cascaded_delays(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """[G14] task, delay: own delay or the largest delay of what it waits for (links: task, on), to the fixpoint; cycles end as delays are bounded by the largest."""
    now = tasks.select("task", "delay")
    while True:
        passed_on = links.join(now.select(F.col("task").alias("on"), F.col("delay").alias("_d")), "on").groupBy("task").agg(F.max("_d").alias("_d"))
        then = now.join(passed_on, "task", "left").select("task", F.greatest("delay", F.coalesce("_d", F.col("delay"))).alias("delay"), (F.col("_d") > F.col("delay")).alias("_up"))
        then = lasting(then)
        now = then.drop("_up")
        if not then.where("_up").take(1):
            return now


# --- graph --------------------------------------------------------------------


#: What a task of ``_reached`` holds: seeds, bytes of their bits, rows of the last hop; edges that it reads; nodes that it gives out at a time.
SEEDS, BIT_BYTES, LAST, EDGES, NODES = 2048, 1 << 26, 1 << 21, 1 << 16, 128


def _reached(both: DataFrame, last: DataFrame, known: DataFrame) -> DataFrame:
    """seed, node: once each, what an edge a, b of both leads to from a row seed, node of last, without known's rows.

    A task has some of the seeds and the edges to some of the nodes. A node's seeds are the bits of all that lead to it, so that a pair that many
    edges make is neither shuffled nor kept. The tasks get each edge once for 2048 seeds, and each row of last once for 65,536 edges.
    """
    rows, seeds, nodes = last.agg(F.count("*"), F.countDistinct("seed"), F.countDistinct("node")).first()
    ways = lasting(both.join(last.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
    c = max(1, math.ceil(seeds / SEEDS), math.ceil(seeds * nodes / 8 / BIT_BYTES), math.ceil(rows / LAST))
    d = max(1, math.ceil(ways.count() / EDGES))
    of_seed, of_node = (lambda x: F.pmod(F.xxhash64(x), F.lit(c)) * d), (lambda x: F.pmod(F.xxhash64(x), F.lit(d)))
    each = lambda n, step: F.explode(F.sequence(F.lit(0), F.lit((n - 1) * step), F.lit(step)))
    dealt = last.select("seed", "node", F.lit(0).alias("kind"), each(d, 1).alias("_d")).select((of_seed("seed") + F.col("_d")).alias("task"), "kind", F.col("seed").alias("x"), F.col("node").alias("y"))
    dealt = dealt.union(known.select(of_seed("seed") + of_node("node"), F.lit(1), "seed", "node"))
    dealt = dealt.union(ways.select("a", "b", each(c, d).alias("_c")).select(F.col("_c") + of_node("b"), F.lit(2), "a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[pa.RecordBatch] = []
        bits = held = None

        def given(names: pa.Array, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(at), NODES):
                hit = np.unpackbits((at[i : i + NODES, 0] & ~at[i : i + NODES, 1]).view(np.uint8), axis=1, count=len(own), bitorder="little")
                ends = np.concatenate([[0], np.cumsum(hit.sum(axis=1, dtype=np.int64))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([names[i : i + NODES], pa.ListArray.from_arrays(pa.array(ends), own.take(pa.array(np.nonzero(hit)[1])))], ["node", "seeds"])

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            start = int(np.searchsorted(kind > 0, True))
            if start:
                first.append(batch.slice(0, start))
            batch, kind = batch.slice(start), kind[start:]
            if not first or not len(kind):
                continue  # none of the seeds is this task's
            if bits is None:  # for each node of the last hop its seeds, a row of nothing, and each seed by itself as known
                x, y = (pa.chunked_array([b.column(k) for b in first]).combine_chunks().dictionary_encode() for k in "xy")
                own, via = x.dictionary, y.dictionary
                bits = np.zeros((len(via) + 1 + len(own), 2, 8 * math.ceil(len(own) / 64)), np.uint8)
                s = np.concatenate([x.indices.to_numpy(), np.arange(len(own))])
                at = np.concatenate([y.indices.to_numpy(), len(via) + 1 + np.arange(len(own))])
                np.bitwise_or.at(bits, (at, (at > len(via)).astype(int), s >> 3), np.left_shift(1, s & 7).astype(np.uint8))
                bits = bits.view(np.uint64)
            edge = pc.index_in(batch.column("x"), via).fill_null(len(via)).to_numpy()
            self = pc.index_in(batch.column("x"), own).to_numpy(zero_copy_only=False)
            at = np.where(kind == 2, edge, np.where(np.isnan(self), len(via), self + len(via) + 1)).astype(np.int64)
            same = batch.column("y").dictionary_encode(null_encoding="encode")
            starts = np.flatnonzero(np.diff(same.indices.to_numpy(), prepend=-1))
            names, got = batch.column("y").take(pa.array(starts)), np.bitwise_or.reduceat(bits[at], starts, axis=0)
            if held is not None:  # a node's rows may go on in the next batch
                if held[0][0].as_py() == names[0].as_py():
                    got[0] |= held[1][0]
                else:
                    yield from given(*held)
            held = names[-1:], got[-1:].copy()
            yield from given(names[:-1], got[:-1])
        if held is not None:
            yield from given(*held)

    kinds = {k: dealt.schema[k].dataType.simpleString() for k in "xy"}
    lists = dealt.repartitionById(c * d, F.col("task").cast("int")).drop("task").sortWithinPartitions(F.col("kind") > 0, "y").mapInArrow(run, f"node {kinds['y']}, seeds array<{kinds['x']}>")
    return lists.select(F.explode("seeds").alias("seed"), "node")


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """[G11] seed, node, hop: nodes within so many edges of a seed, either way, at their least distance. edges: a, b; seeds: node.

    A null node is reached like others and leads nowhere. Seeds that repeat do so at hop 0.
    """
    both = lasting(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    seen = lasting(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")))
    for hop in range(1, hops + 1):
        # What lies one edge from the last hop is at that hop, at the one before, or new; but for null, which has no edges.
        last = seen.where((F.col("hop") == hop - 1) & F.col("node").isNotNull()).select("seed", "node")
        known = seen.where((F.col("hop") >= hop - 2) | F.col("node").isNull()).select("seed", "node")
        found = _reached(both, last, known).withColumn("hop", F.lit(hop))
        seen = seen.union(found if hop == hops else lasting(found))
    return seen


def pivoted(edges: DataFrame, rels: Sequence[str], may_see: DataFrame, key: str = "a") -> DataFrame:
    """[J14 G12] key and a column for each relation with its smallest target; assignee is null where the key may not be seen."""
    p = edges.groupBy(key).pivot("rel", list(rels)).agg(F.min("b"))
    p = p.join(may_see.select(key).distinct().withColumn("_m", F.lit(True)), key, "left")
    return p.withColumn("assignee", F.when(F.col("_m"), F.col("assignee"))).drop("_m")
