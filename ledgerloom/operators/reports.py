"""Reports, guards, document slices and lookups, as functions over DataFrames.

"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- people and what they report ----------------------------------------------


def logged_hours(ledger: DataFrame) -> DataFrame:
    """[A15] person, day, hours, entries, open_tasks (distinct, by first entry); ledger: person, day, task, delta, open, seq."""
    is_open = F.col("open") & F.col("task").isNotNull()
    tasks = ledger.groupBy("person", "day", "task").agg(F.sum(F.coalesce("delta", F.lit(0.0))).alias("h"), F.count("*").alias("n"), F.min(F.when(is_open, F.col("seq"))).alias("first"))
    opened = F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "task")))
    days = tasks.groupBy("person", "day").agg(F.sum("h").alias("h"), F.sum("n").alias("entries"), F.array_sort(opened).alias("o"))
    return days.select("person", "day", F.round("h", 4).alias("hours"), "entries", F.array_join(F.col("o.task").cast("array<string>"), ",").alias("open_tasks"))


def report_verdicts(people: DataFrame, lines: DataFrame) -> DataFrame:
    """[A25] person, verdict: reported needs a log line and every log line valid; lines: person, is_log, valid."""
    log = F.coalesce("is_log", F.lit(False))
    seen = lines.groupBy("person").agg(F.count_if(log).alias("logs"), F.count_if(log & ~F.coalesce("valid", F.lit(False))).alias("bad"))
    verdict = F.when(F.col("logs").isNull(), "not_reported").when((F.col("logs") > 0) & (F.col("bad") == 0), "reported").otherwise("bad_format")
    return people.select("person").join(seen, "person", "left").select("person", verdict.alias("verdict"))


def observed(rows: DataFrame, *names: str) -> DataFrame:
    """[A27] name, value_list: the sorted distinct values of each dimension; values are made distinct before they meet."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])
    each = rows.select(F.explode(pairs).alias("p")).select("p.name", "p.value").where("value is not null and value <> ''").distinct()
    return each.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value_list"))


def thread_totals(messages: DataFrame, thread: str) -> DataFrame:
    """[A30] threads, messages; one row."""
    return messages.groupBy(thread).agg(F.count("*").alias("n")).agg(F.count(thread).alias("threads"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


def scoped_rows(rows: DataFrame, header: str, value: str, cite: str) -> DataFrame:
    """[A32] header, n, cite: each row with a value under its header, beside how many there are. Counts are joined, so no header is gathered."""
    held = rows.where(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")
    return held.select(header, cite).join(held.groupBy(header).agg(F.count("*").alias("n")), header)


def people_by_tasks(tasks: DataFrame, person: str) -> DataFrame:
    """[A33 T05] person, tasks: most tasks first, ties by person."""
    return tasks.where(F.col(person).isNotNull()).groupBy(F.col(person).alias("person")).agg(F.count("*").alias("tasks")).orderBy(F.desc("tasks"), "person")


def module_coverage(modules: DataFrame, pages: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """[A34] key, coverage: partial with pages and gaps, covered with pages alone, else not_in_kb."""
    has = lambda t, name: t.select(key).distinct().withColumn(name, F.lit(True))
    j = modules.select(key).join(has(pages, "_p"), key, "left").join(has(gaps, "_g"), key, "left")
    return j.select(key, F.when(F.col("_p") & F.col("_g"), "partial").when(F.col("_p"), "covered").otherwise("not_in_kb").alias("coverage"))


# --- filters and guards -------------------------------------------------------


def current(rows: DataFrame, registry: DataFrame, doc: str, version: str, pages: bool = False) -> DataFrame:
    """Rows of the registered version (registry: doc, current). Rows without a document or version pass only as pages."""
    named = F.col(doc).isNotNull() & F.col(version).isNotNull()
    kept = rows.where(named).join(registry.select(F.col("doc").alias(doc), F.col("current").alias(version)), [doc, version], "left_semi").select(*rows.columns)
    return kept.unionByName(rows.where(~named)) if pages else kept


def log_guards(logs: DataFrame) -> DataFrame:
    """logs with guard: the first rule that stops an entry, and diff in hours.

    logs: status, estimate, re_estimate, actual, total_today, allocated; a null switches its rule off.
    """
    over = F.greatest(F.col("actual") - F.col("estimate"), F.col("re_estimate") - F.col("estimate"))
    left = F.col("re_estimate") - F.col("actual")
    done = (F.lower(F.trim("status")) == "done") & (F.abs(left) > 0.01)
    gap = F.round(F.col("allocated") - F.round("total_today", 2), 2)
    rules = [("overtime", over > 0, over), ("done_mismatch", done, left), ("allocation_mismatch", gap < -0.01, gap)]
    guard, diff = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, hit, by in reversed(rules):
        guard, diff = F.when(hit, name).otherwise(guard), F.when(hit, F.round(by, 2)).otherwise(diff)
    return logs.withColumn("guard", guard).withColumn("diff", diff)


def blocked(note: Column) -> Column:
    """The note speaks of a block, in any case."""
    return F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit("block"))


def reusable_requests(incoming: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """incoming with reuse: the first live request with the same keys; requests: keys, id, status. Blank keys reuse none."""
    live = requests.where("status is null or status not in ('failed', 'stale')").groupBy(*keys).agg(F.min("id").alias("reuse"))
    for k in keys:
        live = live.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return incoming.join(live, list(keys), "left")


# --- lookups ------------------------------------------------------------------


def untranslated(segments: DataFrame, langs: Sequence[str], native: Sequence[str], cached: DataFrame, pending: DataFrame) -> DataFrame:
    """[J22] idx, target: what each language still lacks; segments: idx, language; cached and pending: idx, target."""
    asked = [x for x in langs if x not in set(native)]
    todo = segments.select("idx", "language", F.explode(F.lit(asked).cast("array<string>")).alias("target")).where("language is null or language = '' or language <> target")
    return todo.select("idx", "target").join(cached, ["idx", "target"], "left_anti").join(pending, ["idx", "target"], "left_anti")


def related(cells: DataFrame, given: str, wanted: str) -> DataFrame:
    """[J25] doc, row_no, given, wanted: the value beside a value, by direction; cells: doc, row_no, header, value. Rows are folded, not joined."""
    at = lambda h: F.max(F.when(F.col("header") == h, F.col("value")))
    return cells.where(F.col("header").isin(given, wanted)).groupBy("doc", "row_no").agg(at(given).alias("given"), at(wanted).alias("wanted")).where("given <> '' and wanted <> ''")


def person_nodes(names: DataFrame, people: DataFrame) -> DataFrame:
    """[J27] name, node: a known person's node, else a node of the dimension; people: name, node."""
    known = people.groupBy("name").agg(F.min("node").alias("node"))
    return names.select("name").distinct().join(known, "name", "left").select("name", F.coalesce("node", F.concat(F.lit("dim:"), F.col("name").cast("string"))).alias("node"))


def overridden(new: DataFrame, old: DataFrame) -> DataFrame:
    """[U09] title, block, state: fixed blocks of the old text stay; both hold title, block, old also fixed. A fixed block whose title is gone is ``missing``."""
    kept = old.where("fixed").select("title", F.col("block").alias("_old"))
    j = new.select("title", F.col("block").alias("_new"), F.lit(True).alias("_n")).join(kept, "title", "full_outer")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_old").isNotNull(), "reused").otherwise("generated")
    return j.select("title", F.coalesce("_old", "_new").alias("block"), state.alias("state"))


# --- values and shapes --------------------------------------------------------


def mean_log(confidence: Column) -> Column:
    """[P10] The aggregate mean of ln(confidence), at least 1e-6 each; nulls are left out, and -0.1 stands for none at all."""
    return F.coalesce(F.avg(F.when(confidence.isNotNull(), F.log(F.greatest(confidence, F.lit(1e-6))))), F.lit(-0.1))


def widened(lists: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """[P15] The array ``values`` as columns name_1, name_2, ... up to the longest array's length, which alone reaches the driver."""
    width = max(lists.agg(F.max(F.size(F.coalesce(F.col(values), F.array())))).first()[0] or 0, 1)
    return lists.select(key, *[F.get(F.col(values), F.lit(i)).alias(f"{name}_{i + 1}") for i in range(width)])


def chapter_marks(headings: DataFrame) -> DataFrame:
    """[W14] doc, number, start, title: each number's last heading, numbers increasing with place; headings: doc, number, start, title."""
    last = headings.groupBy("doc", "number").agg(F.max(F.struct("start", "title")).alias("at")).select("doc", "number", "at.start", "at.title")
    before = F.max("number").over(Window.partitionBy("doc").orderBy("start", "title").rowsBetween(Window.unboundedPreceding, -1))
    return last.withColumn("_m", before).where("_m is null or number > _m").drop("_m")


def sections(docs: DataFrame, marks: DataFrame, least_front: int = 400) -> DataFrame:
    """[W15] doc, start, title, body: slices from mark to mark, covering the text; docs: doc, text; marks: doc, start, title.

    Fewer than two marks give none. What precedes the first mark is a section (title null) if it has ``least_front`` characters without the white space around it.
    """
    by = Window.partitionBy("doc")
    told = marks.withColumn("_to", F.lead("start").over(by.orderBy("start"))).withColumn("_k", F.count("*").over(by)).withColumn("_first", F.min("start").over(by)).where("_k > 1")
    spans = F.array(F.struct("start", "_to", "title"))
    front = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("start").alias("_to"), F.lit(None).cast("string").alias("title")))
    told = told.select("doc", F.explode(F.when((F.col("start") == F.col("_first")) & (F.col("start") > 0), F.concat(front, spans)).otherwise(spans)).alias("s")).select("doc", "s.*")
    size = F.coalesce("_to", F.char_length("text").cast("long")) - F.col("start")
    cut = told.join(docs.select("doc", "text"), "doc").select("doc", "start", "title", F.substring("text", (F.col("start") + 1).cast("int"), size.cast("int")).alias("body"))
    return cut.where(F.col("title").isNotNull() | (F.char_length(F.regexp_replace("body", AROUND, "")) >= least_front))


#: White space at both ends, of any kind.
AROUND = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
LINE_ENDS = "(?<=\\n)|(?<=\\r)(?!\\n)|(?<=[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"
BOUNDARY = r"(?U)^\s*(?:\[\[page \d+\]\]\s*)?$"


def chunk_starts(text: Column, limit: int = 12000) -> Column:
    """[W16] array<int>: where chunks begin. One ends before the first page marker or blank line that finds it ``limit`` characters long."""
    lines = F.transform(F.filter(F.split(text, LINE_ENDS), lambda x: x != ""), lambda x: F.struct(F.char_length(x).alias("n"), x.rlike(BOUNDARY).alias("b")))
    zero = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        ends = x["b"] & (acc["at"] - F.element_at(acc["starts"], -1) >= limit)
        return F.struct((acc["at"] + x["n"]).alias("at"), F.when(ends, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))

    return F.aggregate(lines, zero, step, lambda acc: acc["starts"])


def thread_context(lines: DataFrame, most: int = 7000) -> DataFrame:
    """[T07] thread, context: a thread's lines in order, cut at ``most`` characters; lines: thread, seq, line.

    Lines that begin beyond the cut are left out before lines meet, so no thread is gathered whole; of lines with one seq the smaller comes first. The
    line that follows ``most`` characters is kept, as it is what tells that the thread is cut.
    """
    size = F.char_length("line") + 1
    at = F.coalesce(F.sum(size).over(Window.partitionBy("thread").orderBy("seq", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = lines.where("line is not null").withColumn("_at", at).where(F.col("_at") <= most + 1)
    whole = near.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("_at", "seq", "line"))).alias("l")).select("thread", F.array_join("l.line", "\n").alias("t"))
    mark = "\n[history truncated]"
    return whole.select("thread", F.when(F.char_length("t") > most, F.concat(F.substring("t", 1, most - len(mark)), F.lit(mark))).otherwise(F.col("t")).alias("context"))
