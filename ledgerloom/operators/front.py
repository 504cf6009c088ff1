"""What stands before the answers: tasks by all that a question names, pages of a catalogue, cells by asked fields, aliases and follow-ups.

"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .answers import Tier
from .lookup import lasting
from .similar import mentions

# What a question about tasks asks for, words that name no task, and how its answers read.
PEOPLE, ROLES, TASKS, LISTS = r"\b(ai|nguoi|assignee|phu trach)\b", r"\b(role|vai tro)\b", r"\b(task|tasks|cong viec|dau viec)\b", r"\b(nhung|nao|liet ke|danh sach|cac)\b"
NOT_NAMES = ("task", "tasks", "cong", "viec", "nhung", "nao")
PEOPLE_ARE, ROLES_ARE, NOBODY = "Những người liên quan: ", "Các vai trò liên quan: ", "chưa gán"
# Fields that a question asks for, how it names them, and the labels of their columns.
FIELDS = (
    ("start", r"actual\s+start|ngay\s+bat dau\s+thuc te|plan\s+start|ke hoach.*bat dau|bat dau|khoi dong|start date", r"^start date$|plan start date|actual start date"),
    ("end", r"actual\s+end|ngay\s+ket thuc\s+thuc te|plan\s+end|ke hoach.*ket thuc|ket thuc|deadline|end date|han", r"^end date$|plan end date|actual end date"),
    ("status", r"trang thai|tinh trang|\bstatus\b", r"^status$"),
    ("pic", r"\bpic\b|phu trach|nguoi phu trach|ai phu trach", r"^pic$|^assignee$|related assignee"),
    ("priority", r"uu tien|\bpriority\b", r"^priority$"),
    ("task", r"\btask\b|cong viec|dau viec", r"^task$|^task name$"),
    ("remaining", "con lai|remaining", "remaining"),
    ("progress", r"tien do|\bprogress\b", "^progress$"),
    ("actual_effort", "actual effort|thuc te|da bo ra|da dung", "actual effort|actual_h|thuc te"),
    ("estimate", "uoc luong|estimate|re-estimated|re-est", "estimate|uoc luong|re-estimated effort"),
    ("scope", "scope|pham vi|milestone", "^scope$|project scope|category milestone"),
    ("person", "ten nhan su|nhung nguoi|nhan su|nguoi nao", "ten nhan su|^assignee$|^nguoi$"),
    ("role", r"vai tro|\brole\b", "^role$|^vai tro$"),
    ("level", "xep hang|senior|middle|junior|level", "xep hang|^level$"),
)
# Questions that want a list, the alias of the first sprint, what adds the schedule, and what a follow-up may not say besides a name.
WANTS_LIST = r"liet ke|danh sach|nhung|cac\s+|co .* nao|task nao|remaining|nhan su|scope nao|phan bo|the nao"
FIRST_SPRINT, SCHEDULE = r"(?iU)sprint\s+đầu\s+tiên|sprint\s+đầu\b", "Master schedule"
OWN_MATTER = r"\d|task|gio|effort|cong|vai tro|role|sprint|thang|bao nhieu"


# --- fields, aliases, follow-ups ------------------------------------------------


def wants_list(plain: Column) -> Column:
    """The question wants a list."""
    return plain.rlike(WANTS_LIST)


def asked_fields(plain: Column) -> Column:
    """[P04] array<string> of the fields that a folded question asks for, in the order of FIELDS."""
    return F.array_compact(F.array(*[F.when(plain.rlike(said), name) for name, said, _ in FIELDS]))


def asked_cells(cells: Column, plain: Column) -> Column:
    """[P04] Of a row's filled cells (array of struct<label,value>) those under a label of an asked field; all filled ones if there is none.

    The question is searched once a field and a label folded once a cell; only asked fields' labels are looked for.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    asks = lambda p: F.array(*[p.rlike(said) for _, said, _ in FIELDS])
    under = lambda label, asked: F.coalesce(reduce(or_, [F.get(asked, F.lit(i)) & label.rlike(on) for i, (_, _, on) in enumerate(FIELDS)]), F.lit(False))
    own = lambda filled, asked: F.filter(filled, lambda c: once(F.lower(text.fold(c["label"])), lambda label: under(label, asked)))
    pick = lambda filled, asked: once(own(filled, asked), lambda o: F.when(F.size(o) > 0, o).otherwise(filled))
    return once(F.filter(cells, lambda c: c["value"] != ""), lambda filled: once(once(plain, asks), lambda asked: pick(filled, asked)))


def with_aliases(question: Column) -> Column:
    """[X16] The question with ``Sprint 1`` for the first sprint, and the schedule's name before its closing marks where a start is asked for."""
    first = question.rlike(FIRST_SPRINT)
    said = F.regexp_replace(question, FIRST_SPRINT, "Sprint 1")
    plain = text.fold(said)
    more = F.array_join(F.array_compact(F.array(
        F.when(first & plain.rlike("bat dau|khoi dong|ngay nao|khi nao"), SCHEDULE),
        F.when(plain.rlike(r"authentication\s+bat dau|authentication.*\b(start|begin)"), SCHEDULE),
    )), " ")
    closing = F.regexp_extract(said, r"([?.!]+)\s*$", 1)
    bare = F.when(closing != "", F.regexp_replace(F.regexp_replace(said, r"[?.!]+\s*$", ""), r"(?U)\s+$", "")).otherwise(said)
    return F.when(more == "", said).otherwise(F.concat(bare, F.lit(" "), more, closing))


def name_pattern(label: Column) -> Column:
    """A pattern that finds a person's label whatever its brackets and blanks; null for a label without letters and digits."""
    words = F.regexp_extract_all(label, F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?iu)\[?\s*"), F.array_join(words, r"\s*\]?\s*")))


def follow_ups(questions: DataFrame, key: str, session: str, order: Sequence[str], people: DataFrame, name: str) -> DataFrame:
    """[X16] key, rewritten: a question that is no more than one person's name takes the question before it, with that name for the one it named.

    questions: key, session, order, question; keys are unique. The question before is the last one that named one person and had matter of its own, or
    the first of its session that named one, so that a row of follow-ups all change the same one. Questions that follow none, null ones included, are not
    rewritten (null).
    """
    q = questions.select(key, session, *order, F.coalesce("question", F.lit("")).alias("question"))
    found = mentions(q, people, key, text.fold(F.col("question")), text.fold(F.col(name)), name)
    one = found.groupBy(key).agg(F.count("*").alias("n"), F.min(name).alias("who")).where("n = 1").select(key, "who")
    j = q.join(one, key, "left").withColumn("pattern", name_pattern(F.col("who")))
    rest = text.fold(F.regexp_replace(F.col("question"), F.col("pattern"), F.lit("")))
    before = Window.partitionBy(session).orderBy(*order, key).rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("bare", F.coalesce(~rest.rlike(OWN_MATTER), F.lit(False))).withColumn("named", F.count("who").over(before))
    base = F.when(F.col("who").isNotNull() & (~F.col("bare") | (F.col("named") == 0)), F.struct("question", "pattern"))
    j = j.withColumn("base", F.last(base, ignorenulls=True).over(before))
    spoken = F.regexp_replace(F.col("base.question"), F.col("base.pattern"), F.regexp_replace("who", r"([\\$])", r"\\$1"))
    met = F.regexp_like(F.col("base.question"), F.col("base.pattern"))
    return j.select(key, F.when(F.col("bare") & met, spoken).alias("rewritten"))


# --- tasks by all that a question names ------------------------------------------


def task_hits(searches: DataFrame, tasks: DataFrame, dims: Sequence[str] = ("role", "category", "status", "priority"), limit: int = 60) -> DataFrame:
    """[G12] search, task, place, name, assignee, role: the first ``limit`` tasks, by place, that fit all that a search names.

    searches: search (a key), said (words in ASCII), ids (array of ids in ASCII words). tasks: task (a key), place, name, assignee, the ``dims``.
    Every value of a dimension that is named must be the task's, and its person and id one of those named; only where none is named do tasks count whose
    names hold two of the search's words (one, if it has but one). A task is dealt to the sets of its values that are asked for as a whole, at most
    2 to the number of dimensions, so named sets meet their tasks by equality: no search meets tasks that it does not get, and of a set's tasks
    only the first are moved.
    """
    rels = (*dims, "assignee")
    tag = {r: F.concat(F.lit(f"{r}:"), F.col(r)) for r in rels}
    t = lasting(tasks.select("task", "place", "name", "assignee", *[d for d in dims], F.array_compact(F.array(*[tag[d] for d in dims])).alias("_tags")))
    out = ["task", "place", "name", "assignee", "role"]

    values = reduce(DataFrame.union, [t.where(F.col(r).isNotNull()).select(tag[r].alias("tag"), F.lit(r).alias("rel"), F.col(r).alias("value")).distinct() for r in rels])
    values = lasting(values.withColumn("word", text.ascii_words(F.col("value"))))
    of = lambda kind, whole, to: mentions(searches, values.where(kind), "search", F.col("said"), F.col("word"), "tag", whole=whole).groupBy("search").agg(F.array_sort(F.collect_set("tag")).alias(to))
    none = F.array().cast("array<string>")
    named = searches.join(of("rel <> 'assignee'", 2, "_dims"), "search", "left").join(of("rel = 'assignee'", 0, "_people"), "search", "left")
    named = lasting(named.select("search", "said", "ids", F.coalesce("_dims", none).alias("_dims"), F.coalesce("_people", none).alias("_people")))

    # By id: few tasks, held against all else that is named.
    i = named.where("size(ids) > 0").withColumn("_id", F.explode("ids")).join(t.withColumn("_id", text.ascii_words(F.col("task"))), "_id")
    by_id = i.where((F.size(F.array_except("_dims", "_tags")) == 0) & ((F.size("_people") == 0) | F.array_contains("_people", tag["assignee"]))).select("search", *out)

    # By the set of named values, with each of the named people in turn.
    p = named.where("size(ids) = 0 and size(_dims) + size(_people) > 0").select("search", "_dims", F.explode_outer("_people").alias("_person"))
    p = p.select("search", F.array_sort(F.array_compact(F.concat("_dims", F.array("_person")))).alias("_set"))
    p = p.withColumn("_rels", F.transform("_set", lambda x: F.substring_index(x, ":", 1))).where("size(array_distinct(_rels)) = size(_set)")
    p = lasting(p)
    shapes = [r[0] for r in p.select("_rels").distinct().collect()]  # no more than sets of dimensions
    hits = by_id
    if shapes:
        # Each shape by itself: where few sets are asked for, tasks are cut to the first of each before they are moved.
        for shape in shapes:
            whole = reduce(and_, [tag[r].isNotNull() for r in shape])
            own = p.where(F.col("_rels") == F.array(*map(F.lit, shape)))
            dealt = t.where(whole).select(*out, F.array_sort(F.array(*[tag[r] for r in shape])).alias("_set")).join(own.select("_set").distinct(), "_set", "left_semi")
            hits = hits.union(own.join(_first(dealt, ["_set"], limit), "_set").select("search", *out))

    # By words of names, where nothing else is named; searches of the same words are one.
    terms = F.filter(F.regexp_extract_all("said", F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*NOT_NAMES))
    u = lasting(named.where("size(ids) + size(_dims) + size(_people) = 0").select("search", F.array_sort(terms).alias("_terms")).where("size(_terms) > 0"))
    words = u.select("_terms").distinct().select("_terms", F.explode("_terms").alias("term")).groupBy("_terms", "term").agg(F.count("*").alias("times"))
    # Tasks of the same name are held by the same searches, which get no more than the first of each name.
    t = t.withColumn("_name", text.ascii_words(F.col("name")))
    held = mentions(t.select("_name").distinct(), words.select("term").distinct(), "_name", F.col("_name"), F.col("term"), "term", whole=0)
    enough = lasting(words.join(held, "term").groupBy("_terms", "_name").agg(F.sum("times").alias("n")).where(F.col("n") >= F.least(F.lit(2), F.size("_terms"))))
    first = _first(t.join(enough.select("_name").distinct(), "_name", "left_semi").select("_name", *out), ["_name"], limit)
    by_name = _first(enough.join(first, "_name"), ["_terms"], limit)
    return _first(hits.union(u.join(by_name, "_terms").select("search", *out)), ["search"], limit)


def _first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows by place and task of each group; Spark cuts them before it moves them."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("place", "task"))).where(F.col("_n") <= n).drop("_n")


def graph_tier(key: str, tasks: DataFrame, dims: Sequence[str] = ("role", "category", "status", "priority"), limit: int = 60) -> Tier:
    """[G12 R07] Lists of people, of roles, or of tasks by person for questions that ask for them; the tasks are those of ``task_hits``.

    tasks: as there, without those that the asker may not read, assignee null where that may not be seen. An empty list leaves the question open. đ is
    dropped from questions and names alike, as by ``ascii_words``.
    """

    def run(left: DataFrame) -> DataFrame:
        said = text.ascii_words(F.col("asked"))
        ids = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("asked", F.lit(r"[A-Za-z]+-\d+"), F.lit(0)), text.ascii_words)))
        kind = F.when(said.rlike(PEOPLE), "people").when(said.rlike(ROLES), "roles").when(said.rlike(TASKS), "tasks")
        asked = left.select(key, said.alias("said"), ids.alias("ids"), kind.alias("kind")).where(F.col("kind").isNotNull() & F.col("said").rlike(LISTS))
        asked = lasting(asked.withColumn("search", F.concat_ws("\n", "said", F.array_join("ids", " "))))
        hits = task_hits(asked.select("search", "said", "ids").distinct(), tasks, dims, limit)
        who = F.coalesce(F.nullif("assignee", F.lit("")), F.lit(NOBODY))
        line = F.concat("task", F.lit(" — "), F.coalesce("name", F.lit("")))
        g = hits.groupBy("search").agg(
            F.count("*").alias("hits"),
            F.array_sort(F.collect_set(F.nullif("assignee", F.lit("")))).alias("people"),
            F.array_sort(F.collect_set(F.nullif("role", F.lit("")))).alias("roles"),
            F.array_sort(F.collect_list(F.struct("place", "task", who.alias("who"), line.alias("line")))).alias("tasks"),  # at most ``limit``
        )
        each = F.transform(F.array_sort(F.array_distinct(F.transform("tasks", lambda x: x["who"]))), lambda w: F.concat(F.lit("**"), w, F.lit("**: "), F.array_join(F.transform(F.filter("tasks", lambda x: x["who"] == w), lambda x: x["line"]), "; ")))
        listed = lambda c, mark, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x, F.lit(mark))), ", "), F.lit(".")))
        answer = F.when(F.col("kind") == "people", listed("people", "**", PEOPLE_ARE)).when(F.col("kind") == "roles", listed("roles", "`", ROLES_ARE)).otherwise(F.array_join(each, "\n"))
        got = asked.join(g, "search").select(key, F.concat(F.lit("graph_"), "kind").alias("rule"), F.lit("found").alias("outcome"), answer.alias("answer"), "hits")
        return got.where("answer is not null")

    return run


# --- catalogue --------------------------------------------------------------------


def shortlist(questions: DataFrame, key: str, question: Column, lines: DataFrame, pins: DataFrame | None = None, limit: int = 64) -> DataFrame:
    """[T03] key, at (from 1), path, hits (null: pinned): the pages that a catalogue's lines name for each question, each once, at most ``limit``.

    lines: position, line, path, a row for each page that a line names. pins: key, at, path: pages that come first, in that order. The others come by
    the number of the question's terms in the line (repeated ones count), then by position, then by path from the end; lines without any term come
    last. Questions with the same terms are one search; only (term, line) hits are joined, and of lines without a hit the first ``limit`` are enough,
    as no more places can be open. Null questions have no terms.
    """
    q = lasting(questions.select(key, F.array_sort(text.terms(F.coalesce(question, F.lit("")))).alias("terms")))
    searches = q.select("terms").distinct()
    words = searches.select("terms", F.explode("terms").alias("term")).groupBy("terms", "term").agg(F.count("*").alias("times"))
    table = lasting(lines.select("position", text.fold(F.col("line")).alias("line"), "path"))
    held = mentions(table.dropDuplicates(["position"]), words.select("term").distinct(), "position", F.col("line"), F.col("term"), "term", whole=0)
    scored = words.join(held, "term").groupBy("terms", "position").agg(F.sum("times").alias("hits"))
    best = scored.join(table.select("position", "path"), "position").groupBy("terms", "path").agg(F.max(F.struct("hits", (-F.col("position")).alias("_p"))).alias("b"))
    best = lasting(_listed(best.select("terms", "path", "b.hits", (-F.col("b._p")).alias("position")), limit))
    filler = table.groupBy("path").agg(F.min("position").alias("position")).orderBy("position", F.desc("path")).limit(limit)
    short = searches.join(best.groupBy("terms").agg(F.count("*").alias("n")).where(F.col("n") >= limit), "terms", "left_anti")
    fill = short.crossJoin(F.broadcast(filler)).join(best, ["terms", "path"], "left_anti")  # ``limit`` rows
    both = _listed(best.union(fill.select("terms", "path", F.lit(0).cast("long").alias("hits"), "position")), limit)
    own = q.join(both, "terms").select(key, F.lit(None).cast("long").alias("_pin"), "path", "hits", "position")
    if pins is not None:
        first = pins.groupBy(key, "path").agg(F.min("at").cast("long").alias("_pin")).join(q, key, "left_semi")
        own = first.select(key, "_pin", "path", F.lit(None).cast("long").alias("hits"), F.lit(None).cast("long").alias("position")).union(own.join(first, [key, "path"], "left_anti").select(key, "_pin", "path", "hits", "position"))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("_pin"), F.desc("hits"), "position", F.desc("path"))
    return own.withColumn("at", F.row_number().over(w)).where(F.col("at") <= limit).select(key, "at", "path", "hits")


def _listed(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("terms").orderBy(F.desc("hits"), "position", F.desc("path"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("terms", "path", "hits", "position")
