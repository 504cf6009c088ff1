"""A table of questions answered in tiers: each tier gets, as a table, what those before it left open.

"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .lookup import is_action, lasting
from .similar import mentions

# Ranges of sprints, one sprint, scopes that facts are not kept by, and questions that ask for a judgement.
SPRINTS = r"sprint\s*(\d)\s*(?:[-–—]|den|toi|->)\s*(?:sprint\s*)?(\d)"
SPRINT = r"sprint\s*(\d)"
OTHER_SCOPES = {"tháng": r"th[aá]ng\s*(\d{1,2})", "quý": r"(qu[yý]\s*[1-4])", "năm": r"(nam\s*20\d\d)", "tuần": r"(tu[aà]n\s*\d+)"}
JUDGEMENT = "vi sao|tai sao|ly do|nguyen nhan|nhu the nao|ra sao|danh gia|nhan xet|giai thich|co nen"
# What a question calls a column, and the word of the column's label.
COLUMN_WORDS = {
    "ngay": "date", "bat dau": "start", "khoi dong": "start", "ket thuc": "end",
    "han": "deadline", "trang thai": "status", "tinh trang": "status",
    "ghi chu": "note", "luu y": "note", "nguoi": "assignee", "phu trach": "assignee",
    "tien do": "progress", "uoc luong": "estimate", "cong viec": "task",
    "thuc te": "actual", "con lai": "remaining", "thang": "month", "tuan": "week",
    "note": "note", "status": "status", "date": "date", "assignee": "assignee",
}
# Columns with closed values, how a question names the column, and the values in the order of trial.
CLOSED = (("status", "trang thai|status", ("Open", "In progress", "Done", "Pending", "Cancel")), ("priority", "uu tien|priority", ("Highest", "High", "Medium", "Low")))
LEFT_OVER = "con lai|remaining"

Tier = Callable[[DataFrame], DataFrame]


def _strings(*xs: str) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


def scope(plain: Column) -> Column:
    """struct<sprints array<int>, others array<string>>: all sprints that are named, ranges in full whichever end comes first, and scopes of other kinds."""
    ends = F.arrays_zip(F.regexp_extract_all(plain, F.lit(SPRINTS), F.lit(1)).alias("a"), F.regexp_extract_all(plain, F.lit(SPRINTS), F.lit(2)).alias("b"))
    whole = F.flatten(F.transform(ends, lambda e: F.sequence(F.least(e["a"].cast("int"), e["b"].cast("int")), F.greatest(e["a"].cast("int"), e["b"].cast("int")))))
    single = F.transform(F.regexp_extract_all(F.regexp_replace(plain, SPRINTS, " "), F.lit(SPRINT), F.lit(1)), lambda n: n.cast("int"))
    others = F.array_compact(F.array(*[F.when(plain.rlike(p), name) for name, p in OTHER_SCOPES.items()]))
    return F.struct(F.array_sort(F.array_union(whole, single)).alias("sprints"), others.alias("others"))


def asked_columns(plain: Column) -> Column:
    """[X15] array<string> of the words of labels that the question asks for, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(said)), label) for said, label in COLUMN_WORDS.items()]))))


def row_terms(plain: Column) -> Column:
    """The question's terms without the words that name columns, sorted; repeated ones stay."""
    used = F.flatten(F.array(*[F.when(F.contains(plain, F.lit(said)), _strings(*said.split())).otherwise(_strings()) for said in COLUMN_WORDS]))
    return F.transform(F.array_sort(F.filter(F.transform(text.terms(plain), lambda t: F.struct(t.alias("t"), F.array_contains(used, t).alias("u"))), lambda x: ~x["u"])), lambda x: x["t"])


def wanted(plain: Column) -> Column:
    """struct<column,value> that rows must have: a closed value whose column is named, first found first, else what is left over (value null: not 0); null if neither."""
    tries = [F.when(plain.rlike(said) & F.contains(plain, F.lit(v.lower())), F.struct(F.lit(c).alias("column"), F.lit(v).alias("value"))) for c, said, values in CLOSED for v in values]
    return F.coalesce(*tries, F.when(plain.rlike(LEFT_OVER), F.struct(F.lit("remaining").alias("column"), F.lit(None).cast("string").alias("value"))))


def has_wanted(want: Column, cells: Column) -> Column:
    """Whether a row's cells (array of struct<label,value>) have what is wanted; true if nothing is."""
    same = lambda x, y: text.fold(x) == text.fold(y)
    closed = F.exists(cells, lambda c: same(c["label"], want["column"]) & same(c["value"], want["value"]))
    left = F.exists(cells, lambda c: F.startswith(F.lower(c["label"]), F.lit("remaining")) & ~F.coalesce(c["value"], F.lit("")).isin("", "0", "0.0"))
    return want.isNull() | F.when(want["value"].isNull(), left).otherwise(closed)


def tiered(questions: DataFrame, key: str, question: str, tiers: Sequence[Tier]) -> DataFrame:
    """[R07] key, tier, rule, outcome (found, no, missing), answer, hits: one row for each question.

    Every tier is a function of the open questions (key, plain, asked: as said) that returns key, rule, outcome, answer, hits of those it settles, each once. They are
    taken away by an anti-join, so that no tier works on what another has settled; what stays open is missing, by the tier after the last. Keys
    must be unique; a null text is a question without words.
    """
    asked = F.coalesce(question, F.lit(""))
    left = lasting(questions.select(key, text.fold(asked).alias("plain"), asked.alias("asked")))
    settled = None
    for i, tier in enumerate(tiers):
        got = lasting(tier(left).select(key, F.lit(i + 1).alias("tier"), "rule", "outcome", F.col("answer").cast("string").alias("answer"), F.col("hits").cast("long").alias("hits")))
        settled = got if settled is None else settled.union(got)
        left = left.join(got, key, "left_anti")
    none = left.select(key, F.lit(len(tiers) + 1).alias("tier"), F.lit("nothing").alias("rule"), F.lit("missing").alias("outcome"), F.lit(None).cast("string").alias("answer"), F.lit(0).cast("long").alias("hits"))
    return none if settled is None else settled.union(none)


def guard_tier(key: str, whole: Sequence[int] = (1,)) -> Tier:
    """[R08 F06] Refuses requests for changes, sets of several sprints and scopes that facts are not kept by; ``whole``: sprints that mean all of the time. Judgements pass on."""

    def run(left: DataFrame) -> DataFrame:
        s = scope(F.col("plain"))
        several = (F.size(s["sprints"]) > 1) & (s["sprints"] != F.array(*map(F.lit, whole)).cast("array<int>"))
        judged = F.col("plain").rlike(JUDGEMENT)
        rule = F.when(is_action(F.col("plain")), "action").when(judged, None).when(several, "several_sprints").when(F.size(s["others"]) > 0, "other_scope")
        return left.select(key, rule.alias("rule")).where("rule is not null").select(key, "rule", F.lit("missing").alias("outcome"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("hits"))

    return run


def fact_tier(key: str, facts: DataFrame, people: DataFrame, name: str, measures: Mapping[str, str], signed: Sequence[str] = ()) -> Tier:
    """[R08] A measure of the one person that the question names, over all or of its one sprint.

    facts: person, sprint int (null: over all), measure, value; one row each. measures: how questions name them, first found first. Where
    a person has no such fact, the answer is no if the measure is ``signed`` (known to be complete), and else the question stays open.
    """

    def run(left: DataFrame) -> DataFrame:
        plain, none = F.col("plain"), F.lit(None).cast("string")
        measure = F.coalesce(*[F.when(plain.rlike(p), m) for m, p in measures.items()], none)
        sprints = scope(plain)["sprints"]
        q = left.where(~plain.rlike(JUDGEMENT)).withColumn("measure", measure).withColumn("sprint", F.get(sprints, F.lit(0))).where(F.col("measure").isNotNull() & (F.size(sprints) <= 1))
        named = mentions(q, people, key, plain, text.fold(F.col(name)), name).groupBy(key).agg(F.count("*").alias("n"), F.min(name).alias("person")).where("n = 1")
        f = facts.select(F.col("person").alias("_person"), F.col("sprint").alias("_sprint"), F.col("measure").alias("_measure"), F.col("value").cast("string").alias("answer"))
        met = q.join(named, key).join(f, (F.col("person") == F.col("_person")) & F.col("sprint").eqNullSafe(F.col("_sprint")) & (F.col("measure") == F.col("_measure")), "left")
        outcome = F.when(F.col("answer").isNotNull(), "found").when(F.col("measure").isin(*signed), "no")
        return met.withColumn("outcome", outcome).where("outcome is not null").select(key, F.lit("fact").alias("rule"), "outcome", "answer", F.when(F.col("outcome") == "found", 1).otherwise(0).alias("hits"))

    return run


def cell_tier(key: str, rows: DataFrame, row: str, blob: Column, labels: Column | None = None, least: float = 0.6) -> Tier:
    """[R10] The rows that hold most of the question's terms by rarity, if that is at least ``least``: answer is the smallest of them, hits their number.

    labels: an array of the row's folded labels, one of which must hold a word of a column that the question names, if it names any. Questions with
    the same terms and columns are one search. Texts are read by automata of all terms, and only (row, term) hits are joined with the searches.
    """

    def run(left: DataFrame) -> DataFrame:
        asked = left.select(key, row_terms(F.col("plain")).alias("terms"), asked_columns(F.col("plain")).alias("columns")).where("size(terms) > 1")
        if labels is None:
            asked = asked.withColumn("columns", _strings())
        asked = lasting(asked)
        searches = asked.select("terms", "columns").distinct()
        words = searches.select("terms", "columns", F.explode("terms").alias("term")).groupBy("terms", "columns", "term").agg(F.count("*").alias("times"))
        table = lasting(rows.select(F.col(row).alias("row"), blob.alias("blob"), (labels if labels is not None else _strings()).alias("labels")))
        hits = mentions(table, words.select("term").distinct(), "row", F.col("blob"), F.col("term"), "term", whole=0)
        # Rows that hold the same terms, under the same labels, have the same share of every search: they go through it as one, named by the smallest.
        kinds = hits.groupBy("row").agg(F.array_sort(F.collect_set("term")).alias("held"))
        kinds = kinds.withColumn("labels", _strings()) if labels is None else kinds.join(table.select("row", "labels"), "row")
        kinds = lasting(kinds.groupBy("held", "labels").agg(F.min("row").alias("row"), F.count("*").alias("n")))
        holds = kinds.select("row", "n", F.explode("held").alias("term"))
        total = table.agg(F.count("*").alias("n"))
        weights = words.select("term").distinct().join(holds.groupBy("term").agg(F.sum("n").alias("df")), "term", "left").crossJoin(F.broadcast(total))  # one row
        weights = weights.select("term", F.log((F.lit(1.0) + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))
        words = lasting(words.join(weights, "term").withColumn("weight", F.col("times") * F.col("idf")))
        full = words.groupBy("terms", "columns").agg(F.sum("weight").alias("full"))
        scored = words.join(holds, "term").groupBy("terms", "columns", "row").agg(F.sum("weight").alias("part"), F.first("n").alias("n")).join(full, ["terms", "columns"])
        scored = scored.select("terms", "columns", "row", "n", F.round(F.col("part") / F.when(F.col("full") == 0, 1.0).otherwise(F.col("full")), 9).alias("share"))
        if labels is not None:
            named = scored.where("size(columns) > 0").join(kinds.select("row", "labels"), "row").where(F.exists("columns", lambda c: F.exists("labels", lambda x: F.contains(x, c)))).select("terms", "columns", "row", "n", "share")
            scored = scored.where("size(columns) = 0").union(named)
        # The best share of a search, then its ties: two aggregations, so that no search's rows are gathered.
        ties = scored.groupBy("terms", "columns", "share").agg(F.sum("n").alias("hits"), F.min("row").alias("answer"))
        best = ties.groupBy("terms", "columns").agg(F.max(F.struct("share", "hits", "answer")).alias("b")).where(F.col("b.share") >= least)
        return asked.join(best, ["terms", "columns"]).select(key, F.lit("cells").alias("rule"), F.lit("found").alias("outcome"), F.col("b.answer").alias("answer"), F.col("b.hits").alias("hits"))

    return run
