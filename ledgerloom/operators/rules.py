"""Risk rules over tasks, people's calendars and overtime, as functions over DataFrames.

estimate, actual, remaining, sprint. Calendars: person, day, hours, where no hours (null) means not planned and 0 means leave.
Items: rule, layer, ref, score, priority.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import core, gates
from .lookup import lasting


def normalised(rows: DataFrame) -> DataFrame:
    """[P01] Raw task rows with title, status, estimate and ref: sub-task or task, Open if blank, re-estimate or estimate, id or place."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return rows.select(
        "*",
        F.coalesce(full("sub_task"), full("task")).alias("title"),
        F.coalesce(full("raw_status"), F.lit("Open")).alias("status"),
        F.coalesce("re_estimate", "first_estimate").alias("estimate"),
        F.coalesce(full("id"), F.concat("tab", F.lit(", row "), F.col("row").cast("string"))).alias("ref"),
    )


def item(rows: DataFrame, rule: str, layer: str, ref: Column | str, probability: int, impact: Column | int) -> DataFrame:
    """[P05 P06] Items of a rule: score is probability times impact, priority its band."""
    score = (F.lit(probability) * (F.lit(impact) if isinstance(impact, int) else impact)).cast("int")
    ref = F.col(ref) if isinstance(ref, str) else ref
    return rows.select(F.lit(rule).alias("rule"), F.lit(layer).alias("layer"), ref.alias("ref"), score.alias("score")).withColumn("priority", core.priority(F.col("score")))


def _steps(value: Column, three: float, two: float) -> Column:
    return F.when(value >= three, 3).when(value >= two, 2).otherwise(1)


def bugs(tasks: DataFrame, status: str = "verify bug") -> DataFrame:
    """[A06] category, bugs, refs (in order of ref): tasks that wait for a bug's verification."""
    t = tasks.where(F.lower(F.trim("status")) == status)
    return t.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("bugs"), F.array_join(F.array_sort(F.collect_list("ref")), ", ").alias("refs"))


def category_lag(tasks: DataFrame, today: Column, margin: float = 15.0) -> DataFrame:
    """[A07] category, elapsed_pct, done_pct where a category's share of time passed is ahead of its share done by the margin."""
    c = tasks.where("category is not null").groupBy("category").agg(F.min("plan_start").alias("a"), F.max("plan_end").alias("b"), F.count("*").alias("n"), F.count_if("is_done").alias("d"))
    days = F.datediff("b", "a")
    passed = F.greatest(F.lit(0), F.least(F.datediff(today, "a"), days))
    c = c.where(days > 0).select("category", (passed / days * 100).alias("elapsed_pct"), (F.col("d") / F.col("n") * 100).alias("done_pct"))
    return c.where(F.col("elapsed_pct") - F.col("done_pct") >= margin)


def last_two(tasks: DataFrame, margin: float = 15.0) -> DataFrame:
    """[A05 S1] sprint, before, done_pct, before_pct if the last sprint (by its number) has a share done below the one before by the margin."""
    number = F.regexp_extract("sprint", r"(\d+)", 1)
    s = tasks.where(number != "").groupBy("sprint").agg(F.count_if("is_done").alias("d"), F.count("*").alias("n"), F.first(number.cast("long")).alias("k"))
    two = s.orderBy(F.desc("k"), F.desc("sprint")).limit(2).withColumn("pct", F.col("d") / F.col("n") * 100)
    w = Window.orderBy("k", "sprint")  # two rows
    two = two.select("sprint", F.lag("sprint").over(w).alias("before"), F.col("pct").alias("done_pct"), F.lag("pct").over(w).alias("before_pct"))
    return two.where(F.col("before_pct") - F.col("done_pct") >= margin)


def regular_start(today: Column, hour: int, cutoff: int = 18) -> Column:
    """[A09] The first day whose regular hours still count: tomorrow once the cutoff hour has come."""
    return today if hour < cutoff else F.date_add(today, 1)


def capacity(calendar: DataFrame, overtime: DataFrame, today: Column, end: Column, hour: int) -> DataFrame:
    """[A09] person, capacity: regular hours from regular_start on and overtime from today on, both up to the sprint's end."""
    sums = lambda df, start: df.where(F.col("day").between(start, end)).groupBy("person").agg(F.sum("hours").alias("h"))
    both = sums(calendar, regular_start(today, hour)).union(sums(overtime, today)).groupBy("person").agg(F.sum("h").alias("h"))
    return calendar.select("person").distinct().join(both, "person", "left").select("person", F.coalesce("h", F.lit(0.0)).alias("capacity"))


def backlog(tasks: DataFrame, sprint: str) -> DataFrame:
    """[A10] person, backlog: hours that remain of a person's open tasks of the sprint."""
    t = tasks.where((F.col("sprint") == sprint) & ~F.col("is_done") & F.col("assignee").isNotNull())
    return t.groupBy(F.col("assignee").alias("person")).agg(F.sum("remaining").alias("backlog"))


def load(tasks: DataFrame, calendar: DataFrame, overtime: DataFrame, today: Column, end: Column, sprint: str, hour: int) -> DataFrame:
    """[A11] person, capacity, backlog of each person of the plan."""
    return capacity(calendar, overtime, today, end, hour).join(backlog(tasks, sprint), "person", "left").select("person", "capacity", F.coalesce("backlog", F.lit(0.0)).alias("backlog"))


def gap_days(calendar: DataFrame, start: Column, end: Column) -> DataFrame:
    """person, gaps: the days in order on which nothing is planned, null and 0 alike."""
    g = calendar.where(F.col("day").between(start, end) & (F.coalesce("hours", F.lit(0.0)) == 0))
    return g.groupBy("person").agg(F.array_join(F.array_sort(F.collect_list(F.date_format("day", "yyyy-MM-dd"))), ",").alias("gaps"))


def deficits(loads: DataFrame, gaps: DataFrame) -> DataFrame:
    """[A12 P4] person, deficit, impact, gaps of those whose backlog is above their capacity."""
    d = loads.withColumn("deficit", F.col("backlog") - F.col("capacity")).where("deficit > 0")
    return d.join(gaps, "person", "left").select("person", "deficit", F.when(F.col("deficit") >= 16, 3).otherwise(2).alias("impact"), F.coalesce("gaps", F.lit("")).alias("gaps"))


def health(loads: DataFrame) -> DataFrame:
    """[A13] total_backlog, total_capacity, on_track of the team: one row always."""
    t = loads.agg(F.coalesce(F.sum("backlog"), F.lit(0.0)).alias("total_backlog"), F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("total_capacity"))
    return t.withColumn("on_track", F.col("total_backlog") <= F.col("total_capacity"))


def overtime_of(entries: DataFrame, people: DataFrame) -> DataFrame:
    """[J01] person, day, hours: overtime entries (slack_id, day, hours, at) of known people; of entries for one day the last one holds."""
    e = entries.join(people.select("slack_id", "person"), "slack_id")
    return e.groupBy("person", "day").agg(F.max_by("hours", "at").alias("hours"))


def sprint_end(named: DataFrame, tasks: DataFrame, today: Column) -> DataFrame:
    """[J18] end: the sprint's own end if it has one, else the last planned end of its tasks, else today."""
    return named.agg(F.max("end").alias("a")).crossJoin(tasks.agg(F.max("plan_end").alias("b"))).select(F.coalesce("a", "b", today).alias("end"))  # one row beside one row


def status_split(tasks: DataFrame, today: Column) -> DataFrame:
    """ref, kind, idle_days: open or pending tasks, and those in progress with the days since their last change; others go."""
    s = F.lower(F.trim("status"))
    kind = F.when(s.isin("open", "pending"), "open").when(s == "in progress", "in_progress")
    t = tasks.withColumn("kind", kind).where("kind is not null")
    return t.select("ref", "kind", F.when(F.col("kind") == "in_progress", F.datediff(today, "changed")).alias("idle_days"))


def run_rules(tasks: DataFrame, calendar: DataFrame, overtime: DataFrame, today: Column, end: Column, sprint: str, hour: int) -> DataFrame:
    """[U01] Items of all rules: T1, T2, T4 of tasks, S1, S2 of sprints, M1, M2 of categories, P2, P3, P4 of people.

    Tasks are made once, not once a rule with all their joins, and so is the calendar.
    """
    tasks, calendar = lasting(tasks.select("ref", "assignee", "category", "status", "is_done", "plan_start", "plan_end", "estimate", "actual", "remaining", "sprint")), lasting(calendar.select("person", "day", "hours"))
    late = core.overdue(tasks.where("plan_end is not null"), today)
    over = core.overrun(tasks)
    idle = gates.not_started(tasks.where("plan_start is not null"), today)
    bug, lag = bugs(tasks), category_lag(tasks, today)
    loads = load(tasks, calendar, overtime, today, end, sprint, hour)
    short = deficits(loads, calendar.select("person").distinct().withColumn("gaps", F.lit("")))
    parts: Sequence[DataFrame] = (
        item(late, "T1", "Task", "ref", 3, _steps(F.col("days"), 7, 3)),
        item(over, "T2", "Task", "ref", 2, F.col("impact")),
        item(idle, "T4", "Task", "ref", 3, _steps(F.col("days"), 5, 2)),
        item(last_two(tasks), "S1", "Sprint", "sprint", 2, 3),
        item(health(loads).where("not on_track"), "S2", "Sprint", F.lit(sprint), 3, 3),
        item(bug, "M1", "Module", "category", 3, _steps(F.col("bugs"), 6, 3)),
        item(lag, "M2", "Module", "category", 2, 3),
        item(core.overload(tasks), "P2", "Person", F.concat_ws(" ", "assignee", F.date_format("day", "yyyy-MM-dd")), 3, 2),
        item(gates.unassigned(tasks, today), "P3", "Person", "ref", 3, 2),
        item(short, "P4", "Person", "person", 3, F.col("impact")),
    )
    return reduce(DataFrame.unionByName, parts)
