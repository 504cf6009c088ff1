"""Gates, deadlines and capacity, as functions over DataFrames.

"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import priority


def not_started(tasks: DataFrame, today: Column, grace: int = 0) -> DataFrame:
    """Tasks not done whose planned start is past and that have no effort (0 counts as none); probability 3, impact 3 from 5 days on, 2 from 2."""
    days = F.datediff(today, "plan_start")
    t = tasks.where(~F.col("is_done")).withColumn("days", days).where((F.col("days") > grace) & (F.coalesce("actual", F.lit(0)) == 0))
    score = F.lit(3) * F.when(F.col("days") >= 5, 3).when(F.col("days") >= 2, 2).otherwise(1)
    return t.withColumn("score", score).withColumn("priority", priority(F.col("score")))


def unassigned(tasks: DataFrame, today: Column, within: int = 2) -> DataFrame:
    """Tasks not done and without assignee that end within so many days, or should have ended."""
    t = tasks.where(~F.col("is_done") & F.col("assignee").isNull()).withColumn("days_left", F.datediff("plan_end", today))
    return t.where(F.col("days_left") <= within)


def valid_ids(rows: DataFrame, id_: str, order: str) -> DataFrame:
    """Well-formed ids, each with its first row."""
    return rows.where(F.col(id_).rlike("^[UW][A-Z0-9]{6,}$")).groupBy(id_).agg(F.min(order).alias("first"))


def deficits(people: DataFrame, capacity: DataFrame, backlog: DataFrame, key: str) -> DataFrame:
    """[A10-A12] People whose backlog (hours) is above their capacity (hours); impact 3 from 16 hours on. Who has no rows has 0 hours."""
    total = lambda df, name: df.groupBy(key).agg(F.sum("hours").alias(name))
    j = people.join(total(capacity, "capacity"), key, "left").join(total(backlog, "backlog"), key, "left").fillna(0.0, ["capacity", "backlog"])
    short = F.round(F.col("backlog") - F.col("capacity"), 4)
    return j.withColumn("deficit", short).where("deficit > 0").withColumn("impact", F.when(F.col("deficit") >= 16, 3).otherwise(2))


def without_source(cited: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """[G05] Citations of what does not exist."""
    return cited.select(key).distinct().join(sources.select(key), key, "left_anti")


def registry_faults(registry: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """[G08] Keys with a version that occurs twice, or with more than one current row."""
    each = registry.groupBy(*keys, version).agg(F.count("*").alias("k"), F.count_if("current").alias("c"))
    return each.groupBy(*keys).agg((F.max("k") > 1).alias("repeated"), (F.sum("c") > 1).alias("several_current")).where("repeated or several_current")


def containing(rows: DataFrame, spans: DataFrame, day: str) -> DataFrame:
    """[J17] How many spans (start, end) hold a row's day: one, none or several. Spans are laid out by day, so the join is on equality."""
    days = spans.select(F.explode(F.sequence("start", "end")).alias(day)).groupBy(day).agg(F.count("*").alias("_k"))
    k = F.coalesce("_k", F.lit(0))
    return rows.join(days, day, "left").withColumn("verdict", F.when(k == 1, "one").when(k == 0, "none").otherwise("several")).drop("_k")


def mentioned_ids(rows: DataFrame, key: str, text: str) -> DataFrame:
    """[G13] Edges from a row to the distinct ids, letters and a number, that its text names."""
    return rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]+-[0-9]+"), F.lit(0)))).alias("target"))


def log_status(plan: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """[J20] Who is planned: logged, or chua_log."""
    j = plan.join(log.select(key).distinct().withColumn("_l", F.lit(True)), key, "left")
    return j.withColumn("status", F.when(F.col("_l"), "logged").otherwise("chua_log")).drop("_l")


def first_and_last(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """[W06] A group's first and last value."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def too_short(rows: DataFrame, new: Column, old: Column, least: float = 0.6) -> DataFrame:
    """[G15] Rows whose new text has less than that share of the old one's characters."""
    return rows.where(F.char_length(new) < least * F.char_length(old))
