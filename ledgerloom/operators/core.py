"""Relational operators of project analytics, as functions over DataFrames.

"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lookup import ranked_value

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def zero_filled(people: DataFrame, rollup: DataFrame, key: str, zeros: dict[str, object]) -> DataFrame:
    """[J02] Every person with their rollup; who has none gets ``zeros`` and appears = false."""
    j = people.join(rollup.withColumn("appears", F.lit(True)), key, "left")
    return j.fillna(zeros).withColumn("appears", F.coalesce("appears", F.lit(False)))


def undeclared(used: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """[J03] Rows whose key is not declared."""
    return used.join(declared.select(key).distinct(), key, "left_anti")


def priority(score: Column) -> Column:
    """[P06] The band of a score."""
    return F.when(score >= 6, "Highest").when(score >= 4, "High").when(score >= 2, "Medium").otherwise("Low")


def overdue(tasks: DataFrame, today: Column, grace: int = 0) -> DataFrame:
    """Tasks not done whose planned end is more than ``grace`` days ago; probability 3, impact 3 from 7 days on, 2 from 3."""
    days = F.datediff(today, "plan_end")
    t = tasks.where(~F.col("is_done")).withColumn("days", days).where(F.col("days") > grace)
    score = F.lit(3) * F.when(F.col("days") >= 7, 3).when(F.col("days") >= 3, 2).otherwise(1)
    return t.withColumn("score", score).withColumn("priority", priority(F.col("score")))


def overrun(tasks: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Tasks whose actual effort is above ``ratio`` times the estimate; impact 3 above 1.5 times that ratio."""
    r = F.try_divide("actual", F.when(F.col("estimate") > 0, F.col("estimate")))
    return tasks.withColumn("ratio", r).where(F.col("ratio") > ratio).withColumn("impact", F.when(F.col("ratio") > ratio * 1.5, 3).otherwise(2))


def velocity(tasks: DataFrame, sprint: str, margin: float = 15.0) -> DataFrame:
    """[A05 W07] Share done of each sprint, that of the one before, and whether it fell by the margin."""
    s = tasks.groupBy(sprint).agg(F.round(100.0 * F.count_if("is_done") / F.count("*"), 4).alias("done_pct"))
    before = F.lag("done_pct").over(Window.orderBy(sprint))  # one row for each sprint
    return s.withColumn("before_pct", before).withColumn("fell", F.coalesce(before - F.col("done_pct") >= margin, F.lit(False)))


def overload(tasks: DataFrame, most: float = 8, least_tasks: int = 2) -> DataFrame:
    """[A08] assignee, day, tasks, hours: days onto which several open one-day tasks of a person are stacked, of more than ``most`` hours together."""
    t = tasks.where(~F.col("is_done") & F.col("assignee").isNotNull() & (F.col("plan_start") == F.col("plan_end")) & (F.col("estimate") != 0))
    each = t.groupBy("assignee", F.col("plan_start").alias("day")).agg(F.count("*").alias("tasks"), F.round(F.sum("estimate"), 4).alias("hours"))
    return each.where((F.col("tasks") >= least_tasks) & (F.col("hours") > most))


def calendar_slots(work: DataFrame, key: str, order: Sequence[str], hours: str, per_day: float = 8.0) -> DataFrame:
    """[W10] Where a person's tasks lie in their running hours: from, to, and the working days of both."""
    to = F.sum(hours).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    w = work.withColumn("to_h", to).withColumn("from_h", F.col("to_h") - F.col(hours))
    return w.withColumn("first_day", F.floor(F.col("from_h") / per_day)).withColumn("last_day", F.greatest(F.ceil(F.col("to_h") / per_day) - 1, F.lit(0)))


def overlap_hours(start: Column, end: Column, day_start: Column, day_end: Column) -> Column:
    """[W11] Hours that a slot gives to a day."""
    return F.greatest(F.lit(0.0), F.least(end, day_end) - F.greatest(start, day_start))


def nearest_before(rows: DataFrame, key: str, order: Sequence[str], is_source: Column, value: str, name: str) -> DataFrame:
    """[J16] Beside each row, the value of the nearest earlier source row of its group."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(w))


def forward_fill(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """[W01] Nulls take the last value before them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def islands(days: DataFrame, key: str, day: str) -> DataFrame:
    """[W04] Runs of consecutive days: key, start, end, days."""
    d = days.select(key, day).distinct()
    run = F.date_sub(day, F.row_number().over(Window.partitionBy(key).orderBy(day)))
    return d.withColumn("_run", run).groupBy(key, "_run").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("days")).drop("_run")


def overlapping(tasks: DataFrame, leave: DataFrame, key: str) -> DataFrame:
    """[J04] Tasks (start_t, end_t) beside each leave (start, end) of the same person that overlaps them."""
    return tasks.join(leave, key).where((F.col("start_t") <= F.col("end")) & (F.col("end_t") >= F.col("start")))


def gap_sessions(rows: DataFrame, key: str, order: Sequence[str], start: Column, end: Column, gap: Column) -> DataFrame:
    """[W05] Sessions: a new one starts where more than ``gap`` lies between a row's start and the end before it."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((start - F.lag(end).over(w) > gap).cast("long"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def paired(rows: DataFrame, key: str, order: Sequence[str], left: Column, right: Column, value: str) -> DataFrame:
    """[J15] The n-th left row of a group beside its n-th right row; what has no partner is left out."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    a = rows.where(left).select(key, number.alias("n"), F.col(value).alias("left_value"))
    b = rows.where(right).select(key, number.alias("n"), F.col(value).alias("right_value"))
    return a.join(b, [key, "n"])


def history(rows: DataFrame, key: str, order: str, n: int, newest: bool = True) -> DataFrame:
    """[W08 T06] The newest (or oldest) n rows of a group."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if newest else F.asc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def logged_today(ledger: DataFrame, keys: Sequence[str], task: str, order: str, delta: str, actual: str, live: DataFrame | None = None, drift: float = 0.01) -> DataFrame:
    """[A14] Hours logged, over a person's tasks: the last actual less what stood before the first entry.

    A task whose first or last entry has no actual gives the sum of its deltas. live (keys, task, live) has what a task's sheet says
    now: a task whose last actual is off by more than ``drift`` is left out, as its entries no longer hold.
    """
    t = ledger.groupBy(*keys, task).agg(F.min_by(F.struct(F.col(actual).alias("a"), F.coalesce(delta, F.lit(0.0)).alias("d")), order).alias("f"), F.max_by(F.struct(F.col(actual).alias("a")), order)["a"].alias("l"), F.sum(delta).alias("s"))
    if live is not None:
        t = t.join(live, [*keys, task], "left").where(F.col("live").isNull() | F.col("l").isNull() | (F.abs(F.col("l") - F.col("live")) <= drift))
    hours = F.when(F.col("f.a").isNull() | F.col("l").isNull(), F.coalesce("s", F.lit(0.0))).otherwise(F.col("l") - (F.col("f.a") - F.col("f.d")))
    return t.groupBy(*keys).agg((F.round(F.sum(hours), 2) + 0.0).alias("logged"), F.count("*").alias("tasks"))


def nearest_rank(values: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """[A16] The value at place floor(n * share) of each group, the last at most."""
    return ranked_value(values, keys, value, F.floor(F.col("_n") * share), f"p{round(share * 100)}")


def dominant(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """[A18] The most frequent value of a group; of ties, the one seen first."""
    c = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first", value))
    return c.withColumn("_b", best).where("_b = 1").select(key, F.col(value).alias("dominant"), "n")


def verdict(votes: DataFrame, key: str, run: str, value: str, runs: int) -> DataFrame:
    """[A19] What more than half of the runs say, a run counting once."""
    return votes.select(key, run, value).distinct().groupBy(key, value).agg(F.count("*").alias("k")).withColumn("agreed", F.col("k") >= runs // 2 + 1)


def duplicates(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """[A23] Digests that several rows have: how many, and the smallest key."""
    return rows.groupBy(F.sha2(content, 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def compared(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """[J05 J07] Each key: missing, extra, changed or same."""
    j = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_io")).join(new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_in")), key, "full_outer")
    kind = F.when(F.col("_in").isNull(), "missing").when(F.col("_io").isNull(), "extra").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed").otherwise("same")
    return j.select(key, kind.alias("verdict"))


def linked_to_all(links: DataFrame, keys: Sequence[str], target: str, n: int) -> DataFrame:
    """[J13] Keys linked to all n targets."""
    return links.select(*keys, target).distinct().groupBy(*keys).agg(F.count("*").alias("k")).where(F.col("k") == n).drop("k")


def readable(rows: DataFrame, actor: str | None, roles: Sequence[str], role_of: dict[str, Sequence[str]]) -> DataFrame:
    """Rows that the actor may read: public, named users, allowed roles, or a role of the visibility. No actor, no rows."""
    if not actor:
        return rows.where(F.lit(False))
    mine = F.array(*map(F.lit, roles)).cast("array<string>")
    by_visibility = [v for v, allowed in role_of.items() if set(allowed) & set(roles)]
    may = (F.col("visibility") == "public") | F.array_contains("allowed_users", actor) | F.arrays_overlap("allowed_roles", mine)
    if by_visibility:
        may = may | F.col("visibility").isin(by_visibility)
    return rows.where(F.coalesce(may, F.lit(False)))


def three_valued(asked: DataFrame, facts: DataFrame, key: str, declared: DataFrame, signed: bool) -> DataFrame:
    """[R09 F18] yes where a fact exists; no only for a declared key under a signed receipt; else unknown."""
    f = facts.select(key).distinct().withColumn("_f", F.lit(True))
    d = declared.select(key).distinct().withColumn("_d", F.lit(True))
    j = asked.join(f, key, "left").join(d, key, "left")
    return j.select(key, F.when(F.col("_f"), "yes").when(F.col("_d") & F.lit(signed), "no").otherwise("unknown").alias("answer"))


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """[K09 ST10] The last version of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last_days(log: DataFrame, day: str, n: int = 7) -> DataFrame:
    """[K11] Entries of the last n distinct days."""
    days = log.select(day).distinct().orderBy(F.desc(day)).limit(n)
    return log.join(days, day, "left_semi")


def cosine_top(queries: DataFrame, rows: DataFrame, k: int, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """[R03] query (id, q) beside rows (vec, v): the k rows of highest cosine, rounded to 6 places, ties by vec; queries meet rows block by block.

    A block's products are a matrix product, from which each query keeps the rows that may be among its best; their cosines are then summed in the
    components' order, as without blocks. Vectors that are null, hold null or non-finite components, have no length or not the usual number of
    components are no part of a matrix: their pairs are joined.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows, asked = rows.where("vec is not null"), queries.where("id is not null")
    finite = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100)), F.lit(False))
    width = rows.where(finite(F.col("v"))).agg(F.max(F.size("v"))).first()[0] or 0
    usual = lambda c: finite(c) & (F.size(c) == width) & F.exists(c, lambda x: F.abs(x) > 1e-30)
    rows, asked = rows.select("vec", "v", F.coalesce(usual(F.col("v")), F.lit(False)).alias("_u")), asked.select("id", "q", F.coalesce(usual(F.col("q")), F.lit(False)).alias("_u"))
    n, n_q = (df.agg(F.count("*"), F.count_if("_u")).first() for df in (rows, asked))
    blocks, q_blocks = max(1, math.ceil(n[1] / block)), max(1, math.ceil(n_q[1] / query_block))
    number = F.monotonically_increasing_id()
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = asked.where("_u").withColumn("_qb", F.pmod(number, F.lit(q_blocks)).cast("long")).withColumn("_b", each(blocks)).groupBy("_qb", "_b")
    b = rows.where("_u").withColumn("_b", F.pmod(number, F.lit(blocks)).cast("long")).withColumn("_qb", each(q_blocks)).groupBy("_qb", "_b")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [(a["id"].iloc[:0], b["vec"].iloc[:0], np.empty(0))]
        if len(a) and len(b):
            qs, vs, ids, vecs = np.stack(a["q"]).astype(float), np.stack(b["v"]).astype(float), a["id"].to_numpy(), b["vec"].to_numpy()
            length = lambda m: np.sqrt(np.add.accumulate(m * m, axis=1)[:, -1])
            nq, nv = length(qs), length(vs)
            for at in range(0, len(qs), 256):
                near = (qs[at : at + 256] / nq[at : at + 256, None]) @ (vs / nv[:, None]).T
                near[ids[at : at + 256, None] == vecs[None, :]] = -np.inf
                # Rounding to 6 places makes ties of cosines that are no farther apart than that.
                least = np.partition(near, len(vecs) - k, axis=1)[:, len(vecs) - k] - 3e-6 if len(vecs) > k else np.full(len(near), -2.0)
                i, j = np.nonzero(near >= np.maximum(least, -2.0)[:, None])
                for part in range(0, len(i), 65536):
                    x, y = i[part : part + 65536] + at, j[part : part + 65536]
                    sums = np.add.accumulate(qs[x] * vs[y], axis=1)[:, -1] / (nq[x] * nv[y])
                    out.append((a["id"].iloc[x], b["vec"].iloc[y], sums))
        return pd.DataFrame({"id": pd.concat([o[0] for o in out], ignore_index=True), "vec": pd.concat([o[1] for o in out], ignore_index=True), "cosine": np.concatenate([o[2] for o in out])})

    kinds = f"id {asked.schema['id'].dataType.simpleString()}, vec {rows.schema['vec'].dataType.simpleString()}, cosine double"
    s = a.cogroup(b).applyInPandas(meet, kinds).select("id", "vec", F.round("cosine", 6).alias("cosine"))
    odd = lambda x, y: x.join(y, F.col("id") != F.col("vec")).select("id", "vec", F.round(dot / (norm(F.col("q")) * norm(F.col("v"))), 6).alias("cosine"))
    asked_u, rows_u = asked.drop("_u"), rows.drop("_u")
    if n[0] > n[1]:
        s = s.union(odd(asked_u, rows.where("not _u").drop("_u")))
    if n_q[0] > n_q[1]:
        s = s.union(odd(asked.where("not _u").drop("_u"), rows_u if n[0] == n[1] else rows.where("_u").drop("_u")))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "vec"))).where(F.col("rank") <= k)


def fused(lists: DataFrame, keep: int, k0: int = 60, pins: DataFrame | None = None) -> DataFrame:
    """[W13 R06] item, rank from 1: items by the sum of 1 / (k0 + rank); pins (item, pin) come first, in their order."""
    s = lists.groupBy("item").agg(F.round(F.sum(1.0 / (k0 + F.col("rank"))), 8).alias("score"))
    if pins is None:
        return s.orderBy(F.desc("score"), "item").limit(keep)
    s = s.join(pins, "item", "full_outer").select("item", F.coalesce("score", F.lit(0.0)).alias("score"), "pin")
    return s.orderBy(F.col("pin").asc_nulls_last(), F.desc("score"), "item").limit(keep).drop("pin")


def bm25(docs: DataFrame, words: Sequence[str], keep: int, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """[R04 R05] The best documents for the words, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); positive scores only."""
    tokens = docs.select(F.col(key).alias("doc"), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)).alias("ws"))
    stats = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("ws")).alias("mean"))
    asked = F.array(*map(F.lit, words))
    hits = tokens.where(F.arrays_overlap("ws", asked)).withColumn("dl", F.size("ws"))
    tf = hits.select("doc", "dl", F.explode(F.filter("ws", lambda w: F.array_contains(asked, w))).alias("w")).groupBy("doc", "dl", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    j = tf.join(df, "w").join(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    return j.groupBy("doc").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc").limit(keep)


def mutual(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """[J11] Edges a, b without their counterpart; with pages (b), also kind: ``dangling`` where the target is no page, else ``one_way``."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    left = edges.join(back, ["a", "b"], "left_anti")
    if pages is None:
        return left
    known = pages.select("b").distinct().withColumn("_p", F.lit(True))
    return left.join(known, "b", "left").select("a", "b", F.when(F.col("_p"), "one_way").otherwise("dangling").alias("kind"))
