"""Queries of the risk rules; importing this adds them to the catalogue.

Tasks are line items: planned from their order's date to the day of shipping, done at status F. Calendars are suppliers'
days of shipping in the first half of 1998: eight hours, 0 on a Saturday (leave), null on a Sunday (not planned).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from .catalogue import query, table

TODAY, END, SPRINT, HOUR = "DATE '1998-06-10'", "DATE '1998-06-30'", "Sprint 199806", 19

TASKS = """
    t AS (SELECT l_orderkey || '-' || l_linenumber AS ref, CASE WHEN l_suppkey % 7 <> 0 THEN 's' || l_suppkey END AS assignee, p_brand AS category,
                 CASE WHEN l_returnflag = 'R' THEN ' Verify Bug' WHEN l_linenumber = 1 THEN 'Pending' WHEN l_linenumber = 2 THEN 'In progress' ELSE 'Closed' END AS status,
                 l_linestatus = 'F' AS is_done, CASE WHEN l_linenumber = 3 THEN CAST(l_shipdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS plan_start, CAST(l_shipdate AS DATE) AS plan_end,
                 l_quantity AS estimate, CASE WHEN l_returnflag <> 'N' THEN l_quantity * (1 + 10 * l_discount) END AS actual, l_quantity / 2 AS remaining,
                 'Sprint ' || strftime(o_orderdate, '%Y%m') AS sprint, CAST(o_orderdate AS DATE) AS changed
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    c AS (SELECT DISTINCT 's' || l_suppkey AS person, CAST(l_shipdate AS DATE) AS day, CASE dayofweek(l_shipdate) WHEN 0 THEN NULL WHEN 6 THEN 0.0 ELSE 8.0 END AS hours FROM lineitem
          WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-07-01'),
    o AS (SELECT 's' || l_suppkey AS person, CAST(l_shipdate AS DATE) AS day, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS hours FROM lineitem WHERE l_linenumber = 4 AND l_suppkey % 3 <> 0 GROUP BY ALL)"""


def tasks(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, start, end = F.col("l_linenumber"), F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    status = F.when(F.col("l_returnflag") == "R", " Verify Bug").when(n == 1, "Pending").when(n == 2, "In progress").otherwise("Closed")
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ref"),
        F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("assignee"),
        F.col("p_brand").alias("category"),
        status.alias("status"),
        (F.col("l_linestatus") == "F").alias("is_done"),
        F.when(n == 3, end).otherwise(start).alias("plan_start"),
        end.alias("plan_end"),
        F.col("l_quantity").alias("estimate"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * (1 + 10 * F.col("l_discount"))).alias("actual"),
        (F.col("l_quantity") / 2).alias("remaining"),
        F.concat(F.lit("Sprint "), F.date_format("o_orderdate", "yyyyMM")).alias("sprint"),
        start.alias("changed"),
    )


def person():
    return F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("person")


def calendar(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    rows = table(spark, sf_dir, "lineitem").where(day.between(F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date"))).select(person(), day.alias("day")).distinct()
    return rows.withColumn("hours", F.when(F.dayofweek("day") == 7, 0.0).when(F.dayofweek("day") != 1, 8.0))


def overtime(spark, sf_dir):
    """Fourth lines are entries of overtime; suppliers are known by a number of their own, but every third isn't known."""
    rows = table(spark, sf_dir, "lineitem")
    entries = rows.where("l_linenumber = 4").select((F.col("l_suppkey") + 5000).alias("slack_id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("hours"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    people = rows.where("l_suppkey % 3 <> 0").select((F.col("l_suppkey") + 5000).alias("slack_id"), person()).distinct()
    return rules.overtime_of(entries, people)


def loads(spark, sf_dir):
    return rules.load(tasks(spark, sf_dir), calendar(spark, sf_dir), overtime(spark, sf_dir), F.expr(TODAY), F.expr(END), SPRINT, HOUR)


LOADS = f"""
    r AS (SELECT person, sum(h) AS h FROM (SELECT person, hours AS h FROM c WHERE day > {TODAY} AND day <= {END} UNION ALL SELECT person, hours FROM o WHERE day BETWEEN {TODAY} AND {END}) GROUP BY 1),
    b AS (SELECT assignee AS person, sum(remaining) AS backlog FROM t WHERE sprint = '{SPRINT}' AND NOT is_done AND assignee IS NOT NULL GROUP BY 1),
    l AS (SELECT DISTINCT c.person, coalesce(h, 0) AS capacity, coalesce(backlog, 0) AS backlog FROM c LEFT JOIN r ON c.person = r.person LEFT JOIN b ON c.person = b.person)"""
BAND = "CASE WHEN score >= 6 THEN 'Highest' WHEN score >= 4 THEN 'High' WHEN score >= 2 THEN 'Medium' ELSE 'Low' END AS priority"


@query(f"""
    WITH {TASKS}, {LOADS},
    late AS (SELECT ref, date_diff('day', plan_end, {TODAY}) AS d FROM t WHERE NOT is_done),
    idle AS (SELECT ref, date_diff('day', plan_start, {TODAY}) AS d FROM t WHERE NOT is_done AND coalesce(actual, 0) = 0),
    cat AS (SELECT category, min(plan_start) AS a, max(plan_end) AS z, 100.0 * count(*) FILTER (WHERE is_done) / count(*) AS done FROM t GROUP BY 1),
    spr AS (SELECT sprint, 100.0 * count(*) FILTER (WHERE is_done) / count(*) AS p FROM t GROUP BY 1 ORDER BY 1 DESC LIMIT 2),
    i AS (SELECT 'T1' AS rule, 'Task' AS layer, ref, 3 * CASE WHEN d >= 7 THEN 3 WHEN d >= 3 THEN 2 ELSE 1 END AS score FROM late WHERE d > 0
          UNION ALL SELECT 'T2', 'Task', ref, 2 * CASE WHEN actual / estimate > 2.25 THEN 3 ELSE 2 END FROM t WHERE estimate > 0 AND actual / estimate > 1.5
          UNION ALL SELECT 'T4', 'Task', ref, 3 * CASE WHEN d >= 5 THEN 3 WHEN d >= 2 THEN 2 ELSE 1 END FROM idle WHERE d > 0
          UNION ALL SELECT 'S1', 'Sprint', max(sprint), 6 FROM spr HAVING min_by(p, sprint) - max_by(p, sprint) >= 15
          UNION ALL SELECT 'S2', 'Sprint', '{SPRINT}', 9 FROM l HAVING sum(backlog) > sum(capacity)
          UNION ALL SELECT 'M1', 'Module', category, 3 * CASE WHEN count(*) >= 6 THEN 3 WHEN count(*) >= 3 THEN 2 ELSE 1 END FROM t WHERE lower(trim(status)) = 'verify bug' GROUP BY category
          UNION ALL SELECT 'M2', 'Module', category, 6 FROM cat WHERE z > a AND 100.0 * greatest(0, least(date_diff('day', a, {TODAY}), date_diff('day', a, z))) / date_diff('day', a, z) - done >= 15
          UNION ALL SELECT 'P2', 'Person', assignee || ' ' || strftime(plan_start, '%Y-%m-%d'), 6 FROM t WHERE NOT is_done AND assignee IS NOT NULL AND plan_start = plan_end AND estimate <> 0 GROUP BY assignee, plan_start HAVING count(*) >= 2 AND sum(estimate) > 8
          UNION ALL SELECT 'P3', 'Person', ref, 6 FROM t WHERE NOT is_done AND assignee IS NULL AND date_diff('day', {TODAY}, plan_end) <= 2
          UNION ALL SELECT 'P4', 'Person', person, 3 * CASE WHEN backlog - capacity >= 16 THEN 3 ELSE 2 END FROM l WHERE backlog > capacity)
    SELECT rule, layer, ref, CAST(score AS INTEGER) AS score, {BAND} FROM i""")
def risk_items(spark, sf_dir):
    """P05 P06 U01 and the rules T1, T2, T4, S1, S2, M1, M2, P2, P3, P4."""
    return rules.run_rules(tasks(spark, sf_dir), calendar(spark, sf_dir), overtime(spark, sf_dir), F.expr(TODAY), F.expr(END), SPRINT, HOUR)


@query(f"WITH {TASKS} SELECT category, count(*) AS bugs, string_agg(ref, ', ' ORDER BY ref) AS refs FROM t WHERE lower(trim(status)) = 'verify bug' GROUP BY 1")
def bug_trend(spark, sf_dir):
    return rules.bugs(tasks(spark, sf_dir))


@query(f"""
    WITH {TASKS}, k AS (SELECT category, min(plan_start) AS a, max(plan_end) AS z, 100.0 * count(*) FILTER (WHERE is_done) / count(*) AS done_pct FROM t GROUP BY 1),
    e AS (SELECT category, 100.0 * greatest(0, least(date_diff('day', a, {TODAY}), date_diff('day', a, z))) / date_diff('day', a, z) AS elapsed_pct, done_pct FROM k WHERE z > a)
    SELECT category, round(elapsed_pct, 6) AS elapsed_pct, round(done_pct, 6) AS done_pct FROM e WHERE elapsed_pct - done_pct >= 2""")
def category_lag(spark, sf_dir):
    return rules.category_lag(tasks(spark, sf_dir), F.expr(TODAY), 2).select("category", F.round("elapsed_pct", 6).alias("elapsed_pct"), F.round("done_pct", 6).alias("done_pct"))


@query(f"""WITH {TASKS}, r AS (SELECT person, sum(h) AS h FROM (SELECT person, hours AS h FROM c WHERE day > {TODAY} AND day <= {END} UNION ALL SELECT person, hours FROM o WHERE day BETWEEN {TODAY} AND {END}) GROUP BY 1)
    SELECT DISTINCT c.person, coalesce(h, 0) AS capacity FROM c LEFT JOIN r ON c.person = r.person""")
def person_capacity(spark, sf_dir):
    return rules.capacity(calendar(spark, sf_dir), overtime(spark, sf_dir), F.expr(TODAY), F.expr(END), HOUR)


@query(f"WITH {TASKS} SELECT person, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS gaps FROM c WHERE day BETWEEN {TODAY} AND {END} AND coalesce(hours, 0) = 0 GROUP BY 1")
def calendar_gaps(spark, sf_dir):
    return rules.gap_days(calendar(spark, sf_dir), F.expr(TODAY), F.expr(END))


@query(f"""WITH {TASKS}, {LOADS}, g AS (SELECT person, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS gaps FROM c WHERE day > {TODAY} AND day <= {END} AND coalesce(hours, 0) = 0 GROUP BY 1)
    SELECT l.person, backlog - capacity AS deficit, CAST(CASE WHEN backlog - capacity >= 16 THEN 3 ELSE 2 END AS INTEGER) AS impact, coalesce(gaps, '') AS gaps FROM l LEFT JOIN g ON l.person = g.person WHERE backlog > capacity""")
def sprint_deficits(spark, sf_dir):
    gaps = rules.gap_days(calendar(spark, sf_dir), rules.regular_start(F.expr(TODAY), HOUR), F.expr(END))
    return rules.deficits(loads(spark, sf_dir), gaps)


@query(f"WITH {TASKS}, {LOADS} SELECT sum(backlog) AS total_backlog, sum(capacity) AS total_capacity, sum(backlog) <= sum(capacity) AS on_track FROM l")
def sprint_health(spark, sf_dir):
    return rules.health(loads(spark, sf_dir))


@query(f"WITH {TASKS} SELECT person, day, hours FROM o")
def overtime_by_person(spark, sf_dir):
    return overtime(spark, sf_dir)


@query(f"WITH {TASKS} SELECT max(plan_end) AS \"end\" FROM t")
def sprint_end_fallback(spark, sf_dir):
    none = table(spark, sf_dir, "region").where("r_regionkey < 0").select(F.lit(None).cast("date").alias("end"))
    return rules.sprint_end(none, tasks(spark, sf_dir), F.expr(TODAY))


@query(f"""WITH {TASKS} SELECT ref, CASE WHEN status = 'Pending' THEN 'open' ELSE 'in_progress' END AS kind, CAST(CASE WHEN status = 'In progress' THEN date_diff('day', changed, {TODAY}) END AS INTEGER) AS idle_days
    FROM t WHERE status IN ('Pending', 'In progress')""")
def status_split(spark, sf_dir):
    return rules.status_split(tasks(spark, sf_dir), F.expr(TODAY))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN p_name ELSE p_type END AS title, CASE WHEN l_returnflag = 'N' THEN 'Open' ELSE l_returnflag END AS status,
           CASE WHEN l_linenumber = 2 THEN l_tax ELSE l_quantity END AS estimate, CASE WHEN l_linestatus = 'F' THEN 'T-' || l_orderkey ELSE 'tab, row ' || l_linenumber END AS ref
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def normalised_tasks(spark, sf_dir):
    """Blanks in the raw columns mean nothing was entered."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    raw = j.select("l_orderkey", "l_linenumber", F.when(n == 1, "  ").otherwise(F.col("p_type")).alias("sub_task"), F.col("p_name").alias("task"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("raw_status"), F.when(n == 2, F.col("l_tax")).alias("re_estimate"), F.col("l_quantity").alias("first_estimate"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("T-"), F.col("l_orderkey").cast("string"))).alias("id"), F.lit("tab").alias("tab"), n.alias("row"))
    return rules.normalised(raw).select("l_orderkey", "l_linenumber", "title", "status", "estimate", "ref")
