"""Queries of gates, deadlines and capacity; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from .catalogue import query, table

TODAY = "DATE '1996-06-01'"


@query(f"""
    WITH d AS (SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), {TODAY}) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) > {TODAY} AND l_linestatus <> 'F'),
         s AS (SELECT *, CAST(3 * CASE WHEN days >= 5 THEN 3 WHEN days >= 2 THEN 2 ELSE 1 END AS INTEGER) AS score FROM d WHERE days > 0)
    SELECT *, CASE WHEN score >= 6 THEN 'Highest' WHEN score >= 4 THEN 'High' ELSE 'Medium' END AS priority FROM s""")
def not_started(spark, sf_dir):
    """Planned start: order date. Effort: the quantity, once shipped. Done: line status F."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.when(F.col("l_shipdate").cast("date") <= F.expr(TODAY), F.col("l_quantity"))
    t = t.select("l_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").alias("plan_start"), shipped.alias("actual"), (F.col("l_linestatus") == "F").alias("is_done"))
    return gates.not_started(t, F.expr(TODAY)).select("l_orderkey", "l_linenumber", "days", "score", "priority")


@query(f"""
    SELECT o_orderkey, CAST(date_diff('day', {TODAY}, CAST(o_orderdate AS DATE) + 30) AS INTEGER) AS days_left
    FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 5 = 0 AND date_diff('day', {TODAY}, CAST(o_orderdate AS DATE) + 30) <= 2""")
def unassigned_deadline(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_done"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("assignee"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("plan_end"))
    return gates.unassigned(o, F.expr(TODAY)).select("o_orderkey", "days_left")


@query("""
    SELECT id, min(o_orderkey) AS first FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'U' ELSE 'x' END || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS id FROM orders)
    WHERE regexp_full_match(id, '[UW][A-Z0-9]{6,}') GROUP BY id""")
def valid_ids(spark, sf_dir):
    id_ = F.concat(F.when(F.col("o_custkey") % 2 == 0, "U").otherwise("x"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    return gates.valid_ids(table(spark, sf_dir, "orders").select("o_orderkey", id_.alias("id")), "id", "o_orderkey")


@query("""
    WITH c AS (SELECT l_suppkey, 8.0 * count(DISTINCT CAST(l_shipdate AS DATE)) AS capacity FROM lineitem GROUP BY 1),
         b AS (SELECT l_suppkey, sum(l_quantity) AS backlog FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
         d AS (SELECT s_suppkey AS person, round(coalesce(backlog, 0) - coalesce(capacity, 0), 4) AS deficit FROM supplier LEFT JOIN c ON s_suppkey = c.l_suppkey LEFT JOIN b ON s_suppkey = b.l_suppkey)
    SELECT *, CAST(CASE WHEN deficit >= 16 THEN 3 ELSE 2 END AS INTEGER) AS impact FROM d WHERE deficit > 0""")
def capacity_deficit(spark, sf_dir):
    """Capacity: eight hours on each day of shipping. Backlog: quantities of open lines."""
    w = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "person")
    capacity = w.select("person", F.col("l_shipdate").cast("date").alias("day")).distinct().withColumn("hours", F.lit(8.0))
    backlog = w.where("l_linestatus = 'O'").select("person", F.col("l_quantity").alias("hours"))
    return gates.deficits(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person")), capacity, backlog, "person").select("person", "deficit", "impact")


@query("SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def citations_without_source(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("part"))
    return gates.without_source(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part")), parts, "part")


@query("""
    WITH e AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS k, count(*) FILTER (WHERE value > 50) AS c FROM events GROUP BY ALL),
         f AS (SELECT user_id, event_type, max(k) > 1 AS repeated, sum(c) > 1 AS several_current FROM e GROUP BY ALL)
    SELECT * FROM f WHERE repeated OR several_current""")
def registry_faults(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), (F.col("value") > 50).alias("current"))
    return gates.registry_faults(e, ["user_id", "event_type"], "day")


@query("""
    WITH s AS (SELECT DATE '1995-01-01' + CAST(40 * n_nationkey AS INTEGER) AS a FROM nation),
         k AS (SELECT o_orderkey, (SELECT count(*) FROM s WHERE CAST(o_orderdate AS DATE) BETWEEN a AND a + 45) AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k = 1 THEN 'one' WHEN k = 0 THEN 'none' ELSE 'several' END AS verdict FROM k""")
def sprint_containment(spark, sf_dir):
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey") * 40)
    spans = table(spark, sf_dir, "nation").select(start.alias("start"), F.date_add(start, 45).alias("end"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return gates.containing(o, spans, "day").select("o_orderkey", "verdict")


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[A-Za-z]+-[0-9]+')) AS target FROM pages")
def mentioned_ids(spark, sf_dir):
    return gates.mentioned_ids(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""
    SELECT c_custkey AS person, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10') THEN 'logged' ELSE 'chua_log' END AS status FROM customer""")
def log_status(spark, sf_dir):
    log = table(spark, sf_dir, "events").where(F.col("ts").cast("date") == F.lit("2024-01-10").cast("date")).select(F.col("user_id").alias("person"))
    return gates.log_status(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person")), log, "person")


@query("SELECT user_id, event_type, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL")
def first_and_last(spark, sf_dir):
    return gates.first_and_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^a-z]', '', 'g')) < 0.85 * length(text)")
def too_short(spark, sf_dir):
    """What is left of a text when all but a-z is taken out."""
    return gates.too_short(table(spark, sf_dir, "documents"), F.regexp_replace("text", "[^a-z]", ""), F.col("text"), 0.85).select("doc_id")
