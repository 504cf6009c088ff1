"""Queries of what stands before the answers; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, front
from .catalogue import query, table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"""
    WITH t AS (SELECT o_orderkey AS place, 'ORD-' || o_orderkey AS task, p_name AS name, c_name, c_mktsegment AS seg, o_orderstatus AS st, o_orderpriority AS pri, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = o_orderkey % 200),
         q AS (SELECT c_custkey AS k, c_custkey % 6 AS kind, {list(PRIORITIES)}[c_custkey // 6 % 5 + 1] AS pri, ['F', 'O', 'P'][c_custkey // 6 % 3 + 1] AS st, c_mktsegment AS seg, p_name FROM customer JOIN part ON p_partkey = c_custkey % 200),
         w AS (SELECT DISTINCT p_name, list_filter(regexp_extract_all('liet ke task ' || p_name, '[a-z0-9]+'), lambda x: length(x) > 3 AND x <> 'task') AS ws FROM q WHERE kind = 4),
         n AS (SELECT p_name, name FROM w JOIN (SELECT DISTINCT name FROM t) ON len(list_filter(ws, lambda x: contains(name, x))) >= least(2, len(ws))),
         h AS (SELECT k, kind, t.* FROM q JOIN t ON kind = 0 AND o_custkey = k UNION ALL SELECT k, kind, t.* FROM q JOIN t ON kind = 1 AND q.seg = t.seg AND q.pri = t.pri
               UNION ALL SELECT k, kind, t.* FROM q JOIN t ON kind = 2 AND q.st = t.st AND q.pri = t.pri UNION ALL SELECT k, kind, t.* FROM q JOIN t ON kind = 3 AND place = k
               UNION ALL SELECT k, kind, t.* FROM q JOIN t ON kind = 3 AND place = k + 1 UNION ALL SELECT k, kind, t.* FROM q JOIN n ON kind = 4 AND n.p_name = q.p_name JOIN t ON t.name = n.name),
         f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY place) <= 60),
         p AS (SELECT k, c_name, '**' || c_name || '**: ' || string_agg(task || ' — ' || name, '; ' ORDER BY place) AS line FROM f GROUP BY 1, 2),
         l AS (SELECT k, string_agg(line, chr(10) ORDER BY c_name) AS lines FROM p GROUP BY 1),
         g AS (SELECT k, any_value(kind) AS kind, count(*) AS hits, 'Những người liên quan: **' || string_agg(DISTINCT c_name, '**, **' ORDER BY c_name) || '**.' AS people, 'Các vai trò liên quan: `' || string_agg(DISTINCT seg, '`, `' ORDER BY seg) || '`.' AS roles FROM f GROUP BY 1)
    SELECT q.k AS c_custkey, CASE WHEN hits IS NULL THEN 2 ELSE 1 END AS tier, CASE WHEN hits IS NULL THEN 'nothing' WHEN q.kind = 1 THEN 'graph_people' WHEN q.kind = 2 THEN 'graph_roles' ELSE 'graph_tasks' END AS rule,
           CASE WHEN hits IS NULL THEN 'missing' ELSE 'found' END AS outcome, CASE WHEN q.kind = 1 THEN people WHEN q.kind = 2 THEN roles ELSE lines END AS answer, coalesce(hits, 0) AS hits
    FROM q LEFT JOIN g ON g.k = q.k LEFT JOIN l ON l.k = q.k""")
def graph_answers(spark, sf_dir):
    """A customer asks one of six questions: own tasks, people by priority and segment, segments by status and priority, two ids, a name's words, nothing."""
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    tasks = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("o_orderkey") % 200 == F.col("p_partkey"))
    tasks = tasks.select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("task"), F.col("o_orderkey").alias("place"), F.col("p_name").alias("name"), F.col("c_name").alias("assignee"), F.col("c_mktsegment").alias("role"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    k = F.col("c_custkey")
    nth = F.expr("c_custkey div 6")
    priority, status = F.get(F.array(*map(F.lit, PRIORITIES)), (nth % 5).cast("int")), F.get(F.array(*map(F.lit, "FOP")), (nth % 3).cast("int"))
    said = F.when(k % 6 == 0, F.concat(F.lit("Liệt kê task của "), "c_name")).when(k % 6 == 1, F.concat(F.lit("Liệt kê người phụ trách: "), priority, F.lit(", "), "c_mktsegment"))
    said = said.when(k % 6 == 2, F.concat(F.lit("Các vai trò của task "), status, F.lit(" "), priority)).when(k % 6 == 3, F.concat(F.lit("Danh sách task ORD-"), k.cast("string"), F.lit(" và ORD-"), (k + 1).cast("string")))
    said = said.when(k % 6 == 4, F.concat(F.lit("Liệt kê task "), "p_name")).otherwise("xem")
    q = customers.join(parts, k % 200 == F.col("p_partkey")).select(k, said.alias("question"))
    return answers.tiered(q, "c_custkey", "question", [front.graph_tier("c_custkey", tasks, ("role", "status", "priority"))])


@query("""
    WITH q AS (SELECT c_custkey, p_name, p_brand || '/' || p_type AS pin FROM customer JOIN part ON p_partkey = c_custkey % 200),
         l AS (SELECT p_partkey AS pos, p_name || ' ' || lower(p_type) AS line, unnest([p_brand || '/' || p_type, 'size/' || p_size]) AS path FROM part),
         s AS (SELECT DISTINCT p_name, list_filter(string_split('danh sach ' || p_name, ' '), lambda x: length(x) > 2) AS ts FROM q),
         a AS (SELECT DISTINCT pos, line FROM l), b AS (SELECT p_name, pos, len(list_filter(ts, lambda x: contains(line, x))) AS hits FROM s, a),
         c AS (SELECT p_name, path, max((hits, -pos)) AS m FROM b JOIN l USING (pos) GROUP BY 1, 2), d AS (SELECT p_name, path, m[1] AS hits, -m[2] AS pos FROM c),
         e AS (SELECT c_custkey, path, hits, pos, 9 AS pin FROM q JOIN d USING (p_name) WHERE path <> pin AND path <> 'size/1' UNION ALL SELECT c_custkey, pin, NULL, NULL, 1 FROM q UNION ALL SELECT c_custkey, 'size/1', NULL, NULL, 2 FROM q),
         f AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY pin, hits DESC, pos, path DESC) AS "at", path, hits FROM e)
    SELECT * FROM f WHERE "at" <= 64""")
def catalogue_shortlists(spark, sf_dir):
    """A part's line names the page of its brand and type and that of its size; a customer asks for a part by name, and has two pages pinned, one twice."""
    parts = table(spark, sf_dir, "part")
    page, size = F.concat_ws("/", "p_brand", "p_type"), F.concat(F.lit("size/"), F.col("p_size").cast("string"))
    lines = parts.select(F.col("p_partkey").alias("position"), F.concat_ws(" ", "p_name", "p_type").alias("line"), F.explode(F.array(page, size)).alias("path"))
    q = table(spark, sf_dir, "customer").join(parts, F.col("c_custkey") % 200 == F.col("p_partkey"))
    pins = q.select("c_custkey", F.posexplode(F.array(page, F.lit("size/1"), page)).alias("at", "path"))
    return front.shortlist(q, "c_custkey", F.concat(F.lit("Danh sách "), "p_name"), lines, pins)


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderstatus AS s, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(o_custkey AS VARCHAR) AS c FROM orders)
    SELECT o_orderkey, kind = 5 AS lists,
           CASE kind WHEN 0 THEN 'status,priority' WHEN 1 THEN 'start' WHEN 2 THEN 'pic' WHEN 3 THEN 'remaining' WHEN 4 THEN '' ELSE 'task,person' END AS fields,
           CASE kind WHEN 0 THEN 'Status=' || s || ';Priority=' || p WHEN 1 THEN 'Plan Start Date=' || d WHEN 2 THEN 'Related Assignee=' || c ELSE 'Status=' || s || ';Priority=' || p || ';Plan Start Date=' || d || ';Related Assignee=' || c END AS cells,
           CASE kind WHEN 0 THEN 'Trạng thái và ưu tiên?' WHEN 1 THEN 'Sprint 1 bắt đầu ngày nào Master schedule?' WHEN 2 THEN 'Ai phụ trách' WHEN 3 THEN 'Còn lại bao nhiêu...' WHEN 4 THEN 'authentication start Master schedule' ELSE 'Những người nào làm task ở Sprint 1' END AS asked
    FROM o""")
def asked_cells(spark, sf_dir):
    """An order's row of four cells and an empty one, and one of six questions."""
    o = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 6
    said = F.when(kind == 0, "Trạng thái và ưu tiên?").when(kind == 1, "Sprint đầu tiên bắt đầu ngày nào?").when(kind == 2, "Ai phụ trách").when(kind == 3, "Còn lại bao nhiêu...").when(kind == 4, "authentication start").otherwise("Những người nào làm task ở SPRINT ĐẦU")
    cell = lambda label, c: F.struct(F.lit(label).alias("label"), c.cast("string").alias("value"))
    cells = F.array(cell("Status", F.col("o_orderstatus")), cell("Priority", F.col("o_orderpriority")), cell("Plan Start Date", F.date_format("o_orderdate", "yyyy-MM-dd")), cell("Related Assignee", F.col("o_custkey")), cell("Remaining(h)", F.lit("")))
    # All that follows reads the folded question, which has a projection of its own.
    d = o.select("o_orderkey", said.alias("said"), cells.alias("cells")).withColumn("plain", text.fold(F.col("said")))
    shown = F.array_join(F.transform(front.asked_cells(F.col("cells"), F.col("plain")), lambda c: F.concat_ws("=", c["label"], c["value"])), ";")
    return d.select("o_orderkey", front.wants_list(F.col("plain")).alias("lists"), F.array_join(front.asked_fields(F.col("plain")), ",").alias("fields"), shown.alias("cells"), front.with_aliases(F.col("said")).alias("asked"))


@query("""
    WITH e AS (SELECT event_id, user_id, ts, event_type, '[KH] ' || lpad(CAST(event_id % 100 AS VARCHAR), 9, '0') AS who, event_id % 100 IN (SELECT c_custkey FROM customer) AS known FROM events),
         s AS (SELECT *, event_type NOT IN ('click', 'error') AND known AS bare, event_type <> 'error' AND known AS named FROM e),
         n AS (SELECT *, count(*) FILTER (WHERE named) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
         b AS (SELECT *, last_value(CASE WHEN event_type = 'click' AND known THEN 'task' WHEN bare AND before = 0 THEN 'bare' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM n)
    SELECT event_id, CASE WHEN bare AND base = 'task' THEN who || ' có bao nhiêu task?' WHEN bare AND base = 'bare' THEN 'vậy còn ' || who || ' thì sao?' END AS rewritten FROM b""")
def question_follow_ups(spark, sf_dir):
    """Clicks ask for a customer's tasks, errors for nothing, all others are no more than a customer's name; sessions are users."""
    who = F.concat(F.lit("[KH] "), F.lpad((F.col("event_id") % 100).cast("string"), 9, "0"))
    said = F.when(F.col("event_type") == "click", F.concat(who, F.lit(" có bao nhiêu task?"))).when(F.col("event_type") == "error", "xin chào").otherwise(F.concat(F.lit("vậy còn "), who, F.lit(" thì sao?")))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("[KH] "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("person"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", said.alias("question"))
    return front.follow_ups(e, "event_id", "user_id", ["ts"], people, "person")
