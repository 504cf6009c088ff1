"""Queries of questions answered in tiers; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers
from .catalogue import query, table


@query("""
    WITH q AS (SELECT o_orderkey AS k, o_orderkey % 8 AS kind, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS person, o_custkey, p_name, lower(p_type) AS p_type FROM orders JOIN part ON p_partkey = o_orderkey % 200),
         f AS (SELECT o_custkey, o_orderkey % 4 AS s, count(*) AS n FROM orders GROUP BY 1, 2), a AS (SELECT o_custkey, sum(n)::BIGINT AS n FROM f GROUP BY 1),
         known AS (SELECT c_custkey FROM customer),
         r AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS blob FROM part), b AS (SELECT DISTINCT p_name, p_type FROM q WHERE kind = 6),
         t AS (SELECT p_name, p_type, unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM b), u AS (SELECT DISTINCT t FROM t),
         i AS (SELECT t, ln((1.0 + (SELECT count(*) FROM r)) / (1 + count(p_partkey))) AS idf FROM u LEFT JOIN r ON contains(blob, t) GROUP BY 1),
         z AS (SELECT p_name, p_type, sum(idf) AS total FROM t JOIN i USING (t) GROUP BY 1, 2),
         h AS (SELECT t.p_name, t.p_type, p_partkey, round(sum(idf) / any_value(total), 9) AS share FROM t JOIN i USING (t) JOIN z USING (p_name, p_type) JOIN r ON contains(blob, t) GROUP BY 1, 2, 3),
         m AS (SELECT p_name, p_type, max(share) AS share FROM h GROUP BY 1, 2 HAVING max(share) >= 0.6),
         c AS (SELECT p_name, p_type, count(*) AS hits, CAST(min(p_partkey) AS VARCHAR) AS answer FROM h JOIN m USING (p_name, p_type, share) GROUP BY 1, 2)
    SELECT k AS o_orderkey, CASE WHEN kind < 3 THEN 1 WHEN kind IN (3, 4) AND o_custkey IN (SELECT c_custkey FROM known) THEN 2 WHEN kind = 6 AND c.hits IS NOT NULL THEN 3 ELSE 4 END AS tier,
           CASE WHEN kind = 0 THEN 'action' WHEN kind = 1 THEN 'several_sprints' WHEN kind = 2 THEN 'other_scope' WHEN kind IN (3, 4) AND o_custkey IN (SELECT c_custkey FROM known) THEN 'fact' WHEN kind = 6 AND c.hits IS NOT NULL THEN 'cells' ELSE 'nothing' END AS rule,
           CASE WHEN kind = 3 AND o_custkey IN (SELECT c_custkey FROM known) THEN 'found' WHEN kind = 4 AND o_custkey IN (SELECT c_custkey FROM known) THEN CASE WHEN f.n IS NULL THEN 'no' ELSE 'found' END WHEN kind = 6 AND c.hits IS NOT NULL THEN 'found' ELSE 'missing' END AS outcome,
           CASE WHEN kind = 3 AND o_custkey IN (SELECT c_custkey FROM known) THEN CAST(a.n AS VARCHAR) WHEN kind = 4 AND o_custkey IN (SELECT c_custkey FROM known) THEN CAST(f.n AS VARCHAR) WHEN kind = 6 THEN c.answer END AS answer,
           CASE WHEN kind = 3 AND o_custkey IN (SELECT c_custkey FROM known) THEN 1 WHEN kind = 4 AND f.n IS NOT NULL AND o_custkey IN (SELECT c_custkey FROM known) THEN 1 WHEN kind = 6 THEN coalesce(c.hits, 0) ELSE 0 END AS hits
    FROM q LEFT JOIN a USING (o_custkey) LEFT JOIN f ON f.o_custkey = q.o_custkey AND f.s = 2 LEFT JOIN c ON q.kind = 6 AND c.p_name = q.p_name AND c.p_type = q.p_type""")
def tiered_answers(spark, sf_dir):
    """An order is a question of one of eight kinds: a change, sprints in a row, a quarter, a customer's tasks, those of a sprint, why, a part's words, one word."""
    o, kind = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 8
    person = lambda c: F.concat(F.lit("Customer#"), F.lpad(F.col(c).cast("string"), 9, "0"))
    parts = table(spark, sf_dir, "part")
    cells = F.concat_ws(" ", "p_name", F.lower("p_type"))
    said = F.when(kind == 0, "Cập nhật trạng thái task").when(kind == 1, "effort sprint 3 đến sprint 1").when(kind == 2, "bao nhiêu task quý 2")
    said = said.when(kind == 3, F.concat(person("o_custkey"), F.lit(" có bao nhiêu task?"))).when(kind == 4, F.concat(person("o_custkey"), F.lit(" có bao nhiêu task ở Sprint 2")))
    said = said.when(kind == 5, F.concat(F.lit("Vì sao "), person("o_custkey"), F.lit(" ?"))).when(kind == 6, cells).otherwise("xem")
    q = o.join(parts, F.col("o_orderkey") % 200 == F.col("p_partkey")).select("o_orderkey", said.alias("question"))
    by_sprint = o.groupBy(person("o_custkey").alias("person"), (F.col("o_orderkey") % 4).cast("int").alias("sprint")).agg(F.count("*").alias("value"))
    over_all = by_sprint.groupBy("person").agg(F.sum("value").alias("value")).select("person", F.lit(None).cast("int").alias("sprint"), "value")
    facts = by_sprint.unionByName(over_all).withColumn("measure", F.lit("tasks"))
    tiers = [
        answers.guard_tier("o_orderkey"),
        answers.fact_tier("o_orderkey", facts, table(spark, sf_dir, "customer"), "c_name", {"tasks": "bao nhieu task"}, ("tasks",)),
        answers.cell_tier("o_orderkey", parts, "p_partkey", text.fold(cells)),
    ]
    return answers.tiered(q, "o_orderkey", "question", tiers)
