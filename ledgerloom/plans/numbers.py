"""Queries of numbers in texts and of the gates over them; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbers
from .catalogue import query, table


@query()
def document_numbers(spark, sf_dir):
    """The numbers of every whole document by unit, and the dotted ones that only name something; no SQL engine here has the look-around of their patterns."""
    found = numbers.number_tokens(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return found.groupBy("doc_id", "kind", "unit").agg(F.count("*").alias("tokens"), F.count_distinct("value").alias("different"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS c, CAST(o_custkey * 2 + 1 AS VARCHAR) AS n, CAST(o_custkey * 2 + 3 AS VARCHAR) AS other, CAST((o_orderkey % 500) * 2 + 2 AS VARCHAR) AS m FROM orders),
         f AS (SELECT o_orderkey, other AS value, 'error' AS level, 'invented' AS fault, '' AS lost, 'hour' AS gained FROM o WHERE c = 1
               UNION ALL SELECT o_orderkey, n, 'error', 'dropped', 'hour', '' FROM o WHERE c IN (1, 5)
               UNION ALL SELECT o_orderkey, n, 'error', 'unit_changed', 'hour', 'minute' FROM o WHERE c = 2
               UNION ALL SELECT o_orderkey, m, 'warning', 'unit_lost', 'day', '' FROM o WHERE c = 3
               UNION ALL SELECT o_orderkey, m, unnest(['error', 'warning']), unnest(['invented', 'unit_gained']), '', 'day' FROM o WHERE c = 4)
    SELECT * FROM f""")
def number_transforms(spark, sf_dir):
    """An order is a rule of two numbers, rewritten in one of six ways: as it was, with another value, another unit, no unit, a value twice, a value less.

    The clause, the task and the dotted name are identifiers in either text, the dotted one only by what the first text says.
    """
    # A file of few row groups would leave the number search to few cores; only two numbers a row are shuffled for it.
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey")
    case, n, m = F.col("o_orderkey") % 6, F.col("o_custkey") * 2 + 1, ((F.col("o_orderkey") % 500) * 2 + 2).cast("string")
    name = F.concat(F.lit("7."), F.col("o_orderkey") % 90 + 10)
    head = F.concat(F.lit("Điều "), F.col("o_custkey"), F.lit(", NEX-"), F.col("o_orderkey"), F.lit(": "))
    hours = F.when(case == 5, "nothing").otherwise(F.concat(F.when(case == 1, n + 2).otherwise(n).cast("string"), F.when(case == 2, " phút").otherwise(" giờ")))
    days = F.when(case == 3, F.concat(F.lit("| "), m, F.lit(" | ngày |"))).when(case == 4, F.concat(m, F.lit(" ngày, "), m, F.lit(" ngày"))).otherwise(F.concat(m, F.lit(" ngày")))
    before = F.concat(head, n.cast("string"), F.lit(" giờ ("), m, F.lit(" ngày)\n"), name, F.lit(". Text"))
    after = F.concat(head, days, F.lit("; "), hours, F.lit(" in "), name, F.lit(" here"))
    f = numbers.transform_faults(o.select("o_orderkey", before.alias("before"), after.alias("after")), "o_orderkey", F.col("before"), F.col("after"))
    return f.withColumn("lost", F.array_join("lost", ",")).withColumn("gained", F.array_join("gained", ","))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_custkey AS c FROM orders)
    SELECT o_orderkey, CASE WHEN k = 1 THEN 'no_unit,' ELSE '' END || CASE WHEN k = 2 THEN 'no_source' WHEN k = 3 THEN 'not_a_number'
             WHEN c NOT IN (SELECT c_custkey FROM customer) THEN 'unknown_source' WHEN c % 7 = 0 THEN 'old_source' WHEN c % 11 = 0 THEN 'ocr_source'
             WHEN k = 4 THEN 'no_section' WHEN k IN (5, 6) THEN 'not_there' WHEN k = 7 THEN 'other_unit' ELSE '' END AS faults
    FROM o""")
def declared_facts(spark, sf_dir):
    """A customer is a document of two clauses, of which some are superseded and some guessed; an order declares a number of one of them.

    By its last digit it lacks a unit or a source, is no number, cites a clause that isn't there, the other clause's number, one of another document, or another unit; else it is right.
    """
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    body = F.concat(F.lit("# Rules\nĐiều 1. Within "), F.col("c_custkey") * 2 + 1, F.lit(" giờ at most.\nĐiều 2. After "), F.col("c_custkey") * 2 + 2, F.lit(" ngày, or later."))
    documents = c.select(F.col("c_custkey").alias("doc"), body.alias("body"), (F.col("c_custkey") % 7 != 0).alias("current"), (F.col("c_custkey") % 11 == 0).alias("ocr"))
    k, first = F.col("o_orderkey") % 10, F.col("o_orderkey") % 4 < 2
    own = F.col("o_custkey") * 2 + F.when(first, 1).otherwise(2)
    number = F.when(k == 5, F.col("o_custkey") * 2 + F.when(first, 2).otherwise(1)).when(k == 6, own + 2).when(k != 3, own).cast("double")
    unit = F.when(k == 7, "phút").when(k != 1, F.when(first, "hour").otherwise("Ngày"))
    place = F.when(k == 4, "Điều 9").otherwise(F.when(first, "điều  1").otherwise("Điều 2"))
    declared = o.select("o_orderkey", number.alias("number"), F.lit(None).cast("string").alias("day"), unit.alias("unit"), F.when(k != 2, F.col("o_custkey")).alias("doc"), place.alias("place"))
    f = numbers.declaration_faults(declared, documents, "o_orderkey", "doc", F.col("body"))
    # A lone no_unit keeps its comma, as it does beside another fault.
    return f.select("o_orderkey", F.regexp_replace(F.array_join("faults", ","), "^no_unit$", "no_unit,").alias("faults"))
