"""Queries of version diffs and moved plans; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import changes
from .catalogue import query, table


@query("""
    WITH l AS (SELECT doc_id, doc_id % 10 AS k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text <> '')
    SELECT doc_id, count(*) FILTER (WHERE k = 1 OR (k > 2 AND i % 7 <> 3 AND (i % 5 = 2 OR i % 9 = 4))) + count(*) FILTER (WHERE k > 2 AND i = 1) AS added_lines,
           count(*) FILTER (WHERE k = 0 OR (k > 2 AND (i % 7 = 3 OR i % 5 = 2))) AS removed_lines
    FROM l WHERE k <> 2 GROUP BY 1""")
def version_diffs(spark, sf_dir):
    """A document's second version has some lines left out, some rewritten and some added; a tenth each is of the first version alone, of the second alone, or unchanged."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    k = F.col("doc_id") % 10

    def rewritten(line, j):
        i = j + 1
        said = F.when(i % 5 == 2, F.concat(F.lit("new text of line "), i)).otherwise(line)
        more = F.when((i % 9 == 4) & (i % 5 != 2), F.array(said, F.concat(F.lit("new line after "), i))).otherwise(F.array(said))
        return F.when(i % 7 == 3, F.array().cast("array<string>")).otherwise(more)

    lines = F.concat(F.array(F.lit("new first line")), F.flatten(F.transform(F.split("text", "\n", -1), rewritten)))
    second = F.when(k > 2, F.array_join(lines, "\n")).otherwise(F.col("text"))
    return changes.version_diffs(d.where(k != 1), d.where(k != 0).select("doc_id", second.alias("text")), "doc_id", "text")


@query("""
    WITH RECURSIVE l AS (SELECT l_orderkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus) AS n, l_suppkey % 2 AS person, l_partkey % 2 AS grp, l_returnflag = 'R' AS be,
                   CAST(l_quantity AS BIGINT) * 30 + CASE WHEN l_discount > 0.05 THEN 240 ELSE 0 END AS minutes, l_linestatus FROM lineitem),
         t AS (SELECT *, n * 480 AS release, l_linestatus = 'F' AND n % 3 = 0 AS done FROM l),
         r AS (SELECT DISTINCT p, 0::BIGINT AS n, 0::BIGINT AS e0, 0::BIGINT AS e1, NULL::BIGINT AS b0, NULL::BIGINT AS b1, NULL::BIGINT AS on0, NULL::BIGINT AS on1, NULL::BIGINT AS blocker, 0::BIGINT AS begins, 0::BIGINT AS ends, 0::BIGINT AS release FROM t
               UNION ALL SELECT p, n, CASE WHEN person = 0 AND NOT done THEN ends ELSE e0 END, CASE WHEN person = 1 AND NOT done THEN ends ELSE e1 END, CASE WHEN be AND grp = 0 THEN ends ELSE b0 END, CASE WHEN be AND grp = 1 THEN ends ELSE b1 END,
                         CASE WHEN be AND grp = 0 THEN n ELSE on0 END, CASE WHEN be AND grp = 1 THEN n ELSE on1 END, blocker, ends - minutes, ends, release
               FROM (SELECT t.*, r.e0, r.e1, r.b0, r.b1, r.on0, r.on1, CASE WHEN be THEN NULL WHEN grp = 0 THEN on0 ELSE on1 END AS blocker,
                            minutes + CASE WHEN done THEN t.release ELSE greatest(t.release, CASE WHEN person = 0 THEN e0 ELSE e1 END, CASE WHEN be THEN 0 ELSE coalesce((CASE WHEN grp = 0 THEN b0 ELSE b1 END + 479) // 480 * 480, 0) END) END AS ends
                     FROM r JOIN t ON t.p = r.p AND t.n = r.n + 1))
    SELECT p * 1000 + n AS task, p * 1000 + blocker AS blocker, begins, ends, DATE '2026-07-27' + CAST(begins // 480 + 2 * (begins // 2400) AS INTEGER) AS first_day,
           DATE '2026-07-27' + CAST(greatest((ends + 479) // 480 - 1, begins // 480) + 2 * (greatest((ends + 479) // 480 - 1, begins // 480) // 5) AS INTEGER) AS last_day, begins > release AS moved FROM r WHERE n > 0""")
def late_tasks(spark, sf_dir):
    """An order is a sheet of two people and two groups of tasks, planned a day apart; those with a high discount need half a day more."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")).cast("long")
    minutes = F.col("l_quantity").cast("long") * 30 + F.when(F.col("l_discount") > 0.05, 240).otherwise(0)
    part = lambda c: F.col("l_orderkey") * 2 + F.col(c) % 2
    tasks = l.withColumn("place", n).select(
        (F.col("l_orderkey") * 1000 + F.col("place")).alias("task"), "place", part("l_suppkey").alias("person"), part("l_partkey").alias("grp"), F.when(F.col("l_returnflag") == "R", "BE").otherwise("FE").alias("role"),
        F.col("l_orderkey").alias("sheet"), (F.col("place") * 480).alias("release"), minutes.alias("minutes"), ((F.col("l_linestatus") == "F") & (F.col("place") % 3 == 0)).alias("done"),
    )
    return changes.rescheduled(tasks, F.lit("2026-07-27").cast("date"))
