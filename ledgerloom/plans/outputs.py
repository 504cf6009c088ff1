"""Queries of what is written and given out; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outputs
from .catalogue import query, table


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders)
    SELECT k % 3 AS sheet, k AS "row", CAST(p AS VARCHAR) AS value, CASE WHEN k % 10 = 0 THEN CAST(CAST(round(p * 100) AS BIGINT) AS VARCHAR) ELSE 'n/a' END AS got FROM o WHERE k % 10 = 0 OR k % 33 = 1""")
def unconfirmed_updates(spark, sf_dir):
    """An order is a line of a report, set in one of three sheets; some cells lose their decimal point, or show no number."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    spoken = F.concat(F.replace(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("h"))
    reports = o.select((k % 3).alias("sheet"), k.alias("row"), F.lit("8").alias("re_est"), F.lit(" 01-01-2026").alias("start"), F.when(k % 2 == 0, "Chưa").otherwise("02-01-2026").alias("end"), spoken.alias("actual"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note"))
    layout = spark.range(3).select(F.col("id").alias("sheet"), F.posexplode(F.array(*map(F.lit, ("re_est", "start", "end", "actual", "status", "note")))).alias("i", "field")).select("sheet", "field", (F.col("i") * 2 + F.col("sheet") + 1).alias("col"))
    updates = outputs.report_cells(reports, layout)
    old = o.select((k % 3).alias("sheet"), k.alias("row"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("col"), F.lit("old").alias("value"))
    now = outputs.written(old, updates)
    actual, row = F.col("col") == 7 + F.col("sheet"), F.col("row")
    shown = F.when(actual & (row % 10 == 0), F.replace(F.col("value").cast("double").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(""))).when(actual & (row % 33 == 1), "n/a").otherwise(F.col("value"))
    d = outputs.unconfirmed(updates, now.withColumn("value", shown))
    return d.withColumn("value", F.regexp_replace(F.col("value").cast("double").cast("decimal(12,2)").cast("string"), r"(\.\d)0$", "$1"))


@query("""
    WITH r AS (SELECT c_nationkey AS tab, max(c_custkey % 500) AS id, max(c_custkey) + 2 AS r FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1),
         o AS (SELECT o_custkey % 30 AS tab, o_orderkey, o_custkey, CAST(o_orderkey % 80 AS DOUBLE) / 8 AS h, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P')
    SELECT tab, coalesce(r, 1) + n AS "row", 'R-' || CASE WHEN coalesce(id, 0) + n < 10 THEN '0' ELSE '' END || (coalesce(id, 0) + n) AS id, CASE WHEN o_custkey % 7 = 0 THEN 'Dev' ELSE 'c' || o_custkey END || ' vượt ' || regexp_replace(CAST(h AS VARCHAR), '\\.0$', '') || 'h ở task ORD-' || o_orderkey || ': x' AS description,
           CASE WHEN h >= 4 THEN 'High' ELSE 'Medium' END AS priority, CASE WHEN tab % 2 = 0 THEN CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'c' || o_custkey END ELSE CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'c' || o_custkey || '/' END || 'ORD-' || o_orderkey END AS related,
           'PM review giờ vượt' AS next_action, 'Open' AS status, 'Ghi tự động từ report Slack ngày 03-07-2026' AS notes
    FROM o LEFT JOIN r USING (tab)""")
def appended_risks(spark, sf_dir):
    """Pending orders are overtime that tabs of risks take in below the customers of a nation; some tabs are empty."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    k = F.col("c_custkey")
    risks = c.select(F.col("c_nationkey").alias("tab"), (k + 2).alias("row"), F.when(k % 3 == 0, "other").otherwise(F.concat(F.lit(" R-"), (k % 500).cast("string"))).alias("id")).where("c_custkey % 3 > 0")
    text_ = F.lit(None).cast("string")
    overs = o.select((F.col("o_custkey") % 30).alias("tab"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("task"), F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("assignee"), text_.alias("reporter"), F.lit(" x ").alias("reason"), ((F.col("o_orderkey") % 80) / 8).alias("hours"), text_.alias("priority"), text_.alias("next_action"), "o_orderdate", "o_orderkey")
    return outputs.appended_risks(risks, overs, F.lit("2026-07-03").cast("date"), ["o_orderdate", "o_orderkey"], F.col("tab") % 2 == 0)


@query("""
    WITH a AS (SELECT l_orderkey AS r, 'derived/' || ['facts', 'graph', 'rag', 'chroma/x', 'chroma/y', 'bm25', 'z'][l_linenumber] AS path, max(l_partkey) AS size FROM lineitem GROUP BY ALL),
         g AS (SELECT r, count(*) AS files, sum(size)::BIGINT AS bytes, list(path) AS ps, sha256(string_agg(path || chr(9) || sha256(path || r), chr(10) ORDER BY path)) AS digest FROM a GROUP BY 1),
         m AS (SELECT o_orderkey AS r, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, digest, concat_ws(',', CASE WHEN NOT coalesce(list_contains(ps, 'derived/facts'), false) THEN 'derived/facts' END, CASE WHEN NOT coalesce(list_contains(ps, 'derived/graph'), false) THEN 'derived/graph' END,
               CASE WHEN NOT coalesce(list_has_any(ps, ['derived/chroma/x', 'derived/chroma/y']), false) THEN 'derived/chroma/' END) AS missing FROM orders LEFT JOIN g ON r = o_orderkey)
    SELECT r AS "release", CASE WHEN r % 9 = 0 THEN 'stale' WHEN missing <> '' THEN 'incomplete' ELSE 'ready' END AS status, missing, files, bytes, digest FROM m""")
def release_manifests(spark, sf_dir):
    """An order is a release, its lines are files."""
    name = F.get(F.array(*map(F.lit, ("facts", "graph", "rag", "chroma/x", "chroma/y", "bm25", "z"))), F.col("l_linenumber").cast("int") - 1)
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("release"), F.concat(F.lit("derived/"), name).alias("path")).agg(F.max("l_partkey").alias("size"))
    files = files.withColumn("sha256", F.sha2(F.concat("path", F.col("release").cast("string")), 256))
    k = F.col("o_orderkey")
    releases = table(spark, sf_dir, "orders").select(k.alias("release"), F.sha2(k.cast("string"), 256).alias("told_sha256"), F.when(k % 9 > 0, F.sha2(k.cast("string"), 256)).alias("input_sha256"))
    return outputs.release_manifests(files, releases, ("derived/graph", "derived/facts"), ("derived/chroma/",)).withColumn("missing", F.array_join("missing", ","))


@query("""
    WITH p AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_custkey % 5 = 0 AS person, c_custkey % 4 = 1 AS policy, c_custkey % 3 = 0 AS own FROM customer),
         c AS (SELECT k, CASE WHEN person THEN CASE WHEN own THEN 'team' END WHEN policy THEN 'internal' WHEN own OR seg = 'BUILDING' THEN 'project' WHEN k % 2 = 0 THEN 'internal' END AS c FROM p),
         m AS (SELECT k, unnest([CASE WHEN c = 'internal' AND k % 7 > 0 THEN 'company-basics' END, CASE WHEN c = 'internal' AND (k % 10 BETWEEN 3 AND 9 OR k % 7 = 0) THEN 'workplace-practice' END, CASE WHEN c = 'project' THEN 'project-context' END,
               CASE WHEN c = 'team' THEN 'team-workflow' END, CASE WHEN c IN ('project', 'team') THEN 'role-readiness' END, CASE WHEN c IN ('project', 'team') THEN 'first-delivery' END]) AS module FROM c)
    SELECT k AS page, module FROM m WHERE module IS NOT NULL""")
def handbook_modules(spark, sf_dir):
    """A customer is a page of a person, a policy, the project or none."""
    k = F.col("c_custkey")
    said = F.concat_ws(" ", F.lit("page"), F.when(k % 4 == 1, "noi-quy"), F.when(k % 3 == 0, "nexus-plan"))
    pages = table(spark, sf_dir, "customer").select(k.alias("page"), F.concat(F.lit("Chương "), (k % 10).cast("string")).alias("title"), F.when(k % 7 == 0, "van--chuong-4.md").otherwise("van.md").alias("relative"), F.when(k % 5 == 0, "entity-person").otherwise("source").alias("page_type"), said.alias("searchable"), F.when(F.col("c_mktsegment") == "BUILDING", "NEXUS").alias("project"), F.when(k % 2 == 0, "internal").otherwise("public").alias("visibility"))
    return outputs.modules(pages, "Nexus", "developer")


@query("""
    WITH h AS (SELECT c_custkey AS k, c_custkey % 2 > 0 AS a, c_custkey % 3 > 0 AS b, c_custkey % 5 > 0 AS c, c_custkey % 7 > 0 AS d, c_custkey % 11 > 0 AS e FROM customer)
    SELECT k AS c_custkey, CAST(round(100.0 * (2 + a::INT + b::INT + c::INT + d::INT + e::INT) / 7) AS INTEGER) AS score, a AND b AND c AND d AND e AS passed, b AS role_profile, d AS source_citations, 2 AS modules, CAST(CASE WHEN e THEN 2 ELSE 1 END AS INTEGER) AS citations
    FROM h""")
def handbook_quality(spark, sf_dir):
    """A customer is a handbook that lacks some of what it must hold."""
    k = F.col("c_custkey")
    scope = lambda s: F.lit(f"- **Scope:** `{s}`")
    body = F.concat_ws("\n", F.lit("# Handbook\n## 1. Hồ sơ đào tạo\n## 2.\n### 2.1 Một\n### 2.2 Hai\n## 3.\n## 4.\n## 5."), F.when(k % 2 > 0, "## 6."), F.when(k % 3 > 0, scope("role_guidance")).otherwise(scope("role")), scope("policy_fixed"), scope("policy_fixed"), scope("project_dynamic"),
                       F.when(k % 5 > 0, scope("project_dynamic")), F.when(k % 7 > 0, "Nguồn: `a`").otherwise("Nguồn: `raw/a.md`"), F.lit("Freshness KB\n- **Coverage:** `partial`"), F.when(k % 11 > 0, "[Chưa có trong KB]\nNguồn: b"))
    d = table(spark, sf_dir, "customer").select(k, outputs.handbook_quality(body).alias("q"))
    return d.select(k, "q.score", "q.passed", F.col("q.checks")["role_profile"].alias("role_profile"), F.col("q.checks")["source_citations"].alias("source_citations"), "q.modules", "q.citations")


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""")
def reply_objects(spark, sf_dir):
    """An event's properties come back bare, among words, in a fence, cut off, or as a list."""
    p, n = F.col("props"), F.col("event_id") % 5
    raw = F.when(n == 0, F.concat(F.lit(" "), p, F.lit("\n"))).when(n == 1, F.concat(F.lit("Here: "), p, F.lit(" done"))).when(n == 2, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 3, F.concat(p, F.lit(" and "), p)).otherwise(F.concat(F.lit("["), F.rtrim(F.substring_index(p, ":", -1)), F.lit(", 1]")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(outputs.json_object(raw), "$.k").cast("int").alias("k"))


@query("""
    SELECT c_custkey, 'R' || c_custkey % 3 AS rule, DATE '2026-07-03' AS date_detected, 'late by ' || c_custkey % 9 AS description, CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_custkey ELSE c_name END AS related, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ask' ELSE 'move' END AS next_action, CAST(c_custkey % 3 AS INTEGER) AS options
    FROM customer""")
def described_items(spark, sf_dir):
    """A customer is an item of a rule with no, one or two options of what to do next."""
    k = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(k, "c_name", F.concat(F.lit("R"), (k % 3).cast("string")).alias("rule"), F.concat(F.lit("c"), k.cast("string")).alias("ref"))
    options = F.when(k % 3 == 1, F.array(F.lit("ask"))).when(k % 3 == 2, F.array(F.lit("move"), F.lit("ask")))
    d = outputs.described(items, F.lit("2026-07-03").cast("date"), F.concat(F.lit("late by "), (k % 9).cast("string")), options, F.when(k % 4 > 0, F.col("c_name")).otherwise(""))
    return d.select(k, "rule", "date_detected", "description", "related", "next_action", F.size("options").alias("options"))
