"""Queries of tabs found by their headers, and of access, uploads and reuse; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tabs
from .catalogue import query, table


def _cells(rows: DataFrame, sheet: str, row, values: dict) -> DataFrame:
    """Cells of columns by their places."""
    a = F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in values.items()])
    return rows.select(F.col(sheet).alias("sheet"), row.cast("int").alias("row"), F.explode(a).alias("x")).select("sheet", "row", "x.col", "x.value")


def _fixed(rows: DataFrame, sheet: str, cells: list[tuple[int, int, str]]) -> DataFrame:
    """The same cells for each sheet."""
    a = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in cells])
    return rows.select(F.col(sheet).alias("sheet")).distinct().select("sheet", F.explode(a).alias("x")).select("sheet", "x.*")


@query("""
    WITH s AS (SELECT s_suppkey AS k, s_nationkey % 3 AS sheet, CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE 'U' || lpad(CAST(s_suppkey // 2 AS VARCHAR), 7, '0') END AS id, s_name FROM supplier),
         p AS (SELECT *, row_number() OVER (PARTITION BY sheet, id ORDER BY k) AS n FROM s WHERE sheet < 2)
    SELECT sheet, CAST(k + 10 AS INTEGER) AS "row", CASE WHEN id = 'n/a' THEN 'no_id' WHEN k % 5 IN (1, 2) THEN 'off' ELSE 'present' END AS state, CASE WHEN id <> 'n/a' THEN id END AS id, s_name AS name, CASE WHEN k % 2 = 0 THEN 'qa' ELSE 'dev' END AS role,
           CASE WHEN id <> 'n/a' THEN CASE k % 5 WHEN 0 THEN 8.0 WHEN 1 THEN 0.0 WHEN 3 THEN 7.5 END END AS hours FROM p WHERE id = 'n/a' OR n = 1
    UNION ALL SELECT DISTINCT 2, NULL, 'no_header', NULL, NULL, NULL, NULL::DOUBLE FROM s WHERE sheet = 2""")
def person_grid(spark, sf_dir):
    """Suppliers are people of three sheets, one without a header; a day's number stands under two months."""
    s = table(spark, sf_dir, "supplier").withColumn("sheet", F.col("s_nationkey") % 3)
    k = F.col("s_suppkey")
    uid = F.when(k % 7 == 0, "n/a").otherwise(F.concat(F.lit("U"), F.lpad(F.expr("s_suppkey div 2").cast("string"), 7, "0")))
    hours = F.get(F.array(*map(F.lit, ("8", " 0 ", "Nghỉ  phép", "7,5", "abc"))), (k % 5).cast("int"))
    body = _cells(s, "sheet", k + 10, {2: F.col("s_name"), 3: uid, 5: F.when(k % 2 == 0, "qa").otherwise("dev"), 7: F.lit("1"), 9: hours})
    top = [(1, 1, "Plan"), (3, 2, " Member "), (3, 3, "SLACK  ID"), (3, 5, "Vai trò"), (3, 6, "June"), (3, 8, "Tháng 7"), (4, 6, "29"), (4, 7, "30"), (4, 8, "29"), (4, 9, "30"), (4, 10, "31"), (5, 2, "Sum"), (6, 2, "July")]
    head = _fixed(s, "sheet", top).where("sheet < 2 or row <> 3")
    return tabs.person_grid(body.union(head.select(body.columns)), F.lit("2026-07-30").cast("date")).drop("slack_name")


@query("""
    WITH c AS (SELECT c_custkey AS k, c_nationkey AS sheet, c_name, c_mktsegment FROM customer)
    SELECT sheet, CAST(k + 2 AS INTEGER) AS "row", NULL AS fault, 'R-' || k AS id, c_mktsegment AS priority, CASE WHEN k % 5 = 0 THEN '' ELSE 'Open' END AS status, CASE WHEN sheet % 3 = 0 THEN c_name WHEN k % 3 = 0 THEN c_mktsegment ELSE c_name || ' / ' || c_mktsegment END AS related
    FROM c WHERE sheet % 3 < 2 AND k % 4 > 0 UNION ALL SELECT DISTINCT sheet, NULL, 'Status, Related Assignee/Task', NULL, NULL, NULL, NULL FROM c WHERE sheet % 3 = 2""")
def issue_tabs(spark, sf_dir):
    """Customers are rows of a tab for each nation, of three kinds: one column of who and what, two, and tabs without their columns."""
    c = table(spark, sf_dir, "customer")
    k, kind = F.col("c_custkey"), F.col("c_nationkey") % 3
    id_, state = F.when(k % 4 > 0, F.concat(F.lit(" R-"), k.cast("string"))), F.when(k % 5 > 0, "Open ")
    what = {0: {1: id_, 2: F.col("c_mktsegment"), 3: state, 8: F.col("c_name")}, 1: {9: id_, 4: state, 5: F.col("c_mktsegment"), 6: F.when(k % 3 > 0, F.col("c_name")), 7: F.col("c_mktsegment")}, 2: {1: id_, 2: state}}
    heads = {0: ["ID", "Priority", "Status", "Date Detected", "Description", "Next Action", "Notes", "Related Assignee/Task"], 1: ["Date Detected", "Description", "Next Action", "Status", "Priority", "Related Assignee", "Related Task", "Notes", " ID "], 2: ["ID", "Priority", "State", "Date Detected", "Description", "Next Action", "Notes", "Related Assignee"]}
    cells = None
    for n in what:
        own = c.where(kind == n)
        part = _cells(own, "c_nationkey", k + 2, what[n]).union(_fixed(own, "c_nationkey", [(1, i + 1, h) for i, h in enumerate(heads[n])]))
        cells = part if cells is None else cells.union(part)
    return tabs.issue_rows(cells).select("sheet", "row", "fault", "id", "priority", "status", "related")


@query("""
    WITH c AS (SELECT c_custkey AS k, (SELECT 1) AS one FROM customer),
         f AS (SELECT o_custkey AS k, count(*) AS cells, count(*) FILTER (o_orderkey % 40 <> 0) AS told, count(*) FILTER (o_orderkey % 40 = 0) AS extra, count(*) FILTER (o_orderkey % 40 <> 0 AND o_orderkey % 30 = 0 AND o_orderkey % 60 <> 0) AS wrong FROM orders GROUP BY 1)
    SELECT 'd' || k AS doc_id, CASE WHEN k % 19 = 0 THEN 'not a sheet' WHEN k % 17 = 0 THEN 'original changed' WHEN k % 13 = 0 THEN 'artifact missing' WHEN k % 11 = 0 THEN 'page differs from raw' WHEN k % 23 = 0 THEN 'facts of another version' WHEN cells IS NULL THEN 'no cells'
           WHEN k % 2 = 0 AND told > 0 AND k % 7 = 0 THEN 'review of another file' WHEN k % 2 = 0 AND told > 0 AND extra > 0 THEN 'cells extra' WHEN k % 2 = 0 AND told > 0 AND wrong > 0 THEN 'cells differ' ELSE 'pass' END AS status,
           coalesce(cells, 0) AS cells, CASE WHEN k % 2 = 0 AND told > 0 THEN told END AS reviewed
    FROM c LEFT JOIN f USING (k)""")
def sheet_contract(spark, sf_dir):
    """A customer is a sheet, orders are its cells; even ones were reviewed, without some cells and with other values."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    doc = F.concat(F.lit("d"), k.cast("string"))
    registry = c.select(doc.alias("doc_id"), F.lit(2).alias("version"), F.when(k % 19 == 0, "van").otherwise("spreadsheet").alias("extractor"), F.sha2(doc, 256).alias("sha256"), F.when(k % 17 != 0, F.sha2(doc, 256)).alias("original_sha256"))
    kinds = c.select(k, doc.alias("doc_id"), F.explode(F.array(*map(F.lit, ("raw", "page", "facts")))).alias("kind")).where("not (kind = 'page' and c_custkey % 13 = 0)")
    raw, page = F.concat(F.lit("raw/"), "doc_id", F.lit(".md")), F.concat(F.lit("wiki/sources/"), "doc_id", F.lit(".md"))
    files = kinds.select("doc_id", "kind", F.when(F.col("kind") == "page", page).otherwise(raw).alias("path"), F.col("doc_id").alias("said_doc"), F.when((F.col("kind") == "facts") & (k % 23 == 0), 1).otherwise(2).alias("said_version"), F.when((F.col("kind") == "page") & (k % 11 == 0), "x").otherwise("body").alias("body_sha256"), F.array(raw).alias("raw_paths"), F.lit(True).alias("machine"))
    own = o.join(c.select(k), F.col("o_custkey") == k)
    cells = own.select(doc.alias("doc_id"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderkey") % 60 != 0, F.col("o_orderstatus")).alias("value"), F.when(F.col("o_orderkey") % 60 == 0, "=A1").alias("formula"))
    seen = own.where((k % 2 == 0) & (F.col("o_orderkey") % 40 != 0))
    review = seen.select(doc.alias("doc_id"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderkey") % 60 == 0, "").when(F.col("o_orderkey") % 30 == 0, "?").otherwise(F.col("o_orderstatus")).alias("value"), F.when(F.col("o_orderkey") % 60 == 0, "=A1").alias("formula"), F.when(k % 7 == 0, "x").otherwise(F.sha2(doc, 256)).alias("sha256"))
    return tabs.sheet_contract(registry, files, cells, review)


@query("""
    SELECT c_custkey, c_custkey % 5 > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AS allowed, CASE WHEN c_custkey % 5 = 0 THEN 'no_actor' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'role' ELSE 'no_role' END AS reason FROM customer""")
def project_access(spark, sf_dir):
    """customers ask for an internal project with their segments as roles; some have no name."""
    actors = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise(" ").alias("actor"), F.array("c_mktsegment", F.lit("guest")).alias("roles"))
    return tabs.project_gate(actors, "internal", {"internal": ("BUILDING", "MACHINERY")}).select("c_custkey", "allowed", "reason")


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_totalprice * 1000 AS BIGINT) AS size FROM orders)
    SELECT k AS o_orderkey, CASE WHEN c IS NULL OR c % 9 = 0 THEN 'no_actor' WHEN c % 3 = 1 OR c NOT IN (SELECT c_custkey FROM customer) THEN 'not_allowed' WHEN k % 13 = 0 THEN 'missing' WHEN k % 17 = 0 THEN 'link' WHEN k % 11 = 0 THEN 'guarded' WHEN size > 104857600 THEN 'too_large' WHEN k % 4 >= 2 THEN 'kind'
           WHEN k % 6 = 0 THEN 'awaiting_identity' WHEN k % 6 <= 2 THEN 'ready_to_ingest' WHEN k % 6 = 3 THEN 'duplicate' WHEN k % 6 = 4 THEN 'no_op' ELSE 'blocked' END AS status,
           CASE WHEN k % 13 = 0 OR k % 5 = 0 THEN 'gone' WHEN k % 17 = 0 THEN 'link' WHEN k % 4 = 0 THEN 'changed' ELSE 'same' END AS source
    FROM o""")
def upload_decisions(spark, sf_dir):
    """An order is an upload by its customer, and a proposal whose file may be gone or changed before it runs."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.when(k % 13 == 0, None).when(k % 11 == 0, F.concat(F.lit("/kb/raw/"), k.cast("string"))).otherwise(F.concat(F.lit("/kb/rawest/"), k.cast("string")))
    actor = F.when(F.col("o_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit("U"), F.col("o_custkey").cast("string")))
    kind = F.get(F.array(F.lit("pdf"), F.lit("csv"), F.lit("exe"), F.lit(None)), (k % 4).cast("int"))
    flow = F.get(F.array(*map(F.lit, ("identity_review", "initial_ingest", "reingest", "duplicate", "no_op", "other"))), (k % 6).cast("int"))
    r = o.select(k, actor.alias("actor"), path.alias("path"), (k % 17 == 0).alias("is_link"), (F.col("o_totalprice") * 1000).cast("long").alias("size"), kind.alias("kind"), flow.alias("flow"), F.sha2(k.cast("string"), 256).alias("sha256"))
    allowed = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 1").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("actor"))
    staged = r.where("path is not null and o_orderkey % 5 <> 0").select("path", "is_link", F.when(k % 4 != 0, F.col("sha256")).otherwise("x").alias("sha256"))
    return tabs.still_there(tabs.uploads(r, allowed, "/kb"), staged).select(k, "status", "source")


@query("""
    WITH p AS (SELECT l_suppkey AS d, l_orderkey % 3 AS v, 'd' || l_linenumber % 2 AS dom, CASE WHEN l_partkey % 2 = 0 THEN 's' || l_partkey % 5 END AS sec, l_returnflag = 'A' AS rej, 'p' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS path
               FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'R' AND (l_returnflag <> 'A' OR l_partkey % 2 = 1)),
         b AS (SELECT d, v, dom, sec, min((rej, path)) AS best FROM p GROUP BY ALL)
    SELECT o_orderkey, best[2] AS path FROM orders LEFT JOIN b ON d = o_custkey % 100 AND v = o_orderkey % 3 AND dom = 'd' || o_orderkey // 3 % 2 AND sec IS NOT DISTINCT FROM CASE WHEN o_orderkey // 6 % 2 = 0 THEN 's' || o_orderkey % 5 END""")
def reusable_pages(spark, sf_dir):
    """an order is a scope of a supplier's document; lines are pages of it, some turned down, of two raw files, or not valid today."""
    part = lambda c, s: F.when(c, F.concat(F.lit("s"), (s % 5).cast("string")))
    raw = F.concat(F.lit("raw/"), F.col("l_suppkey").cast("string"))
    sec = part(F.col("l_partkey") % 2 == 0, F.col("l_partkey"))
    path = F.concat(F.lit("p"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))
    pages = table(spark, sf_dir, "lineitem").select(path.alias("path"), (F.col("l_returnflag") == "A").alias("rejected"), F.lit("source").alias("page"), F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 3).alias("version"), F.concat(F.lit("d"), (F.col("l_linenumber") % 2).cast("string")).alias("domain"), F.lit("internal").alias("visibility"),
                                                    F.when(F.col("l_returnflag") == "R", F.array(raw, F.lit("x"))).otherwise(F.array(raw)).alias("raw_paths"), sec.alias("section"), F.when(sec.isNotNull(), F.concat(F.lit("wiki/sources/"), F.col("l_suppkey").cast("string"), F.lit(".md"))).alias("part_of"), (F.col("l_quantity") > 10).alias("valid"), F.lit(True).alias("complete"))
    k = F.col("o_orderkey")
    scopes = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 100).alias("doc_id"), (k % 3).alias("version"), F.concat(F.lit("d"), (F.expr("o_orderkey div 3") % 2).cast("string")).alias("domain"), F.lit("internal").alias("visibility"), F.concat(F.lit("raw/"), (F.col("o_custkey") % 100).cast("string")).alias("raw_path"), part(F.expr("o_orderkey div 6") % 2 == 0, k).alias("section"))
    return tabs.reusable_pages(scopes, pages, "o_orderkey")


@query("""
    SELECT event_id, event_type AS subtype, 'password: [REDACTED]' AS note, 'u' || user_id AS by_user, CASE WHEN event_id % 2 = 0 THEN 'Bearer [REDACTED]' ELSE event_type END AS mark, 3 AS fields FROM events""")
def safe_metadata(spark, sf_dir):
    """An event is a message with files, reactions and columns that are not kept."""
    mark = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Bearer abcdefghijkl"), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    files = F.array(F.struct(F.concat(F.lit("password: p"), F.col("event_id").cast("string")).alias("note"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("by_user")))
    m = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("subtype"), files.alias("files"), F.create_map(F.lit("password: x"), mark).alias("reactions"), F.lit("secret").alias("blocks"))
    safe = m.select("event_id", tabs.safe_metadata(m).alias("s"))
    return safe.select("event_id", "s.subtype", F.get("s.files", F.lit(0))["note"].alias("note"), F.get("s.files", F.lit(0))["by_user"].alias("by_user"), F.element_at("s.reactions", "password: x").alias("mark"), F.lit(len(safe.schema["s"].dataType.fields)).alias("fields"))
