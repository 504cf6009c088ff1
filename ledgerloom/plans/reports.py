"""Queries of reports, guards, slices and lookups; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from .catalogue import query, table


@query("""
    WITH t AS (SELECT user_id AS person, CAST(ts AS DATE) AS day, event_id % 9 AS task, sum(coalesce(value, 0)) AS h, count(*) AS n, min(event_id) FILTER (WHERE event_type <> 'error') AS f FROM events GROUP BY ALL)
    SELECT person, day, round(sum(h), 4) AS hours, CAST(sum(n) AS BIGINT) AS entries, coalesce(string_agg(CAST(task AS VARCHAR), ',' ORDER BY f) FILTER (WHERE f IS NOT NULL), '') AS open_tasks FROM t GROUP BY ALL""")
def logged_hours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reports.logged_hours(e.select(F.col("user_id").alias("person"), F.col("ts").cast("date").alias("day"), (F.col("event_id") % 9).alias("task"), F.col("value").alias("delta"), (F.col("event_type") != "error").alias("open"), F.col("event_id").alias("seq")))


@query("""
    WITH s AS (SELECT o_custkey AS person, count(*) FILTER (WHERE o_orderstatus <> 'P') AS logs, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice >= 400000) AS bad FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT c_custkey AS person, CASE WHEN logs IS NULL THEN 'not_reported' WHEN logs > 0 AND bad = 0 THEN 'reported' ELSE 'bad_format' END AS verdict FROM customer LEFT JOIN s ON c_custkey = person""")
def report_verdicts(spark, sf_dir):
    """Replies are urgent orders; pending ones are no log lines."""
    lines = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("person"), (F.col("o_orderstatus") != "P").alias("is_log"), (F.col("o_totalprice") < 400000).alias("valid"))
    return reports.report_verdicts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person")), lines)


@query("SELECT name, string_agg(DISTINCT value, ',' ORDER BY value) AS value_list FROM (SELECT 'o_orderstatus' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY 1")
def observed_values(spark, sf_dir):
    return reports.observed(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT count(DISTINCT conv_id) AS threads, count(*) AS messages FROM conversations")
def thread_totals(spark, sf_dir):
    return reports.thread_totals(table(spark, sf_dir, "conversations"), "conv_id")


@query("WITH h AS (SELECT event_type, event_id FROM events WHERE value IS NOT NULL AND value > 90) SELECT h.event_type, n, event_id FROM h JOIN (SELECT event_type, count(*) AS n FROM h GROUP BY 1) USING (event_type)")
def scoped_rows(spark, sf_dir):
    """Only values above 90 count as filled in."""
    e = table(spark, sf_dir, "events").withColumn("cell", F.when(F.col("value") > 90, F.col("value")))
    return reports.scoped_rows(e, "event_type", "cell", "event_id")


@query("SELECT o_custkey AS person, count(*) AS tasks FROM orders GROUP BY 1")
def people_by_tasks(spark, sf_dir):
    return reports.people_by_tasks(table(spark, sf_dir, "orders"), "o_custkey")


@query("""
    WITH f AS (SELECT l_partkey, bool_or(l_quantity > 45) AS p, bool_or(l_quantity < 3) AS g FROM lineitem GROUP BY 1)
    SELECT p_partkey, CASE WHEN p AND g THEN 'partial' WHEN p THEN 'covered' ELSE 'not_in_kb' END AS coverage FROM part LEFT JOIN f ON p_partkey = l_partkey""")
def module_coverage(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return reports.module_coverage(table(spark, sf_dir, "part"), lines.where("l_quantity > 45"), lines.where("l_quantity < 3"), "p_partkey")


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("doc"), F.year("o_orderdate").alias("version"))
    return o, o.where("doc is not null").groupBy("doc").agg(F.max("version").alias("current"))


VERSIONS = "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS doc, CAST(year(o_orderdate) AS INTEGER) AS version FROM orders), r AS (SELECT doc AS d, max(version) AS c FROM o WHERE doc IS NOT NULL GROUP BY 1) SELECT o.* FROM o LEFT JOIN r ON doc = d WHERE version = c"


@query(VERSIONS)
def current_payloads(spark, sf_dir):
    return reports.current(*_versions(spark, sf_dir), "doc", "version")


@query(VERSIONS + " OR doc IS NULL")
def current_pages(spark, sf_dir):
    return reports.current(*_versions(spark, sf_dir), "doc", "version", pages=True)


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus AS s, l_quantity AS e, round(l_quantity * (0.95 + l_discount), 2) AS r, round(l_quantity * (0.96 + l_tax), 2) AS a, CASE WHEN l_returnflag = 'R' THEN 8.0 END AS al FROM lineitem),
         g AS (SELECT *, greatest(a - e, r - e) AS over, round(al - round(a / 3, 2), 2) AS gap FROM l)
    SELECT l_orderkey, l_linenumber, CASE WHEN over > 0 THEN 'overtime' WHEN s = 'F' AND abs(r - a) > 0.01 THEN 'done_mismatch' WHEN gap < -0.01 THEN 'allocation_mismatch' END AS guard,
           CASE WHEN over > 0 THEN round(over, 2) WHEN s = 'F' AND abs(r - a) > 0.01 THEN round(r - a, 2) WHEN gap < -0.01 THEN gap END AS diff FROM g""")
def log_guards(spark, sf_dir):
    """A line is a log entry: closed ones are done, returned ones are bound to 8 hours, a third of the actual hours is today's."""
    actual = F.round(F.col("l_quantity") * (F.lit(0.96) + F.col("l_tax")), 2)
    logs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", " Done ").otherwise("Open").alias("status"), F.col("l_quantity").alias("estimate"), F.round(F.col("l_quantity") * (F.lit(0.95) + F.col("l_discount")), 2).alias("re_estimate"), actual.alias("actual"), (actual / 3).alias("total_today"), F.when(F.col("l_returnflag") == "R", 8.0).alias("allocated"))
    return reports.log_guards(logs).select("l_orderkey", "l_linenumber", "guard", "diff")


@query("SELECT event_id, event_id % 3 = 0 AS blocked FROM events")
def blocked_notes(spark, sf_dir):
    """Every third event has a note that speaks of a block."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", reports.blocked(F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(": Blocked by QA"))).otherwise(F.col("event_type"))).alias("blocked"))


@query("""
    WITH r AS (SELECT user_id, event_type, min(event_id) AS reuse FROM events WHERE value < 50 AND event_id % 4 > 1 GROUP BY ALL)
    SELECT e.event_id, reuse FROM events e LEFT JOIN r ON e.user_id = r.user_id AND e.event_type = r.event_type WHERE value >= 50""")
def reusable_requests(spark, sf_dir):
    """Low values are earlier requests, of which every second one failed or is stale."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 4 == 0, "failed").when(F.col("event_id") % 4 == 1, "stale").otherwise("open")
    old = e.where("value < 50").select("user_id", "event_type", F.col("event_id").alias("id"), status.alias("status"))
    return reports.reusable_requests(e.where("value >= 50").select("event_id", "user_id", "event_type"), old, ["user_id", "event_type"]).select("event_id", "reuse")


@query("""
    SELECT doc_id AS idx, target FROM documents, (VALUES ('en'), ('fr'), ('de')) t(target)
    WHERE (lang IS NULL OR lang = '' OR lang <> target) AND NOT (target = 'fr' AND doc_id % 3 = 0) AND NOT (target = 'en' AND doc_id % 5 = 0)""")
def untranslated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("lang").alias("language"))
    done = lambda n, lang: d.where(f"idx % {n} = 0").select("idx", F.lit(lang).alias("target"))
    return reports.untranslated(d, ["en", "es", "fr", "de"], ["es"], done(3, "fr"), done(5, "en"))


@query("SELECT 'customer' AS doc, c_custkey AS row_no, CAST(c_nationkey AS VARCHAR) AS given, c_mktsegment AS wanted FROM customer")
def related_values(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").select(F.lit("customer").alias("doc"), F.col("c_custkey").alias("row_no"), F.explode(F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))).alias("header", "value"))
    return reports.related(cells, "nation", "segment")


@query("SELECT DISTINCT o_custkey AS name, coalesce('person:' || c_custkey, 'dim:' || o_custkey) AS node FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def person_nodes(spark, sf_dir):
    """Customers in credit are the known people."""
    people = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name"), F.concat(F.lit("person:"), F.col("c_custkey").cast("string")).alias("node"))
    return reports.person_nodes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")), people)


@query("""
    WITH n AS (SELECT c_custkey AS title, c_name AS block FROM customer WHERE c_acctbal > 0), o AS (SELECT c_custkey AS title, c_mktsegment AS block FROM customer WHERE c_nationkey < 10)
    SELECT coalesce(n.title, o.title) AS title, coalesce(o.block, n.block) AS block, CASE WHEN n.title IS NULL THEN 'missing' WHEN o.title IS NOT NULL THEN 'reused' ELSE 'generated' END AS state FROM n FULL JOIN o ON n.title = o.title""")
def overridden_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return reports.overridden(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("title"), F.col("c_name").alias("block")), c.select(F.col("c_custkey").alias("title"), F.col("c_mktsegment").alias("block"), (F.col("c_nationkey") < 10).alias("fixed")))


@query("SELECT user_id, coalesce(avg(ln(greatest(value / 100, 0.000001))) FILTER (WHERE event_type = 'error' AND value IS NOT NULL), -0.1) AS mean_log FROM events GROUP BY 1")
def confidence_log(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(reports.mean_log(F.when(F.col("event_type") == "error", F.col("value") / 100)).alias("mean_log"))


@query("SELECT n_regionkey, l[1] AS nation_1, l[2] AS nation_2, l[3] AS nation_3, l[4] AS nation_4, l[5] AS nation_5 FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation WHERE n_nationkey <> 3 GROUP BY 1)")
def widened_lists(spark, sf_dir):
    """One region has a nation less than the others."""
    lists = table(spark, sf_dir, "nation").where("n_nationkey <> 3").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return reports.widened(lists, "n_regionkey", "names", "nation")


@query("""
    WITH l AS (SELECT user_id AS doc, event_id * 7 % 40 AS number, max(event_id) AS start FROM events GROUP BY ALL), m AS (SELECT *, max(number) OVER (PARTITION BY doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l)
    SELECT doc, number, start, event_type AS title FROM m JOIN events ON event_id = start WHERE m IS NULL OR number > m""")
def chapter_marks(spark, sf_dir):
    """A user's events are a document's headings."""
    e = table(spark, sf_dir, "events")
    return reports.chapter_marks(e.select(F.col("user_id").alias("doc"), (F.col("event_id") * 7 % 40).alias("number"), F.col("event_id").alias("start"), F.col("event_type").alias("title")))


@query("""
    WITH d AS (SELECT doc_id AS doc, coalesce(text, '') AS text FROM documents), m AS (SELECT doc, text, 350 + 700 * k AS start, 'part ' || k AS title FROM (SELECT doc, text, unnest(range(0, (length(text) - 350 + 699) // 700)) AS k FROM d WHERE length(text) > 350)),
         w AS (SELECT *, lead(start) OVER (PARTITION BY doc ORDER BY start) AS next, count(*) OVER (PARTITION BY doc) AS n FROM m),
         s AS (SELECT doc, start, title, substr(text, start + 1, coalesce(next, length(text)) - start) AS body FROM w WHERE n > 1 UNION ALL SELECT doc, 0, NULL, substr(text, 1, 350) FROM w WHERE n > 1 AND start = 350 AND length(regexp_replace(substr(text, 1, 350), '^\\s+|\\s+$', '', 'g')) >= 350)
    SELECT doc, start, title, length(body) AS size, sha256(body) AS digest FROM s""")
def document_sections(spark, sf_dir):
    """A mark at character 350 and at each 700 more, as titles are not in these texts; a front with a blank at its end is too short."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.ceil((F.char_length("text") - 350) / 700).cast("int")
    marks = d.where(F.char_length("text") > 350).select("doc", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select("doc", (F.lit(350) + 700 * F.col("k")).cast("long").alias("start"), F.concat(F.lit("part "), F.col("k").cast("string")).alias("title"))
    return reports.sections(d, marks, least_front=350).select("doc", "start", "title", F.char_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("digest"))


@query("""
    WITH RECURSIVE l AS (SELECT doc_id, i, ls[i] AS line, i < len(ls) AS more FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), '. ', chr(10) || chr(10)), chr(10)) AS ls FROM documents))),
         a AS (SELECT doc_id, line, more, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l),
         b AS (SELECT doc_id, coalesce(list(place ORDER BY place) FILTER (WHERE trim(line) = '' AND more), []) AS bs FROM a GROUP BY 1),
         r AS (SELECT doc_id, bs, 0::BIGINT AS start, 1 AS k FROM b UNION ALL SELECT doc_id, bs, list_min(list_filter(bs, lambda x: x - start >= 2000))::BIGINT, k + 1 FROM r WHERE list_min(list_filter(bs, lambda x: x - start >= 2000)) IS NOT NULL)
    SELECT doc_id, CAST(k - 1 AS BIGINT) AS chunk, start FROM r""")
def text_chunks(spark, sf_dir):
    """Sentences are set apart by blank lines first, as the texts have none."""
    t = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(reports.chunk_starts(t, 2000)).alias("chunk", "start")).select("doc_id", F.col("chunk").cast("long"), F.col("start").cast("long"))


@query("""
    WITH t AS (SELECT conv_id AS thread, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1)
    SELECT thread, CASE WHEN length(t) > 1500 THEN substr(t, 1, 1480) || chr(10) || '[history truncated]' ELSE t END AS context FROM t""")
def thread_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return reports.thread_context(c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")), 1500)
