"""Queries of retrieval, sets, versions, histories and checks; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import core, lookup
from .catalogue import query, table

DAY = "CAST(ts AS DATE)"


def day():
    return F.col("ts").cast("date").alias("day")


@query("SELECT 'o_orderstatus' AS name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def status_counts(spark, sf_dir):
    return lookup.counter(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT count(*) AS tasks, round(sum(l_quantity), 4) AS estimate, round(sum(l_tax * 100), 4) AS actual, round(sum(l_quantity) - sum(l_tax * 100), 4) AS remaining FROM lineitem")
def global_totals(spark, sf_dir):
    return lookup.totals(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("estimate"), (F.col("l_tax") * 100).alias("actual")))


@query("""SELECT o_custkey AS person, round(sum(o_totalprice), 4) AS total, string_agg(DISTINCT strftime(o_orderdate, '%Y'), '; ' ORDER BY strftime(o_orderdate, '%Y')) AS sources FROM orders GROUP BY 1""")
def rollup_of_sprints(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person"), F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.sum("o_totalprice").alias("part"))
    return lookup.rolled_up(parts, "person", "part", "year")


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
         p AS (SELECT event_type, max(value) FILTER (WHERE i = least(CAST(floor(n * 50 / 100.0) AS BIGINT), n - 1)) AS p50, max(value) FILTER (WHERE i = least(CAST(floor(n * 95 / 100.0) AS BIGINT), n - 1)) AS p95 FROM r GROUP BY 1)
    SELECT e.event_type, count(*) AS events, count(*) FILTER (WHERE value > 60) AS hits, any_value(p50) AS p50, any_value(p95) AS p95 FROM events e JOIN p ON e.event_type = p.event_type GROUP BY 1""")
def telemetry_summary(spark, sf_dir):
    return lookup.telemetry(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") > 60)


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, value FROM r WHERE i = least(CAST(round_even((n - 1) * 0.5, 0) AS BIGINT), n - 1)""")
def benchmark_median(spark, sf_dir):
    return lookup.benchmark_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.5)


@query("""
    WITH a AS (SELECT l_suppkey AS person, CAST(l_linenumber AS VARCHAR) AS num, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END) AS d FROM lineitem GROUP BY ALL)
    SELECT person, num, CAST(greatest(d, 0) AS BIGINT) AS lost, CAST(greatest(-d, 0) AS BIGINT) AS added FROM a WHERE d <> 0""")
def number_changes(spark, sf_dir):
    """Numbers of closed lines are the old text's, those of open lines the new one's."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_linenumber").cast("string").alias("num"), "l_linestatus")
    return lookup.multiset_difference(rows.where("l_linestatus = 'F'").drop("l_linestatus"), rows.where("l_linestatus <> 'F'").drop("l_linestatus"), ["person"], "num")


@query("SELECT event_type, count(*) FILTER (WHERE value > 40) AS passed, count(*) AS total, round(100.0 * count(*) FILTER (WHERE value > 40) / count(*), 2) AS pct FROM events GROUP BY 1")
def eval_by_group(spark, sf_dir):
    return lookup.passed(table(spark, sf_dir, "events"), "event_type", F.col("value") > 40)


@query("SELECT user_id, min(event_id) AS first_at, coalesce(string_agg('f' || event_id, ',' ORDER BY event_id) FILTER (WHERE event_type = 'error'), '') AS files FROM events GROUP BY 1")
def evidence_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("file", F.when(F.col("event_type") == "error", F.concat(F.lit("f"), F.col("event_id").cast("string"))))
    return lookup.evidence(e, "user_id", "event_id", "file")


@query("""SELECT event_type, count(*) AS cells, count(*) FILTER (WHERE event_id % 3 = 0) AS covered FROM events GROUP BY ROLLUP (event_type)""")
def audit_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return lookup.coverage_audit(e, e.where("event_id % 3 = 0"), "event_type", ["event_id"])


@query(f"""
    WITH a AS (SELECT user_id, {DAY} AS day, round(sum(value), 4) AS logged FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, {DAY} AS day, round(sum(value), 4) AS allocated FROM events WHERE event_type = 'view' GROUP BY ALL),
         j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, coalesce(logged, 0) AS logged, coalesce(allocated, 0) AS allocated FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day)
    SELECT *, CASE WHEN logged - allocated > 0.01 THEN 'over' WHEN logged - allocated < -0.01 THEN 'under' ELSE 'even' END AS verdict FROM j""")
def effort_allocation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", day(), "event_type", F.col("value").alias("hours"))
    out = lookup.effort_against_allocation(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id", "day"])
    return out.select("user_id", "day", F.round("logged", 4).alias("logged"), F.round("allocated", 4).alias("allocated"), "verdict")


ASKED = ("license", "token", "the", "nicht", "zzqx")
HITS = " + ".join(f"CASE WHEN contains(b, '{t}') THEN d{i} ELSE 0 END" for i, t in enumerate(ASKED))
FOLDED = "strip_accents(replace(lower(coalesce(text, '')), 'đ', 'd'))"
SHARES = f"""
    b AS (SELECT doc_id, {FOLDED} AS b FROM documents), n AS (SELECT {", ".join(f"ln((1.0 + count(*)) / (1 + count(*) FILTER (WHERE contains(b, '{t}')))) AS d{i}" for i, t in enumerate(ASKED))} FROM b),
    s AS (SELECT doc_id, round(({HITS}) / ({" + ".join(f"d{i}" for i in range(len(ASKED)))}), 9) AS share FROM b, n WHERE {" OR ".join(f"contains(b, '{t}')" for t in ASKED)})"""


def folded():
    return text.fold(F.coalesce("text", F.lit("")))


@query(f"WITH {SHARES} SELECT doc_id, share FROM s ORDER BY share DESC, doc_id LIMIT 6")
def row_search_top(spark, sf_dir):
    """The six best rows."""
    return lookup.row_search(table(spark, sf_dir, "documents"), "doc_id", folded(), ASKED, 6)


@query(f"WITH {SHARES} SELECT doc_id, share FROM s WHERE share = (SELECT max(share) FROM s)")
def row_search_ties(spark, sf_dir):
    """All rows of the highest share."""
    return lookup.top_ties(lookup.row_search(table(spark, sf_dir, "documents"), "doc_id", folded(), ASKED, None), "share")


@query(f"WITH {SHARES} SELECT doc_id, share, share = (SELECT max(share) FROM s) AND share >= 0.6 AS found FROM s")
def cell_fallback(spark, sf_dir):
    """All rows that hold some of what is asked, and whether they are found: those that hold most, if that is enough. The word of a column does not count."""
    return lookup.fallback_shares(table(spark, sf_dir, "documents"), "doc_id", folded(), (*ASKED, "text"), ("text",))


@query("""
    WITH k AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 80)
    SELECT * FROM k WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def search_overfetch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return lookup.overfetched(o.select("o_orderkey", "o_totalprice"), o.where("o_custkey % 2 = 0"), "o_orderkey", "o_totalprice", 10)


@query("""
    WITH w AS (SELECT DISTINCT item_id, w, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS w FROM benchmark) GROUP BY ALL),
         d AS (SELECT item_id, c, sha256(w) AS d FROM w),
         v AS (SELECT item_id, CAST(CAST('0x' || d[1:8] AS BIGINT) % 384 AS INTEGER) AS i, sum(CASE WHEN CAST('0x' || d[10:10] AS BIGINT) % 2 = 1 THEN c ELSE -c END) AS x FROM d GROUP BY 1, 2)
    SELECT item_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM v WHERE x <> 0""".replace("\\\\", "\\"))
def hash_embedding(spark, sf_dir):
    return lookup.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "i", F.round("x", 6).alias("x"))


@query("""
    WITH e AS (SELECT * FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'), a AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase')
    SELECT user_id, 'missing' AS side FROM a WHERE user_id NOT IN (FROM b) UNION ALL SELECT user_id, 'extra' FROM b WHERE user_id NOT IN (FROM a)""")
def except_both_ways(spark, sf_dir):
    """U03 U06, of one day."""
    e = table(spark, sf_dir, "events").where(F.col("ts").cast("date") == F.lit("2024-01-15").cast("date"))
    return lookup.except_both(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def changed_keys_intersect(spark, sf_dir):
    """U04."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'signup'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def union_distinct_in_order(spark, sf_dir):
    return lookup.union_in_order(table(spark, sf_dir, "events"), "user_id", ["event_id"])


@query("""
    WITH r AS (SELECT n_nationkey, chr(CAST(65 + n_nationkey % 5 AS INTEGER)) AS a, n_nationkey + 1 AS f FROM nation)
    SELECT n_nationkey, chr(CAST(ascii(a) + x AS INTEGER)) || (f + y) AS cell FROM r, range(3) t(x), range(4) u(y)""")
def range_cells(spark, sf_dir):
    letter = lambda k: F.char((F.col("n_nationkey") % 5 + 65 + k).cast("long"))
    cell = lambda k, r: F.concat(letter(k), (F.col("n_nationkey") + 1 + r).cast("string"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", cell(0, 0).alias("a"), cell(2, 3).alias("b"))
    return lookup.expanded_ranges(n, "n_nationkey", "a", "b")


@query("""
    WITH s AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS path FROM lineitem), c AS (SELECT page, count(*) AS n, count(*) FILTER (WHERE path IN (SELECT p_partkey FROM part WHERE p_size < 20)) AS k FROM s GROUP BY 1)
    SELECT page, CASE WHEN n = k THEN 'all' ELSE 'part' END AS strategy FROM c WHERE k > 0""")
def impacted_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_set("l_partkey").alias("sources"))
    return lookup.impacted(pages, "page", "sources", table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("path")), "path")


@query("""
    SELECT coalesce(a.k, b.k) AS page, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'write' ELSE 'keep' END AS action
    FROM (SELECT o_orderkey AS k, o_orderstatus AS d FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS d FROM orders WHERE o_orderkey % 4 <> 0) b ON a.k = b.k""")
def page_write_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("digest"))
    new = o.where("page % 4 <> 0").withColumn("digest", F.when(F.col("page") % 5 == 0, "X").otherwise(F.col("digest")))
    return lookup.write_set(o.where("page % 3 <> 0"), new, "page", "digest")


@query("""
    WITH n AS (SELECT l_partkey, count(*) AS n, min(l_suppkey) AS p FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
    SELECT p_partkey AS l_partkey, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS verdict, CASE WHEN n = 1 THEN p END AS l_suppkey FROM part LEFT JOIN n ON p_partkey = l_partkey""")
def find_by_id(spark, sf_dir):
    return lookup.found_by_id(table(spark, sf_dir, "lineitem").where("l_linenumber = 1"), table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "l_suppkey")


REGISTRY = """
    d AS (SELECT o_custkey AS doc, o_orderkey, o_orderstatus || (o_orderkey % 9) AS digest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders),
    r AS (SELECT doc, CAST(version AS INTEGER) AS version, back = 1 AS current, CASE WHEN version > 1 THEN CAST(version - CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN -99 ELSE 1 END AS INTEGER) END AS supersedes, digest FROM d),
    i AS (SELECT c_custkey AS doc, CAST(c_custkey % 20 AS INTEGER) AS from_version, CASE WHEN c_custkey % 4 = 0 THEN 'F1' WHEN c_custkey % 4 = 1 THEN 'n' || c_custkey ELSE coalesce(r.digest, 'O2') END AS digest FROM customer LEFT JOIN r ON doc = c_custkey AND current)"""


def registry(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.concat("o_orderstatus", (F.col("o_orderkey") % 9).cast("string")).alias("digest"), F.row_number().over(w.orderBy("o_orderkey")).alias("version"), F.row_number().over(w.orderBy(F.desc("o_orderkey"))).alias("back"))
    less = F.when(F.col("o_orderkey") % 11 == 0, 0).when(F.col("o_orderkey") % 13 == 0, -99).otherwise(1)
    return d.select("doc", "version", (F.col("back") == 1).alias("current"), F.when(F.col("version") > 1, F.col("version") - less).alias("supersedes"), "digest")


def incoming(spark, sf_dir):
    now = registry(spark, sf_dir).where("current").select("doc", F.col("digest").alias("now"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 20).cast("int").alias("from_version")).join(now, "doc", "left")
    return c.select("doc", "from_version", F.when(F.col("doc") % 4 == 0, "F1").when(F.col("doc") % 4 == 1, F.concat(F.lit("n"), F.col("doc").cast("string"))).otherwise(F.coalesce("now", F.lit("O2"))).alias("digest"))


@query(f"""
    WITH {REGISTRY}, m AS (SELECT i.doc, n.version AS v, i.digest FROM i LEFT JOIN r n ON i.doc = n.doc AND n.current WHERE i.doc NOT IN (SELECT doc FROM r) OR (from_version = n.version AND i.digest <> n.digest))
    SELECT doc, version, current AND doc NOT IN (SELECT doc FROM m) AS current, supersedes, digest FROM r UNION ALL SELECT doc, CAST(coalesce(v, 0) + 1 AS INTEGER), true, v, digest FROM m""")
def register_version(spark, sf_dir):
    return lookup.registered(registry(spark, sf_dir), incoming(spark, sf_dir), "doc")


@query(f"""
    WITH {REGISTRY} SELECT i.doc, from_version, n.version AS now FROM i JOIN r ON i.doc = r.doc LEFT JOIN r n ON n.doc = i.doc AND n.current WHERE from_version IS DISTINCT FROM n.version GROUP BY ALL""")
def refused_registrations(spark, sf_dir):
    """Rows that expect another version than the current one; registering them changes nothing."""
    return lookup.refused(registry(spark, sf_dir), incoming(spark, sf_dir), "doc")


@query("""
    WITH r AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS current, CASE WHEN o_orderkey % 50 = 0 THEN 'twice' ELSE 'd' || o_orderkey END AS digest, o_orderstatus AS semantic FROM orders),
         i AS (SELECT c_custkey AS doc, CASE c_custkey % 4 WHEN 0 THEN coalesce('d' || (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'new') WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN 'twice' ELSE 'new' END ELSE 'new' END AS digest, c_custkey % 3 <> 0 AS confirmed FROM customer)
    SELECT doc, CASE WHEN (SELECT count(*) FROM r WHERE r.digest = i.digest) > 1 THEN 'review' WHEN (SELECT count(*) FROM r WHERE r.digest = i.digest) = 1 THEN 'duplicate' WHEN doc NOT IN (SELECT doc FROM r) THEN 'initial_ingest'
           WHEN NOT confirmed THEN 'identity_review' WHEN EXISTS (SELECT 1 FROM r WHERE r.doc = i.doc AND r.current AND r.semantic = 'F') THEN 'no_op' ELSE 'reingest' END AS decision FROM i""")
def intake_decision(spark, sf_dir):
    """G09, all six decisions: a customer is a document, its orders the versions, told apart by status."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    digest = F.when(F.col("o_orderkey") % 50 == 0, "twice").otherwise(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")))
    registry = o.select(F.col("o_custkey").alias("doc"), F.row_number().over(w.orderBy("o_orderkey")).alias("version"), (F.row_number().over(w.orderBy(F.desc("o_orderkey"))) == 1).alias("current"), digest.alias("digest"), F.col("o_orderstatus").alias("semantic"))
    first = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.min("o_orderkey").alias("first"))
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc")).join(first, "doc", "left")
    digest = F.when((F.col("doc") % 4 == 0) & F.col("first").isNotNull(), F.concat(F.lit("d"), F.col("first").cast("string"))).when(F.col("doc") % 8 == 1, "twice").otherwise("new")
    return lookup.intake(given.select("doc", digest.alias("digest"), F.lit("F").alias("semantic"), (F.col("doc") % 3 != 0).alias("confirmed")), registry, "doc")


@query(f"""
    WITH {REGISTRY}, f AS (SELECT doc, version, CASE WHEN supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r x WHERE x.doc = r.doc AND x.version = r.supersedes) THEN 'missing' WHEN supersedes >= version THEN 'not_smaller'
         WHEN NOT current AND NOT EXISTS (SELECT 1 FROM r x WHERE x.doc = r.doc AND x.supersedes = r.version) THEN 'dangling' END AS fault FROM r)
    SELECT * FROM f WHERE fault IS NOT NULL""")
def version_history_faults(spark, sf_dir):
    return lookup.history_faults(registry(spark, sf_dir), "doc")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE ts >= DATE '2024-01-10') WHERE n <= 3")
def retained_entries(spark, sf_dir):
    return lookup.retained(table(spark, sf_dir, "events"), "user_id", "event_id", 3, F.col("ts") >= F.lit("2024-01-10").cast("date")).select("event_id")


@query(f"WITH d AS (SELECT DISTINCT {DAY} AS day FROM events ORDER BY 1 DESC LIMIT 7) SELECT event_id FROM events WHERE {DAY} IN (FROM d)")
def last_seven_days(spark, sf_dir):
    """K11."""
    return core.keep_last_days(table(spark, sf_dir, "events").select("event_id", day()), "day").select("event_id")


@query("""
    WITH b AS (SELECT user_id, event_id, value < 75 AS blank, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, sum(CASE WHEN value < 75 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events WHERE value IS NOT NULL),
         e AS (SELECT user_id, min(g) AS g FROM (SELECT user_id, g FROM b WHERE blank GROUP BY 1, 2 HAVING count(*) >= 4) GROUP BY 1)
    SELECT event_id FROM b LEFT JOIN e ON b.user_id = e.user_id WHERE NOT blank AND (e.g IS NULL OR b.g <= e.g)""")
def blank_run_cutoff(spark, sf_dir):
    return lookup.before_blank_run(table(spark, sf_dir, "events").where("value IS NOT NULL"), "user_id", "event_id", F.col("value") < 75, 4).select("event_id")


HEADER = "SELECT n_regionkey AS sheet, n_nationkey AS col, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 12 + 1 END AS month, CASE WHEN n_nationkey % 4 <> 1 THEN n_nationkey % 28 + 1 END AS day FROM nation"
DATES = f"""h AS ({HEADER}), m AS (SELECT sheet, col, last_value(month IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY col ROWS UNBOUNDED PRECEDING) AS month, day FROM h),
    d AS (SELECT sheet, col, make_date(2026, month, day) AS date FROM m WHERE month IS NOT NULL AND day IS NOT NULL)"""


def dates(spark, sf_dir):
    n = F.col("n_nationkey")
    h = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("sheet"), n.alias("col"), F.when(n % 3 == 0, n % 12 + 1).alias("month"), F.when(n % 4 != 1, n % 28 + 1).alias("day"))
    return lookup.header_dates(h, "sheet", "col", "month", "day", 2026)


@query(f"WITH {DATES} SELECT sheet, col, date FROM d")
def grid_header_dates(spark, sf_dir):
    return dates(spark, sf_dir)


@query(f"""
    WITH {DATES}, g AS (SELECT c_custkey AS person, c_nationkey % 5 AS sheet, unnest(range(25)) AS col FROM customer), v AS (SELECT *, CASE (person + col) % 4 WHEN 0 THEN '8' WHEN 1 THEN ' 7,5 ' WHEN 2 THEN '' ELSE 'off' END AS cell FROM g)
    SELECT person, date, TRY_CAST(replace(trim(cell), ',', '.') AS DOUBLE) AS hours FROM v JOIN d ON v.sheet = d.sheet AND v.col = d.col""")
def grid_unpivot(spark, sf_dir):
    cell = lambda i: F.element_at(F.array(*map(F.lit, ("8", " 7,5 ", "", "off"))), ((F.col("c_custkey") + i) % 4 + 1).cast("int"))
    grid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_nationkey") % 5).alias("sheet"), F.transform(F.sequence(F.lit(0), F.lit(24)), cell).alias("cells"))
    return lookup.unpivoted(grid, "person", "cells", dates(spark, sf_dir), "sheet", "col")


CASCADE = """
    w AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS z FROM lineitem WHERE l_linestatus = 'O'),
    k AS (SELECT *, CAST(floor((z - l_quantity) / 8) AS INTEGER) AS a, CAST(greatest(ceil(z / 8) - 1, floor((z - l_quantity) / 8)) AS INTEGER) AS b FROM w),
    p AS (SELECT l_suppkey, l_orderkey, l_linenumber, DATE '2026-01-05' + (a + 2 * (a // 5)) AS first_day, DATE '2026-01-05' + (b + 2 * (b // 5)) AS last_day FROM k)"""


def cascaded(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    return lookup.cascade(t, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", F.lit("2026-01-05").cast("date"))


@query(f"WITH {CASCADE} SELECT l_suppkey, l_orderkey, l_linenumber, first_day, last_day FROM p")
def capacity_cascade(spark, sf_dir):
    return cascaded(spark, sf_dir).drop("l_shipdate")


@query(f"WITH {CASCADE} SELECT l_orderkey, l_linenumber, CAST(date_diff('day', DATE '2026-06-30', last_day) AS INTEGER) AS days_over FROM p WHERE last_day > DATE '2026-06-30'")
def sprint_overflow(spark, sf_dir):
    return lookup.past_sprint_end(cascaded(spark, sf_dir), F.lit("2026-06-30").cast("date")).select("l_orderkey", "l_linenumber", "days_over")


@query("SELECT user_id, max(ts) AS last_at FROM events WHERE CAST(ts + INTERVAL 7 HOUR AS DATE) = DATE '2024-01-12' GROUP BY 1")
def last_message_of_day(spark, sf_dir):
    return lookup.last_of_local_day(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-12").cast("date"))


@query("SELECT 'R-' || (max(p_partkey) + 1) AS next_id FROM part")
def next_risk_id(spark, sf_dir):
    return lookup.next_id(table(spark, sf_dir, "part").select(F.concat(F.lit("R-"), F.lpad(F.col("p_partkey").cast("string"), F.lit(9), F.lit("0"))).alias("id")).union(table(spark, sf_dir, "region").select("r_name")), "id")


@query("""
    WITH f AS (SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'value' END, CASE WHEN event_id % 3 = 0 THEN 'unit' END, CASE WHEN event_id % 7 = 0 THEN 'src' END) AS missing FROM events) SELECT * FROM f WHERE missing <> ''""")
def ingest_gate(spark, sf_dir):
    n = F.col("event_id")
    m = table(spark, sf_dir, "events").select("event_id", F.when(n % 5 != 0, F.coalesce("value", F.lit(0.0))).alias("value"), F.when(n % 3 == 0, " ").otherwise("h").alias("unit"), F.when(n % 7 != 0, "doc").alias("src"))
    return lookup.measure_faults(m, "event_id")


@query("""
    WITH n AS (SELECT user_id, CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) AS num, event_type = 'click' AS answer FROM events WHERE value IS NOT NULL)
    SELECT DISTINCT a.user_id, a.num FROM n a ANTI JOIN (SELECT * FROM n WHERE NOT answer) s ON a.user_id = s.user_id AND a.num = s.num WHERE a.answer""")
def answer_gate(spark, sf_dir):
    """Numbers that a user's clicks say and no other event of theirs does."""
    n = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", "event_type", F.floor("value").cast("string").alias("num"))
    return lookup.unsupported_numbers(n.where("event_type = 'click'"), n.where("event_type <> 'click'"), "user_id", "num")


@query("""
    SELECT event_id, 'value: missing' AS fault FROM events WHERE value IS NULL UNION ALL SELECT event_id, 'event_type: not allowed' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""")
def schema_lint(spark, sf_dir):
    return lookup.enum_faults(table(spark, sf_dir, "events"), "event_id", ["value"], {"event_type": ["view", "click", "purchase"]})


@query("""
    WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS task, l_quantity AS e, l_tax * 100 AS a, CASE WHEN l_linenumber = 1 THEN 0.5 ELSE l_tax * 100 / l_quantity END AS p, CASE WHEN l_linenumber = 2 THEN l_quantity ELSE l_quantity - l_tax * 100 END AS r FROM lineitem)
    SELECT task, 'progress' AS fault FROM t WHERE abs(p - a / e) > 0.01 UNION ALL SELECT task, 'remaining' FROM t WHERE abs(r - (e - a)) > 0.01""")
def self_consistency(spark, sf_dir):
    n, e, a = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_tax") * 100
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("task"), e.alias("estimate"), a.alias("actual"), F.when(n == 1, 0.5).otherwise(a / e).alias("progress"), F.when(n == 2, e).otherwise(e - a).alias("remaining"))
    return lookup.inconsistent(t, "task")


@query("SELECT DISTINCT o_custkey AS page FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def publish_smoke(spark, sf_dir):
    """G18 J21."""
    return lookup.subset_faults(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("page")), "page")


@query(f"""
    WITH e AS (SELECT user_id, event_type FROM events WHERE {DAY} = DATE '2024-01-15')
    SELECT c_custkey AS user_id, CASE WHEN c_custkey IN (SELECT user_id FROM e WHERE event_type = 'view') THEN 'reported' WHEN c_custkey IN (SELECT user_id FROM e WHERE event_type = 'click') THEN 'proven' ELSE 'missing' END AS verdict
    FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT user_id FROM e WHERE event_type = 'error')""")
def report_compliance(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts").cast("date") == F.lit("2024-01-15").cast("date"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 10 == 0).alias("is_bot"))
    return lookup.compliance(people, e.where("event_type = 'error'"), e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id")


@query("""
    WITH e AS (SELECT o_custkey AS person, o_orderkey AS task, CAST(o_orderdate AS DATE) AS day, 1.0 + o_orderkey % 4 AS hours, o_orderkey AS k, o_orderstatus AS s FROM orders),
         o AS (SELECT person, day, CASE WHEN k % 5 = 0 THEN hours + 0.5 ELSE hours END AS hours FROM e WHERE k % 3 <> 0), r AS (SELECT CASE WHEN k % 11 = 0 THEN person + 1 ELSE person END AS person, task, s = 'F' AS done FROM e WHERE k % 7 <> 0)
    SELECT person, task, day, hours, CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.person = e.person AND o.day = e.day AND o.hours = e.hours) THEN 'unknown'
           WHEN EXISTS (SELECT 1 FROM r WHERE r.person = e.person AND r.task = e.task AND done) THEN 'match' WHEN EXISTS (SELECT 1 FROM r WHERE r.person = e.person AND r.task = e.task) THEN 'open' ELSE 'unknown' END AS verdict FROM e""")
def overtime_reconciliation(spark, sf_dir):
    """Orders are hours to be explained; some have no overtime, other hours, no risk, or another person's."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), k.alias("task"), F.col("o_orderdate").cast("date").alias("day"), (F.lit(1.0) + k % 4).alias("hours"), F.col("o_orderstatus").alias("s"))
    t = F.col("task")
    paid = e.where(t % 3 != 0).select("person", "day", F.when(t % 5 == 0, F.col("hours") + 0.5).otherwise(F.col("hours")).alias("hours"))
    risks = e.where(t % 7 != 0).select(F.when(t % 11 == 0, F.col("person") + 1).otherwise(F.col("person")).alias("person"), "task", F.when(F.col("s") == "F", "Done").otherwise("Open").alias("status"))
    return lookup.reconciled(e.drop("s"), paid, risks)


@query("""
    WITH r AS (SELECT o_custkey AS person, o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' THEN 'Watch' ELSE 'Open' END AS status FROM orders), d AS (SELECT o_custkey AS person, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS task, o_orderkey % 2 = 0 AS done FROM orders WHERE o_orderkey % 3 = 0)
    SELECT person, task, status FROM r WHERE status = 'Done' UNION ALL
    SELECT coalesce(r.person, d.person), coalesce(r.task, d.task), CASE WHEN d.task IS NULL THEN r.status WHEN d.done THEN 'Done' ELSE 'Open' END FROM (SELECT * FROM r WHERE status <> 'Done') r FULL JOIN d ON r.person = d.person AND r.task = d.task""")
def risk_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "P", "Watch").otherwise("Open")
    risks = o.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("task"), status.alias("status"))
    k = F.col("o_orderkey")
    made = o.where(k % 3 == 0).select(F.col("o_custkey").alias("person"), F.when(k % 5 == 0, k + 100_000_000).otherwise(k).alias("task"), F.when(k % 2 == 0, "reschedule").otherwise("overtime").alias("action"))
    return lookup.decided(risks, made, ["person", "task"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'F' AND CAST(l_shipdate AS DATE) <= DATE '1998-06-10'")
def late_by_calendar(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").alias("is_done"), F.col("l_shipdate").cast("date").alias("plan_end"))
    return lookup.calendar_late(t, F.lit("1998-06-10 17:00:00").cast("timestamp")).select("l_orderkey", "l_linenumber")


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 1 THEN concat_ws(',', CASE WHEN l_linenumber >= 5 THEN 'fields' END, CASE WHEN l_linenumber = 3 THEN 'estimate' END, CASE WHEN l_tax = 0 THEN 'actual' END,
           CASE WHEN l_discount = 0 THEN 'status' END, CASE WHEN l_returnflag = 'R' THEN 'start' END, CASE WHEN l_linestatus = 'F' AND l_discount > 0 AND l_linenumber % 4 <> 2 OR l_linenumber % 4 = 3 THEN 'end' END) END AS faults FROM lineitem""")
def log_line_check(spark, sf_dir):
    """lines in the rules' order with list marks and bars before them; ends empty, as ``-``, as dates of either shape. Every fiftieth has no digit in its first field."""
    n, d, back = F.col("l_linenumber"), F.date_format("l_shipdate", "dd-MM-yyyy"), F.date_format("l_shipdate", "yyyy-MM-dd")
    first = F.when(F.col("l_quantity") > 1, F.col("l_orderkey").cast("string")).otherwise("xong")
    end = F.when(n % 4 == 2, d).when(n % 4 == 3, back).when(n % 4 == 1, "-").otherwise("")
    status = F.when(F.col("l_discount") == 0, "").when(F.col("l_linestatus") == "F", " đã hoàn thành ✅ ").otherwise("hoàn thành 90%")
    fields = [first, F.when(n == 3, " ").otherwise("8h"), F.when(F.col("l_returnflag") == "R", back).otherwise(d), end, F.when(F.col("l_tax") == 0, "").otherwise(" 7.5"), status]
    mark = F.when(F.col("l_returnflag") == "A", "- ").when(F.col("l_returnflag") == "N", "|").otherwise("  2) ")
    line = F.concat(mark, F.concat_ws("|", *fields), F.when(n < 5, "|").otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lookup.log_line_faults(line).alias("faults"))


@query("""
    WITH RECURSIVE t AS (SELECT p_partkey AS task, p_size AS delay FROM part), c AS (SELECT task, delay FROM t UNION SELECT t.task, c.delay FROM t JOIN c ON t.task = c.task * 2 OR t.task = c.task * 2 + 1)
    SELECT task, max(delay) AS delay FROM c GROUP BY 1""")
def delay_cascade(spark, sf_dir):
    """Each task waits for the one of half its number."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), F.col("p_size").alias("delay"))
    return lookup.cascaded_delays(t, t.select("task", F.floor(F.col("task") / 2).alias("on")))


@query("""
    WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'y' || strftime(o_orderdate, '%Y%m') AS b FROM orders), s AS (SELECT DISTINCT a AS node FROM e WHERE CAST(substr(a, 2) AS BIGINT) % 100 = 1),
         one AS (SELECT node AS seed, b AS node FROM s JOIN e ON node = a), two AS (SELECT DISTINCT seed, a AS node FROM one JOIN e ON node = b)
    SELECT node AS seed, node, 0 AS hop FROM s UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two WHERE seed <> node""")
def graph_neighbours(spark, sf_dir):
    """From customers, the months of their orders, and who ordered in those."""
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("y"), F.date_format("o_orderdate", "yyyyMM")).alias("b")).where("a is not null").distinct()
    seeds = e.where(F.substring("a", 2, 20).cast("long") % 100 == 1).select(F.col("a").alias("node")).distinct()
    return lookup.neighbours(e, seeds, 2)


@query("""
    SELECT o_orderkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey END AS assignee, o_orderpriority AS sprint, CASE WHEN o_orderstatus = 'F' THEN 'm' || (o_orderkey % 7) END AS milestone FROM orders""")
def edge_attributes(spark, sf_dir):
    """Typed edges of orders; only every third order's assignee may be seen."""
    o = table(spark, sf_dir, "orders")
    k, edge = F.col("o_orderkey"), lambda rel, b: F.struct(F.lit(rel).alias("rel"), b.alias("b"))
    e = o.select(k.alias("a"), F.explode(F.array_compact(F.array(edge("assignee", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), edge("sprint", F.col("o_orderpriority")), F.when(F.col("o_orderstatus") == "F", edge("milestone", F.concat(F.lit("m"), (k % 7).cast("string"))))))).alias("e"))
    return lookup.pivoted(e.select("a", "e.rel", "e.b"), ["assignee", "sprint", "milestone"], o.where(k % 3 == 0).select(k.alias("a")))


@query("""
    WITH e AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders UNION ALL SELECT c_custkey, c_nationkey FROM customer)
    SELECT a, b, CASE WHEN b IN (SELECT c_custkey FROM customer) THEN 'one_way' ELSE 'dangling' END AS kind FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.a = e.b AND r.b = e.a)""")
def unreciprocated_links(spark, sf_dir):
    """Links of customers to orders, and some links back; customers are the pages."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"))
    back = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    return core.mutual(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).union(back), pages)


@query(f"SELECT doc_id, sha256({FOLDED}) AS folded FROM documents")
def folded_texts(spark, sf_dir):
    """X01."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.coalesce("text", F.lit(""))), 256).alias("folded"))


@query(f"SELECT doc_id, sha256(regexp_replace({FOLDED}, '[^a-z0-9]', '', 'g')) AS signature FROM documents")
def text_signatures(spark, sf_dir):
    """X03."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.signature(F.coalesce("text", F.lit(""))), 256).alias("signature"))


@query("SELECT event_id, sha256('s' || user_id || chr(10) || event_type || chr(10) || event_id)[1:24] AS id, user_id || ':' || event_id || '.5' AS thread FROM events")
def message_ids(spark, sf_dir):
    """X21 X26."""
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", text.synthetic_id(F.concat(F.lit("s"), u), F.col("event_type"), e).alias("id"), text.thread_id(F.concat(F.lit(" "), u), F.concat(e, F.lit(".5 "))).alias("thread"))


@query("SELECT o_custkey, sha256(string_agg(DISTINCT o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderkey || ' ' || o_orderstatus)) AS digest FROM orders GROUP BY 1")
def manifest_digest(spark, sf_dir):
    """Of a group's lines, whatever their order."""
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(line).alias("l")).select("o_custkey", text.digest(F.col("l")).alias("digest"))


PLACE = [(26 ** (k + 1) - 1) // 25 for k in range(5)]


@query(f"SELECT p_partkey, {' || '.join(f"CASE WHEN p_partkey + 1 >= {PLACE[k]} THEN chr(CAST(65 + (p_partkey + 1 - {PLACE[k]}) // {26**k} % 26 AS INTEGER)) ELSE '' END" for k in reversed(range(5)))} AS letter FROM part")
def column_letters(spark, sf_dir):
    """P03."""
    return table(spark, sf_dir, "part").select("p_partkey", text.column_letter(F.col("p_partkey")).alias("letter"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\\b(cap nhat|sua|tao|doi|update|create|delete|remove|add|xoa)\\b') OR regexp_matches(q, '^\\s*(ghi|log)\\b') THEN 'action' WHEN regexp_matches(r, 'vì sao|tại sao|nguyên nhân|đánh giá|nhận xét|giải thích') THEN 'open' WHEN regexp_matches(r, 'tài liệu|sheet|wiki|master schedule|resource plan|summary') THEN 'document' WHEN regexp_matches(r, 'ai |task|sprint|effort|giờ|status|trạng thái|bao nhiêu|ngày') THEN 'structured' ELSE 'document' END AS route FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS r, strip_accents(replace(lower(coalesce(text, '')), 'đ', 'd')) AS q FROM conversations)".replace("\\\\", "\\"))
def question_routes(spark, sf_dir):
    """F16 R11; no turn of the tables says what not to do."""
    q = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lookup.route(q, text.fold(q)).alias("route"))
