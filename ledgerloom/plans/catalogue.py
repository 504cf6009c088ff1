"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import core
from ..streaming import segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query("""
    SELECT c_custkey AS person, count(o_orderkey) AS task_count, round(coalesce(sum(o_totalprice), 0), 4) AS amount, count(o_orderkey) > 0 AS appears
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey GROUP BY c_custkey""")
def person_rollup_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup is made before the join, so the join meets one row for each person."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("task_count"), F.sum("o_totalprice").alias("amount"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    return core.zero_filled(people, done, "person", {"task_count": 0, "amount": 0.0}).withColumn("amount", F.round("amount", 4))


TODAY = "DATE '1998-06-01'"


@query("SELECT c_custkey AS person FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def undeclared_actor_anti(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    return core.undeclared(people, table(spark, sf_dir, "events").select(F.col("user_id").alias("person")), "person")


@query(f"""
    WITH d AS (SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE) + 30, {TODAY}) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> 'F'),
         s AS (SELECT *, CAST(3 * CASE WHEN days >= 7 THEN 3 WHEN days >= 3 THEN 2 ELSE 1 END AS INTEGER) AS score FROM d WHERE days > 0)
    SELECT *, CASE WHEN score >= 6 THEN 'Highest' WHEN score >= 4 THEN 'High' WHEN score >= 2 THEN 'Medium' ELSE 'Low' END AS priority FROM s""")
def overdue_lines(spark, sf_dir):
    """Planned end: order date and 30 days. Done: line status F."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.select("l_orderkey", "l_linenumber", F.date_add(F.col("o_orderdate").cast("date"), 30).alias("plan_end"), (F.col("l_linestatus") == "F").alias("is_done"))
    return core.overdue(t, F.expr(TODAY)).select("l_orderkey", "l_linenumber", "days", "score", "priority")


@query("""
    SELECT l_orderkey, l_linenumber, round(l_quantity / p_size, 6) AS ratio, CAST(CASE WHEN l_quantity / p_size > 2.25 THEN 3 ELSE 2 END AS INTEGER) AS impact
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 0 AND l_quantity / p_size > 1.5""")
def effort_overrun(spark, sf_dir):
    """Estimate: part size. Actual: quantity."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = t.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("actual"), F.col("p_size").alias("estimate"))
    return core.overrun(t).select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"), "impact")


@query("""
    WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS sprint, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS done_pct FROM orders GROUP BY 1),
         p AS (SELECT *, lag(done_pct) OVER (ORDER BY sprint) AS before_pct FROM s)
    SELECT *, coalesce(before_pct - done_pct >= 15, false) AS fell FROM p""")
def velocity_drop(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("sprint"), (F.col("o_orderstatus") == "F").alias("is_done"))
    return core.velocity(o, "sprint")


@query("""
    SELECT l_suppkey AS assignee, CAST(l_shipdate AS DATE) AS day, count(*) AS tasks, round(sum(l_quantity), 4) AS hours
    FROM lineitem WHERE l_linestatus <> 'F' AND l_returnflag = 'N' GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(l_quantity) > 8""")
def daily_overload(spark, sf_dir):
    """Tasks of one day: lines that were not sent back; done: line status F."""
    end = F.col("l_shipdate").cast("date")
    start = F.when(F.col("l_returnflag") == "N", end).otherwise(F.date_sub(end, 3))
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("assignee"), start.alias("plan_start"), end.alias("plan_end"), F.col("l_quantity").alias("estimate"), (F.col("l_linestatus") == "F").alias("is_done"))
    return core.overload(w)


@query("""
    WITH w AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS to_h FROM lineitem)
    SELECT l_orderkey, l_linenumber, to_h - l_quantity AS from_h, to_h, CAST(floor((to_h - l_quantity) / 8) AS BIGINT) AS first_day,
           CAST(greatest(ceil(to_h / 8) - 1, 0) AS BIGINT) AS last_day, greatest(0.0, least(to_h, 80) - greatest(to_h - l_quantity, 40)) AS second_week FROM w""")
def running_calendar(spark, sf_dir):
    s = core.calendar_slots(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity")
    week = core.overlap_hours(F.col("from_h"), F.col("to_h"), F.lit(40.0), F.lit(80.0))
    return s.select("l_orderkey", "l_linenumber", "from_h", "to_h", "first_day", "last_day", week.alias("second_week"))


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_before
    FROM events""")
def nearest_preceding(spark, sf_dir):
    return core.nearest_before(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click", "event_id", "click_before").select("event_id", "click_before")


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS category FROM events""")
def forward_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("category", F.when(F.col("event_type") == "signup", F.col("value")))
    return core.forward_fill(e, "user_id", ["ts", "event_id"], "category").select("event_id", "category")


@query("""
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
         r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d),
         i AS (SELECT user_id, min(day) AS "start", max(day) AS "end", count(*) AS days FROM r GROUP BY user_id, run)
    SELECT event_id, "start", "end", days FROM i JOIN events e ON i.user_id = e.user_id
    WHERE e.event_type = 'error' AND CAST(e.ts AS DATE) <= i."end" AND CAST(e.ts AS DATE) + 1 >= i."start" """)
def leave_overlap(spark, sf_dir):
    """Runs of active days beside two-day tasks that begin with an error."""
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    tasks = e.where("event_type = 'error'").select("user_id", "event_id", F.col("day").alias("start_t"), F.date_add("day", 1).alias("end_t"))
    return core.overlapping(tasks, core.islands(e, "user_id", "day"), "user_id").select("event_id", "start", "end", "days")


@query("""
    WITH n AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
    SELECT a.conv_id, a.n, a.turn AS left_value, b.turn AS right_value FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.n = b.n WHERE a.role = 'user' AND b.role = 'assistant'""")
def fifo_pair(spark, sf_dir):
    return core.paired(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "user", F.col("role") == "assistant", "turn")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def latest_history(spark, sf_dir):
    return core.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3")
def oldest_history(spark, sf_dir):
    return core.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3, newest=False).select("conv_id", "turn")


@query("""
    WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS new FROM events)
    SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def gap_sessions(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return core.gap_sessions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], at, at, F.lit(86_400_000_000)).select("event_id", "session")


@query("""
    WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS actual, 1.0 AS delta FROM events),
         t AS (SELECT user_id, day, event_type, first(actual ORDER BY event_id) AS f, last(actual ORDER BY event_id) AS l, sum(delta) AS s FROM e GROUP BY ALL),
         k AS (SELECT *, CASE WHEN f IS NULL OR l IS NULL THEN s ELSE l - (f - 1) END AS hours FROM t WHERE event_type <> 'error' OR l IS NULL OR abs(l - 50) <= 30)
    SELECT user_id, day, round(sum(hours), 2) + 0.0 AS logged, count(*) AS tasks FROM k GROUP BY ALL""")
def ledger_delta(spark, sf_dir):
    """Every seventh entry has no actual; the sheet says 50 for each task of kind error."""
    day = F.col("ts").cast("date").alias("day")
    e = table(spark, sf_dir, "events").select("user_id", day, "event_type", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.lit(1.0).alias("delta"))
    live = e.where("event_type = 'error'").select("user_id", "day", "event_type").distinct().withColumn("live", F.lit(50.0))
    return core.logged_today(e, ["user_id", "day"], "event_type", "event_id", "delta", "value", live, 30.0)


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, value AS p95 FROM r WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)""")
def telemetry_pct(spark, sf_dir):
    return core.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
    SELECT user_id, event_type AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS b FROM c) WHERE b = 1""")
def dominant_value(spark, sf_dir):
    return core.dominant(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""
    WITH v AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS run, event_type FROM events)
    SELECT user_id, event_type, count(*) AS k, count(*) >= 4 AS agreed FROM v GROUP BY ALL""")
def vote_majority(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("run"), "event_type")
    return core.verdict(e, "user_id", "run", "event_type", 7)


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return core.duplicates(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("""
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN d.v IS DISTINCT FROM l.quality THEN 'changed' ELSE 'same' END AS verdict
    FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS v FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def compare_full_outer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("v"))
    return core.compared(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v")), "doc_id", "v")


@query("SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5")
def relational_division(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("week", "ts").cast("date").alias("week"), "event_type")
    return core.linked_to_all(e, ["user_id", "week"], "event_type", 5)


@query("""
    SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders
    FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY r_name""")
def entity_graph_walk(spark, sf_dir):
    """A rollup of a tree: counts go up from orders to regions, so no level is multiplied by the one below."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))
    n = table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"), F.sum("customers").alias("customers"), F.sum("orders").alias("orders"))
    return table(spark, sf_dir, "region").join(n, "r_regionkey", "left").select(F.col("r_name").alias("region"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("nations", "customers", "orders")])


@query("""
    SELECT c_custkey AS person, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'yes' WHEN c_nationkey < 15 THEN 'no' ELSE 'unknown' END AS answer FROM customer""")
def three_valued_answer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), "c_nationkey")
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("person"))
    return core.three_valued(c.select("person"), big, "person", c.where("c_nationkey < 15"), True)


@query("SELECT doc_id FROM documents WHERE lang = 'en' OR source IN ('src1', 'src2') OR doc_id % 100 = 7 OR lang = 'fr'")
def acl_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "public").otherwise(F.col("lang")).alias("visibility"), F.array("source").alias("allowed_roles"), F.when(F.col("doc_id") % 100 == 7, F.array(F.lit("u7"))).otherwise(F.array().cast("array<string>")).alias("allowed_users"))
    return core.readable(d, "u7", ["src1", "src2", "editor"], {"fr": ["editor"], "de": ["owner"]}).select("doc_id")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_wins_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return core.latest(e, "key", ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
    WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
         s AS (SELECT q.vec_id AS id, v.vec_id AS vec, round(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(q.e AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS cosine FROM q JOIN embeddings v ON q.vec_id <> v.vec_id)
    SELECT id, vec, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, vec) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return core.cosine_top(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("vec"), F.col("embedding").alias("v")), 5)


@query("""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL),
         s AS (SELECT count(*) AS n, avg(len(ws)) AS m FROM t),
         f AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM t) WHERE w IN ('idiot', 'license', 'token') GROUP BY ALL),
         d AS (SELECT w, count(*) AS df FROM f GROUP BY w)
    SELECT doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))), 6) AS score FROM f JOIN d USING (w), s GROUP BY doc_id ORDER BY score DESC, doc LIMIT 20""")
def bm25_topk(spark, sf_dir):
    return core.bm25(table(spark, sf_dir, "documents").where("text IS NOT NULL"), ["idiot", "license", "token"], 20)


@query("""
    WITH l AS (SELECT event_id AS item, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events), u AS (SELECT user_id AS item, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
    SELECT item, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM l WHERE r <= 100 UNION ALL SELECT * FROM u WHERE r <= 100) GROUP BY item ORDER BY score DESC, item LIMIT 50""")
def rrf(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    e = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 100")
    return core.fused(e.select(F.col("event_id").alias("item"), "rank").union(e.select(F.col("user_id").alias("item"), "rank")), 50)


@query(r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bxox[baprs]-[A-Za-z0-9-]+', '[REDACTED_SLACK_TOKEN]', 'gi'), '\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'gi'), '\b(sk-[A-Za-z0-9_-]{12,})\b', '[REDACTED_API_KEY]', 'gi'),
           '(\b(?:password|passwd|secret|token)\s*[:=]\s*)[^\s,;]+', '\1[REDACTED]', 'gi')) AS digest FROM documents""")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("digest"))


STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""
    SELECT doc_id, CAST(len(list_filter(regexp_extract_all(strip_accents(replace(lower(coalesce(text, '')), 'đ', 'd')), '[a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN ({STOP_SQL}))) AS BIGINT) AS n_terms FROM documents""")
def qterms(spark, sf_dir):
    """X14 over all documents, with the folding of accents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.terms(F.coalesce("text", F.lit("")))).cast("long").alias("n_terms"))


def stream_segments(spark, sf_dir):
    """ST01-ST03 ST06: conversations as an arriving stream, cut into segments by keyed state; rows only, no SQL."""
    return segments.run_available(spark, f"{sf_dir}/conversations.parquet")


QUERIES["stream_segments"] = stream_segments
