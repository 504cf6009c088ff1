"""Queries of live streams, replayed over the tables; importing this adds them to the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import live, store
from .catalogue import query

DAY, QUARTER = 86_400_000, 21_600_000
NONE = "0 seconds"  # a replayed table is one batch: no row is late


@query("""
    WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
    SELECT a.conv_id, a.n, a.turn AS left_value, b.turn AS right_value FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.n = b.n WHERE a.role = 'user' AND b.role = 'assistant'""")
def live_pairs(spark, sf_dir):
    """ST09: a conversation's questions and answers as two streams."""
    c = live.table_stream(spark, f"{sf_dir}/conversations.parquet").where("role in ('user', 'assistant')")
    met = live.run_available(live.paired(c.select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), (F.col("role") == "assistant").alias("is_right"), F.col("turn").cast("string").alias("value"))))
    return met.select(F.col("key").alias("conv_id"), "n", F.col("left").cast("long").alias("left_value"), F.col("right").cast("long").alias("right_value"))


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, {{'at': (epoch_us(ts) // 1000), 'id': event_id}} AS e FROM events WHERE length(event_type) >= 5),
         r AS (SELECT user_id, min(e) AS e FROM e GROUP BY 1 UNION ALL SELECT user_id, (SELECT min(x.e) FROM e x WHERE x.user_id = r.user_id AND x.e.at >= r.e.at + {QUARTER}) FROM r WHERE e IS NOT NULL)
    SELECT user_id, e.at AS at, e.id AS event_id FROM r WHERE e IS NOT NULL""")
def throttled_events(spark, sf_dir):
    """ST07 ST14: one event in six hours of a user, of those whose name has five letters."""
    e = live.table_stream(spark, f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").alias("key"), live.millis(F.col("ts")).alias("at"), F.col("event_id").alias("row"), F.col("event_type").alias("text"), F.lit(False).alias("forced"))
    return live.run_available(live.throttled(rows, QUARTER, 5)).select(F.col("key").alias("user_id"), "at", F.col("row").alias("event_id"))


@query(f"""
    WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS "at", event_id, event_type, coalesce(count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM events),
         i AS (SELECT user_id, turn, min("at") FILTER (WHERE event_type = 'error') AS asked, max("at") FILTER (WHERE event_type = 'purchase') AS answered FROM e GROUP BY 1, 2)
    SELECT user_id, asked, answered AS "at", CASE WHEN answered > asked + {DAY} THEN 'late' ELSE 'accepted' END AS verdict FROM i WHERE asked IS NOT NULL AND answered IS NOT NULL
    UNION ALL SELECT user_id, asked, asked + {DAY}, 'expired' FROM i WHERE asked + {DAY} < coalesce(answered, (SELECT max((epoch_us(ts) // 1000)) FROM events))""")
def expiring_items(spark, sf_dir):
    """ST19: an error asks, a purchase answers, within a day; a second error gives no more time."""
    e = live.table_stream(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "ask").when(F.col("event_type") == "purchase", "answer").otherwise("tick")
    rows = e.select(F.col("user_id").alias("key"), live.millis(F.col("ts")).alias("at"), F.col("event_id").alias("row"), kind.alias("kind"))
    return live.run_available(live.expiring(rows, DAY, NONE)).withColumnRenamed("key", "user_id")


@query(f"""
    WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS "at", event_id, event_type, lead((epoch_us(ts) // 1000)) OVER w AS next, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id)),
         f AS (SELECT *, event_type <> 'view' AND (next - "at" > {DAY} OR (next IS NULL AND "at" + {DAY} < (SELECT max((epoch_us(ts) // 1000)) FROM events))) AS ends FROM e),
         g AS (SELECT *, coalesce(count(*) FILTER (WHERE ends) OVER (PARTITION BY user_id ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM f)
    SELECT user_id, n, max("at") FILTER (WHERE event_type <> 'view') AS last, string_agg(event_type, ' ' ORDER BY "at", event_id) FILTER (WHERE event_type <> 'view') AS text FROM g GROUP BY 1, 2 HAVING bool_or(ends)""")
def idle_segments(spark, sf_dir):
    """ST04: a user's events are tokens, views an interim tail; a day of silence ends a segment, but not while a view is the last that came."""
    e = live.table_stream(spark, f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").alias("key"), live.millis(F.col("ts")).alias("at"), F.col("event_id").alias("row"), (F.col("event_type") != "view").alias("final"), F.concat(F.col("event_type"), F.lit(" ")).alias("token"))
    return live.run_available(live.idle_flushed(rows, DAY, NONE)).withColumnRenamed("key", "user_id")


@query("""
    WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS channel, CAST(event_id % 9 AS VARCHAR) AS ts, CASE WHEN event_type = 'signup' THEN 'other' WHEN event_id % 9 = 0 THEN '' ELSE '0' END AS thread_ts, event_type, value FROM events),
         m AS (SELECT *, channel || ':' || ts AS message_key, row_number() OVER (PARTITION BY channel, ts ORDER BY seq DESC) AS back, min(seq) OVER (PARTITION BY channel, ts) AS created FROM e WHERE thread_ts <> 'other')
    SELECT message_key, channel || ':0' AS thread, seq, CASE WHEN event_type = 'view' THEN 'assistant' ELSE 'user' END AS role, event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS text, event_type = 'click' AS edited, event_type = 'error' AS deleted, created FROM m WHERE back = 1""")
def stored_messages(spark, sf_dir):
    """ST18 K09: events as messages of nine to a channel, written again, edited, deleted or of another thread, merged into a stored table."""
    folder = f"{live.shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    e, kind = live.table_stream(spark, f"{sf_dir}/events.parquet"), F.col("event_type")
    ts = (F.col("event_id") % 9).cast("string")
    thread = F.when(kind == "signup", "other").when(ts == "0", "").otherwise("0")
    said = F.concat_ws(" ", kind, F.floor("value").cast("string"))
    events = e.select(F.col("user_id").cast("string").alias("channel"), ts.alias("ts"), thread.alias("thread_ts"), said.alias("text"), (kind == "view").alias("bot"), F.when(kind == "error", "message_deleted").alias("subtype"), (kind == "click").alias("edited"), F.col("event_id").alias("seq"))
    table = store.Store(spark, f"{folder}/table", "message_key", "seq", 16)
    table.follow(store.messages(events, F.lit("0")), f"{folder}/state")
    return table.read()


@query("""
    WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS "at", event_id, event_type, event_id % 3 AS idx, event_type = 'purchase' AND event_id % 20 = 0 AS direct FROM events),
         f AS (SELECT user_id, min({'at': "at", 'id': event_id}) AS first FROM e WHERE direct GROUP BY 1),
         p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, idx ORDER BY "at", event_id) AS before FROM e LEFT JOIN f USING (user_id) WHERE NOT direct AND (first IS NULL OR {'at': "at", 'id': event_id} < first))
    SELECT user_id, "at", event_id, idx, event_type AS text FROM p WHERE before IS DISTINCT FROM event_type UNION ALL SELECT user_id, "at", event_id, idx, event_type FROM e WHERE direct""")
def preferred_source(spark, sf_dir):
    """ST11: a user is a room; some purchases are its direct stream, all other events are polled."""
    e = live.table_stream(spark, f"{sf_dir}/events.parquet")
    direct = (F.col("event_type") == "purchase") & (F.col("event_id") % 20 == 0)
    rows = e.select(F.col("user_id").alias("key"), live.millis(F.col("ts")).alias("at"), F.col("event_id").alias("row"), direct.alias("direct"), (F.col("event_id") % 3).alias("idx"), F.col("event_type").alias("text"))
    return live.run_available(live.preferred(rows)).select(F.col("key").alias("user_id"), "at", F.col("row").alias("event_id"), "idx", "text")


@query("""
    WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS "at", event_id, event_type IN ('view', 'error') AS result, left('abababab', event_id % 7) AS t, left('abababab', CAST(floor(value) AS BIGINT) % 7) || CASE WHEN event_id % 4 = 0 THEN 'x' ELSE '' END AS made_for FROM events),
         x AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY "at", event_id), '') AS before FROM e WHERE NOT result),
         v AS (SELECT user_id, "at", event_id, t, sum(CASE WHEN starts_with(t, before) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY "at", event_id) AS version FROM x),
         m AS (SELECT e.*, v.t AS now, v.version AS version, row_number() OVER (PARTITION BY e.event_id ORDER BY v."at" DESC, v.event_id DESC) AS back FROM e LEFT JOIN v ON e.user_id = v.user_id AND {'at': v."at", 'id': v.event_id} < {'at': e."at", 'id': e.event_id} WHERE result)
    SELECT user_id, "at", event_id, coalesce(version, 0)::BIGINT AS version, starts_with(coalesce(now, ''), made_for) AS fresh FROM m WHERE back = 1""")
def fresh_results(spark, sf_dir):
    """ST13: a user's events set a text of up to six letters, views and errors are results for a text of their own length."""
    e = live.table_stream(spark, f"{sf_dir}/events.parquet")
    letters = lambda n: F.substring(F.lit("abababab"), F.lit(1), n.cast("int"))
    made_for = F.concat(letters(F.floor("value") % 7), F.when(F.col("event_id") % 4 == 0, "x").otherwise(""))
    rows = e.select(F.col("user_id").alias("key"), live.millis(F.col("ts")).alias("at"), F.col("event_id").alias("row"), F.col("event_type").isin("view", "error").alias("result"), letters(F.col("event_id") % 7).alias("text"), made_for.alias("made_for"))
    return live.run_available(live.fresh_results(rows)).select(F.col("key").alias("user_id"), "at", F.col("row").alias("event_id"), "version", "fresh")


@query("""
    WITH e AS (SELECT user_id || ':' || (event_id // 10) % 40 AS k, event_id, event_type, event_id % 10 < 9 AS early FROM events),
         b AS (SELECT k, max(event_id) AS event_id, min(event_id) AS created FROM e WHERE early GROUP BY 1), n AS (SELECT k, max(event_id) AS event_id, min(event_id) AS created FROM e GROUP BY 1),
         t AS (SELECT 'backlog' AS part, * FROM b UNION ALL SELECT 'live', * FROM (SELECT * FROM n EXCEPT SELECT * FROM b))
    SELECT part, k, event_id, event_type, created FROM t JOIN e USING (k, event_id)""")
def late_subscriber(spark, sf_dir):
    """ST12: nine tenths of the events are merged before someone joins, who gets them as a backlog and then only what the rest changed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws(":", "user_id", F.floor(F.col("event_id") / 10) % 40).alias("k"), "event_id", "event_type")
    table = store.Store(spark, f"{live.shared_folder(spark)}/events-{uuid.uuid4().hex}", "k", "event_id", 16)
    parts, seen = [], None
    for batch, part in enumerate(("backlog", "live")):
        table.merge(e.where((F.col("event_id") % 10 < 9) == (part == "backlog")), batch)
        seen, rows = table.changes(seen)
        parts.append(rows.select(F.lit(part).alias("part"), "k", "event_id", "event_type", "created"))
    return parts[0].union(parts[1])
