"""Queries of answers, citations, segments and page versions; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes
from .catalogue import query, table


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS segment, CAST(NULL AS VARCHAR) AS beyond FROM customer")
def sheet_cells(spark, sf_dir):
    row = F.array("c_name", F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", shapes.cell(row, "b").alias("segment"), shapes.cell(row, "C").alias("beyond"))


STATUSES = ["Open", " Đã  hoàn thành!", "DONE ✅", "not done", "Xong.", "đã xong", "Completed?", "hoan tat 1"]


@query("""
    WITH s AS (SELECT o_orderkey, ['Open', ' Đã  hoàn thành!', 'DONE ✅', 'not done', 'Xong.', 'đã xong', 'Completed?', 'hoan tat 1'][o_orderkey % 8 + 1] AS s FROM orders),
         t AS (SELECT o_orderkey, trim(regexp_replace(lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))), '[^0-9a-zà-ỹ\\s]', '', 'g')) AS t FROM s)
    SELECT o_orderkey, trim(regexp_replace(t, '^đã\\s+', '')) IN ('done', 'completed', 'finished', 'xong', 'hoàn thành', 'hoan thanh', 'hoàn tất', 'hoan tat') AS done FROM t""")
def done_statuses(spark, sf_dir):
    """Orders have statuses as people write them, by their key."""
    said = F.get(F.array(*map(F.lit, STATUSES)), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shapes.is_done(said).alias("done"))


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS ratio, CAST(l_discount AS DECIMAL(30, 10)) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(CAST(d AS VARCHAR), '0+$', ''), '\\.$', '') || CASE WHEN ratio AND d <> 0 THEN ',' || regexp_replace(regexp_replace(CAST(CAST(d * 100 AS DECIMAL(32, 10)) AS VARCHAR), '0+$', ''), '\\.$', '') ELSE '' END AS forms FROM l""")
def discount_forms(spark, sf_dir):
    """The discounts of returned lines are ratios; 0 has one form."""
    forms = shapes.numeric_forms(F.col("l_discount"), F.when(F.col("l_returnflag") == "R", "ratio"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(forms, ",").alias("forms"))


@query("""
    SELECT event_id, CASE WHEN regexp_matches(props, '(^|\\W)69(\\W|$)') THEN '69' WHEN regexp_matches(props, '(^|\\W)12(\\W|$)') THEN '12' WHEN regexp_matches(props, '(^|\\W)6(\\W|$)') THEN '6' WHEN regexp_matches(props, '(^|\\W)1(\\W|$)') THEN '1' END AS value FROM events""")
def closed_values(spark, sf_dir):
    """6 is not found in 69, nor 1 in 12."""
    return table(spark, sf_dir, "events").select("event_id", shapes.closed_value(["6", "69", "1", "12"], F.col("props")).alias("value"))


@query("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'in_kb' WHEN 'O' THEN 'not_in_kb' WHEN 'P' THEN 'confident_no' ELSE 'error' END AS status,
           CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_custkey % 3 = 1) THEN 'high' WHEN o_orderstatus = 'F' THEN 'medium' ELSE 'none' END AS confidence FROM orders""")
def answer_shapes(spark, sf_dir):
    outcome = F.when(F.col("o_orderstatus") == "F", "found").when(F.col("o_orderstatus") == "O", "missing").when(F.col("o_orderstatus") == "P", "no")
    return table(spark, sf_dir, "orders").select("o_orderkey", shapes.answer_shape(outcome, F.col("o_custkey") % 3).alias("a")).select("o_orderkey", "a.*")


@query("""
    WITH o AS (SELECT o_orderkey, 'wiki/' || o_clerk_ AS cite, strftime(o_orderdate, '%d/%m/%Y') AS day, o_orderkey % 4 AS k, o_orderstatus AS s, o_orderpriority AS p FROM (SELECT *, 'o' || o_custkey AS o_clerk_ FROM orders))
    SELECT o_orderkey, CASE WHEN k = 0 THEN 'Nguồn: `' || split_part(cite, '/', 2) || '` · cập nhật ngày chưa ghi nhận · bởi chưa ghi nhận'
           ELSE 'Nguồn: `' || CASE WHEN k = 1 THEN 'mail' ELSE p END || '` · cập nhật ngày ' || CASE WHEN k = 3 THEN 'chưa ghi nhận' ELSE day END || ' · bởi ' || CASE WHEN s = 'F' THEN 'chưa ghi nhận' ELSE s END END
           || CASE WHEN s = 'O' THEN ' · phạm vi ' || p ELSE '' END AS cited FROM o""")
def public_citations(spark, sf_dir):
    """Every fourth order is no known document; others have an origin, a name alone, or no date."""
    k, s = F.col("o_orderkey") % 4, F.col("o_orderstatus")
    day = F.when(k == 3, "").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00:00")))
    cite = F.concat(F.lit("wiki/o"), F.col("o_custkey").cast("string"))
    shown = shapes.citation(cite, F.when(k == 1, " mail "), F.col("o_orderpriority"), day, F.when(s != "F", s), F.when(s == "O", F.col("o_orderpriority")), k != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("cited"))


@query("""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS b, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
         c AS (SELECT doc_id, list_concat(list_filter(b, lambda x: length(x) BETWEEN 18 AND 60), list_filter(p, lambda x: length(x) >= 35)) AS c FROM d)
    SELECT doc_id, sha256(array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:5], chr(10))) AS points FROM c""")
def page_points(spark, sf_dir):
    """Sentences of at most 60 characters are bullets, lines are paragraphs."""
    t = F.coalesce("text", F.lit(""))
    bullets = F.filter(F.split(t, r"\. "), lambda x: F.char_length(x) <= 60)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(shapes.source_points(bullets, F.split(t, "\n")), "\n"), 256).alias("points"))


@query("""
    WITH d AS (SELECT doc_id, '## Chương ' || doc_id % 7 || '. A title that is long enough to be a paragraph' || chr(10) || chr(10) || replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), ',', ' |') AS t FROM documents),
         p AS (SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(t, '(?im)^\\s*#{0,6}\\s*chương\\s+\\d+\\.[^\\n]*$', '', 'g'), '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS p FROM d),
         f AS (SELECT doc_id, replace(list_filter(p, lambda x: length(x) >= 40 AND NOT starts_with(x, '---'))[1], '|', '\\|') AS f FROM p)
    SELECT doc_id, CASE WHEN f IS NULL THEN 'Nội dung chi tiết được lập chỉ mục tại trang chương tương ứng.' WHEN length(f) > 280 THEN rtrim(substr(f, 1, 280)) || '…' ELSE f END AS teaser FROM f""")
def chapter_teasers(spark, sf_dir):
    """Sentences are paragraphs, below a chapter's title; commas become bars, which a teaser escapes."""
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n")), F.lit(","), F.lit(" |"))
    title = F.concat(F.lit("## Chương "), (F.col("doc_id") % 7).cast("string"), F.lit(". A title that is long enough to be a paragraph\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", shapes.teaser(F.concat(title, t)).alias("teaser"))


@query("""
    WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''), c AS (SELECT doc_id, h, unnest(range(0, (length(h) + 511) // 512)) AS k FROM h)
    SELECT DISTINCT doc_id, left(sha256(unhex(substr(h, k * 512 + 1, 512))), 16) AS print FROM c""")
def document_prints(spark, sf_dir):
    """Chunks of 256 bytes, as most texts are below the 4096 of files."""
    return shapes.chunk_prints(table(spark, sf_dir, "documents"), "doc_id", "text", 256)


@query("""
    SELECT conv_id AS room, turn AS idx, CASE WHEN turn % 3 = 0 THEN 'Speaker' WHEN turn % 3 = 1 THEN 'name ' || role ELSE role END AS speaker, CASE WHEN turn % 2 = 0 THEN 'en' ELSE '' END AS language, trim(text) AS text,
           CAST(turn AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS "end" FROM conversations WHERE trim(text) <> '' AND turn % 5 <> 4""")
def transcript_segments(spark, sf_dir):
    """Turns with speakers in one column or the other, or none, languages in capitals, and blank texts."""
    t = F.col("turn")
    raw = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("room"), t.alias("idx"), F.when(t % 3 == 2, F.col("role")).otherwise("").alias("speaker"), F.when(t % 3 == 1, F.concat(F.lit("name "), F.col("role"))).alias("speaker_name"), F.when(t % 2 == 0, "EN").alias("lang"), F.when(t % 5 == 4, "  \n").otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).alias("text"), t.alias("start_time"))
    return shapes.transcript_segments(raw)


@query("SELECT event_id, event_type, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def kept_telemetry(spark, sf_dir):
    """The last 5 days up to the latest event, as the table spans few."""
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])
    seen = e.select("event_id", "event_type", "ts", F.col("user_id").alias("actor"), F.col("props").alias("content"))
    return shapes.kept_telemetry(seen, "ts", now, 5)


@query("""
    WITH n AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)
    SELECT p_partkey AS page, p_brand AS doc, CASE WHEN l_partkey IS NULL THEN 3 END AS retired_in, CASE WHEN l_partkey IS NULL THEN 'wiki/sources/' || p_brand || '.md' END AS retired_by FROM part LEFT JOIN n ON p_partkey = l_partkey""")
def retired_pages(spark, sf_dir):
    """Parts are pages; those in large lines are in version 3 too."""
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("page"))
    return shapes.retired(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_brand").alias("doc")), new, 3)


@query("""
    WITH c AS (SELECT 'c' || c_custkey AS page, c_nationkey AS version, c_nationkey < 10 AS planned FROM customer), p AS (SELECT * FROM c UNION ALL SELECT page || '@v' || version, version, false FROM c WHERE version = 4)
    SELECT CASE WHEN planned AND version <> 4 THEN page || '@v' || version ELSE page END AS page, version, CASE WHEN planned AND version <> 4 THEN 'new/' || page END AS superseded_by, planned AND version = 4 AS refused FROM p""")
def closed_versions(spark, sf_dir):
    """Customers are pages, their nation the version; version 4 was archived before, so it is refused."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("page"), F.col("c_nationkey").alias("version"))
    old = c.where("version = 4").select(F.concat("page", F.lit("@v4")).alias("page"), "version")
    return shapes.closed_versions(c.unionByName(old), c.where("version < 10").select("page", F.concat(F.lit("new/"), "page").alias("by")))
