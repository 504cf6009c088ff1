"""Queries of near-duplicate files, mentions and digests; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes, similar
from .catalogue import query, table


@query("""
    WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''), c AS (SELECT doc_id, h, unnest(range(0, (length(h) + 511) // 512)) AS k FROM h),
         p AS (SELECT DISTINCT doc_id, left(sha256(unhex(substr(h, k * 512 + 1, 512))), 16) AS p FROM c), s AS (SELECT doc_id, list(p ORDER BY p) AS s, count(*) AS n FROM p GROUP BY 1),
         m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS node, n FROM s), r AS (SELECT DISTINCT node, n FROM m),
         b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM p x JOIN p y ON x.p = y.p AND x.doc_id <> y.doc_id WHERE x.doc_id IN (SELECT node FROM r) AND y.doc_id IN (SELECT node FROM r) GROUP BY 1, 2),
         l AS (SELECT a, count(*) AS links FROM b JOIN r u ON a = u.node JOIN r v ON b = v.node WHERE 5 * k >= 3 * (u.n + v.n - k) GROUP BY 1)
    SELECT doc_id, node, coalesce(links, 0) AS links FROM m LEFT JOIN l ON node = a""")
def near_duplicate_files(spark, sf_dir):
    """J12 by content: documents are files, in chunks of 256 bytes, as most are below the 4096 of files."""
    return similar.near_duplicate_files(shapes.chunk_prints(table(spark, sf_dir, "documents"), "doc_id", "text", 256), "doc_id")


NAMES = "n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark)"


@query(f"""
    WITH {NAMES}, d AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS ws FROM documents WHERE text IS NOT NULL),
         f AS (SELECT doc_id, name FROM d, n WHERE CASE WHEN length(name) <= 2 THEN list_contains(ws, name) ELSE contains(t, name) END)
    SELECT doc_id, count(*) AS names, sum(length(name))::BIGINT AS letters, min(name) AS first_name, max(name) AS last_name FROM f GROUP BY 1""")
def mentioned_names(spark, sf_dir):
    """All words of the benchmark are names; those of one or two letters must stand alone."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    names = table(spark, sf_dir, "benchmark").select(word.alias("name")).distinct()
    found = similar.mentions(table(spark, sf_dir, "documents"), names, "doc_id", F.lower("text"), F.col("name"), "name")
    return found.groupBy("doc_id").agg(F.count("*").alias("names"), F.sum(F.char_length("name")).alias("letters"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("""
    WITH c AS (SELECT l_orderkey, l_returnflag AS sheet, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS place, l_linenumber AS row, unnest([1, 2]) AS col, unnest([l_linestatus, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) END]) AS value FROM lineitem),
         s AS (SELECT l_orderkey, place, sheet, coalesce(string_agg('{"row":' || row || ',"col":' || col || ',"value":"' || value || '"}', ',' ORDER BY row, col, value) FILTER (WHERE value IS NOT NULL), '') AS cells FROM c GROUP BY 1, 2, 3)
    SELECT l_orderkey, sha256(string_agg('{"sheet":"' || sheet || '","cells":[' || cells || ']}', chr(10) ORDER BY place)) AS digest FROM s GROUP BY 1""")
def sheet_digests(spark, sf_dir):
    """An order is a workbook, its lines rows of a sheet for each return flag; every third row has an empty cell."""
    n = F.col("l_linenumber")
    cells = F.array(F.struct(F.lit(1).alias("col"), F.col("l_linestatus").alias("value")), F.struct(F.lit(2).alias("col"), F.when(n % 3 != 0, F.col("l_partkey").cast("string")).alias("value")))
    place = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("place"), F.col("l_returnflag").alias("sheet"), n.cast("int").alias("row"), F.explode(cells).alias("c")).select("l_orderkey", "place", "sheet", "row", "c.col", "c.value")
    return similar.sheet_digest(rows, "l_orderkey")
