"""Queries of the stored index and of pointers; importing this adds them to the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import index
from ..streaming.live import shared_folder
from .catalogue import ORACLE_SQL, query, table


@query(ORACLE_SQL["bm25_topk"])
def bm25_indexed(spark, sf_dir):
    """The documents' index is made, stored and asked."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.build(docs, path)
    return index.search(spark, path, ["idiot", "license", "token"], 20, docs)


@query("""
    WITH p AS (SELECT event_id, event_id % 4 AS k, props, event_id % 7 <> 0 AS current FROM events)
    SELECT event_id, CASE WHEN NOT current THEN 'superseded' WHEN k = 2 THEN 'missing' WHEN k = 3 THEN 'node' ELSE 'found' END AS verdict,
           CASE WHEN NOT current OR k >= 2 THEN NULL WHEN k = 0 THEN CAST(event_id AS VARCHAR) ELSE json_extract_string(props, '$.' || json_keys(props)[1]) END AS value FROM p""")
def dereferenced_facts(spark, sf_dir):
    """An event's properties are a file's facts, beside its id; pointers at a scalar, at a property, at nothing and at an object."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    file = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    payloads = e.select(file.alias("file"), F.concat(F.lit('{"facts": {"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit("}}")).alias("json"), (F.col("event_id") % 7 != 0).alias("current"))
    first = F.regexp_extract("props", '"([^"]+)"', 1)
    way = F.when(k == 0, "id").when(k == 1, F.concat(F.lit("props."), first)).when(k == 2, "props.none.at").otherwise("props")
    asked = e.select("event_id", F.concat(file, F.lit("#"), way).alias("pointer"))
    return index.dereferenced(asked, payloads, "pointer").drop("pointer")
