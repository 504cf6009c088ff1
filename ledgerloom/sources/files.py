"""Files as tables: numbered CSV rows, Markdown pages with front matter, JSON facts, an inventory of a folder.

"""

from __future__ import annotations

import mimetypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The first bytes of files, as hex digits, and their kinds; kinds of zip files and of Markdown by their suffix.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("89504E47", "image"), ("FFD8FF", "image"))
ZIPPED = ("xlsx", "docx", "pptx")
MARKDOWN = ("md", "markdown")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """[S11] file, row (from 2, the header being 1) and the columns of CSV files, which may begin with a byte order mark."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])
    w = Window.partitionBy("file").orderBy("_at")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"), *rows.columns).withColumn("row", F.row_number().over(w) + 1).drop("_at")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """[S12 S13] file, meta, body, title, links of the current Markdown pages: no index, no log, none that another supersedes."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^﻿|\r", "").alias("t"))
    front = r"(?s)^---\n(.*?)\n---\n"
    lines = F.filter(F.split(F.regexp_extract("t", front, 1), "\n"), lambda x: x.rlike(r"^\w+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^\w+:", "")), "^[\"']|[\"']$", "").alias("v")))
    p = text.select("file", F.map_from_entries(pairs).alias("meta"), F.regexp_replace("t", front, "").alias("body"))
    p = p.where(~F.col("file").isin("index.md", "log.md") & (F.coalesce(F.col("meta")["superseded_by"], F.lit("")) == ""))
    title = F.coalesce(F.col("meta")["title"], F.nullif(F.regexp_extract("body", r"(?m)^# +(.+)$", 1), F.lit("")), F.col("file"))
    return p.select("file", "meta", "body", title.alias("title"), F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("links"))


def leaves(rows: DataFrame, key: str, json: str) -> DataFrame:
    """[S17 S18] key, path, value of each scalar in JSON texts, however deep; texts that are no JSON give none.

    Each level is one step over all rows; a level without objects and arrays is the last.
    """
    level = rows.select(F.col(key), F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    done = None
    while True:
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        flat = level.where(~nested).select(key, "path", F.variant_get("v", "$", "string").alias("value"))
        done = flat if done is None else done.unionByName(flat)
        level = level.where(nested)
        if not level.take(1):
            return done
        step = F.when(F.col("k").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("k")))
        each = level.select(key, "path", "v").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "w"))
        level = each.select(key, F.concat("path", step).alias("path"), F.col("w").alias("v"))

def inventory(spark: SparkSession, path: str) -> DataFrame:
    """[S21] file, size, sha256, kind of each file under path; the kind by its first bytes, else the type that its suffix stands for, else ``binary``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head, suffix = F.hex(F.substring("content", 1, 8)), F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    magic = F.coalesce(*[F.when(head.startswith(m), F.lit(k)) for m, k in MAGIC], F.lit(None))
    types = F.create_map(*[F.lit(x) for k, v in sorted(mimetypes.types_map.items()) for x in (k[1:], v)])
    kind = F.when((magic == "zip") & suffix.isin(*ZIPPED), suffix).otherwise(F.coalesce(magic, F.when(suffix.isin(*MARKDOWN), "text/markdown"), F.try_element_at(types, suffix), F.lit("binary")))
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"))
