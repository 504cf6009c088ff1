"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Null and empty texts pass the first three stages unchanged (they score as clean, have no near copy and no span); mixing takes no word of
them, so they end there. Rows without id are no copies of any and stay. Of rows with one id, near-dedup keeps one: the
smallest by text and the other columns. An empty table gives empty stages. Columns besides those of ``documents`` are dropped by
the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, near_dedup, packing, pii, queries, toxicity
from ledgerloom.llm.common import delete, maybe_in, new_path, settled, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learnt from all labelled rows but the held-out ones."""
    net = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), queries.held_out)
    return toxicity.score(docs.select(*COLUMNS), net).where(F.col("score") < queries.THRESHOLD).drop("score")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, and of rows with one id the smallest."""
    ship(spark)

    def ids() -> DataFrame:
        told = near_dedup.near_duplicates(docs).where("doc_id is not null")
        return told.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")

    named = settled(spark, ids, "named")
    rows = maybe_in(docs.select(*COLUMNS), "doc_id", named, name="_may")
    # Only rows that may be left out or repeated are shuffled.
    held = rows.where("_may").drop("_may").join(named, "doc_id", "left")
    once = held.where("kept and n > 1").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return rows.where("not _may").drop("_may").unionByName(held.where("n is null").select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data."""
    ship(spark)
    return pii.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, in their documents: a row for each time over that it reads some of a document."""
    ship(spark)
    return mixing.mixed_texts(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(packing.pieces(docs, queries.vocabulary()))


STAGES = [("toxicity", non_toxic), ("near_dedup", deduplicated), ("pii", sanitised), ("mixing", mixed), ("packing", packed)]

#: A trained network, a pseudorandom mix and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
