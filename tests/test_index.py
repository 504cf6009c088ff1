"""The stored index against the search without one; pointers case by case."""

import pytest
from compare import same
from ledgerloom.operators import core, index
from ledgerloom.plans import catalogue
from ledgerloom.plans import index as plans  # noqa: F401


def test_index_gives_what_the_search_gives(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL")
    path = f"{tmp_path}/i"
    told = index.build(docs, path)
    for words in (["the", "license"], ["nicht", "zzqx"], ["zzqx"], []):
        want = [tuple(r) for r in core.bm25(docs, words, 15).collect()] if words else []
        got = index.search(spark, path, words, 15, docs)
        assert [tuple(r) for r in got.collect()] == want
    # Only the buckets of the words are read.
    plan = index.search(spark, path, ["license"], 5)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    allowed = docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "doc")
    best = [r.doc for r in index.search(spark, path, ["the"], 40).collect()]
    assert [r.doc for r in index.search(spark, path, ["the"], 5, allowed=allowed).collect()] == [d for d in best if d % 2 == 0][:5]
    assert told["documents"] == docs.count()


def test_words_are_counted_where_texts_are_read(spark, tmp_path, monkeypatch):
    """One shuffle, of a document's distinct words; also where a text has more words than are handed on at a time, capitals that grow when lowered, or none."""
    monkeypatch.setattr(index, "LOT", 3)
    given = [(1, "A b a B a c d"), (2, None), (3, ""), (4, "\u0130x \u212a9 -"), (5, "a")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    wanted = {(1, 7, "a", 3), (1, 7, "b", 2), (1, 7, "c", 1), (1, 7, "d", 1), (4, 3, "i", 1), (4, 3, "x", 1), (4, 3, "k9", 1), (5, 1, "a", 1)}
    counted = index.counted_words(docs, "doc_id", "text")
    assert {tuple(r) for r in counted.collect()} == wanted and "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    told = index.build(docs, f"{tmp_path}/i")
    assert (told["documents"], told["words"]) == (5, 11)
    assert {(r.doc, r.dl, r.term, r.tf) for r in index.stored(spark, f"{tmp_path}/i", "bigint").collect()} == wanted


def test_rows_of_one_id_count_as_without_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a a c"), (2, "c d"), (None, "a"), (None, "a"), (3, "d d d d")], "doc_id long, text string")
    index.build(docs, f"{tmp_path}/i")
    for words in (["a"], ["a", "c"]):
        want = core.bm25(docs, words, 9).collect()
        assert want and index.search(spark, f"{tmp_path}/i", words, 9, docs).collect() == want


def test_stale_index_is_refused(spark, tmp_path):
    kind = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], kind)
    path = f"{tmp_path}/i"
    with pytest.raises(index.StaleIndex):
        index.search(spark, path, ["a"], 5)
    index.build(docs, path)
    assert [r.doc for r in index.search(spark, path, ["A"], 5, docs.repartition(3)).collect()] == [1]
    for other in ([(1, "a c"), (2, None), (3, "")], [(1, "a b"), (2, None)], [(1, "a b"), (2, ""), (3, None)], [(2, "a b"), (1, None), (3, "")]):
        with pytest.raises(index.StaleIndex, match="other documents"):
            index.search(spark, path, ["a"], 5, spark.createDataFrame(other, kind))
    none = spark.createDataFrame([], kind)
    index.build(none, f"{tmp_path}/n")
    assert index.search(spark, f"{tmp_path}/n", ["a"], 5, none).collect() == []


def test_pointers(spark):
    payloads = spark.createDataFrame([("a.json", '{"facts": {"x": {"y": {"value": 3, "l": [1, {"s": "t"}]}}}, "version": 2}', True), ("b.json", '{"x": "plain"}', True), ("old.json", '{"x": 1}', False), ("bad.json", "{", True)], "file string, json string, current boolean")
    given = {"a.json#x.y.value": ("found", "3"), "a.json#x.y": ("node", None), "a.json#x.y.l[1].s": ("found", "t"), "a.json#version": ("missing", None), "b.json#x": ("found", "plain"), "b.json#x.z": ("missing", None), "old.json#x": ("superseded", None), "none.json#x": ("missing", None), "bad.json#x": ("missing", None)}
    got = index.dereferenced(spark.createDataFrame([(p,) for p in given], "p string"), payloads, "p").collect()
    assert {r.p: (r.verdict, r.value) for r in got} == given and len(got) == len(given)


@pytest.mark.parametrize("name", ["bm25_indexed", "dereferenced_facts"])
def test_as_sql(spark, name):
    assert not same(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.01")
