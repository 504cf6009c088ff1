import hashlib

from ledgerloom.sources import files


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,note\nx,\"two\nlines\"\ny,\"a \"\"b\"\"\"\n".encode())
    assert [(r.row, r.name, r.note) for r in files.csv_rows(spark, f"{tmp_path}/a.csv").orderBy("row").collect()] == [(2, "x", "two\nlines"), (3, "y", 'a "b"')]


def test_pages(spark, tmp_path):
    for name, body in (("a.md", "---\ntitle: \"One\"\nversion: 2\n---\n# H\nsee [[b]] and [[c|C]] and [[b]]\n"), ("b.md", "# Two\n"), ("old.md", "---\nsuperseded_by: a\n---\nx"), ("index.md", "x"), ("c.txt", "x")):
        (tmp_path / name).write_text(body)
    got = {r.file: r for r in files.pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"].meta == {"title": "One", "version": "2"} and got["a.md"].links == ["b", "c"] and got["b.md"].title == "Two"


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"src": "x", "value": 1.5}, "l": [true, {"src": "y"}], "n": null}'), (2, "no json"), (3, "7"), (4, "{}")], "id int, j string")
    got = {(r.id, r.path): r.value for r in files.leaves(df, "id", "j").collect() if r.value is not None}
    assert got == {(1, "$.a.src"): "x", (1, "$.a.value"): "1.5", (1, "$.l[0]"): "true", (1, "$.l[1].src"): "y", (3, "$"): "7"}


def test_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, raw in (("a.bin", b"%PDF-1.7"), ("d/b.xlsx", b"PK\x03\x04abc"), ("c.TXT", b"hi"), ("noext", b"\x00")):
        (tmp_path / name).write_bytes(raw)
    got = {r.file: (r.size, r.kind, r.sha256) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"a.bin": (8, "pdf"), "b.xlsx": (7, "xlsx"), "c.TXT": (2, "text/plain"), "noext": (1, "binary")}
    assert got["c.TXT"][2] == hashlib.sha256(b"hi").hexdigest()
