from ledgerloom.operators import shapes
from pyspark.sql import functions as F


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_roles_meetings_and_closed_values(spark):
    aliases = {"kiem-thu": "qa", "backend": "developer"}
    df = spark.createDataFrame([("Kiểm  Thử",), ("BACKEND!",), ("lead",), ("", ), (None,)], "r string")
    assert [r.c for r in df.select(shapes.role(F.col("r"), aliases, ["lead"]).alias("c")).collect()] == ["qa", "developer", "lead", "general", "general"]
    assert tuple(one(spark, shapes.meeting(F.lit("https://meet.google.com/abc-defg-hij?x=1")))) == ("google_meet", "abc-defg-hij")
    assert tuple(one(spark, shapes.meeting(F.lit("https://us02.zoom.us/wc/join/123456")))) == ("zoom", "123456")
    assert one(spark, shapes.meeting(F.lit("https://example.com"))) is None
    assert one(spark, shapes.closed_value(["high", "highest"], F.lit("the highest one"))) == "highest"
    assert one(spark, shapes.closed_value(["high"], F.lit("higher"))) is None
    assert one(spark, shapes.closed_value(["a+b"], F.lit("is a+b."))) == "a+b"


def test_forms_dates_and_teasers(spark):
    assert one(spark, shapes.numeric_forms(F.lit(0.25), F.lit("ratio"))) == ["0.25", "25"]
    assert one(spark, shapes.numeric_forms(F.lit(4300.0), F.lit("hours"))) == ["4300"]
    assert one(spark, shapes.numeric_forms(F.lit(None).cast("double"), F.lit("ratio"))) == []
    assert [one(spark, shapes.shown_date(F.lit(x))) for x in ("2024-05-06T07:00", "May", " ", None)] == ["06/05/2024", "May", "chưa ghi nhận", "chưa ghi nhận"]
    assert one(spark, shapes.teaser(F.lit(None).cast("string"))) == shapes.NO_TEASER
    assert one(spark, shapes.teaser(F.lit("# CHƯƠNG 1. X\n\nshort\n\n--- " + "a" * 50 + "\n\n[[page 2]] " + "b | " * 20))) == "b \\| " * 19 + "b \\|"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page string, doc string, version int, by string, room int, idx int, text string")
    assert shapes.retired(none, none, 2).count() == 0
    assert shapes.closed_versions(none.select("page", "version"), none).count() == 0
    assert shapes.transcript_segments(none).count() == 0
    assert shapes.chunk_prints(none, "page", "text").count() == 0
