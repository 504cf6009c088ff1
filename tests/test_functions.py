import unicodedata

from ledgerloom.functions import text
from ledgerloom.streaming.segments import fold, run_available
from pyspark.sql import functions as F


def values(spark, f, *given):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_text(spark):
    assert values(spark, text.fold, "Đặng Văn-Ứng", None) == ["dang van-ung", None]
    assert values(spark, text.ascii_words, "Đô thị!") == ["o thi"]
    assert values(spark, text.redact, "a token=abc Bearer xyz xoxb-12-ab") == ["a token=[REDACTED] Bearer [REDACTED] [REDACTED_SLACK_TOKEN]"]
    assert values(spark, text.slug, " Xin chào, bạn! ") == ["xin-chao-ban"]


def test_numbers_and_dates(spark):
    assert values(spark, text.local_number, "480,0", "32,88%", "8h", "1.234,5", "x", "") == [480.0, 32.88, 8.0, 1234.5, None, None]
    assert values(spark, text.canonical_number, "1.234.567", "1,234", "45.50", "007", "12,") == ["1234567", "1234", "45.5", "7", "12"]
    assert [str(x) for x in values(spark, text.day_month_year, "27-7-2026", "03-8-2026", "2026-07-27", "31-02-2026")] == ["2026-07-27", "2026-08-03", "None", "None"]
    assert str(values(spark, text.sprint_end, "2026/08/09（CN）")[0]) == "2026-08-07"
    assert values(spark, text.is_off, "off", "0", "8", "", None, "-", "P", "0,0", "nghỉ phép", "-1", "họp", "0,5") == [True, True, False, True, True, True, True, True, True, True, False, False]
    assert values(spark, text.file_identity, "prev.docx", "plan_v2_final.xlsx", "Kế hoạch (rev 3).md", "a-copy2.tar.gz", "b final.pdf") == ["prev", "plan", "k-ho-ch-rev-3", "a-copy2-tar", "b"]


def test_fold_is_decomposition_without_marks(spark):
    letters = [chr(i) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]] + ["e\u0301", "Ứ", "Łódź"]
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")
    assert values(spark, text.fold, *letters) == [strip(x) for x in letters]


def test_secrets_and_threads(spark):
    given = ["sk-abcdefghijkl", "Bearer   abc.def", "password  =  x1", "XOXB-12-ab", "mysecret: a", "task-abcdefghijklmn", "sk-short"]
    assert values(spark, text.redact, *given) == ["[REDACTED_API_KEY]", "Bearer [REDACTED]", "password  =  [REDACTED]", "[REDACTED_SLACK_TOKEN]", "mysecret: a", "task-abcdefghijklmn", "sk-short"]
    df = spark.createDataFrame([("U123", "17.1"), (" C1 ", "abc"), ("", "1"), ("a b", "1"), (None, "1")], "c string, t string")
    assert [r[0] for r in df.select(text.thread_id(F.col("c"), F.col("t"))).collect()] == ["U123:17.1", "C1:abc", None, None, None]


def test_segments():
    def run(*tokens):
        return fold(("", 0, 0, False), tokens)

    assert run((0, 10, " It costs over 4."), (20, 30, "000 dong today."), (40, 50, " next")) == ((" next", 50, 1, False), [(0, "It costs over 4.000 dong today.")])
    assert run((0, 10, " It costs over 4."), (20, 30, " Then we go on and on."))[1] == [(0, "It costs over 4."), (1, "Then we go on and on.")]
    assert run((0, 10, " Hi."), (20, 30, " re"), (2000, 2010, "ad this."))[1] == [(0, "Hi. read this.")]
    assert run((0, 10, " Hi there."), (20, 30, " reading this."))[1] == [(0, "Hi there. reading this.")]
    assert run((0, 800, " A pause comes here"), (1600, 1700, " not yet"), (2601, 2700, " but now"))[1] == [(0, "A pause comes here not yet")]
    assert run((0, 1, " " + "x" * 221))[1] == [(0, "x" * 221)]


def test_open_text_is_closed_at_the_end(spark, tmp_path):
    rows = [(1, 0, "user", "A whole sentence."), (1, 1, "user", "no end mark"), (2, 0, "user", "It costs 4."), (3, 0, "user", "Done."), (4, 0, "user", None)]
    for name in ("conversations", "conversations_old"):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for _ in range(2):
        got = run_available(spark, f"{tmp_path}/conversations.parquet").collect()
        assert sorted((r.key, r.n, r.text) for r in got) == [(1, 0, "A whole sentence."), (1, 1, "no end mark"), (2, 0, "It costs 4."), (3, 0, "Done.")]
