"""Queries of clauses, transcripts, answers and cells; importing this adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wording
from .catalogue import query, table


@query("""
    WITH l AS (SELECT l_orderkey AS o, l_orderkey % 40 + 1 AS n, l_linenumber AS k, bool_or(l_returnflag = 'N' OR (l_returnflag = 'A' AND l_linenumber > 1)) AS has, bool_or(l_returnflag = 'R') AS mark FROM lineitem GROUP BY ALL)
    SELECT o AS l_orderkey, CASE WHEN bool_and(has OR mark) AND o % 7 > 0 THEN 'pass' ELSE 'fail' END AS status, bool_and(has OR mark) AND NOT bool_or(mark) AS complete,
           n || coalesce(',' || string_agg(n || '.' || k, ',' ORDER BY k) FILTER (has), '') AS covered, coalesce(string_agg(n || '.' || k, ',' ORDER BY k) FILTER (mark), '') AS marked,
           coalesce(string_agg(n || '.' || k, ',' ORDER BY k) FILTER (NOT has AND NOT mark), '') AS missing, CASE WHEN o % 7 = 0 THEN n || '.99' ELSE '' END AS unexpected, '' AS marked_unexpected
    FROM l GROUP BY o, n""")
def clause_coverage(spark, sf_dir):
    """An order is an article, its lines are clauses; pages hold those kept, refer to those accepted but for the first, and mark those returned."""
    n = F.col("l_orderkey") % 40 + 1
    of = F.concat_ws(".", n.cast("string"), F.col("l_linenumber").cast("string"))
    covers = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("- **"), of, F.lit("** x"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("[Chưa bao phủ: "), of, F.lit("]"))).when(F.col("l_linenumber") > 1, F.concat(F.lit("theo khoản "), of, F.lit(", x")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(of, F.lit(". x")))).alias("s"), F.array_sort(F.collect_set(covers)).alias("p"))
    source = F.concat(F.lit("MỤC LỤC\nĐiều 9\n9.9 x\n[[page 2]]\n1.0 lần ban hành\nĐiều "), n.cast("string"), F.lit("\n"), F.array_join("s", "\n"))
    more = F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("\n0"), n.cast("string"), F.lit(".099 x"))).otherwise("")
    page = F.concat(F.lit("## Điều "), n.cast("string"), F.lit("\n"), F.array_join("p", "\n"), more, F.lit("\n# Nguồn\n7.98 x"))
    d = wording.clause_coverage(lines.select("l_orderkey", source.alias("source"), page.alias("page")), "l_orderkey")
    return d.select("l_orderkey", "status", "complete", *[F.array_join(c, ",").alias(c) for c in ("covered", "marked", "missing", "unexpected", "marked_unexpected")])


@query(r"""
    WITH s AS (SELECT doc_id, doc_id // 50 AS meeting, lang, CASE WHEN doc_id % 13 = 0 THEN 'Cam on cac ban da theo doi!' WHEN doc_id % 7 = 0 THEN 'Uh huh' || repeat('.', CAST(doc_id % 3 AS INTEGER)) WHEN doc_id % 5 = 0 THEN 'Ok ' || source ELSE text END AS text FROM documents),
         p AS (SELECT *, strip_accents(lower(coalesce(text, ''))) AS plain FROM s),
         w AS (SELECT *, list_distinct(regexp_extract_all(plain, '[a-z0-9]{4,}')) AS words, regexp_replace(plain, '[^\p{L}\p{N}]', '', 'g') AS sign, len(regexp_extract_all(plain, '\S+')) AS n FROM p),
         b AS (SELECT *, lag(words) OVER m AS b, lead(words) OVER m AS a, lag(sign) OVER m AS bs, lead(sign) OVER m AS as_ FROM w WINDOW m AS (PARTITION BY meeting ORDER BY doc_id)),
         o AS (SELECT doc_id, meeting, lang, sign, doc_id % 13 = 0 AS canned, n BETWEEN 1 AND 7 AND (bs IS NOT DISTINCT FROM sign OR NOT coalesce(list_has_any(words, b), false)) AND (as_ IS NOT DISTINCT FROM sign OR NOT coalesce(list_has_any(words, a), false)) AS odd FROM b),
         c AS (SELECT meeting, lang, count(*) AS n FROM documents, (SELECT doc_id AS d, doc_id // 50 AS meeting FROM documents) WHERE d = doc_id GROUP BY ALL), u AS (SELECT meeting, lang AS usual FROM c QUALIFY row_number() OVER (PARTITION BY meeting ORDER BY n DESC, lang) = 1),
         r AS (SELECT meeting, sign, count(*) AS again FROM o WHERE odd GROUP BY ALL)
    SELECT doc_id, CASE WHEN canned THEN 'canned' WHEN odd AND lang <> usual THEN 'language' WHEN odd AND again >= 3 THEN 'repeated' END AS noise FROM o JOIN u USING (meeting) LEFT JOIN r USING (meeting, sign)""")
def transcript_noise(spark, sf_dir):
    """fifty documents are a meeting; some texts are a closing phrase, a hum, or two words."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    said = F.when(k % 13 == 0, "Cảm ơn các bạn đã theo dõi!").when(k % 7 == 0, F.concat(F.lit("Uh huh"), F.repeat(F.lit("."), (k % 3).cast("int")))).when(k % 5 == 0, F.concat(F.lit("Ok "), "source")).otherwise(F.col("text"))
    return wording.noise(d.select("doc_id", F.expr("doc_id div 50").alias("meeting"), "lang", said.alias("text")), "meeting", "doc_id").select("doc_id", "noise")


ANSWERS = ("", "Kho chưa có dữ liệu", "Có thể là 5 giờ", "Chắc chắn không có ai", "x TODO y", "a\n" * 9, "giá trị NaN.", "Xong rồi", "chuông\x07 \x1b[0m", "nano")


@query("""
    WITH f(v, control, esc, trace, long, unsure, sure, none, neg) AS (VALUES (0, false, false, false, false, false, false, false, false), (1, false, false, false, false, false, false, true, true), (2, false, false, false, false, true, false, false, false),
              (3, false, false, false, false, false, true, false, true), (4, false, false, true, false, false, false, false, false), (5, false, false, false, true, false, false, false, false), (6, false, false, true, false, false, false, false, false),
              (7, false, false, false, false, false, false, false, false), (8, true, true, false, false, false, false, false, false), (9, false, false, false, false, false, false, false, false)),
         e AS (SELECT event_id, event_id % 10 AS v, ['in_kb', 'not_in_kb', 'confident_no'][event_id // 10 % 3 + 1] AS s, event_type = 'click' AS cited FROM events)
    SELECT event_id, CASE WHEN v = 0 THEN 'empty' ELSE concat_ws(',', CASE WHEN control THEN 'control' END, CASE WHEN esc THEN 'escape' END, CASE WHEN trace THEN 'trace' END, CASE WHEN long THEN 'long' END, CASE WHEN s = 'in_kb' AND NOT cited THEN 'uncited' END,
           CASE WHEN s = 'in_kb' AND unsure THEN 'unsure' END, CASE WHEN s = 'not_in_kb' AND sure THEN 'too_sure' END, CASE WHEN s = 'not_in_kb' AND NOT none THEN 'no_notice' END, CASE WHEN s = 'confident_no' AND NOT neg THEN 'no_denial' END) END AS faults
    FROM e JOIN f USING (v)""")
def answer_style(spark, sf_dir):
    """An event is one of ten answers under one of three statuses; clicks cite."""
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ("in_kb", "not_in_kb", "confident_no"))), (F.expr("event_id div 10") % 3).cast("int"))
    said = F.get(F.array(*map(F.lit, ANSWERS)), (k % 10).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(wording.style_faults(status, said, (F.col("event_type") == "click").cast("int")), ",").alias("faults"))


@query("""
    SELECT conv_id, turn, CASE WHEN conv_id % 4 < 2 THEN '[' || text || ']' ELSE text END AS said, conv_id % 4 < 2 AS translated FROM conversations WHERE text IS NOT NULL""")
def placed_translations(spark, sf_dir):
    """A conversation's replies come back as one list, in a fence, among words, one short, or cut off; without a list of the right length the texts stand."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    talk = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = F.to_json(F.transform("t", lambda x: F.concat(F.lit("["), x["text"], F.lit("]"))))
    kind = F.col("conv_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Here [it] is:\n```json\n"), said, F.lit("\n```\nDone [x]"))).when(kind == 1, F.concat(F.lit("Sure: "), said, F.lit(" - all done")))
    raw = raw.when(kind == 2, F.to_json(F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x: x["text"]))).otherwise(F.concat(F.rtrim(F.substring_index(said, "]", -1)), F.substring_index(said, '"', 2)))
    got = talk.withColumn("got", wording.listed_strings(raw, F.size("t")))
    rows = got.select("conv_id", "got", F.posexplode("t").alias("i", "x"))
    return rows.select("conv_id", "x.turn", F.coalesce(F.get("got", F.col("i")), F.col("x.text")).alias("said"), F.col("got").isNotNull().alias("translated"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 6 WHEN 0 THEN CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%' WHEN 1 THEN regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
           WHEN 3 THEN CASE WHEN round(l_tax * 100) = 0 THEN '0' WHEN round(l_tax * 100) <= 5 THEN '0.0' ELSE '1e-06' END WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE CASE WHEN l_returnflag = 'R' THEN 'True' WHEN l_returnflag = 'N' THEN l_linestatus || ' x' END END AS shown
    FROM lineitem""")
def cell_texts(spark, sf_dir):
    """A line is a percent, a price, a whole number, a small part, a day, or a flag, words or nothing."""
    kind = F.col("l_linenumber") % 6
    number = F.when(kind == 0, F.col("l_discount")).when(kind == 1, F.col("l_extendedprice")).when(kind == 2, F.col("l_quantity")).when(kind == 3, F.col("l_tax") / 100000)
    five = lambda flag, c: F.when((kind == 5) & (F.col("l_returnflag") == flag), c)
    said = F.coalesce(five("N", F.concat(F.lit(" "), "l_linestatus", F.lit("\nx\t"))), F.lit(""))
    shown = wording.cell_text(number, F.when(kind == 0, "0.00%"), F.when(kind == 4, F.col("l_shipdate").cast("date")), five("R", F.lit(True)), said)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("shown"))
