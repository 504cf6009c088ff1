"""Tabs whose columns are found by their headers, the contract of a sheet that was taken in, and who may read, upload and reuse.

"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions import text
from .shapes import one_line

# Headers of a grid of people, months, rows that are no people, ids.
ID_HEADS, NAME_HEADS = ("slack id", "slackid", "slack_id"), ("member", "tên nhân sự", "ten nhan su", "name", "họ tên", "ho ten")
NICK_HEADS, ROLE_HEADS = ("slack name", "slackname", "slack_name"), ("role", "vai trò", "vai tro")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
NO_PERSON, PERSON_ID = ("member", "sum", "grand total"), "^[UW][A-Z0-9]{6,}$"
# Headers of a tab of risks or issues.
ISSUE_HEADS = {"date_detected": "Date Detected", "description": "Description", "priority": "Priority", "next_action": "Next Action", "status": "Status", "notes": "Notes"}
RELATED = "Related Assignee/Task"
# Kinds of files that may come in, folders that uploads may not come from, and what an intake's decision makes of a proposal.
KINDS, GUARDED = ("xlsx", "docx", "pptx", "pdf", "text/markdown", "text/csv", "csv"), ("originals", "raw", "structured", "wiki", "derived")
STATUS_OF = {"identity_review": "awaiting_identity", "initial_ingest": "ready_to_ingest", "reingest": "ready_to_ingest", "duplicate": "duplicate", "no_op": "no_op"}
# What is kept of a message's metadata.
KEPT = ("subtype", "bot_id", "client_msg_id", "event_ts", "reply_count", "reactions", "files", "edited", "deleted", "permalink")


# --- tabs ---------------------------------------------------------------------------


def _norm(c: Column) -> Column:
    return F.lower(one_line(F.coalesce(c, F.lit(""))))


def month_of(c: Column) -> Column:
    """The month that a cell names, in English or as ``tháng 8``; null if none."""
    t = _norm(c)
    named = F.coalesce(*[F.when(t == m, n) for m, n in {**{m: i + 1 for i, m in enumerate(MONTHS)}, **SHORT_MONTHS}.items()])
    n = F.regexp_extract(t, r"^th[aá]ng\s*([0-9]{1,2})$", 1).try_cast("int")
    return F.coalesce(named, F.when(n.between(1, 12), n))


def _first_col(names: Sequence[str]) -> Column:
    """Over a header's cells: the column of the first of these names that is there, at its first place."""
    rank = F.coalesce(*[F.when(F.col("_t") == n, i) for i, n in enumerate(names)])
    return F.min_by("col", F.when(rank.isNotNull(), F.struct(rank, F.col("col"))))


def person_grid(cells: DataFrame, today: Column) -> DataFrame:
    """[S23] sheet, row, state, id, name, slack_name, role, hours of each person of grids that are found by their headers.

    The header is a sheet's first row with a cell for the id; a sheet without one gives one row of state no_header. Months stand in the header row, days in
    the next; the day's column is the first with its number under its month (the nearest at or before it). state: off where the day's cell
    says so, no_id (a name without a valid id, which is null then), else present; of rows with the same id the first counts. hours: the number in the
    day's cell, null without such a column or where it is no number. Layouts are one row a sheet; rows are grouped by sheet and row.
    """
    c = cells.where("value is not null").withColumn("_t", _norm(F.col("value")))
    head = c.where(F.col("_t").isin(*ID_HEADS)).groupBy("sheet").agg(F.min("row").alias("head"))
    top = c.join(head, "sheet").where("row = head")
    months = F.array_sort(F.collect_list(F.when(month_of(F.col("value")).isNotNull(), F.struct("col", month_of(F.col("value")).alias("m")))))
    layout = top.groupBy("sheet", "head").agg(_first_col(ID_HEADS).alias("_id"), _first_col(NAME_HEADS).alias("_name"), _first_col(NICK_HEADS).alias("_nick"), _first_col(ROLE_HEADS).alias("_role"), months.alias("_months"))
    days = c.join(layout.select("sheet", "head", "_months"), "sheet").where((F.col("row") == F.col("head") + 1) & F.trim("value").rlike("^[0-9]{1,2}$") & (F.trim("value").try_cast("int") == F.dayofmonth(today)))
    under = F.element_at(F.filter("_months", lambda m: m["col"] <= F.col("col")), -1)["m"]
    layout = layout.join(days.where(F.size(F.filter("_months", lambda m: m["col"] <= F.col("col"))) > 0).where(under == F.month(today)).groupBy("sheet").agg(F.min("col").alias("_day")), "sheet", "left").drop("_months")
    body = c.join(layout, "sheet").where("row > head")
    of = lambda col: F.coalesce(F.max(F.when(F.col("col") == F.col(col), one_line(F.col("value")))), F.lit(""))
    rows = body.groupBy("sheet", "row").agg(F.max("_day").alias("_day"), of("_id").alias("id"), of("_name").alias("name"), of("_nick").alias("slack_name"), of("_role").alias("role"), of("_day").alias("_cell"))
    valid = F.col("id").rlike(PERSON_ID)
    first = rows.where(valid).groupBy("sheet", "id").agg(F.min("row").alias("row"))
    number = F.replace(F.col("_cell"), F.lit(","), F.lit("."))
    hours = F.when(F.col("_day").isNotNull() & number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number.try_cast("double"))
    state = F.when(F.col("_day").isNotNull() & text.is_off(F.col("_cell")), "off").otherwise("present")
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("slack_name", F.lit("")), F.col("id"))
    people = rows.join(first, ["sheet", "id", "row"], "left_semi").select("sheet", "row", state.alias("state"), "id", name.alias("name"), "slack_name", "role", hours.alias("hours"))
    nothing = F.lit(None).cast("string")
    bare = rows.where(~valid & (F.col("name") != "") & month_of(F.col("name")).isNull() & ~F.lower("name").isin(*NO_PERSON))
    bare = bare.select("sheet", "row", F.lit("no_id"), nothing, "name", "slack_name", "role", F.lit(None).cast("double"))
    without = cells.select("sheet").distinct().join(head, "sheet", "left_anti").select("sheet", F.lit(None).cast("int"), F.lit("no_header"), nothing, nothing, nothing, nothing, F.lit(None).cast("double"))
    return people.union(bare).union(without)


def issue_rows(cells: DataFrame) -> DataFrame:
    """[S29] sheet, row, fault, id, the fields of ISSUE_HEADS and related, of tabs whose first row names their columns, wherever these stand.

    related: one column, or the assignee and the task, joined where both are there. Rows without an id are left out. A tab that lacks a column gives one row
    with the names of those that are missing as its fault. A tab whose first row is empty lacks them all; one without cells is not there.
    """
    c = cells.withColumn("_t", F.trim("value"))
    heads = {"id": "ID", **ISSUE_HEADS}
    col_of = lambda *names: F.min_by("col", F.when(F.coalesce(*[F.when(F.col("_t") == n, i) for i, n in enumerate(names)]).isNotNull(), F.struct(F.coalesce(*[F.when(F.col("_t") == n, i) for i, n in enumerate(names)]), F.col("col"))))
    top = F.col("row") == 1
    c1 = c.withColumn("_t", F.when(top, F.col("_t")))
    layout = c1.groupBy("sheet").agg(*[col_of(n).alias(f"_{k}") for k, n in heads.items()], col_of(RELATED).alias("_both"), col_of("Related Assignee").alias("_who"), col_of("Task", "Related Task").alias("_what"))
    lacks = [F.when(F.col(f"_{k}").isNull(), n) for k, n in heads.items()] + [F.when(F.col("_both").isNull() & (F.col("_who").isNull() | F.col("_what").isNull()), RELATED)]
    layout = layout.withColumn("fault", F.nullif(F.concat_ws(", ", *lacks), F.lit("")))
    good = c.where("row > 1").join(layout.where("fault is null"), "sheet")
    of = lambda k: F.coalesce(F.max(F.when(F.col("col") == F.col(f"_{k}"), F.col("_t"))), F.lit(""))
    rows = good.groupBy("sheet", "row").agg(F.max("_both").isNotNull().alias("_one"), *[of(k).alias(k) for k in (*heads, "both", "who", "what")]).where("id <> ''")
    pair = F.concat_ws(" / ", F.nullif("who", F.lit("")), F.nullif("what", F.lit("")))
    rows = rows.select("sheet", "row", F.lit(None).cast("string").alias("fault"), *heads, F.when(F.col("_one"), F.col("both")).otherwise(pair).alias("related"))
    return rows.unionByName(layout.where("fault is not null").select("sheet", "fault"), allowMissingColumns=True)


def sheet_contract(registry: DataFrame, artifacts: DataFrame, facts: DataFrame, review: DataFrame) -> DataFrame:
    """[G16] doc_id, status (pass, or the first fault), cells, reviewed (null without a review) of each registered document.

    registry: doc_id, version, extractor, sha256, original_sha256 (of the file as it is now, null: gone). artifacts: doc_id, kind (raw, page, facts), path,
    said_doc, said_version, body_sha256, raw_paths array, machine boolean; one row each. facts and review: doc_id, place, value, formula, each place once; review rows also
    have sha256, of the file that was reviewed. A reviewed formula without a value asks for the formula alone.
    """
    empty = F.coalesce("r.value", F.lit("")) == ""
    same = F.col("f.formula").eqNullSafe(F.col("r.formula")) & ((F.col("r.formula").isNotNull() & (F.col("r.formula") != "") & empty) | F.col("f.value").eqNullSafe(F.col("r.value")))
    both = facts.withColumn("_f", F.lit(True)).alias("f").join(review.withColumn("_r", F.lit(True)).alias("r"), ["doc_id", "place"], "full_outer")
    n = lambda when: F.count(F.when(when, 1))
    met = both.groupBy("doc_id").agg(n(F.col("_f")).alias("cells"), n(F.col("_r")).alias("reviewed"), n(F.col("_f").isNull()).alias("lost"), n(F.col("_r").isNull()).alias("extra"), n(F.col("_f") & F.col("_r") & ~same).alias("wrong"), F.min("sha256").alias("_least"), F.max("sha256").alias("_most"))
    part = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("path", "said_doc", "said_version", "body_sha256", "raw_paths", "machine")))
    files = artifacts.groupBy("doc_id").agg(part("raw").alias("raw"), part("page").alias("page"), part("facts").alias("facts"))
    d = registry.join(files, "doc_id", "left").join(met, "doc_id", "left")
    told = F.coalesce("reviewed", F.lit(0)) > 0
    faults = (
        ("not a sheet", ~F.col("extractor").eqNullSafe(F.lit("spreadsheet"))),
        ("original changed", ~F.col("original_sha256").eqNullSafe(F.col("sha256"))),
        ("artifact missing", F.col("raw").isNull() | F.col("facts").isNull() | F.col("page").isNull()),
        ("raw of another document", ~F.col("raw.said_doc").eqNullSafe(F.col("doc_id"))),
        ("raw of another version", ~F.col("raw.said_version").eqNullSafe(F.col("version"))),
        ("page not made by the machine", ~(F.coalesce("page.machine", F.lit(False)) & F.col("page.said_doc").eqNullSafe(F.col("doc_id")) & (F.col("page.path") == F.concat(F.lit("wiki/sources/"), "doc_id", F.lit(".md"))))),
        ("page of other raw files", ~F.col("page.raw_paths").eqNullSafe(F.array("raw.path"))),
        ("page differs from raw", ~F.col("page.body_sha256").eqNullSafe(F.col("raw.body_sha256"))),
        ("facts of another document", ~F.col("facts.said_doc").eqNullSafe(F.col("doc_id"))),
        ("facts of another version", ~F.col("facts.said_version").eqNullSafe(F.col("version"))),
        ("no cells", F.coalesce("cells", F.lit(0)) == 0),
        ("review of another file", told & ~(F.col("_least").eqNullSafe(F.col("original_sha256")) & F.col("_most").eqNullSafe(F.col("original_sha256")))),
        ("cells missing", told & (F.col("lost") > 0)),
        ("cells extra", told & (F.col("extra") > 0)),
        ("cells differ", told & (F.col("wrong") > 0)),
    )
    status = F.coalesce(*[F.when(is_so, name) for name, is_so in faults], F.lit("pass"))
    return d.select("doc_id", status.alias("status"), F.coalesce("cells", F.lit(0)).alias("cells"), F.nullif("reviewed", F.lit(0)).alias("reviewed"))


# --- access, uploads, reuse -----------------------------------------------------------


def project_gate(actors: DataFrame, visibility: str, role_of: Mapping[str, Sequence[str]]) -> DataFrame:
    """actors (actor, roles) with ``allowed`` and ``reason``: all in a public project, no one without a name, else those with a role of the visibility."""
    named = F.coalesce(F.trim("actor"), F.lit("")) != ""
    if visibility == "public":
        return actors.withColumn("allowed", F.lit(True)).withColumn("reason", F.lit("public"))
    roles = F.array(*map(F.lit, role_of.get(visibility, ()))).cast("array<string>")
    may = named & F.coalesce(F.arrays_overlap("roles", roles), F.lit(False))
    return actors.withColumn("allowed", may).withColumn("reason", F.when(may, "role").when(named, "no_role").otherwise("no_actor"))


def uploads(requests: DataFrame, allowed: DataFrame, root: str, most: int = 100 * 1024 * 1024) -> DataFrame:
    """requests with ``status``: what refuses an upload, or what its intake's decision makes of it, ``blocked`` for one that is not known.

    requests: actor, path (resolved, null: no such file), is_link, size, kind, flow. allowed: actor, those who may upload. In order: no_actor, not_allowed,
    missing, link, guarded (in the corpus itself), too_large, kind.
    """
    may = allowed.select(F.col("actor").alias("_who")).distinct()
    who = F.trim("actor")
    inside = F.coalesce(*[F.when((F.col("path") == f"{root}/{g}") | F.startswith("path", F.lit(f"{root}/{g}/")), True) for g in GUARDED], F.lit(False))
    flow = F.coalesce(*[F.when(F.col("flow") == f, s) for f, s in STATUS_OF.items()], F.lit("blocked"))
    status = F.when(F.coalesce(who, F.lit("")) == "", "no_actor").when(F.col("_who").isNull(), "not_allowed").when(F.col("path").isNull(), "missing").when(F.col("is_link"), "link")
    status = status.when(inside, "guarded").when(F.col("size") > most, "too_large").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind").otherwise(flow)
    return requests.join(may, who == F.col("_who"), "left").withColumn("status", status).drop("_who")


def still_there(proposals: DataFrame, staged: DataFrame) -> DataFrame:
    """[G19] proposals (path, sha256) with ``source``: same, or why none may run: gone, link, changed. staged: path, is_link, sha256, each path once."""
    s = staged.select("path", F.col("is_link").alias("_link"), F.col("sha256").alias("_now"), F.lit(True).alias("_there"))
    said = F.when(F.col("_there").isNull(), "gone").when(F.col("_link"), "link").when(F.col("_now").eqNullSafe(F.col("sha256")), "same").otherwise("changed")
    return proposals.join(s, "path", "left").withColumn("source", said).drop("_link", "_now", "_there")


def reusable_pages(scopes: DataFrame, pages: DataFrame, key: str, drafts: bool = False) -> DataFrame:
    """key, path: the page that may stand for a scope instead of a new one, null if none may.

    scopes: key, doc_id, version, domain, visibility, raw_path, section (null: the whole document). pages: path, rejected (a draft that was turned down),
    page, doc_id, version, domain, visibility, raw_paths array, section, part_of, valid (by today's gates), complete (its coverage passes). Only a valid
    source page of the same document, version, domain, visibility and just that raw file serves, of the same section and its document's part, or of none.
    Kept pages come before drafts, then by path. Drafts of a section serve only if ``drafts``, and then only complete ones.
    """
    p = pages.where("page = 'source' and valid and size(raw_paths) = 1").withColumn("raw_path", F.get("raw_paths", F.lit(0)))
    mine = F.when(F.col("section").isNull(), F.col("part_of").isNull()).otherwise(F.col("part_of").eqNullSafe(F.concat(F.lit("wiki/sources/"), F.col("doc_id").cast("string"), F.lit(".md"))))
    p = p.where(mine & (~F.col("rejected") | F.col("section").isNull() | (F.col("complete") & F.lit(drafts))))
    p = p.select("doc_id", "version", "domain", "visibility", "raw_path", F.col("section").alias("_section"), F.struct("rejected", "path").alias("_page"))
    best = p.groupBy("doc_id", "version", "domain", "visibility", "raw_path", "_section").agg(F.min("_page").alias("_page"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "version", "raw_path")], "_section", "domain", "visibility", "_page")
    s = scopes.alias("s")
    on = [F.col("s.doc_id") == F.col("_doc_id"), F.col("s.version") == F.col("_version"), F.col("s.raw_path") == F.col("_raw_path"), F.col("s.section").eqNullSafe(F.col("_section")), F.col("s.domain").eqNullSafe(F.col("b.domain")), F.col("s.visibility").eqNullSafe(F.col("b.visibility"))]
    return s.join(best.alias("b"), on, "left").select(f"s.{key}", F.col("_page.path").alias("path"))


def redacted(c: Column, kind: DataType) -> Column:
    """[P07] A column with the secrets masked in every text it holds, at any depth; names of fields and keys stay."""
    if isinstance(kind, StringType):
        return text.redact(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: redacted(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[redacted(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def safe_metadata(messages: DataFrame, kept: Sequence[str] = KEPT) -> Column:
    """[P07] A struct of the columns that may be kept, those that are there, with their secrets masked."""
    return F.struct(*[redacted(F.col(n), messages.schema[n].dataType).alias(n) for n in kept if n in messages.columns])
