"""What is written and given out: cells of reports and their check, risks with running ids, release manifests, described items, modules of a handbook and its quality, objects in replies.

"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .wording import S, short_number

# What an open end is written as, how a risk of overtime reads, and words that mark company pages.
EMPTY_END = ("", "-", "--", "x", "?", "n/a", "chưa", "chưa xong", "tbd")
NEXT_STEP, NOTE = "PM review giờ vượt", "Ghi tự động từ report Slack ngày "
POLICY = "noi-quy|policy|handbook|hr|mor-software"
# What a handbook must hold.
HEADINGS = ("## 1.", "## 2.", "## 3.", "## 4.", "## 5.", "## 6.")
SOURCE, UNKNOWN, GAP = "Nguồn:", "Nguồn: `chưa xác định`", "[Chưa có trong KB]"


# --- sheets -----------------------------------------------------------------------


def report_cells(reports: DataFrame, layout: DataFrame) -> DataFrame:
    """[K10] sheet, row, col, field, value: the cells that a report's line sets.

    reports: sheet, row, re_est, start, end, actual, status, note (null: not said). layout: sheet, field, col. Numbers are written as numbers, an end that
    is none as an empty cell; a field without a column, such as a note, is not written.
    """
    none = F.lower(F.trim(F.coalesce("end", F.lit("")))).isin(*EMPTY_END)
    number = lambda c: F.coalesce(text.local_number(F.col(c)).cast("string"), F.trim(c))
    said = {"re_est": number("re_est"), "start": F.trim("start"), "end": F.when(none, "").otherwise(F.trim("end")), "actual": number("actual"), "status": F.trim("status"), "note": F.col("note")}
    cells = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("field"), v.alias("value"))) for k, v in said.items()]))
    return reports.select("sheet", "row", F.explode(cells).alias("c")).select("sheet", "row", "c.*").join(layout, ["sheet", "field"]).select("sheet", "row", "col", "field", "value")


def written(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """[K10] cells (sheet, row, col, value) after a batch of updates, each cell once: updated ones replace those that are there."""
    new = updates.select("sheet", "row", "col", "value")
    return cells.select("sheet", "row", "col", "value").join(new, ["sheet", "row", "col"], "left_anti").union(new)


def unconfirmed(updates: DataFrame, back: DataFrame, field: str = "actual", within: float = 0.01) -> DataFrame:
    """[K10] sheet, row, value, got: updates of a field that, read back from the sheet, are no number or another one. back: sheet, row, col, value as shown."""
    u = updates.where(F.col("field") == field).join(back.select("sheet", "row", "col", F.col("value").alias("got")), ["sheet", "row", "col"], "left")
    got, want = text.local_number(F.col("got")), text.local_number(F.col("value"))
    return u.where(got.isNull() | F.coalesce(F.abs(got - want) > within, F.lit(True))).select("sheet", "row", "value", "got")


def appended_risks(risks: DataFrame, overs: DataFrame, today: Column, order: Sequence[str], split: Column | None = None) -> DataFrame:
    """[K12] tab, row, id, description, priority, related, next_action, status, notes of new risks, below those that a tab has, with its ids running on.

    risks: tab, row, id. overs: tab, task, assignee, reporter, reason, hours, priority, next_action (the last two null: by the hours, and a review) and
    the columns of ``order``, which tell overs of a tab apart. An id counts by the number after its ``R-``. split: whether the tab has a column of its own for
    the task. A tab's new risks are numbered in one task; its old ones only give their largest number and row.
    """
    last = risks.groupBy("tab").agg(F.max("row").alias("_row"), F.coalesce(F.max(F.regexp_extract("id", r"^\s*R-(\d+)", 1).try_cast("long")), F.lit(0)).alias("_id"))
    n = F.row_number().over(Window.partitionBy("tab").orderBy(*order))
    d = overs.withColumn("_n", n).join(last, "tab", "left")
    number = (F.coalesce("_id", F.lit(0)) + F.col("_n")).cast("string")
    who, hours = F.coalesce(F.nullif("assignee", F.lit("")), F.lit(None).cast("string")), F.coalesce("hours", F.lit(0.0))
    joined = F.concat_ws("/", who, "task")
    day = F.date_format(today, "dd-MM-yyyy")
    return d.select(
        "tab",
        (F.coalesce("_row", F.lit(1)) + F.col("_n")).cast("long").alias("row"),
        F.concat(F.lit("R-"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0"))).alias("id"),
        F.concat(F.coalesce(who, F.lit("Dev")), F.lit(" vượt "), short_number(hours), F.lit("h ở task "), "task", F.lit(": "), F.trim("reason")).alias("description"),
        F.coalesce("priority", F.when(hours >= 4, "High").otherwise("Medium")).alias("priority"),
        (joined if split is None else F.when(split, F.coalesce(who, F.lit(""))).otherwise(joined)).alias("related"),
        F.coalesce("next_action", F.lit(NEXT_STEP)).alias("next_action"),
        F.lit("Open").alias("status"),
        F.concat(F.lit(NOTE), day, F.coalesce(F.concat(F.lit(", người report "), F.nullif("reporter", F.lit(""))), F.lit(""))).alias("notes"),
    )


def described(items: DataFrame, today: Column, description: Column, options: Column, related: Column | None = None) -> DataFrame:
    """[P05] Items of rules with all that a risk's row holds: date_detected, description, related (else the item's ref), next_action (the first option, else empty), options."""
    several = F.coalesce(options, F.array().cast("array<string>"))
    return items.select(
        "*",
        today.alias("date_detected"),
        description.alias("description"),
        (F.col("ref") if related is None else F.coalesce(F.nullif(related, F.lit("")), F.col("ref"))).alias("related"),
        F.coalesce(F.get(several, F.lit(0)), F.lit("")).alias("next_action"),
        several.alias("options"),
    )


# --- releases -----------------------------------------------------------------------


def release_manifests(artifacts: DataFrame, releases: DataFrame, required: Sequence[str], folders: Sequence[str] = ()) -> DataFrame:
    """[K15] release, status, missing, files, bytes, digest of each release.

    artifacts: release, path, sha256, size, each path once a release. releases: release, told_sha256, input_sha256. status: stale (the corpus is told to be of
    another input), incomplete (``missing``: the required files that are not there, and folders without a file), else ready. digest: of the
    lines of paths and hashes, by path. Only the required paths of a release are gathered as they are; the digest sorts a line for each file of one release.
    """
    asked = F.array(*map(F.lit, sorted(required))).cast("array<string>")
    seen = [F.coalesce(F.bool_or(F.startswith("path", F.lit(f))), F.lit(False)) for f in folders]
    a = artifacts.groupBy("release").agg(
        F.collect_set(F.when(F.col("path").isin(*required), F.col("path"))).alias("_has"),
        F.array_compact(F.array(*[F.when(~s, f) for s, f in zip(seen, folders)])).cast("array<string>").alias("_bare"),
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        text.digest(F.collect_list(F.concat_ws("\t", "path", "sha256"))).alias("digest"),
    )
    d = releases.join(a, "release", "left")
    bare = F.coalesce("_bare", F.array(*map(F.lit, folders)).cast("array<string>"))
    missing = F.concat(F.array_except(asked, F.coalesce("_has", F.array().cast("array<string>"))), bare)
    status = F.when(~F.col("told_sha256").eqNullSafe(F.col("input_sha256")), "stale").when(F.size(missing) > 0, "incomplete").otherwise("ready")
    return d.select("release", status.alias("status"), missing.alias("missing"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "digest")


# --- handbooks ------------------------------------------------------------------------


def page_class(project: str) -> Column:
    """[P13] internal, project or team, null for a page that is none: by page_type, searchable (lower case), project, visibility."""
    own = F.contains("searchable", F.lit(project.lower()))
    person = F.when(own, "team")
    belongs = own | F.coalesce(F.lower("project") == project.lower(), F.lit(False))
    other = F.when(F.col("searchable").rlike(POLICY), "internal").when(belongs, "project").when(F.col("visibility") == "internal", "internal")
    return F.when(F.col("page_type") == "entity-person", person).otherwise(other)


def modules(pages: DataFrame, project: str, role: str) -> DataFrame:
    """[P13] page, module: the modules of a role's handbook that a page is read in. pages: page, title, relative, and the columns of ``page_class``."""
    kind = F.col("_c")
    inside = kind == "internal"
    chapter = F.col("title").rlike(r"(?iuU)\bCH(?:Ư|Æ¯)ƠNG\s*[3-9]\b") | F.col("relative").rlike(r"(?i)\bchuong-[3-9]\b")
    overview = inside & ~F.contains(F.lower("relative"), F.lit("--chuong-"))
    ready = {"hr-operations": overview, "project-manager": kind == "project"}.get(role, kind.isin("project", "team"))
    of: Mapping[str, Column] = {"company-basics": overview, "workplace-practice": inside & chapter, "project-context": kind == "project", "team-workflow": kind == "team", "role-readiness": ready, "first-delivery": kind.isin("project", "team")}
    names = F.array_compact(F.array(*[F.when(is_in, name) for name, is_in in of.items()]))
    return pages.withColumn("_c", page_class(project)).where("_c is not null").select("page", F.explode(names).alias("module"))


def handbook_quality(body: Column) -> Column:
    """[A29] struct<checks map<string,boolean>, score, passed, modules, citations> of a handbook's text: seven checks, score in whole percent; a null text is empty."""
    c = F.coalesce(body, F.lit(""))
    found = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    scopes, covered = found(r"(?md)^- \*\*Scope:\*\* `([^`]+)`$"), found(r"(?md)^- \*\*Coverage:\*\* `([^`]+)`$")
    lines = F.filter(F.split(c, "\n", -1), lambda x: F.contains(x, F.lit(SOURCE)))
    twice = lambda s: F.size(F.filter(scopes, lambda x: x == s)) >= 2
    raw = F.exists(lines, lambda x: F.contains(x, F.lit("wiki/")) | F.contains(x, F.lit("raw/")) | F.contains(x, F.lit(UNKNOWN)))
    has = lambda s: F.contains(c, F.lit(s))
    headings = F.lit(True)
    for h in HEADINGS:
        headings = headings & has(h)
    checks = {
        "required_sections": headings,
        "role_profile": has("Hồ sơ đào tạo") & F.array_contains(scopes, "role_guidance"),
        "fixed_policy_scope": twice("policy_fixed"),
        "dynamic_project_scope": twice("project_dynamic"),
        "source_citations": (F.size(lines) > 0) & ~raw,
        "freshness": has("Freshness KB"),
        "explicit_gaps": has(GAP) & F.array_contains(covered, "partial"),
    }
    good = sum((v.cast("int") for v in checks.values()), F.lit(0))
    pairs = [x for k, v in checks.items() for x in (F.lit(k), v)]
    return F.struct(F.create_map(*pairs).alias("checks"), F.round(100 * good / len(checks)).cast("int").alias("score"), (good == len(checks)).alias("passed"), F.size(found(r"(?md)^### 2\.\d+ (.+)$")).alias("modules"), F.size(lines).alias("citations"))


def json_object(reply: Column) -> Column:
    """[X24] The JSON object that a reply is, or that stands from its first to its last brace, as text; null if neither is one."""
    whole = F.regexp_replace(F.coalesce(reply, F.lit("")), rf"^{S}+|{S}+$", "")

    def own(c: Column) -> Column:
        parts = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
        return F.when((F.size(parts) == 1) & F.startswith(F.schema_of_variant(F.get(parts, F.lit(0))), F.lit("OBJECT")), c)

    return F.coalesce(own(whole), own(F.regexp_extract(whole, r"(?s)(\{.*\})", 1)))
