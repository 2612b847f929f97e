"""Requests for an outside reviewer, and what becomes of its answers.

The reviewer itself is not part of the library: it reads the request tables and writes response
tables. Both sides are plain rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.text import (
    adjust_severity,
    fingerprint,
    lines_of,
    percent,
    slug,
    snippet,
)
from vetgrid.operators.projects import (
    PYTHON_ROLES,
    WEB_ROLES,
    python_role,
    role_context,
    reviewable,
    web_role,
)
from vetgrid.schemas import REVIEW_RESPONSE, TRIAGE_RESPONSE

# The context file's name, the length of text a reviewer takes at once, and the
# confidence above which a false positive is believed.
CONTEXT_FILE = ".owasp-context.md"
REVIEW_CHARS = 150_000
CONFIDENT = 0.8

_CONTEXT_LINES = (9, 10)

_CONTEXT_NOTE = (
    "# Project context\nThe notes below come from the project's reviewers and hold unless this "
    "file clearly says otherwise.\n\n"
)


# -- project context ----------------------------------------------------------------------


def project_contexts(files: DataFrame, *, max_chars: int | None = None) -> DataFrame:
    """``(folder, context)`` for each folder with a context file that is not blank.

    Notes are whole, unless ``max_chars`` cuts longer ones with a remark.
    """
    text = F.col("content")
    cut = text if max_chars is None else F.when(
        F.length(text) > max_chars,
        F.concat(F.substring(text, 1, max_chars), F.lit("\n\n[context cut at the size cap]")),
    ).otherwise(text)
    name = "/" + CONTEXT_FILE
    return files.filter(
        F.endswith("path", F.lit(name)) & text.rlike(r"(?U)\S")
    ).select(F.expr(f"left(path, length(path) - {len(name)})").alias("folder"), cut.alias("context"))


def _ancestors(folder: Column) -> Column:
    """The folder and all folders above it."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def context_anchors(rows: DataFrame, contexts: DataFrame, path: str = "path") -> DataFrame:
    """``(folder, anchor)``: the nearest folder with a context file, for each folder in ``rows``.

    Folders are made distinct first and the texts stay out of the join.
    """
    def parent(column: Column) -> Column:
        return F.regexp_replace(column, r"/?[^/]*$", "")

    folders = rows.select(parent(F.col(path)).alias("folder")).distinct()
    up = folders.select("folder", F.explode(_ancestors(F.col("folder"))).alias("anchor"))
    known = contexts.select(F.col("folder").alias("anchor"))
    return up.join(known, "anchor").groupBy("folder").agg(
        F.max_by("anchor", F.length("anchor")).alias("anchor"))


def with_context(rows: DataFrame, contexts: DataFrame, path: str = "path") -> DataFrame:
    """Rows with ``context``, the text of the nearest context file above ``path``."""
    anchors = context_anchors(rows, contexts, path)
    texts = anchors.join(
        contexts.withColumnRenamed("folder", "anchor"), "anchor").select("folder", "context")
    folder = F.regexp_replace(F.col(path), r"/?[^/]*$", "")
    return rows.withColumn("folder", folder).join(texts, "folder", "left").drop("folder")


def _context_block(context: Column) -> Column:
    return F.when(
        context.rlike(r"(?U)\S"),
        F.concat(F.lit(_CONTEXT_NOTE), F.regexp_replace(context, r"(?U)^\s+|\s+$", ""), F.lit("\n\n")),
    ).otherwise("")


# -- triage of findings -------------------------------------------------------------------


def findings_in_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``context``: the lines from 9 above to 10 below in the present file.

    A finding whose file is gone keeps its stored snippet. The wanted lines go to the file, at most one
    of each, and are cut there; what comes back to the findings are snippets. So a text meets its file's
    lines once, however many findings name them, and files that are bucketed by path are not moved.
    """
    place = [F.col("file_path").alias("path"), F.coalesce("line_number", F.lit(1)).alias("at")]
    lines = findings.select(*place).distinct().groupBy("path").agg(F.collect_set("at").alias("wanted"))
    cut = files.select("path", "content").join(lines, "path").filter("content is not null").select(
        "path", lines_of(F.col("content")).alias("lines"), F.explode("wanted").alias("at")).select(
        F.col("path").alias("cut_path"), F.col("at").alias("cut_at"),
        snippet(F.col("lines"), F.col("at"), *_CONTEXT_LINES).alias("window"))
    joined = findings.join(cut, (F.col("file_path") == F.col("cut_path"))
                           & (F.coalesce("line_number", F.lit(1)) == F.col("cut_at")), "left")
    return joined.withColumn("context", F.coalesce("window", "code_snippet", F.lit(""))).drop(
        "cut_path", "cut_at", "window")


def triage_requests(findings: DataFrame, project_context: str | None = None) -> DataFrame:
    """``(finding_id, prompt)`` from findings with ``context``.

    ``project_context`` names a column with the project's notes, if the rows have one.
    """
    notes = _context_block(F.col(project_context)) if project_context else F.lit("")
    body = F.concat(
        notes,
        F.format_string(
            "Triage this security finding:\n\nFinding ID: %s\nTitle: %s\nDescription: %s\n"
            "File: %s:%s\nCode context:\n```\n%s\n```\n",
            "id", "title", "description", "file_path",
            F.coalesce(F.col("line_number").cast("string"), F.lit("None")), "context",
        ),
    )
    return findings.select(F.col("id").alias("finding_id"), body.alias("prompt"))


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """Verdicts from ``(finding_id, json)`` answers, one row for each request.

    The assessment that names the finding counts, else the first one; an answer without any
    becomes ``needs_investigation`` with confidence 0.
    """
    listed = F.from_json("json", TRIAGE_RESPONSE)["assessments"]
    parsed = responses.select("finding_id", listed.alias("l"))
    own = F.filter("l", lambda a: a["finding_id"] == F.col("finding_id"))
    chosen = F.coalesce(F.get(own, 0), F.get(F.col("l"), 0))
    rows = parsed.select("finding_id", chosen.alias("a"))
    missing = F.col("a").isNull()
    return rows.select(
        "finding_id",
        F.coalesce("a.verdict", F.lit("needs_investigation")).alias("verdict"),
        F.when(missing, 0.0).otherwise(F.coalesce("a.confidence", F.lit(0.5))).alias("confidence"),
        F.when(missing, "The reviewer gave no assessment.")
        .otherwise(F.coalesce("a.reasoning", F.lit(""))).alias("reasoning"),
        F.col("a.adjusted_severity").alias("adjusted_severity"),
    )


def complete_verdicts(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One verdict for each request; requests without an answer need investigation."""
    joined = requests.select("finding_id").join(verdicts, "finding_id", "left")
    return joined.withColumns({
        "verdict": F.coalesce("verdict", F.lit("needs_investigation")),
        "reasoning": F.when(F.col("confidence").isNull(), "The reviewer gave no assessment.")
        .otherwise(F.col("reasoning")),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
    })


def verdicts_as_updates(verdicts: DataFrame) -> DataFrame:
    """Updates for the verdicts that may be applied unseen: confident false positives."""
    sure = (F.col("verdict") == "false_positive") & (F.col("confidence") > CONFIDENT)
    note = F.concat(F.lit("LLM triage ("), percent(F.col("confidence")), F.lit("): "), F.col("reasoning"))
    none = F.lit(None).cast("string")
    return verdicts.filter(sure).select(
        "finding_id", F.lit("false_positive").alias("status"), note.alias("notes"),
        none.alias("fix_commit_sha"), none.alias("suggested_fix"),
        F.lit(0).cast("long").alias("ord"),
    )


# -- review of whole files ----------------------------------------------------------------


def review_requests(
    files: DataFrame, project_types: DataFrame, project_context: str | None = None, *,
    window: int = REVIEW_CHARS,
) -> DataFrame:
    """``(path, part, first_line, role, prompt)`` for the files a reviewer reads.

    Only the small project table is joined to the files, on the project. A text beyond the length that
    a reviewer takes is read in windows (see ``review_windows``), each a prompt of its own.
    """
    typed = files.join(project_types, "project", "left")
    kept = typed.filter(reviewable(F.col("rel_path"), F.coalesce("project_type", F.lit("unknown"))))
    web = F.coalesce(F.col("project_type").isin("nextjs", "react"), F.lit(False))
    text = F.col("content")
    role = F.when(web, web_role(F.col("rel_path"), text)).otherwise(python_role(F.col("path"), text))
    rows = kept.withColumn("role", role)
    info = F.when(web, role_context(F.col("role"), WEB_ROLES)).otherwise(
        role_context(F.col("role"), PYTHON_ROLES))
    notes = _context_block(F.col(project_context)) if project_context else F.lit("")
    part = F.when(F.col("parts") > 1, F.format_string(
        "Part: %d of %d, lines %d to %d\n", F.col("part") + 1, "parts", "first_line", "last_line")).otherwise("")
    prompt = F.concat(
        notes,
        F.format_string("File: %s\nType: %s\nTrust: %s\nRisk: %s\n", "path", "i.label", "i.trust", "i.risk"),
        part, F.format_string("\n```\n%s\n```", "window_text"),
    )
    pieces = _in_windows(rows.withColumn("i", info), window)
    return pieces.select("path", "part", "first_line", "role", prompt.alias("prompt"))


_LINE_BLOCK = 100  # windows whose line feeds are summed up once


def _in_windows(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with a row for each window of ``content``: ``(part, parts, first_line, last_line, window_text)``.

    Half a window apart, the text is cut behind the last line feed of that half, or just there if a
    line is longer. A window has at most ``size`` characters, and every character is in one. The text is
    cut into halves in one pass, a window joins the end of a half to the start of the next one: no step
    walks the text from its start again. The steps are columns of their own, so that none is evaluated
    again for each window.
    """
    half = max(size // 2, 1)
    text, length, halves = F.col("content"), F.length("content"), F.col("_halves")

    def after(h: Column) -> Column:
        """What follows the last line feed of a half; nothing without one."""
        return F.when(F.contains(h, F.lit("\n")), F.substring_index(h, "\n", -1)).otherwise("")

    def until(h: Column) -> Column:
        return F.substring(h, F.lit(1), F.length(h) - F.length(after(h)))

    def feeds(t: Column) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))

    def total(numbers: Column, start: Column, count: Column) -> Column:
        return F.aggregate(F.slice(numbers, start, count), F.lit(0), lambda a, n: a + n)

    # Bytes that are no UTF-8 would not survive the regex.
    by_place = F.transform(F.sequence(F.lit(0), F.ceil(length / half).cast("int") - 1),
                           lambda k: F.substring(text, k * half + 1, F.lit(half)))
    by_regex = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{half}}}"), F.lit(0))
    cut = rows.withColumn("_halves", F.when(length <= size, F.array(text)).when(F.is_valid_utf8(text), by_regex).otherwise(by_place))
    pieces = cut.withColumn("parts", F.size("_halves")).withColumn("_pieces", F.transform(halves, lambda h, k: F.concat(
        F.when(k > 0, after(F.get(halves, k - 1))).otherwise(""),
        F.when(k == F.size(halves) - 1, h).otherwise(until(h)))))
    fed = pieces.withColumn("_feeds", F.transform("_pieces", feeds))
    summed = fed.withColumn("_sums", F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_feeds") - 1) / _LINE_BLOCK).cast("int")),
        lambda b: total(F.col("_feeds"), b * _LINE_BLOCK + 1, F.lit(_LINE_BLOCK))))

    def window(piece: Column, k: Column) -> Column:
        blocks = F.floor(k / _LINE_BLOCK).cast("int")
        first = F.lit(1) + total(F.col("_sums"), F.lit(1), blocks) + total(
            F.col("_feeds"), blocks * _LINE_BLOCK + 1, k % _LINE_BLOCK)
        last = first + F.get("_feeds", k) - F.endswith(piece, F.lit("\n")).cast("int")
        return F.struct(k.alias("part"), first.alias("first_line"), last.alias("last_line"), piece.alias("window_text"))

    # An expression, not a column: from the column Spark would infer a filter, push it below all steps
    # and evaluate them there again and again.
    each = summed.select("*", F.inline(F.transform("_pieces", window)))
    kept = [*rows.columns, "parts", "part", "window_text", "first_line", "last_line"]
    return each.select(*kept)


def review_windows(files: DataFrame, *, window: int = REVIEW_CHARS) -> DataFrame:
    """``(path, part, parts, first_line, last_line, window_text)``: each text whole, in numbered windows.

    No text is cut off or repeated; a null text has no window and an empty one a single empty window.
    """
    return _in_windows(files.filter("content is not null").select("path", "content"), window).drop("content")


def place_reviews(reviews: DataFrame, windows: DataFrame) -> DataFrame:
    """Reviews of windows, ``(path, part, line_number, ...)``, with line numbers of the whole file.

    ``windows`` is ``(path, part, first_line, last_line)``; a line that the window does not have becomes null.
    """
    spans = windows.select("path", "part", "first_line", "last_line")
    line = F.col("first_line") + F.col("line_number") - 1
    placed = reviews.join(spans, ["path", "part"])
    return placed.withColumn("line_number", F.when(
        (F.col("line_number") >= 1) & (line <= F.col("last_line")), line).cast("int")).drop("part", "first_line", "last_line")


def parse_reviews(responses: DataFrame) -> DataFrame:
    """Findings from ``(path, json)`` answers, with defaults for what an item leaves out."""
    items = F.from_json("json", REVIEW_RESPONSE)["findings"]
    part = ["part"] if "part" in responses.columns else []
    rows = responses.select("path", *part, F.explode(items).alias("i"))

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.col(f"i.{name}"), F.lit(default)).alias(name)

    named = rows.select(
        "path", *part, field("owasp_category", "A10"), field("severity", "medium"),
        field("title", "Unknown"), field("description", ""),
        F.col("i.line_number").alias("line_number"), field("suggested_fix", ""),
        F.coalesce("i.confidence", F.lit(0.5)).alias("confidence"),
    )
    rule = F.concat(F.lit("llm-"), F.col("owasp_category"), F.lit("-"), slug(F.col("title")))
    return named.withColumn("rule_id", rule)


def review_findings(reviews: DataFrame, *, scan_id: str) -> DataFrame:
    """Reviewer findings as finding candidates."""
    path = F.col("path")
    return reviews.select(
        F.lit(scan_id).alias("scan_id"),
        path.alias("file_path"),
        "line_number",
        "rule_id",
        fingerprint(path, F.col("line_number"), F.col("rule_id")).alias("fingerprint"),
        "owasp_category",
        adjust_severity(F.col("severity"), path).alias("severity"),
        "title",
        "description",
        F.lit(None).cast("string").alias("code_snippet"),
        "suggested_fix",
        "confidence",
    )
