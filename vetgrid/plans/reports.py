"""SARIF, Markdown and baseline output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.functions.constants import constant
from vetgrid.functions.text import category_label, display_time, sarif_level, severity_rank
from vetgrid.operators.aggregates import scan_history_range
from vetgrid.operators.findings import newest
from vetgrid.rules.catalog import ALL_RULES, Rule, rules_dataframe
from vetgrid.session import stage_table

# The SARIF schema, version and property names, and the address of the categories.
_SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
_CATEGORY_PAGE = "https://owasp.org/Top10/"


def sarif_results(findings: DataFrame) -> DataFrame:
    """``(id, result)``: one SARIF result object, as JSON text, for each finding."""
    def text(column: str) -> Column:
        return F.struct(F.col(column).alias("text"))

    location = F.struct(F.struct(
        F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"),
        F.struct(F.when(F.col("line_number") > 0, F.col("line_number")).otherwise(1)
                 .alias("startLine")).alias("region"),
    ).alias("physicalLocation"))
    rule = F.when(F.col("rule_id") != "", F.col("rule_id")).otherwise("manual")
    result = F.struct(
        rule.alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        text("description").alias("message"),
        F.array(location).alias("locations"),
        F.struct(
            F.col("owasp_category").alias("owasp-category"),
            category_label(F.col("owasp_category"), F.lit("")).alias("owasp-label"),
            F.col("severity").alias("severity"),
            F.col("status").alias("status"),
            F.col("id").alias("finding-id"),
        ).alias("properties"),
        F.when(F.col("suggested_fix") != "",
               F.array(F.struct(text("suggested_fix").alias("description")))).alias("fixes"),
    )
    return findings.select("id", F.to_json(result).alias("result"))


def _descriptor(row: dict[str, Column], known: bool) -> Column:
    fields = [
        row["id"].alias("id"),
        row["title"].alias("name"),
        F.struct(row["title"].alias("text")).alias("shortDescription"),
        F.struct(row["description"].alias("text")).alias("fullDescription"),
    ]
    if known:
        fields.append(F.concat(F.lit(_CATEGORY_PAGE), row["category"], F.lit("_2025/"))
                      .alias("helpUri"))
    fields.append(F.struct(row["category"].alias("owasp-category"),
                           row["severity"].alias("severity")).alias("properties"))
    return F.to_json(F.struct(*fields))


def sarif_rules(findings: DataFrame, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """``(rule_id, descriptor)``: the given rules and those that only the findings name."""
    built_in = rules_dataframe(findings.sparkSession, rules).dropDuplicates(["id"])
    known = built_in.select(F.col("id").alias("rule_id"), _descriptor({
        "id": F.col("id"), "title": F.col("title"), "description": F.col("description"),
        "category": F.col("owasp_category"), "severity": F.col("severity")}, True)
        .alias("descriptor"))
    foreign = findings.filter(
        (F.col("rule_id") != "") & ~F.col("rule_id").isin([r.id for r in rules])
    ).groupBy("rule_id").agg(F.max_by(
        F.struct("title", "description", "owasp_category", "severity"),
        F.struct("found_at", "id")).alias("f"))
    other = foreign.select("rule_id", _descriptor({
        "id": F.col("rule_id"), "title": F.col("f.title"), "description": F.col("f.description"),
        "category": F.col("f.owasp_category"), "severity": F.col("f.severity")}, False)
        .alias("descriptor"))
    return known.unionByName(other)


def sarif_documents(findings: DataFrame, rules: Sequence[Rule] = ALL_RULES, *,
                    shards: int | None = None, results_per_document: int = 5000) -> DataFrame:
    """``(shard, document)``: complete SARIF documents, the findings spread over ``shards``.

    Findings are spread by a hash of their id, which is unique, so every document holds about
    the same number of results: about ``results_per_document`` unless ``shards`` is given. Each
    document carries the descriptors of all given rules.
    """
    spark = findings.sparkSession
    if shards is None:
        shards = max(1, -(-findings.count() // results_per_document))
    known = [r.descriptor for r in sarif_rules(findings.limit(0), rules).collect()]
    header = F.lit(f'{{"$schema":"{_SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":'
                   f'{{"name":"vetgrid","version":"0.1.0","rules":[' + ",".join(known))
    ids = [r.id for r in rules]
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    rows = findings.withColumn("shard", shard)
    results = sarif_results(rows).withColumn("shard", shard).groupBy("shard").agg(
        F.array_join(F.sort_array(F.collect_list("result")), ",").alias("results"))
    foreign = rows.filter((F.col("rule_id") != "") & ~F.col("rule_id").isin(ids)).groupBy(
        "shard", "rule_id").agg(F.max_by(
            F.struct("title", "description", "owasp_category", "severity"),
            F.struct("found_at", "id")).alias("f"))
    extra = foreign.groupBy("shard").agg(F.sort_array(F.collect_list(_descriptor({
        "id": F.col("rule_id"), "title": F.col("f.title"), "description": F.col("f.description"),
        "category": F.col("f.owasp_category"), "severity": F.col("f.severity")}, False)))
        .alias("extra"))
    numbered = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    joined = numbered.join(results, "shard", "left").join(extra, "shard", "left")
    more = F.when(F.size("extra") > 0, F.concat(F.lit("," if known else ""), F.array_join("extra", ",")))
    return joined.select("shard", F.concat(
        header, F.coalesce(more, F.lit("")), F.lit(']}},"results":['),
        F.coalesce("results", F.lit("")), F.lit("]}]}")).alias("document"))


def write_sarif(findings: DataFrame, folder: str, *, limit: int | None = None,
                results_per_document: int = 5000) -> None:
    """Write SARIF documents as text files: all findings, or the newest ``limit`` of them."""
    chosen = findings if limit is None else newest(findings, limit)
    sarif_documents(chosen, results_per_document=results_per_document).select("document").write.text(folder)


# -- Markdown -----------------------------------------------------------------------------

_DETAILS = 20
_FILES = 10
# Blocks of a section sort by number; headings come before all others.
_FIRST_BLOCK = -(1 << 62)


def _rows(df: DataFrame, section: int, block: Column, line: Column, text: Column, tie: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), block.cast("long").alias("block"), (F.lit("") if tie is None else tie).alias("id"),
        line.cast("long").alias("line"), text.alias("text"))


def _fixed(spark: SparkSession, section: int, block: int, lines: list[str]) -> DataFrame:
    one = spark.range(1)
    return one.select(
        F.lit(section).alias("section"), F.lit(block).cast("long").alias("block"),
        F.posexplode(F.array(*map(F.lit, lines))).alias("line", "text"),
    ).select("section", "block", F.lit("").alias("id"), F.col("line").cast("long").alias("line"), "text")


def report_lines(findings: DataFrame, scans: DataFrame, generated_at: str) -> DataFrame:
    """The Markdown report as ordered rows ``(section, block, id, line, text)``.

    All counts come from one staged cube of the findings, a row for each status, category, severity and
    file. Only the top twenty are shown in detail, and the triaged ones are rows by time, so nothing is
    gathered on the way.
    """
    spark = findings.sparkSession
    opened = findings.filter("status = 'open'")
    decided_with_note = F.col("status").isin("accepted", "false_positive") & (F.col("notes") != "")
    cells = stage_table(findings.groupBy("status", "owasp_category", "severity", "file_path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(decided_with_note).alias("triaged")), "report-cells")
    open_cells = cells.filter("status = 'open'")
    zero = F.lit(0)

    dates = scan_history_range(scans).filter("scans > 0")
    history = _rows(dates, 0, F.lit(1), zero, F.format_string(
        "**Scan history:** %s scans, first: %s, latest: %s  ",
        F.col("scans").cast("string"), F.coalesce("first", F.lit("N/A")),
        F.coalesce("latest", F.lit("N/A"))))
    top = _fixed(spark, 0, 0, ["# Security Scan Report", "", f"**Generated:** {generated_at}  "])

    status, n = F.col("status"), F.col("n")

    def counted(test: Column | None = None) -> Column:
        return F.coalesce(F.sum(n if test is None else F.when(test, n)), zero)

    head = cells.agg(
        counted().alias("total"), counted(status == "open").alias("open"), counted(status == "fixed").alias("fixed"),
        counted(status.isin("accepted", "false_positive")).alias("accepted_or_false_positive"),
        F.coalesce(F.sum("triaged"), zero).alias("triaged"))
    counts = F.array(
        F.format_string("- **Total findings:** %d", "total"),
        F.format_string("- **Open:** %d", "open"),
        F.format_string("- **Fixed:** %d", "fixed"),
        F.format_string("- **Accepted/False Positive:** %d", "accepted_or_false_positive"),
    )
    shown = F.when(F.col("total") > 0, counts).otherwise(
        F.array(F.lit("No security findings recorded.")))
    header = head.select(F.posexplode(shown).alias("line", "text"))
    summary = _rows(header, 1, F.lit(1), F.col("line"), F.col("text"))

    rank = severity_rank(F.col("severity"))
    severities = _rows(open_cells.groupBy("severity").agg(F.sum("n").alias("count")), 2, zero, -rank, F.format_string(
        "| %s | %d |", F.upper("severity"), "count"))
    code = F.substring("owasp_category", 2, 9).try_cast("long")
    categories = _rows(open_cells.groupBy("owasp_category").agg(F.sum("n").alias("count")), 3, zero, F.coalesce(code, F.lit(99)),
                       F.format_string("| %s | %s | %d |", "owasp_category",
                                       category_label(F.col("owasp_category")), "count"))
    most = open_cells.groupBy("file_path").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "file_path").limit(_FILES)
    files = _rows(most, 4, -F.col("count"), zero, F.format_string("| `%s` | %d |", "file_path", "count"), F.col("file_path"))

    order = [F.desc("rank"), F.desc("found_at"), F.asc("id")]
    best = opened.withColumn("rank", rank).orderBy(*order).limit(_DETAILS)
    numbered = best.select(F.struct("*").alias("f")).agg(F.array_sort(F.collect_list("f"), _by_rank).alias("l")).select(
        F.posexplode("l").alias("i", "f"))  # at most twenty rows
    details = numbered.select("i", F.posexplode(_detail_lines()).alias("line", "text"))
    detail = _rows(details, 5, F.col("i"), F.col("line"), F.col("text"))
    more = open_cells.agg((F.sum("n") - _DETAILS).alias("n")).filter("n > 0")
    rest = _rows(more, 6, zero, zero, F.format_string("*...and %d more open findings.*", "n"))

    triaged = findings.filter(decided_with_note)
    label = F.when(F.col("status") == "false_positive", "False Positive").otherwise("Accepted Risk")
    entries = triaged.select("id", "updated_at", F.posexplode(F.array(
        F.format_string("- **[%s]** %s (`%s`)", label, "title", "file_path"),
        F.format_string("  - *Rationale:* %s", "notes"),
        F.format_string("  - *Triaged:* %s", display_time(F.col("updated_at").cast("string"))),
    )).alias("line", "text"))
    decided = _rows(entries, 7, F.unix_micros("updated_at"), F.col("line"), F.col("text"), F.col("id"))

    some = head.filter("total > 0").select(F.lit(8).alias("section"))
    advice = _fixed(spark, 8, 0, [
        "", "## Remediation Priority", "",
        "1. **Critical findings**: fix at once", "2. **High findings**: fix before the next release",
        "3. **Medium findings**: plan for the coming weeks",
        "4. **Low findings**: fix when the code is touched",
    ]).join(some, "section", "left_semi")
    result = top.unionByName(history).unionByName(
        _fixed(spark, 1, 0, ["", "## Executive Summary", ""])).unionByName(summary)
    for rows in (_headings(head), severities, categories, files, detail, rest, decided, advice):
        result = result.unionByName(rows)
    return result


# Headings by section, and the count that has to be above zero for them to appear.
_HEADINGS = (
    (2, "open", ["", "### Open by Severity", "", "| Severity | Count |", "|---|---|"]),
    (3, "open", ["", "### Open by Category", "", "| Category | Name | Count |", "|---|---|---|"]),
    (4, "open", ["", "### Top Files (most open findings)", "", "| File | Findings |", "|---|---|"]),
    (5, "open", ["", "## Findings Detail", ""]),
    (7, "triaged", ["", "## Triaged Findings", "", "*Reviewed, and judged to be acceptable or not to apply.*", ""]),
)


def _headings(counts: DataFrame) -> DataFrame:
    lines = constant(
        [{"section": section, "of": of, "line": i, "text": text}
         for section, of, texts in _HEADINGS for i, text in enumerate(texts)],
        "array<struct<section: int, of: string, line: bigint, text: string>>",
    )
    wanted = F.filter(lines, lambda x: F.when(x["of"] == "open", F.col("open") > 0)
                      .otherwise(F.col("triaged") > 0))
    return counts.select(F.inline(wanted)).select(
        "section", F.lit(_FIRST_BLOCK).alias("block"), F.lit("").alias("id"), "line", "text")


def _by_rank(a: Column, b: Column) -> Column:
    """Order of the detailed findings: rank and time falling, id rising."""
    before = (a["rank"] > b["rank"]) | (
        (a["rank"] == b["rank"]) & ((a["found_at"] > b["found_at"]) | (
            (a["found_at"] == b["found_at"]) & (a["id"] < b["id"]))))
    return F.when(before, -1).when(a["id"] == b["id"], 0).otherwise(1)


def _detail_lines() -> Column:
    f = lambda name: F.col(f"f.{name}")
    optional = [
        F.format_string("### %d. [%s] %s", F.col("i") + 1, F.upper(f("severity")), f("title")),
        F.lit(""),
        F.format_string("- **Category:** %s — %s", f("owasp_category"),
                        category_label(f("owasp_category"))),
        F.format_string("- **File:** `%s`", f("file_path")),
        F.when(f("line_number") > 0, F.format_string("- **Line:** %d", f("line_number"))),
        F.format_string("- **Found:** %s", display_time(f("found_at").cast("string"))),
        F.when(f("updated_at") != f("found_at"), F.format_string(
            "- **Last updated:** %s", display_time(f("updated_at").cast("string")))),
        F.format_string("- **Description:** %s", f("description")),
        F.when(f("suggested_fix") != "", F.format_string("- **Suggested Fix:** %s", f("suggested_fix"))),
        F.when(f("code_snippet") != "", F.format_string("\n```\n%s\n```\n", f("code_snippet"))),
        F.lit(""),
    ]
    return F.array_compact(F.array(*optional))


def ordered_text(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "block", "id", "line", "text").select("text")


def write_report(findings: DataFrame, scans: DataFrame, folder: str, generated_at: str) -> None:
    """Write the report as text; the parts of the folder are in order."""
    ordered_text(report_lines(findings, scans, generated_at)).write.text(folder)
