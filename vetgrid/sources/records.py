"""Rule tables, audit reports, error logs and category reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.functions.regex import is_valid
from vetgrid.rules.catalog import Rule
from vetgrid.schemas import AUDIT_REPORT, CATEGORY_REFERENCE, ERRORS

REQUIRED_FIELDS = ("id", "owasp_category", "severity", "title", "description", "pattern")


def complete_rules(records: DataFrame) -> DataFrame:
    """Rule records that hold every required field; optional fields get their defaults."""
    present = F.lit(True)
    for name in REQUIRED_FIELDS:
        present = present & F.col(name).isNotNull()
    optional = {"file_glob": "*.py", "suggested_fix": "", "exclude_pattern": None}
    columns = [
        F.coalesce(F.col(name), F.lit(default)).alias(name)
        if name in records.columns else F.lit(default).cast("string").alias(name)
        for name, default in optional.items()
    ]
    return records.filter(present).select(*REQUIRED_FIELDS, *columns)


def load_rules(records: DataFrame) -> list[Rule]:
    """Rules from a table of records, as constants of a plan next to the built-in ones.

    Records that lack a field or hold a pattern that does not compile are left out. The table is
    read once, on the driver: this is for the tens of rules that somebody selects from or shows.
    Tables of many or untried rules are scanned with ``vetgrid.operators.rule_index``.
    """
    return [
        Rule(
            id=r.id,
            owasp_category=r.owasp_category,
            severity=r.severity,
            title=r.title,
            description=r.description,
            pattern=r.pattern,
            globs=(r.file_glob,),
            suggested_fix=r.suggested_fix,
            exclude_pattern=r.exclude_pattern,
        )
        for r in complete_rules(records).toLocalIterator()
        if is_valid(r.pattern) and is_valid(r.exclude_pattern or "")
    ]


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Custom rules from JSON records."""
    names = (*REQUIRED_FIELDS, "file_glob", "suggested_fix", "exclude_pattern")
    schema = ", ".join(f"{n} STRING" for n in names)
    return load_rules(spark.read.schema(schema).json(path))


def audit_report_rows(reports: DataFrame, json: str = "json") -> DataFrame:
    """One row for each package and known vulnerability of dependency-audit reports."""
    parsed = reports.withColumn("_report", F.from_json(json, AUDIT_REPORT))
    packages = parsed.withColumn("_dep", F.explode("_report.dependencies"))
    vulns = packages.withColumn("_vuln", F.explode("_dep.vulns"))
    empty = F.lit("")
    return vulns.select(
        *[c for c in reports.columns if c != json],
        F.coalesce("_dep.name", empty).alias("package"),
        F.coalesce("_dep.version", empty).alias("installed_version"),
        F.coalesce("_vuln.id", empty).alias("vuln_id"),
        F.coalesce("_vuln.description", "_vuln.id", empty).alias("description"),
        F.coalesce("_vuln.fix_versions", F.array().cast("array<string>")).alias("fix_versions"),
    )


# Dependency files from the most to the least preferred, and their kinds.
DEPENDENCY_FILES = {
    "requirements.txt": "requirements",
    "requirements/production.txt": "requirements",
    "requirements/base.txt": "requirements",
    "requirements/main.txt": "requirements",
    "pyproject.toml": "pyproject",
    "uv.lock": "lockfile",
    "poetry.lock": "lockfile",
}


def dependency_sources(files: DataFrame) -> DataFrame:
    """The preferred dependency file of each project: ``(project, source_path, source_type)``."""
    names = list(DEPENDENCY_FILES)
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("rel_path"))
    kinds = F.create_map(*[F.lit(x) for pair in DEPENDENCY_FILES.items() for x in pair])
    return (
        files.filter(F.col("rel_path").isin(*names))
        .groupBy("project")
        .agg(
            F.min_by("path", rank).alias("source_path"),
            F.min_by(kinds[F.col("rel_path")], rank).alias("source_type"),
        )
    )


def parse_errors(lines: DataFrame, line: str = "value") -> DataFrame:
    """Error records from JSON lines; lines that do not parse are left out."""
    bad = "_broken"
    record = F.from_json(
        F.col(line), f"{ERRORS}, {bad} STRING", {"columnNameOfCorruptRecord": bad})
    parsed = lines.select(record.alias("e")).select("e.*")
    return parsed.filter(F.col(bad).isNull() & F.col("error_id").isNotNull()).drop(bad)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return parse_errors(spark.read.text(path))


def recent_errors(
    errors: DataFrame, *, error_id: str | None = None, tool_name: str | None = None, limit: int | None = None
) -> DataFrame:
    """Error records, newest first, optionally of one id or one tool, all or ``limit`` of them."""
    keep: Column = F.lit(True)
    if error_id:
        keep = keep & (F.col("error_id") == error_id)
    if tool_name:
        keep = keep & (F.col("tool_name") == tool_name)
    ordered = errors.filter(keep).orderBy(F.desc("timestamp"), F.desc("error_id"))
    return ordered if limit is None else ordered.limit(limit)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category reference data, one row for each category."""
    document = spark.read.schema(CATEGORY_REFERENCE).option("multiLine", True).json(path)
    return document.select(F.inline("categories"))


def category_weaknesses(categories: DataFrame) -> DataFrame:
    return categories.select(
        F.col("id").alias("owasp_category"), "rank", F.explode("key_cwes").alias("cwe")
    ).select("owasp_category", "rank", F.col("cwe.id").alias("cwe_id"),
             F.col("cwe.name").alias("cwe_name"), F.col("cwe.cves").alias("cves"))


def category_notes(categories: DataFrame) -> DataFrame:
    """The text lists of each category as rows ``(owasp_category, kind, position, text)``."""
    kinds = ("common_vulnerabilities", "prevention", "notable_incidents")
    lists = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])
    return (
        categories.select(F.col("id").alias("owasp_category"), F.explode(lists).alias("kind", "l"))
        .select("owasp_category", "kind", F.posexplode("l").alias("position", "text"))
    )
