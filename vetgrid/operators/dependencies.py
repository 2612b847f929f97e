"""Findings from dependency-audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.text import fingerprint


def dependency_findings(
    vulnerabilities: DataFrame, *, scan_id: str, description_chars: int | None = None
) -> DataFrame:
    """Vulnerability rows (with ``source_path``) as finding candidates of category A03.

    ``ord`` orders the copies of one vulnerability id in one source, which share a fingerprint.
    ``description_chars`` cuts the descriptions, which are whole otherwise.
    """
    told = F.col("description")
    rule = F.concat(F.lit("pip-audit-"), F.col("vuln_id"))
    none = F.lit(None)
    fixes = F.when(F.size("fix_versions") > 0, F.array_join("fix_versions", ", ")).otherwise(
        "No fix available")
    return vulnerabilities.select(
        F.lit(scan_id).alias("scan_id"),
        F.col("source_path").alias("file_path"),
        none.cast("int").alias("line_number"),
        rule.alias("rule_id"),
        fingerprint(F.col("source_path"), none.cast("int"), rule).alias("fingerprint"),
        F.lit("A03").alias("owasp_category"),
        F.lit("high").alias("severity"),
        F.format_string("%s %s: %s", "package", "installed_version", "vuln_id").alias("title"),
        (told if description_chars is None else F.substring(told, 1, description_chars)).alias("description"),
        none.cast("string").alias("code_snippet"),
        F.concat(F.lit("Upgrade "), F.col("package"), F.lit(" to "), fixes).alias("suggested_fix"),
        none.cast("double").alias("confidence"),
    )


def vulnerability_counts(vulnerabilities: DataFrame) -> DataFrame:
    return vulnerabilities.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("vulnerabilities"),
        F.count_if(F.size("fix_versions") > 0).alias("fixable"))
