"""Versions of the findings, scans and audit tables as Parquet folders.

A version is a folder that is written once. The next version is computed from the last one and
written next to it, so a failed job leaves the last version untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.operators.findings import (
    FINDING_COLUMNS,
    Change,
    baseline,
    created_audit,
    delete_findings,
    merged_rows,
    update_findings,
)
from vetgrid.schemas import AUDIT_LOG, FINDINGS
from vetgrid.session import stage_table


@dataclass(frozen=True)
class Snapshot:
    """The folder of one version."""

    folder: str

    def findings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(FINDINGS).parquet(f"{self.folder}/findings")

    def audit(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(AUDIT_LOG).parquet(f"{self.folder}/audit_log")


def empty_snapshot(spark: SparkSession, folder: str) -> Snapshot:
    spark.createDataFrame([], FINDINGS).write.parquet(f"{folder}/findings")
    spark.createDataFrame([], AUDIT_LOG).write.parquet(f"{folder}/audit_log")
    return Snapshot(folder)


def _write(last: Snapshot, change: Change, folder: str) -> Snapshot:
    if folder.rstrip("/") == last.folder.rstrip("/"):
        raise ValueError("the next version needs a folder of its own")
    spark = change.findings.sparkSession
    change.findings.write.parquet(f"{folder}/findings")
    # The old log is read again, not rewritten by hand, so that a version is complete in itself.
    last.audit(spark).unionByName(change.audit).write.parquet(f"{folder}/audit_log")
    return Snapshot(folder)


def merge_into(last: Snapshot, candidates: DataFrame, folder: str, now: Column) -> Snapshot:
    """Next version with a batch of candidates merged in.

    The candidates are staged first: findings and audit rows both read them, and a scan is far
    dearer than a table.
    """
    spark = candidates.sparkSession
    staged = stage_table(candidates, "candidates")
    merged = stage_table(merged_rows(last.findings(spark), staged, now), "merged")
    return _write(last, Change(merged.select(*FINDING_COLUMNS), created_audit(merged, now)), folder)


def update_into(last: Snapshot, updates: DataFrame, folder: str, now: Column) -> Snapshot:
    """Next version with triage updates applied."""
    staged = stage_table(updates, "updates")
    spark = updates.sparkSession
    return _write(last, update_findings(last.findings(spark), staged, now), folder)


def delete_from(last: Snapshot, ids: DataFrame, folder: str) -> Snapshot:
    """Next version without the listed findings and their audit rows."""
    spark = ids.sparkSession
    left = delete_findings(last.findings(spark), last.audit(spark), ids)
    left.findings.write.parquet(f"{folder}/findings")
    left.audit.write.parquet(f"{folder}/audit_log")
    return Snapshot(folder)


def write_baseline(last: Snapshot, spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of the open findings as a table, for ``beyond_baseline``."""
    baseline(last.findings(spark)).write.parquet(folder)
    return spark.read.schema("fingerprint STRING").parquet(folder)


def read_baseline_file(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints from a baseline document ``{"version", "fingerprints", "count"}``."""
    schema = "version INT, fingerprints ARRAY<STRING>, count BIGINT"
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select(F.explode("fingerprints").alias("fingerprint"))


def write_bucketed(findings: DataFrame, table: str, buckets: int) -> None:
    """Findings as a catalog table bucketed by fingerprint, so that merges need no shuffle."""
    findings.write.bucketBy(buckets, "fingerprint").sortBy("fingerprint").saveAsTable(table)
