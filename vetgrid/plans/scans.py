"""Whole scans: files in, finding candidates out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.operators.findings import complete_scans
from vetgrid.operators.projects import network_surfaces
from vetgrid.operators.rule_index import scan_with_rules
from vetgrid.operators.scan import scan_text, to_findings
from vetgrid.rules.catalog import ALL_RULES, Rule
from vetgrid.schemas import SCANS
from vetgrid.sources.files import (
    changed_paths,
    drop_ignored,
    eligible_files,
    ignore_patterns,
    only_changed,
)


def scan_files(
    files: DataFrame,
    *,
    scan_id: str,
    rules: Sequence[Rule] = tuple(ALL_RULES),
    exclude: Iterable[str] = (),
    surfaces: bool = True,
    max_file_kb: int | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """Finding candidates of a set of projects.

    Size, folder and glob tests run before the rules. Ignore files and project facts are joined
    to the matches, which are few, so the texts are never shuffled. ``custom`` is a table of rule
    records of any length; those with the id of one of ``rules`` take no part.
    """
    chosen = eligible_files(files, all_text=custom is not None or any("*" in r.globs for r in rules),
                            exclude=exclude, max_file_kb=max_file_kb)
    keep = ("project", "path", "rel_path")
    matches = scan_text(chosen, rules, keep=keep)
    if custom is not None:
        known = [r.id for r in rules]
        matches = matches.unionByName(scan_with_rules(chosen, custom.filter(~F.col("id").isin(known)), keep=keep))
    kept = drop_ignored(matches, ignore_patterns(files))
    facts = network_surfaces(files) if surfaces else None
    return to_findings(kept, scan_id=scan_id, surfaces=facts)


def scan_changes(
    old: DataFrame, new: DataFrame, *, scan_id: str, rules: Sequence[Rule] = tuple(ALL_RULES),
    exclude: Iterable[str] = (), max_file_kb: int | None = None,
) -> DataFrame:
    """Candidates from the files that differ between two snapshots, excludes included."""
    changed = changed_paths(old, new).filter("change <> 'deleted'")
    chosen = eligible_files(
        new, all_text=any("*" in r.globs for r in rules), exclude=exclude, max_file_kb=max_file_kb)
    matches = scan_text(only_changed(chosen, changed), rules, keep=("project", "path", "rel_path"))
    kept = drop_ignored(matches, ignore_patterns(new))
    return to_findings(kept, scan_id=scan_id, surfaces=network_surfaces(new))


def scan_path(files: DataFrame, path: str, *, scan_id: str,
              rules: Sequence[Rule] = tuple(ALL_RULES), max_file_kb: int | None = None) -> DataFrame:
    """Candidates of a single file; the path test reaches the source."""
    chosen = eligible_files(files.filter(F.col("path") == path), max_file_kb=max_file_kb)
    return to_findings(scan_text(chosen, rules), scan_id=scan_id)


def open_scan(spark: SparkSession, scan_id: str, scope: str, target: str, started_at: Column,
              categories: list[str] | None = None) -> DataFrame:
    """A running scan as a row of the scans table."""
    empty = spark.createDataFrame([(scan_id, scope, target, categories)],
                                  "id STRING, scope STRING, target_path STRING, categories ARRAY<STRING>")
    return empty.select(
        "id", "scope", "target_path", started_at.alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(0).cast("long").alias("findings_count"), "categories",
        F.lit("running").alias("status"),
    ).to(spark.createDataFrame([], SCANS).schema)


__all__ = ["complete_scans", "open_scan", "scan_changes", "scan_files", "scan_path"]
