"""Counts, trends and histories over the findings, scans and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetgrid.functions.text import category_label


def _is_open() -> Column:
    return F.col("status") == "open"


def by_status(findings: DataFrame) -> DataFrame:
    return findings.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def open_by_category(findings: DataFrame) -> DataFrame:
    return (
        findings.filter(_is_open()).groupBy("owasp_category")
        .agg(F.count(F.lit(1)).alias("count")).orderBy("owasp_category")
    )


def open_by_severity(findings: DataFrame) -> DataFrame:
    return findings.filter(_is_open()).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def by_category_and_severity(findings: DataFrame) -> DataFrame:
    """Counts of scan results, with the category's name."""
    return (
        findings.groupBy("owasp_category", "severity").agg(F.count(F.lit(1)).alias("count"))
        .withColumn("label", category_label(F.col("owasp_category")))
    )


def summary(findings: DataFrame, scans: DataFrame, *, recent: int = 5) -> DataFrame:
    """Dashboard rows ``(section, key, count)`` in one pass over the findings.

    The ``recent`` newest scans are listed by id with their number of findings.

    The rows are first reduced to one for each status, category and severity, at most a few
    hundred, and only those are grouped again for the sections.
    """
    cells = findings.groupBy("status", "owasp_category", "severity").agg(
        F.count(F.lit(1)).alias("n"))
    opened = F.when(_is_open(), F.col("n"))
    sections = F.array(*[
        F.struct(F.lit(section).alias("section"), key.alias("key"), n.alias("n"))
        for section, key, n in (
            ("total_findings", F.lit("all"), F.col("n")),
            ("by_status", F.col("status"), F.col("n")),
            ("open_by_category", F.col("owasp_category"), opened),
            ("open_by_severity", F.col("severity"), opened),
        )
    ])
    counted = (
        cells.select(F.inline(sections)).filter("n IS NOT NULL")
        .groupBy("section", "key").agg(F.sum("n").alias("count"))
    )
    scan_total = scans.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("total_scans").alias("section"), F.lit("all").alias("key"), "count")
    newest = scans.orderBy(F.desc("started_at"), "id").limit(recent).select(
        F.lit("recent_scans").alias("section"), F.col("id").alias("key"), F.col("findings_count").cast("long").alias("count"))
    return counted.unionByName(scan_total).unionByName(newest)


def report_header(findings: DataFrame) -> DataFrame:
    status = F.col("status")
    return findings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "open").alias("open"),
        F.count_if(status == "fixed").alias("fixed"),
        F.count_if(status.isin("accepted", "false_positive")).alias("accepted_or_false_positive"),
    )


def top_files(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Files with the most open findings; ties by path."""
    return (
        findings.filter(_is_open()).groupBy("file_path").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "file_path").limit(limit)
    )


def daily_changes(findings: DataFrame, since: Column | None = None) -> DataFrame:
    """``(day, opened, fixed)`` from a time on; one pass over the findings."""
    moves = F.array_compact(F.array(*[
        F.when(
            F.col(name).isNotNull() & (F.lit(True) if since is None else F.col(name) >= since),
            F.struct(F.to_date(name).alias("day"), F.lit(kind).alias("kind")),
        )
        for name, kind in (("found_at", "opened"), ("fixed_at", "fixed"))
    ]))
    return findings.select(F.inline(moves)).groupBy("day").agg(
        F.count_if(F.col("kind") == "opened").alias("opened"),
        F.count_if(F.col("kind") == "fixed").alias("fixed"),
    )


def trend_totals(findings: DataFrame, since: Column) -> DataFrame:
    """One row: moves in the period, present open count, mean hours to resolution of all time."""
    hours = (F.unix_micros("fixed_at") - F.unix_micros("found_at")) / 3.6e9
    return findings.agg(
        F.count_if(F.col("found_at") >= since).alias("opened_in_period"),
        F.count_if(F.col("fixed_at") >= since).alias("fixed_in_period"),
        F.count_if(_is_open()).alias("currently_open"),
        F.round(F.avg(hours), 1).alias("mttr_hours"),
    )


def running_open(daily: DataFrame) -> DataFrame:
    """Open findings at the end of each day. The window runs over days, not over findings."""
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("open_total", F.sum(F.col("opened") - F.col("fixed")).over(order))


def scan_history_range(scans: DataFrame) -> DataFrame:
    day = F.date_format("started_at", "yyyy-MM-dd")
    return scans.agg(
        F.count(F.lit(1)).alias("scans"), F.min(day).alias("first"), F.max(day).alias("latest"))


def status_history(audit: DataFrame) -> DataFrame:
    """Status periods of each finding: ``(finding_id, status, since, until)``.

    Entries are paired with their successor inside a day first; the last entry of a day takes
    the first one of the next day that has any, from a table with one row for each finding and
    day. A finding with a huge history is thus spread over its days.
    """
    moves = audit.filter("action IN ('created', 'status_changed')").select(
        "finding_id", "id",
        F.when(F.col("action") == "created", "open").otherwise(F.col("new_value")).alias("status"),
        F.col("timestamp").alias("since"),
        F.to_date("timestamp").alias("day"),
    )
    in_day = Window.partitionBy("finding_id", "day").orderBy("since", "id")
    by_day = Window.partitionBy("finding_id").orderBy("day")
    days = moves.groupBy("finding_id", "day").agg(F.min("since").alias("first_move"))
    next_day = days.select("finding_id", "day", F.lead("first_move").over(by_day).alias("later"))
    return (
        moves.withColumn("same_day", F.lead("since").over(in_day))
        .join(next_day, ["finding_id", "day"])
        .select("finding_id", "status", "since",
                F.coalesce("same_day", "later").alias("until"))
    )


def token_usage(calls: DataFrame) -> DataFrame:
    """Tokens and estimated cost of reviewer calls."""
    used_in, used_out = F.sum("input_tokens"), F.sum("output_tokens")
    # Price in dollars for a million tokens in and out.
    cost = (used_in * 0.10 + used_out * 0.40) / 1_000_000
    return calls.groupBy("model").agg(
        used_in.alias("input_tokens"), used_out.alias("output_tokens"),
        F.round(cost, 6).alias("estimated_cost_usd"))
