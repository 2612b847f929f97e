"""The findings table: merge, triage updates, deletion, verification, baseline, listing.

Tables are never changed in place. Each operator returns the rows of the next version, which
the caller writes elsewhere (see ``vetgrid.plans.snapshots``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetgrid.functions.text import category_label, fingerprint, severity_rank
from vetgrid.operators.replay import FIELDS, final_values, replayed
from vetgrid.rules.catalog import CATEGORIES, SEVERITIES
from vetgrid.session import stage_table

FINDING_COLUMNS = (
    "id", "scan_id", "file_path", "line_number", "rule_id", "fingerprint", "category_type",
    "owasp_category", "severity", "title", "description", "code_snippet", "suggested_fix",
    "status", "found_at", "updated_at", "fixed_at", "fix_commit_sha", "confidence", "notes",
)

# States of a finding.
STATUSES = ("open", "in_progress", "fixed", "accepted", "false_positive")
_REFRESHED = ("open", "in_progress")
_COMPACT_DROPS = ("description", "code_snippet", "suggested_fix", "notes")


@dataclass(frozen=True)
class Change:
    """Next version of the findings and the audit rows that explain it."""

    findings: DataFrame
    audit: DataFrame


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def audit_rows(
    rows: DataFrame, finding_id: Column, action: Column, old: Column, new: Column, at: Column, *place: Column
) -> DataFrame:
    """Audit entries with an id derived from their content and, where given, their place in a batch."""
    parts = [finding_id, action, F.coalesce(old, F.lit("")), F.coalesce(new, F.lit("")),
             at.cast("string"), *[p.cast("string") for p in place]]
    return rows.select(
        F.sha2(F.concat_ws("|", *parts), 256).alias("id"),
        finding_id.alias("finding_id"),
        action.alias("action"),
        old.alias("old_value"),
        new.alias("new_value"),
        at.alias("timestamp"),
    )


def _row_hash(rows: DataFrame) -> Column:
    return F.sha2(F.concat_ws("|", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(rows.columns)]), 256)


def batch_rows(candidates: DataFrame, order: str = "ord") -> DataFrame:
    """Candidates of one batch by ``match_key``, with ``copies``.

    Copies of a fingerprint become one row: the first one (by ``order``) gives the row, the last
    one the scan and the snippet. The reduction is an aggregate, so copies of a hot fingerprint
    are folded before the shuffle. Candidates without a fingerprint all stay; their key is a
    hash of the whole row, which spreads them evenly and matches nothing that is stored.
    """
    if order not in candidates.columns:
        candidates = candidates.withColumn(order, F.lit(0))
    plain = [c for c in candidates.columns if c not in ("fingerprint", order)]
    first = F.struct("fingerprint", *plain)
    last = F.struct("scan_id", "code_snippet")
    rank = F.struct(F.col(order), F.xxhash64("rule_id", "title", "code_snippet"))
    key = F.coalesce("fingerprint", F.concat(F.lit("row:"), _row_hash(candidates)))
    grouped = candidates.groupBy(key.alias("key")).agg(
        F.min_by(first, rank).alias("f"), F.max_by(last, rank).alias("l"),
        F.count(F.lit(1)).alias("n"),
    )
    loose = F.col("f.fingerprint").isNull()
    times = F.sequence(F.lit(1), F.when(loose, F.col("n").cast("int")).otherwise(1))
    columns = [
        F.col(f"l.{c}" if c in ("scan_id", "code_snippet") else f"f.{c}").alias(c)
        for c in ("fingerprint", *plain)
    ]
    return grouped.select(
        F.col("key"), *columns, F.when(loose, 1).otherwise(F.col("n")).alias("copies"),
        F.explode(times).alias("nth"),
    ).select(
        F.when(F.col("fingerprint").isNotNull(), F.col("key"))
        .otherwise(F.concat_ws("#", "key", "nth")).alias("match_key"),
        *["fingerprint", *plain], "copies")


def _new_rows(batch: DataFrame, now: Column) -> DataFrame:
    """Batch rows as findings. Without a fingerprint the id is the caller's or made from the row."""
    made_id = F.coalesce("fingerprint", F.sha2("match_key", 256))
    made = {
        "id": F.when(F.col("fingerprint").isNull(), F.coalesce("id", made_id)).otherwise(made_id)
        if "id" in batch.columns else made_id,
        "status": F.lit("open"), "found_at": now, "updated_at": now,
        "category_type": F.lit("security"), "fixed_at": _null("timestamp"),
        "fix_commit_sha": _null("string"), "notes": _null("string"),
    }
    columns = []
    for name in FINDING_COLUMNS:
        if name in made:
            columns.append(made[name].alias(name))
        elif name in batch.columns:
            columns.append(F.col(name))
        else:
            columns.append(_null("double" if name == "confidence" else "string").alias(name))
    return batch.select("match_key", *columns)


def merged_rows(stored: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """The findings after a batch of candidates, with ``created`` for the rows that are new.

    A new fingerprint is inserted with an audit row. A stored finding that is open or in
    progress gets the batch's scan, snippet and time; other stored findings stay as they are.
    Candidates without a fingerprint are always inserted. Both sides are read once: one full
    outer join on a key that is unique and evenly spread.
    """
    fresh = _new_rows(batch_rows(candidates), now)
    old_key = F.coalesce("fingerprint", F.concat(F.lit("old:"), "id"))
    old = stored.select(old_key.alias("match_key"), *FINDING_COLUMNS).alias("o")
    joined = old.join(fresh.alias("n"), "match_key", "full_outer")
    known, seen = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    take_new = seen & (~known | F.col("o.status").isin(*_REFRESHED))

    def value(name: str) -> Column:
        if name in ("scan_id", "updated_at", "code_snippet"):
            test = take_new
        else:
            test = ~known
        return F.when(test, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return joined.select(*[value(c) for c in FINDING_COLUMNS], (~known).alias("created"))


def created_audit(merged: DataFrame, now: Column) -> DataFrame:
    """Audit rows of the findings that ``merged_rows`` created."""
    return audit_rows(merged.filter("created"), F.col("id"), F.lit("created"), _null("string"),
                      F.concat_ws(": ", "severity", "title"), now)


def merge_findings(stored: DataFrame, candidates: DataFrame, now: Column) -> Change:
    """Next findings and audit rows of a batch; see ``merged_rows``. Both come from the same join, so
    a caller that needs both writes ``merged_rows`` once (as the plans do) instead."""
    merged = merged_rows(stored, candidates, now)
    return Change(merged.select(*FINDING_COLUMNS), created_audit(merged, now))


def flag_candidates(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Batch rows with ``is_new``, ``reappeared`` (stored as fixed) and ``copies``."""
    known = stored.select(
        F.col("fingerprint").alias("match_key"), F.col("status").alias("stored_status")
    ).filter("match_key IS NOT NULL")
    flagged = batch_rows(candidates).join(known, "match_key", "left").drop("match_key")
    return flagged.withColumns({
        "is_new": F.col("stored_status").isNull(),
        "reappeared": F.coalesce(F.col("stored_status") == "fixed", F.lit(False)),
    })


def scan_counts(flagged: DataFrame) -> DataFrame:
    """Totals of a scan: ``(total, new_count, existing_count)``; copies count as existing."""
    return flagged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
        F.count_if("is_new").alias("new_count"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count_if("is_new")).alias("existing_count"),
    )


def scan_response(flagged: DataFrame) -> DataFrame:
    """What a scan answers, ``(section, key, label, count)``, from one pass over ``flag_candidates``.

    Sections: ``total_findings``, ``new_findings`` and ``existing_findings`` with key ``all``, and
    ``by_category`` (with the category's name) and ``by_severity``. Grouping sets count all of them in one
    aggregate; every copy counts. A scan without findings has the three totals, all 0.
    """
    cells = flagged.groupingSets([[], ["owasp_category"], ["severity"]], "owasp_category", "severity").agg(
        F.grouping_id().alias("set"), F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.count_if("is_new").alias("fresh"))
    key, n, none = F.col("owasp_category"), F.col("n"), F.lit(None).cast("string")

    def row(section: str, name: Column, label: Column, count: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("key"), label.alias("label"), count.alias("count"))

    rows = (
        F.when(F.col("set") == 3, F.array(
            row("total_findings", F.lit("all"), none, n), row("new_findings", F.lit("all"), none, F.col("fresh")),
            row("existing_findings", F.lit("all"), none, n - F.col("fresh"))))
        .when(F.col("set") == 1, F.array(row("by_category", key, category_label(key), n)))
        .otherwise(F.array(row("by_severity", F.col("severity"), none, n)))
    )
    return cells.select(F.inline(rows))


# -- triage updates ---------------------------------------------------------------------


def valid_updates(updates: DataFrame) -> DataFrame:
    """Updates that set no status (null or empty) or a known one."""
    return updates.filter(F.coalesce(F.col("status").isin("", *STATUSES), F.lit(True)))


def rejected_updates(updates: DataFrame) -> DataFrame:
    return updates.filter(~F.col("status").isin("", *STATUSES))


def update_findings(stored: DataFrame, updates: DataFrame, now: Column, *, audit_text: int | None = None) -> Change:
    """Apply triage updates in their order: status, notes, fix commit, fix text, each with its audit rows.

    Every update sees the state that the ones before it left, so a finding that turns to ``fixed``
    and back to ``open`` in one batch has two audit rows. Turning to ``fixed`` sets ``fixed_at``.
    Updates with an unknown status are left out; see ``rejected_updates``. ``audit_text`` cuts notes
    and fix texts in the log. The replay is staged, both results read it.
    """
    replay = stage_table(replayed(stored, valid_updates(updates)), "updates-replayed")
    joined = stored.alias("s").join(
        final_values(replay, now).alias("u"), F.col("s.id") == F.col("u.finding_id"), "left")
    new_values = {name: F.coalesce(F.col(f"u.{name}"), F.col(f"s.{name}")) for name in (*FIELDS, "fixed_at")}
    new_values["updated_at"] = F.when(F.col("u.finding_id").isNotNull(), now).otherwise(F.col("s.updated_at"))
    findings = joined.select(*[new_values.get(c, F.col(f"s.{c}")).alias(c) for c in FINDING_COLUMNS])

    def entry(test: Column, action: str, old: Column, new: Column) -> Column:
        return F.when(test, F.struct(F.lit(action).alias("action"), old.alias("old"), new.alias("new")))

    def logged(name: str) -> Column:
        return F.col(name) if audit_text is None else F.substring(name, 1, audit_text)

    entries = F.array_compact(F.array(
        entry(F.col("moved"), "status_changed", F.col("old_status"), F.col("status")),
        entry(F.col("notes").isNotNull(), "note_added", _null("string"), logged("notes")),
        entry(F.col("suggested_fix").isNotNull(), "fix_suggested", _null("string"), logged("suggested_fix")),
    ))
    each = replay.select("finding_id", F.col("place.ord").alias("ord"), F.col("place.tie").alias("tie"), F.explode(entries).alias("e"))
    audit = audit_rows(each, F.col("finding_id"), F.col("e.action"), F.col("e.old"), F.col("e.new"), now,
                       F.col("ord"), F.col("tie"))
    return Change(findings, audit)


def delete_findings(findings: DataFrame, audit: DataFrame, ids: DataFrame) -> Change:
    """Findings and audit rows without those of the listed ids (column ``id``)."""
    gone = ids.select("id").distinct()
    return Change(
        findings.join(gone, "id", "left_anti"),
        audit.join(gone.withColumnRenamed("id", "finding_id"), "finding_id", "left_anti"),
    )


# -- manual findings --------------------------------------------------------------------


def validated_manual(rows: DataFrame) -> DataFrame:
    """Manual findings with normalised severity and category, and ``reject_reason``."""
    sev, cat = F.lower("severity"), F.upper("owasp_category")
    reason = (
        F.when(~F.coalesce(sev.isin(*SEVERITIES), F.lit(False)), "severity")
        .when(~F.coalesce(cat.isin(*CATEGORIES), F.lit(False)), "category")
    )
    return rows.withColumns({
        "severity": sev, "owasp_category": cat, "reject_reason": reason,
    })


def manual_candidates(rows: DataFrame) -> DataFrame:
    """Accepted manual findings in the shape of scan candidates."""
    good = validated_manual(rows).filter("reject_reason IS NULL").drop("reject_reason")
    rule = F.col("rule_id") if "rule_id" in rows.columns else _null("string")
    good = good.withColumn("rule_id", rule)
    return good.withColumn(
        "fingerprint", fingerprint(F.col("file_path"), F.col("line_number"), F.col("rule_id"))
    )


# -- verification -----------------------------------------------------------------------

_NEAR = 5
_BUCKET = _NEAR + 1


def nearby_matches(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """``(id, near)``: lines of fresh matches of the same rule within 5 lines of a finding.

    Matches are offered to their own bucket of lines and both neighbours, so the join is an
    equality on path, rule and bucket and a crowded file is spread over many keys.
    """
    def bucket(line: Column) -> Column:
        return F.floor(line / _BUCKET)

    line = F.coalesce(F.col("line_number"), F.lit(0))
    wanted = findings.select("id", "file_path", "rule_id", line.alias("at"),
                             bucket(line).alias("bucket"))
    offered = matches.select(
        F.col("path").alias("file_path"), "rule_id", F.col("line_number").alias("seen"),
        F.explode(F.array(*[bucket(F.col("line_number")) + d for d in (-1, 0, 1)])).alias("bucket"),
    )
    pairs = wanted.join(offered, ["file_path", "rule_id", "bucket"]).filter(
        F.abs(F.col("seen") - F.col("at")) <= _NEAR
    )
    # At most eleven lines lie within reach of a finding.
    return pairs.groupBy("id").agg(F.array_sort(F.collect_set("seen")).alias("near"))


def verify_findings(
    findings: DataFrame, files: DataFrame, matches: DataFrame, known_rules: list[str]
) -> DataFrame:
    """``(id, outcome, near)`` for every finding against the present files and their matches."""
    checkable = findings.filter(
        F.col("rule_id").isin(*known_rules) & ~F.col("status").isin("fixed", "false_positive")
    )
    present = files.select(F.col("path").alias("file_path")).distinct()
    near = nearby_matches(checkable, matches)
    rows = (
        findings.select("id", "file_path", "rule_id", "status")
        .join(present.withColumn("_present", F.lit(True)), "file_path", "left")
        .join(near, "id", "left")
    )
    outcome = (
        F.when(F.col("rule_id").isNull() | (F.col("rule_id") == ""), "no_rule")
        .when(F.col("status").isin("fixed", "false_positive"), "already_resolved")
        .when(~F.col("rule_id").isin(*known_rules), "unknown_rule")
        .when(F.col("_present").isNull(), "file_missing")
        .when(F.col("near").isNull(), "verified_fixed")
        .otherwise("still_present")
    )
    return rows.select("id", "file_path", "rule_id", outcome.alias("outcome"), "near")


def files_to_verify(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files that hold a finding which may still be verified, with ``wanted``: the rules to look for.

    A file has at most as many wanted rules as there are rules, however many findings it has. Files
    that are bucketed by path (``write_source_snapshot``) are not moved.
    """
    wanted = findings.filter(
        "rule_id IS NOT NULL AND status NOT IN ('fixed', 'false_positive')"
    ).groupBy(F.col("file_path").alias("path")).agg(F.collect_set("rule_id").alias("wanted"))
    return files.join(wanted, "path")


def fixes_as_updates(outcomes: DataFrame) -> DataFrame:
    """Updates that close the findings whose pattern is gone."""
    return outcomes.filter("outcome = 'verified_fixed'").select(
        F.col("id").alias("finding_id"),
        F.lit("fixed").alias("status"),
        _null("string").alias("notes"),
        _null("string").alias("fix_commit_sha"),
        _null("string").alias("suggested_fix"),
        F.lit(0).cast("long").alias("ord"),
    )


# -- baseline, listing, gate --------------------------------------------------------------


def baseline(findings: DataFrame) -> DataFrame:
    """Fingerprints of the open findings."""
    return findings.filter("status = 'open' AND fingerprint IS NOT NULL").select("fingerprint")


def beyond_baseline(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that the baseline does not hold."""
    return candidates.join(known.select("fingerprint"), "fingerprint", "left_anti")


def filter_findings(
    findings: DataFrame,
    *,
    status: str | None = None,
    severity: str | None = None,
    category: str | None = None,
    path_part: str | None = None,
    scan_id: str | None = None,
) -> DataFrame:
    """Findings by status, severity, category, path and scan.

    ``path_part`` is looked for anywhere in the path, without regard to the case of ASCII
    letters, and may hold the wildcards ``%`` and ``_``; a backslash stands for itself.
    """
    equal = {"status": status, "severity": severity, "owasp_category": category,
             "scan_id": scan_id}
    tests = [F.col(name) == value for name, value in equal.items() if value]
    if path_part:
        tests.append(F.col("file_path").ilike("%" + path_part.replace("\\", "\\\\") + "%"))
    return findings.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def newest(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest findings first: all of them, or a listing of ``limit`` rows."""
    ordered = findings.orderBy(F.desc("found_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def compact(findings: DataFrame) -> DataFrame:
    """Without the long text columns."""
    return findings.drop(*_COMPACT_DROPS)


def with_audit_trail(findings: DataFrame, audit: DataFrame) -> DataFrame:
    """Findings with their label and audit entries, one row for each entry.

    Entries stay rows, so a finding with a very long history needs no single large group.
    """
    trail = audit.select(
        F.col("finding_id").alias("id"), F.col("id").alias("entry_id"), "action", "old_value",
        "new_value", F.col("timestamp").alias("entry_at"),
    )
    return findings.withColumn("owasp_label", category_label(F.col("owasp_category"), F.lit(""))).join(
        trail, "id", "left"
    )


def audit_trail(audit: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Audit entries by finding and time, with ``nth``: the number of the entry in its finding's trail.

    ``ids`` (column ``id``) narrows it to some findings. Numbers are made of a count of the days before
    and a window inside the day, so a finding with a very long history is not one window.
    """
    rows = audit if ids is None else audit.join(
        ids.select(F.col("id").alias("finding_id")).distinct(), "finding_id", "left_semi")
    rows = rows.withColumn("day", F.to_date("timestamp"))
    days = rows.groupBy("finding_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = days.select("finding_id", "day", (F.sum("n").over(
        Window.partitionBy("finding_id").orderBy("day")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("finding_id", "day").orderBy("timestamp", "id"))
    numbered = rows.withColumn("inside", inside).alias("r").join(
        before.alias("b"), (F.col("r.finding_id") == F.col("b.finding_id")) & F.col("r.day").eqNullSafe(F.col("b.day")))
    return numbered.select(
        "r.finding_id", (F.col("before") + F.col("inside")).alias("nth"), "r.id", "action", "old_value", "new_value", "timestamp",
    ).orderBy("finding_id", "nth")


def gate(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """``(failing, passed)``: findings at or above a severity. Unknown levels mean ``high``."""
    level = fail_on.lower() if fail_on.lower() in SEVERITIES else "high"
    floor = SEVERITIES.index(level) + 1
    failing = F.count_if(severity_rank(F.col("severity")) >= floor)
    return findings.agg(failing.alias("failing"), (failing == 0).alias("passed"))


# -- scans ------------------------------------------------------------------------------


def complete_scans(scans: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """Running scans closed with the number of findings that name them."""
    counts = findings.groupBy(F.col("scan_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_count"))
    joined = scans.join(counts, "id", "left")
    running = F.col("status") == "running"
    return joined.withColumns({
        "findings_count": F.when(running, F.coalesce("_count", F.lit(0)))
        .otherwise(F.col("findings_count")),
        "completed_at": F.when(running, now).otherwise(F.col("completed_at")),
        "status": F.when(running, F.lit("completed")).otherwise(F.col("status")),
    }).drop("_count")


def newest_scans(scans: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest scans first: all of them, or a listing of ``limit`` rows."""
    ordered = scans.orderBy(F.desc("started_at"), "id")
    return ordered if limit is None else ordered.limit(limit)
