"""Fixed table schemas (Spark DDL)."""

FILES = "project STRING, path STRING, rel_path STRING, content STRING, size BIGINT"

RULES = (
    "id STRING, owasp_category STRING, severity STRING, title STRING, description STRING, "
    "pattern STRING, flags STRING, file_glob STRING, suggested_fix STRING, exclude_pattern STRING"
)

FINDINGS = (
    "id STRING, scan_id STRING, file_path STRING, line_number INT, rule_id STRING, "
    "fingerprint STRING, category_type STRING, owasp_category STRING, severity STRING, "
    "title STRING, description STRING, code_snippet STRING, suggested_fix STRING, "
    "status STRING, found_at TIMESTAMP, updated_at TIMESTAMP, fixed_at TIMESTAMP, "
    "fix_commit_sha STRING, confidence DOUBLE, notes STRING"
)

SCANS = (
    "id STRING, scope STRING, target_path STRING, started_at TIMESTAMP, completed_at TIMESTAMP, "
    "findings_count BIGINT, categories ARRAY<STRING>, status STRING"
)

AUDIT_LOG = (
    "id STRING, finding_id STRING, action STRING, old_value STRING, new_value STRING, "
    "timestamp TIMESTAMP"
)

UPDATES = (
    "finding_id STRING, status STRING, notes STRING, fix_commit_sha STRING, "
    "suggested_fix STRING, ord BIGINT"
)

ERRORS = (
    "error_id STRING, timestamp STRING, tool_name STRING, error_type STRING, message STRING, "
    "context MAP<STRING,STRING>"
)

AUDIT_REPORT = (
    "dependencies ARRAY<STRUCT<name: STRING, version: STRING, vulns: ARRAY<STRUCT<"
    "id: STRING, description: STRING, fix_versions: ARRAY<STRING>>>>>"
)

TRIAGE_RESPONSE = (
    "assessments ARRAY<STRUCT<finding_id: STRING, verdict: STRING, confidence: DOUBLE, "
    "reasoning: STRING, adjusted_severity: STRING>>"
)

REVIEW_RESPONSE = (
    "findings ARRAY<STRUCT<owasp_category: STRING, severity: STRING, title: STRING, "
    "description: STRING, line_number: INT, suggested_fix: STRING, confidence: DOUBLE>>"
)

CATEGORY_REFERENCE = (
    "version STRING, source STRING, categories ARRAY<STRUCT<id: STRING, name: STRING, rank: INT, "
    "description: STRING, stats: STRUCT<cwes_mapped: INT, max_incidence_rate_pct: DOUBLE, "
    "avg_incidence_rate_pct: DOUBLE, total_occurrences: BIGINT, total_cves: BIGINT, "
    "avg_weighted_exploit: DOUBLE, avg_weighted_impact: DOUBLE>, "
    "key_cwes: ARRAY<STRUCT<id: STRING, name: STRING, cves: BIGINT>>, "
    "common_vulnerabilities: ARRAY<STRING>, prevention: ARRAY<STRING>, "
    "notable_incidents: ARRAY<STRING>, scanner_note: STRING>>"
)
