from __future__ import annotations

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from vetgrid.functions.text import display_time
from vetgrid.plans import reports
from vetgrid.rules import ALL_RULES
from vetgrid.schemas import FINDINGS, SCANS


@pytest.fixture(scope="module")
def stored(spark):
    rows = []
    for n in range(30):
        status = ["open", "fixed", "accepted", "false_positive"][n % 4] if n >= 24 else "open"
        rows.append((f"{n:02d}", f"src/f{n % 3}.py", n, "A05-004" if n % 5 else "config-X", "A05",
                     ["low", "medium", "high", "critical"][n % 4], f"Title {n}", "Why", "code" if n % 2 else None,
                     "Fix" if n % 3 else None, status, "note" if n % 2 else None))
    made = spark.createDataFrame(rows, "id STRING, file_path STRING, line_number INT, rule_id STRING, owasp_category STRING, "
                                 "severity STRING, title STRING, description STRING, code_snippet STRING, suggested_fix STRING, status STRING, notes STRING")
    made = made.withColumns({"found_at": F.to_timestamp(F.lit("2025-01-01 10:00:00")), "updated_at": F.to_timestamp(F.lit("2025-01-02 10:00:00"))})
    return spark.createDataFrame([], FINDINGS).unionByName(made, allowMissingColumns=True)


def text_of(folder):
    return "".join(p.read_text() for p in sorted(pathlib.Path(folder).glob("part-*")))


def test_report(spark, stored, tmp_path):
    scans = spark.createDataFrame([], SCANS)
    reports.write_report(stored, scans, str(tmp_path / "r"), "2025-01-03 00:00 UTC")
    text = text_of(tmp_path / "r")
    lines = text.split("\n")
    assert lines[0] == "# Security Scan Report"
    assert "- **Total findings:** 30" in lines and "- **Open:** 26" in lines and "- **Fixed:** 2" in lines
    assert "- **Accepted/False Positive:** 2" in lines
    order = [text.index(h) for h in ("## Executive", "### Open by Severity", "| CRITICAL |", "| LOW |", "### Open by Category",
                                     "| A05 | Injection | 26 |", "### Top Files", "## Findings Detail", "### 1. [CRITICAL]",
                                     "### 20. ", "*...and 6 more open findings.*", "## Triaged Findings", "## Remediation Priority")]
    assert order == sorted(order)
    assert "### 21." not in text and "Scan history" not in text
    assert "- **[False Positive]** Title 27 (`src/f0.py`)\n  - *Rationale:* note\n  - *Triaged:* 2025-01-02 10:00 UTC" in text


def test_empty_report(spark):
    lines = reports.ordered_text(reports.report_lines(
        spark.createDataFrame([], FINDINGS), spark.createDataFrame([], SCANS), "now")).collect()
    text = "\n".join(r.text for r in lines)
    assert "No security findings recorded." in text
    assert "### Open by" not in text and "## Findings Detail" not in text
    assert "## Remediation Priority" not in text


def test_sarif(spark, stored, tmp_path):
    reports.write_sarif(stored, str(tmp_path / "s"), limit=None, results_per_document=20)
    documents = [json.loads(line) for line in text_of(tmp_path / "s").strip().split("\n")]
    assert len(documents) == 2
    results = [r for d in documents for r in d["runs"][0]["results"]]
    assert {r["properties"]["finding-id"] for r in results} == {f"{n:02d}" for n in range(30)}
    assert {r["level"] for r in results} == {"error", "warning", "note"}
    first = next(r for r in results if r["properties"]["finding-id"] == "00")
    assert first["ruleId"] == "config-X" and first["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert "fixes" not in first
    rules = {r["id"]: r for r in documents[0]["runs"][0]["tool"]["driver"]["rules"]}
    assert len(rules) == len(ALL_RULES) + 1
    assert rules["A05-004"]["helpUri"].endswith("A05_2025/") and "helpUri" not in rules["config-X"]
    assert documents[0]["version"] == "2.1.0"


def test_sarif_limit(spark, stored, tmp_path):
    reports.write_sarif(stored, str(tmp_path / "s"), limit=5)
    document = json.loads(text_of(tmp_path / "s"))
    assert len(document["runs"][0]["results"]) == 5


def test_empty_sarif(spark):
    row = reports.sarif_documents(spark.createDataFrame([], FINDINGS)).first()
    assert json.loads(row.document)["runs"][0]["results"] == []


def test_display_time(one):
    assert one(display_time(F.col("t")), t="2025-01-02T03:04:05+00:00") == "2025-01-02 03:04 UTC"
    assert one(display_time(F.col("t")), t="soon") == "soon"
