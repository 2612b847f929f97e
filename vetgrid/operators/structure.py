"""Structure of a file for a design review: imports, decorators, endpoints, checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.constants import constant
from vetgrid.functions.text import has_any, lines_of, strip
from vetgrid.operators.config_checks import detect_framework

# Line forms of endpoints, in the order of their report.
_ENDPOINTS = {
    "route": r"(?dU)^@app\.(get|post|put|delete|patch)\s*\(",
    "mcp_tool": r"(?dU)^@mcp\.tool\s*\(",
    "route_handler": r"(?dU)^export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)\s*\(",
    "server_action": r"(?dU)^export\s+(?:async\s+)?function\s+\w+\s*\(",
    "handler": r"(?dU)^def\s+\w+.*request",
}


def file_structure(files: DataFrame, *, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row for each file; the lists are built inside the row, without a group."""
    stripped = F.transform(lines_of(F.col("content")), strip)
    base = files.select(
        *keep,
        stripped.alias("_lines"),
        has_any(F.col("content"), ("'use server'", '"use server"')).alias("_actions"),
        detect_framework(F.col("content")).alias("framework"),
    )
    lines = F.col("_lines")

    def kinds(line: Column) -> Column:
        tests = []
        for kind, pattern in _ENDPOINTS.items():
            test = line.rlike(pattern)
            if kind == "server_action":
                test = test & F.col("_actions")
            tests.append(F.when(test, F.lit(kind)))
        return F.array_compact(F.array(*tests))

    endpoints = F.flatten(F.transform(lines, lambda line, i: F.transform(
        kinds(line),
        lambda kind: F.struct((i + 1).alias("line"), kind.alias("type"), line.alias("detail")),
    )))
    decorators = F.array_compact(F.transform(lines, lambda line, i: F.when(
        F.startswith(line, F.lit("@")), F.struct((i + 1).alias("line"), line.alias("decorator")))))
    imports = F.filter(lines, lambda line: F.startswith(line, F.lit("import "))
                       | F.startswith(line, F.lit("from ")))
    return base.select(
        *keep, "framework", F.size(lines).alias("line_count"), imports.alias("imports"),
        decorators.alias("decorators"), endpoints.alias("endpoints"),
    )


# Framework (empty: all), check, question and signs; the names of the checks are fixed values.
_CHECKLIST = (
    ("", "Authorization", "Is the caller's right to the very resource checked at each endpoint?",
     "permission and ownership checks"),
    ("", "Rate Limiting", "Are costly and sensitive endpoints throttled?", "limiters, throttles"),
    ("", "Input Validation", "Is input checked on the server against what is allowed?",
     "schemas, forms, type checks"),
    ("", "Error Handling", "Are errors caught by kind, logged and kept from users?",
     "narrow handlers, plain answers"),
    ("", "Security Logging", "Do logins, refusals and rejected input leave a trace?",
     "log calls at these points"),
    ("", "Database Transactions", "Do changes in several steps commit as one?",
     "transactions, rollbacks"),
    ("", "Secrets Management", "Do credentials come from outside the source?",
     "environment or vault lookups"),
    ("mcp", "Tool Input Sanitization", "Do tools check every parameter before use?",
     "allow-lists, path checks"),
    ("mcp", "Code Execution Risk", "Can a parameter name code, a file or a command?",
     "child processes, evaluation, file access"),
    ("mcp", "Data Exfiltration Surface", "Can an answer carry secrets or file contents?",
     "raw file or environment output"),
    ("nextjs", "Server/Client Boundary", "Do client components get only what they show?",
     "whole records or sessions as props"),
    ("nextjs", "Server Action Authorization", "Does every action check the caller?",
     "actions without a check"),
    ("nextjs", "Route Handler Auth", "Do route handlers check the caller?",
     "exported methods without a check"),
    ("nextjs", "Middleware Coverage", "Does the matcher reach all protected routes?",
     "gaps, API routes"),
    ("nextjs", "Mass Assignment", "Are form fields picked one by one?",
     "whole forms written to a record"),
)


def review_checklist(structure: DataFrame, *, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Checklist items for each file, by its framework."""
    items = constant(
        [
            {"fw": fw, "position": i, "check": check, "question": question, "look_for": signs}
            for i, (fw, check, question, signs) in enumerate(_CHECKLIST, start=1)
        ],
        "array<struct<fw: string, position: int, check: string, question: string, look_for: string>>",
    )
    fitting = F.filter(items, lambda i: (i["fw"] == "") | (i["fw"] == F.col("framework")))
    return structure.select(*keep, "framework", F.inline(fitting)).drop("fw")
