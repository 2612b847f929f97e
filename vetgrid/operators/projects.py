"""Roles of files and facts about projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.constants import constant
from vetgrid.functions.text import file_name, file_stem, has_any, lines_of, strip

# Directive lines at the head of a module, and file names.
_CLIENT = ("'use client'", '"use client"', "'use client';", '"use client";')
_SERVER = ("'use server'", '"use server"', "'use server';", '"use server";')
_NEXT_CONFIGS = ("next.config.js", "next.config.mjs", "next.config.ts")
_PYTHON_MARKERS = ("pyproject.toml", "requirements.txt", "setup.py")
_SETTINGS_NAMES = ("settings.py", "config.py", "conf.py", ".env")
_SURFACE_SKIPPED = ("__pycache__", ".venv", "venv", "node_modules", ".git", ".tox", ".mypy_cache")

# Imports that open a network port.
_NETWORK_IMPORTS = (
    r"(?dmU)^\s*(?:from|import)\s+(?:fastapi|flask|django|aiohttp\.web|tornado\.web|sanic"
    r"|uvicorn|gunicorn|hypercorn|waitress|fastmcp|mcp\.server|socketserver|http\.server"
    r"|xmlrpc\.server|starlette)"
)


def _directives(content: Column) -> Column:
    """First five lines of the first 500 characters, stripped."""
    return F.transform(F.slice(lines_of(F.substring(content, 1, 500)), 1, 5), strip)


def is_client_component(content: Column) -> Column:
    return F.arrays_overlap(_directives(content), F.array(*map(F.lit, _CLIENT)))


def web_role(rel_path: Column, content: Column) -> Column:
    """Role of a file in a Next.js App Router project."""
    name, stem = file_name(rel_path), file_stem(rel_path)
    first_directive = F.filter(_directives(content), lambda line: line.isin(*_CLIENT, *_SERVER))
    directive = F.get(first_directive, 0)
    return (
        F.when(F.startswith(name, F.lit("next.config")), "config")
        .when(stem == "middleware", "middleware")
        .when(stem == "route", "route_handler")
        .when(stem == "error", "error_boundary")
        .when(directive.isin(*_CLIENT), "client_component")
        .when(directive.isin(*_SERVER), "server_action")
        .when(stem == "layout", "layout")
        .when(stem == "page", "page")
        .when(F.startswith(rel_path, F.lit("app/")), "server_component")
        .otherwise("lib")
    )


def python_role(path: Column, content: Column) -> Column:
    """Role of a Python file, by path first and then by its first 2000 characters."""
    low = F.lower(path)
    name = file_name(low)
    head = F.substring(content, 1, 2000)
    django = F.contains(F.lower(head), F.lit("django")) | F.contains(head, F.lit("@login_required"))
    view = F.contains(head, F.lit("def ")) & F.contains(head, F.lit("request")) & django
    return (
        F.when(F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("conftest"))
               | F.contains(low, F.lit("/tests/")), "test")
        .when(name.isin(*_SETTINGS_NAMES), "settings")
        .when((name == "models.py") | F.contains(low, F.lit("/models/")), "model")
        .when(has_any(head, ("@mcp.tool", "FastMCP")), "mcp_tool")
        .when(has_any(head, ("@app.get", "@app.post", "FastAPI")), "fastapi_route")
        .when(view, "django_view")
        .when(has_any(head, ("@app.route", "Flask(")), "flask_route")
        .when(has_any(head, ("argparse", "click.command", "if __name__")), "cli_script")
        .otherwise("lib")
    )


# Role, label, trust and risk; the texts are descriptive.
WEB_ROLES = (
    ("server_component", "Server component", "Runs on the server with access to secrets and data.",
     "Props handed to client components leave the server."),
    ("client_component", "Client component", "Runs in the browser, which is not trusted.",
     "Code and props are visible; raw markup from users is dangerous."),
    ("server_action", "Server action", "Runs on the server, callable by anyone over HTTP.",
     "Each action has to check the caller and the input itself."),
    ("route_handler", "Route handler", "Public HTTP endpoint on the server.",
     "Checks in middleware alone are not enough."),
    ("middleware", "Middleware", "Runs at the edge before routing.",
     "The matcher has to cover every protected route."),
    ("layout", "Layout", "Server component around child pages.",
     "Data loaded here is shared with all children."),
    ("page", "Page", "Server component at the start of a route.",
     "Look at the props given to client components."),
    ("error_boundary", "Error boundary", "Client component for run-time errors.",
     "Details of errors must not reach users."),
    ("config", "Framework configuration", "Read at build time.",
     "Headers, image hosts and rewrites matter for security."),
    ("lib", "Library module", "As trusted as the modules that import it.",
     "Secrets leak if a client component imports it."),
)
PYTHON_ROLES = (
    ("fastapi_route", "FastAPI route", "Public HTTP endpoint with untrusted input.",
     "Check caller and input in the handler."),
    ("django_view", "Django view", "Public HTTP endpoint through URL routing.",
     "Login checks do not replace permission checks."),
    ("flask_route", "Flask route", "Public HTTP endpoint.",
     "Nothing is checked unless the route does it."),
    ("mcp_tool", "Agent tool", "Called by agents; parameters are untrusted.",
     "Paths, commands and code in parameters need an allow-list."),
    ("cli_script", "Command line script", "Runs with the user's own rights.",
     "Look at child processes and configuration input."),
    ("settings", "Settings", "Sets the security of the whole application.",
     "Secrets, debug switches and open hosts are critical here."),
    ("model", "Data model", "Data layer on the server.",
     "Look for fields that clients may set or read freely."),
    ("test", "Test file", "Not deployed.",
     "Lower the severity; look for real credentials."),
    ("lib", "Library module", "As trusted as its callers.",
     "Follow the callers to see whether input arrives."),
)


def role_context(role: Column, roles: tuple[tuple[str, str, str, str], ...]) -> Column:
    """``struct(label, trust, risk)`` for a role; unknown roles get their name as label."""
    names = constant([name for name, *_ in roles], "array<string>")
    texts = constant(
        [{"label": label, "trust": trust, "risk": risk} for _, label, trust, risk in roles],
        "array<struct<label: string, trust: string, risk: string>>",
    )
    unknown = F.struct(F.upper(role).alias("label"), F.lit("").alias("trust"), F.lit("").alias("risk"))
    known = F.array_position(names, role)
    return F.when(known > 0, F.element_at(texts, known.cast("int"))).otherwise(unknown)


def project_types(files: DataFrame) -> DataFrame:
    """``(project, project_type)`` from the files at each project's root."""
    rel, text = F.col("rel_path"), F.col("content")
    manifest = rel == "package.json"

    def depends_on(package: str) -> Column:
        kinds = [
            F.from_json(F.get_json_object(text, f"$.{kind}"), "map<string,string>")
            for kind in ("dependencies", "devDependencies")
        ]
        found = F.lit(False)
        for kind in kinds:
            found = found | F.coalesce(F.map_contains_key(kind, package), F.lit(False))
        return F.when(manifest, found).otherwise(F.lit(False))

    # Other files only prove that the project exists, so their text is not looked at.
    facts = files.groupBy("project").agg(
        F.bool_or(rel.isin(*_NEXT_CONFIGS) | depends_on("next")).alias("web"),
        F.bool_or(rel.isin(*_PYTHON_MARKERS)).alias("python"),
        F.bool_or(depends_on("react")).alias("react"),
    )
    kind = (
        F.when(F.col("web") & F.col("python"), "monorepo")
        .when(F.col("web"), "nextjs")
        .when(F.col("python"), "python")
        .when(F.col("react"), "react")
        .otherwise("unknown")
    )
    return facts.select("project", kind.alias("project_type"))


def network_surfaces(files: DataFrame) -> DataFrame:
    """``(project, surface)``: ``network`` if any Python file imports a server framework."""
    parts = F.split("rel_path", "/")
    hidden = F.exists(parts, lambda p: p.isin(*_SURFACE_SKIPPED) | F.startswith(p, F.lit(".")))
    opens = F.when(
        F.endswith("rel_path", F.lit(".py")) & ~hidden, F.col("content").rlike(_NETWORK_IMPORTS)
    ).otherwise(F.lit(False))
    return files.groupBy("project").agg(
        F.when(F.bool_or(opens), "network").otherwise("local").alias("surface"))


def reviewable(rel_path: Column, project_type: Column) -> Column:
    """Files that a reviewer model reads: Python, and scripts in web projects."""
    script = rel_path.rlike(r"(?<=[^/])\.(?:ts|tsx|js|jsx)$") & project_type.isin("nextjs", "react")
    return rel_path.rlike(r"(?<=[^/])\.py$") | script
