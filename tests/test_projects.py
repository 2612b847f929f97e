from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vetgrid.operators import boundary, structure
from vetgrid.operators.projects import (
    PYTHON_ROLES,
    WEB_ROLES,
    network_surfaces,
    project_types,
    python_role,
    reviewable,
    role_context,
    web_role,
)


@pytest.mark.parametrize("path, text, role", [
    ("next.config.mjs", "'use client'", "config"), ("middleware.ts", "", "middleware"),
    ("app/api/route.ts", "", "route_handler"), ("app/error.tsx", "'use client'", "error_boundary"),
    ("app/a.tsx", "\n'use client';\n", "client_component"), ("app/a.ts", '"use server"', "server_action"),
    ("app/page.tsx", "", "page"), ("app/layout.tsx", "", "layout"), ("app/x.tsx", "", "server_component"),
    ("lib/x.ts", "", "lib"), ("app/x.tsx", "\n\n\n\n\n'use client'", "server_component"),
    ("app/x.tsx", "x" * 500 + "\n'use client'", "server_component"), ("app/page.test.tsx", "", "server_component"),
    ("app/page.tsx", "'use server'\n'use client'", "server_action")])
def test_web_role(one, path, text, role):
    assert one(web_role(F.col("p"), F.col("t")), p=path, t=text) == role


@pytest.mark.parametrize("path, text, role", [
    ("p/test_a.py", "", "test"), ("p/tests/a.py", "", "test"), ("p/Conftest.py", "", "test"),
    ("p/settings.py", "", "settings"), ("p/models.py", "", "model"), ("p/models/a.py", "", "model"),
    ("a.py", "@mcp.tool", "mcp_tool"), ("a.py", "FastAPI()", "fastapi_route"),
    ("a.py", "import Django\ndef f(request)", "django_view"), ("a.py", "def f(request)", "lib"),
    ("a.py", "Flask(x)", "flask_route"), ("a.py", "import argparse", "cli_script"),
    ("a.py", " " * 2000 + "argparse", "lib")])
def test_python_role(one, path, text, role):
    assert one(python_role(F.col("p"), F.col("t")), p=path, t=text) == role


def test_role_context(one):
    assert one(role_context(F.col("r"), WEB_ROLES), r="page")["label"] == "Page"
    assert tuple(one(role_context(F.col("r"), PYTHON_ROLES), r="other")) == ("OTHER", "", "")
    assert len(WEB_ROLES) == 10 and len(PYTHON_ROLES) == 9


def package(**deps):
    return json.dumps({"name": "x", **deps})


def test_project_types(make_files):
    files = make_files({
        "a/next.config.ts": "", "b/next.config.js": "", "b/setup.py": "", "c/pyproject.toml": "",
        "d/package.json": package(dependencies={"next": "1"}), "e/package.json": package(devDependencies={"react": "1"}),
        "f/package.json": "{broken", "g/x/next.config.js": "", "h/package.json": package(name="next"),
        "i/package.json": package(dependencies={"react": "1"}), "i/requirements.txt": ""})
    assert {tuple(r) for r in project_types(files).collect()} == {
        ("a", "nextjs"), ("b", "monorepo"), ("c", "python"), ("d", "nextjs"), ("e", "react"),
        ("f", "unknown"), ("g", "unknown"), ("h", "unknown"), ("i", "python")}


def test_surfaces(make_files):
    files = make_files({"a/x.py": "import os", "b/x.py": "  from flask import Flask", "c/.x/y.py": "import flask",
                        "d/venv/y.py": "import flask", "e/y.txt": "import flask", "f/y.py": "# import flask",
                        "g/y.py": "x\nimport http.server"})
    assert {r.project for r in network_surfaces(files).collect() if r.surface == "network"} == {"b", "g"}
    assert network_surfaces(files).count() == 7


def test_reviewable(one):
    test = reviewable(F.col("p"), F.col("t"))
    assert one(test, p="a/b.py", t="unknown") and one(test, p="a/b.tsx", t="react")
    assert not one(test, p="a/b.tsx", t="monorepo") and not one(test, p="a/.py", t="python")


def test_structure(make_files):
    text = ("import os\nfrom a import b\n@app.get('/x')\ndef read(request):\n    pass\n  @mcp.tool()\n"
            "export async function GET(r) {\nexport function go() {\nimportant = 1")
    rows = structure.file_structure(make_files({"p/a.py": text, "p/b.ts": "'use server'\nexport function act() {"}))
    by_path = {r.path: r for r in rows.collect()}
    a = by_path["p/a.py"]
    assert a.line_count == 9 and a.imports == ["import os", "from a import b"]
    assert [(d.line, d.decorator) for d in a.decorators] == [(3, "@app.get('/x')"), (6, "@mcp.tool()")]
    assert [(e.line, e.type) for e in a.endpoints] == [(3, "route"), (4, "handler"), (6, "mcp_tool"), (7, "route_handler")]
    assert [(e.line, e.type) for e in by_path["p/b.ts"].endpoints] == [(2, "server_action")]
    checks = structure.review_checklist(rows).groupBy("path").count()
    assert {tuple(r) for r in checks.collect()} == {("p/a.py", 10), ("p/b.ts", 12)}


def test_boundary(make_files):
    files = make_files({
        "p/app/page.tsx": "import Card from './Card'\nimport { A, b, C as D } from '../ui/kit'\nimport Gone from './gone'\n"
                          "import Srv from './srv'\nimport Alias from '@/x'\nimport Css from './s.css'\n"
                          "<Card user={session.user}\n  n={1}/>\n<D x={1}></D><A label=\"t\"/><Gone token={t}>\n<Srv a={1}/>"
                          "<Alias a={1}/><Css a={1}/><Card wrap={<Gone q={2}/>}/>",
        "p/app/Card.tsx": "'use client'\n", "p/ui/kit/index.tsx": "\"use client\"", "p/app/srv.ts": "x",
        "p/app/s.css": "x", "p/app/client.tsx": "'use client'\nimport Card from './Card'\n<Card user={u}/>",
        "p/lib/x.tsx": "import Card from '../app/Card'\n<Card user={u}/>"})
    rows = boundary.boundary_crossings(boundary.boundary_facts(files))
    got = {(r.client_component, r.client_file, r.line, r.risk_level, tuple(p.name for p in r.props)) for r in rows.collect()}
    assert got == {
        ("Card", "p/app/Card.tsx", 7, "high", ("user", "n")), ("D", "p/ui/kit/index.tsx", 9, "medium", ("x",)),
        ("Gone", None, 9, "high", ("token",)), ("Gone", None, 10, "medium", ("q",)),
        ("Card", "p/app/Card.tsx", 10, "medium", ("wrap",))}
    assert tuple(boundary.boundary_summary(rows).first()) == (5, 2, 3)
    props = {(r.client_component, r.prop, r.value, r.line) for r in boundary.sensitive_props(rows).collect()}
    assert props == {("Card", "user", "session.user", 7), ("Gone", "token", "t", 9)}
    assert boundary.in_web_projects(rows, project_types(files)).count() == 0
