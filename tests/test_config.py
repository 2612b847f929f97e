from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vetgrid.functions.text import setting_is, setting_value
from vetgrid.operators.config_checks import check_config, config_findings, detect_framework

SAFE_DJANGO = """
DEBUG = False
SECURE_HSTS_SECONDS = 31536000
SECURE_SSL_REDIRECT = True
SESSION_COOKIE_SECURE = True,
CSRF_COOKIE_SECURE = True
X_FRAME_OPTIONS = 'DENY'
SECURE_CONTENT_TYPE_NOSNIFF = True
ALLOWED_HOSTS = ['a.example']
SECRET_KEY = os.getenv('A_LONG_NAME')
MIDDLEWARE = ['django.middleware.csrf.CsrfViewMiddleware']
"""


@pytest.fixture(scope="module")
def failed(make_files):
    def run(text, framework):
        rows = check_config(make_files({"p/f.py": text}), framework).collect()
        return {r.setting: (r.actual, r.severity) for r in rows}
    return run


@pytest.mark.parametrize("text, value", [
    ("A = 1", "1"), ("  A=  x  \n", "x"), ("A =\n  7", "7"), ("BA = 1", None), ("# A = 1", None),
    ("A = \n", ""), ("A = 1\nA = 2", "1"), ("A = ", "")])
def test_setting_value(one, text, value):
    import re
    m = re.search(r"^\s*A\s*=\s*(.+?)$", text, re.MULTILINE)
    assert value == (m.group(1).strip() if m else None)
    assert one(setting_value(F.col("t"), "A"), t=text) == value


def test_setting_is(one):
    assert one(setting_is(setting_value(F.col("t"), "A"), "True"), t="A = True,") is True
    assert one(setting_is(setting_value(F.col("t"), "A"), "True"), t="x") is False


def test_django(failed):
    assert failed(SAFE_DJANGO, "django") == {}
    bare = failed("DEBUG = True\nSESSION_COOKIE_HTTPONLY = False\nALLOWED_HOSTS = [\"*\"]\nSECRET_KEY = 'abcdefghij'", "django")
    assert len(bare) == 11
    assert bare["DEBUG"] == ("True", "critical")
    assert bare["ALLOWED_HOSTS"] == ('["*"]', "high")
    assert bare["SECURE_SSL_REDIRECT"] == ("not set", "high")
    assert "SECRET_KEY" not in failed("SECRET_KEY = 'short'", "django")
    assert failed("SECURE_HSTS_SECONDS = 0", "django")["SECURE_HSTS_SECONDS"] == ("0", "high")
    assert "MIDDLEWARE (CSRF)" not in failed("# Csrf is off", "django")


def test_fastapi(failed):
    assert set(failed("app = FastAPI()\nallow_origins=[\n'*'\n], allow_credentials = True", "fastapi")) == {
        "CORSMiddleware.allow_origins", "CORSMiddleware", "TrustedHostMiddleware"}
    assert failed("x = 1", "fastapi") == {}
    assert failed("FastAPI() trusted_host", "fastapi") == {}


def test_nextjs(failed):
    text = "hostname: '**' destination: 'http://10.0.0.1' poweredByHeader: TRUE reactStrictMode: false"
    assert set(failed(text, "nextjs")) == {
        "Security headers", "images.remotePatterns", "rewrites", "poweredByHeader", "reactStrictMode"}
    assert failed("async headers() {} poweredByHeader: false", "nextjs") == {}


def test_general(failed):
    assert set(failed("debug=True token = 'abcdefgh' mysql://a:b@c 5432:5432", "general")) == {
        "DEBUG/DEV_MODE", "Secret value", "Database connection string", "Port mapping"}
    assert set(failed("debug=True", "flask")) == {"DEBUG/DEV_MODE"}


@pytest.mark.parametrize("text, framework", [
    ("INSTALLED_APPS MIDDLEWARE", "django"), ("from fastapi import X", "fastapi"), ("@app.route", "flask"),
    ("FastMCP(", "mcp"), ("NextResponse", "nextjs"), ("x", "unknown"), ("DATABASES from flask", "django"),
    ("from flask @app.get @app.post", "fastapi")])
def test_framework(one, text, framework):
    assert one(detect_framework(F.col("t")), t=text) == framework


def test_auto_and_findings(make_files):
    files = make_files({"p/a.py": "from fastapi import FastAPI\napp = FastAPI()", "p/b.py": "DEBUG = True"})
    checks = check_config(files)
    assert {(r.path, r.framework, r.setting) for r in checks.collect()} == {
        ("p/a.py", "fastapi", "TrustedHostMiddleware"), ("p/b.py", "unknown", "DEBUG/DEV_MODE")}
    found = {r.rule_id: r for r in config_findings(checks, scan_id="s").collect()}
    row = found["config-DEBUG/DEV_MODE"]
    assert row.suggested_fix == "Set DEBUG/DEV_MODE = False in production"
    assert row.description.endswith("(expected: False in production, actual: True)")
    assert row.owasp_category == "A02" and row.line_number is None and row.fingerprint
