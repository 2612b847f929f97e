"""Checks of framework configuration, and the detection of the framework."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.text import (
    count_present,
    fingerprint,
    has_any,
    setting_is,
    setting_value,
)

# Texts whose presence speaks for a framework, in tie-breaking order.
FRAMEWORK_SIGNALS = {
    "django": ("INSTALLED_APPS", "MIDDLEWARE", "ROOT_URLCONF", "DATABASES", "TEMPLATES", "STATIC_URL"),
    "fastapi": ("FastAPI(", "from fastapi", "app = FastAPI", "@app.get", "@app.post", "APIRouter"),
    "flask": ("Flask(__name__)", "from flask", "@app.route"),
    "mcp": ("FastMCP(", "from mcp", "@mcp.tool()", "mcp.run()", "from mcp.server", "@mcp.tool"),
    "nextjs": ("NextConfig", "next.config", "remotePatterns", "from next/", "import next/",
               "'use client'", "'use server'", "NextResponse", "NextRequest"),
}

_CHECK = "array<struct<setting:string,expected:string,actual:string,severity:string,title:string,description:string>>"


def framework_scores(content: Column) -> dict[str, Column]:
    return {name: count_present(content, words) for name, words in FRAMEWORK_SIGNALS.items()}


def detect_framework(content: Column) -> Column:
    """The framework with the most signals present; the first one on ties; ``unknown`` at none."""
    scores = framework_scores(content)
    best = F.greatest(*scores.values())
    result = F.when(best == 0, "unknown")
    for name, score in scores.items():
        result = result.when(score == best, name)
    return result


def _check(test: Column, setting: str, expected: str, actual: Column | str, severity: str,
           title: str, description: str) -> Column:
    return F.when(test, F.struct(
        F.lit(setting).alias("setting"),
        F.lit(expected).alias("expected"),
        (F.lit(actual) if isinstance(actual, str) else actual).alias("actual"),
        F.lit(severity).alias("severity"),
        F.lit(title).alias("title"),
        F.lit(description).alias("description"),
    ))


def _failed(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


# In the four functions below setting names, expected and actual texts, severities and patterns
# are fixed values; titles and descriptions are descriptive text.


def django_checks(content: Column) -> Column:
    def value(name: str) -> Column:
        return setting_value(content, name)

    def shown(name: str) -> Column:
        return F.coalesce(F.nullif(value(name), F.lit("")), F.lit("not set"))

    def must_be_true(name: str, severity: str, title: str, description: str) -> Column:
        return _check(~setting_is(value(name), "True"), name, "True", shown(name), severity,
                      title, description)

    hosts, key = value("ALLOWED_HOSTS"), value("SECRET_KEY")
    quoted = F.startswith(key, F.lit("'")) | F.startswith(key, F.lit('"'))
    return _failed(
        _check(setting_is(value("DEBUG"), "True"), "DEBUG", "False", "True", "critical",
               "Debug mode is on", "Debug pages show traces, queries and paths."),
        _check(value("SECURE_HSTS_SECONDS").isNull() | setting_is(value("SECURE_HSTS_SECONDS"), "0"),
               "SECURE_HSTS_SECONDS", ">= 31536000 (1 year)", shown("SECURE_HSTS_SECONDS"), "high",
               "Strict transport is off", "Browsers may be led back to plain HTTP."),
        must_be_true("SECURE_SSL_REDIRECT", "high", "No redirect to HTTPS",
                     "Plain requests are answered instead of redirected."),
        must_be_true("SESSION_COOKIE_SECURE", "high", "Session cookie may travel in the clear",
                     "The cookie is also sent over HTTP."),
        _check(setting_is(value("SESSION_COOKIE_HTTPONLY"), "False"), "SESSION_COOKIE_HTTPONLY",
               "True (default)", "False", "high", "Session cookie readable by scripts",
               "Injected scripts can steal the session."),
        must_be_true("CSRF_COOKIE_SECURE", "medium", "CSRF cookie may travel in the clear",
                     "The token is also sent over HTTP."),
        _check(value("X_FRAME_OPTIONS").isNull(), "X_FRAME_OPTIONS", "'DENY' or 'SAMEORIGIN'",
               "not set", "medium", "Framing is not restricted",
               "Other sites can embed the pages."),
        must_be_true("SECURE_CONTENT_TYPE_NOSNIFF", "medium", "Content sniffing is allowed",
                     "Browsers may treat uploads as scripts."),
        _check(has_any(F.coalesce(hosts, F.lit("")), ("'*'", '"*"')), "ALLOWED_HOSTS",
               "Specific hostnames", hosts, "high", "All host names are accepted",
               "Forged Host headers reach the application."),
        _check(F.coalesce(
                   quoted & (F.length(key) > 10)
                   & ~has_any(key, ("os.environ", "os.getenv", "config(", "env(")), F.lit(False)),
               "SECRET_KEY", "Loaded from environment", "Hardcoded in source", "high",
               "Signing key in source", "Readers of the source can forge sessions."),
        _check(~F.contains(content, F.lit("CsrfViewMiddleware"))
               & ~F.contains(F.lower(content), F.lit("csrf")),
               "MIDDLEWARE (CSRF)", "django.middleware.csrf.CsrfViewMiddleware in MIDDLEWARE",
               "Not found", "high", "No CSRF middleware in sight",
               "Other sites can submit forms for a user."),
    )


def fastapi_checks(content: Column) -> Column:
    any_origin = content.rlike(r"(?dsU)allow_origins\s*=\s*\[.*?['\"]?\*['\"]?.*?\]")
    open_list = content.rlike(r"(?dsU)allow_origins\s*=\s*\[.*?\*.*?\]")
    credentials = content.rlike(r"(?dU)allow_credentials\s*=\s*True")
    host_check = F.contains(content, F.lit("TrustedHostMiddleware")) | F.contains(
        F.lower(content), F.lit("trusted_host"))
    return _failed(
        _check(any_origin, "CORSMiddleware.allow_origins", "Specific origins", '["*"]', "high",
               "All origins are allowed", "Any site may call the API."),
        _check(credentials & open_list, "CORSMiddleware",
               "Credentials not allowed with wildcard origins",
               "allow_credentials=True with allow_origins=['*']", "critical",
               "Credentials with open origins", "Any site may call the API as the user."),
        _check(~host_check & has_any(content, ("FastAPI", "app = ")), "TrustedHostMiddleware",
               "TrustedHostMiddleware configured", "Not found", "medium",
               "Host names are not checked", "Forged Host headers reach the application."),
    )


def nextjs_checks(content: Column) -> Column:
    return _failed(
        _check(~F.contains(content, F.lit("async headers")), "Security headers",
               "headers() function with CSP, HSTS, X-Frame-Options",
               "No headers configuration found", "medium", "No security headers configured",
               "Policy, transport and framing headers are missing."),
        _check(content.rlike(r"""(?dU)hostname\s*:\s*['"][*]{2}['"]"""), "images.remotePatterns",
               "Specific hostnames", "hostname: '**' (wildcard)", "high",
               "Image loader open to all hosts", "The optimizer fetches any address."),
        _check(content.rlike(r"(?diuU)destination\s*:\s*['\"]https?://(?:localhost|127\.0\.0\.1|10\.|192\.168\.)"),
               "rewrites", "No direct proxy to internal services",
               "Rewrite to localhost/private IP detected", "high",
               "Rewrite to an internal address", "Outside requests reach an internal service."),
        _check(~F.contains(content, F.lit("poweredByHeader"))
               | content.rlike(r"(?diuU)poweredByHeader\s*:\s*true"),
               "poweredByHeader", "false", "true or not set", "low",
               "Framework named in responses", "The header tells attackers what to try."),
        _check(content.rlike(r"(?diuU)reactStrictMode\s*:\s*false"), "reactStrictMode", "true",
               "false", "medium", "Strict mode is off", "Unsafe patterns go unnoticed."),
    )


def general_checks(content: Column) -> Column:
    environment = "Loaded from environment or secrets manager"
    return _failed(
        _check(content.rlike(r"(?diuU)(?:DEBUG|DEV_MODE|DEVELOPMENT)\s*=\s*True"),
               "DEBUG/DEV_MODE", "False in production", "True", "high",
               "Development mode is on", "Internal details may be shown."),
        _check(content.rlike(
                   r"""(?diuU)(?:SECRET|KEY|TOKEN|PASSWORD|PASSWD|API_KEY)\s*=\s*['"][^'"]{8,}['"]"""),
               "Secret value", environment, "Hardcoded in source", "high",
               "Secret in source", "Readers of the source hold the secret."),
        _check(content.rlike(r"(?diuU)(?:mysql|postgresql|mongodb|redis)://\S+:\S+@"),
               "Database connection string", environment, "Hardcoded in source", "high",
               "Connection string in source", "Readers of the source reach the database."),
        _check(content.rlike(r"""(?dU)['"]?\d{4,5}:\d{4,5}['"]?"""), "Port mapping",
               "Bound to 127.0.0.1 or internal network", "May be exposed", "medium",
               "Port mapping to be checked", "The port may be reachable from outside."),
    )


_CHECKS = {
    "django": django_checks,
    "fastapi": fastapi_checks,
    "nextjs": nextjs_checks,
    "general": general_checks,
}


def check_config(files: DataFrame, framework: str = "auto", *, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Failed checks of each file, one row each, with the framework that was assumed."""
    content = F.col("content")
    if framework == "auto":
        named = files.select(*keep, "content", detect_framework(content).alias("framework"))
        checks = F.when(F.col("framework") == "django", django_checks(content))
        for name in ("fastapi", "nextjs"):
            checks = checks.when(F.col("framework") == name, _CHECKS[name](content))
        checks = checks.otherwise(general_checks(content))
    else:
        named = files.select(*keep, "content", F.lit(framework.lower()).alias("framework"))
        checks = _CHECKS.get(framework.lower(), general_checks)(content)
    return named.select(*keep, "framework", F.inline(checks.cast(_CHECK)))


def config_findings(checks: DataFrame, *, scan_id: str) -> DataFrame:
    """Failed checks as finding candidates of category A02."""
    rule = F.concat(F.lit("config-"), F.col("setting"))
    none = F.lit(None)
    return checks.select(
        F.lit(scan_id).alias("scan_id"),
        F.col("path").alias("file_path"),
        none.cast("int").alias("line_number"),
        rule.alias("rule_id"),
        fingerprint(F.col("path"), none.cast("int"), rule).alias("fingerprint"),
        F.lit("A02").alias("owasp_category"),
        "severity",
        "title",
        F.format_string("%s (expected: %s, actual: %s)", "description", "expected", "actual")
        .alias("description"),
        none.cast("string").alias("code_snippet"),
        F.format_string("Set %s = %s", "setting", "expected").alias("suggested_fix"),
        none.cast("double").alias("confidence"),
    )


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("framework", "setting", "severity").agg(F.count(F.lit(1)).alias("count"))
