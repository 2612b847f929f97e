"""The queries of ``workload.queries`` as SQL over the driver's tables."""

from __future__ import annotations

from vetgrid.operators.config_checks import FRAMEWORK_SIGNALS
from vetgrid.operators.findings import STATUSES
from vetgrid.operators.projects import PYTHON_ROLES, WEB_ROLES
from vetgrid.operators.structure import _CHECKLIST
from vetgrid.rules import ALL_RULES, CATEGORIES
from vetgrid.sources.files import CODE_EXTENSIONS, SKIPPED_FOLDERS
from vetgrid.sources.records import DEPENDENCY_FILES
from workload.oracle_base import (
    LABELS,
    LIFECYCLE,
    SCANS,
    SURFACE,
    adjusted,
    base,
    corpus_cte,
    hits_cte,
    in_list,
    lit,
    snippet,
)
from workload.queries import EXCLUDES, FIRST, SECOND, SINCE

SUFFIX = "regexp_extract(name, '.(\\.[^.]+)$', 1)"
STEM = "regexp_replace(name, '(.)\\.[^.]+$', '\\1')"
FOLDER = "regexp_replace(path, '/?[^/]*$', '')"
PRINT = "sha256({0} || ':' || coalesce({1}::VARCHAR, 'None') || ':' || {2})"
FINGERPRINT = PRINT.format("path", "line_number", "rule_id")
SECONDS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
MICROS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

FOLDERS = "string_split(rel_path, '/')[1:len(string_split(rel_path, '/')) - 1]"
SKIPPED = (
    f"(list_has_any({FOLDERS}, [{', '.join(map(lit, SKIPPED_FOLDERS))}]) OR "
    f"coalesce(list_bool_or(list_transform({FOLDERS}, lambda p: ends_with(p, '.egg-info'))), false))")
EXCLUDED = " OR ".join(
    f"rel_path GLOB {lit(p)} OR name GLOB {lit(p)}"
    + (f" OR contains('/' || rel_path, {lit('/' + p)})" if p.endswith("/") else "")
    for p in EXCLUDES)

HITS = base(hits_cte())
HITS2 = HITS.rstrip() + ",\n" + corpus_cte("files2", 2) + ",\n" + hits_cte("hits2", "files2") + "\n"

CANDIDATES = f"""cand AS (
  SELECT {PRINT.format('path', 'line_number', 'rule_id')} AS fp, *, {adjusted()} AS sev,
    sha256({snippet()}) AS snip FROM hits2 WHERE NOT off)"""
STORED = f"""stored AS (
  SELECT {FINGERPRINT} AS id, *, {adjusted()} AS sev, sha256({snippet()}) AS snip,
    CASE line_number % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'in_progress'
      ELSE 'open' END AS status
  FROM hits WHERE NOT off)"""
LIFE = HITS2.rstrip() + ",\n" + STORED + ",\n" + CANDIDATES + "\n"

IGNORE = """ign AS (SELECT project, e AS pat FROM (
    SELECT project, unnest(list_transform(string_split(content, chr(10)), lambda x: trim(x))) AS e
    FROM files WHERE rel_path = '.owaspignore') WHERE e <> '' AND NOT starts_with(e, '#'))"""
IGNORED = """EXISTS (SELECT 1 FROM ign WHERE ign.project = {0}.project AND (
    {0}.rel_path GLOB pat OR regexp_extract({0}.rel_path, '[^/]*$') GLOB pat
    OR (ends_with(pat, '/') AND contains('/' || {0}.rel_path, '/' || pat))))"""

CHANGES = """changes AS (SELECT coalesce(a.path, b.path) AS path,
    CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM files a FULL JOIN files2 b ON a.path = b.path
  WHERE a.path IS NULL OR b.path IS NULL OR a.content <> b.content)"""

AUDIT = f"""audit AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS finding_id,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'status_changed'
      WHEN 'view' THEN 'fix_suggested' ELSE 'note_added' END AS action,
    CASE WHEN event_type = 'purchase' THEN 'open' END AS old_value,
    CASE WHEN event_type = 'purchase' THEN [{', '.join(map(lit, STATUSES))}][event_id % 5 + 1] END AS new_value,
    ts FROM events)"""

UPDATES = f"""upd AS (SELECT l_orderkey::VARCHAR AS finding_id,
    CASE WHEN l_linenumber % 3 = 0 THEN [{', '.join(map(lit, (*STATUSES, 'closed')))}][l_partkey % 6 + 1] END AS status,
    CASE WHEN l_linenumber % 2 = 0 THEN 'part ' || l_partkey END AS notes,
    CASE WHEN l_linenumber = 1 THEN 'sha' || l_suppkey END AS fix_commit_sha,
    CASE WHEN l_linenumber = 4 THEN 'use ' || l_suppkey END AS suggested_fix,
    (l_linenumber::BIGINT * 1000000 + l_partkey) * 100000 + l_suppkey AS ord FROM lineitem),
  each AS (SELECT u.*, f.status AS first_status, coalesce(
      last_value(u.status IGNORE NULLS) OVER (PARTITION BY finding_id ORDER BY ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f.status) AS old
    FROM upd u JOIN findings f ON f.id = u.finding_id
    WHERE u.status IS NULL OR u.status IN {in_list(STATUSES)}),
  lastu AS (SELECT finding_id, bool_or(coalesce(status = 'fixed' AND old <> 'fixed', false)) AS closed, """ + ", ".join(
    f"last({c} ORDER BY ord) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in ("status", "notes", "fix_commit_sha", "suggested_fix")
) + """ FROM each GROUP BY finding_id),
  moved AS (SELECT f.*, u.finding_id AS hit, u.status AS us, u.notes AS un, u.fix_commit_sha AS uc,
      u.suggested_fix AS uf, coalesce(u.closed, false) AS closed
    FROM findings f LEFT JOIN lastu u ON f.id = u.finding_id)"""

MANUAL = """manual AS (SELECT 'manual-' || c_custkey AS id,
    'src/' || c_name || '.py' AS file_path,
    lower(['High', 'LOW', 'urgent', 'critical', 'medium'][c_custkey % 5 + 1]) AS severity,
    upper(['a01', 'A10', 'A11', 'x'][c_custkey % 4 + 1]) AS owasp_category FROM customer)"""
SEV_OK = "severity IN ('low', 'medium', 'high', 'critical')"
CAT_OK = f"owasp_category IN {in_list(CATEGORIES)}"


def setting(name: str) -> str:
    raw = f"nullif(regexp_extract(content, '(?m)^\\s*{name}\\s*=\\s*(.+?)$', 1), '')"
    return STRIP.format(raw)


def is_(name: str, word: str) -> str:
    return f"coalesce(rtrim({setting(name)}, ',') = '{word}', false)"


def shown(name: str) -> str:
    return f"coalesce(nullif({setting(name)}, ''), 'not set')"


def m(pattern: str) -> str:
    return f"regexp_matches(content, {lit(pattern)})"


def has(word: str) -> str:
    return f"contains(content, {lit(word)})"


CONFIG = {
    "django": [
        ("DEBUG", "'True'", "critical", is_("DEBUG", "True")),
        ("SECURE_HSTS_SECONDS", shown("SECURE_HSTS_SECONDS"), "high",
         f"{setting('SECURE_HSTS_SECONDS')} IS NULL OR {is_('SECURE_HSTS_SECONDS', '0')}"),
        *[(n, shown(n), s, f"NOT {is_(n, 'True')}") for n, s in (
            ("SECURE_SSL_REDIRECT", "high"), ("SESSION_COOKIE_SECURE", "high"),
            ("CSRF_COOKIE_SECURE", "medium"), ("SECURE_CONTENT_TYPE_NOSNIFF", "medium"))],
        ("SESSION_COOKIE_HTTPONLY", "'False'", "high", is_("SESSION_COOKIE_HTTPONLY", "False")),
        ("X_FRAME_OPTIONS", "'not set'", "medium", f"{setting('X_FRAME_OPTIONS')} IS NULL"),
        ("ALLOWED_HOSTS", setting("ALLOWED_HOSTS"), "high",
         f"""contains({setting('ALLOWED_HOSTS')}, '''*''') OR contains({setting('ALLOWED_HOSTS')}, '"*"')"""),
        ("SECRET_KEY", "'Hardcoded in source'", "high",
         f"""regexp_matches({setting('SECRET_KEY')}, '^[''"]') AND length({setting('SECRET_KEY')}) > 10
             AND NOT regexp_matches({setting('SECRET_KEY')}, 'os\\.environ|os\\.getenv|config\\(|env\\(')"""),
        ("MIDDLEWARE (CSRF)", "'Not found'", "high",
         f"NOT {has('CsrfViewMiddleware')} AND NOT contains(lower(content), 'csrf')"),
    ],
    "fastapi": [
        ("CORSMiddleware.allow_origins", "'[\"*\"]'", "high",
         m(r"(?s)allow_origins\s*=\s*\[.*?['\"]?\*['\"]?.*?\]")),
        ("CORSMiddleware", lit("allow_credentials=True with allow_origins=['*']"), "critical",
         m(r"allow_credentials\s*=\s*True") + " AND " + m(r"(?s)allow_origins\s*=\s*\[.*?\*.*?\]")),
        ("TrustedHostMiddleware", "'Not found'", "medium",
         f"NOT {has('TrustedHostMiddleware')} AND NOT contains(lower(content), 'trusted_host') "
         f"AND ({has('FastAPI')} OR {has('app = ')})"),
    ],
    "nextjs": [
        ("Security headers", "'No headers configuration found'", "medium",
         f"NOT {has('headers')} OR NOT {has('async headers')}"),
        ("images.remotePatterns", lit("hostname: '**' (wildcard)"), "high",
         m(r"""hostname\s*:\s*['"][*]{2}['"]""")),
        ("rewrites", "'Rewrite to localhost/private IP detected'", "high",
         m(r"(?i)destination\s*:\s*['\"]https?://(?:localhost|127\.0\.0\.1|10\.|192\.168\.)")),
        ("poweredByHeader", "'true or not set'", "low",
         f"NOT {has('poweredByHeader')} OR " + m(r"(?i)poweredByHeader\s*:\s*true")),
        ("reactStrictMode", "'false'", "medium", m(r"(?i)reactStrictMode\s*:\s*false")),
    ],
    "general": [
        ("DEBUG/DEV_MODE", "'True'", "high", m(r"(?i)(?:DEBUG|DEV_MODE|DEVELOPMENT)\s*=\s*True")),
        ("Secret value", "'Hardcoded in source'", "high",
         m(r"""(?i)(?:SECRET|KEY|TOKEN|PASSWORD|PASSWD|API_KEY)\s*=\s*['"][^'"]{8,}['"]""")),
        ("Database connection string", "'Hardcoded in source'", "high",
         m(r"(?i)(?:mysql|postgresql|mongodb|redis)://\S+:\S+@")),
        ("Port mapping", "'May be exposed'", "medium", m(r"""['"]?\d{4,5}:\d{4,5}['"]?""")),
    ],
}
EXPECTED = {
    "DEBUG": "False", "SECURE_HSTS_SECONDS": ">= 31536000 (1 year)", "SECURE_SSL_REDIRECT": "True",
    "SESSION_COOKIE_SECURE": "True", "CSRF_COOKIE_SECURE": "True",
    "SECURE_CONTENT_TYPE_NOSNIFF": "True", "SESSION_COOKIE_HTTPONLY": "True (default)",
    "X_FRAME_OPTIONS": "'DENY' or 'SAMEORIGIN'", "ALLOWED_HOSTS": "Specific hostnames",
    "SECRET_KEY": "Loaded from environment",
    "MIDDLEWARE (CSRF)": "django.middleware.csrf.CsrfViewMiddleware in MIDDLEWARE",
    "CORSMiddleware.allow_origins": "Specific origins",
    "CORSMiddleware": "Credentials not allowed with wildcard origins",
    "TrustedHostMiddleware": "TrustedHostMiddleware configured",
    "Security headers": "headers() function with CSP, HSTS, X-Frame-Options",
    "images.remotePatterns": "Specific hostnames",
    "rewrites": "No direct proxy to internal services", "poweredByHeader": "false",
    "reactStrictMode": "true", "DEBUG/DEV_MODE": "False in production",
    "Secret value": "Loaded from environment or secrets manager",
    "Database connection string": "Loaded from environment or secrets manager",
    "Port mapping": "Bound to 127.0.0.1 or internal network",
}


def config_rows(framework: str, files: str = "files") -> str:
    return "\nUNION ALL ".join(
        f"SELECT path, {lit(s)} AS setting, {actual} AS actual, {lit(sev)} AS severity "
        f"FROM {files} WHERE {test}" for s, actual, sev, test in CONFIG[framework])


SCORES = ", ".join(
    " + ".join(f"contains(content, {lit(w)})::INTEGER" for w in words) + f" AS {name}"
    for name, words in FRAMEWORK_SIGNALS.items())
BEST = "greatest(django, fastapi, flask, mcp, nextjs)"
FRAMEWORK = f"CASE WHEN {BEST} = 0 THEN 'unknown' " + " ".join(
    f"WHEN {n} = {BEST} THEN '{n}'" for n in FRAMEWORK_SIGNALS) + " END"
SCORED = f"scored AS MATERIALIZED (SELECT *, {FRAMEWORK} AS framework FROM (SELECT *, {SCORES} FROM files))"
AUTO = ",\n".join([
    f"by_{fw} AS (SELECT * FROM scored WHERE framework " + (
        f"= '{fw}')" if fw != "general" else "NOT IN ('django', 'fastapi', 'nextjs'))")
    for fw in CONFIG])
CHECKED = (SCORED + ",\n" + AUTO + ",\nchecked AS (SELECT c.*, s.framework FROM ("
           + "\nUNION ALL ".join(config_rows(fw, f"by_{fw}") for fw in CONFIG)
           + ") c JOIN scored s USING (path))")

EXPECT = "(VALUES " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in EXPECTED.items()) + ") AS e(setting, expected)"

HEAD = "list_transform(string_split(substring(content, 1, 500), chr(10))[1:5], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
CLIENT = """['''use client''', '"use client"', '''use client'';', '"use client";']"""
SERVER = CLIENT.replace("client", "server")
IS_CLIENT = f"list_has_any({HEAD}, {CLIENT})"
FIRST_DIRECTIVE = f"list_filter({HEAD}, lambda x: list_contains({CLIENT}, x) OR list_contains({SERVER}, x))[1]"
WEB_ROLE = f"""CASE WHEN starts_with(name, 'next.config') THEN 'config'
  WHEN {STEM} = 'middleware' THEN 'middleware' WHEN {STEM} = 'route' THEN 'route_handler'
  WHEN {STEM} = 'error' THEN 'error_boundary'
  WHEN list_contains({CLIENT}, {FIRST_DIRECTIVE}) THEN 'client_component'
  WHEN list_contains({SERVER}, {FIRST_DIRECTIVE}) THEN 'server_action'
  WHEN {STEM} = 'layout' THEN 'layout' WHEN {STEM} = 'page' THEN 'page'
  WHEN starts_with(rel_path, 'app/') THEN 'server_component' ELSE 'lib' END"""


def head_has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(substring(content, 1, 2000), {lit(w)})" for w in words) + ")"


PYTHON_ROLE = f"""CASE WHEN starts_with(lower(name), 'test_') OR starts_with(lower(name), 'conftest')
    OR contains(lower(path), '/tests/') THEN 'test'
  WHEN lower(name) IN ('settings.py', 'config.py', 'conf.py', '.env') THEN 'settings'
  WHEN lower(name) = 'models.py' OR contains(lower(path), '/models/') THEN 'model'
  WHEN {head_has('@mcp.tool', 'FastMCP')} THEN 'mcp_tool'
  WHEN {head_has('@app.get', '@app.post', 'FastAPI')} THEN 'fastapi_route'
  WHEN {head_has('def ')} AND {head_has('request')} AND (contains(lower(substring(content, 1, 2000)), 'django')
    OR {head_has('@login_required')}) THEN 'django_view'
  WHEN {head_has('@app.route', 'Flask(')} THEN 'flask_route'
  WHEN {head_has('argparse', 'click.command', 'if __name__')} THEN 'cli_script' ELSE 'lib' END"""

TYPES = """types AS (SELECT project, CASE WHEN web AND python THEN 'monorepo' WHEN web THEN 'nextjs'
    WHEN python THEN 'python' WHEN react THEN 'react' ELSE 'unknown' END AS project_type
  FROM (SELECT project,
    bool_or(rel_path IN ('next.config.js', 'next.config.mjs', 'next.config.ts')
      OR (rel_path = 'package.json' AND contains(content, '"next":'))) AS web,
    bool_or(rel_path IN ('pyproject.toml', 'requirements.txt', 'setup.py')) AS python,
    bool_or(rel_path = 'package.json' AND contains(content, '"react":')) AS react
  FROM files GROUP BY project))"""

SERVERS = f"""servers AS MATERIALIZED (SELECT * FROM files WHERE starts_with(rel_path, 'app/')
    AND {SUFFIX} IN ('.tsx', '.ts', '.jsx', '.js') AND name <> 'middleware.ts' AND NOT {IS_CLIENT}
    AND NOT contains(substring(content, 1, 200), '''use client''')
    AND NOT contains(substring(content, 1, 200), '"use client"'))"""
IMPORT = r"""import\s+(?:(\w+)|\{([^}]+)\})\s+from\s+['"](\.[^'"]+)['"]"""
IMPORTS = f"""imported AS (SELECT project, path, ord, component, spec, folder,
    CASE WHEN starts_with(spec, './') THEN folder || '/' || spec[3:]
      WHEN starts_with(spec, '../') THEN regexp_replace(folder, '/[^/]*$', '') || '/' || spec[4:] END AS target
  FROM (SELECT project, path, {FOLDER} AS folder, ord, spec,
      unnest(list_filter(list_concat([d], list_transform(string_split(n, ','),
        lambda x: trim(string_split(trim(x), ' as ')[-1]))), lambda x: regexp_matches(x, '^[A-Z]'))) AS component
    FROM (SELECT project, path, unnest(regexp_extract_all(content, {lit(IMPORT)}, 1)) AS d,
        unnest(regexp_extract_all(content, {lit(IMPORT)}, 2)) AS n,
        unnest(regexp_extract_all(content, {lit(IMPORT)}, 3)) AS spec,
        generate_subscripts(regexp_extract_all(content, {lit(IMPORT)}, 3), 1) AS ord FROM servers))),
  options AS (SELECT DISTINCT target, unnest([target, target || '/index.tsx', target || '.tsx',
      target || '.ts', target || '.jsx', target || '.js']) AS option,
      unnest(range(1, 7)) AS rank FROM imported),
  best AS (SELECT target, arg_min(option, rank) AS client_file,
      arg_min({IS_CLIENT}, rank) AS client FROM options JOIN files ON option = path GROUP BY target),
  resolved AS (SELECT project, path, ord, component, client_file FROM imported LEFT JOIN best USING (target)
    WHERE coalesce(client, true))"""
TAG = r"(?s)<([A-Z]\w*)\s+(.*?)/?>"
SENSITIVE = (
    "(?i)(?:user|session|account|profile|token|auth|credentials|secret|password|email|phone|ssn"
    "|credit.?card|payment|address|dob|date.?of.?birth|salary|medical|health)")
PROP = r"(\w+)\s*=\s*\{([^}]*)\}"
CROSSINGS = f"""tags AS (SELECT project, path, component, body,
    (1 + list_sum(list_transform(pieces[1:k], lambda x: length(x) - length(replace(x, chr(10), '')))))::INTEGER AS line
  FROM (SELECT project, path, unnest(regexp_extract_all(content, {lit(TAG)}, 1)) AS component,
      unnest(regexp_extract_all(content, {lit(TAG)}, 2)) AS body,
      generate_subscripts(regexp_extract_all(content, {lit(TAG)}, 1), 1) AS k,
      string_split(regexp_replace(content, {lit(TAG)}, chr(57344) || '\\0', 'g'), chr(57344)) AS pieces
    FROM servers)),
  crossings AS (SELECT t.project, t.path AS server_file, t.component AS client_component, client_file, line,
      list_transform(regexp_extract_all(body, {lit(PROP)}, 1), lambda x, i:
        {{'name': x, 'value': trim(regexp_extract_all(body, {lit(PROP)}, 2)[i])}}) AS props
    FROM tags t JOIN (SELECT path, component, arg_max(coalesce(client_file, ''), ord) AS client_file
        FROM resolved GROUP BY path, component) r USING (path, component)
    WHERE regexp_matches(body, {lit(PROP)})),
  risky AS (SELECT * REPLACE (nullif(client_file, '') AS client_file),
      list_filter(props, lambda p: regexp_matches(p.name, {lit(SENSITIVE)})
        OR regexp_matches(p.value, {lit(SENSITIVE)})) AS bad FROM crossings)"""
BOUNDARY = base(SERVERS, IMPORTS, CROSSINGS, TYPES)

LINES = f"""ln AS (SELECT path, framework, actions, n::INTEGER AS line, {STRIP.format('l[n]')} AS s FROM (
    SELECT path, framework, l, contains(content, '''use server''') OR contains(content, '"use server"') AS actions,
      unnest(range(1, len(l) + 1)) AS n
    FROM (SELECT *, string_split(content, chr(10)) AS l FROM scored)))"""
ENDPOINTS = {
    "route": (r"^@app\.(get|post|put|delete|patch)\s*\(", ""),
    "mcp_tool": (r"^@mcp\.tool\s*\(", ""),
    "route_handler": (r"^export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)\s*\(", ""),
    "server_action": (r"^export\s+(?:async\s+)?function\s+\w+\s*\(", " AND actions"),
    "handler": (r"^def\s+\w+.*request", ""),
}

DEPS = """vulns AS (SELECT 'proj' || (p_partkey % 200) || '/requirements.txt' AS source_path, p_partkey,
    p_brand, p_size, p_type, id, fixes FROM (
      SELECT *, 'PYSEC-' || (p_partkey % 50) AS id, '2.0, 3.1' AS fixes FROM part
      UNION ALL SELECT *, 'PYSEC-' || (p_partkey % 7 + 100), 'No fix available' FROM part)
  WHERE p_partkey % 100 <> 99)"""

VERDICTS = """verdicts AS (SELECT id AS finding_id,
    CASE WHEN k % 11 = 0 OR k % 4 = 3 THEN 'needs_investigation'
      ELSE ['false_positive', 'true_positive', 'needs_investigation'][k % 3 + 1] END AS verdict,
    CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE WHEN k % 7 = 6 THEN 0.5::DOUBLE ELSE (k % 21) / 20.0::DOUBLE END AS confidence,
    CASE WHEN k % 11 = 0 THEN 'The reviewer gave no assessment.' ELSE 'reason ' || id END AS reasoning
  FROM (SELECT id, id::BIGINT AS k FROM findings WHERE status <> 'fixed'))"""

REVIEWS = f"""reviews AS (SELECT path AS file_path, owasp_category, severity, title, line_number, confidence,
    'llm-' || owasp_category || '-' || slug AS rule_id FROM (
      SELECT doc_id, 'A05' AS owasp_category, 'high' AS severity,
        'Raw  SQL -- built by hand, with a title that is far too long!' AS title,
        (doc_id % 30)::INTEGER AS line_number, 0.75::DOUBLE AS confidence,
        'raw-sql-built-by-hand-with-a-title-that-is-far-too-long'[1:40] AS slug FROM labels WHERE toxic = 1
      UNION ALL SELECT doc_id, 'A10', 'medium', 'Unknown', NULL, 0.5, 'unknown' FROM labels WHERE quality = 0)
    JOIN files USING (doc_id))"""

ROLE_TEXT = "(VALUES " + ", ".join(
    f"('{kind}', {lit(n)}, {lit(la)}, {lit(tr)}, {lit(ri)})"
    for kind, roles in (("web", WEB_ROLES), ("python", PYTHON_ROLES)) for n, la, tr, ri in roles
) + ") AS t(kind, role, label, trust, risk)"

RULE_TABLE = "(VALUES " + ", ".join(
    f"({lit(r.id)}, {lit(g)}, {lit(r.severity)})" for r in ALL_RULES for g in r.globs
) + ") AS r(id, file_glob, severity)"

BULK = f"WITH {LIFECYCLE}"
BULK_SCANS = f"WITH {LIFECYCLE}, {SCANS}"


def gate_sql() -> str:
    levels = ["critical", "high", "medium", "low"]
    return f"{BULK} " + " UNION ALL ".join(
        f"SELECT count(*) FILTER (WHERE severity IN {in_list(levels[:i + 1])}) AS failing, "
        f"count(*) FILTER (WHERE severity IN {in_list(levels[:i + 1])}) = 0 AS passed, "
        f"'{level}' AS level FROM findings WHERE status = 'open'"
        for i, level in enumerate(levels))


EXCLUDE_RULE = next(r for r in ALL_RULES if r.exclude_pattern)

MINUTES = "strftime({0}, '%Y-%m-%d %H:%M UTC')"
RANK = "list_position(['low', 'medium', 'high', 'critical'], severity)"


def texts(section: int, *lines: str) -> str:
    return " UNION ALL ".join(f"SELECT {section} AS section, {lit(t)} AS text" for t in lines)


REPORT = f"""{BULK_SCANS}, top AS (SELECT *, row_number() OVER (ORDER BY {RANK} DESC, found_at DESC, id) AS i
    FROM findings WHERE status = 'open'),
  detail AS (SELECT top.*, label FROM top JOIN {LABELS} USING (owasp_category) WHERE i <= 20),
  triaged AS (SELECT * FROM findings WHERE status IN ('accepted', 'false_positive') AND notes <> '')
  {texts(0, '# Security Scan Report', '', '**Generated:** 2025-06-01 12:00 UTC  ')}
  UNION ALL SELECT 0, '**Scan history:** ' || count(*) || ' scans, first: ' || strftime(min(started_at), '%Y-%m-%d')
    || ', latest: ' || strftime(max(started_at), '%Y-%m-%d') || '  ' FROM scans
  UNION ALL {texts(1, '', '## Executive Summary', '')}
  UNION ALL SELECT 1, '- **Total findings:** ' || count(*) FROM findings
  UNION ALL SELECT 1, '- **Open:** ' || count(*) FROM findings WHERE status = 'open'
  UNION ALL SELECT 1, '- **Fixed:** ' || count(*) FROM findings WHERE status = 'fixed'
  UNION ALL SELECT 1, '- **Accepted/False Positive:** ' || count(*) FROM findings WHERE status IN ('accepted', 'false_positive')
  UNION ALL {texts(2, '', '### Open by Severity', '', '| Severity | Count |', '|---|---|')}
  UNION ALL SELECT 2, '| ' || upper(severity) || ' | ' || count(*) || ' |' FROM top GROUP BY severity
  UNION ALL {texts(3, '', '### Open by Category', '', '| Category | Name | Count |', '|---|---|---|')}
  UNION ALL SELECT 3, '| ' || owasp_category || ' | ' || label || ' | ' || count(*) || ' |'
    FROM top JOIN {LABELS} USING (owasp_category) GROUP BY owasp_category, label
  UNION ALL {texts(4, '', '### Top Files (most open findings)', '', '| File | Findings |', '|---|---|')}
  UNION ALL SELECT 4, '| `' || file_path || '` | ' || n || ' |' FROM (
    SELECT file_path, count(*) AS n FROM top GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
  UNION ALL {texts(5, '', '## Findings Detail', '')}
  UNION ALL SELECT 5, unnest(list_filter([
      '### ' || i || '. [' || upper(severity) || '] ' || title, '',
      '- **Category:** ' || owasp_category || ' — ' || label, '- **File:** `' || file_path || '`',
      '- **Line:** ' || line_number, '- **Found:** ' || {MINUTES.format('found_at')},
      CASE WHEN updated_at <> found_at THEN '- **Last updated:** ' || {MINUTES.format('updated_at')} END,
      '- **Description:** ' || description, '- **Suggested Fix:** ' || suggested_fix,
      chr(10) || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10), ''],
    lambda x: x IS NOT NULL)) FROM detail
  UNION ALL SELECT 6, '*...and ' || (count(*) - 20) || ' more open findings.*' FROM top HAVING count(*) > 20
  UNION ALL {texts(7, '', '## Triaged Findings', '', '*Reviewed, and judged to be acceptable or not to apply.*', '')}
  UNION ALL SELECT 7, unnest(['- **[' || CASE WHEN status = 'accepted' THEN 'Accepted Risk' ELSE 'False Positive' END
      || ']** ' || title || ' (`' || file_path || '`)', '  - *Rationale:* ' || notes,
      '  - *Triaged:* ' || {MINUTES.format('updated_at')}]) FROM triaged
  UNION ALL {texts(8, '', '## Remediation Priority', '', '1. **Critical findings**: fix at once',
    '2. **High findings**: fix before the next release', '3. **Medium findings**: plan for the coming weeks',
    '4. **Low findings**: fix when the code is touched')}"""

ORACLE = {
    "report_lines": REPORT,
    "sarif_documents": f"""{BULK} SELECT '2.1.0' AS version, rule_id,
          CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'low' THEN 'note' ELSE 'warning' END AS level,
          id FROM findings""",
    "file_eligibility": base() + f"""SELECT path, {SKIPPED} AS skipped,
        {SUFFIX} IN {in_list(CODE_EXTENSIONS)} AS known_extension, false AS "binary",
        size > 20480 AS over_20_kb FROM files""",
    "binary_files": """SELECT doc_id, doc_id % 2048 < 1024 AS "binary" FROM documents""",
    "invalid_bytes": """SELECT doc_id, sha256(chr(65533) || text || chr(65533)) AS text_hash FROM documents""",
    "exclude_paths": base() + f"""SELECT path, size FROM files
        WHERE NOT {SKIPPED} AND NOT ({EXCLUDED})""",
    "capped_files": base() + f"""SELECT path, size FROM files WHERE size <= 4096 AND NOT {SKIPPED}""",
    "odd_globs": base() + """, odd("glob", re) AS (VALUES ('foo[bar', '^foo\\[bar$'), ('[z-a].py', NULL), ('[]a]*', '^[\\]a].*$'),
          ('*.[!pt]*', '^.*\\.[^pt].*$'), ('s[', '^s\\[$'), ('*[m-]*s', '^.*[m\\-].*s$'), ('a(b', '^a\\(b$'), ('?o[n-z]*', '^.o[n-z].*$'))
        SELECT path, "glob" FROM files, odd WHERE regexp_matches(rel_path, re) OR regexp_matches(name, re)""",
    "ignore_files": base(IGNORE) + f"SELECT path FROM files f WHERE NOT {IGNORED.format('f')}",
    "changed_files": base(corpus_cte("files2", 2), CHANGES) + "SELECT path, change FROM changes",
    "many_rules": """WITH words AS (
          SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-zà-öø-ÿ]{9,}')) AS word FROM documents),
        lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
          FROM conversations),
        tokens AS (SELECT DISTINCT conv_id, turn, n, unnest(regexp_extract_all(lower(line), '[0-9a-z_ßà-öø-ÿ]+')) AS word FROM lines)
        SELECT 'W-' || word AS rule_id, count(*) AS lines, count(DISTINCT conv_id) AS conversations
        FROM tokens JOIN words USING (word) GROUP BY word""",
    "rejected_rules": """SELECT 'R-' || p_partkey AS id, CASE p_partkey % 6
            WHEN 0 THEN 'pattern: missing ), unterminated subpattern at position 0'
            WHEN 1 THEN 'pattern: bad character range z-a at position 1'
            WHEN 2 THEN 'missing: title' WHEN 3 THEN 'exclude_pattern: nothing to repeat at position 0' END AS reason
        FROM part WHERE p_partkey % 6 < 4""",
    "custom_rules_raw": """WITH l AS (SELECT 'doc' || doc_id || '.txt' AS path, n, l[n] AS line FROM (
          SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
        h AS (SELECT path, 'ORG-001' AS rule_id, n FROM l WHERE regexp_matches(line, '(?i)token = "[0-9a-f]{40}"')
          UNION ALL SELECT path, 'ORG-002', n FROM l WHERE regexp_matches(line, '(?i)[\\pL\\pN_.]+@[\\pL\\pN_.]+\\.[a-z]{2,}')
          UNION ALL SELECT path, 'ORG-003', n FROM l WHERE regexp_matches(line, '(?i)licen[sc]e[sd]? '))
        SELECT path, rule_id, count(*) AS lines, min(n)::INTEGER AS first_line FROM h GROUP BY path, rule_id""",
    "chat_secrets": """SELECT conv_id || '/' || turn AS path, 'A07-003' AS rule_id,
          (2 + length(text) - length(replace(text, chr(10), '')))::INTEGER AS line_number
        FROM conversations WHERE turn % 4 = 1""",
    "recent_errors": """SELECT event_id::VARCHAR AS error_id,
          strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'ValueError' AS error_type,
          user_id::VARCHAR AS "user" FROM events
        WHERE event_type = 'error' AND event_id % 10 <> 0 AND event_id % 3 = 1
        ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 20""",
    "rule_coverage": HITS + f"""SELECT id, file_glob, severity, coalesce(hits, 0) AS hits FROM {RULE_TABLE}
        LEFT JOIN (SELECT rule_id, count(*) AS hits FROM hits WHERE NOT off GROUP BY 1) h ON rule_id = id""",
    "scan_full": HITS + """SELECT path, rule_id, line_number::INTEGER AS line_number, line_content
        FROM hits WHERE NOT off""",
    "scan_by_category": HITS + f"""SELECT owasp_category, severity, count(*) AS count, label
        FROM hits JOIN {LABELS} USING (owasp_category) WHERE NOT off GROUP BY ALL""",
    "scan_one_category": base(hits_cte(rules=[
        r for r in ALL_RULES if r.owasp_category == "A05" and r.severity == "critical"])) +
        "SELECT project, rule_id, count(*) AS hits FROM hits WHERE NOT off GROUP BY ALL",
    "scan_one_severity": HITS + """SELECT rule_id, severity, count(*) AS hits FROM hits
        WHERE NOT off AND severity = 'medium' GROUP BY ALL""",
    "scan_single_file": HITS + f"""SELECT path AS file_path, rule_id, line_number::INTEGER AS line_number, {adjusted()} AS severity
        FROM hits WHERE NOT off AND path = 'p1/app/helper.ts'""",
    "suppressed_hits": HITS + "SELECT path, rule_id, line_number::INTEGER AS line_number FROM hits WHERE off",
    "excluded_hits": base("""l AS (SELECT path, n::INTEGER AS line_number, line, codes FROM (
          SELECT path, n, l[n] AS line, CASE WHEN n > 1 THEN l[n - 1] ELSE '' END || chr(10) || l[n] AS codes
          FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS n
            FROM (SELECT path, string_split(content, chr(10)) AS l FROM files WHERE name GLOB '*.py'))))""") + f"""
        SELECT path, line_number, NOT regexp_matches(line, {lit('(?i)' + EXCLUDE_RULE.exclude_pattern)})
          AND NOT regexp_matches(codes, 'owasp-ignore: A09-003') AS reported
        FROM l WHERE regexp_matches(line, {lit('(?i)' + EXCLUDE_RULE.pattern)})
        UNION ALL
        SELECT path, line_number, true FROM l WHERE line = 'logging.info('""",
    "snippets": HITS + f"""SELECT path, rule_id, line_number::INTEGER AS line_number,
          sha256({snippet()}) AS snippet_hash, length({snippet()})::INTEGER AS snippet_length
        FROM hits WHERE NOT off""",
    "severity_adjusted": HITS + f"""SELECT path, rule_id, line_number::INTEGER AS line_number,
          {adjusted(surface='surface')} AS severity
        FROM hits JOIN ({SURFACE}) USING (project) WHERE NOT off""",
    "fingerprints": HITS + f"""SELECT path AS file_path, rule_id, line_number::INTEGER AS line_number,
          {FINGERPRINT} AS fingerprint FROM hits WHERE NOT off""",
    "directory_scan": base(hits_cte(), IGNORE) + f"""
        SELECT path AS file_path, {adjusted(surface='surface')} AS severity, count(*) AS count
        FROM hits JOIN ({SURFACE}) USING (project) JOIN (SELECT path, name, size FROM files) USING (path)
        WHERE NOT off AND NOT {SKIPPED} AND NOT contains('/' || rel_path, '/docs/')
          AND NOT {IGNORED.format('hits')} GROUP BY ALL""",
    "incremental_scan": HITS2.rstrip() + ",\n" + CHANGES + ",\n" + IGNORE.replace("FROM files ", "FROM files2 ") + f"""
        SELECT path AS file_path, rule_id, line_number::INTEGER AS line_number,
          {adjusted(surface='surface')} AS severity
        FROM hits2 JOIN ({SURFACE.replace('FROM files', 'FROM files2')}) USING (project)
        JOIN (SELECT path, size FROM files2) USING (path) JOIN changes USING (path)
        WHERE change <> 'deleted' AND NOT off AND NOT {SKIPPED}
          AND NOT {IGNORED.format('hits2')}""",
    "upsert_findings": LIFE + f"""SELECT coalesce(s.id, c.fp) AS id,
          CASE WHEN c.fp IS NULL THEN 'scan-1' WHEN s.id IS NULL OR s.status IN ('open', 'in_progress')
            THEN 'scan-2' ELSE 'scan-1' END AS scan_id,
          coalesce(s.path, c.path) AS file_path, coalesce(s.line_number, c.line_number)::INTEGER AS line_number,
          coalesce(s.rule_id, c.rule_id) AS rule_id, coalesce(s.status, 'open') AS status,
          CASE WHEN s.id IS NULL THEN '{SECOND}' ELSE '{FIRST}' END AS found_at,
          CASE WHEN c.fp IS NOT NULL AND (s.id IS NULL OR s.status IN ('open', 'in_progress'))
            THEN '{SECOND}' ELSE '{FIRST}' END AS updated_at,
          CASE WHEN c.fp IS NOT NULL AND (s.id IS NULL OR s.status IN ('open', 'in_progress'))
            THEN c.snip ELSE s.snip END AS snippet_hash
        FROM stored s FULL JOIN cand c ON s.id = c.fp""",
    "upsert_audit": LIFE + f"""SELECT fp AS finding_id, 'created' AS action, NULL::VARCHAR AS old_value,
          sev || ': ' || title AS new_value, '{SECOND}' AS timestamp
        FROM cand WHERE fp NOT IN (SELECT id FROM stored)""",
    "snapshot_merge": LIFE + f"""SELECT coalesce(s.id, c.fp) AS id, CASE WHEN c.fp IS NULL THEN 'scan-1' ELSE 'scan-2' END AS scan_id,
          coalesce(s.path, c.path) AS file_path, coalesce(s.line_number, c.line_number)::INTEGER AS line_number,
          coalesce(s.rule_id, c.rule_id) AS rule_id, 'open' AS status,
          CASE WHEN s.id IS NULL THEN '{SECOND}' ELSE '{FIRST}' END AS found_at,
          CASE WHEN c.fp IS NULL THEN '{FIRST}' ELSE '{SECOND}' END AS updated_at, coalesce(c.snip, s.snip) AS snippet_hash
        FROM stored s FULL JOIN cand c ON s.id = c.fp""",
    "snapshot_audit": LIFE + f"""SELECT * FROM (
          SELECT id AS finding_id, 'created' AS action, NULL::VARCHAR AS old_value, sev || ': ' || title AS new_value, '{FIRST}' AS timestamp,
            line_number FROM stored
          UNION ALL SELECT fp, 'created', NULL, sev || ': ' || title, '{SECOND}', line_number FROM cand WHERE fp NOT IN (SELECT id FROM stored)
          UNION ALL SELECT f.id, 'status_changed', a, b, '{SECOND}', line_number
            FROM (SELECT id, line_number FROM stored UNION SELECT fp, line_number FROM cand) f, (VALUES ('open', 'fixed'), ('fixed', 'open')) m(a, b)
            WHERE line_number % 3 = 0) WHERE line_number % 6 <> 3""".replace("SELECT * FROM (", "SELECT finding_id, action, old_value, new_value, timestamp FROM ("),
    "new_vs_existing": LIFE + """SELECT fp AS fingerprint, s.id IS NULL AS is_new,
          coalesce(s.status = 'fixed', false) AS reappeared FROM cand LEFT JOIN stored s ON s.id = fp""",
    "scan_counts": LIFE + """SELECT count(*) AS total, count(*) FILTER (WHERE s.id IS NULL) AS new_count,
          count(s.id) AS existing_count FROM cand LEFT JOIN stored s ON s.id = fp""",
    "scan_response": LIFE + f"""SELECT 'total_findings' AS section, 'all' AS key, NULL::VARCHAR AS label, count(*) AS count FROM cand
        UNION ALL SELECT 'new_findings', 'all', NULL, count(*) FROM cand WHERE fp NOT IN (SELECT id FROM stored)
        UNION ALL SELECT 'existing_findings', 'all', NULL, count(*) FROM cand WHERE fp IN (SELECT id FROM stored)
        UNION ALL SELECT 'by_category', owasp_category, label, count(*) FROM cand JOIN {LABELS} USING (owasp_category) GROUP BY owasp_category, label
        UNION ALL SELECT 'by_severity', sev, NULL, count(*) FROM cand GROUP BY sev""",
    "audit_trail": f"""WITH {AUDIT} SELECT finding_id, row_number() OVER (PARTITION BY finding_id ORDER BY ts, id) AS nth, id, action
        FROM audit""",
    "baseline_diff": LIFE + """SELECT path AS file_path, rule_id, line_number::INTEGER AS line_number
        FROM cand WHERE fp NOT IN (SELECT id FROM stored WHERE status = 'open')""",
    "apply_updates": f"""{BULK}, {UPDATES} SELECT id,
          coalesce(us, status) AS status, coalesce(un, notes) AS notes,
          coalesce(uc, fix_commit_sha) AS fix_commit_sha, coalesce(uf, suggested_fix) AS suggested_fix,
          CASE WHEN hit IS NOT NULL THEN '{SECOND}' ELSE {SECONDS.format('updated_at')} END AS updated_at,
          CASE WHEN closed THEN '{SECOND}' ELSE {SECONDS.format('fixed_at')} END AS fixed_at
        FROM moved""",
    "update_audit": f"""{BULK}, {UPDATES}
        SELECT finding_id, 'status_changed' AS action, old AS old_value, status AS new_value FROM each WHERE status <> old
        UNION ALL SELECT finding_id, 'note_added', NULL, notes FROM each WHERE notes IS NOT NULL
        UNION ALL SELECT finding_id, 'fix_suggested', NULL, suggested_fix FROM each WHERE suggested_fix IS NOT NULL""",
    "rejected_updates": f"""{BULK}, {UPDATES} SELECT status, count(*) AS count FROM upd
        WHERE status NOT IN {in_list(STATUSES)} GROUP BY status""",
    "delete_findings": f"""{BULK}, {AUDIT}, gone AS (SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_acctbal < 0)
        SELECT id, 'finding' AS kind FROM findings WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT id, 'audit' FROM audit WHERE finding_id NOT IN (SELECT id FROM gone)""",
    "manual_findings": f"""{BULK}, {MANUAL} SELECT status, owasp_category, severity, count(*) AS count,
          count(fingerprint) AS keyed FROM (
            SELECT status, owasp_category, severity, fingerprint FROM findings
            UNION ALL SELECT 'open', owasp_category, severity, NULL FROM manual WHERE {SEV_OK} AND {CAT_OK})
        GROUP BY ALL""",
    "rejected_manual": f"""WITH {MANUAL} SELECT id, CASE WHEN NOT {SEV_OK} THEN 'severity' ELSE 'category' END
          AS reject_reason FROM manual WHERE NOT ({SEV_OK} AND {CAT_OK})""",
    "verify_fixes": LIFE.rstrip() + ",\n" + CHECKED + f""",
        rows AS (SELECT id, path, CASE WHEN line_number % 9 <> 0 THEN rule_id END AS rule_id, line_number, status
          FROM stored UNION ALL
          SELECT DISTINCT {PRINT.format('path', 'NULL', "'config-' || setting")}, path, 'config-' || setting, NULL, 'open' FROM checked)
        SELECT id, CASE WHEN rule_id IS NULL THEN 'no_rule' WHEN status = 'fixed' THEN 'already_resolved'
            WHEN rule_id NOT IN {in_list(r.id for r in ALL_RULES)} THEN 'unknown_rule'
            WHEN path NOT IN (SELECT path FROM files2) THEN 'file_missing'
            WHEN near IS NULL THEN 'verified_fixed' ELSE 'still_present' END AS outcome,
          CASE WHEN status <> 'fixed' THEN near END AS near
        FROM rows r LEFT JOIN (SELECT r2.id AS rid, string_agg(c.line_number::VARCHAR, ',' ORDER BY c.line_number) AS near
            FROM rows r2 JOIN cand c ON c.path = r2.path AND c.rule_id = r2.rule_id
              AND abs(c.line_number - coalesce(r2.line_number, 0)) <= 5 GROUP BY 1) ON rid = id""",
    "complete_scans": f"""{BULK_SCANS} SELECT id, 'completed' AS status, findings_count,
        '{SECOND}' AS completed_at FROM scans""",
    "summary": f"""{BULK_SCANS}
        SELECT 'total_findings' AS section, 'all' AS key, count(*) AS count FROM findings
        UNION ALL SELECT 'by_status', status, count(*) FROM findings GROUP BY status
        UNION ALL SELECT 'open_by_category', owasp_category, count(*) FROM findings WHERE status = 'open' GROUP BY 2
        UNION ALL SELECT 'open_by_severity', severity, count(*) FROM findings WHERE status = 'open' GROUP BY 2
        UNION ALL SELECT 'total_scans', 'all', count(*) FROM scans
        UNION ALL (SELECT 'recent_scans', id, findings_count FROM scans ORDER BY started_at DESC, id LIMIT 5)""",
    "trends_daily": f"""{BULK}, moves AS (
          SELECT found_at::DATE AS day, 1 AS opened, 0 AS fixed FROM findings WHERE found_at >= TIMESTAMP '{SINCE}'
          UNION ALL SELECT fixed_at::DATE, 0, 1 FROM findings WHERE fixed_at >= TIMESTAMP '{SINCE}')
        SELECT day::VARCHAR AS day, sum(opened)::BIGINT AS opened, sum(fixed)::BIGINT AS fixed FROM moves GROUP BY 1""",
    "trend_totals": f"""{BULK} SELECT count(*) FILTER (WHERE found_at >= TIMESTAMP '{SINCE}') AS opened_in_period,
          count(*) FILTER (WHERE fixed_at >= TIMESTAMP '{SINCE}') AS fixed_in_period,
          count(*) FILTER (WHERE status = 'open') AS currently_open,
          round(avg((epoch_us(fixed_at) - epoch_us(found_at)) / 3.6e9), 1) AS mttr_hours FROM findings""",
    "open_running": f"""{BULK}, moves AS (SELECT found_at::DATE AS day, 1 AS n FROM findings
          UNION ALL SELECT fixed_at::DATE, -1 FROM findings WHERE fixed_at IS NOT NULL)
        SELECT day::VARCHAR AS day, (sum(sum(n)) OVER (ORDER BY day))::BIGINT AS open_total FROM moves GROUP BY day""",
    "open_by_category": f"""{BULK} SELECT owasp_category, count(*) AS count FROM findings
        WHERE status = 'open' GROUP BY 1""",
    "open_by_severity": f"""{BULK} SELECT severity, count(*) AS count FROM findings
        WHERE status = 'open' GROUP BY 1""",
    "findings_by_status": f"{BULK} SELECT status, count(*) AS count FROM findings GROUP BY 1",
    "top_files": f"""{BULK} SELECT file_path, count(*) AS count FROM findings WHERE status = 'open'
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "severity_gate": gate_sql(),
    "report_header": f"""{BULK} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open,
          count(*) FILTER (WHERE status = 'fixed') AS fixed,
          count(*) FILTER (WHERE status IN ('accepted', 'false_positive')) AS accepted_or_false_positive
        FROM findings""",
    "scan_history_range": f"""{BULK_SCANS} SELECT count(*) AS scans, strftime(min(started_at), '%Y-%m-%d') AS first,
          strftime(max(started_at), '%Y-%m-%d') AS latest FROM scans""",
    "scan_history": f"""{BULK_SCANS} SELECT id, {SECONDS.format('started_at')} AS started_at, findings_count
        FROM scans ORDER BY scans.started_at DESC, id LIMIT 20""",
    "list_findings": f"""{BULK} SELECT id, file_path, {SECONDS.format('found_at')} AS found_at FROM findings
        WHERE status = 'open' AND severity = 'high' AND file_path ILIKE '%SRC/m1_%'
        ORDER BY findings.found_at DESC, id LIMIT 50""",
    "compact_findings": f"""{BULK} SELECT 16::INTEGER AS columns, id, title FROM findings""",
    "findings_with_audit": f"""{BULK}, {AUDIT} SELECT f.id, label AS owasp_label, a.id AS entry_id, action, new_value,
          {MICROS.format('ts')} AS entry_at FROM findings f JOIN {LABELS} USING (owasp_category)
        LEFT JOIN audit a ON a.finding_id = f.id""",
    "status_history": f"""WITH {AUDIT} SELECT finding_id,
          CASE WHEN action = 'created' THEN 'open' ELSE new_value END AS status,
          {MICROS.format('ts')} AS since,
          {MICROS.format('lead(ts) OVER (PARTITION BY finding_id ORDER BY ts, id)')} AS until
        FROM audit WHERE action IN ('created', 'status_changed')""",
    "token_usage": """SELECT lang AS model, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens,
          round((sum(i) * 0.1::DOUBLE + sum(o) * 0.4::DOUBLE) / 1000000, 6) AS estimated_cost_usd
        FROM (SELECT lang, n_chars // 4 AS i, doc_id % 200 AS o FROM documents) GROUP BY lang""",
    **{f"config_{fw}": base() + config_rows(fw) for fw in CONFIG},
    "framework_detect": base(SCORED) + "SELECT path, framework, django, fastapi, flask, mcp, nextjs FROM scored",
    "config_findings": base(CHECKED) + f"""SELECT path AS file_path, 'config-' || setting AS rule_id,
          {PRINT.format('path', 'NULL', "'config-' || setting")} AS fingerprint, severity,
          'Set ' || setting || ' = ' || expected AS suggested_fix
        FROM checked JOIN {EXPECT} USING (setting)""",
    "config_counts": base(CHECKED) + """SELECT framework, setting, severity, count(*) AS count
        FROM checked GROUP BY ALL""",
    "file_roles_web": base() + f"SELECT path, {WEB_ROLE} AS role FROM files",
    "file_roles_python": base() + f"SELECT path, {PYTHON_ROLE} AS role FROM files",
    "project_types": base(TYPES) + "SELECT project, project_type FROM types",
    "network_surfaces": base() + SURFACE,
    "endpoints": base(SCORED, LINES) + " UNION ALL ".join(
        f"SELECT path, line, '{kind}' AS type, s AS detail FROM ln WHERE regexp_matches(s, {lit(p)}){more}"
        for kind, (p, more) in ENDPOINTS.items()),
    "file_outline": base(SCORED, LINES) + """SELECT path, framework, count(*)::INTEGER AS line_count,
          coalesce(string_agg(s, '|' ORDER BY line) FILTER (WHERE starts_with(s, 'import ') OR starts_with(s, 'from ')), '') AS imports,
          coalesce(string_agg(line || ':' || s, '|' ORDER BY line) FILTER (WHERE starts_with(s, '@')), '') AS decorators
        FROM ln GROUP BY path, framework""",
    "checklist": base(SCORED) + f"""SELECT path, framework, position, "check" FROM scored JOIN (VALUES """ + ", ".join(
        f"({lit(fw)}, {i}, {lit(check)})" for i, (fw, check, _, _) in enumerate(_CHECKLIST, start=1)) +
        """) AS c(fw, position, "check") ON fw = '' OR fw = framework""",
    "boundary_imports": BOUNDARY + "SELECT path, component, client_file FROM resolved",
    "boundary_crossings": BOUNDARY + """SELECT server_file, client_component, client_file, line,
          CASE WHEN len(bad) > 0 THEN 'high' ELSE 'medium' END AS risk_level,
          array_to_string(list_transform(props, lambda p: p.name || '=' || p.value), ';') AS props FROM risky""",
    "boundary_one_file": base("servers AS MATERIALIZED (SELECT * FROM files WHERE path = 'p0/app/layout.tsx')", IMPORTS, CROSSINGS) +
        "SELECT server_file, client_component, client_file, line FROM risky",
    "boundary_summary": BOUNDARY + """SELECT count(*) AS total_crossings,
          count(*) FILTER (WHERE len(bad) > 0) AS high_risk, count(*) FILTER (WHERE len(bad) = 0) AS medium_risk
        FROM risky JOIN types USING (project) WHERE project_type IN ('nextjs', 'monorepo')""",
    "sensitive_props": BOUNDARY + """SELECT server_file, client_component, b.name AS prop, b.value AS value, line
        FROM (SELECT server_file, client_component, line, unnest(bad) AS b FROM risky)""",
    "dependency_findings": f"""WITH {DEPS} SELECT source_path AS file_path, 'pip-audit-' || id AS rule_id,
          p_brand || ' 1.' || p_size || ': ' || id AS title, p_type AS description,
          'Upgrade ' || p_brand || ' to ' || fixes AS suggested_fix,
          {PRINT.format('source_path', 'NULL', "'pip-audit-' || id")} AS fingerprint FROM vulns""",
    "dependency_merge": f"""WITH {DEPS} SELECT {PRINT.format('source_path', 'NULL', "'pip-audit-' || id")} AS fingerprint,
          count(*) AS copies, true AS is_new FROM vulns GROUP BY 1""",
    "vulnerability_counts": f"""WITH {DEPS} SELECT source_path, count(*) AS vulnerabilities,
          count(*) FILTER (WHERE fixes <> 'No fix available') AS fixable FROM vulns GROUP BY 1""",
    "dependency_sources": base() + f"""SELECT project, arg_min(path, rank) AS source_path,
          arg_min(kind, rank) AS source_type FROM files JOIN (VALUES """ + ", ".join(
        f"({i}, {lit(n)}, {lit(k)})" for i, (n, k) in enumerate(DEPENDENCY_FILES.items())) +
        ") AS d(rank, rel, kind) ON rel = rel_path GROUP BY project",
    "triage_requests": HITS + f"""SELECT {FINGERPRINT} AS finding_id, sha256('Triage this security finding:\n\nFinding ID: '
          || {FINGERPRINT} || '\nTitle: ' || title || '\nDescription: ' || description || '\nFile: ' || path || ':'
          || line_number || '\nCode context:\n```\n' || {snippet(9, 10)} || '\n```\n') AS prompt_hash
        FROM hits WHERE NOT off""",
    "triage_of_stored": LIFE + f"""SELECT s.id, CASE WHEN f.path IS NULL THEN s.snip ELSE
          sha256({snippet(9, 10, 'f.l', 's.line_number')}) END AS context_hash
        FROM stored s LEFT JOIN files2_l f ON f.path = s.path""",
    "triage_verdicts": f"""{BULK}, {VERDICTS} SELECT f.id AS finding_id,
          coalesce(verdict, 'needs_investigation') AS verdict, coalesce(v.confidence, 0.0) AS confidence,
          coalesce(reasoning, 'The reviewer gave no assessment.') AS reasoning
        FROM findings f LEFT JOIN verdicts v ON v.finding_id = f.id""",
    "triage_apply": f"""{BULK}, {VERDICTS} SELECT f.id,
          CASE WHEN v.finding_id IS NOT NULL THEN 'false_positive' ELSE status END AS status,
          CASE WHEN v.finding_id IS NOT NULL THEN 'LLM triage (' || round(v.confidence * 100)::INTEGER || '%): ' || reasoning
            ELSE notes END AS notes
        FROM findings f LEFT JOIN (SELECT * FROM verdicts WHERE verdict = 'false_positive' AND confidence > 0.8) v
          ON v.finding_id = f.id""",
    "review_findings": base(REVIEWS) + f"""SELECT file_path, rule_id, line_number,
          {adjusted(path='file_path')} AS severity, title, confidence,
          {PRINT.format('file_path', 'line_number', 'rule_id')} AS fingerprint FROM reviews""",
    "review_requests": base(TYPES) + f"""SELECT path, t.role, sha256('File: ' || path || '\nType: ' || label || '\nTrust: '
          || trust || '\nRisk: ' || risk || '\n\n```\n' || content || '\n```') AS prompt_hash
        FROM (SELECT *, CASE WHEN project_type IN ('nextjs', 'react') THEN 'web' ELSE 'python' END AS k,
            CASE WHEN project_type IN ('nextjs', 'react') THEN {WEB_ROLE} ELSE {PYTHON_ROLE} END AS role
          FROM files JOIN types USING (project)
          WHERE {SUFFIX} = '.py' OR (project_type IN ('nextjs', 'react') AND {SUFFIX} IN ('.ts', '.tsx', '.js', '.jsx'))) f
        JOIN {ROLE_TEXT} ON t.kind = f.k AND t.role = f.role""",
    "review_windows": base() + """, counted AS (SELECT path, content, length(content) AS size,
          CASE WHEN length(content) <= 1000 THEN 1 ELSE ceil(length(content) / 500.0)::INTEGER END AS parts FROM files),
        cut AS (SELECT *, list_transform(range(0, parts + 1), lambda k: CASE WHEN k = 0 THEN 0 WHEN k = parts THEN size ELSE
            k * 500 - coalesce(nullif(strpos(reverse(substr(content, (k - 1) * 500 + 1, 500)), chr(10)), 0), 1) + 1 END) AS cuts
          FROM counted),
        piece AS (SELECT path, parts, k AS part, substr(content, cuts[k + 1] + 1, cuts[k + 2] - cuts[k + 1]) AS t,
            substr(content, 1, cuts[k + 1]) AS before FROM cut, unnest(range(0, parts)) AS u(k))
        SELECT path, part::INTEGER AS part, parts, (1 + len(before) - len(replace(before, chr(10), '')))::INTEGER AS first_line,
          (1 + len(before) - len(replace(before, chr(10), '')) + len(t) - len(replace(t, chr(10), ''))
           - ends_with(t, chr(10))::INTEGER)::INTEGER AS last_line, sha256(t) AS window_hash FROM piece""",
    "context_anchors": base() + f"""SELECT DISTINCT {FOLDER} AS folder, project AS anchor FROM files
        WHERE project IN (SELECT project FROM files WHERE rel_path = '.owasp-context.md')""",
    "files_with_context": base() + """SELECT f.path, sha256(CASE WHEN strlen(c.content) > 20000
          THEN substring(c.content, 1, 20000) || '\n\n[context cut at the size cap]' ELSE c.content END) AS context_hash
        FROM files f LEFT JOIN (SELECT project, content FROM files WHERE rel_path = '.owasp-context.md') c USING (project)""",
    "all_finding_kinds": base(hits_cte(), CHECKED, DEPS, REVIEWS, MANUAL) + f"""
        SELECT kind, owasp_category, severity, count(*) AS count, count(*) FILTER (WHERE keyed) AS keyed FROM (
          SELECT 'rule' AS kind, owasp_category, {adjusted()} AS severity, true AS keyed FROM hits WHERE NOT off
          UNION ALL SELECT 'config', 'A02', severity, true FROM checked
          UNION ALL SELECT 'dependency', 'A03', 'high', true FROM vulns
          UNION ALL SELECT 'review', owasp_category, {adjusted(path='file_path')}, true FROM reviews
          UNION ALL SELECT 'manual', owasp_category, severity, false FROM manual WHERE {SEV_OK} AND {CAT_OK})
        GROUP BY ALL""",
    "sarif_results": f"""{BULK} SELECT id, rule_id,
          CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'low' THEN 'note' ELSE 'warning' END AS level,
          description AS message, file_path AS uri, line_number::VARCHAR AS start_line, label, suggested_fix AS fix
        FROM findings JOIN {LABELS} USING (owasp_category)""",
    "sarif_rules": base(CHECKED) + f"""SELECT DISTINCT id AS rule_id,
          'https://owasp.org/Top10/' || regexp_extract(id, 'A\\d\\d') || '_2025/' AS help FROM {RULE_TABLE}
        UNION ALL SELECT DISTINCT 'config-' || setting, NULL FROM checked
        UNION ALL SELECT DISTINCT 'A' || lpad((o_orderkey % 10 + 1)::VARCHAR, 2, '0') || '-001', NULL FROM orders
          WHERE 'A' || lpad((o_orderkey % 10 + 1)::VARCHAR, 2, '0') || '-001' NOT IN {in_list(r.id for r in ALL_RULES)}""",
    "stream_scan": HITS + """SELECT path AS file_path, rule_id, line_number::INTEGER AS line_number
        FROM hits WHERE NOT off AND NOT starts_with(project, 'site')""",
    "stream_merge": HITS + """SELECT path AS file_path, rule_id, line_number::INTEGER AS line_number, 'live' AS scan_id, 1::BIGINT AS logged
        FROM hits WHERE NOT off AND NOT starts_with(project, 'site')""",
    "stream_dedup": HITS + """SELECT path AS file_path, rule_id, line_number::INTEGER AS line_number
        FROM hits WHERE NOT off AND NOT starts_with(project, 'site')""",
    "stream_counts": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
          event_type AS severity, count(*) AS count FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
        GROUP BY ALL""",
}
