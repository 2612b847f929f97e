"""Building blocks of the oracle SQL: the corpus, and the hits of the rules on it.

The SQL engine's regexes know no lookarounds. Rules that use them get an equivalent below; the
reasoning stands next to each.
"""

from __future__ import annotations

from vetgrid.rules.catalog import ALL_RULES, CATEGORIES, Rule
from workload.profiles import NETWORK_HEADS, PROFILES

K = len(PROFILES)


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def profile_cte() -> str:
    rows = ",\n".join(
        f"({i}, {lit(p)}, {lit(h)}, {lit(t)})" for i, (p, h, t) in enumerate(PROFILES))
    return f"prof(idx, rel0, head0, tail0) AS (VALUES {rows})"


def corpus_cte(name: str = "files", version: int = 1, pages: bool = True) -> str:
    """``name(project, path, rel_path, name, content, size, doc_id)``; needs ``profile_cte``."""
    head = "head1"
    tail = "tail0"
    where = ""
    if version == 2:
        head = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '# moved\n# down\n' || head1 ELSE head1 END"
        tail = "CASE WHEN doc_id % 5 = 0 THEN '' ELSE tail0 END"
        where = "WHERE doc_id % 11 <> 3"
    page = "" if not pages else """
      UNION ALL
      SELECT 'site' || (page_id // 50), 'site' || (page_id // 50) || '/pages/' || page_id || '.html',
             'pages/' || page_id || '.html', -page_id - 1,
             html || CASE WHEN page_id % 3 = 0
               THEN '\n<script src="https://cdn.example.net/w.js"></script>' ELSE '' END
      FROM pages"""
    return f"""{name} AS MATERIALIZED (
      SELECT *, regexp_extract(rel_path, '[^/]*$') AS name, strlen(content) AS size FROM (
      SELECT project, project || '/' || rel_path AS path, rel_path, doc_id,
        CASE WHEN rel_path = 'package.json' THEN
            '{{"name":"demo","version":"' || n_chars || CASE WHEN num % 4 = 0
              THEN '","dependencies":{{"next":"14.0"}},"devDependencies":{{"x":"1"}}}}'
              ELSE '","dependencies":{{"left":"1"}},"devDependencies":{{"react":"18"}}}}' END
          WHEN rel_path = 'data/blob.bin' THEN chr(1) || ({head}) || '\n' || text || '\n' || ({tail})
          ELSE ({head}) || '\n' || text || '\n' || ({tail}) END AS content
      FROM (SELECT *, CASE WHEN num % 2 = 1 AND rel_path IN {in_list(NETWORK_HEADS)} THEN ''
              ELSE head0 END AS head1
        FROM (SELECT doc_id, text, n_chars, doc_id // {K} AS num, 'p' || (doc_id // {K}) AS project,
                head0, tail0,
                CASE WHEN (doc_id // {K}) % 4 IN (1, 3) AND rel0 = 'next.config.js' THEN 'conf/' || rel0
                     WHEN (doc_id // {K}) % 4 IN (2, 3) AND rel0 IN ('pyproject.toml', 'requirements.txt')
                     THEN 'py/' || rel0 ELSE rel0 END AS rel_path
              FROM documents JOIN prof ON prof.idx = documents.doc_id % {K}))
      {where}{page}))"""


# Equivalent patterns without lookarounds.
RE2 = {
    # The class cannot match the word the lookahead forbids at the place where it is tried.
    "A07-002": r"jwt\.decode\s*\(",
    # The lookbehind follows a closing bracket, so it never sees the word.
    "A10-004": r"requests\.(?:get|post|put|patch|delete|head|options)\s*\([^)]*\)",
    # What the lookaheads forbid cannot follow there anyway.
    "A03-001": r"pip\s+install\s+[a-zA-Z][\w-]*(?:\s|$)",
    "JS-A01-004": r"redirect\s*\(\s*\w",
    "JS-A05-005": r"\$queryRaw\s*\(\s*['\"]",
    "JS-A05-008": r"router\.(?:push|replace)\s*\(\s*\w",
    # With a blank after the bracket the lookahead can be passed by giving the blank back.
    "JS-A01-005": r"revalidate(?:Path|Tag)\s*\((?:\s[^)]*|[^)\s'\"][^)]*|['\"]\s*(?:[^\s/\w)][^)]*)?)\)",
}

# Rules as "the line matches P and not Q"; on the corpus P lies within one line and occurs once
# in it. The first entry looks at the next line instead.
LINE_PAIRS = {
    "A02-007": (r"lxml\.etree\.(?:parse|fromstring|XML|HTML)\s*\([^)]*\)",
                r"lxml\.etree\.(?:parse|fromstring|XML|HTML)\s*\([^)]*\).*resolve_entities\s*=\s*False"),
    "A05-005": (r"yaml\.load\s*\([^)]*\)",
                r"yaml\.load\s*\([^)]*\).*(?:Loader\s*=\s*(?:yaml\.)?SafeLoader|safe_load)"),
    "A08-001": (r"<script\s+src=['\"]https?://[^'\"]+['\"]",
                r"<script\s+src=['\"]https?://[^'\"]+['\"][^>]*integrity="),
    "JS-A06-001": (r"matcher\s*[=:]\s*\[", r"matcher\s*[=:]\s*\[[^\]]*/api"),
}
LOGIN = ("A01-001", r"@login_required\s*$", r"@(?:permission_required|staff_member_required|user_passes_test)")


def hits_cte(name: str = "hits", files: str = "files", rules: list[Rule] = ALL_RULES) -> str:
    """``name(project, path, rel_path, rule_id, line_number, line_content, line, above, off)``.

    ``off`` tells whether a comment switches the rule off on that line.
    """
    parts = []
    for r in rules:
        flags = f"(?{r.flags})" if r.flags else ""
        globs = " OR ".join(f"name GLOB {lit(g)}" for g in r.globs)
        mark = "l"
        if r.id in LINE_PAIRS:
            yes, no = LINE_PAIRS[r.id]
            test = (f"regexp_matches(l[n], {lit(flags + yes)}) "
                    f"AND NOT regexp_matches(l[n], {lit(flags + no)})")
            shown = "l[n]"
        elif r.id == LOGIN[0]:
            test = (f"n < len(l) AND regexp_matches(l[n], {lit(flags + LOGIN[1])}) "
                    f"AND NOT regexp_matches(l[n + 1], {lit(flags + LOGIN[2])})")
            shown = "l[n]"
        else:
            pattern = lit(flags + RE2.get(r.id, r.pattern))
            mark = (f"string_split(regexp_replace(content, {pattern}, "
                    "chr(57344) || '\\0' || chr(57345), 'g'), chr(10))")
            test = f"(regexp_matches(l[n], {pattern}) OR contains(m[n], chr(57344)))"
            shown = (f"CASE WHEN regexp_matches(l[n], {pattern}) THEN l[n] ELSE "
                     "regexp_extract(m[n], chr(57344) || '([^' || chr(57345) || ']*)', 1) END")
        if r.exclude_pattern:
            test += f" AND NOT regexp_matches(l[n], {lit(flags + r.exclude_pattern)})"
        parts.append(
            f"SELECT project, path, rel_path, {lit(r.id)} AS rule_id, n AS line_number, "
            f"{shown} AS line_content, l[n] AS line, CASE WHEN n > 1 THEN l[n - 1] END AS above, l "
            f"FROM (SELECT project, path, rel_path, l, {mark} AS m, "
            f"unnest(range(1, len(l) + 1)) AS n FROM {files}_l WHERE {globs}) WHERE {test}")
    body = "\nUNION ALL ".join(parts)
    meta = ", ".join(
        f"({lit(r.id)}, {lit(r.owasp_category)}, {lit(r.severity)}, {lit(r.title)}, "
        f"{lit(r.description)}, {lit(r.suggested_fix)})" for r in rules)
    return f"""{files}_l AS MATERIALIZED (SELECT *, string_split(content, chr(10)) AS l FROM {files}),
    {name}_meta(rule_id, owasp_category, severity, title, description, suggested_fix) AS (VALUES {meta}),
    {name} AS MATERIALIZED (
      SELECT h.*, owasp_category, severity, title, description, suggested_fix,
        list_has_any([rule_id, owasp_category], list_concat(
          {codes('line')}, {codes("coalesce(above, '')")})) AS off
      FROM ({body}) h JOIN {name}_meta USING (rule_id))"""


def codes(line: str) -> str:
    return (f"list_transform(string_split(regexp_extract({line}, "
            "'#\\s*owasp-ignore:\\s*([\\w\\-,\\s]+)', 1), ','), lambda c: trim(c))")


def adjusted(severity: str = "severity", path: str = "path", surface: str | None = None) -> str:
    scale = "['low', 'medium', 'high', 'critical']"
    low = f"regexp_matches({path}, '(?i)(?:^|/)migrations?/|(?:^|/)alembic/')"
    test = (f"regexp_matches({path}, '(?i)(?:^|/)tests?/|(?:^|/)test_[^/]+\\.py$|_test\\.py$|"
            "(?:^|/)conftest\\.py$|(?:^|/)fixtures?/')")
    rank = (f"CASE WHEN {low} THEN 1 WHEN {test} THEN list_position({scale}, {severity}) - 1 "
            f"ELSE list_position({scale}, {severity}) END")
    if surface:
        rank = f"greatest(1, {rank}) - CASE WHEN {surface} = 'local' THEN 1 ELSE 0 END"
    return f"{scale}[greatest(1, {rank})]"


def snippet(before: int = 1, after: int = 2, lines: str = "l", n: str = "line_number") -> str:
    return (f"array_to_string(list_transform(range(greatest({n} - {before}, 1), "
            f"least({n} + {after}, len({lines})) + 1), "
            f"lambda i: format('{{:4d}} | {{}}', i, {lines}[i])), chr(10))")


LABELS = "(VALUES " + ", ".join(f"({lit(c)}, {lit(n)})" for c, n in CATEGORIES.items()) + ") AS labels(owasp_category, label)"

NETWORK = (
    "(?m)^\\s*(?:from|import)\\s+(?:fastapi|flask|django|aiohttp\\.web|tornado\\.web|sanic|uvicorn"
    "|gunicorn|hypercorn|waitress|fastmcp|mcp\\.server|socketserver|http\\.server"
    "|xmlrpc\\.server|starlette)"
)

SURFACE = f"""SELECT project, CASE WHEN bool_or(
    rel_path LIKE '%.py'
    AND NOT list_bool_or(list_transform(string_split(rel_path, '/'), lambda p:
        starts_with(p, '.') OR p IN ('__pycache__', 'venv', 'node_modules')))
    AND regexp_matches(content, {lit(NETWORK)})) THEN 'network' ELSE 'local' END AS surface
  FROM files GROUP BY project"""

LIFECYCLE = """findings AS (
  SELECT o_orderkey::VARCHAR AS id, 'scan-' || (o_orderkey % 40) AS scan_id,
    'src/m' || (o_custkey % 97) || '.py' AS file_path, (o_orderkey % 400 + 1)::INTEGER AS line_number,
    'A' || lpad((o_orderkey % 10 + 1)::VARCHAR, 2, '0') || '-001' AS rule_id,
    sha256(o_orderkey::VARCHAR) AS fingerprint, 'security' AS category_type,
    'A' || lpad((o_orderkey % 10 + 1)::VARCHAR, 2, '0') AS owasp_category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
      WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
    'Finding ' || o_orderkey AS title,
    'Seen in src/m' || (o_custkey % 97) || '.py' AS description,
    CASE WHEN o_orderkey % 2 = 0 THEN '   1 | call(' || o_orderkey || ')' END AS code_snippet,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Change it' END AS suggested_fix,
    CASE WHEN o_orderstatus = 'F' THEN 'fixed'
      WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'accepted'
      WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 1 THEN 'false_positive'
      WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'open' END AS status,
    o_orderdate AS found_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 97 + 1)
      ELSE o_orderdate END AS updated_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 97 + 1) END AS fixed_at,
    NULL::VARCHAR AS fix_commit_sha,
    CASE WHEN o_orderkey % 5 = 0 THEN 0.5::DOUBLE END AS confidence,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'reviewed' END AS notes
  FROM orders)"""

SCANS = """scans AS (
  SELECT 'scan-' || (o_orderkey % 40) AS id, min(o_orderdate) AS started_at, count(*) AS findings_count
  FROM orders GROUP BY 1)"""


def base(*ctes: str) -> str:
    """``WITH`` clause for the first version of the corpus and more CTEs."""
    return "WITH " + ",\n".join((profile_cte(), corpus_cte(), *ctes)) + "\n"
