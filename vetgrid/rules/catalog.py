"""The built-in rule set as a table, and the operations on rule sets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vetgrid.schemas import RULES

# Risk class codes and names (public Top 10 list, 2025 edition).
CATEGORIES = {
    "A01": "Broken Access Control",
    "A02": "Security Misconfiguration",
    "A03": "Software Supply Chain Failures",
    "A04": "Cryptographic Failures",
    "A05": "Injection",
    "A06": "Insecure Design",
    "A07": "Authentication Failures",
    "A08": "Software or Data Integrity Failures",
    "A09": "Security Logging and Alerting Failures",
    "A10": "Mishandling of Exceptional Conditions",
}

# Severities from weakest to strongest.
SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    """One detection rule. ``flags`` holds the letters of the regex flags (``i``, ``m``)."""

    id: str
    owasp_category: str
    severity: str
    title: str
    description: str
    pattern: str
    globs: tuple[str, ...] = ("*.py",)
    suggested_fix: str = ""
    exclude_pattern: str | None = None
    flags: str = "im"


def _category_of(rule_id: str) -> str:
    return next(part for part in rule_id.split("-") if part in CATEGORIES)


def _table(rows: Iterable[tuple]) -> list[Rule]:
    return [
        Rule(
            id=rid,
            owasp_category=_category_of(rid),
            severity=severity,
            title=title,
            description=why,
            pattern=pattern,
            globs=globs,
            suggested_fix=fix,
            flags=flags,
        )
        for rid, severity, globs, flags, pattern, title, why, fix in rows
    ]


PY = ("*.py",)
ANY = ("*",)
JS = ("*.[jt]s", "*.[jt]sx")
ROUTE = ("route.*",)
NEXT_CONFIG = ("next.config*",)
MIDDLEWARE = ("middleware.*",)
COMPOSE = ("docker-compose*",)
HTML = ("*.html",)

# Rule ids, severities, file globs, flags and patterns. Titles, reasons and
# fixes are descriptive text.
_PYTHON_AND_TEXT = [
    ("A01-001", "high", PY, "im",
     r"@login_required\s*\n(?!.*@(?:permission_required|staff_member_required|user_passes_test))",
     "View checks login but not permission",
     "The decorator proves who the caller is, not what the caller may do.",
     "Stack a permission or staff check under the login decorator."),
    ("A01-002", "high", PY, "im",
     r"""(?:open|Path|FileResponse|send_file|send_from_directory)\s*\(.*?f['"]\s*[^'"]*\{.*?\}""",
     "File path assembled from variables",
     "A path interpolated from request data can climb out of the intended folder.",
     "Resolve the path and require it to stay below a known base folder."),
    ("A01-003", "high", PY, "im",
     r"requests\.(?:get|post|put|patch|delete|head|options)\s*\(\s*f['\"]",
     "Outgoing request to an interpolated URL",
     "Callers who steer the URL can make the server reach internal services.",
     "Check the host against an allow-list and refuse private address ranges."),
    ("A01-004", "high", PY, "im",
     r"urllib\.request\.(?:urlopen|urlretrieve)\s*\(\s*(?:f['\"]|[^'\")]*\+)",
     "urllib call with a computed URL",
     "A computed URL lets callers redirect the server's own requests.",
     "Compare the target with an allow-list before opening it."),
    ("A02-001", "critical", PY, "im",
     r"^\s*DEBUG\s*=\s*True",
     "Debug switch left on",
     "Debug pages reveal stack traces, queries and paths.",
     "Turn it off and read the switch from the environment."),
    ("A02-002", "high", PY, "im",
     r"""ALLOWED_HOSTS\s*=\s*\[.*?['"]\*['"]""",
     "Every host name accepted",
     "A wildcard host list permits forged Host headers.",
     "List the served host names."),
    ("A02-003", "medium", PY, "im",
     r"""SECRET_KEY\s*=\s*['"][^'"]{8,}['"]""",
     "Signing key written in source",
     "Whoever reads the source can sign sessions and tokens.",
     "Read the key from the environment or a vault."),
    ("A02-004", "medium", COMPOSE, "",
     r"""['"]?\d{4,5}:\d{4,5}['"]?""",
     "Container port published on all interfaces",
     "A port mapping without an address is reachable from outside the host.",
     "Prefix the mapping with 127.0.0.1 or drop it."),
    ("A02-005", "medium", PY, "im",
     r"CORS_ALLOW_ALL_ORIGINS\s*=\s*True",
     "Cross-origin access open to all sites",
     "Any site may send requests with the user's credentials.",
     "Name the permitted origins."),
    ("A02-006", "high", PY, "im",
     r"(?:xml\.etree\.ElementTree|etree)\.(?:parse|fromstring|iterparse)\s*\(",
     "XML parsed with external entities allowed",
     "External entities can read files or call internal hosts.",
     "Use a hardened XML package."),
    ("A02-007", "high", PY, "im",
     r"lxml\.etree\.(?:parse|fromstring|XML|HTML)\s*\([^)]*\)(?!.*resolve_entities\s*=\s*False)",
     "lxml used without a safe parser",
     "The default parser resolves entities and may use the network.",
     "Pass a parser with entity resolution and network access off."),
    ("A03-001", "medium", ANY, "im",
     r"pip\s+install\s+(?!-r\b|--requirement\b|-e\b|--editable\b|\.)(?:[a-zA-Z][\w-]*\s*(?!==|>=|<=|~=|!=)(?:\s|$))",
     "Package installed without a pinned version",
     "Builds change silently when a new or hijacked release appears.",
     "Pin the version and keep a hash-checked lock file."),
    ("A03-002", "high", ANY, "im",
     r"pip\s+install\s+(?:--trusted-host\s+\S+\s+)?(?:git\+|https?://|svn\+)",
     "Package installed from a URL or repository",
     "Direct installs skip the registry's integrity checks.",
     "Publish to a private registry or pin a commit hash."),
    ("A04-001", "critical", PY, "im",
     r"hashlib\.md5\(",
     "MD5 digest",
     "MD5 collisions are cheap and tables of its digests are public.",
     "Use SHA-256, or a password hash for passwords."),
    ("A04-002", "high", PY, "im",
     r"hashlib\.sha1\(",
     "SHA-1 digest",
     "SHA-1 collisions are practical.",
     "Use SHA-256 or SHA-3."),
    ("A04-003", "high", PY, "im",
     r"random\.(?:choice|choices|randint|random|sample|getrandbits)\(",
     "Predictable random generator",
     "The generator's output can be predicted from earlier values.",
     "Draw secrets from the secrets module."),
    ("A04-004", "high", PY, "im",
     r"verify\s*=\s*False",
     "Certificate check switched off",
     "Without the check anyone on the path can read and alter traffic.",
     "Keep verification on; pass the private CA bundle if one is needed."),
    ("A04-005", "high", PY, "im",
     r"(?:AES\.new|AES\.encrypt)\s*\([^)]*MODE_ECB",
     "AES in ECB mode",
     "Equal blocks encrypt to equal blocks, so structure shows.",
     "Use GCM, or CTR with a separate tag."),
    ("A04-006", "high", PY, "im",
     r"(?:DES3?|Triple_?DES)\.new\s*\(",
     "DES or triple DES",
     "The key or block size is too small by present standards.",
     "Move to AES with a 256-bit key."),
    ("A04-007", "high", PY, "im",
     r"hashlib\.(?:sha256|sha512|sha1|md5)\s*\(\s*(?:password|passwd|pwd|user_pass)",
     "Password hashed with a fast digest",
     "Fast digests allow billions of guesses a second.",
     "Use Argon2id, scrypt or bcrypt."),
    ("A05-001", "critical", PY, "im",
     r"""(?:execute|executemany|raw|cursor\.)\s*\(\s*f['"].*?(?:SELECT|INSERT|UPDATE|DELETE|WHERE)""",
     "SQL statement in an f-string",
     "Interpolated values can rewrite the statement.",
     "Bind values as parameters."),
    ("A05-002", "critical", PY, "im",
     r"""['"](?:SELECT|INSERT|UPDATE|DELETE)\s.*?['"]\s*\+""",
     "SQL statement joined with plus",
     "Concatenated values can rewrite the statement.",
     "Bind values as parameters or use a query builder."),
    ("A05-003", "critical", PY, "im",
     r"pickle\.loads?\(",
     "Unpickling",
     "A crafted pickle runs code while loading.",
     "Exchange data as JSON; unpickle trusted files only."),
    ("A05-004", "critical", PY, "im",
     r"\beval\s*\(|\bexec\s*\(",
     "Dynamic evaluation",
     "Evaluated text runs with the program's rights.",
     "Parse literals with ast.literal_eval or use plain logic."),
    ("A05-005", "critical", PY, "im",
     r"yaml\.load\s*\([^)]*\)(?!.*(?:Loader\s*=\s*(?:yaml\.)?SafeLoader|safe_load))",
     "YAML loaded with the full loader",
     "The full loader can build arbitrary objects.",
     "Call the safe loader."),
    ("A05-006", "critical", PY, "im",
     r"os\.system\s*\(",
     "Shell command through os.system",
     "The shell interprets whatever the string holds.",
     "Run a list of arguments without a shell."),
    ("A05-007", "high", PY, "im",
     r"subprocess\.\w+\([^)]*shell\s*=\s*True",
     "Child process started through a shell",
     "The shell interprets metacharacters in the arguments.",
     "Pass a list and leave the shell off."),
    ("A05-008", "high", PY, "im",
     r"Template\s*\(\s*f['\"]",
     "Template text built from variables",
     "Values placed in the template source are executed by the engine.",
     "Keep the template fixed and pass values at render time."),
    ("A07-001", "high", PY, "im",
     r"""(?:password|passwd|api_key|apikey|secret_key|access_token|auth_token)\s*=\s*['"][^'"]{6,}['"]""",
     "Credential written in source",
     "Everyone with read access to the code holds the credential.",
     "Load it from the environment or a secret store."),
    ("A07-002", "medium", PY, "im",
     r"jwt\.decode\s*\([^)]*(?!algorithms\s*=)",
     "Token decoded, algorithm list to be checked",
     "A decoder without a fixed algorithm list may accept unsigned tokens.",
     "Name the accepted algorithms."),
    ("A07-003", "critical", ANY, "m",
     r"AKIA[0-9A-Z]{16}",
     "Cloud access key id",
     "The id names a live key pair of a cloud account.",
     "Remove and rotate the key; use roles."),
    ("A07-004", "critical", ANY, "im",
     r"""(?:aws_secret_access_key|secret_key|secretkey)\s*[=:]\s*['"]?[A-Za-z0-9/+=]{40}['"]?""",
     "Cloud secret access key",
     "The secret half of a key pair gives account access.",
     "Rotate it and load it from the environment."),
    ("A07-005", "critical", ANY, "m",
     r"sk-proj-[A-Za-z0-9_\-]{20,}",
     "Model provider API key",
     "Holders of the key can spend on the account.",
     "Rotate it and load it from the environment."),
    ("A07-006", "critical", ANY, "m",
     r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+)?PRIVATE\s+KEY-----",
     "Private key block",
     "The key allows impersonation and decryption.",
     "Move it to a secret store and replace it."),
    ("A07-007", "critical", ANY, "im",
     r"(?:mysql|postgresql|postgres|mongodb|redis)://[^:]+:[^@]+@",
     "Connection string with a password",
     "The string opens the database to every reader.",
     "Load the string from the environment."),
    ("A07-008", "critical", ANY, "m",
     r"gh[pousr]_[A-Za-z0-9_]{36,}",
     "Code host access token",
     "The token gives access to repositories.",
     "Revoke it and load a new one from the environment."),
    ("A07-009", "critical", ANY, "m",
     r"xox[bpas]-[A-Za-z0-9\-]{10,}",
     "Chat workspace token",
     "The token can read messages and act as a bot.",
     "Revoke it and load a new one from the environment."),
    ("A08-001", "medium", HTML, "im",
     r"<script\s+src=['\"]https?://[^'\"]+['\"](?![^>]*integrity=)",
     "Remote script without an integrity hash",
     "A changed remote script runs unnoticed.",
     "Add integrity and crossorigin attributes."),
    ("A08-002", "critical", PY, "im",
     r"marshal\.loads?\(",
     "Unmarshalling",
     "Crafted marshal data can crash or take over the interpreter.",
     "Exchange data as JSON."),
    ("A08-003", "high", PY, "im",
     r"shelve\.open\s*\(",
     "Shelf file opened",
     "Shelves are pickles; a planted file runs code.",
     "Use a database or JSON."),
    ("A08-004", "critical", PY, "im",
     r"(?:jsonpickle\.decode|dill\.loads?)\s*\(",
     "Object decoding with a pickle-like library",
     "These libraries rebuild arbitrary objects.",
     "Exchange plain JSON."),
    ("A09-001", "high", PY, "im",
     r"(?:log(?:ger|ging)?\.(?:debug|info|warning|error|critical|exception)|print)\s*\("
     r"[^)]*(?:password|passwd|secret|token|api_key|apikey|ssn|credit_card)",
     "Secret written to a log",
     "Logs travel further than the data they describe.",
     "Mask or leave out the value."),
    ("A09-002", "high", PY, "im",
     r"log(?:ger|ging)?\.(?:debug|info|warning|error|critical|exception)\s*\(\s*f['\"]"
     r"[^'\"]*\{"
     r"[^}]*(?:request|req\.|params|query|form|header|body|payload|user_input|argv|stdin)"
     r"[^}]*\}",
     "Request data formatted into a log line",
     "Line breaks in the value forge further log entries.",
     "Use placeholders and strip control characters."),
    ("A09-003", "low", PY, "im",
     r"log(?:ger|ging)?\.(?:debug|info|warning|error|critical|exception)\s*\(\s*f['\"]",
     "Log message formatted eagerly",
     "The text is built even when the level is off.",
     "Use placeholders with arguments."),
    ("A10-001", "high", PY, "im",
     r"except\s*:\s*\n\s*pass",
     "Bare except that does nothing",
     "Every failure, security ones included, disappears.",
     "Catch named exceptions and log them."),
    ("A10-002", "medium", PY, "im",
     r"except\s+(?:Exception|BaseException)\s*(?:as\s+\w+)?\s*:\s*\n\s*pass",
     "Broad except that does nothing",
     "Unexpected failures disappear.",
     "Catch named exceptions and log them."),
    ("A10-003", "medium", PY, "im",
     r"traceback\.(?:format_exc|print_exc)\s*\(",
     "Stack trace may reach the user",
     "Traces show internals to an attacker.",
     "Log on the server and answer with a plain message."),
    ("A10-004", "medium", PY, "im",
     r"requests\.(?:get|post|put|patch|delete|head|options)\s*\([^)]*\)(?<!\btimeout\b)",
     "Outgoing request, timeout to be checked",
     "A peer that never answers holds the worker for good.",
     "Set a timeout."),
    ("A10-005", "high", PY, "im",
     r"except\s*(?:\w+\s*)?(?:as\s+\w+\s*)?:\s*\n\s*return\s+True",
     "Failure treated as success",
     "An error in a check lets the caller pass.",
     "Return a refusal on errors."),
]

_WEB = [
    ("JS-A01-001", "high", ROUTE, "im",
     r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)\s*\(",
     "Public route handler",
     "A handler is reachable by anyone, and middleware checks have been bypassed before.",
     "Check the session inside the handler."),
    ("JS-A01-002", "high", JS, "im",
     r"""^['"]use server['"]""",
     "Server action module",
     "Exported actions are HTTP endpoints even without a form.",
     "Check the caller at the top of each action."),
    ("JS-A01-003", "critical", JS, "im",
     r"Object\.fromEntries\s*\(\s*(?:formData|form)",
     "Whole form spread into an object",
     "Extra form fields can set columns the user must not touch.",
     "Pick the expected fields one by one."),
    ("JS-A01-004", "high", JS, "im",
     r"redirect\s*\(\s*(?!['\"\/])\w",
     "Redirect to a computed target",
     "A computed target can lead to a foreign site.",
     "Accept local paths only."),
    ("JS-A01-005", "medium", JS, "im",
     r"revalidate(?:Path|Tag)\s*\(\s*(?!['\"]\s*[/\w])[^)]+\)",
     "Cache key taken from a variable",
     "Callers who choose the key can poison the cache.",
     "Map the input to known routes."),
    ("JS-A02-001", "critical", ANY, "im",
     r"NEXT_PUBLIC_\w*(?:SECRET|KEY|TOKEN|PASSWORD|PRIVATE|AUTH)\w*",
     "Secret-looking variable exposed to browsers",
     "Variables with the public prefix are shipped in the bundle.",
     "Drop the prefix unless the value is meant to be public."),
    ("JS-A02-002", "high", NEXT_CONFIG, "",
     r"""hostname\s*:\s*['"][*]{2}['"]""",
     "Image loader open to all hosts",
     "The optimizer can be used to fetch any address.",
     "List the image hosts."),
    ("JS-A02-005", "high", NEXT_CONFIG, "im",
     r"destination\s*:\s*['\"]https?://(?:localhost|127\.0\.0\.1|10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.)",
     "Rewrite to an internal address",
     "The rewrite carries outside requests to an internal service.",
     "Put an authenticated route in between."),
    ("JS-A04-001", "high", JS, "im",
     r"Math\.random\s*\(\s*\)",
     "Predictable random number in the browser",
     "The values can be predicted.",
     "Use the crypto module."),
    ("JS-A04-002", "high", JS, "im",
     r"cookies\(\)\s*\.set\s*\(\s*['\"][^'\"]+['\"]",
     "Cookie set, flags to be checked",
     "A cookie without flags can be read by scripts or sent across sites.",
     "Set httpOnly, secure and sameSite."),
    ("JS-A05-001", "high", JS, "im",
     r"dangerouslySetInnerHTML\s*=",
     "Raw markup rendered",
     "Markup from users runs scripts.",
     "Render as text or sanitize first."),
    ("JS-A05-002", "high", JS, "im",
     r"\.innerHTML\s*=",
     "Markup assigned to an element",
     "The assignment skips the framework's escaping.",
     "Assign text content."),
    ("JS-A05-003", "critical", JS, "im",
     r"\beval\s*\(|new\s+Function\s*\(",
     "Dynamic code in script",
     "Evaluated text runs with the page's or server's rights.",
     "Parse data as JSON and use plain logic."),
    ("JS-A05-004", "critical", JS, "im",
     r"\$(?:queryRawUnsafe|executeRawUnsafe)\s*\(",
     "Unsafe raw query",
     "The text reaches the database without binding.",
     "Use the tagged template form."),
    ("JS-A05-005", "critical", JS, "im",
     r"\$queryRaw\s*\(\s*(?!`)['\"]",
     "Raw query given a plain string",
     "A plain string is not parameterised.",
     "Use the tagged template form."),
    ("JS-A05-006", "critical", JS, "im",
     r"(?:exec|execSync)\s*\(\s*`",
     "Shell command in a template literal",
     "Interpolated values are read by the shell.",
     "Run a file with an argument array."),
    ("JS-A05-008", "high", JS, "im",
     r"router\.(?:push|replace)\s*\(\s*(?!['\"\/])\w",
     "Navigation to a computed address",
     "A script address runs in the page.",
     "Accept local paths only."),
    ("JS-A06-001", "high", MIDDLEWARE, "im",
     r"matcher\s*[=:]\s*\[(?![^\]]*\/api)",
     "Middleware matcher leaves out API routes",
     "Unmatched routes run without the middleware's checks.",
     "Add the API routes or check in each handler."),
    ("JS-A07-001", "critical", JS, "im",
     r"(?:mysql|postgresql|postgres|mongodb|redis)://[^:]+:[^@]+@",
     "Connection string in script",
     "The password is readable in the source.",
     "Read the string from the environment."),
    ("JS-A07-002", "critical", JS, "im",
     r"""(?:api_?key|secret_?key|auth_?token|access_?token)\s*[=:]\s*['"][^'"]{8,}['"]""",
     "Credential in script",
     "The value ships with the code.",
     "Read it from the environment."),
    ("JS-A10-001", "high", JS, "im",
     r"catch\s*\([^)]*\)\s*\{\s*\}",
     "Empty catch block",
     "Failures disappear.",
     "Log and handle the error."),
    ("JS-A10-002", "medium", JS, "im",
     r"(?:\.json|Response\.json)\s*\(.*?(?:\.message|\.stack)",
     "Error details sent to the client",
     "Messages and stacks show internals.",
     "Answer with a general message."),
]

# Fixed value: lines that match this as well are not reported by rule A09-003.
_EXCLUDES = {
    "A09-003": r"\{[^}]*(?:request|req\.|params|query|form|header|body|payload|user_input|argv|stdin)[^}]*\}",
}


def _with_excludes(rules: list[Rule]) -> list[Rule]:
    return [
        Rule(**{**vars(r), "exclude_pattern": _EXCLUDES[r.id]}) if r.id in _EXCLUDES else r
        for r in rules
    ]


ALL_RULES: list[Rule] = _with_excludes(_table(_PYTHON_AND_TEXT) + _table(_WEB))


def select_rules(
    rules: Iterable[Rule] = ALL_RULES,
    *,
    category: str | None = None,
    severity: str | None = None,
    min_severity: str | None = None,
    ids: Iterable[str] | None = None,
    extra: Iterable[Rule] = (),
) -> list[Rule]:
    """Built-in rules plus ``extra`` rules with new ids, narrowed by category or base severity.

    ``severity`` is an equality test on the base severity; ``min_severity`` is a lower bound.
    """
    chosen = list(rules)
    known = {r.id for r in chosen}
    chosen += [r for r in extra if r.id not in known]
    if ids is not None:
        wanted = set(ids)
        chosen = [r for r in chosen if r.id in wanted]
    if category:
        chosen = [r for r in chosen if r.owasp_category == category]
    if severity:
        chosen = [r for r in chosen if r.severity == severity]
    if min_severity:
        floor = SEVERITIES.index(min_severity)
        chosen = [r for r in chosen if r.severity in SEVERITIES[floor:]]
    return chosen


def rules_dataframe(spark: SparkSession, rules: Iterable[Rule] = ALL_RULES) -> DataFrame:
    """The rule set as a DataFrame, one row for each rule and glob."""
    rows = [
        (r.id, r.owasp_category, r.severity, r.title, r.description, r.pattern, r.flags,
         glob, r.suggested_fix, r.exclude_pattern)
        for r in rules
        for glob in r.globs
    ]
    return spark.createDataFrame(rows, RULES)
