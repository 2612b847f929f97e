"""Values that cross from server components to client components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.text import (
    MATCH_START,
    file_name,
    file_suffix,
    has_any,
    lines_of,
    mark_matches,
    strip,
)
from vetgrid.operators.projects import is_client_component

# Imports by relative path, prop pairs, names that suggest personal data, and the
# suffixes tried when an import names no file.
_IMPORT = r"""(?dU)import\s+(?:(\w+)|\{([^}]+)\})\s+from\s+['"](\.[^'"]+)['"]"""
_PROP = r"(?dU)(\w+)\s*=\s*\{([^}]*)\}"
_SENSITIVE = (
    r"(?diuU)(?:user|session|account|profile|token|auth|credentials|secret|password|email|phone"
    r"|ssn|credit.?card|payment|address|dob|date.?of.?birth|salary|medical|health)"
)
_SUFFIXES = ("", ".tsx", ".ts", ".jsx", ".js")
_SCRIPTS = (".tsx", ".ts", ".jsx", ".js")


def is_sensitive(text: Column) -> Column:
    return text.rlike(_SENSITIVE)


def _is_server_file(rel_path: Column, content: Column, client: Column) -> Column:
    """A script below ``app/`` that is no client component."""
    head = F.substring(content, 1, 200)
    return (
        F.startswith(rel_path, F.lit("app/"))
        & file_suffix(rel_path).isin(*_SCRIPTS)
        & (file_name(rel_path) != "middleware.ts")
        & ~client
        & ~has_any(head, ("'use client'", '"use client"'))
    )


def boundary_facts(files: DataFrame, target: str | None = None) -> DataFrame:
    """``(project, path, client, imports, tags)``: all that the analysis needs of each file.

    With ``target``, the path of a single file, only that file's imports and tags are read, wherever it
    stands and whatever it is; the other files are what its imports may lead to.

    This is the only step that reads the texts. Everything after it joins these small rows, and
    reads them several times: stage them (``vetgrid.session.stage_table``) for large inputs.
    """
    text = F.col("content")
    marked = files.withColumn("client", is_client_component(text))
    server = (_is_server_file(F.col("rel_path"), text, F.col("client")) if target is None
              else F.col("path") == target)
    return marked.select(
        "project", "path", "client",
        F.when(server, _imports(text)).alias("imports"),
        F.when(server, _tags(text)).alias("tags"),
    )


def _upper_first(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def _imported_names(default: Column, named: Column) -> Column:
    last = F.transform(
        F.split(named, ","),
        lambda part: strip(F.element_at(F.split(strip(part), " as "), -1)),
    )
    return F.filter(F.concat(F.array(default), last), _upper_first)


def _imports(text: Column) -> Column:
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_IMPORT), 1).alias("default"),
        F.regexp_extract_all(text, F.lit(_IMPORT), 2).alias("named"),
        F.regexp_extract_all(text, F.lit(_IMPORT), 3).alias("specifier"),
    )


def component_imports(facts: DataFrame) -> DataFrame:
    """``(path, ord, component, specifier)``: capitalised names imported by relative path."""
    one = facts.select("path", F.posexplode("imports").alias("ord", "i"))
    return one.select(
        "path", "ord", F.explode(_imported_names(F.col("i.default"), F.col("i.named")))
        .alias("component"), F.col("i.specifier").alias("specifier"),
    )


def _joined_path(folder: Column, specifier: Column) -> Column:
    """Folder and relative specifier as a plain path: ``.`` dropped, ``..`` goes up."""
    parts = F.split(F.concat_ws("/", folder, specifier), "/")
    kept = F.aggregate(
        F.filter(parts, lambda p: ~p.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    root = F.when(F.startswith(folder, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.array_join(kept, "/"))


def _candidates(base: Column) -> Column:
    """Files an import may mean, best first."""
    paths = []
    for suffix in _SUFFIXES:
        paths.append(F.concat(base, F.lit(suffix)))
        paths.append(F.concat(base, F.lit(suffix + "/index" + (suffix or ".tsx"))))
    return F.array(*paths)


def resolve_imports(imports: DataFrame, facts: DataFrame) -> DataFrame:
    """Imports with ``client_file``: the first existing candidate.

    Imports that lead to a file which is no client component are dropped; imports that lead
    nowhere stay with a NULL file. Each distinct target is looked up once, so a component that
    very many files import is one row of the lookup join.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    targets = imports.withColumn("target", _joined_path(folder, F.col("specifier")))
    lookup = targets.select("target").distinct().select(
        "target", F.posexplode(_candidates(F.col("target"))).alias("rank", "candidate"))
    present = facts.select(F.col("path").alias("candidate"), "client")
    best = (
        lookup.join(present, "candidate").groupBy("target")
        .agg(F.min_by(F.struct("candidate", "client"), "rank").alias("b"))
        .select("target", F.col("b.candidate").alias("client_file"), F.col("b.client").alias("client"))
    )
    resolved = targets.join(best, "target", "left")
    return resolved.filter(F.coalesce("client", F.lit(True))).select(
        "path", "ord", "component", "client_file")


def _tags(text: Column) -> Column:
    # A tag ends at the first ``>``. Only its name is consumed, so that a tag inside a prop of
    # another one is found as well.
    tag = r"(?dsU)<(\p{Lu}\w*)(?=\s+(.*?)/?>)"
    marked = lines_of(mark_matches(text, tag))
    # Matches may share a line; each start mark stands for one tag.
    line_numbers = F.flatten(F.transform(marked, lambda line, i: F.array_repeat(
        i + 1, F.size(F.split(line, MATCH_START)) - 1)))
    return F.arrays_zip(
        line_numbers.alias("line"),
        F.regexp_extract_all(text, F.lit(tag), 1).alias("component"),
        F.regexp_extract_all(text, F.lit(tag), 2).alias("body"),
    )


def component_tags(facts: DataFrame) -> DataFrame:
    """``(project, path, component, line, props)``: JSX tags with at least one ``name={value}`` prop."""
    one = facts.select("project", "path", F.inline("tags"))
    body = F.col("body")
    props = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(body, F.lit(_PROP), 1).alias("name"),
            F.regexp_extract_all(body, F.lit(_PROP), 2).alias("value"),
        ),
        lambda p: F.struct(
            p["name"].alias("name"), strip(p["value"]).alias("value"),
            F.col("line").alias("line"),
            (is_sensitive(p["name"]) | is_sensitive(strip(p["value"]))).alias("sensitive"),
        ),
    )
    return one.select("project", "path", "component", "line", props.alias("props")).filter(
        F.size("props") > 0)


def boundary_crossings(facts: DataFrame) -> DataFrame:
    """``(project, server_file, client_component, client_file, line, props, risk_level)``."""
    imports = resolve_imports(component_imports(facts), facts)
    # A later import of the same name replaces an earlier one.
    named = imports.groupBy("path", "component").agg(
        F.max_by(F.struct("client_file"), F.col("ord")).alias("t"))
    risky = F.exists("props", lambda p: p["sensitive"])
    return component_tags(facts).join(named, ["path", "component"]).select(
        "project",
        F.col("path").alias("server_file"),
        F.col("component").alias("client_component"),
        F.col("t.client_file").alias("client_file"),
        "line", "props",
        F.when(risky, "high").otherwise("medium").alias("risk_level"),
    )


def in_web_projects(crossings: DataFrame, types: DataFrame) -> DataFrame:
    """Crossings of projects that are web projects, from ``(project, project_type)``."""
    web = types.filter(F.col("project_type").isin("nextjs", "monorepo")).select("project")
    return crossings.join(web, "project", "left_semi")


def boundary_summary(crossings: DataFrame) -> DataFrame:
    high = F.col("risk_level") == "high"
    return crossings.agg(
        F.count(F.lit(1)).alias("total_crossings"),
        F.count_if(high).alias("high_risk"),
        F.count_if(~high).alias("medium_risk"),
    )


def sensitive_props(crossings: DataFrame) -> DataFrame:
    found = F.filter("props", lambda p: p["sensitive"])
    return crossings.select(
        "server_file", "client_component", F.explode(found).alias("p")
    ).select("server_file", "client_component", F.col("p.name").alias("prop"),
             F.col("p.value").alias("value"), F.col("p.line").alias("line"))
