"""Which files of a table of sources are scanned, and which of them changed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.regex import glob_head, glob_match, glob_regex_of
from vetgrid.functions.text import file_name, file_suffix, lines_of, strip

# Folders that are never scanned.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache",
    "node_modules", ".venv", "venv", ".env", "env", ".tox", ".eggs", "*.egg-info", "dist",
    "build", ".next", ".nuxt",
)

# Extensions scanned when no rule asks for every text file.
CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cs", ".go", ".rb", ".php", ".html", ".htm",
    ".yml", ".yaml", ".toml", ".cfg", ".ini", ".env", ".json",
)

# The usual size cap and the name of the per-project ignore file.
MAX_FILE_KB = 500
IGNORE_FILE = ".owaspignore"

_BINARY_HEAD = 1024


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 1024 bytes."""
    head = F.substring(content.cast("binary"), 1, _BINARY_HEAD)
    return F.contains(head, F.lit(b"\x00"))


def in_skipped_folder(rel_path: Column) -> Column:
    """True if a folder above the file is one of the skipped ones."""
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) | F.exists(
        folders, lambda part: F.endswith(part, F.lit(".egg-info"))
    )


def is_excluded(rel_path: Column, patterns: Iterable[str]) -> Column:
    """Globs on the relative path or the name; ``dir/`` also excludes what lies below it."""
    test = F.lit(False)
    for pattern in patterns:
        test = test | glob_match(rel_path, pattern) | glob_match(file_name(rel_path), pattern)
        if pattern.endswith("/"):
            test = test | F.contains(F.concat(F.lit("/"), rel_path), F.lit("/" + pattern))
    return test


def eligible_files(
    files: DataFrame,
    *,
    all_text: bool = True,
    exclude: Iterable[str] = (),
    max_file_kb: int | None = None,
) -> DataFrame:
    """Files worth scanning. ``all_text`` is for rule sets that hold a rule with glob ``*``.

    Files of any size are, unless ``max_file_kb`` (``MAX_FILE_KB`` is usual) leaves out larger ones.
    """
    rel = F.col("rel_path")
    kind = ~is_binary(F.col("content")) if all_text else file_suffix(rel).isin(*CODE_EXTENSIONS)
    small = F.lit(True) if max_file_kb is None else F.col("size") <= max_file_kb * 1024
    return files.filter(
        small
        & ~in_skipped_folder(rel)
        & ~is_excluded(rel, exclude)
        & kind
    )


def ignore_patterns(files: DataFrame) -> DataFrame:
    """``(project, ignore_patterns)`` from the ignore file at each project's root."""
    entries = F.transform(lines_of(F.col("content")), strip)
    kept = F.filter(entries, lambda e: (e != "") & ~F.startswith(e, F.lit("#")))
    return files.filter(F.col("rel_path") == IGNORE_FILE).select(
        "project", kept.alias("ignore_patterns")
    )


def drop_ignored(rows: DataFrame, ignores: DataFrame) -> DataFrame:
    """Rows whose ``rel_path`` no ignore pattern of their project matches.

    ``rows`` may be files or, to move less data, findings: any table with ``project`` and
    ``rel_path``. ``ignores`` has at most one row for a project.
    """
    rel, name = F.col("rel_path"), file_name(F.col("rel_path"))
    # Each line becomes a regex once for its project, and meets the few paths that start like it.
    tests = ignores.select("project", F.transform("ignore_patterns", lambda p: F.struct(
        p.alias("glob"), glob_head(p).alias("head"), glob_regex_of(p).alias("regex"))).alias("_tests"))
    hit = F.exists(
        F.col("_tests"),
        lambda t: (F.startswith(rel, t["head"]) & F.rlike(rel, t["regex"]))
        | (F.startswith(name, t["head"]) & F.rlike(name, t["regex"]))
        | (F.endswith(t["glob"], F.lit("/"))
           & F.contains(F.concat(F.lit("/"), rel), F.concat(F.lit("/"), t["glob"]))),
    )
    joined = rows.join(tests, "project", "left")
    return joined.filter(~F.coalesce(hit, F.lit(False))).drop("_tests")


def write_source_snapshot(files: DataFrame, table: str, buckets: int) -> None:
    """Files as a catalog table, bucketed and sorted by path, with ``content_hash``.

    Two snapshots with the same number of buckets are compared, and a snapshot is joined to findings or
    changes by path, without moving a text: only the small side is dealt to the buckets. Choose
    ``buckets`` at ``spark.sql.shuffle.partitions`` or more, so that Spark keeps to them.
    """
    files.withColumn("content_hash", F.sha2("content", 256)).write.bucketBy(buckets, "path").sortBy("path").saveAsTable(table)


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` between two snapshots: added, modified or deleted.

    Only paths and content hashes are shuffled, of snapshots by ``write_source_snapshot`` nothing is
    and no content is read.
    """
    def hashed(files: DataFrame, name: str) -> DataFrame:
        known = F.col("content_hash") if "content_hash" in files.columns else F.sha2("content", 256)
        return files.select("path", known.alias(name))

    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return (
        hashed(old, "old_hash")
        .join(hashed(new, "new_hash"), "path", "full_outer")
        .select("path", change.alias("change"))
        .filter("change IS NOT NULL")
    )


def only_changed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files whose path is among the changed ones."""
    return files.join(changes.select("path"), "path", "left_semi")
