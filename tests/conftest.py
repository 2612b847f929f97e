from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vetgrid.operators.scan import scan_text
from vetgrid.rules import ALL_RULES
from vetgrid.session import builder


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests").master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files from ``{path: content}``; the first folder of a path is its project."""
    def make(contents: dict[str, str]):
        rows = [
            (p.split("/")[0], p, p.split("/", 1)[-1], text, len(text.encode()))
            for p, text in contents.items()
        ]
        return spark.createDataFrame(
            rows, "project STRING, path STRING, rel_path STRING, content STRING, size BIGINT")
    return make


@pytest.fixture(scope="session")
def scan(make_files):
    """Set of ``(path, rule_id, line_number)`` found in ``{path: content}``."""
    def run(contents: dict[str, str], rules=ALL_RULES, **options):
        found = scan_text(make_files(contents), rules, **options)
        return {tuple(r) for r in found.select("path", "rule_id", "line_number").collect()}
    return run


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over a single row of named values."""
    def evaluate(expression, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
        return row.select(expression.alias("x")).first()["x"]
    return evaluate
