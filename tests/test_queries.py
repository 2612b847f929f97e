"""The registry is complete, and cheap queries agree with their SQL at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normal
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
CHEAP = ("scan_full", "suppressed_hits", "directory_scan", "apply_updates", "summary", "open_running",
         "config_django", "boundary_crossings", "dependency_findings", "triage_verdicts", "status_history")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_registry():
    assert set(ORACLE) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 10


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, sql, name):
    df = queries()[name](spark, SF)
    cursor = sql.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), columns)


def test_many_rules_on_odd_words(spark, tmp_path):
    """Words are cut at letters outside the listed range, capitals of which only A to Z are lowered."""
    texts = ["Lighthouse LIGHTHOUSE lighthousé, abcdefgh abcdefghi_jklmnopqrst x÷abcdefghij", "ÉTUDIANTES étudiantes Straßenbahnen",
             "abcdefghiÀklmnopqrstu ŵabcdefghijk", "", None, "intérêtsÿøöà1lighthouses"]
    turns = [(1, 0, "LightHouse\nlighthouse lighthouse\nlighthouses"), (1, 1, "Étudiantes ÉTUDIANTES"), (2, 0, "tudiantes nbahnen"),
             (2, 1, "abcdefghi_jklmnopqrst intérêtsÿøöà lighthousé"), (3, 0, ""), (3, 1, None), (4, 0, "abcdefghi klmnopqrstu\nlighthouse")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.rule_id: (r.lines, r.conversations) for r in queries()["many_rules"](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    for name in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in connection.execute(oracle_sql()["many_rules"]).fetchall()}
    assert got["W-lighthouse"] == (3, 2) and len(got) > 6
