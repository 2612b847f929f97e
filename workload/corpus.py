"""The source-code corpus derived from ``documents`` and ``pages``, as DataFrames.

``workload.oracle`` states the same corpus in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.functions.constants import constant
from vetgrid.session import spread
from workload.profiles import NETWORK_HEADS, PROFILES

K = len(PROFILES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(constant(values, "array<string>"), index.cast("int") + 1)


def files(spark: SparkSession, sf_dir: str, *, version: int = 1, pages: bool = True) -> DataFrame:
    """``(project, path, rel_path, content, size, doc_id)``; ``version`` 2 is a later snapshot."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    result = from_documents(docs, version)
    if pages:
        result = result.unionByName(_from_pages(
            spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")))
    return result.withColumn("size", F.octet_length("content").cast("long"))


def from_documents(docs: DataFrame, version: int = 1) -> DataFrame:
    doc = F.col("doc_id")
    entry = doc % K
    number = F.floor(doc / K)
    paths = [p for p, _, _ in PROFILES]
    heads = [h for _, h, _ in PROFILES]
    tails = [t for _, _, t in PROFILES]

    rel = pick(paths, entry)
    # Which root markers a project has decides its type.
    rel = (
        F.when((number % 4).isin(1, 3) & (rel == "next.config.js"), F.concat(F.lit("conf/"), rel))
        .when((number % 4).isin(2, 3) & rel.isin("pyproject.toml", "requirements.txt"),
              F.concat(F.lit("py/"), rel))
        .otherwise(rel)
    )
    head = F.when((number % 2 == 1) & rel.isin(*NETWORK_HEADS), F.lit("")).otherwise(
        pick(heads, entry))
    manifest = F.concat(
        F.lit('{"name":"demo","version":"'), F.col("n_chars").cast("string"),
        F.when(number % 4 == 0, '","dependencies":{"next":"14.0"},"devDependencies":{"x":"1"}}')
        .otherwise('","dependencies":{"left":"1"},"devDependencies":{"react":"18"}}'),
    )
    tail = pick(tails, entry)
    if version == 2:
        # Fixed, shifted and untouched files; see ``deleted`` below for the missing ones.
        head = F.when(doc % 5 == 0, F.lit("")).when(
            doc % 7 == 0, F.concat(F.lit("# moved\n# down\n"), head)).otherwise(head)
        tail = F.when(doc % 5 == 0, F.lit("")).otherwise(tail)
    body = F.concat(head, F.lit("\n"), F.col("text"), F.lit("\n"), tail)
    content = F.when(rel == "package.json", manifest).when(
        rel == "data/blob.bin", F.concat(F.lit("\u0001"), body)).otherwise(body)
    result = docs.select(
        F.concat(F.lit("p"), number.cast("string")).alias("project"),
        F.concat(F.lit("p"), number.cast("string"), F.lit("/"), rel).alias("path"),
        rel.alias("rel_path"),
        content.alias("content"),
        doc.alias("doc_id"),
    )
    if version == 2:
        result = result.filter(doc % 11 != 3)
    return result


def _from_pages(pages: DataFrame) -> DataFrame:
    page = F.col("page_id")
    site = F.concat(F.lit("site"), F.floor(page / 50).cast("string"))
    rel = F.concat(F.lit("pages/"), page.cast("string"), F.lit(".html"))
    script = '\n<script src="https://cdn.example.net/w.js"></script>'
    markup = F.concat(F.col("html"), F.when(page % 3 == 0, script).otherwise(""))
    return pages.select(
        site.alias("project"),
        F.concat(site, F.lit("/"), rel).alias("path"),
        rel.alias("rel_path"),
        markup.alias("content"),
        (-page - 1).alias("doc_id"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a findings table: status, severity and times of a long history."""
    key = F.col("o_orderkey")
    found = F.col("o_orderdate").cast("timestamp")
    status = (
        F.when(F.col("o_orderstatus") == "F", "fixed")
        .when((F.col("o_orderstatus") == "P") & (key % 3 == 0), "accepted")
        .when((F.col("o_orderstatus") == "P") & (key % 3 == 1), "false_positive")
        .when(F.col("o_orderstatus") == "P", "in_progress")
        .otherwise("open")
    )
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
        .otherwise("low")
    )
    category = F.concat(F.lit("A"), F.lpad((key % 10 + 1).cast("string"), 2, "0"))
    path = F.concat(F.lit("src/m"), (F.col("o_custkey") % 97).cast("string"), F.lit(".py"))
    hours = (key % 97 + 1).cast("int")
    fixed = F.when(F.col("o_orderstatus") == "F", found + F.make_dt_interval(hours=hours))
    none = F.lit(None)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.concat(F.lit("scan-"), (key % 40).cast("string")).alias("scan_id"),
        path.alias("file_path"),
        (key % 400 + 1).cast("int").alias("line_number"),
        F.concat(category, F.lit("-001")).alias("rule_id"),
        F.sha2(key.cast("string"), 256).alias("fingerprint"),
        F.lit("security").alias("category_type"),
        category.alias("owasp_category"),
        severity.alias("severity"),
        F.concat(F.lit("Finding "), key.cast("string")).alias("title"),
        F.concat(F.lit("Seen in "), path).alias("description"),
        F.when(key % 2 == 0, F.concat(F.lit("   1 | call("), key.cast("string"), F.lit(")")))
        .alias("code_snippet"),
        F.when(key % 3 != 0, F.lit("Change it")).alias("suggested_fix"),
        status.alias("status"),
        found.alias("found_at"),
        F.coalesce(fixed, found).alias("updated_at"),
        fixed.alias("fixed_at"),
        none.cast("string").alias("fix_commit_sha"),
        F.when(key % 5 == 0, F.lit(0.5)).alias("confidence"),
        F.when((F.col("o_orderstatus") == "P") & (key % 2 == 0), F.lit("reviewed")).alias("notes"),
    )
