"""The findings table with versions: copy on write by bucket, an atomic switch, an appended log.

A findings row belongs to one bucket, by a hash of its fingerprint (its id if it has none). A version
is a manifest: for each bucket the folder that holds its rows, and the folders of the audit log. A
change reads and writes only the buckets that it touches, appends its audit rows as one more folder,
and then writes the manifest of the next version, which is the only thing that readers look at. A job
that fails before leaves files that no manifest names. A manifest also remembers the last batch of
each stream, so a batch that is handed over again changes nothing.

There is one writer at a time; a second one that started from the same version fails at its manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.operators.findings import (
    created_audit,
    delete_findings,
    merged_rows,
    update_findings,
)
from vetgrid.schemas import AUDIT_LOG, FINDINGS
from vetgrid.session import stage_table

BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    """What a version consists of; folders are relative to the table."""

    version: int
    buckets: int
    findings: dict[int, str] = field(default_factory=dict)
    audit: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "audit": list(self.audit),
                           "findings": {str(k): v for k, v in sorted(self.findings.items())},
                           "batches": self.batches}, sort_keys=True)


def _parsed(text: str) -> Manifest:
    raw = json.loads(text)
    return Manifest(raw["version"], raw["buckets"], {int(k): v for k, v in raw["findings"].items()},
                    tuple(raw["audit"]), raw["batches"])


@dataclass(frozen=True)
class FindingsTable:
    """One version of a table. Changes return the next version; this one stays readable until swept."""

    spark: SparkSession
    folder: str
    manifest: Manifest

    # -- reading --------------------------------------------------------------------------

    def findings(self, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = [f"{self.folder}/{p}" for b, p in self.manifest.findings.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], FINDINGS)
        return self.spark.read.schema(FINDINGS).parquet(*paths)

    def audit(self) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in self.manifest.audit]
        return self.spark.read.schema(AUDIT_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], AUDIT_LOG)

    def bucket(self, fingerprint: Column, finding_id: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(fingerprint, finding_id)), F.lit(self.manifest.buckets)).cast("int")

    # -- changes --------------------------------------------------------------------------

    def merge(self, candidates: DataFrame, now: Column, *, stream: str | None = None,
              batch_id: int | None = None) -> FindingsTable:
        """Next version with a batch of candidates merged in (see ``merged_rows``).

        With ``stream`` and ``batch_id``, a batch that a version already holds is not merged again.
        """
        if stream is not None and self.manifest.batches.get(stream, -1) >= batch_id:
            return self
        staged = stage_table(candidates, "candidates")
        fresh = F.col("fingerprint").isNotNull()
        touched = self._listed(staged.filter(fresh).select(self.bucket(F.col("fingerprint"), F.col("fingerprint"))))
        # Rows without a fingerprint match nothing that is stored: they are added to a folder of their bucket.
        merged = merged_rows(self.findings(touched), staged, now)
        batches = {**self.manifest.batches, **({stream: batch_id} if stream is not None else {})}
        loose = not staged.filter(~fresh).isEmpty()
        if loose:  # their buckets are known when their ids are
            merged = stage_table(merged, "merged")
            more = self._listed(merged.filter("fingerprint is null").select(self.bucket(F.col("fingerprint"), F.col("id"))))
            merged = merged.unionByName(self.findings(more - touched).withColumn("created", F.lit(False)))
            touched |= more
        return self._commit(merged, touched, lambda rows: created_audit(rows, now), batches)

    def update(self, updates: DataFrame, now: Column) -> FindingsTable:
        """Next version with triage updates replayed (see ``update_findings``)."""
        staged = stage_table(updates, "updates")
        touched = self._holding(staged.select(F.col("finding_id").alias("id")))
        change = update_findings(self.findings(touched), staged, now)
        return self._commit(change.findings, touched, lambda _: change.audit, self.manifest.batches)

    def delete(self, ids: DataFrame) -> FindingsTable:
        """Next version without the listed findings. Their log goes too, so it is written anew."""
        gone = stage_table(ids.select("id").distinct(), "deleted")
        touched = self._holding(gone)
        left = delete_findings(self.findings(touched), self.audit(), gone)
        return self._commit(left.findings, touched, lambda _: left.audit, self.manifest.batches, whole_log=True)

    def _listed(self, buckets: DataFrame) -> set[int]:
        """Distinct bucket numbers; there are never more than the table has buckets."""
        return {r[0] for r in buckets.distinct().collect()}

    def _holding(self, ids: DataFrame) -> set[int]:
        rows = self.findings().select("id", self.bucket(F.col("fingerprint"), F.col("id")).alias("bucket"))
        return self._listed(rows.join(ids, "id", "left_semi").select("bucket"))

    def _commit(self, rows: DataFrame, touched: set[int], audit: Callable[[DataFrame], DataFrame],
                batches: dict[str, int], whole_log: bool = False) -> FindingsTable:
        last, version = self.manifest, self.manifest.version + 1
        name = f"v{version}-{uuid.uuid4().hex[:8]}"  # a failed attempt leaves a folder of its own
        target = f"{self.folder}/findings/{name}"
        placed = rows.withColumn("bucket", self.bucket(F.col("fingerprint"), F.col("id")))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(target)
        written = self.spark.read.schema(f"{FINDINGS}, created BOOLEAN, bucket INT").parquet(target)
        held = self._listed(written.select("bucket"))
        assert held <= touched
        audit(written).write.parquet(f"{self.folder}/audit/{name}")
        kept = {b: p for b, p in last.findings.items() if b not in touched}
        log = () if whole_log else last.audit
        manifest = Manifest(version, last.buckets, kept | {b: f"findings/{name}/bucket={b}" for b in held},
                            (*log, f"audit/{name}"), batches)
        _write_manifest(self.spark, self.folder, manifest)
        return FindingsTable(self.spark, self.folder, manifest)

    # -- old versions -----------------------------------------------------------------------

    def sweep(self, keep: int = 2) -> list[str]:
        """Delete what only versions before the last ``keep`` ones name; the folders that went."""
        versions = sorted(_manifests(self.spark, self.folder), key=lambda m: m.version)
        old, new = versions[:-keep], versions[-keep:]

        def named(manifests: list[Manifest]) -> set[str]:
            return reduce(set.union, ({*m.findings.values(), *m.audit} for m in manifests), set())

        gone = sorted(named(old) - named(new)) + [f"manifest/{m.version}" for m in old]
        for path in gone:
            _delete(self.spark, f"{self.folder}/{path}")
        return gone


def _write_manifest(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    row = spark.createDataFrame([(manifest.text(),)], "value STRING").coalesce(1)
    row.write.mode("error").text(f"{folder}/manifest/{manifest.version}")


def _manifests(spark: SparkSession, folder: str) -> list[Manifest]:
    rows = spark.read.option("wholetext", True).text(f"{folder}/manifest/*")
    return [_parsed(r.value) for r in rows.collect() if r.value]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def create_table(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> FindingsTable:
    """An empty table. A bucket should hold some hundred megabytes at the size that is expected."""
    folder = folder.rstrip("/")
    manifest = Manifest(0, buckets)
    _write_manifest(spark, folder, manifest)
    return FindingsTable(spark, folder, manifest)


def open_table(spark: SparkSession, folder: str, version: int | None = None) -> FindingsTable:
    """The last version of a table, or a given one that has not been swept."""
    folder = folder.rstrip("/")
    found = _manifests(spark, folder)
    wanted = [m for m in found if version is None or m.version == version]
    if not wanted:
        raise ValueError(f"no version {'' if version is None else version} in {folder}")
    return FindingsTable(spark, folder, max(wanted, key=lambda m: m.version))
