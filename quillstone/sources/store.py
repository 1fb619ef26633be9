"""Tables that grow by whole commits: what a run writes becomes visible at once, or not at all.

A commit stages its tables under folders of its own and then writes one manifest, the only file that readers look for. Its
name carries the version that it follows, and it is made by a rename that fails where that name stands, so of two writers
one loses. One writer at a time is meant; a lost race shows as CommitConflict.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_TEXT_BYTES, RESULT_JSON_BYTES = 1 << 20, 2 << 20


class CommitConflict(Exception):
    """Another commit came first."""


class Store:
    """Append-only tables below one folder of any store that Spark opens."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """How many commits there are."""
        manifests = self._at(f"{self.path}/manifest")
        return len(self.fs.listStatus(manifests)) if self.fs.exists(manifests) else 0

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Appends all tables, or none; expected: the version that must still be the last."""
        before = self.version()
        if expected is not None and expected != before:
            raise CommitConflict(f"expected version {expected}, found {before}")
        parts = {name: f"{self.path}/{name}/{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(parts[name])
        staged, final = self._at(f"{self.path}/staged/{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest/{before + 1:012d}.json")
        out = self.fs.create(staged, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        self.fs.mkdirs(final.getParent())
        if self.fs.exists(final) or not self.fs.rename(staged, final):
            raise CommitConflict(f"version {before + 1} is taken")
        return before + 1

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, or the last; None where no commit holds it."""
        manifests = self._at(f"{self.path}/manifest")
        if not self.fs.exists(manifests):
            return None
        names = sorted(s.getPath().toString() for s in self.fs.listStatus(manifests))[:version]
        rows = self.spark.read.text(names, wholetext=True).select(F.get_json_object("value", f"$.{name}").alias("part")).where("part is not null")
        parts = [r["part"] for r in rows.collect()]  # one for each commit
        return self.spark.read.parquet(*parts) if parts else None


def artifact(rows: DataFrame, run: str, document: str, version: str, value: Column) -> DataFrame:
    """run_id, document_id, version, artifact (JSON) and its hash, as artifacts are stored."""
    text = F.to_json(value)
    return rows.select(F.col(run).alias("run_id"), F.col(document).alias("document_id"), F.lit(version).alias("version"), text.alias("artifact"), F.sha2(text, 256).alias("artifact_hash"))


def artifact_violations(artifacts: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """Stored artifacts that no longer are what was stored: run_id and the first rule broken."""
    met = artifacts.join(runs.select("run_id", F.col("document_id").alias("of_run")), "run_id", "left")
    code = (
        F.when(F.col("of_run").isNull(), "UNKNOWN_RUN")
        .when(F.sha2("artifact", 256) != F.col("artifact_hash"), "HASH_MISMATCH")
        .when((F.col("of_run") != F.col("document_id")) | (F.get_json_object("artifact", "$.document_id") != F.col("document_id")), "DOCUMENT_MISMATCH")
        .when(F.col("version") != version, "VERSION_MISMATCH")
    )
    return met.select("run_id", code.alias("code")).where("code is not null")


def bounded_json(rows: DataFrame, body: str, schema: str, limit: int) -> DataFrame:
    """Bodies as structs; `rejected` says why there is none: over the limit in bytes, or not such JSON."""
    size = F.octet_length(body)
    parsed = F.when(size <= limit, F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.try_parse_json(body).isNotNull() & F.trim(body).startswith("{")
    return rows.withColumn("parsed", F.when(whole, parsed)).withColumn("rejected", F.when(size > limit, "TOO_LARGE").when(~F.coalesce(whole, F.lit(False)), "INVALID_JSON"))


def claim_prefix(claims: DataFrame, key: str, order: list[str], line: str, text_limit: int = RESULT_TEXT_BYTES) -> DataFrame:
    """The whole claims, from the first on, whose lines with a blank line between stay within the limit in bytes."""
    from quillstone.operators.ordered import prefix_within

    return prefix_within(claims, key, order, F.octet_length(line), text_limit)


def wire_results(claims: DataFrame, key: str, order: list[str], line: str, text_limit: int = RESULT_TEXT_BYTES, json_limit: int = RESULT_JSON_BYTES) -> DataFrame:
    """key, n_claims, text, body (JSON) and fits: whether text and body stay within their limits."""
    kept = claim_prefix(claims, key, order, line, text_limit)
    grouped = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, line))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r[line]), "\n\n")
    told = grouped.select(key, F.size("x").cast("long").alias("n_claims"), text.alias("text"))
    body = F.to_json(F.struct(F.lit("text/plain").alias("media_type"), F.col("text"), F.col("n_claims")))
    return told.withColumn("body", body).withColumn("fits", (F.octet_length("text") <= text_limit) & (F.octet_length("body") <= json_limit))
