"""Files, parsers, artifacts and wire results: documents stand for files, their text behind a PDF's signature."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.plans.registry import query, table
from quillstone.sources import documents, store

_PATH = "concat('/in/', CASE doc_id % 6 WHEN 0 THEN concat('a', doc_id, '.txt') WHEN 1 THEN concat('b', doc_id, '.PDF') ELSE concat('c', doc_id, '.pdf') END)"
_CONTENT = "concat(CASE WHEN doc_id % 5 = 3 THEN '%PDX-' ELSE '%PDF-' END, text)"
_REJECTED = "CASE WHEN doc_id % 6 = 0 THEN 'UNSUPPORTED_EXTENSION' WHEN doc_id % 5 = 3 THEN 'INVALID_PDF_SIGNATURE' END"
_ID = f"'doc-' || sha256({_PATH} || sha256({_CONTENT}))"


def _files(spark, d, content: str = _CONTENT):
    return table(spark, d, "documents").selectExpr(f"{_PATH} AS path", f"encode({content}, 'UTF-8') AS content")


@query(f"SELECT {_ID} AS document_id, {_PATH} AS path, substr({_PATH}, 5) AS original_filename, strlen({_CONTENT}) AS byte_size, sha256({_CONTENT}) AS content_hash, 'native' AS source_type, {_REJECTED} AS rejected FROM documents")
def ingested_files(spark, d):
    return documents.ingest(_files(spark, d))


@query(f"SELECT {_PATH} AS path, coalesce({_REJECTED}, CASE WHEN doc_id % 7 = 2 AND {_PATH} NOT LIKE '%9.pdf' THEN 'SOURCE_CHANGED' END) AS rejected FROM documents")
def expected_files(spark, d):
    expected = table(spark, d, "documents").selectExpr(f"{_PATH} AS path", f"CASE WHEN doc_id % 7 = 2 THEN 'other' ELSE sha2({_CONTENT}, 256) END AS expected_hash").where("path not like '%9.pdf'")
    return documents.ingest_expected(_files(spark, d), expected).select("path", "rejected")


@query(f"SELECT 'run-' || sha256({_ID} || '2024-01-01 00:00:00') AS run_id, {_ID} AS document_id, 'received' AS state, 1 AS state_version, true AS resumable FROM documents WHERE {_REJECTED} IS NULL")
def received_runs(spark, d):
    return documents.received_runs(documents.ingest(_files(spark, d)), F.lit("2024-01-01 00:00:00").cast("timestamp")).select("run_id", "document_id", "state", "state_version", "resumable")


@query(f"SELECT {_ID} AS document_id, CASE doc_id % 8 WHEN 1 THEN 'SOURCE_MISSING' WHEN 2 THEN 'SOURCE_SIZE_CHANGED' ELSE 'SOURCE_HASH_CHANGED' END AS code FROM documents WHERE {_REJECTED} IS NULL AND doc_id % 8 IN (1, 2, 4)")
def changed_sources(spark, d):
    again = _files(spark, d, f"CASE doc_id % 8 WHEN 2 THEN concat({_CONTENT}, '!') WHEN 4 THEN reverse({_CONTENT}) ELSE {_CONTENT} END").join(table(spark, d, "documents").where("doc_id % 8 <> 1").selectExpr(f"{_PATH} AS path"), "path", "left_semi")
    return documents.changed_sources(documents.ingest(_files(spark, d)), again)


class _Turns:
    """Turns as pages, by built-in functions: a parser for tables that hold text already."""

    version = "1"

    def __init__(self, id_: str, turns):
        self.id, self.turns = id_, turns

    def transform(self, docs):
        return documents.mark_blank(self.turns.join(docs.select("document_id"), "document_id", "left_semi"))


def _parsed(spark, d):
    turns = table(spark, d, "conversations").selectExpr("concat('', conv_id) AS document_id", "turn + 1 AS page_number", "CASE WHEN conv_id % 9 = 4 THEN ' ' WHEN conv_id % 9 = 5 AND turn = 0 THEN chr(10) ELSE text END AS text", "false AS visual").withColumn("warnings", F.array().cast("array<string>"))
    docs = turns.select("document_id").distinct().selectExpr("document_id", "CASE WHEN CAST(document_id AS BIGINT) % 2 = 0 THEN 'native' ELSE 'ocr' END AS source_type")
    parsers = {"native": _Turns("turns", turns), "ocr": _Turns("scans", turns)}
    return documents.parse(docs, parsers), docs, parsers


_BLANK = "conv_id % 9 = 4 OR (conv_id % 9 = 5 AND turn = 0)"


@query(f"SELECT concat('', conv_id) AS document_id, turn + 1 AS page_number, CASE WHEN conv_id % 2 = 0 THEN 'turns' ELSE 'scans' END AS parser_id, {_BLANK} AS visual, CASE WHEN {_BLANK} THEN 'NO_NATIVE_TEXT' ELSE '' END AS warnings FROM conversations")
def parsed_pages(spark, d):
    return _parsed(spark, d)[0].select("document_id", "page_number", "parser_id", "visual", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT concat('', conv_id) AS document_id, 'NO_NATIVE_TEXT_IN_DOCUMENT' AS warning FROM conversations WHERE conv_id % 9 = 4 GROUP BY conv_id")
def blank_documents(spark, d):
    return documents.blank_documents(_parsed(spark, d)[0])


@query("SELECT concat('', conv_id) AS document_id, sha256(string_agg(CASE WHEN conv_id % 9 = 4 THEN ' ' WHEN conv_id % 9 = 5 AND turn = 0 THEN chr(10) ELSE text END, chr(12) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id")
def ocr_texts(spark, d):
    return documents.ocr_text(_parsed(spark, d)[0]).select("document_id", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT DISTINCT 'parse' AS stage, document_id, code FROM (SELECT concat('', conv_id) AS document_id, CASE conv_id % 6 WHEN 0 THEN 'FOREIGN_DOCUMENT' WHEN 1 THEN 'PARSER_IDENTITY' WHEN 2 THEN 'SOURCE_TYPE_CHANGED' WHEN 3 THEN 'PAGES_OUT_OF_ORDER' ELSE 'BLANK_PAGE_UNMARKED' END AS code FROM conversations WHERE turn = 1 AND conv_id % 6 < 5)
 UNION SELECT 'parse', concat('', conv_id), 'PARSER_IDENTITY' FROM conversations WHERE turn = 1 AND conv_id % 6 = 2""")
def parser_violations(spark, d):
    pages, docs, parsers = _parsed(spark, d)
    kind, second = F.col("document_id").cast("long") % 6, F.col("page_number") == 2
    broken = pages.withColumns({
        "parser_version": F.when((kind == 1) & second, "2").otherwise(F.col("parser_version")), "source_type": F.when((kind == 2) & second, F.when(F.col("source_type") == "ocr", "native").otherwise("ocr")).otherwise(F.col("source_type")),
        "text": F.when((kind == 4) & second, " ").otherwise(F.col("text")), "visual": F.when((kind == 4) & second, False).otherwise(F.col("visual")),
    }).withColumn("page_number", F.when((kind == 3) & second, 7).otherwise(F.col("page_number")))
    several = pages.where("page_number = 2").select("document_id")
    known = docs.join(several.where("document_id % 6 = 0"), "document_id", "left_anti")
    return documents.parser_violations(broken, known, parsers)


_ARTIFACT = """concat('{"document_id":"d', o_custkey, '","n":', o_orderkey, '}')"""


@query("SELECT o_orderkey AS run_id, CASE o_orderkey % 7 WHEN 0 THEN 'UNKNOWN_RUN' WHEN 1 THEN 'HASH_MISMATCH' WHEN 2 THEN 'DOCUMENT_MISMATCH' ELSE 'VERSION_MISMATCH' END AS code FROM orders WHERE o_orderkey % 7 < 4")
def artifact_violations(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS run_id", "concat('d', o_custkey) AS document_id", "o_orderkey AS n")
    made = store.artifact(rows, "run_id", "document_id", "1.0.0", F.struct("document_id", "n"))
    kind = F.col("run_id") % 7
    stored = made.withColumns({"artifact": F.when(kind == 1, F.concat("artifact", F.lit(" "))).otherwise(F.col("artifact")), "version": F.when(kind == 3, "0.9.0").otherwise(F.col("version"))})
    runs = rows.where("run_id % 7 <> 0").selectExpr("run_id", "CASE WHEN run_id % 7 = 2 THEN 'other' ELSE document_id END AS document_id")
    return store.artifact_violations(stored, runs, "1.0.0")


@query(f"SELECT o_orderkey AS run_id, {_ARTIFACT} AS artifact, sha256({_ARTIFACT}) AS artifact_hash FROM orders")
def stored_artifacts(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS run_id", "concat('d', o_custkey) AS document_id", "o_orderkey AS n")
    return store.artifact(rows, "run_id", "document_id", "1.0.0", F.struct("document_id", "n")).select("run_id", "artifact", "artifact_hash")


_BODY = """CASE event_id % 4 WHEN 0 THEN concat('{"job_id":"j', event_id, '"}') WHEN 1 THEN concat('{"job_id":"', repeat('x', 90), '"}') WHEN 2 THEN '{"job_id":' ELSE '[1]' END"""


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'j' || event_id END AS job_id, CASE event_id % 4 WHEN 1 THEN 'TOO_LARGE' WHEN 2 THEN 'INVALID_JSON' WHEN 3 THEN 'INVALID_JSON' END AS rejected FROM events")
def bounded_bodies(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", f"{_BODY} AS body")
    return store.bounded_json(rows, "body", "job_id string", 64).select("event_id", "parsed.job_id", "rejected")


@query("""WITH c AS (SELECT conv_id, turn, text || ' p. ' || (turn + 1) AS line FROM conversations), p AS (SELECT *, sum(strlen(line) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS used FROM c)
 SELECT conv_id, count(*) AS n_claims, sha256(string_agg(line, chr(10) || chr(10) ORDER BY turn)) AS text_sha256, max(used) <= 900 AS fits FROM p WHERE used <= 1400 GROUP BY 1""".replace("max(used) <= 900 AS fits", "strlen('{\"media_type\":\"text/plain\",\"text\":\"\",\"n_claims\":}') + max(used) + strlen(CAST(count(*) AS VARCHAR)) + 2 * (count(*) - 1) + sum(length(line) - length(replace(replace(replace(line, chr(10), ''), '\"', ''), '\\', ''))) <= 1000 AS fits"))
def wire_results(spark, d):
    claims = table(spark, d, "conversations").selectExpr("conv_id", "turn", "concat(text, ' p. ', turn + 1) AS line")
    return store.wire_results(claims, "conv_id", ["turn"], "line", 1400, 1000).select("conv_id", "n_claims", F.sha2("text", 256).alias("text_sha256"), "fits")


