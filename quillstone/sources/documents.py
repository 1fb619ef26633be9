"""Documents from files: ingestion of PDF bytes, re-reads, parser routing and the checks on what a parser returns.

files: path, content (bytes), as `spark.read.format("binaryFile")` gives them. Parsers are replaceable: anything with id,
version and transform(documents) -> pages (document_id, page_number, text, visual, warnings).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.structure import _out_of_order, _violation

SIGNATURE = b"%PDF-"


class Parser(Protocol):
    """A reader of documents. Its pages may come from built-in functions, mapInArrow or another system."""

    id: str
    version: str

    def transform(self, documents: DataFrame) -> DataFrame: ...


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file below a folder, in any store that Spark opens."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def filename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def ingest(files: DataFrame, source_type: str = "native") -> DataFrame:
    """One row for each file: document_id, original_filename, byte_size, content_hash, source_type, and rejected, the first
    rule that it breaks (null where it is taken). A document's id is the hash of its path and content, so a second run gives it again."""
    name = filename(F.col("path"))
    rejected = (
        F.when(~F.lower(name).endswith(".pdf"), "UNSUPPORTED_EXTENSION")
        .when(~F.coalesce(F.substring("content", 1, 5) == F.lit(bytearray(SIGNATURE)), F.lit(False)), "INVALID_PDF_SIGNATURE")
        .when(~T.valid_filename(name), "INVALID_FILENAME")
    )
    known = files.withColumn("content_hash", F.sha2("content", 256))
    return known.select(
        T.tagged_hash("doc-", F.encode("path", "UTF-8"), F.encode("content_hash", "UTF-8")).alias("document_id"), "path", name.alias("original_filename"),
        F.octet_length("content").cast("long").alias("byte_size"), "content_hash", F.lit(source_type).alias("source_type"), rejected.alias("rejected"),
    )


def ingest_expected(files: DataFrame, expected: DataFrame) -> DataFrame:
    """ingest(), and SOURCE_CHANGED for files whose hash isn't the one observed before. expected: path, expected_hash."""
    seen = ingest(files).join(expected.select("path", "expected_hash"), "path", "left")
    return seen.withColumn("rejected", F.coalesce("rejected", F.when(F.col("expected_hash") != F.col("content_hash"), "SOURCE_CHANGED"))).drop("expected_hash")


def received_runs(ingested: DataFrame, created_at: Column) -> DataFrame:
    """The first row of a run for each document that was taken."""
    return ingested.where("rejected is null").select(
        T.tagged_hash("run-", F.encode("document_id", "UTF-8"), F.encode(created_at.cast("string"), "UTF-8")).alias("run_id"), "document_id",
        F.lit("received").alias("state"), F.lit(1).alias("state_version"), F.lit("1.0").alias("pipeline_version"), created_at.alias("created_at"), created_at.alias("updated_at"),
        F.lit(False).alias("cancellation_requested"), F.lit(True).alias("resumable"),
    )


def changed_sources(ingested: DataFrame, again: DataFrame) -> DataFrame:
    """Documents whose bytes, read once more, are gone or have another size or hash."""
    now = again.select("path", F.octet_length("content").cast("long").alias("size_now"), F.sha2("content", 256).alias("hash_now"))
    met = ingested.where("rejected is null").join(now, "path", "left")
    code = F.when(F.col("hash_now").isNull(), "SOURCE_MISSING").when(F.col("size_now") != F.col("byte_size"), "SOURCE_SIZE_CHANGED").when(F.col("hash_now") != F.col("content_hash"), "SOURCE_HASH_CHANGED")
    return met.select("document_id", code.alias("code")).where("code is not null")


def parse(documents: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """Each document's pages from the parser for its source type; the parser's id and version come along."""
    out = None
    for kind, parser in parsers.items():
        pages = parser.transform(documents.where(F.col("source_type") == kind)).select("document_id", "page_number", "text", "visual", "warnings")
        pages = pages.withColumns({"source_type": F.lit(kind), "parser_id": F.lit(parser.id), "parser_version": F.lit(parser.version)})
        out = pages if out is None else out.unionByName(pages)
    return out


def mark_blank(pages: DataFrame) -> DataFrame:
    """Blank pages are sent to visual processing with a warning."""
    blank = T.trimmed(F.col("text")) == ""
    warnings = F.when(blank, F.array_union("warnings", F.array(F.lit("NO_NATIVE_TEXT")))).otherwise(F.col("warnings"))
    return pages.withColumns({"visual": F.col("visual") | blank, "warnings": warnings})


def blank_documents(pages: DataFrame) -> DataFrame:
    """Documents without a single page of text, which get a warning of their own."""
    return pages.groupBy("document_id").agg(F.bool_and(T.trimmed(F.col("text")) == "").alias("blank")).where("blank").select("document_id", F.lit("NO_NATIVE_TEXT_IN_DOCUMENT").alias("warning"))


def requires_ocr(pages: DataFrame) -> DataFrame:
    """Native documents with a page that text alone doesn't give."""
    return pages.groupBy("document_id").agg(F.bool_or((F.col("source_type") == "native") & F.col("visual")).alias("requires_ocr"))


def ocr_text(pages: DataFrame) -> DataFrame:
    """The canonical text of a scanned document: its pages in order, with a form feed between."""
    grouped = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("x"))
    return grouped.select("document_id", F.array_join("x.text", "\f").alias("text"))


def parser_violations(pages: DataFrame, documents: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """What in parsed pages doesn't fit their documents: identity, provenance, page order and blank pages."""
    stage = "parse"
    met = pages.join(documents.select("document_id", F.col("source_type").alias("declared")), "document_id", "left")
    known = F.lit(False)
    for kind, p in parsers.items():
        known = known | ((F.col("source_type") == kind) & (F.col("parser_id") == p.id) & (F.col("parser_version") == p.version))
    unmarked = (T.trimmed(F.col("text")) == "") & (~F.col("visual") | ~F.array_contains("warnings", "NO_NATIVE_TEXT"))
    return (
        _violation(met.where("declared is null"), stage, "FOREIGN_DOCUMENT")
        .union(_violation(met.where(~F.coalesce(known, F.lit(False))), stage, "PARSER_IDENTITY"))
        .union(_violation(met.where("declared <> source_type"), stage, "SOURCE_TYPE_CHANGED"))
        .union(_violation(_out_of_order(pages), stage, "PAGES_OUT_OF_ORDER"))
        .union(_violation(pages.where(unmarked), stage, "BLANK_PAGE_UNMARKED"))
    )
