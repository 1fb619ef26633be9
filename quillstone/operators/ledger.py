"""A ledger of requests that are each made once: reserved, submitted, completed, acknowledged; and corrections of scanned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

KEY = ["owner_id", "stage", "ordinal"]
STATES = ("reserved", "submitted", "completed", "acknowledged")
TEXT_BYTES = 262_144
CORRECTED = "OPERATOR_CORRECTED_TEXT"


def _digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def reserve(requests: DataFrame, ledger: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New reservations, and for each request (key, semantic_hash, expires_at) why it is refused (null where it stands).

    The first of several requests for a key, by their hash, is kept; one with another hash than what is there is a conflict.
    """
    stood = ledger.select(*KEY, F.col("semantic_hash").alias("stored"))
    valid = _digest(F.col("semantic_hash")) & (F.col("expires_at") > now) & (F.trim("owner_id") != "")
    first = requests.where(valid).groupBy(*KEY).agg(F.min(F.struct("semantic_hash", "expires_at")).alias("x")).select(*KEY, F.col("x.semantic_hash").alias("kept"), F.col("x.expires_at").alias("kept_until"))
    met = requests.join(stood, KEY, "left").join(first, KEY, "left")
    code = F.when(~valid, "INVALID_INPUT").when(F.coalesce("stored", "kept") != F.col("semantic_hash"), "SEMANTIC_CONFLICT")
    fresh = first.join(ledger.select(*KEY), KEY, "left_anti").select(*KEY, F.col("kept").alias("semantic_hash"), F.col("kept_until").alias("expires_at"), F.lit("reserved").alias("state"))
    return fresh, met.select(*KEY, "semantic_hash", code.alias("code"))


def submit(requests: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """For each request (key, request_hash) the state that its entry has then, or why it stays as it is."""
    met = requests.join(ledger.select(*KEY, "state", "expires_at", F.col("request_hash").alias("stored")), KEY, "left")
    code = (
        F.when(F.col("state").isNull(), "NOT_RESERVED").when(~_digest(F.col("request_hash")), "INVALID_INPUT").when(F.col("stored") != F.col("request_hash"), "SUBMISSION_CONFLICT")
        .when((F.col("state") == "reserved") & (F.col("expires_at") <= now), "EXPIRED")
    )
    return met.select(*KEY, code.alias("code"), F.when(code.isNull() & (F.col("state") == "reserved"), "submitted").otherwise(F.col("state")).alias("state"))


def complete(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """For each request (key, request_hash, completion as JSON): the same completion again changes nothing, another is a conflict."""
    met = requests.join(ledger.select(*KEY, "state", F.col("request_hash").alias("stored"), "completion_hash"), KEY, "left")
    told = F.sha2("completion", 256)
    code = (
        F.when(F.col("state").isNull(), "NOT_RESERVED").when(~F.col("stored").eqNullSafe(F.col("request_hash")), "SUBMISSION_CONFLICT").when(F.col("state") == "reserved", "INVALID_TRANSITION")
        .when(F.col("state").isin("completed", "acknowledged") & (F.col("completion_hash") != told), "COMPLETION_CONFLICT")
    )
    return met.select(*KEY, code.alias("code"), F.when(code.isNull() & (F.col("state") == "submitted"), "completed").otherwise(F.col("state")).alias("state"), F.when(code.isNull(), told).otherwise(F.col("completion_hash")).alias("completion_hash"))


def acknowledge(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Only what is completed can be acknowledged; once more is no error."""
    met = requests.join(ledger.select(*KEY, "state"), KEY, "left")
    code = F.when(F.col("state").isNull(), "NOT_RESERVED").when(~F.col("state").isin("completed", "acknowledged"), "INVALID_TRANSITION")
    return met.select(*KEY, code.alias("code"), F.when(code.isNull(), "acknowledged").otherwise(F.col("state")).alias("state"))


def backward_steps(history: DataFrame) -> DataFrame:
    """Entries whose recorded states (key, at, state) ever went back: the ledger only goes forward."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    before = F.lag(rank).over(Window.partitionBy(*KEY).orderBy("at"))
    return history.withColumn("back", rank < before).where("back").select(*KEY).distinct()


def correct(edits: DataFrame, pages: DataFrame, limit: int = TEXT_BYTES) -> DataFrame:
    """document_id and why its edits (document_id, page_number, text) can't be taken, or null: known pages once each, text that isn't
    blank and has no NUL, something changed, all pages together within the limit in bytes."""
    asked = edits.join(pages.select("document_id", "page_number", F.col("text").alias("stood")), ["document_id", "page_number"], "left")
    g = asked.groupBy("document_id").agg(
        F.count("*").alias("n"), F.countDistinct("page_number").alias("d"), F.bool_or(F.col("stood").isNull()).alias("unknown"),
        F.bool_or((T.trimmed(F.col("text")) == "") | F.col("text").contains("\0")).alias("blank"), F.bool_or(F.col("text") != F.col("stood")).alias("changed"),
        F.sum(F.octet_length("text") - F.octet_length("stood")).alias("grown"),
    )
    total = pages.groupBy("document_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    met = g.join(total, "document_id", "left")
    code = (
        F.when(F.col("n") != F.col("d"), "DUPLICATE_PAGE").when(F.col("unknown"), "UNKNOWN_PAGE").when(F.col("blank"), "INVALID_TEXT").when(~F.col("changed"), "NOTHING_CHANGED").when(F.col("bytes") + F.col("grown") > limit, "TOO_LARGE")
    )
    return met.select("document_id", code.alias("code"), (F.col("bytes") + F.col("grown")).alias("bytes"))


def save(requests: DataFrame, runs: DataFrame, hashes: DataFrame, corrections: DataFrame) -> DataFrame:
    """requests (run_id, expected_version, source_hash) as successor runs, or why not: stale source, or corrected before by another edit."""
    met = requests.join(runs.select("run_id", "document_id", "state_version"), "run_id", "left").join(hashes.select("document_id", "parsed_hash"), "document_id", "left")
    met = met.join(corrections.select(F.col("source_document_id").alias("document_id"), F.col("run_id").alias("successor"), "corrected_hash"), "document_id", "left")
    code = (
        F.when(F.col("state_version").isNull(), "NOT_ALLOWED").when((F.col("state_version") != F.col("expected_version")) | (F.col("parsed_hash") != F.col("source_hash")), "STALE_SOURCE")
        .when(F.col("successor").isNotNull() & (F.col("corrected_hash") != F.col("new_hash")), "ALREADY_CORRECTED")
    )
    fresh = T.tagged_hash("run-", F.encode(F.col("run_id").cast("string"), "UTF-8"), F.encode("new_hash", "UTF-8"))
    return met.select("run_id", code.alias("code"), F.when(code.isNull(), F.coalesce("successor", fresh)).alias("corrected_run_id"))


def reviews(runs: DataFrame, corrections: DataFrame) -> DataFrame:
    """For each run the run that it corrects, and the run that corrects it."""
    of = corrections.select("document_id", F.col("source_run_id").alias("correction_of"))
    by = corrections.select(F.col("source_document_id").alias("document_id"), F.col("run_id").alias("corrected_by"))
    return runs.select("run_id", "document_id").join(of, "document_id", "left").join(by, "document_id", "left").select("run_id", "correction_of", "corrected_by")


def with_corrections(pages: DataFrame, corrected: DataFrame) -> DataFrame:
    """What a parser gave, with stored corrections (document_id, page_number, text) in its place and a warning where one is."""
    met = pages.join(corrected.select("document_id", "page_number", F.col("text").alias("better")), ["document_id", "page_number"], "left")
    return met.select("document_id", "page_number", F.coalesce("better", "text").alias("text"), F.when(F.col("better").isNotNull(), F.lit(CORRECTED)).alias("warning"))
