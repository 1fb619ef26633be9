"""Claims against their evidence: citations, guards, and how bounds follow from bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import guards as G
from quillstone.functions import text as T


def entails(source: Column, claim: Column, order: Column) -> Column:
    """Whether a bound (<, <=, >, >=, =, !=) on a value follows from another: every number that the source allows, the claim allows.

    order: -1, 0 or 1 as the source's value is less than, equal to or greater than the claim's.
    """
    strictly = F.when(claim.isin("<", "<="), order < 0).otherwise(order > 0)
    same = (order == 0) & ((source == claim) | (source.isin("<", ">")) | (claim.isin("<=", ">=")))
    side = lambda s, c: source.isin(*s) & claim.isin(*c)
    apart = F.when(source == "=", order != 0).when(source == "!=", order == 0).when(source == "<", order <= 0).when(source == "<=", order < 0).when(source == ">", order >= 0).otherwise(order > 0)
    return F.when(claim == "!=", apart).when(source == "!=", False).when(claim == "=", (source == "=") & (order == 0)).when(side(("<", "<=", "="), ("<", "<=")) | side((">", ">=", "="), (">", ">=")), strictly | same).otherwise(False)


def _guard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        told = [",".join(G.broken(c or "", e)) if s else None for c, e, s in zip(b.column("text").to_pylist(), b.column("quotes").to_pylist(), b.column("supported").to_pylist())]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("document_id", "claim_id", "supported")], pa.array(told, pa.string())], ["document_id", "claim_id", "supported", "broken"])


def guarded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (document_id, claim_id, text, evidence_ids, verdict) with their verdict after the guards: supported ones that break a
    guard become unsupported, `broken` names which; a claim that cites unknown evidence has code UNKNOWN_EVIDENCE and keeps its verdict.

    One shuffle joins the cited quotes; only supported claims are read by the guards.
    """
    cited = claims.select("document_id", "claim_id", F.posexplode("evidence_ids").alias("i", "evidence_id")).join(evidence.select("document_id", "evidence_id", "quote"), ["document_id", "evidence_id"], "left")
    g = cited.groupBy("document_id", "claim_id").agg(F.sort_array(F.collect_list(F.struct("i", "quote"))).alias("x"), F.bool_or(F.col("quote").isNull()).alias("unknown"))
    met = claims.join(g, ["document_id", "claim_id"], "left").withColumn("supported", (F.col("verdict") == "supported") & ~F.coalesce("unknown", F.lit(False)))
    read = met.select("document_id", "claim_id", "text", F.coalesce(F.transform("x", lambda r: F.coalesce(r["quote"], F.lit(""))), F.array().cast("array<string>")).alias("quotes"), "supported").mapInArrow(
        _guard, "document_id string, claim_id string, supported boolean, broken string"
    )
    both = read.join(met.select("document_id", "claim_id", "verdict", "unknown"), ["document_id", "claim_id"])
    return both.select("document_id", "claim_id", F.when(F.col("broken") != "", "unsupported").otherwise(F.col("verdict")).alias("verdict"), F.nullif("broken", F.lit("")).alias("broken"), F.when(F.col("unknown"), "UNKNOWN_EVIDENCE").alias("code"))


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each citation of a claim, in order, with its label and quote."""
    rows = claims.select("document_id", "claim_id", F.posexplode("evidence_ids").alias("i", "evidence_id"))
    met = rows.join(evidence.select("document_id", "evidence_id", "page_start", "page_end", "quote"), ["document_id", "evidence_id"])
    return met.select("document_id", "claim_id", "i", "evidence_id", T.source_label(F.col("page_start"), F.col("page_end")).alias("label"), "quote")


def citation_violations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(document_id, code): claims without text or citation, ids that stand twice, evidence cited twice, unknown or never cited."""
    rows = claims.select("document_id", "claim_id", F.explode("evidence_ids").alias("evidence_id"))
    coded = lambda df, code: df.select("document_id", F.lit(code).alias("code")).distinct()
    return (
        coded(claims.where((T.trimmed(F.col("text")) == "") | (T.trimmed(F.col("claim_id")) == "")), "BLANK_CLAIM").union(coded(claims.where("size(evidence_ids) = 0"), "NO_CITATION"))
        .union(coded(claims.groupBy("document_id", "claim_id").agg(F.count("*").alias("n")).where("n > 1"), "CLAIM_TWICE")).union(coded(claims.where("size(array_distinct(evidence_ids)) < size(evidence_ids)"), "EVIDENCE_TWICE"))
        .union(coded(rows.join(evidence.select("document_id", "evidence_id"), ["document_id", "evidence_id"], "left_anti"), "UNKNOWN_EVIDENCE"))
        .union(coded(evidence.join(rows, ["document_id", "evidence_id"], "left_anti"), "UNUSED_EVIDENCE"))
    )
