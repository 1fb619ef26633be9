"""Documents to training ids in five stages; each reads all that the one before kept.

Every stage judges rows, not doc_ids: rows that share a doc_id, or have none, are decided by their own text and metadata. Nulls
in any column are allowed, a null text is an empty one; an empty table gives an empty one; columns beyond those of documents
are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, cotrain, decontaminate, recompress, tensor_minhash
from quillstone.llm.common import Stages, keyed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the co-trained classifier finds poor or toxic. Empty texts are judged like others; without labels every row stays."""
    return cotrain.classify(docs, table(spark, sf_dir, "labels"), with_docs=True).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, 0.8): that with the least doc_id (null last), of equal ones the first.
    Texts without words have no near duplicate: each such row stays."""
    rows = keyed(docs.select(*COLUMNS), Stages(spark, "near-rows"))
    found = tensor_minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), size=5, percent=80)
    member = rows.select("row", "doc_id").join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    best = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x"))
    return rows.join(best.select("x.row"), "row", "left_semi").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of windows of 35 that stand anywhere else, so that what is left may be empty; texts without any stay as they are, null as null."""
    rows = keyed(docs.select(*COLUMNS), Stages(spark, "substring-rows"))
    found = recompress.substring_dedup(rows.select(F.col("row").alias("doc_id"), "text"), with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("row"), "kept_text")
    text = F.when(F.col("kept_text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    out = rows.join(found, "row", "left").withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark window; texts without words hold none."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return found.where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids; null and empty texts have none."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("substring dedup", substrings), ("decontamination", contamination), ("bpe", encode)]

#: A trained classifier comes first, which SQL can't express; tests/llm/test_pipeline_rows.py holds stages 2 to 5 against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written, then read again as the next one's documents."""
    docs, written = table(spark, sf_dir, "documents"), Stages(spark, "pipeline")
    for name, stage in STAGES:
        docs = written.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
