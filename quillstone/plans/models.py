"""Steps that ask a model, with one that answers from the requests; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import models, structure
from quillstone.plans.registry import query, table
from quillstone.plans.structure import _outlined


@query()
def page_outcomes(spark, d):
    """No SQL: quotes are cut at the ends of sentences, by rules; tests hold every outcome against fixtures."""
    pages = table(spark, d, "conversations").selectExpr("conv_id AS document_id", "turn + 1 AS page_number", "CASE (conv_id + turn) % 9 WHEN 0 THEN '03/10/03 A-4' WHEN 1 THEN '... --- ***' WHEN 2 THEN 'Scope of the Work' ELSE text END AS text")
    return models.page_outcomes(pages, models.FirstModel())


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn + 1 AS page, length(text) AS n FROM conversations) SELECT concat('', conv_id) AS document_id, page AS page_number, CASE WHEN conv_id % 5 = 1 AND page = 1 THEN 'NO_CHUNK' END AS code FROM c""")
def page_scopes(spark, d):
    outlined = _outlined(spark, d)
    chunks = structure.chunks(outlined, structure.nodes(outlined))
    lost = (F.col("document_id") % 5 == 1) & (F.col("page_number") == 1)
    pages = outlined.select("document_id", "page_number", F.when(lost, "nb-none").otherwise(F.col("block_id")).alias("block_id"))
    return models.page_scopes(pages, chunks).select("document_id", "page_number", "code")


def _claims(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id % 12 AS document_id", "doc_id AS place", "concat('c', doc_id) AS claim_id", "least(length(text), 300) AS size", "left(text, 20) AS text", "array(concat('e', doc_id % 7), concat('e', doc_id % 5)) AS ids")


@query()
def key_point_rounds(spark, d):
    """No SQL: each round's batches follow from the round before; tests hold it against a plain loop."""
    return models.key_points(_claims(spark, d), models.FirstModel(), 2400)


@query()
def merged_claims(spark, d):
    """No SQL: as above."""
    return models.merged(_claims(spark, d).select("document_id", "place", "text", "ids"), models.FirstModel(), 6, 3).select("document_id", "place", "text", F.array_join(F.sort_array("ids"), ",").alias("ids"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS attempts, CASE WHEN p_size + 2 > 256 THEN 'PLAN_TOO_LARGE' WHEN p_partkey % 3 = 2 THEN 'MISSING_REFERENCES' END AS code, CASE WHEN p_partkey % 3 = 0 THEN 'e1,e2' WHEN p_partkey % 3 = 1 THEN 'e2,e1' END AS ids FROM part""")
def repaired_answers(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_size")
    first = rows.selectExpr("p_partkey", "p_size", "CASE WHEN p_partkey % 3 = 0 THEN array('e1', 'e2') ELSE array('e1') END AS ids")
    second = rows.where("p_partkey % 3 > 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 1 THEN array('e2', 'e1') ELSE array('e2') END AS ids")
    return models.repaired(first, second, "p_partkey", F.array(F.lit("e1"), F.lit("e2")), F.col("p_size")).withColumn("ids", F.array_join("ids", ","))


@query("SELECT p_partkey AS document_id, 'c' AS claim_id, CASE WHEN p_partkey % 4 = 1 THEN 'unsupported' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'unsupported' ELSE 'supported' END END AS verdict FROM part")
def trimmed_contributions(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey AS document_id", "'c' AS claim_id", "'it rains' AS text", "p_partkey % 2 = 1 AS trimmed", "array('e1', 'e2') AS evidence_ids", "CASE WHEN p_partkey % 5 = 0 THEN 'unsupported' ELSE 'supported' END AS verdict")
    proof = rows.selectExpr("document_id", "explode(array('e1', 'e2')) AS evidence_id").selectExpr("document_id", "evidence_id", "CASE WHEN document_id % 4 = 1 AND evidence_id = 'e2' THEN 'sun' ELSE 'rain' END AS quote")
    return models.contributions(rows, proof, F.col("text").contains(F.col("quote")))


@query("""SELECT user_id, CASE user_id % 5 WHEN 0 THEN CASE WHEN n < 2 THEN 'UNVERIFIED' END WHEN 1 THEN 'MODEL_CHANGED' WHEN 2 THEN 'NOT_DONE' WHEN 3 THEN 'INVALID_FRAME' ELSE CASE WHEN n < 2 THEN 'UNVERIFIED' END END AS code, CASE WHEN user_id % 5 IN (0, 4) AND n >= 2 THEN content END AS content, CASE WHEN user_id % 5 IN (0, 4) AND n >= 2 THEN 7 + n END AS tokens
 FROM (SELECT user_id, count(*) AS n, string_agg(event_type || ' ', '' ORDER BY event_id) AS content FROM events GROUP BY 1)""")
def streamed_answers(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("user_id", "event_id", "event_type").withColumns({"n": F.count("*").over(Window.partitionBy("user_id")), "i": F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))})
    frame = F.to_json(F.struct(
        F.when((F.col("user_id") % 5 == 1) & (F.col("i") == 1), "other").otherwise("m").alias("model"), F.struct(F.concat("event_type", F.lit(" ")).alias("content")).alias("message"),
        ((F.col("i") == F.col("n")) & (F.col("user_id") % 5 != 2)).alias("done"), F.when(F.col("i") == F.col("n"), 7).alias("prompt_eval_count"), F.when(F.col("i") == F.col("n"), F.col("n")).alias("eval_count"),
    ))
    frames = rows.select("user_id", "event_id", F.when((F.col("user_id") % 5 == 3) & (F.col("i") == 1), "{").otherwise(frame).alias("frame"))
    return models.stream_answers(frames, "user_id", "event_id", "frame", "m")


_JOB = "CASE o_orderkey % 11 WHEN 10 THEN 'F47AC10B-58CC-4372-A567-0E02B2C3D479' ELSE 'f47ac10b-58cc-4372-a567-0e02b2c3d479' END"


@query("""SELECT o_orderkey, CASE o_orderkey % 11 WHEN 9 THEN 'PROTOCOL_UNSUPPORTED' WHEN 10 THEN 'JOB_ID_INVALID' WHEN 8 THEN 'CAPABILITY_UNSUPPORTED' WHEN 7 THEN 'INPUT_COUNT_INVALID' WHEN 0 THEN NULL ELSE 'INPUT_INVALID' END AS code FROM orders""")
def job_boundaries(spark, d):
    k = F.col("o_orderkey") % 11
    uuid, sha = F.lit("f47ac10b-58cc-4372-a567-0e02b2c3d479"), F.sha2(F.lit("x"), 256)
    one = F.struct(
        F.when(k == 1, "x").otherwise(uuid).alias("artifact_id"), F.when(k == 2, "text/html").otherwise("application/pdf").alias("media_type"), F.when(k == 3, 0).when(k == 4, 5000).otherwise(100).cast("long").alias("byte_size"), F.when(k == 5, "x").otherwise(sha).alias("sha256"),
        F.when(k == 6, "a/b.pdf").otherwise("a.pdf").alias("name"), F.lit("app.one").alias("app"),
    )
    jobs = table(spark, d, "orders").select(
        "o_orderkey", F.expr(_JOB).alias("job_id"), F.when(k == 9, "1").otherwise("2").alias("protocol"), F.when(k == 8, "translate").otherwise("summarize").alias("capability"), F.when(k == 7, F.array(one, one)).otherwise(F.array(one)).alias("inputs"),
    )
    return jobs.select("o_orderkey", models.job_code(4000, ("application/pdf",)).alias("code"))


@query("SELECT doc_id, strlen(text) AS n_tokens FROM documents")
def conservative_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", models.conservative_tokens(F.col("text")).alias("n_tokens"))


@query("""SELECT run_id, attempt, code FROM (SELECT o_orderkey AS run_id, o_orderkey % 3 AS attempt, CASE WHEN o_orderkey % 10 = 0 THEN 'NO_ARTIFACT' WHEN o_custkey % 4 = 1 THEN 'DOCUMENT_MISMATCH' END AS code FROM orders)""")
def attempt_artifacts(spark, d):
    runs = table(spark, d, "orders").selectExpr("o_orderkey AS run_id", "o_orderkey % 3 AS attempt", "o_custkey AS document_id")
    artifacts = runs.where("run_id % 10 <> 0").selectExpr("run_id", "attempt", "CASE WHEN document_id % 4 = 1 THEN -1 ELSE document_id END AS of_document").union(runs.selectExpr("run_id", "attempt + 1", "document_id"))
    met = runs.join(artifacts, ["run_id", "attempt"], "left")
    return met.select("run_id", "attempt", F.when(F.col("of_document").isNull(), "NO_ARTIFACT").when(F.col("of_document") != F.col("document_id"), "DOCUMENT_MISMATCH").alias("code"))
