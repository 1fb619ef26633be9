"""Batches, samples, page orders, allotments, pairs and answers, over conversations, lineitems and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import planning
from quillstone.plans.registry import query, table


@query("""WITH RECURSIVE b AS (SELECT doc_id % 40 AS document_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n, doc_id, least(length(text), 900) + doc_id % 7 * 50 AS len FROM documents),
 f AS (SELECT document_id, n, doc_id, CASE WHEN len > 1100 THEN 0 ELSE 1 END AS held, len AS used, 0 AS batch, len > 1100 AS out FROM b WHERE n = 1 UNION ALL
 SELECT b.document_id, b.n, b.doc_id, CASE WHEN f.held = 4 OR f.used + b.len > 1100 THEN 1 ELSE f.held + 1 END, CASE WHEN f.held = 4 OR f.used + b.len > 1100 THEN b.len ELSE f.used + b.len END, CASE WHEN f.held = 4 OR f.used + b.len > 1100 THEN f.batch + 1 ELSE f.batch END, b.len > 1100 FROM f JOIN b ON b.document_id = f.document_id AND b.n = f.n + 1)
 SELECT document_id, doc_id, CASE WHEN out THEN NULL ELSE CAST(batch AS BIGINT) END AS batch FROM f""".replace("CASE WHEN len > 1100 THEN 0 ELSE 1 END AS held", "1 AS held"))
def request_batches(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id % 40 AS document_id", "doc_id", "least(length(text), 900) + doc_id % 7 * 50 AS len")
    return planning.batches(rows, "document_id", "doc_id", "len", 4, 1100)


_LONG = "SELECT conv_id, turn + 1 AS page, CASE WHEN conv_id % 2 = 0 THEN repeat(concat(trim(text), '. '), 12) ELSE trim(text) END AS text FROM conversations"


@query(f"""WITH p AS (SELECT conv_id, page, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(trim(text))) OVER (PARTITION BY conv_id) AS total FROM ({_LONG}))
 SELECT conv_id, page, CASE WHEN total <= 6000 THEN 'full_text' ELSE 'distributed' END AS sampling, CASE WHEN total <= 6000 OR length(text) <= 600 THEN text ELSE left(text, 298) || chr(10) || '[…]' || chr(10) || right(text, 297) END AS excerpt
 FROM p WHERE total <= 6000 OR i IN (SELECT unnest(list_transform(range(least(n, 5)), lambda s: CASE WHEN least(n, 5) <= 1 THEN 0 ELSE s * (n - 1) // (least(n, 5) - 1) END)))""")
def classification_samples(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn + 1 AS page", "CASE WHEN conv_id % 2 = 0 THEN repeat(concat(trim(text), '. '), 12) ELSE trim(text) END AS text")
    return planning.sample(rows, "conv_id", "page", "text")


@query("""WITH v AS (SELECT o_custkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'contract' WHEN 'O' THEN 'report' ELSE 'unknown' END AS purpose, CAST(o_orderkey % 5 AS BIGINT) AS w FROM orders), s AS (SELECT document_id, purpose, sum(w) AS w FROM v GROUP BY 1, 2),
 r AS (SELECT *, sum(w) OVER (PARTITION BY document_id) AS total, row_number() OVER (PARTITION BY document_id ORDER BY w DESC, purpose DESC) AS i FROM s)
 SELECT document_id, purpose, CASE WHEN w * 2 > total THEN CASE purpose WHEN 'contract' THEN 'contract' WHEN 'report' THEN 'general' END END AS profile, NOT (w * 2 > total AND purpose <> 'unknown') AS expand FROM r WHERE i = 1""")
def profile_suggestions(spark, d):
    votes = table(spark, d, "orders").selectExpr("o_custkey AS document_id", "CASE o_orderstatus WHEN 'F' THEN 'contract' WHEN 'O' THEN 'report' ELSE 'unknown' END AS purpose", "o_orderkey % 5 AS w")
    return planning.suggestion(votes, "document_id", "purpose", "w", {"contract": "contract", "report": "general"})


_PLAN = """WITH p AS (SELECT user_id, event_id, event_type <> 'error' AS kept, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 t AS (SELECT *, least(n, (3 * n + 4) // 5 + 16, 512) AS target FROM p), c AS (SELECT *, i IN (SELECT unnest(list_transform(range(target), lambda s: CASE WHEN target <= 1 THEN 0 ELSE s * (n - 1) // (target - 1) END))) AS chosen FROM t),
 o AS (SELECT *, row_number() OVER w AS turn FROM c WINDOW w AS (PARTITION BY user_id ORDER BY chosen DESC, event_id)), r AS (SELECT *, coalesce(sum(kept::INT) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < target AS reached FROM o)"""


def _plan(spark, d):
    return planning.page_order(table(spark, d, "events").selectExpr("user_id", "event_id", "event_type <> 'error' AS kept"), "user_id", "event_id", "kept")


@query(f"{_PLAN} SELECT user_id, event_id, chosen, CAST(turn AS BIGINT) AS turn, reached, target FROM r")
def page_plans(spark, d):
    return _plan(spark, d).withColumn("turn", F.col("turn").cast("long"))


@query(f"{_PLAN} SELECT DISTINCT user_id FROM r WHERE reached AND ((user_id % 5 = 0 AND turn = 1) OR (user_id % 5 = 1 AND turn = 2))")
def replayed_plans(spark, d):
    planned = _plan(spark, d)
    looks = planned.where("reached").where("not (user_id % 5 = 0 and turn = 1)").withColumn("turn", F.expr("CASE WHEN user_id % 5 = 1 AND turn = 2 THEN 99999 ELSE turn END"))
    return planning.replay_violations(looks, planned, "user_id", "event_id")


@query("""WITH b AS (SELECT c_nationkey AS k, c_mktsegment AS batch, count(*) AS capacity FROM customer GROUP BY 1, 2), r AS (SELECT k, batch, row_number() OVER (PARTITION BY k ORDER BY d, batch) AS n FROM b, (SELECT unnest(range(1, 1000)) AS d) WHERE d <= capacity)
 SELECT k, batch, count(*) AS allotted FROM r WHERE n <= 7 GROUP BY 1, 2""")
def round_robin_targets(spark, d):
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("batch")).agg(F.count("*").alias("capacity"))
    return planning.round_robin(b, "k", "batch", "capacity", F.lit(7))


@query()
def candidate_pairs(spark, d):
    """No SQL: each pair depends on all before it; tests hold it against a plain loop."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 6)).alias("ids"))
    return planning.pairs(rows, "l_orderkey", "l_linenumber", "ids", 3, 2)


@query("SELECT l_orderkey, 'k' || row_number() OVER (PARTITION BY l_orderkey ORDER BY claim) AS local_id, claim FROM (SELECT DISTINCT l_orderkey, 'c' || l_partkey AS claim FROM lineitem)")
def request_ids(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("c"), "l_partkey").alias("claim")).distinct()
    return planning.local_ids(rows, "l_orderkey", "claim", "claim")


@query("""WITH ids AS (SELECT l_orderkey, claim, row_number() OVER (PARTITION BY l_orderkey ORDER BY claim) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, 'c' || l_partkey AS claim FROM lineitem))
 SELECT l_orderkey, CASE l_orderkey % 5 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'INVALID_COUNT' WHEN 2 THEN 'INVALID_COUNT' ELSE CASE WHEN max(n) < 2 THEN 'UNKNOWN_ID' END END AS code, CASE WHEN l_orderkey % 5 > 2 AND max(n) >= 2 THEN max(claim) FILTER (i = 2) || ',' || max(claim) FILTER (i = 1) END AS claims FROM ids GROUP BY 1""")
def restored_answers(spark, d):
    ids = request_ids(spark, d)
    bodies = ids.select("l_orderkey").distinct().selectExpr("l_orderkey", """CASE l_orderkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN '{"claim_ids":["k2","k2"]}' WHEN 2 THEN '{"claim_ids":["k1"]}' ELSE '{"claim_ids":["k2","k1"]}' END AS body""")
    return planning.answered(bodies, "l_orderkey", "body", ids, "claim", F.lit(2)).select("l_orderkey", "code", F.array_join("claim", ",").alias("claims"))


@query("""WITH g AS (SELECT l_orderkey % 300 AS document_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey % 300 AS l_orderkey, l_partkey % 12 AS p FROM lineitem) GROUP BY 1)
 SELECT document_id, CASE WHEN n <= 8 THEN document_id % 4 = 0 ELSE document_id % 4 IN (1, 2) END AS valid FROM g""".replace("SELECT l_orderkey % 300 AS document_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey % 300 AS l_orderkey", "SELECT l_orderkey AS document_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey % 300 AS l_orderkey"))
def key_point_contracts(spark, d):
    claims = table(spark, d, "lineitem").selectExpr("l_orderkey % 300 AS document_id", "l_partkey % 12 AS place", "concat('c', l_partkey % 12) AS claim_id").distinct()
    g = claims.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("place", "claim_id"))).alias("x")).select("document_id", F.col("x.claim_id").alias("ids"))
    kind = F.col("document_id") % 4
    # 0: all of them; 1: the first eight; 2: none, with a warning; 3: one of them eight times.
    chosen = F.when(kind == 0, F.col("ids")).when(kind == 1, F.when(F.size("ids") <= 8, F.reverse(F.concat("ids", F.slice("ids", 1, 1)))).otherwise(F.slice("ids", 1, 8))).when(kind == 2, F.array().cast("array<string>")).otherwise(F.array_repeat(F.get("ids", F.lit(0)), 8))
    picked = g.select("document_id", F.when((kind == 0) & (F.size("ids") > 8), F.slice("ids", 1, 9)).otherwise(chosen).alias("claim_ids"), (kind == 2).alias("warned"))
    return planning.key_points_valid(claims, picked, "document_id")


@query("SELECT p_partkey, p_partkey % 6 = 0 AS assigned, p_partkey % 4 = 0 AS reduced, p_partkey % 5 > 2 AS within FROM part")
def structural_answers(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_partkey",
        """CASE p_partkey % 6 WHEN 0 THEN '{"claims":[{"text":"a"},{"text":"b"}],"assignments":[0,1,1]}' WHEN 1 THEN '{"claims":[{"text":"a"}],"assignments":[0,0]}' WHEN 2 THEN '{"claims":[{"text":"a"},{"text":"b"}],"assignments":[0,0,0]}'
 WHEN 3 THEN '{"claims":[{"text":"a"},{"text":"b"}],"assignments":[0,1,2]}' WHEN 4 THEN '{"claims":[],"assignments":[]}' ELSE 'no' END AS a""",
        """CASE p_partkey % 4 WHEN 0 THEN '{"claims":[{"text":"a"}]}' WHEN 1 THEN '{"claims":[{"text":"a"}]}' WHEN 2 THEN '{"claims":[{"text":"a"},{"text":"b"}]}' ELSE 'no' END AS r""", "CASE WHEN p_partkey % 4 = 1 THEN 3 ELSE 2 END AS n",
        """concat('{"units":[{"text":"', repeat('x', 8), '"},{"text":"yy"}]}') AS u""", "p_partkey % 5 + 5 AS most",
    )
    a = planning.assignments_valid(rows, "p_partkey", "a", F.lit(3), 1, 4, 2).withColumnRenamed("valid", "assigned")
    r = planning.reductions_valid(rows, "p_partkey", "r", F.col("n")).withColumnRenamed("valid", "reduced")
    return a.join(r, "p_partkey").join(planning.lengths_valid(rows, "p_partkey", "u", F.col("most")).withColumnRenamed("valid", "within"), "p_partkey")


@query("SELECT p_partkey, CAST(least(8, greatest(0, (p_size * 100 - 300) // (p_size + 3))) AS BIGINT) AS allowance, CAST(CASE WHEN least(384, greatest(0, p_size * 2000 // (23 * 6))) >= 120 THEN least(384, greatest(0, p_size * 2000 // (23 * 6))) END AS BIGINT) AS ceiling FROM part")
def admitted_budgets(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", planning.largest_allowance(size * 100 - 300, size + 3, F.lit(8)).alias("allowance"), planning.admitted_ceiling(size * 20, F.lit(6), F.lit(384), 120).alias("ceiling"))


@query("""WITH c AS (SELECT o_orderkey AS chunk, o_orderkey % 9 AS doc FROM orders), e AS (SELECT l_orderkey AS chunk, 'e' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS evidence, l_shipdate, l_linenumber FROM lineitem WHERE l_returnflag = 'N')
 SELECT chunk, count(evidence) AS n, coalesce(string_agg(evidence, ',' ORDER BY l_linenumber, evidence), '') AS evidence FROM c LEFT JOIN e USING (chunk) GROUP BY 1""")
def chunk_evidence(spark, d):
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"))
    evidence = table(spark, d, "lineitem").where("l_returnflag = 'N'").selectExpr("l_orderkey AS chunk", "l_linenumber", "concat('e', l_linenumber, '-', l_partkey, '-', l_suppkey) AS evidence")
    g = evidence.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "evidence"))).alias("x"))
    return chunks.join(g, "chunk", "left").select("chunk", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("x", lambda r: r["evidence"]), ","), F.lit("")).alias("evidence"))


@query("""WITH cl AS (SELECT l_orderkey AS document_id, 'c' || l_linenumber AS claim_id, l_partkey % 60 AS e FROM lineitem), ev AS (SELECT p_partkey AS e, p_size AS page FROM part WHERE p_partkey < 58)
 SELECT document_id, code FROM (SELECT document_id, 'UNKNOWN_EVIDENCE' AS code FROM cl WHERE e NOT IN (SELECT e FROM ev) UNION SELECT document_id, 'EVIDENCE_TWICE' FROM cl GROUP BY document_id, claim_id, e HAVING count(*) > 1)
 UNION ALL SELECT NULL, 'UNUSED_EVIDENCE' FROM ev WHERE e NOT IN (SELECT e FROM cl) GROUP BY ALL""")
def citation_mismatches(spark, d):
    claims = table(spark, d, "lineitem").selectExpr("l_orderkey AS document_id", "concat('c', l_linenumber) AS claim_id", "l_partkey % 60 AS e")
    known = table(spark, d, "part").where("p_partkey < 58").select(F.col("p_partkey").alias("e"))
    unknown = claims.join(known, "e", "left_anti").select("document_id", F.lit("UNKNOWN_EVIDENCE").alias("code")).distinct()
    twice = claims.groupBy("document_id", "claim_id", "e").agg(F.count("*").alias("n")).where("n > 1").select("document_id", F.lit("EVIDENCE_TWICE").alias("code")).distinct()
    unused = known.join(claims, "e", "left_anti").select(F.lit(None).cast("long").alias("document_id"), F.lit("UNUSED_EVIDENCE").alias("code")).distinct()
    return unknown.union(twice).union(unused)


@query("SELECT l_orderkey, CAST(page AS VARCHAR) AS page, missing FROM (SELECT l_orderkey, l_linenumber AS page, 'claims' AS missing FROM lineitem WHERE l_orderkey % 6 = 0 AND l_linenumber = 1 GROUP BY 1, 2) UNION ALL SELECT l_orderkey, CAST(99 AS VARCHAR), 'recomputed' FROM lineitem WHERE l_orderkey % 6 = 1 GROUP BY 1")
def recomputed_claims(spark, d):
    want = table(spark, d, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber AS string) AS page").distinct()
    stored = want.where("not (l_orderkey % 6 = 0 and page = '1')").union(want.where("l_orderkey % 6 = 1").select("l_orderkey", F.lit("99")).distinct())
    return want.exceptAll(stored).withColumn("missing", F.lit("claims")).union(stored.exceptAll(want).withColumn("missing", F.lit("recomputed")))
