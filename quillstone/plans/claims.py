"""Claims, guards, clauses and quotes: parts and orders stand for claims and contracts, whose sentences are put together by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import claims, contracts
from quillstone.operators.rounds import settle
from quillstone.plans.registry import query, table

_RELATIONS = ("<", "<=", ">", ">=", "=", "!=")
_OPS = "[" + ", ".join(f"'{r}'" for r in _RELATIONS) + "]"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE claim WHEN '!=' THEN CASE source WHEN '=' THEN s <> c WHEN '!=' THEN s = c WHEN '<' THEN s <= c WHEN '<=' THEN s < c WHEN '>' THEN s >= c ELSE s > c END
 WHEN '=' THEN source = '=' AND s = c WHEN '<' THEN (source IN ('=', '<=') AND s < c) OR (source = '<' AND s <= c) WHEN '<=' THEN source IN ('=', '<', '<=') AND s <= c WHEN '>' THEN (source IN ('=', '>=') AND s > c) OR (source = '>' AND s >= c) ELSE source IN ('=', '>', '>=') AND s >= c END AS entailed
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_OPS}[l_partkey % 6 + 1] AS source, {_OPS}[l_suppkey % 6 + 1] AS claim, l_partkey % 5 AS s, l_suppkey % 4 AS c FROM lineitem)""")
def entailed_bounds(spark, d):
    pick = lambda c: F.element_at(F.array(*map(F.lit, _RELATIONS)), (F.col(c) % 6 + 1).cast("int"))
    order = T.decimal_order((F.col("l_partkey") % 5).cast("string"), (F.col("l_suppkey") % 4).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", claims.entails(pick("l_partkey"), pick("l_suppkey"), order).alias("entailed"))


#: Claims and evidence of ten kinds, one for each guard and side of it; n and m are a claim's and its evidence's number.
_CLAIM = """CASE k WHEN 0 THEN concat('The fee is at most ', n, ' dollars.') WHEN 1 THEN concat('The fee is more than ', n, ' dollars.') WHEN 2 THEN concat('The fee is at least ', n, ' euros.') WHEN 3 THEN 'Buses run from the home to the workplace.'
 WHEN 4 THEN 'Buses run from the worksite to housing.' WHEN 5 THEN 'Tenants must pay rent.' WHEN 6 THEN 'The lamp is safe.' WHEN 7 THEN 'Family members may stay.' WHEN 8 THEN 'ABC only if paid must register.' ELSE concat('It rains. ', n) END"""
_PROOF = """CASE k WHEN 0 THEN concat('The fee is at most ', m, ' dollars.') WHEN 1 THEN concat('The fee is exactly ', m, ' dollars.') WHEN 2 THEN concat('The fee is at least ', n, ' dollars.') WHEN 3 THEN 'Buses run from housing to the work site.'
 WHEN 4 THEN 'Buses run from housing to the work site.' WHEN 5 THEN CASE WHEN n % 2 = 0 THEN 'Tenants may pay rent.' ELSE 'Tenants shall pay rent.' END WHEN 6 THEN CASE WHEN n % 2 = 0 THEN 'The lamp is unsafe.' ELSE 'The lamp is safe.' END
 WHEN 7 THEN CASE WHEN n % 2 = 0 THEN 'Immediate family members may stay.' ELSE 'A family member may stay.' END WHEN 8 THEN CASE WHEN n % 2 = 0 THEN 'A broker company (ABC) must register. Agents (AGT) only for payment register.' ELSE 'A broker company (ABC) only for payment must register.' END ELSE 'No rain.' END"""
_GUARDED = "(SELECT p_partkey, p_partkey % 10 AS k, p_size AS n, p_partkey % 40 AS m, p_partkey % 13 = 5 AS unknown, p_partkey % 17 <> 3 AS supported FROM part)"


@query("""SELECT concat('', p_partkey) AS document_id, 'c1' AS claim_id, CASE WHEN unknown OR NOT supported THEN verdict WHEN broken IS NOT NULL THEN 'unsupported' ELSE verdict END AS verdict, CASE WHEN NOT unknown AND supported THEN broken END AS broken, CASE WHEN unknown THEN 'UNKNOWN_EVIDENCE' END AS code
 FROM (SELECT *, CASE WHEN supported THEN 'supported' ELSE 'unsupported' END AS verdict, CASE WHEN (k = 0 AND m > n) OR (k = 1 AND m <= n) OR k = 2 THEN 'numbers' WHEN k = 4 THEN 'directions' WHEN n % 2 = 0 THEN CASE k WHEN 5 THEN 'obligations' WHEN 6 THEN 'judgements' WHEN 7 THEN 'enumeration' WHEN 8 THEN 'conditions' END END AS broken FROM """ + _GUARDED + ")")
def guarded_claims(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 10 AS k", "p_size AS n", "p_partkey % 40 AS m", "p_partkey % 13 = 5 AS unknown", "p_partkey % 17 <> 3 AS supported")
    told = rows.selectExpr("concat('', p_partkey) AS document_id", "'c1' AS claim_id", f"{_CLAIM} AS text", "array(CASE WHEN unknown THEN 'e9' ELSE 'e1' END) AS evidence_ids", "CASE WHEN supported THEN 'supported' ELSE 'unsupported' END AS verdict")
    proof = rows.selectExpr("concat('', p_partkey) AS document_id", "'e1' AS evidence_id", f"{_PROOF} AS quote")
    return claims.guarded(told, proof)


def _cited(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("concat('', l_orderkey) AS document_id", "l_linenumber", "concat('e', l_partkey % 9) AS evidence_id", "l_partkey")
    told = rows.groupBy("document_id", "l_linenumber").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids")).selectExpr("document_id", "concat('c', l_linenumber) AS claim_id", "CASE WHEN l_linenumber = 6 THEN ' ' ELSE concat('claim ', l_linenumber) END AS text", "evidence_ids")
    known = rows.where("l_linenumber <> 3").select("document_id", "evidence_id").distinct().selectExpr("document_id", "evidence_id", "1 AS page_start", "1 + cast(substring(evidence_id, 2) AS int) % 3 AS page_end", "concat('quote ', evidence_id) AS quote")
    return told, known.union(known.where("document_id % 7 = 1").selectExpr("document_id", "'e99'", "1", "1", "'never'").distinct())


_CITED = "WITH r AS (SELECT concat('', l_orderkey) AS document_id, l_linenumber, 'e' || l_partkey % 9 AS evidence_id FROM lineitem), k AS (SELECT DISTINCT document_id, evidence_id FROM r WHERE l_linenumber <> 3)"


@query(f"""{_CITED} SELECT document_id, 'c' || l_linenumber AS claim_id, CAST(row_number() OVER (PARTITION BY document_id, l_linenumber ORDER BY r.evidence_id) - 1 AS INTEGER) AS i, r.evidence_id, CASE WHEN CAST(substr(r.evidence_id, 2) AS INT) % 3 = 0 THEN 'p. 1' ELSE 'pp. 1–' || (1 + CAST(substr(r.evidence_id, 2) AS INT) % 3) END AS label, 'quote ' || r.evidence_id AS quote FROM r
 QUALIFY (document_id, r.evidence_id) IN (SELECT document_id, evidence_id FROM k)""")
def citation_views(spark, d):
    return claims.citations(*_cited(spark, d))


@query(f"""{_CITED} SELECT DISTINCT document_id, code FROM (SELECT document_id, 'UNKNOWN_EVIDENCE' AS code FROM r WHERE (document_id, evidence_id) NOT IN (SELECT document_id, evidence_id FROM k) UNION ALL SELECT document_id, 'EVIDENCE_TWICE' FROM r GROUP BY document_id, l_linenumber, evidence_id HAVING count(*) > 1
 UNION ALL SELECT document_id, 'BLANK_CLAIM' FROM r WHERE l_linenumber = 6 UNION ALL SELECT document_id, 'UNUSED_EVIDENCE' FROM k WHERE CAST(document_id AS BIGINT) % 7 = 1)""")
def citation_violations(spark, d):
    return claims.citation_violations(*_cited(spark, d))


#: A contract for each order: an opening, an article, and a numbered clause for each of its lines; headings by the line's place.
_HEADINGS = ("Payment Terms", "Term and Termination", "Insurance", "Notices", "Fees & Payment", "Liability", "Scope")
_TITLE = "CASE n % 7 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADINGS)) + " END"
_LINES = """(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n, l_partkey FROM lineitem)"""
_CLAUSE = f"concat('1.', n, ' ', {_TITLE}, chr(10), 'The buyer agrees to part ', l_partkey, '.')"
_OPENING = "concat('This agreement is made between party ', l_orderkey % 10, ' and another.', chr(10), 'ARTICLE 1 - MAIN TERMS')"


def _blocks(spark, d):
    """A block for each order. All steps deal rows by document_id, so that lineitem is shuffled and sorted once."""
    from quillstone.operators import lineage

    rows = table(spark, d, "lineitem").withColumn("document_id", F.expr("concat('', l_orderkey)"))
    rows = lineage.numbered(rows, "document_id", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).withColumn("n", F.col("sequence_no") + 1)
    held = rows.select("document_id", "l_orderkey", "n", F.expr(_CLAUSE).alias("c")).withColumn("x", F.collect_list(F.struct("n", "c")).over(Window.partitionBy("document_id"))).where("n = 1")
    text = F.concat(F.expr(_OPENING), F.lit("\n"), F.array_join(F.transform(F.sort_array("x"), lambda r: r["c"]), "\n"))
    return held.select("document_id", F.lit(1).alias("page_number"), F.lit(0).alias("block_index"), F.expr("concat('b', l_orderkey)").alias("block_id"), text.alias("text"))


def _contracts(spark, d):
    blocks = _blocks(spark, d)
    lines = settle(contracts.source_lines(blocks))
    return blocks, lines, settle(contracts.clauses(lines))  # both are read several times


_EXPECTED = f"""c AS (SELECT concat('', l_orderkey) AS document_id, l_orderkey, n, {_CLAUSE} AS text, {_TITLE} AS heading FROM {_LINES}),
 a AS (SELECT document_id, CAST(n + 1 AS INTEGER) AS ordinal, heading, text, '1.' || n AS number, CAST(NULL AS INTEGER) AS article, 1 AS parent, false AS opening FROM c
 UNION ALL SELECT DISTINCT document_id, 0, NULL, concat('This agreement is made between party ', l_orderkey % 10, ' and another.'), NULL, NULL, NULL, true FROM c UNION ALL SELECT DISTINCT document_id, 1, 'MAIN TERMS', 'ARTICLE 1 - MAIN TERMS', NULL, 1, NULL, false FROM c)"""


@query(f"WITH {_EXPECTED} SELECT document_id, ordinal, heading, number, article, CAST(parent AS INTEGER) AS parent, opening, article IS NOT NULL AS heading_only FROM a")
def contract_clauses(spark, d):
    return _contracts(spark, d)[2].select("document_id", "ordinal", F.get("headings", F.lit(0)).alias("heading"), "number", "article", "parent", "opening", "heading_only")


@query(f"WITH {_EXPECTED} SELECT document_id, ordinal, 'contract-clause-' || sha256(encode('1.0.0') || '\\x00'::blob || encode(document_id) || '\\x00'::blob || encode(CAST(ordinal AS VARCHAR)) || '\\x00'::blob || encode(text)) AS clause_id, sha256(text) AS text_sha256, CAST(1 AS INTEGER) AS n_evidence FROM a")
def contract_records(spark, d):
    blocks, lines, found = _contracts(spark, d)
    told, _ = contracts.records(found, lines, blocks)
    return told.select("document_id", "ordinal", "clause_id", F.sha2("text", 256).alias("text_sha256"), F.size("evidence_ids").alias("n_evidence"))


_NAMED = {"Payment": ("Payment Terms", "Fees & Payment"), "Term and renewal": ("Term and Termination",), "Termination": ("Term and Termination",), "Insurance": ("Insurance",), "Liability and indemnity": ("Liability",)}
_TERMS = " UNION ALL ".join(f"SELECT document_id, '{t}' AS term, 'heading' AS rule, ordinal AS root, CAST(ordinal AS VARCHAR) AS ordinals FROM a WHERE heading IN ({', '.join(repr(h) for h in hs)})" for t, hs in _NAMED.items())


@query(f"WITH {_EXPECTED} {_TERMS} UNION ALL SELECT document_id, 'Parties', 'opening_between', 0, '0' FROM a WHERE opening")
def contract_key_terms(spark, d):
    terms = contracts.key_terms(_blocks(spark, d))
    return terms.select("document_id", "term", "rule", "root", F.array_join(F.transform("ordinals", lambda o: o.cast("string")), ",").alias("ordinals"))


@query(f"""WITH {_EXPECTED}, i AS (SELECT *, 'contract-clause-' || sha256(encode('1.0.0') || '\\x00'::blob || encode(document_id) || '\\x00'::blob || encode(CAST(ordinal AS VARCHAR)) || '\\x00'::blob || encode(text)) || chr(10) || text AS line FROM a),
 t AS (SELECT 0 AS pos, 'Parties' AS term {' '.join(f"UNION ALL SELECT {n}, '{t}'" for n, t in enumerate(list(contracts.TERMS)[1:], 1))}), k AS ({_TERMS.replace("FROM a", "FROM i").replace("CAST(ordinal AS VARCHAR) AS ordinals", "line")} UNION ALL SELECT document_id, 'Parties', 'x', 0, line FROM i WHERE opening),
 h AS (SELECT d.document_id, t.pos, t.term || coalesce(chr(10) || chr(10) || string_agg(k.line, chr(10) || chr(10) ORDER BY k.root), ': not identified') AS said FROM (SELECT DISTINCT document_id FROM a) d CROSS JOIN t LEFT JOIN k ON k.document_id = d.document_id AND k.term = t.term GROUP BY 1, 2, t.term)
 SELECT document_id, sha256('Key terms' || chr(10) || chr(10) || (SELECT string_agg(said, chr(10) || chr(10) ORDER BY pos) FROM h WHERE h.document_id = i.document_id) || chr(10) || chr(10) || 'Full clause list' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY ordinal)) AS text_sha256 FROM i GROUP BY document_id""")
def contract_renderings(spark, d):
    return contracts.render(_blocks(spark, d)).select("document_id", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT concat('', l_orderkey) AS document_id FROM lineitem WHERE l_orderkey % 5 = 2 GROUP BY l_orderkey")
def contract_mismatches(spark, d):
    blocks, lines, found = _contracts(spark, d)
    told, _ = contracts.records(found, lines, blocks)
    stored = told.withColumn("text", F.when((F.col("document_id") % 5 == 2) & (F.col("ordinal") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return contracts.extraction_violations(stored, told)


_HEADED = ("Payment and Performance Bonds", "Fees", "Bonds and Insurance", "Term/Renewal", "hold  harmless", "Notices", "Payment, Taxes", "Scope of Fees due", "Termination of the Agreement", "Parties & Contracting Parties")
_WANT = ("", "Payment", "Insurance", "Term and renewal", "Liability and indemnity", "", "Payment", "", "Termination", "Parties")


@query(f"SELECT c_custkey, nullif([{', '.join(repr(w) for w in _WANT)}][c_custkey % {len(_WANT)} + 1], '') AS terms FROM customer")
def heading_terms(spark, d):
    heading = F.element_at(F.array(*map(F.lit, _HEADED)), (F.col("c_custkey") % len(_HEADED) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.nullif(F.array_join(contracts.heading_terms(heading), ","), F.lit("")).alias("terms"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, repeat('This is sentence ' || conv_id || '. ', 60) AS text, length('This is sentence ' || conv_id || '. ') AS one FROM conversations)
 SELECT conv_id, turn, CAST(0 AS INTEGER) AS omitted, CAST(ceil(60.0 / ((600 + 1) // one)) AS INTEGER) AS n, CAST(least(60, (600 + 1) // one) * one - 1 AS INTEGER) AS first_chars FROM s""")
def quote_segments(spark, d):
    rows = table(spark, d, "conversations").selectExpr("concat(conv_id, ':', turn) AS id", "conv_id", "turn", "repeat(concat('This is sentence ', conv_id, '. '), 60) AS text")
    found = contracts.quotes(rows, "id", "text").join(rows.select("id", "conv_id", "turn"), "id")
    return found.select("conv_id", "turn", "omitted", F.size("segments").alias("n"), F.length(F.get("segments", F.lit(0))).alias("first_chars"))


@query()
def document_quotes(spark, d):
    """No SQL: the ends of sentences are found by rules; tests hold them against fixtures."""
    return contracts.quotes(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.size("segments").alias("n"), "omitted", F.sha2(F.array_join("segments", "\0"), 256).alias("segments_sha256"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Costs rose.' WHEN 1 THEN '' WHEN 2 THEN 'Short one.' ELSE '' END AS kept, CASE WHEN p_partkey % 4 IN (1, 3) THEN CASE p_partkey % 4 WHEN 1 THEN 1 ELSE 0 END ELSE 0 END AS withheld, p_partkey % 4 = 0 AS trimmed FROM part")
def recovered_answers(spark, d):
    body = """CASE p_partkey % 4 WHEN 0 THEN '{"units":[{"text":"Costs rose. And mor"}]}' WHEN 1 THEN '{"units":[{"text":"It is. Unless they "}]}' WHEN 2 THEN '{"units":[{"text":"Short one."}]}' ELSE 'no' END"""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{body} AS body")
    found = contracts.recovered(rows, "p_partkey", "body", F.lit(19))
    return found.select("p_partkey", F.array_join("kept", "|").alias("kept"), "withheld", (F.size("cut") > 0).alias("trimmed"))


@query("""SELECT concat('', l_orderkey) AS document_id, CAST(n - 1 AS INTEGER) AS place, '1.' || n AS number, sha256(CASE WHEN n = 1 THEN '' ELSE '' END || text) AS text_sha256 FROM (SELECT l_orderkey, n, concat('1.', n, ' Part', chr(10), 'Text ', l_partkey, '.') AS text FROM """ + _LINES + ")")
def numbered_units(spark, d):
    from quillstone.operators import lineage

    rows = lineage.numbered(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).withColumn("n", F.col("sequence_no") + 1)
    blocks = rows.selectExpr("concat('', l_orderkey) AS document_id", "n AS page_number", "0 AS block_index", "concat('1.', n, ' Part', chr(10), 'Text ', l_partkey, '.') AS text")
    return contracts.numbered_units(blocks).select("document_id", "place", "number", F.sha2("text", 256).alias("text_sha256"))


