"""All queries of the engine by name, with their SQL. Driver tables stand for documents, runs and events as SURVEY §7 maps them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import coverage, lineage, ordered, planning
from quillstone.plans.registry import QUERIES, SQL, query
from quillstone.plans.registry import table as _table


@query(r"SELECT doc_id, sha256(replace(regexp_replace(replace(text, ' ', chr(13) || ' '), '\r\n?', chr(10), 'g'), chr(0), '')) AS cleaned, true AS changed FROM documents WHERE text LIKE '% %' UNION ALL SELECT doc_id, sha256(text), false FROM documents WHERE text NOT LIKE '% %'")
def text_cleanup(spark, d):
    raw = F.regexp_replace("text", " ", "\r ")
    return _table(spark, d, "documents").select("doc_id", F.sha2(T.cleanup(raw), 256).alias("cleaned"), (T.cleanup(raw) != raw).alias("changed"))


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS key_hash, sha256(lower(trim(regexp_replace(regexp_replace(text, '[0-9]', '', 'g'), '\s+', ' ', 'g')))) AS repeated_hash FROM documents")
def text_keys(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2(T.key(F.col("text")), 256).alias("key_hash"), F.sha2(T.repeated_key(F.col("text")), 256).alias("repeated_hash"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 298) || chr(10) || '[…]' || chr(10) || right(text, 297) END AS middle, CASE WHEN length(text) <= 480 THEN text ELSE left(text, 239) || ' … ' || right(text, 238) END AS ranked, left(text, 40) AS prefix FROM documents")
def text_excerpts(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", T.middle_excerpt(t, 600).alias("middle"), T.ranking_excerpt(t).alias("ranked"), F.left(t, F.lit(40)).alias("prefix"))


@query(r"SELECT doc_id, CAST(length(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words FROM documents")
def word_counts(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query(r"SELECT conv_id, turn, 'nb-' || sha256(encode('normalized-block') || '\x00'::blob || encode(CAST(conv_id AS VARCHAR)) || '\x00'::blob || encode('v1') || '\x00'::blob || unhex(lpad(hex(turn + 1), 8, '0')) || unhex('00000000')) AS block_id FROM conversations WHERE trim(text) <> ''")
def block_ids(spark, d):
    rows = _table(spark, d, "conversations").where(F.trim("text") != "")
    return rows.select("conv_id", "turn", T.block_id(F.col("conv_id").cast("string"), "v1", F.col("turn") + 1, F.lit(0)).alias("block_id"))


@query("SELECT l_orderkey, CASE WHEN lo = hi THEN 'p. ' || lo ELSE 'pp. ' || lo || '–' || hi END AS label FROM (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)")
def page_labels(spark, d):
    pages = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return pages.select("l_orderkey", T.source_label(F.col("lo"), F.col("hi")).alias("label"))


@query(r"SELECT p_partkey, CASE WHEN s LIKE '%.%' THEN regexp_replace(regexp_replace(regexp_replace(s, '^0+([0-9])', '\1'), '0+$', ''), '\.$', '') ELSE s END AS canonical FROM (SELECT p_partkey, '00' || CAST(p_size AS VARCHAR) || '.' || CAST(p_size % 7 AS VARCHAR) || '00' AS s FROM part)")
def canonical_decimals(spark, d):
    s = F.concat(F.lit("00"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_size") % 7).cast("string"), F.lit("00"))
    return _table(spark, d, "part").select("p_partkey", T.canonical_decimal(s).alias("canonical"))


_NAMES = "CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN '..' WHEN 3 THEN url WHEN 4 THEN concat('report ', page_id, '.pdf') WHEN 5 THEN repeat('x', 256) WHEN 6 THEN repeat('y', 255) ELSE concat('1.', page_id, '.7') END"


@query(rf"""SELECT page_id, regexp_extract(name, '^([^.]*(\.[^.]*)?)', 1) AS version, (trim(name) <> '' AND strlen(name) <= 255 AND NOT regexp_matches(name, '[/\\\x00]') AND name NOT IN ('.', '..')) AS valid FROM (SELECT page_id, {_NAMES} AS name FROM pages)""")
def identifier_shapes(spark, d):
    u = F.col("name")
    return _table(spark, d, "pages").selectExpr("page_id", f"{_NAMES} AS name").select("page_id", T.wire_version(u).alias("version"), T.valid_filename(u).alias("valid"))


_UUIDS = "CASE doc_id % 4 WHEN 0 THEN 'f47ac10b-58cc-4372-a567-0e02b2c3d479' WHEN 1 THEN 'f47ac10b-58cc-1372-a567-0e02b2c3d479' WHEN 2 THEN 'F47AC10B-58CC-4372-A567-0E02B2C3D479' ELSE 'x' END"


@query(rf"""SELECT doc_id, regexp_matches(id, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$') AS uuid, regexp_matches(hash, '^[0-9a-f]{{64}}$') AS digest FROM (SELECT doc_id, {_UUIDS} AS id, CASE WHEN doc_id % 3 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS hash FROM documents)""")
def identifier_kinds(spark, d):
    hash_ = F.when(F.col("doc_id") % 3 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256))
    return _table(spark, d, "documents").select("doc_id", T.uuid4(F.expr(_UUIDS)).alias("uuid"), T.digest(hash_).alias("digest"))


#: Marked strings put before each document's text, so that every marker stands somewhere beside what the texts hold.
_MARKS = (
    "Contact Luz.Ortiz@WHS.MIL. for records.", "Call (703) 696-4959 for assistance.", "Approved 5/19/08.", "The memo is dated May 28, 2008.", "NARA job NC1-330-78-7? It applies.", "not-an-email@", "Call (70) 69-49.", "Approved 5/19.",
    "The memo is dated May 2008.", "A-3", "02/25/20Q8", "ABC-1", "plain", "a$b=c@x.com", "a1:2/(x", "x@y.c-d", "+123456789012345", "+1234567890123456", "12-3456", "A-12?", "(A/34567.)", "1-2-03", "1/2-03", "10.2.2003",
)
_MARKED = "(SELECT doc_id, ([" + ", ".join("'" + x + "'" for x in _MARKS) + f"])[doc_id % {len(_MARKS)} + 1] || chr(10) || text AS text FROM documents)"
_TOKENS = r"""list_transform(regexp_extract_all(text, '\S+'), lambda w: regexp_replace(regexp_replace(w, '^[,;:!?."''“”‘’\[\]{{}}()]+', ''), '[,;:!?."''“”‘’\[\]{{}}()]+$', ''))""".replace("{{", "{").replace("}}", "}")
_DIALS = r"""list_transform(regexp_extract_all(text, '\S+'), lambda w: regexp_replace(regexp_replace(w, '^[,;:!"''“”‘’?]+', ''), '[,;:!"''“”‘’?]+$', ''))"""


@query(rf"""SELECT *, email OR numeric_date OR reference OR named_date OR phone AS material FROM (SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z0-9]+$'))) > 0 AS email,
 len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]{{1,4}}-[0-9]{{1,4}}-[0-9]{{1,4}}$|^[0-9]{{1,4}}/[0-9]{{1,4}}/[0-9]{{1,4}}$'))) > 0 AS numeric_date,
 len(list_filter(w, lambda x: strlen(x) BETWEEN 5 AND 64 AND regexp_matches(x, '^[A-Za-z][A-Za-z0-9_/?.-]*$') AND regexp_matches(x, '[0-9].*[0-9]') AND regexp_matches(x, '[/-]'))) > 0 AS reference,
 len(list_filter(range(1, len(w) - 1), lambda i: lower(w[i]) IN {T.MONTHS} AND regexp_matches(w[i + 1], '^[0-9]{{1,2}}$') AND regexp_matches(w[i + 2], '^([0-9]{{2}}|[0-9]{{4}})$'))) > 0 AS named_date,
 len(list_filter(flatten(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN regexp_matches(v[i], '^[0-9+().-]+$') THEN list_transform([1, 2, 3], lambda k: array_to_string(v[i : least(i + k - 1, len(v))], '')) ELSE [] END)),
 lambda x: regexp_matches(x, '^[0-9+().-]+$') AND regexp_matches(x, '[+()-]') AND length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)) > 0 AS phone FROM (SELECT doc_id, {_TOKENS} AS w, {_DIALS} AS v FROM {_MARKED}))""")
def material_markers(spark, d):
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % len(_MARKS) + 1).cast("int"))
    t = F.col("text")
    found = {"email": T.email_marker(t), "numeric_date": T.numeric_date_marker(t), "reference": T.reference_marker(t), "named_date": T.named_date_marker(t), "phone": T.phone_marker(t)}
    marked = _table(spark, d, "documents").select("doc_id", F.concat(mark, F.lit("\n"), "text").alias("text")).select("doc_id", *[c.alias(n) for n, c in found.items()])
    return marked.withColumn("material", F.col("email") | F.col("phone") | F.col("numeric_date") | F.col("named_date") | F.col("reference"))


_ENDED = """CASE doc_id % 9 WHEN 0 THEN concat('Unless ', text) WHEN 1 THEN concat(text, ' 5%.') WHEN 2 THEN concat('( however, ', text, '!') WHEN 3 THEN concat(text, '.', chr(10)) WHEN 4 THEN concat(text, 'x.)') WHEN 5 THEN concat('providedly ', text, '...')
 WHEN 6 THEN concat('Subject to ', text, 'y?') WHEN 7 THEN concat(text, ' $.') ELSE text END"""


@query(rf"""SELECT doc_id, regexp_matches(text, '([\p{{L}}\p{{N}}]|\p{{N}}\s*[%‰‱°\p{{Sc}}])["''”’)\]}}]*[.!?。！？]["''”’)\]}}]*$') AS complete, regexp_matches(lower(text), '^[\s(\[]*(unless |except |provided |subject to |however,|only if |on condition |notwithstanding )') AS qualified FROM (SELECT doc_id, {_ENDED} AS text FROM documents)""")
def completeness(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").selectExpr("doc_id", f"{_ENDED} AS text").select("doc_id", T.complete(t).alias("complete"), T.qualification(t).alias("qualified"))


_NUMBERED = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n, l_quantity, l_partkey FROM lineitem"


def _lines(spark, d):
    rows = _table(spark, d, "lineitem")
    return lineage.numbered(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).withColumn("n", F.col("sequence_no") + 1)


_SHAPES = "CASE n % 9 WHEN 0 THEN '. this is lower' WHEN 1 THEN '. Payment Terms' WHEN 2 THEN ' Scope' WHEN 3 THEN '' WHEN 4 THEN ') Fees' WHEN 5 THEN '.2) Term' WHEN 6 THEN '.1000 Long' WHEN 7 THEN '.Notices' ELSE '.1.1.1.1.1.1 Deep' END"


@query(rf"""SELECT l_orderkey, n, CASE WHEN n % 9 IN (1, 2, 3, 4, 7) THEN CAST(n AS VARCHAR) END AS number, CASE n % 9 WHEN 1 THEN 'Payment Terms' WHEN 2 THEN 'Scope' WHEN 4 THEN 'Fees' WHEN 7 THEN 'Notices' END AS title FROM ({_NUMBERED})""")
def heading_signals(spark, d):
    rows = _lines(spark, d).withColumn("text", F.concat(F.lit(" \n "), F.col("n").cast("string"), F.expr(_SHAPES), F.lit("\nbody")))
    number = F.array_join(T.heading_signal(F.col("text")), ".")
    return rows.select("l_orderkey", F.col("n").cast("long").alias("n"), number.alias("number"), F.when(number.isNotNull(), F.nullif(T.heading_title(F.col("text")), F.lit(""))).alias("title"))


@query("""WITH RECURSIVE b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, length(text) AS len FROM conversations),
 f AS (SELECT conv_id, n, turn, len AS pending, 0 AS chunk FROM b WHERE n = 1 UNION ALL
 SELECT b.conv_id, b.n, b.turn, CASE WHEN f.pending + 2 + b.len > 1200 THEN b.len ELSE f.pending + 2 + b.len END, CASE WHEN f.pending + 2 + b.len > 1200 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN b ON b.conv_id = f.conv_id AND b.n = f.n + 1)
 SELECT conv_id, turn, CAST(chunk AS BIGINT) AS chunk FROM f""")
def chunk_packing(spark, d):
    blocks = _table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    return ordered.pack(blocks, "conv_id", ["turn"], "len", 1200).select("conv_id", "turn", "chunk")


_DECORATED = "SELECT conv_id, turn, unnest(string_split('MASTER SERVICE AGREEMENT' || chr(10) || text || chr(10) || 'Page ' || CAST(turn + 1 AS VARCHAR) || ' of 9', chr(10))) AS line FROM conversations"


@query(rf"""WITH l AS (SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(line, '[0-9]', '', 'g'), '\s+', ' ', 'g'))) AS line_key FROM ({_DECORATED})),
 p AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM l GROUP BY 1), c AS (SELECT conv_id, line_key, count(DISTINCT turn) AS on_pages FROM l GROUP BY 1, 2)
 SELECT conv_id, line_key, on_pages, pages FROM c JOIN p USING (conv_id) WHERE on_pages >= greatest(2, pages // 2 + 1)""")
def page_furniture(spark, d):
    page = F.concat(F.lit("MASTER SERVICE AGREEMENT\n"), F.col("text"), F.lit("\nPage "), (F.col("turn") + 1).cast("string"), F.lit(" of 9"))
    lines = _table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(page, "\n")).alias("line")).select("conv_id", "turn", T.repeated_key(F.col("line")).alias("line_key"))
    return ordered.repeated_lines(lines, "conv_id", "turn", "line_key").select("conv_id", "line_key", "on_pages", "pages")


@query(f"SELECT l_orderkey, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM ({_NUMBERED})) WHERE n IN (1, (c + 1) // 2, c)")
def page_balanced_sources(spark, d):
    return ordered.balanced(_lines(spark, d), "l_orderkey", ["n"]).select("l_orderkey", F.col("n").cast("long").alias("n"))


@query(f"""SELECT DISTINCT l_orderkey, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM ({_NUMBERED})), (SELECT unnest(range(3)) AS slot)
 WHERE slot < least(c, 3) AND n - 1 = CASE WHEN least(c, 3) <= 1 THEN 0 ELSE slot * (c - 1) // (least(c, 3) - 1) END""")
def evenly_spaced_pages(spark, d):
    return ordered.evenly_spaced(_lines(spark, d), "l_orderkey", ["n"], 3).select("l_orderkey", F.col("n").cast("long").alias("n"))


@query("SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(strlen(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS used FROM conversations) WHERE used <= 1500")
def delivery_prefix(spark, d):
    return ordered.prefix_within(_table(spark, d, "conversations"), "conv_id", ["turn"], F.octet_length("text"), 1500).select("conv_id", "turn", "used")


@query("""WITH b AS (SELECT c_nationkey AS k, c_mktsegment AS batch, count(*) AS size FROM customer GROUP BY 1, 2), a AS (SELECT *, 8 - count(*) OVER (PARTITION BY k) AS remaining FROM b),
 m AS (SELECT a.k, a.batch, a.remaining, row_number() OVER (PARTITION BY a.k ORDER BY size / d DESC, a.batch) AS r FROM a, (SELECT unnest(range(2, 9)) AS d) WHERE d <= size)
 SELECT a.k AS c_nationkey, a.batch, a.size, 1 + (SELECT count(*) FROM m WHERE m.k = a.k AND m.batch = a.batch AND m.r <= m.remaining) AS quota FROM a""")
def shortlist_quotas(spark, d):
    b = _table(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("batch")).agg(F.count("*").alias("size"))
    return ordered.quotas(b, "c_nationkey", "batch", "size", 8)


_LOG = "SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_no FROM events"


def _log(spark, d):
    return lineage.numbered(_table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"])


@query(f"SELECT user_id, event_id, event_type, sequence_no FROM ({_LOG})")
def event_history(spark, d):
    return _log(spark, d).select("user_id", "event_id", "event_type", F.col("sequence_no").cast("long").alias("sequence_no"))


@query(f"SELECT user_id, max(sequence_no) AS sequence_no, arg_max(event_type, sequence_no) AS event_type FROM ({_LOG}) GROUP BY 1")
def latest_run_state(spark, d):
    return lineage.latest(_table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT c_custkey AS user_id, coalesce(n, 0) AS next_sequence FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey")
def next_sequence(spark, d):
    events = _table(spark, d, "events").groupBy("user_id").agg((F.count("*") - 1).alias("sequence_no"))
    return lineage.next_sequence(events, _table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def recent_runs(spark, d):
    return lineage.recent(_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def runs_without_child(spark, d):
    children = _table(spark, d, "orders").where("o_orderstatus = 'P'")
    return _table(spark, d, "customer").select("c_custkey").join(children, F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def runs_with_child(spark, d):
    return _table(spark, d, "customer").select("c_custkey").join(_table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")


_PAGED = "(SELECT l_orderkey, l_linenumber AS page, bool_or(l_returnflag = 'N') AS cited, bool_or(l_linestatus = 'F' AND l_returnflag = 'A') AS material, bool_or(l_linestatus = 'F' AND l_returnflag = 'R') AS technical FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT l_orderkey, total, cited, omitted, cited * 2 >= total AS raw_ok, total > omitted AND cited * 5 >= (total - omitted) * 3 AS adjusted_ok, least(total, (3 * total + 4) // 5 + 16, 512) AS retained
 FROM (SELECT l_orderkey, count(*) AS total, count(*) FILTER (cited) AS cited, count(*) FILTER (material AND NOT cited) AS omitted FROM {_PAGED} GROUP BY 1)""")
def page_coverage(spark, d):
    reason = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "A", "scan_noise").when(F.col("l_returnflag") == "R", "technical"))
    rows = _table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), (F.col("l_returnflag") == "N").alias("cited"), reason.alias("reason"))
    return coverage.coverage(rows, "l_orderkey", "page", "cited", "reason")


_STAGED = "(SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS stage, event_id % 1000 AS tokens, event_id % 77 AS elapsed FROM events)"


@query(f"SELECT stage, false AS overall, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(elapsed) AS BIGINT) AS elapsed FROM {_STAGED} GROUP BY 1 UNION ALL SELECT NULL, true, count(*), CAST(sum(tokens) AS BIGINT), CAST(sum(elapsed) AS BIGINT) FROM {_STAGED}")
def attempt_totals(spark, d):
    calls = _table(spark, d, "events").selectExpr("CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS stage", "event_id % 1000 AS tokens", "event_id % 77 AS elapsed")
    return coverage.attempt_totals(calls, "stage", "tokens", "elapsed")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def citation_closure(spark, d):
    claims = _table(spark, d, "orders").select("o_orderkey")
    cited = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return claims.join(cited, "o_orderkey", "left_anti").union(cited.join(claims, "o_orderkey", "left_anti"))


@query("""SELECT p_partkey, least(16000, 3 * greatest(0, p_size * 200 - 256 - 512)) AS ranker_limit, length(p_name) + p_size * 40 <= least(16000, 3 * greatest(0, p_size * 200 - 1024 - 512)) AS fits, CAST(greatest(320, 64 + (23 * p_size * 8 * 2 + 99) // 100 + 256) AS BIGINT) AS response_tokens, 2 * (p_size + p_partkey % 120) <= 256 AS plan_fits, strlen(p_name) AS conservative_tokens FROM part""")
def request_budget(spark, d):
    size, context = F.col("p_size"), F.col("p_size") * 200
    return _table(spark, d, "part").select(
        "p_partkey", planning.character_limit(context, F.lit(256)).alias("ranker_limit"), planning.request_fits(context, F.lit(1024), F.length("p_name"), size * 40).alias("fits"),
        planning.response_tokens(F.lit(64), size * 8, F.lit(2), floor=320).alias("response_tokens"), planning.plan_fits(size, F.col("p_partkey") % 120).alias("plan_fits"), F.octet_length("p_name").cast("long").alias("conservative_tokens"),
    )


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'DOCUMENT_SCANNED;' ELSE '' END || string_agg(CASE WHEN turn % 2 = 0 THEN 'NO_NATIVE_TEXT:' || (turn + 1) || ';CLEANED:' || (turn + 1) ELSE 'CLEANED:' || (turn + 1) END, ';' ORDER BY turn) AS warnings FROM conversations GROUP BY 1""")
def warning_rollup(spark, d):
    pages = _table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("NO_NATIVE_TEXT"), F.lit("CLEANED"))).otherwise(F.array(F.lit("CLEANED"))).alias("warnings"))
    documents = pages.select("conv_id").distinct().withColumn("warnings", F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("DOCUMENT_SCANNED"))).otherwise(F.array().cast("array<string>")))
    return coverage.rolled_up(documents, pages, "conv_id", "page").select("conv_id", F.array_join("warnings", ";").alias("warnings"))


#: Lines of every shape that the predicates tell apart; a part stands for a line, its size for the page.
_LINES = (
    "Page {n} of 50", "{n}", "page {n}", "{n} / 49", "{n}/3", "Page 03", "MASTER SERVICE AGREEMENT", "Annual Report", "CONFIDENTIAL", "Draft", "Overview | page {n}", "Overview | page 0",
    "The supplier shall deliver {n} units.", "Payment may not be withheld", "Exhibit 10.{n}", "Exhibit A", "EXHIBIT b.{n}", "EX-10.{n} 2 form{n}.htm DOCUMENT", "EX-10. 2 form.htm", "EX-99 3 note.TXT",
    "Monday, May {n}, 2021", "may {n} 2021", "March 32, 1999", "Signed on June {n}, 1998.", "Signed (July) {n}. 98", "03/10/03 A-{n}", "3/1/2003 AB-12", "03/10/03 A-1234", "x 1 y 2", "Zahlung: {n} Tage",
    "1. Fees: {n}", "Notes (net): ", "Payment Terms", "Term and Termination:", "Payment terms", "INDEMNITY & Insurance.", "It is not only {n}", "They don't agree", "There is no charge.", "1.2 Scope of work", " leading space.", "He left the",
)


def _shaped(spark, d, shapes):
    """Every line of every document, a line of one of the shapes before its text; its document's number stands for the page."""
    first = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    page = (F.col("doc_id") % 50 + 1).alias("page")
    text = F.concat(F.replace(first, F.lit("{n}"), (F.col("doc_id") % 50 + 1).cast("string")), F.lit("\n"), "text")
    return _table(spark, d, "documents").select("doc_id", page, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _shaped_sql(shapes) -> str:
    listed = "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in shapes) + f"])[doc_id % {len(shapes)} + 1]"
    return f"SELECT doc_id, page, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line FROM (SELECT doc_id, page, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, doc_id % 50 + 1 AS page, string_split(replace({listed}, '{{n}}', CAST(doc_id % 50 + 1 AS VARCHAR)) || chr(10) || text, chr(10)) AS lines FROM documents))"


def _sample(spark, d):
    return _shaped(spark, d, _LINES)


_SAMPLE = _shaped_sql(_LINES)
_KEY = r"lower(trim(regexp_replace(line, '\s+', ' ', 'g')))"
_FORCE = rf"regexp_matches({_KEY}, '(^|[^\p{{L}}\p{{N}}])({'|'.join(T.OPERATIVE)})([^\p{{L}}\p{{N}}]|$)')"
_PAGE = r"""({0} = CAST(page AS VARCHAR) OR {0} = 'page ' || page OR coalesce(regexp_extract({0}, '^(?:page )?([0-9]+)(?: of | / |/)([0-9]+)$', 1) = CAST(page AS VARCHAR)
 AND TRY_CAST(regexp_extract({0}, '^(?:page )?([0-9]+)(?: of | / |/)([0-9]+)$', 2) AS BIGINT) >= page, false))"""


@query(f"SELECT doc_id, line_no, {_PAGE.format(_KEY)} AS number, {_FORCE} AS force FROM ({_SAMPLE})")
def page_number_lines(spark, d):
    return _sample(spark, d).select("doc_id", "line_no", T.page_number(F.col("line"), F.col("page")).alias("number"), T.operative(F.col("line")).alias("force"))


@query(rf"""SELECT doc_id, line_no, strlen(trim(line)) <= 120 AND len(string_split({_KEY}, ' ')) <= 12 AND NOT regexp_matches(trim(line), '^§*\s*[0-9]+(\.[0-9]+)*[.)]*\s+\p{{Lu}}') AND NOT {_FORCE} AND NOT regexp_matches(line, '[.;!?$€]')
 AND ({_KEY} IN {T.LABELS} OR (contains({_KEY}, ' | ') AND {_PAGE.format("list_extract(string_split(" + _KEY + ", ' | '), -1)")}) OR (upper(line) = line AND regexp_matches({_KEY}, '({"|".join(T.TITLE_KINDS)})$'))) AS label FROM ({_SAMPLE})""")
def running_labels(spark, d):
    return _sample(spark, d).select("doc_id", "line_no", T.running_label(F.col("line"), F.col("page")).alias("label"))


@query(rf"""SELECT doc_id, line_no, regexp_matches({_KEY}, '^exhibit [a-z0-9]+(\.[a-z0-9]+)*$') AND regexp_matches({_KEY}, ' .*[0-9]') AS filing,
 NOT {_FORCE} AND regexp_matches(line, '^EX-[0-9]+(\.[0-9]+)*\s+[0-9]+\s+[A-Za-z0-9._-]*\.(htm|html|txt|TXT)(\s|$)') AS header FROM ({_SAMPLE})""")
def filing_lines(spark, d):
    return _sample(spark, d).select("doc_id", "line_no", T.filing_label(F.col("line")).alias("filing"), T.filing_header(F.col("line")).alias("header"))


@query(rf"""SELECT doc_id, line_no, regexp_matches({_KEY}, '^(({"|".join(T.WEEKDAYS)}),* )?({"|".join(T.MONTHS)}) [0-9]+,* [0-9]{{4}}$') AND coalesce(TRY_CAST(regexp_extract(regexp_replace({_KEY}, '^[a-z]+,+ ', ''), '[0-9]+') AS BIGINT), 0) BETWEEN 1 AND 31 AS label,
 regexp_matches(lower(line), '(^|\s)[,;:!?()]*({"|".join(T.MONTHS)})[.,;:!?()]*\s+[0-9]{{1,2}}[.,;:!?()]*\s+([0-9]{{2}}|[0-9]{{4}})[.,;:!?()]*(\s|$)') AS named,
 length(line) <= 32 AND regexp_matches(line, '^[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{2}}|[0-9]{{4}})\s+[A-Za-z]{{1,2}}-[0-9]{{1,3}}$') AS stamp, regexp_matches(line, '\p{{L}}\p{{M}}*\p{{L}}') AS worded FROM ({_SAMPLE})""")
def date_lines(spark, d):
    s = F.col("line")
    return _sample(spark, d).select("doc_id", "line_no", T.date_label(s).alias("label"), T.named_date_marker(s).alias("named"), T.date_stamp(s).alias("stamp"), T.multi_letter_word(s).alias("worded"))


@query(rf"""SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\s*[^:\p{{L}}\p{{N}}]*\p{{L}}[\p{{L}}\p{{N}}\s/()''’&#-]*:') AND trim(substr(line, strpos(line, ':') + 1)) <> '' THEN substr(trim(line), strpos(trim(line), ':') + 1) END AS value FROM ({_SAMPLE})""")
def label_values(spark, d):
    return _sample(spark, d).select("doc_id", "line_no", T.label_value(F.col("line")).alias("value"))


@query(rf"""SELECT doc_id, line_no, regexp_matches(regexp_replace(trim(line), '[.:]$', ''), '^[\p{{L}}\s&/''-]+$') AND regexp_matches(line, '(^|[^\p{{L}}])\p{{Lu}}')
 AND len(list_filter(regexp_extract_all(line, '\p{{L}}+'), lambda w: w NOT IN {T.CONNECTORS} AND NOT regexp_matches(w, '^(\p{{Lu}}+|\p{{Lu}}\p{{Ll}}*)$'))) = 0 AS title,
 regexp_matches(replace(lower(line), 'not only', ''), '(^|[^\p{{L}}\p{{N}}])(({"|".join(T.NEGATIONS)})([^\p{{L}}\p{{N}}]|$)|({"|".join(T.BEFORE_T)})[^\p{{L}}\p{{N}}]+t([^\p{{L}}\p{{N}}]|$))') AS negated FROM ({_SAMPLE})""")
def clause_lines(spark, d):
    return _sample(spark, d).select("doc_id", "line_no", T.clause_title(F.col("line")).alias("title"), T.negation(F.col("line")).alias("negated"))


_COMPLETE = r"""regexp_matches({0}, '([\p{{L}}\p{{N}}]|\p{{N}}\s*[%‰‱°\p{{Sc}}])["''”’)\]}}]*[.!?。！？]["''”’)\]}}]*$')"""


@query(rf"""SELECT doc_id, line_no, length(line) = 11 AND line NOT LIKE ' %' AND trim(line) <> '' AND NOT {_COMPLETE.format('line')} AS clipped, array_to_string(list_filter([CASE WHEN line = '' OR trim(line) <> line THEN 'nonempty_already_trimmed_text' END,
 CASE WHEN length(line) > 384 THEN 'maximum_claim_characters' END, CASE WHEN NOT {_COMPLETE.format('line')} THEN 'complete_sentence_terminal_punctuation_no_cutoff' END], lambda x: x IS NOT NULL), ',') AS broken FROM ({_SAMPLE})""")
def paraphrase_checks(spark, d):
    return _sample(spark, d).select("doc_id", "line_no", T.clipped(F.col("line"), 11).alias("clipped"), F.array_join(T.paraphrase_violations(F.col("line")), ",").alias("broken"))


@query("SELECT conv_id, CAST(sum(strlen(repeat(text, 1 + conv_id % 200))) AS BIGINT) AS bytes, sum(strlen(repeat(text, 1 + conv_id % 200))) <= 262144 AS fits FROM conversations GROUP BY 1")
def corrected_bytes(spark, d):
    pages = _table(spark, d, "conversations").selectExpr("conv_id", "repeat(text, cast(1 + conv_id % 200 AS int)) AS text")
    g = pages.groupBy("conv_id").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return g.select("conv_id", "bytes", (F.col("bytes") <= 262144).alias("fits"))


@query("SELECT l_orderkey, min(p_size) AS first_page, max(p_size) AS last_page FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def ranker_candidates(spark, d):
    cited = _table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return cited.join(_table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").groupBy("l_orderkey").agg(F.min("p_size").alias("first_page"), F.max("p_size").alias("last_page"))


_SHIFTED = "CASE WHEN conv_id % 4 = 1 AND turn > 0 THEN turn + 1 WHEN conv_id % 4 = 2 AND turn = 2 THEN 1 ELSE turn END"


@query(f"SELECT conv_id, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous FROM (SELECT conv_id, {_SHIFTED} AS turn FROM conversations) GROUP BY 1")
def contiguous_blocks(spark, d):
    rows = _table(spark, d, "conversations").selectExpr("conv_id", f"{_SHIFTED} AS turn")
    return rows.groupBy("conv_id").agg(((F.count("*") == F.countDistinct("turn")) & (F.min("turn") == 0) & (F.max("turn") == F.count("*") - 1)).alias("contiguous"))


_NOISE = ("... --- ***", "~~ 5 ~~", "a . - . - . -", "< {n} |", "call (703) 696-{n}59?", "+1 555 12{n}", "703 696 4959", "$ 5", "1 | 2", "3 kg", "3 m .", "ok", "?? !! |", "1 .", "03/10/03 A-{n}", "")


def _noisy(spark, d):
    return _shaped(spark, d, _NOISE)


_NOISY = _shaped_sql(_NOISE)
_VALUE = T.MARKED_NUMBER
_CLASSED = rf"""SELECT *, CASE WHEN solid = '' THEN NULL WHEN regexp_matches(line, '^[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{2}}|[0-9]{{4}})\s+[A-Za-z]{{1,2}}-[0-9]{{1,3}}$') THEN 'date_page_stamp'
 WHEN NOT regexp_matches(line, '\p{{L}}\p{{M}}*\p{{L}}') AND NOT number AND length(regexp_replace(solid, '[^\p{{P}}\p{{S}}\p{{Cc}}]', '', 'g')) * 5 >= length(solid) * 4 THEN 'scan_noise' END AS class
 FROM (SELECT *, regexp_replace(line, '\s', '', 'g') AS solid, regexp_matches(line, '\p{{N}}') AND (regexp_matches(line, '[\p{{Sc}}%‰‱°]') OR regexp_matches(line, '^[\p{{N}}\s+.,/:()-]*$'))
 OR len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: regexp_matches(w, '^{_VALUE}$'))) >= 2 OR regexp_matches(line, '\p{{N}}\p{{N}}')
 OR regexp_matches(line, '(^|\s)(<=|>=|!=|[<>=≤≥≠])\s*{T.NUMBER}[|;,]*(\s|$)') OR regexp_matches(line, '(^|\s){T.NUMBER}\s*[{T.UNITS}](\s|$)') AS number FROM ({_NOISY}))"""


@query(f"SELECT doc_id, line_no, number, class FROM ({_CLASSED})")
def page_classes(spark, d):
    return _noisy(spark, d).select("doc_id", "line_no", T.numeric_content(F.col("line")).alias("number"), T.page_class(F.col("line")).alias("class"))


@query(f"SELECT doc_id, bool_or(contains(line, chr(65533)) OR coalesce(class = 'scan_noise', false)) AS risk FROM ({_CLASSED}) GROUP BY 1")
def text_layer_risk(spark, d):
    risky = F.contains(F.col("line"), F.lit("�")) | F.coalesce(T.page_class(F.col("line")) == "scan_noise", F.lit(False))
    return _noisy(spark, d).groupBy("doc_id").agg(F.bool_or(risky).alias("risk"))


@query(rf"""SELECT doc_id, line_no, len(list_filter(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform([1, 2, 3], lambda k: array_to_string(w[i : least(i + k - 1, len(w))], '')))),
 lambda x: regexp_matches(x, '^[0-9+().-]+$') AND regexp_matches(x, '[+()-]') AND length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)) > 0 AS phone
 FROM (SELECT doc_id, line_no, list_transform(regexp_split_to_array(trim(line), '\s+'), lambda x: trim(x, ',;:!"''“”‘’?')) AS w FROM ({_NOISY}))""")
def phone_markers(spark, d):
    return _noisy(spark, d).select("doc_id", "line_no", T.phone_marker(F.col("line")).alias("phone"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from quillstone.plans import structure  # noqa: E402, F401  (each module registers its queries)
from quillstone.plans import runs  # noqa: E402, F401
from quillstone.plans import planning as _planning  # noqa: E402, F401
from quillstone.plans import rules  # noqa: E402, F401
from quillstone.plans import files  # noqa: E402, F401
from quillstone.plans import furniture as _furniture  # noqa: E402, F401
from quillstone.plans import claims  # noqa: E402, F401
from quillstone.plans import models  # noqa: E402, F401
