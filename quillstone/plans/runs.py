"""Runs, retries, ledgers and corrections: orders stand for runs, events for their log, in states dealt out by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import ledger, lineage
from quillstone.plans.registry import query, table


def _case(value: str, names) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(names)) + " END"


_RUN = {
    "run_id": "o_orderkey", "document_id": "o_custkey", "state": _case(f"o_orderkey % {len(lineage.PATH)}", lineage.PATH), "state_version": "o_orderkey % 4 + 1", "resumable": "o_orderkey % 3 <> 0",
    "cancellation_requested": "o_orderkey % 5 = 0", "recoverable": "o_orderkey % 7 <> 0", "failed_stage": "CASE WHEN o_orderkey % 22 = 21 THEN CASE o_orderkey % 4 WHEN 0 THEN 'ingest' WHEN 1 THEN 'parse' ELSE 'verify' END END", "created_at": "o_orderdate",
}
_RUNS = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _RUN.items()) + " FROM orders)"
_GRAPH = ", ".join(map(str, lineage.edges()))


def _runs(spark, d):
    return table(spark, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _RUN.items()])


_EVENT = {"state": _case(f"least(i, {len(lineage.PATH) - 5})", lineage.PATH[: len(lineage.PATH) - 4])}
_SEQ = "SELECT user_id AS run_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"
_STEP = f"CASE WHEN event_type = 'error' AND i % 9 = 0 THEN 'failed' ELSE {_EVENT['state']} END"
_LOG = f"SELECT run_id, CASE WHEN run_id % 13 = 5 AND i > 6 THEN i + 1 ELSE i END AS sequence_no, {_STEP} AS next_state, CASE WHEN run_id % 11 = 3 AND i = 4 THEN 9 ELSE i + 1 END AS state_version, i, event_id FROM ({_SEQ})"
_LOGGED = f"SELECT *, CASE WHEN run_id % 7 = 2 AND i = 5 THEN 'received' ELSE lag(next_state) OVER (PARTITION BY run_id ORDER BY sequence_no) END AS previous_state FROM ({_LOG})"


def _sql(spark, d, text: str, *tables: str):
    """The decorated input by Spark's own SQL, over views that last as long as this call."""
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM parquet.`{d}/{t}.parquet`").replace(f"JOIN {t}", f"JOIN parquet.`{d}/{t}.parquet`")
    return spark.sql(text)


@query(f"""WITH l AS ({_LOGGED}), s AS (SELECT *, lag(next_state) OVER w AS stood, lag(state_version) OVER w AS was, row_number() OVER w - 1 AS rank FROM l WINDOW w AS (PARTITION BY run_id ORDER BY sequence_no))
 SELECT run_id, sequence_no, code FROM (SELECT run_id, sequence_no, unnest([CASE WHEN sequence_no <> rank THEN 'SEQUENCE_GAP' END, CASE WHEN rank > 0 AND stood IS DISTINCT FROM previous_state THEN 'STALE_STATE' END,
 CASE WHEN previous_state IS NOT NULL AND (previous_state, next_state) NOT IN ({_GRAPH}) THEN 'INVALID_TRANSITION' END, CASE WHEN rank > 0 AND state_version <> was + 1 THEN 'STALE_VERSION' END]) AS code FROM s) WHERE code IS NOT NULL""")
def log_violations(spark, d):
    events = _sql(spark, d, _LOGGED, "events").select("run_id", "sequence_no", "previous_state", "next_state", "state_version")
    return lineage.log_violations(events).select("run_id", F.col("sequence_no").cast("long").alias("sequence_no"), "code")


@query(f"SELECT event_id, before, after FROM (SELECT event_id, next_state AS after, lag(next_state) OVER (PARTITION BY run_id ORDER BY i) AS before FROM ({_LOG})) WHERE before IS NOT NULL AND (before, after) NOT IN ({_GRAPH})")
def invalid_transitions(spark, d):
    events = _sql(spark, d, _LOG, "events").withColumn("sequence_no", F.col("i"))
    return lineage.invalid_transitions(events, "run_id", "next_state").select("event_id", "before", "after")


@query(f"""SELECT run_id, CASE WHEN failed_stage IS NULL AND state NOT IN {lineage.TERMINAL} AND NOT cancellation_requested AND resumable AND state IN {tuple(lineage.CHECKPOINTS)} THEN state END AS continuation,
 state = 'failed' AND resumable AND recoverable AND failed_stage IS NOT NULL AND failed_stage <> 'ingest' AS retryable FROM {_RUNS}""".replace("AS retryable", "IS TRUE AS retryable").replace("state = 'failed' AND resumable AND recoverable AND failed_stage IS NOT NULL AND failed_stage <> 'ingest' IS", "(state = 'failed' AND resumable AND recoverable AND failed_stage IS NOT NULL AND failed_stage <> 'ingest') IS"))
def checkpoints(spark, d):
    c = F.col
    point = lineage.continuation(c("state"), c("failed_stage").isNotNull(), c("state").isin(*lineage.TERMINAL), c("cancellation_requested"), c("resumable"))
    return _runs(spark, d).select("run_id", point.alias("continuation"), lineage.retryable(c("state"), c("resumable"), c("recoverable"), c("failed_stage")).alias("retryable"))


_ASKED = f"(SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 10 = 9 THEN 'received' ELSE {_RUN['state']} END AS expected_state, CASE WHEN o_orderkey % 6 = 5 THEN 9 ELSE {_RUN['state_version']} END AS expected_version, {_case(f'(o_orderkey + 1) % {len(lineage.PATH)}', lineage.PATH)} AS next_state FROM orders)"


@query(f"""SELECT run_id, next_state, code, CASE WHEN code IS NULL THEN state_version + 1 END AS state_version FROM (SELECT a.run_id, a.next_state, r.state_version, CASE WHEN r.state <> expected_state THEN 'STALE_STATE' WHEN r.state_version <> expected_version THEN 'CONCURRENT_MODIFICATION'
 WHEN (r.state, a.next_state) NOT IN ({_GRAPH}) THEN 'INVALID_TRANSITION' END AS code FROM {_ASKED} a JOIN {_RUNS} r USING (run_id))""")
def transition_requests(spark, d):
    return lineage.transitions(_sql(spark, d, f"SELECT * FROM {_ASKED}", "orders"), _runs(spark, d))


@query(f"""SELECT run_id, code, CASE WHEN code IS NULL THEN 'cancelling' END AS next_state, CASE WHEN code IS NULL THEN {_case('list_position(' + str(list(lineage.ACTIVE)) + ', state) - 1', lineage.ACTIVE.values())} END AS stage FROM (SELECT *, CASE WHEN state IN {(*lineage.TERMINAL, 'cancelling')} THEN 'CANCELLATION_NOT_ALLOWED'
 WHEN state_version <> 2 THEN 'CONCURRENT_MODIFICATION' END AS code FROM {_RUNS})""")
def cancellation_requests(spark, d):
    return lineage.cancellations(table(spark, d, "orders").selectExpr("o_orderkey AS run_id", "2 AS expected_version"), _runs(spark, d))


@query(f"""SELECT run_id, state, next_state, CASE next_state WHEN 'failed' THEN 'PROCESS_INTERRUPTED' WHEN 'cancelled' THEN 'cancellation_completed_after_restart' ELSE 'child_rewound_after_restart' END AS reason, state_version + 1 AS state_version FROM
 (SELECT *, CASE WHEN state = 'cancelling' THEN 'cancelled' WHEN run_id % 6 = 0 THEN {_case('list_position(' + str(list(lineage.REWINDS)) + ', state) - 1', lineage.REWINDS.values())} WHEN state IN {tuple(lineage.ACTIVE)} THEN 'failed' END AS next_state FROM {_RUNS}) WHERE next_state IS NOT NULL""")
def interrupted_runs(spark, d):
    runs = _runs(spark, d)
    return lineage.recoveries(runs, runs.where("run_id % 6 = 0").select("run_id"))


_RETRIED = "(SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 8 = 1)"
_RETRY_CODE = f"""CASE WHEN state <> 'failed' THEN 'NOT_FAILED' WHEN state_version <> CASE WHEN run_id % 9 = 2 THEN 0 ELSE run_id % 4 + 1 END THEN 'CONCURRENT_MODIFICATION'
 WHEN NOT (resumable AND recoverable AND failed_stage <> 'ingest') THEN 'NO_CHECKPOINT' WHEN run_id % 6 = 5 THEN 'NO_PROFILE' WHEN run_id % 8 = 1 THEN 'RETRY_EXISTS' END"""


def _retry_sources(spark, d):
    runs = _runs(spark, d)
    requests = runs.selectExpr("run_id AS source_run_id", "CASE WHEN run_id % 9 = 2 THEN 0 ELSE run_id % 4 + 1 END AS expected_version").where("source_run_id % 22 = 21 or source_run_id % 50 = 0")
    profiles = runs.where("run_id % 6 <> 5").selectExpr("run_id", "concat('p', run_id % 3) AS profile")
    return lineage.retry_sources(requests, runs, profiles, runs.where("run_id % 8 = 1").selectExpr("run_id AS source_run_id")), profiles


@query(f"SELECT run_id AS source_run_id, document_id, {_RETRY_CODE} AS code FROM {_RUNS} WHERE run_id % 22 = 21 OR run_id % 50 = 0")
def retry_sources(spark, d):
    return _retry_sources(spark, d)[0]


@query(f"""SELECT 'retry-' || sha256(CAST(run_id AS VARCHAR)) AS run_id, document_id, run_id AS source_run_id, 'parsing' AS state, 'p' || run_id % 3 AS profile FROM {_RUNS} WHERE (run_id % 22 = 21 OR run_id % 50 = 0) AND {_RETRY_CODE} IS NULL""")
def created_retries(spark, d):
    sources, profiles = _retry_sources(spark, d)
    runs, lineage_rows, copied = lineage.create_retries(sources, profiles, F.lit("2024-01-01").cast("timestamp"))
    return runs.join(lineage_rows.withColumnRenamed("retry_run_id", "run_id").select("run_id", "source_run_id"), "run_id").join(copied.select("run_id", "profile"), "run_id").select("run_id", "document_id", "source_run_id", "state", "profile")


@query("""WITH e AS (SELECT o_orderkey AS retry_run_id, o_orderkey - o_orderkey % 5 - 1 AS source_run_id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 = 0)
 SELECT e.retry_run_id, e.source_run_id FROM e JOIN orders a ON a.o_orderkey = e.retry_run_id JOIN orders b ON b.o_orderkey = e.source_run_id WHERE a.o_custkey % 5 = b.o_custkey % 5 AND e.created_at = a.o_orderdate""")
def retry_lineage(spark, d):
    o = table(spark, d, "orders")
    retries = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS retry_run_id", "o_orderkey - o_orderkey % 5 - 1 AS source_run_id", "o_orderdate AS created_at")
    return lineage.retry_lineage(retries, o.selectExpr("o_orderkey AS run_id", "o_custkey % 5 AS document_id", "o_orderdate AS created_at"))


@query(f"""SELECT r.run_id, state, CASE WHEN run_id % 9 = 4 THEN run_id - 1 END AS retry_of, CASE WHEN run_id % 9 = 3 AND run_id + 1 <= (SELECT max(o_orderkey) FROM orders) THEN run_id + 1 END AS retried_by,
 (state = 'failed' AND resumable AND recoverable AND failed_stage <> 'ingest' AND NOT (run_id % 9 = 3 AND run_id + 1 <= (SELECT max(o_orderkey) FROM orders)) AND run_id % 4 <> 1) IS TRUE AS can_retry, point AS checkpoint,
 (point IS NOT NULL AND (point NOT IN ('analyzed', 'synthesized', 'verified') OR run_id % 4 <> 1) AND run_id % 10 <> 0) AS can_continue, state = 'complete' AS has_summary
 FROM (SELECT *, CASE WHEN failed_stage IS NULL AND NOT cancellation_requested AND resumable AND state IN {tuple(lineage.CHECKPOINTS)} THEN state END AS point FROM {_RUNS}) r""")
def run_history(spark, d):
    runs = _runs(spark, d)
    retries = runs.where("run_id % 9 = 4").selectExpr("run_id AS retry_run_id", "run_id - 1 AS source_run_id")
    return lineage.history(runs, retries, runs.where("run_id % 4 <> 1"), runs.where("run_id % 10 = 0"), runs.where("state = 'complete'"))


@query(f"SELECT run_id, state FROM {_RUNS} WHERE (run_id % 2 = 0) <> (state IN {lineage.FINISHED})")
def summary_mismatches(spark, d):
    runs = _runs(spark, d)
    return lineage.summary_mismatches(runs, runs.where("run_id % 2 = 0"))


@query(f"SELECT run_id, state FROM {_RUNS} WHERE state IN {(*lineage.ACTIVE, 'cancelling')} ORDER BY run_id")
def active_runs(spark, d):
    return _runs(spark, d).where(F.col("state").isin(*lineage.ACTIVE, "cancelling")).select("run_id", "state").orderBy("run_id")


@query("""SELECT run_id, CASE WHEN NOT bool_and(profile IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) THEN 'UNKNOWN_VALUE' ELSE 'CHANGED' END AS code FROM (SELECT o_custkey AS run_id, o_orderpriority AS profile FROM orders) GROUP BY 1 HAVING count(DISTINCT profile) > 1 OR NOT bool_and(profile IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))""")
def profile_conflicts(spark, d):
    return lineage.immutable_conflicts(table(spark, d, "orders").selectExpr("o_custkey AS run_id", "o_orderpriority AS profile"), "run_id", "profile", ("1-URGENT", "2-HIGH", "3-MEDIUM"))


@query("SELECT 'handoff-' || sha256(CAST(run_id AS VARCHAR)) AS handoff_id, run_id, 'prepared' AS phase FROM (SELECT DISTINCT o_custkey AS run_id FROM orders) WHERE run_id % 4 <> 0")
def prepared_handoffs(spark, d):
    roots = table(spark, d, "orders").selectExpr("o_custkey AS run_id")
    return lineage.handoffs(roots, roots.where("run_id % 4 = 0"))


@query("""SELECT 'child-' || sha256('h' || o_orderkey) AS child_run_id, 'h' || o_orderkey AS handoff_id, o_orderkey AS run_id, o_custkey AS document_id, 'child_admitted' AS phase FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)""")
def admitted_children(spark, d):
    prepared = table(spark, d, "orders").selectExpr("concat('h', o_orderkey) AS handoff_id", "o_orderkey AS run_id", "o_custkey AS document_id", "CASE WHEN o_orderkey % 3 = 1 THEN 'provider_completed' ELSE 'prepared' END AS phase")
    runs, moved = lineage.admit_children(prepared, table(spark, d, "customer").where("c_nationkey < 12").selectExpr("c_custkey AS document_id"))
    return moved.join(runs.select(F.col("run_id").alias("child_run_id"), "document_id"), "child_run_id").select("child_run_id", "handoff_id", "run_id", "document_id", "phase")


@query("""SELECT handoff_id, CASE WHEN phase = expected AND next = 'submitted' AND expected = 'prepared' THEN next ELSE phase END AS phase, phase = expected AND next = 'submitted' AND expected = 'prepared' AS changed FROM
 (SELECT o_orderkey AS handoff_id, CASE o_orderkey % 3 WHEN 0 THEN 'prepared' WHEN 1 THEN 'submitted' ELSE 'completed' END AS phase, 'prepared' AS expected, CASE WHEN o_orderkey % 2 = 0 THEN 'submitted' ELSE 'completed' END AS next FROM orders)""")
def handoff_phases(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS handoff_id", "CASE o_orderkey % 3 WHEN 0 THEN 'prepared' WHEN 1 THEN 'submitted' ELSE 'completed' END AS phase")
    requests = rows.selectExpr("handoff_id", "'prepared' AS expected", "CASE WHEN handoff_id % 2 = 0 THEN 'submitted' ELSE 'completed' END AS next")
    return lineage.compare_and_set(rows, requests, "handoff_id", "phase", [("prepared", "submitted"), ("submitted", "completed")])


@query("SELECT job_id, CASE WHEN status IN ('accepted', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('accepted', 'running') THEN 'PROCESS_INTERRUPTED' END AS error FROM (SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status FROM orders)")
def interrupted_jobs(spark, d):
    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status")
    active = F.col("status").isin("accepted", "running")
    return jobs.select("job_id", F.when(active, "failed").otherwise(F.col("status")).alias("status"), F.when(active, lineage.INTERRUPTED).alias("error"))


_JOB_CODE = "CASE WHEN job_id % 5 = 0 AND job_id % 10 = 0 THEN 'REQUEST_CONFLICT' WHEN provider = 'FURNITURE' THEN 'PROVIDER_CLOSED' END"
_JOBS = "(SELECT c_custkey AS job_id, c_mktsegment AS provider, c_nationkey AS document_id, concat('h', c_custkey) AS request_hash FROM customer)"


@query(f"""SELECT job_id, {_JOB_CODE} AS outcome, CAST(NULL AS VARCHAR) AS run_id, CAST(0 AS BIGINT) AS n_events FROM {_JOBS} WHERE {_JOB_CODE} IS NOT NULL
 UNION ALL SELECT job_id, 'accepted', 'run-' || sha256(CAST(job_id AS VARCHAR)), CAST(1 AS BIGINT) FROM {_JOBS} WHERE {_JOB_CODE} IS NULL AND job_id % 5 <> 0""")
def admitted_jobs(spark, d):
    jobs = _sql(spark, d, f"SELECT * FROM {_JOBS}", "customer")
    known = jobs.where("job_id % 5 = 0").selectExpr("job_id", "CASE WHEN job_id % 10 = 0 THEN 'other' ELSE request_hash END AS request_hash")
    rows, runs, events, refused = lineage.admit_jobs(jobs, known, jobs.where("provider <> 'FURNITURE'").select("provider"))
    logged = events.groupBy("run_id").agg(F.count("*").alias("n_events"))
    taken = rows.join(runs.select("run_id"), "run_id").join(logged, "run_id").select("job_id", F.col("status").alias("outcome"), "run_id", "n_events")
    return taken.union(refused.select("job_id", F.col("code").alias("outcome"), F.lit(None).cast("string"), F.lit(0).cast("long")))


@query("""SELECT 'artifact_run' AS rule, CAST(l_orderkey AS VARCHAR) AS key FROM (SELECT DISTINCT l_orderkey + CASE WHEN l_orderkey % 50 = 7 THEN 10000000 ELSE 0 END AS l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT DISTINCT 'run_document', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)
 UNION ALL SELECT 'run_status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def schema_violations(spark, d):
    artifacts = table(spark, d, "lineitem").selectExpr("l_orderkey + CASE WHEN l_orderkey % 50 = 7 THEN 10000000 ELSE 0 END AS run_id").distinct()
    orders = table(spark, d, "orders")
    return lineage.dangling(artifacts, "run_id", orders, "o_orderkey", "artifact_run").union(lineage.dangling(orders, "o_custkey", table(spark, d, "customer").where("c_nationkey <> 3"), "c_custkey", "run_document")).union(lineage.outside(orders, "o_orderkey", "o_orderstatus", ("F", "O"), "run_status"))


_CALL = """(SELECT event_id, user_id % 40 AS owner, event_type AS stage, event_id % 6 AS ordinal, sha256(concat('x', event_id % 240)) AS semantic_hash, event_id % 17 = 3 AS late FROM events)"""


@query(f"""WITH r AS (SELECT 'o' || owner AS owner_id, stage, ordinal, CASE WHEN event_id % 19 = 1 THEN 'short' ELSE semantic_hash END AS semantic_hash, late FROM {_CALL}),
 k AS (SELECT owner_id, stage, ordinal, min(semantic_hash) AS kept FROM r WHERE semantic_hash <> 'short' AND NOT late GROUP BY 1, 2, 3),
 s AS (SELECT owner_id, stage, ordinal, sha256('x0') AS stored FROM k WHERE ordinal = 0)
 SELECT owner_id, stage, ordinal, semantic_hash, CASE WHEN semantic_hash = 'short' OR late THEN 'INVALID_INPUT' WHEN coalesce(stored, kept) <> semantic_hash THEN 'SEMANTIC_CONFLICT' END AS code FROM r LEFT JOIN k USING (owner_id, stage, ordinal) LEFT JOIN s USING (owner_id, stage, ordinal)""")
def ledger_reservations(spark, d):
    now = F.lit("2024-01-01").cast("timestamp")
    calls = table(spark, d, "events").selectExpr("concat('o', user_id % 40) AS owner_id", "event_type AS stage", "event_id % 6 AS ordinal", "CASE WHEN event_id % 19 = 1 THEN 'short' ELSE sha2(concat('x', event_id % 240), 256) END AS semantic_hash", "CASE WHEN event_id % 17 = 3 THEN timestamp '2023-12-31 00:00:00' ELSE timestamp '2024-06-01 00:00:00' END AS expires_at")
    stored = calls.where("ordinal = 0 and semantic_hash <> 'short' and expires_at > timestamp '2024-01-01 00:00:00'").select("owner_id", "stage", "ordinal").distinct().withColumn("semantic_hash", F.sha2(F.lit("x0"), 256))
    return ledger.reserve(calls, stored, now)[1]


_ENTRY = """(SELECT concat('o', o_custkey) AS owner_id, o_orderpriority AS stage, o_orderkey AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN 'reserved' WHEN 1 THEN 'submitted' WHEN 2 THEN 'completed' ELSE 'acknowledged' END AS state,
 CASE WHEN o_orderkey % 4 > 0 THEN concat('', repeat('a', 64)) END AS request_hash, o_orderkey % 7 = 0 AS late FROM orders)"""


@query(f"""SELECT owner_id, stage, ordinal, code, CASE WHEN code IS NULL AND state = 'reserved' THEN 'submitted' ELSE state END AS state FROM (SELECT *, CASE WHEN ordinal % 9 = 4 THEN 'INVALID_INPUT' WHEN request_hash <> CASE WHEN ordinal % 5 = 3 THEN repeat('b', 64) ELSE repeat('a', 64) END THEN 'SUBMISSION_CONFLICT'
 WHEN state = 'reserved' AND late THEN 'EXPIRED' END AS code FROM {_ENTRY})""")
def ledger_submissions(spark, d):
    entries = _sql(spark, d, f"SELECT *, CASE WHEN late THEN timestamp '2023-12-31 00:00:00' ELSE timestamp '2024-06-01 00:00:00' END AS expires_at FROM {_ENTRY}", "orders")
    asked = entries.selectExpr("owner_id", "stage", "ordinal", "CASE WHEN ordinal % 9 = 4 THEN 'zz' WHEN ordinal % 5 = 3 THEN repeat('b', 64) ELSE repeat('a', 64) END AS request_hash")
    return ledger.submit(asked, entries, F.lit("2024-01-01").cast("timestamp"))


@query(f"""SELECT owner_id, stage, ordinal, code, CASE WHEN code IS NULL AND state = 'submitted' THEN 'completed' ELSE state END AS state, CASE WHEN code IS NULL THEN told ELSE completion_hash END AS completion_hash FROM (SELECT *, CASE WHEN request_hash IS DISTINCT FROM repeat('a', 64) THEN 'SUBMISSION_CONFLICT'
 WHEN state = 'reserved' THEN 'INVALID_TRANSITION' WHEN state IN ('completed', 'acknowledged') AND completion_hash <> told THEN 'COMPLETION_CONFLICT' END AS code FROM (SELECT *, sha256('{{"n":' || ordinal % 3 || '}}') AS told, CASE WHEN ordinal % 4 > 1 THEN sha256('{{"n":1}}') END AS completion_hash FROM {_ENTRY}))""")
def ledger_completions(spark, d):
    entries = _sql(spark, d, f"SELECT *, CASE WHEN ordinal % 4 > 1 THEN sha2('{{\"n\":1}}', 256) END AS completion_hash FROM {_ENTRY}", "orders")
    return ledger.complete(entries.selectExpr("owner_id", "stage", "ordinal", "repeat('a', 64) AS request_hash", "concat('{\"n\":', ordinal % 3, '}') AS completion"), entries)


@query(f"SELECT owner_id, stage, ordinal, CASE WHEN state IN ('reserved', 'submitted') THEN 'INVALID_TRANSITION' END AS code, CASE WHEN state IN ('completed', 'acknowledged') THEN 'acknowledged' ELSE state END AS state FROM {_ENTRY}")
def ledger_acknowledgements(spark, d):
    entries = _sql(spark, d, f"SELECT * FROM {_ENTRY}", "orders")
    return ledger.acknowledge(entries.select(*ledger.KEY), entries)


@query(f"""SELECT DISTINCT owner_id, stage, ordinal FROM (SELECT 'o' || user_id AS owner_id, 's' AS stage, 1 AS ordinal, r < lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM
 (SELECT user_id, ts, event_id, CASE WHEN user_id % 4 = 0 AND i % 6 = 5 THEN 1 ELSE least(i, 3) END AS r FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events))) WHERE back""")
def ledger_backward_steps(spark, d):
    rows = _sql(spark, d, "SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events", "events")
    state = F.element_at(F.array(*map(F.lit, ledger.STATES)), F.expr("cast(CASE WHEN user_id % 4 = 0 AND i % 6 = 5 THEN 1 ELSE least(i, 3) END + 1 AS int)"))
    return ledger.backward_steps(rows.select(F.concat(F.lit("o"), "user_id").alias("owner_id"), F.lit("s").alias("stage"), F.lit(1).alias("ordinal"), F.struct("ts", "event_id").alias("at"), state.alias("state")))


@query("""WITH p AS (SELECT conv_id AS document_id, turn + 1 AS page_number, text FROM conversations), e AS (SELECT document_id, CASE WHEN document_id % 7 = 1 THEN 1 WHEN document_id % 7 = 2 THEN 99 ELSE page_number END AS page_number,
 CASE WHEN document_id % 7 = 3 THEN '  ' WHEN document_id % 7 = 4 THEN text WHEN document_id % 7 = 5 THEN repeat('x', 300000) ELSE text || '!' END AS text FROM p WHERE page_number <= 2),
 g AS (SELECT e.document_id, count(*) <> count(DISTINCT e.page_number) AS twice, bool_or(p.text IS NULL) AS unknown, bool_or(trim(e.text) = '') AS blank, bool_or(e.text <> p.text) AS changed, sum(strlen(e.text) - strlen(p.text)) AS grown FROM e LEFT JOIN p USING (document_id, page_number) GROUP BY 1)
 SELECT document_id, CASE WHEN twice THEN 'DUPLICATE_PAGE' WHEN unknown THEN 'UNKNOWN_PAGE' WHEN blank THEN 'INVALID_TEXT' WHEN NOT changed THEN 'NOTHING_CHANGED' WHEN bytes + grown > 262144 THEN 'TOO_LARGE' END AS code, CAST(bytes + grown AS BIGINT) AS bytes
 FROM g JOIN (SELECT document_id, sum(strlen(text)) AS bytes FROM p GROUP BY 1) USING (document_id)""")
def text_corrections(spark, d):
    pages = table(spark, d, "conversations").selectExpr("conv_id AS document_id", "turn + 1 AS page_number", "text")
    edits = pages.where("page_number <= 2").selectExpr("document_id", "CASE WHEN document_id % 7 = 1 THEN 1 WHEN document_id % 7 = 2 THEN 99 ELSE page_number END AS page_number", "CASE WHEN document_id % 7 = 3 THEN '  ' WHEN document_id % 7 = 4 THEN text WHEN document_id % 7 = 5 THEN repeat('x', 300000) ELSE concat(text, '!') END AS text")
    return ledger.correct(edits, pages).select("document_id", "code", F.col("bytes").cast("long").alias("bytes"))


@query(f"""SELECT run_id, code, CASE WHEN code IS NULL THEN CASE WHEN document_id % 6 = 2 THEN 's' || document_id ELSE 'run-' || sha256(run_id || 'n' || document_id % 3) END END AS corrected_run_id FROM (SELECT *, CASE WHEN state_version <> 2 OR document_id % 10 = 9 THEN 'STALE_SOURCE'
 WHEN document_id % 6 = 2 AND document_id % 12 <> 2 THEN 'ALREADY_CORRECTED' END AS code FROM {_RUNS})""")
def saved_corrections(spark, d):
    runs = _runs(spark, d)
    hashes = runs.selectExpr("document_id", "concat('h', document_id) AS parsed_hash").distinct()
    stored = runs.where("document_id % 6 = 2").selectExpr("document_id AS source_document_id", "concat('s', document_id) AS run_id", "CASE WHEN document_id % 12 = 2 THEN concat('n', document_id % 3) ELSE 'other' END AS corrected_hash").distinct()
    requests = runs.selectExpr("run_id", "2 AS expected_version", "CASE WHEN document_id % 10 = 9 THEN 'old' ELSE concat('h', document_id) END AS source_hash", "concat('n', document_id % 3) AS new_hash")
    return ledger.save(requests, runs, hashes, stored)


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 4 = 1 THEN o_custkey * 10 END AS correction_of, CASE WHEN o_custkey % 4 = 0 THEN o_custkey + 1 END AS corrected_by FROM orders""")
def correction_reviews(spark, d):
    runs = _runs(spark, d)
    rows = runs.select("document_id").distinct()
    made = rows.where("document_id % 4 = 1").selectExpr("document_id", "document_id * 10 AS source_run_id", "CAST(NULL AS BIGINT) AS source_document_id", "CAST(NULL AS BIGINT) AS run_id")
    of = rows.where("document_id % 4 = 0").selectExpr("CAST(NULL AS BIGINT) AS document_id", "CAST(NULL AS BIGINT) AS source_run_id", "document_id AS source_document_id", "document_id + 1 AS run_id")
    return ledger.reviews(runs, made.union(of))


@query("SELECT conv_id AS document_id, turn + 1 AS page_number, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'better ' || turn ELSE text END AS text, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'OPERATOR_CORRECTED_TEXT' END AS warning FROM conversations")
def corrected_pages(spark, d):
    pages = table(spark, d, "conversations").selectExpr("conv_id AS document_id", "turn + 1 AS page_number", "text", "turn")
    return ledger.with_corrections(pages.drop("turn"), pages.where("(document_id + turn) % 3 = 0").selectExpr("document_id", "page_number", "concat('better ', turn) AS text"))


@query("SELECT c_custkey AS run_id, count(o_orderkey) AS artifacts, count(o_orderkey) > 0 AS has_any FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def artifact_counts(spark, d):
    made = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("run_id"))
    counted = made.groupBy("run_id").agg(F.count("*").alias("n"))
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    return runs.join(counted, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("artifacts"), F.col("n").isNotNull().alias("has_any"))


@query("SELECT provider, jobs FROM (SELECT c_mktsegment AS provider, count(*) AS jobs FROM customer WHERE c_acctbal > 0 GROUP BY 1) ORDER BY provider LIMIT 2")
def active_providers(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("provider")).agg(F.count("*").alias("jobs")).orderBy("provider").limit(2)


@query("SELECT o_orderkey AS handoff_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey")
def recoverable_handoffs(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey AS handoff_id", "o_orderdate AS created_at").orderBy("created_at", "handoff_id")


@query("""SELECT document_id, code, CAST(n AS BIGINT) AS n FROM (SELECT o_custkey AS document_id, unnest(['LONG_CLAIMS', 'TECHNICAL_OMISSIONS']) AS code, unnest([count(*) FILTER (o_totalprice > 250000), count(*) FILTER (o_orderstatus = 'P')]) AS n FROM orders GROUP BY 1) WHERE n > 0""")
def counted_warnings(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.count_if(F.col("o_totalprice") > 250000).alias("LONG_CLAIMS"), F.count_if(F.col("o_orderstatus") == "P").alias("TECHNICAL_OMISSIONS"))
    return g.unpivot("document_id", ["LONG_CLAIMS", "TECHNICAL_OMISSIONS"], "code", "n").where("n > 0")


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS claims FROM lineitem GROUP BY 1")
def source_ordered_claims(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit(":"), r["l_partkey"].cast("string"))), ",").alias("claims"))


@query("SELECT l_orderkey, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS evidence, count(*) <= 5 AS within FROM (SELECT l_orderkey, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1")
def evidence_unions(spark, d):
    rows = table(spark, d, "lineitem")
    g = rows.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("b"))
    both = g.withColumn("u", F.sort_array(F.array_union("a", "b"))).where("size(u) > 0")
    return both.select("l_orderkey", F.array_join(F.transform("u", lambda x: x.cast("string")), ",").alias("evidence"), (F.size("u") <= 5).alias("within"))
