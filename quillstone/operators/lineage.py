"""Runs, events and their lineage, over append-only tables.

Nothing is updated in place: an operator takes the rows as they are and what is asked of them, and gives the rows to append,
or a code for each request that can't be met. A single writer commits them (sources/store.py); what another wrote meanwhile
shows as a stale version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: The stages in order, each with what a run is called while in it and once it is through.
STAGES = (
    ("ingest", "ingesting", "ingested"), ("parse", "parsing", "parsed"), ("normalize", "normalizing", "normalized"), ("structure", "structuring", "structured"),
    ("chunk", "chunking", "chunked"), ("analyze", "analyzing", "analyzed"), ("synthesize", "synthesizing", "synthesized"), ("verify", "verifying", "verified"),
)
FINISHED = ("complete", "complete_with_warnings")
TERMINAL = (*FINISHED, "failed", "cancelled")
PATH = ("received", *[s for _, a, b in STAGES for s in (a, b)], *FINISHED, "cancelling", "cancelled", "failed")
ACTIVE = {a: stage for stage, a, _ in STAGES}
CHECKPOINTS = {b: stage for stage, _, b in STAGES}
#: From an interrupted stage back to what was reached before it. Ingestion has nothing before it.
REWINDS = {STAGES[i][1]: STAGES[i - 1][2] for i in range(1, len(STAGES))}
INTERRUPTED = "PROCESS_INTERRUPTED"


def edges() -> list[tuple[str, str]]:
    """Every step (before, after) that a run may take."""
    way = [s for s in PATH if s not in TERMINAL and s != "cancelling"]
    steps = set(zip(way, way[1:])) | {("verified", s) for s in FINISHED} | set(REWINDS.items()) | {("cancelling", "cancelled")}
    steps |= {(s, t) for s in (*way, "cancelling") for t in ("failed", "cancelling")}
    return sorted(steps)


def _edges(rows: DataFrame, before: str = "before", after: str = "after", steps: list[tuple[str, str]] | None = None) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame(steps or edges(), f"{before} string, {after} string"))  # a fixed table of a few dozen rows


def numbered(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Gapless sequence_no from 0 within each run."""
    return events.withColumn("sequence_no", F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1)


def latest(events: DataFrame, run: str, order: list[str], *columns: str) -> DataFrame:
    """The last event of each run and how many there are: one aggregation with partial sums, no sort of the log."""
    g = events.groupBy(run).agg(F.max(F.struct(*order, *columns)).alias("x"), F.count("*").alias("n"))
    return g.select(run, (F.col("n") - 1).alias("sequence_no"), *[f"x.{c}" for c in columns])


def next_sequence(events: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """The number that each run's next event gets, 0 for a run without events."""
    counted = events.groupBy(run).agg(F.max("sequence_no").alias("last"))
    return runs.select(run).join(counted, run, "left").select(run, (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("next_sequence"))


def invalid_transitions(events: DataFrame, run: str, state: str, steps: list[tuple[str, str]] | None = None) -> DataFrame:
    """Steps of the log that the graph doesn't have."""
    seen = events.withColumn("before", F.lag(state).over(Window.partitionBy(run).orderBy("sequence_no"))).where("before is not null").withColumnRenamed(state, "after")
    return seen.join(_edges(events, steps=steps), ["before", "after"], "left_anti")


def log_violations(events: DataFrame) -> DataFrame:
    """run_id, sequence_no and code of each event that no compare-and-set could have written.

    events: run_id, sequence_no, previous_state, next_state, state_version (after the event).
    """
    w = Window.partitionBy("run_id").orderBy("sequence_no")
    seen = events.withColumns({"stood": F.lag("next_state").over(w), "was": F.lag("state_version").over(w), "rank": F.row_number().over(w) - 1})
    graph = _edges(events, "previous_state", "next_state").withColumn("valid", F.lit(True))
    seen = seen.join(graph, ["previous_state", "next_state"], "left")
    codes = F.array(
        F.when(F.col("sequence_no") != F.col("rank"), "SEQUENCE_GAP"), F.when((F.col("rank") > 0) & ~F.col("stood").eqNullSafe(F.col("previous_state")), "STALE_STATE"),
        F.when(F.col("previous_state").isNotNull() & F.col("valid").isNull(), "INVALID_TRANSITION"), F.when((F.col("rank") > 0) & (F.col("state_version") != F.col("was") + 1), "STALE_VERSION"),
    )
    return seen.select("run_id", "sequence_no", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def recent(runs: DataFrame, updated: str, run: str, limit: int = 30) -> DataFrame:
    return runs.orderBy(F.desc(updated), F.desc(run)).limit(limit)


def _one_of(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def active_stage(state: Column) -> Column:
    return _one_of(state, ACTIVE)


def continuation(state: Column, failed: Column, completed: Column, cancelling: Column, resumable: Column) -> Column:
    """The checkpoint from which a run goes on; null where it can't."""
    return F.when(~failed & ~completed & ~cancelling & resumable & state.isin(*CHECKPOINTS), state)


def retryable(state: Column, resumable: Column, recoverable: Column, failed_stage: Column) -> Column:
    """A failed run with a recoverable failure behind ingestion."""
    return F.coalesce((state == "failed") & resumable & recoverable & failed_stage.isNotNull() & (failed_stage != "ingest"), F.lit(False))


def transitions(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Compare-and-set: for each request (run_id, expected_state, expected_version, next_state) the new version, or why there is none.

    A run takes one request at most; of several the one with the least next_state, the others lose.
    """
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("next_state"))
    met = requests.withColumn("turn", first).join(runs.select("run_id", "state", "state_version"), "run_id", "left")
    met = met.join(_edges(requests, "state", "next_state").withColumn("valid", F.lit(True)), ["state", "next_state"], "left")
    code = (
        F.when(F.col("state").isNull(), "RUN_NOT_FOUND").when(F.col("state") != F.col("expected_state"), "STALE_STATE").when((F.col("state_version") != F.col("expected_version")) | (F.col("turn") > 1), "CONCURRENT_MODIFICATION")
        .when(F.col("valid").isNull(), "INVALID_TRANSITION")
    )
    return met.select("run_id", "next_state", code.alias("code"), F.when(code.isNull(), F.col("state_version") + 1).alias("state_version"))


def compare_and_set(rows: DataFrame, requests: DataFrame, key: str, column: str, steps: list[tuple[str, str]] | None = None) -> DataFrame:
    """For each request (key, expected, next): whether the row's column is as expected and the step, where steps are given, is one of them."""
    met = requests.join(rows.select(key, F.col(column).alias("found")), key, "left")
    changed = F.coalesce(F.col("found") == F.col("expected"), F.lit(False))
    if steps is not None:
        met = met.join(_edges(requests, "expected", "next", steps).withColumn("listed", F.lit(True)), ["expected", "next"], "left")
        changed = changed & F.col("listed").isNotNull()
    return met.select(key, F.when(changed, F.col("next")).otherwise(F.col("found")).alias(column), changed.alias("changed"))


def cancellations(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests (run_id, expected_version) to cancel: a run that has ended, or is being cancelled, can't be."""
    asked = requests.join(runs.select("run_id", "state", "state_version"), "run_id", "left")
    code = F.when(F.col("state").isNull(), "RUN_NOT_FOUND").when(F.col("state").isin(*TERMINAL, "cancelling"), "CANCELLATION_NOT_ALLOWED").when(F.col("state_version") != F.col("expected_version"), "CONCURRENT_MODIFICATION")
    return asked.select("run_id", code.alias("code"), F.when(code.isNull(), "cancelling").alias("next_state"), F.when(code.isNull(), active_stage(F.col("state"))).alias("stage"))


def recoveries(runs: DataFrame, children: DataFrame) -> DataFrame:
    """What becomes of runs that a stop interrupted. Children of scans that were admitted (run_id) go back to their last checkpoint,
    other active runs fail, runs being cancelled are."""
    met = runs.join(children.select("run_id", F.lit(True).alias("owned")).distinct(), "run_id", "left")
    owned, state = F.col("owned").isNotNull(), F.col("state")
    back = _one_of(state, REWINDS)
    action = F.when(state == "cancelling", "cancelled").when(owned & back.isNotNull(), back).when(~owned & state.isin(*ACTIVE), "failed")
    reason = F.when(action == "failed", INTERRUPTED).when(action == "cancelled", "cancellation_completed_after_restart").when(action.isNotNull(), "child_rewound_after_restart")
    return met.select("run_id", "state", action.alias("next_state"), reason.alias("reason"), (F.col("state_version") + 1).alias("state_version")).where("next_state is not null")


def retry_sources(requests: DataFrame, runs: DataFrame, profiles: DataFrame, retries: DataFrame) -> DataFrame:
    """requests (source_run_id, expected_version) with the first reason against a retry, or null.

    runs: run_id, document_id, state, state_version, resumable, recoverable, failed_stage; profiles: run_id, profile; retries: source_run_id.
    """
    met = requests.join(runs.withColumnRenamed("run_id", "source_run_id"), "source_run_id", "left")
    met = met.join(profiles.select(F.col("run_id").alias("source_run_id"), F.lit(True).alias("has_profile")).distinct(), "source_run_id", "left")
    met = met.join(retries.select("source_run_id", F.lit(True).alias("retried")).distinct(), "source_run_id", "left")
    code = (
        F.when(F.col("state").isNull(), "RUN_NOT_FOUND").when(F.col("state") != "failed", "NOT_FAILED").when(F.col("state_version") != F.col("expected_version"), "CONCURRENT_MODIFICATION")
        .when(~retryable(F.col("state"), F.col("resumable"), F.col("recoverable"), F.col("failed_stage")), "NO_CHECKPOINT").when(F.col("has_profile").isNull(), "NO_PROFILE").when(F.col("retried").isNotNull(), "RETRY_EXISTS")
    )
    return met.select("source_run_id", "document_id", code.alias("code"))


def create_retries(sources: DataFrame, profiles: DataFrame, created_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New runs, their lineage and the profiles they inherit, for the sources without a code."""
    taken = sources.where("code is null").withColumn("run_id", T.tagged_hash("retry-", F.encode(F.col("source_run_id").cast("string"), "UTF-8")))
    runs = taken.select("run_id", "document_id", F.lit("parsing").alias("state"), F.lit(4).alias("state_version"), created_at.alias("created_at"))
    lineage = taken.select(F.col("run_id").alias("retry_run_id"), "source_run_id", F.lit("ingested").alias("checkpoint"), created_at.alias("created_at"))
    copied = taken.select("run_id", "source_run_id").join(profiles.withColumnRenamed("run_id", "source_run_id"), "source_run_id").select("run_id", "profile", created_at.alias("created_at"))
    return runs, lineage, copied


def retry_lineage(retries: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges (retry_run_id, source_run_id, created_at) whose ends are runs of one document and which date from their retry."""
    a = runs.select(F.col("run_id").alias("retry_run_id"), F.col("document_id").alias("retry_document"), F.col("created_at").alias("retry_created"))
    b = runs.select(F.col("run_id").alias("source_run_id"), F.col("document_id").alias("source_document"))
    return retries.join(a, "retry_run_id").join(b, "source_run_id").where("retry_document = source_document and created_at = retry_created").select("retry_run_id", "source_run_id")


def history(runs: DataFrame, retries: DataFrame, profiles: DataFrame, handoffs: DataFrame, finished: DataFrame) -> DataFrame:
    """One row for each run as a list of runs shows it: its retries in both directions, and what may be done with it."""
    back = retries.select(F.col("retry_run_id").alias("run_id"), F.col("source_run_id").alias("retry_of"))
    onward = retries.select(F.col("source_run_id").alias("run_id"), F.col("retry_run_id").alias("retried_by"))
    flag = lambda rows, name: rows.select("run_id", F.lit(True).alias(name)).distinct()
    met = runs.join(back, "run_id", "left").join(onward, "run_id", "left").join(flag(profiles, "has_profile"), "run_id", "left").join(flag(handoffs, "handed_off"), "run_id", "left").join(flag(finished, "has_summary"), "run_id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.col("state")
    point = continuation(state, F.col("failed_stage").isNotNull(), state.isin(*TERMINAL), F.col("cancellation_requested"), F.col("resumable"))
    needs = point.isin("analyzed", "synthesized", "verified")
    can_retry = retryable(state, F.col("resumable"), F.col("recoverable"), F.col("failed_stage")) & F.col("retried_by").isNull() & has("has_profile")
    return met.select(
        "run_id", "state", "retry_of", "retried_by", can_retry.alias("can_retry"), point.alias("checkpoint"),
        F.coalesce(point.isNotNull() & (~needs | has("has_profile")) & ~has("handed_off"), F.lit(False)).alias("can_continue"), has("has_summary").alias("has_summary"),
    )


def summary_mismatches(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs that have a summary though they aren't complete, or the other way round."""
    met = runs.join(finished.select("run_id", F.lit(True).alias("has")).distinct(), "run_id", "left")
    return met.where(F.col("has").isNotNull() != F.col("state").isin(*FINISHED)).select("run_id", "state")


def immutable_conflicts(rows: DataFrame, key: str, value: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Keys whose value was written as something else later, or isn't one of the allowed."""
    g = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(F.col(value).isin(*allowed) if allowed else F.lit(True)).alias("known"))
    return g.select(key, F.when(~F.col("known"), "UNKNOWN_VALUE").when(F.col("lo") != F.col("hi"), "CHANGED").alias("code")).where("code is not null")


def handoffs(roots: DataFrame, existing: DataFrame) -> DataFrame:
    """One handoff for each root run, those that have one aside."""
    fresh = roots.dropDuplicates(["run_id"]).join(existing.select("run_id"), "run_id", "left_anti")
    return fresh.select(T.tagged_hash("handoff-", F.encode(F.col("run_id").cast("string"), "UTF-8")).alias("handoff_id"), "run_id", F.lit("prepared").alias("phase"))


def admit_children(prepared: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For handoffs (handoff_id, run_id, document_id, phase = provider_completed) a child run each, and the handoffs with their child."""
    met = prepared.where("phase = 'provider_completed'").join(documents.select("document_id"), "document_id", "left_semi")
    met = met.withColumn("child_run_id", T.tagged_hash("child-", F.encode("handoff_id", "UTF-8")))
    runs = met.select(F.col("child_run_id").alias("run_id"), "document_id", F.lit("ingested").alias("state"), F.lit(3).alias("state_version"))
    return runs, met.select("handoff_id", "run_id", "child_run_id", F.lit("child_admitted").alias("phase"))


def admit_jobs(jobs: DataFrame, known: DataFrame, accepting: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Jobs (job_id, provider, document_id, request_hash) that come in together with their run and first event; and the refused.

    A job is refused where its provider doesn't accept (provider), or its id stands for another request (known: job_id,
    request_hash). A job that is known with the same request is left as it is.
    """
    met = jobs.join(accepting.select("provider", F.lit(True).alias("open")).distinct(), "provider", "left").join(known.select("job_id", F.col("request_hash").alias("stored")), "job_id", "left")
    code = F.when(F.col("stored") != F.col("request_hash"), "REQUEST_CONFLICT").when(F.col("open").isNull(), "PROVIDER_CLOSED")
    fresh = met.where(code.isNull() & F.col("stored").isNull()).withColumn("run_id", T.tagged_hash("run-", F.encode(F.col("job_id").cast("string"), "UTF-8")))
    rows = fresh.select("job_id", "provider", "document_id", "request_hash", "run_id", F.lit("accepted").alias("status"))
    runs = fresh.select("run_id", "document_id", F.lit("received").alias("state"), F.lit(1).alias("state_version"))
    events = fresh.select("run_id", F.lit(0).alias("sequence_no"), F.lit(None).cast("string").alias("previous_state"), F.lit("received").alias("next_state"))
    return rows, runs, events, met.where(code.isNotNull()).select("job_id", code.alias("code"))


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Rows that name a parent which isn't there."""
    lost = rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")).distinct()


def outside(rows: DataFrame, key: str, column: str, domain: tuple[str, ...], rule: str) -> DataFrame:
    """Rows whose value isn't one of a fixed set."""
    return rows.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")).distinct()
