"""The latest state of each run, kept up to date from a stream of events. An addition of ours: the inventory has no streams.

Events are appended to a folder that a file stream reads; every micro-batch is one commit of the store, named by its batch,
so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.sources.store import Store


def keep_latest(events: DataFrame, store: Store, checkpoint: str, run: str = "run_id", order: str = "sequence_no", table: str = "run_states") -> StreamingQuery:
    """Starts the stream until it has read what is there. events: run, order and whatever columns a state has.

    A batch adds one row for each of its runs, the last by order; latest() reads the last of all batches. Late events of a
    run, and events that stand twice, lose against the greater order. Nothing is kept in the stream's own state.
    """

    def commit(batch: DataFrame, number: int) -> None:
        done = store.read(table)
        if done is not None and not done.where(F.col("batch") == number).isEmpty():
            return
        columns = [c for c in batch.columns if c not in (run, order)]
        last = batch.groupBy(run).agg(F.max(F.struct(order, *columns)).alias("x")).select(run, "x.*").withColumn("batch", F.lit(number).cast("long"))
        store.commit({table: last})

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(store: Store, run: str = "run_id", order: str = "sequence_no", table: str = "run_states") -> DataFrame | None:
    """The last row of each run over all batches; null where nothing was committed."""
    rows = store.read(table)
    if rows is None:
        return None
    columns = [c for c in rows.columns if c not in (run, order, "batch")]
    return rows.groupBy(run).agg(F.max(F.struct(order, *columns)).alias("x")).select(run, "x.*")
