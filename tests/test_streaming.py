"""Latest states from a stream of files, against the batch answer."""

from pyspark.sql import functions as F

from quillstone.operators import lineage
from quillstone.sources.store import Store
from quillstone.streaming import runs


def test_latest_states(spark, tmp_path):
    source, schema = str(tmp_path / "events"), "run_id long, sequence_no long, state string"
    store = Store(spark, str(tmp_path / "store"))
    rows = [(r, s, f"s{s}") for r in range(5) for s in range(r + 3)]
    batches = [rows[:7], rows[7:] + rows[:2], [(0, 1, "s1"), (9, 0, "s0")]]  # late and repeated events
    for part in batches:
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        runs.keep_latest(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "checkpoint")).awaitTermination(60)
    everything = spark.read.parquet(source)
    want = lineage.latest(everything.distinct(), "run_id", ["sequence_no"], "state").select("run_id", "state")
    got = runs.latest(store).select("run_id", "state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 6
    assert store.version() == 3 and store.read("run_states").agg(F.countDistinct("batch")).head()[0] == 3
