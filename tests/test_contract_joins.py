"""Contracts join tables of texts without sending one to the driver, whatever size Spark takes them for."""

import pytest

from quillstone.plans import catalog


@pytest.mark.parametrize("name", ["contract_renderings", "contract_key_terms", "contract_mismatches", "contract_records"])
def test_no_table_goes_to_the_driver(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        rows, plan = df.collect(), df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows and "isFinalPlan=true" in plan and "Broadcast" not in plan
