import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 80


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert sum(r["count"] for r in rows) > 1000 and any(r.tag == "PUNCT" for r in rows)


def test_scans_read_only_what_they_need(spark):
    plan = contract.queries()["build_units"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_wise_operators_take_a_stream(spark, tmp_path):
    from tagweave.operators.tags import split_tagged
    spark.createDataFrame([("a|N",), ("b",)], "item string").write.parquet(str(tmp_path / "in"))
    stream = split_tagged(spark.readStream.schema("item string").parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("tagged_stream").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("tagged_stream").collect()] == [("a", "N")]
