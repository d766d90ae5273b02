import time

from plumbline.streaming import incremental


def test_store_merges_and_resumes(spark, tmp_path):
    schema = "row_key string, seq long, done boolean"
    source, store, point = (str(tmp_path / x) for x in ("in", "store", "point"))
    spark.createDataFrame([("a", 1, False), ("b", 1, True)], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    incremental.upsert_stream(stream(), store, point).awaitTermination()
    spark.createDataFrame([("a", 2, True), ("b", 2, False)], schema).write.mode("append").parquet(source)
    incremental.upsert_stream(stream(), store, point).awaitTermination()
    got = {r.row_key: (r.seq, r.done) for r in incremental.read_store(spark, store, schema).collect()}
    assert got == {"a": (2, True), "b": (1, True)}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    schema, store = "row_key string, seq long, done boolean", str(tmp_path / "store")
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(map(tuple, incremental.read_store(spark, store, schema).collect()))
    for number, rows in enumerate([[("a", 1, False), ("b", 1, True)], [("a", 2, True)], [("c", 3, False)], [("c", 4, False)]]):
        for _ in range(2):
            incremental.merge_batch(batch(*rows), store, schema, number)
    assert read() == [("a", 2, True), ("b", 1, True), ("c", 4, False)]
    incremental.merge_batch(batch(), store, schema, 9)
    assert read() == [("a", 2, True), ("b", 1, True), ("c", 4, False)]


def test_budget_and_rows_since(spark):
    costs = spark.createDataFrame([(i, 1.0) for i in range(40)] + [(50, 7.0)], "seq long, cost double").repartition(3)
    assert sorted(r.seq for r in incremental.within_budget(costs, 5.5).collect()) == [0, 1, 2, 3, 4, 5]
    assert [r.seq for r in incremental.rows_since(costs, 37, 2).collect()] == [50, 39]


def test_parts_meet(spark, tmp_path):
    schema = "row_key string, kind string, payload string, failed boolean"
    source = str(tmp_path / "parts")
    rows = [("a", "form", "f", False), ("a", "photo", "p", False), ("b", "form", "f", False), ("c", "form", "g", False), ("c", "photo", "", True), ("d", "form", "g", False), ("d", "photo", "", True), ("d", "photo", "", True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    met = incremental.joined_parts(spark.readStream.schema(schema).parquet(source))
    q = met.writeStream.format("memory").queryName("met").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        # Timeouts make batches without data for ever, so the sink is asked and not the query.
        until = time.time() + 100
        while time.time() < until and spark.table("met").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    # c waits for its photo's second try: a form that came does not count for it.
    assert sorted((r.row_key, r.form, r.photo, r.tries, r.complete) for r in spark.table("met").collect()) == [("a", "f", "p", 2, True), ("d", "g", "error", 3, True)]
