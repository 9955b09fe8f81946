from datetime import datetime

from attesta.streaming.ingest import regressions


def test_regressions_over_micro_batches(spark, tmp_path):
    schema = "set_name string, target string, status string, loaded_at timestamp"
    source = tmp_path / "in"
    for n, rows in enumerate([[("s", "a", "valid_trusted", datetime(2025, 1, 1)), ("s", "b", "absent", datetime(2025, 1, 1))], [("s", "./a", "valid_untrusted", datetime(2025, 1, 2)), ("s", "b", "valid_trusted", datetime(2025, 1, 2))], [("s", "a", "absent", datetime(2024, 1, 1)), ("s", "b", None, datetime(2025, 1, 3))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = regressions(stream).writeStream.format("memory").queryName("lost").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.target, r.was, r.now) for r in spark.table("lost").collect()}
    assert ("b", "valid_trusted", "error") in got and ("a", "valid_trusted", "valid_untrusted") in got and len(got) == 2
