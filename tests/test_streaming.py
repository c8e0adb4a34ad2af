from pyspark.sql import functions as F

from echoframe.streaming import first_seen, repeats


def test_streams(spark, tmp_path):
    rows = [(1, "f", "x = 1; // a", "a", "2024-01-01 00:00:00"), (2, "g", "x = 1;", "b", "2024-01-01 00:01:00"), (3, "h", "y", "c", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "idx long, name string, body string, filename string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for name, build in (("first", first_seen), ("repeats", repeats)):
        stream = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts")
        mode = "append" if name == "first" else "complete"
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("first").count() == 2
    assert sorted(r.n_units for r in spark.table("repeats").collect()) == [1, 2]
