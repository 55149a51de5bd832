from tickloom.metrics import Metrics, Progress


def test_metrics(spark):
    own = Metrics()
    own.count("a")
    own.count("a", 2)
    own.gauge("g", 5)
    assert own.observe(spark.range(7), "seen").where("id > 3").count() == 3
    assert own.collect() == {"a": 3, "g": 5, "seen.rows": 7}


def test_progress(spark, tmp_path):
    own = Metrics()
    listener = Progress(own)
    spark.streams.addListener(listener)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    stream.writeStream.queryName("counted").format("memory").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(listener)
    assert own.collect().get("streams.started", 0) >= 1
