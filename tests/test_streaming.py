from pyspark.sql import functions as F

from readloom.streaming import windows as W


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 1, 2, 14, 16, 31, 33, 34, 59])]
    df = spark.createDataFrame(rows, "id long, user long, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, W.windowed_counts(df, "ts", ["user"], "15 minutes").collect()))
    stream = W.windowed_counts(W.stream_of(spark, str(tmp_path / "in"), df.schema, 3), "ts", ["user"], "15 minutes", "2 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == want
    s = W.sessions(df.withColumn("user", F.lit(1)), "ts", ["user"], "10 minutes").orderBy("start").collect()
    assert [x.n for x in s] == [3, 2, 3, 1]
