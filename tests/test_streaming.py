from lodestone.functions import P
from lodestone.plans.spec import Agg, Grouping, Query
from lodestone.streaming import stream, tumbling


def test_buckets_equal_the_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    spark.read.parquet(src).repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    g = Grouping().group_by("event_type").aggregate(Agg.count("n"))
    q = tumbling(live, "ts", 86400, "400 days", g).writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    q.processAllAvailable()
    q.stop()
    want = spark.sql(f"SELECT unix_seconds(cast(date_trunc('day', ts) as timestamp)) AS bucket, event_type, count(*) AS n FROM parquet.`{src}` GROUP BY 1, 2")
    assert sorted(map(tuple, spark.table("buckets").collect())) == sorted(map(tuple, want.collect()))
    few = stream(live.drop("ts"), Query("events").where(P.cmp("event_type", "=", "click")).select("event_id"))
    assert few.isStreaming and few.columns == ["event_id"]
