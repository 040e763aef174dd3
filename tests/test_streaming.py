from pyspark.sql import functions as F

from tessera.streaming import meters as M

FOLDER = "/root/testdata/sf0.001"


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_last_n_meter(spark):
    got = {r.user_id: (r.n, round(r.mean, 6)) for r in run(M.last_n(M.event_stream(spark, FOLDER)), "meter", "update").collect()}
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    for r in events.groupBy("user_id").count().collect()[:10]:
        own = [x.value for x in events.where(F.col("user_id") == r.user_id).orderBy("ts", "event_id").collect()]
        assert got[r.user_id] == (r["count"], round(sum(own[-30:]) / len(own[-30:]), 6))


def test_distinct_and_windows(spark):
    events = M.event_stream(spark, FOLDER)
    users = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id").distinct().count()
    assert run(M.distinct_within(events, ["event_id"], "100 days"), "distinct_ids", "append").count() == users
    assert run(M.windowed(M.event_stream(spark, FOLDER), "event_type", "1 day"), "daily", "append").count() > 0
