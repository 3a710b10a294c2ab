import uuid

from pyspark.sql import functions as F

from marram.streaming import contacts


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i % 10}:00", i % 4, "x" if i % 3 else "y") for i in range(10)]
    df = spark.createDataFrame(rows, "ts string, user_id long, event_type string").select(F.to_timestamp("ts").alias("ts"), "user_id", "event_type")
    path = f"file://{tmp_path}/events"
    df.coalesce(1).write.parquet(path)
    for make, mode in ((contacts.contacts, "append"), (contacts.contact_counts, "complete")):
        name = "m" + uuid.uuid4().hex
        stream = make(spark.readStream.schema(df.schema).parquet(path))
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(df).collect()))
