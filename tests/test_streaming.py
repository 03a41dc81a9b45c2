import pytest

from trialmill.streaming.running import running_summary


def test_running_summary_equals_the_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    targets = ["value@Mean", "value@Count", "value@Max"]
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = running_summary(stream, ["event_type"], targets).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_type"]: r for r in spark.table("running").collect()}
    for r in running_summary(batch, ["event_type"], targets).collect():
        assert abs(got[r["event_type"]]["value@Mean"] - r["value@Mean"]) < 1e-9 and got[r["event_type"]]["value@Count"] == r["value@Count"]
    with pytest.raises(ValueError):
        running_summary(batch, [], ["value@Median"])
