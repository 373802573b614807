import datetime

from folioscope.streaming import ingest

SCHEMA = "path string, size long, ts timestamp"
at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_growing_files_are_handed_on_when_they_rest(spark, tmp_path):
    """Listings in three batches: files that grow, rest, vanish from the listings, and are written anew."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    batches = [
        [("grows", 1, at(0)), ("grows", 2, at(10)), ("rests", 5, at(0)), ("rests", 5, at(10)), ("rests", 5, at(40)), ("rests", 5, at(50)), ("gone", 7, at(5)), (None, 1, at(1)), ("x", None, at(1)), ("y", 1, None)],
        [("grows", 3, at(60)), ("rests", 5, at(70)), ("again", 1, at(60))],
        [("grows", 3, at(95)), ("again", 1, at(100)), ("again", 9, at(101)), ("rests", 6, at(102)), ("late", 4, at(400))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.settled(ingest.watched(spark, f"{tmp_path}/in", SCHEMA, "parquet"), 30, "20 seconds")
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(r.path, r.size, r.since) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # by a listing: rests, grows (2 until 60, then 3), again; by the timer: gone, and what rested at the end, but not what came last
    assert got == {("rests", 5, at(0)), ("grows", 2, at(10)), ("grows", 3, at(60)), ("again", 1, at(60)), ("gone", 7, at(5)), ("again", 9, at(101)), ("rests", 6, at(102))}
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)
