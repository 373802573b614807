"""Structured Streaming: watched folders, duplicate suppression, sessions by inactivity, incremental index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.functions import text
from folioscope.operators.edit import upsert
from folioscope.operators.inverted import Index

IMAGE, DOCUMENT = ("jpg", "jpeg", "png", "tif", "tiff", "heic"), ("pdf", "djvu", "txt", "docx", "odt", "epub")


def watched(spark: SparkSession, path: str, schema: str | None = None, kind: str = "binaryFile", most: int = 300) -> DataFrame:
    """New files of a folder, at most ``most`` a batch. A writer renames finished files into place, so a file seen is whole."""
    reader = spark.readStream.format(kind).option("maxFilesPerTrigger", most)
    return (reader.schema(schema) if schema else reader).load(path)


def category(path: str = "path") -> F.Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*IMAGE), "image").when(ext.isin(*DOCUMENT), "document").otherwise("other")


def first_seen(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the delay; state is dropped behind the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, by: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Groups that end after a pause: ``by, start, end, n``. Rows later than the watermark are dropped by Spark."""
    g = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def late_rows(batch: DataFrame, ts: str, watermark: str) -> DataFrame:
    """The side output for late data: rows of a batch older than the watermark given."""
    return batch.where(F.col(ts) < F.lit(watermark).cast("timestamp"))


def index_rows(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return records.select(key, F.array_distinct(F.flatten(F.array(*[text.tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]))).alias("tokens"))


def maintain_index(stream: DataFrame, key: str, columns: list[str], path: str, checkpoint: str, updated: str | None = None) -> StreamingQuery:
    """Every batch of changed records replaces their index rows; of several rows of a key that with the latest ``updated`` counts. Versions alternate between two folders, so a batch that
    is run again after a failure starts from the version before it."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        newest = batch.dropDuplicates([key]) if updated is None else batch.groupBy(key).agg(F.max_by(F.struct(*columns), updated).alias("x")).select(key, "x.*")
        fresh = index_rows(newest, key, columns)
        if epoch:
            fresh = upsert(spark.read.parquet(f"{path}/v{(epoch - 1) % 2}"), fresh, key)
        fresh.write.mode("overwrite").parquet(f"{path}/v{epoch % 2}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def maintain_postings(stream: DataFrame, index: Index, checkpoint: str, updated: str | None = None, deleted: str | None = None) -> StreamingQuery:
    """Every batch of changed records becomes a segment of the inverted index; a batch that is run again after a failure is passed over."""

    def apply(batch: DataFrame, epoch: int) -> None:
        index.add(batch, epoch + 1, updated, deleted)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def drained(stream: DataFrame, out: str, mode: str, checkpoint: str) -> None:
    """Runs a stream over what is there now and leaves its result as Parquet in ``out``. 'complete' keeps the last state, 'append' all rows."""

    def whole(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    q = w.foreachBatch(whole).start() if mode == "complete" else w.format("parquet").option("path", out).start()
    q.awaitTermination()


def settled(seen: DataFrame, quiet: int, delay: str, forget: int = 86_400) -> DataFrame:
    """``path, size, since`` of files whose size has not changed for ``quiet`` seconds, each once, from a stream ``seen(path, size, ts)`` of listings.

    A file that grows, or is written anew, starts again when its size changes. It is handed on by the first listing that finds it
    unchanged for so long, or by a timer when the watermark (``delay`` behind the latest listing) passes that time and no
    listing came. What was handed on is remembered for ``forget`` seconds after the last listing, so that the state stays bounded.
    Listings of a batch are taken in order of time; those with a null path, size or time do not count.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, ms = [], 1000
        size, since, done = state.get if state.exists else (None, 0, False)
        if state.hasTimedOut:
            if not done and size is not None:
                out.append((key[0], size, since))
                done = True
                state.update((size, since, done))
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, since + forget * ms))
            else:
                state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "size"])
            at = 0
            for s, t in zip(rows["size"].tolist(), (rows["ts"].astype("int64") // 1_000_000 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("datetime64[ms]").astype("int64")).tolist(), strict=True):
                if size is not None and not done and t - since >= quiet * ms:
                    out.append((key[0], size, since))
                    done = True
                if s != size:
                    size, since, done = s, t, False
                at = max(at, t)
            state.update((size, since, done))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, at + forget * ms if done else since + quiet * ms))
        yield pd.DataFrame({"path": [r[0] for r in out], "size": [r[1] for r in out], "since": pd.to_datetime([r[2] for r in out], unit="ms")})

    known = seen.where("path is not null and size is not null and ts is not null").select("path", F.col("size").cast("long").alias("size"), "ts").withWatermark("ts", delay)
    return known.groupBy("path").applyInPandasWithState(watch, "path string, size long, since timestamp", "size long, since long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
