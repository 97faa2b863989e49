"""Structured Streaming: a change feed into a store, and a limiter over events. Extensions, not parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailweave.cluster import deleted
from trailweave.sources.store import CHANGES, GraphStore


def change_stream(spark, path: str) -> DataFrame:
    """The change files that appear in a folder."""
    return spark.readStream.schema(CHANGES).parquet(path)


def apply_changes(changes: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Commits each micro-batch as one version; the last change of an id within it counts."""

    def commit(batch: DataFrame, _: int) -> None:
        store.refresh()
        last = batch.groupBy("id").agg(F.max_by(F.struct("op", "content", "vector", "meta", "edges"), "seq").alias("c")).select("id", "c.*")
        put, gone = last.where("op = 'put'"), last.where("op = 'delete'")
        with store.transaction() as t:
            t.delete(gone.select("id"))
            t.put(put, put.select(F.col("id").alias("src"), F.inline("edges")))

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requests_per_minute(events: DataFrame, client: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``client, window_start, n``: calls in each tumbling minute, late ones up to ``late``."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w"), client).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(client, F.col("w.start").alias("window_start"), "n")


def run_to_end(counts: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """The whole result of ``counts`` once its stream has taken all there is, written to ``folder`` and read again.

    Both folders must be shared; neither rows nor state go through the driver, as state lies in
    RocksDB beside each task. Each micro-batch writes the whole result; the last one stays.
    """
    spark, last = counts.sparkSession, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        if last and last[-1] != number:
            deleted(spark, f"{folder}/{last[-1]}")
        last.append(number)

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        counts.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
        deleted(spark, checkpoint)
    return spark.read.schema(counts.schema).parquet(f"{folder}/{last[-1]}") if last else spark.createDataFrame([], counts.schema)
