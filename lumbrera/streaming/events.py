"""The event questions as continuous queries: usage per hour, trailing counts, limiter, gate, decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lumbrera.operators import privacy
from lumbrera.operators.lifecycle import DAY_US, Limiter, retry_seconds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = 1000, glob: str | None = None) -> DataFrame:
    """Event source over a folder that grows, with its declared schema. ``streaming/intake.py`` keeps account of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_usage(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Calls, tokens and errors per closed window and outcome (append mode)."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
    return timed.groupBy(F.window("created_at", width).alias("w"), "outcome").agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens")
    ).select(F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), "outcome", "calls", "tokens")


def stream_trailing(events: DataFrame, key: str, width: str = "60 seconds", slide: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Hits per key in sliding windows: trailing counts as of every slide."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
    return timed.groupBy(F.window("created_at", width, slide).alias("w"), key).agg(F.count("*").alias("hits")).select(
        F.col("w.end").alias("as_of"), key, "hits")


class _LimiterProcessor(StatefulProcessor):
    """Accepted times of one key, kept no longer than a day after the last call."""

    def __init__(self, per_minute: int, per_day: int, key: str):
        self.per_minute, self.per_day, self.key = per_minute, per_day, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limiter = Limiter(self.per_minute, self.per_day)
        if self.hits.exists():
            limiter.reset(int(at) for (at,) in self.hits.get())
        calls = pd.concat(list(rows)).sort_values(["at", "event_id"])
        accepted, retry = [], []
        for at in calls["at"]:
            n, wait = limiter.offer(int(at), 1)
            accepted.append(n == 1)
            retry.append(None if wait is None else retry_seconds(wait))
        if limiter.accepted:
            self.hits.put([(at,) for at in limiter.accepted])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(calls["at"].iloc[-1]) + DAY_US) // 1000)
        yield pd.DataFrame({
            self.key: key[0], "event_id": calls["event_id"].to_numpy(), "accepted": accepted, "retry_after": pd.array(retry, dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_limiter(events: DataFrame, key: str, per_minute: int, per_day: int, lateness: str = "1 minute") -> DataFrame:
    """Accept or refuse every call as it comes; state per key is at most a day's accepted times.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kind = events.schema[key].dataType.simpleString()
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
    calls = timed.select(key, "event_id", "created_at", F.unix_micros("created_at").alias("at"))
    return calls.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_LimiterProcessor(per_minute, per_day, key),
        outputStructType=f"{key} {kind}, event_id long, accepted boolean, retry_after long", outputMode="Append", timeMode="EventTime")


def gate_batch(clear_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """Writer for foreachBatch: documents without personal data to one place, the rest to another.

    Each batch owns its folder, so a batch that is run again replaces what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        routed = privacy.route(privacy.with_findings(batch)).drop("findings").persist()  # one detection for both
        try:
            routed.where("NOT blocked").drop("blocked").write.mode("overwrite").parquet(f"{clear_path}/batch={batch_id}")
            routed.where("blocked").drop("blocked").write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            routed.unpersist()

    return write


def stream_gate(materials: DataFrame, clear_path: str, quarantine_path: str, checkpoint: str):
    """Started query that routes documents as they arrive."""
    return materials.writeStream.foreachBatch(gate_batch(clear_path, quarantine_path)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_decisions(log: DataFrame) -> DataFrame:
    """Current state per proposal (update mode)."""
    return log.groupBy("doc_id", "proposal_id", "barrier_id").agg(
        F.max_by("to_status", "seq").alias("status"), F.max("seq").alias("seq"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give back what it wrote. For update mode the last batch per key wins."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/out").start()
    else:
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
