"""Late events: counted and kept aside.

A row is late if its event time is not after the watermark: the greatest event time of all batches
before its own, less the allowed lateness, in whole milliseconds. That is the rule of Structured
Streaming for a stateful operator over single rows, whose progress counts the rows it drops; here the
rows are kept, and every batch says how many it had.

``route`` writes a batch once, on-time and late rows apart, in a folder of the batch's own, then a mark
with its counts and the greatest event time so far. A batch that is run again replaces what it wrote
and reads the same mark of the batch before, so its rows fall the same way. Readers take batches with a mark alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

MARK = "rows long, late long, watermark_us long, greatest_ms long"


def _mark(spark: SparkSession, path: str, batch_id: int):
    try:
        return spark.read.schema(MARK).parquet(f"{path}/marks/batch={batch_id}").first()
    except AnalysisException:  # the batch has no mark
        return None


def writer(path: str, time: str, lateness_ms: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows to ``path``/rows/batch=N/late=true or false, then the mark of the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _mark(spark, path, batch_id - 1)
        known = before["greatest_ms"] if before else None
        watermark = None if known is None else (known - lateness_ms) * 1000
        at = F.unix_micros(F.col(time).cast("timestamp"))
        late = F.lit(False) if watermark is None else F.coalesce(at <= F.lit(watermark), F.lit(False))
        seen = Observation()
        tagged = batch.withColumn("late", late).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("late"), 1)).alias("late"), F.max(F.floor(at / 1000)).alias("greatest"))
        tagged.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        found = seen.get
        greatest = max((x for x in (known, found.get("greatest")) if x is not None), default=None)
        mark = spark.createDataFrame([(found.get("rows", 0), found.get("late", 0), watermark, greatest)], MARK)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return write


def route(events: DataFrame, path: str, time: str = "created_at", lateness_ms: int = 600_000) -> StreamingQuery:
    """Started query that routes what is there now; its state lies under ``path``."""
    return events.writeStream.foreachBatch(writer(path, time, lateness_ms)).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()


def marks(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, accepted, dropped, watermark_us) of every batch."""
    return spark.read.schema(f"{MARK}, batch long").option("basePath", f"{path}/marks").parquet(f"{path}/marks").select(
        "batch", "rows", (F.col("rows") - F.col("late")).alias("accepted"), F.col("late").alias("dropped"), "watermark_us")


def rows(spark: SparkSession, path: str, late: bool) -> DataFrame:
    """The late rows, or the others, of all batches with a mark."""
    return spark.read.parquet(f"{path}/rows").where(F.col("late") == late).join(marks(spark, path).select("batch"), "batch", "left_semi").drop("late")


def stream_distinct(events: DataFrame, key: list[str], time: str = "created_at", lateness: str = "10 minutes") -> DataFrame:
    """Rows by ``key`` and time, each once, late ones left out by the engine's own watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicates([*key, time])


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped in the batches of a finished query, by its progress.

    An aggregation drops partial sums, not rows; the number is one of rows for operators such as :func:`stream_distinct`.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
