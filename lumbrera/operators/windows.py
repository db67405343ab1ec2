"""Reporting windows: equal buckets that start on the viewer's local hour or day."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# Length and bucket unit of each range.
RANGES = {"24h": (24, "hour"), "7d": (7, "day"), "30d": (30, "day")}
_STEP = {"hour": timedelta(hours=1), "day": timedelta(days=1)}


@dataclass(frozen=True)
class ReportWindow:
    """``count`` buckets of ``step``, half open, the last one holding ``now``.

    ``tz_offset`` is in minutes and counts west of UTC as positive, so local = utc - offset.
    """

    range_key: str
    now: datetime
    tz_offset: int = 0

    @property
    def unit(self) -> str:
        return RANGES[self.range_key][1]

    @property
    def count(self) -> int:
        return RANGES[self.range_key][0]

    @property
    def step(self) -> timedelta:
        return _STEP[self.unit]

    @property
    def start(self) -> datetime:
        shift = timedelta(minutes=self.tz_offset)
        local = self.now - shift
        floor = local.replace(minute=0, second=0, microsecond=0)
        if self.unit == "day":
            floor = floor.replace(hour=0)
        return floor - self.step * (self.count - 1) + shift

    @property
    def end(self) -> datetime:
        return self.start + self.step * self.count

    @property
    def previous_start(self) -> datetime:
        return self.start - (self.end - self.start)


def moment(df: DataFrame, column: str, at: datetime) -> Column:
    """Literal of the column's own timestamp type, so a comparison reaches the Parquet scan uncast."""
    kind = "TIMESTAMP_NTZ" if isinstance(df.schema[column].dataType, TimestampNTZType) else "TIMESTAMP"
    return F.expr(f"{kind} '{at.isoformat(sep=' ')}'")


def between(df: DataFrame, lo: datetime, hi: datetime, column: str = "created_at") -> DataFrame:
    return df.filter((F.col(column) >= moment(df, column, lo)) & (F.col(column) < moment(df, column, hi)))


def epoch(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def assign_bucket(events: DataFrame, w: ReportWindow, column: str = "created_at") -> DataFrame:
    """Events of the window with their bucket index: arithmetic, not a range join."""
    step = int(w.step.total_seconds() * 1_000_000)
    origin = epoch(F.expr(f"TIMESTAMP '{w.start.isoformat(sep=' ')}'"))
    return between(events, w.start, w.end, column).withColumn(
        "bucket", F.floor((epoch(F.col(column)) - origin) / F.lit(step)).cast("int")
    )


def label_period(events: DataFrame, w: ReportWindow, column: str = "created_at") -> DataFrame:
    """One scan over the window and the equal one before it, each row labelled with its period."""
    both = between(events, w.previous_start, w.end, column)
    return both.withColumn(
        "period", F.when(F.col(column) >= moment(events, column, w.start), "current").otherwise("previous")
    )


def spine(spark: SparkSession, w: ReportWindow) -> DataFrame:
    """bucket, bucket_start: one row per bucket, what makes empty buckets show as zero."""
    seconds = int(w.step.total_seconds())
    return spark.range(w.count).select(
        F.col("id").cast("int").alias("bucket"),
        F.timestamp_seconds(F.unix_seconds(F.expr(f"TIMESTAMP '{w.start.isoformat(sep=' ')}'")) + F.col("id") * seconds).alias("bucket_start"),
    )


def bucket_spine(ends: DataFrame, range_key: str, tz_offset: int = 0) -> DataFrame:
    """Spine whose end is data: one row of ``ends`` (column ``end``) gives all bucket starts."""
    count, unit = RANGES[range_key]
    shift = F.make_dt_interval(mins=F.lit(tz_offset))
    last = F.date_trunc(unit, F.col("end").cast("timestamp") - shift) + shift
    step = F.expr(f"INTERVAL '1' {unit.upper()}")
    return ends.select(F.posexplode(F.sequence(last - step * (count - 1), last, step)).alias("bucket", "bucket_start"))


def values(spark: SparkSession, column: str, items) -> DataFrame:
    """Literal enumeration as rows, for zero filling."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in items])).alias(column))


def fill(frame: DataFrame, facts: DataFrame, on: list[str], zero: list[str]) -> DataFrame:
    """Every row of the small ``frame`` with its facts, missing counts as zero."""
    return frame.join(facts, on, "left").na.fill(0, zero)


def crosstab(frame: DataFrame, row: str, column: str, items, weight: Column | None = None) -> DataFrame:
    """Counts of known ``column`` values per ``row``, one partial aggregate."""
    one = F.lit(1) if weight is None else weight
    return frame.groupBy(row).agg(*[
        F.coalesce(F.sum(F.when(F.col(column) == i, one)), F.lit(0)).cast("long").alias(i) for i in items
    ])
