"""Sampled splitters: near-equal shards of weighted records, without sorting whole records in one place.

1. Keys are drawn with a chance in proportion to their record's size, so the quantiles of the drawn
   keys are quantiles of the bytes. The draw is a hash of the key: a task that runs twice draws the
   same keys.
2. Quantile boundaries of the sample cut the key space into ranges, several to a shard.
3. Every record goes to its range; the exact rows and bytes of each range give the bytes that lie
   before it, and a running total inside the range gives the bytes before each record.
4. A range that holds more than its part is subdivided at the record where a shard is full, so the
   shards differ by about one record, however rough the sample was.

Boundaries and range totals are bounded by the number of ranges. Equal texts lie next to each other
in the order of keys and stay together unless a shard boundary falls among them; a text that fills
more than a shard is split by the rest of the key.

Defined cases: null keys and texts take part as their own value; an empty table gives an empty
table; where all sizes are 0 everything goes to
shard 0; fully equal rows get different slots; columns named shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbrera.llm.shared import unused, written

DRAWS_PER_RANGE = 40
RANGES_PER_SHARD = 4
_SPACE = 1 << 31


def record_key(group: Column, identity: Column) -> Column:
    """A text that orders records by group (equal groups side by side), then by identity."""
    part = lambda c: F.lpad(F.hex(F.xxhash64(c)), 16, "0")
    return F.concat(part(group), part(identity))


def splitters(keyed: DataFrame, key: str, size: str, ranges: int) -> list[str]:
    """At most ``ranges`` - 1 boundaries, quantiles of a size-weighted sample of bounded expected size."""
    total = keyed.agg(F.sum(size).alias("total")).first()["total"] or 0
    if total <= 0:
        return []
    rate = ranges * DRAWS_PER_RANGE / total
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("draw")), F.lit(_SPACE)) / F.lit(float(_SPACE))
    drawn = keyed.where(draw < F.col(size) * F.lit(rate)).select(key)
    ordered = drawn.agg(F.sort_array(F.collect_list(key)).alias("keys"))
    n = F.size("keys")
    picks = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))), lambda i: F.get(F.col("keys"), (i * n / ranges).cast("int")))
    found = ordered.select(F.array_distinct(F.filter(picks, lambda k: k.isNotNull())).alias("cuts")).first()
    return sorted(found["cuts"])


def range_of(key: Column, cuts: list[str]) -> Column:
    """Number of boundaries at or below ``key``: a halving search over the literal boundaries."""
    if not cuts:
        return F.lit(0)
    array, steps = F.array(*[F.lit(c) for c in cuts]), len(cuts).bit_length() + 1
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        up = (at["lo"] < at["hi"]) & (F.get(array, mid) <= key)
        return F.struct(
            F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"),
            F.when(up | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda at: at["lo"])


def shard(records: DataFrame, group: Column, identity: Column, size: Column, n_shards: int = 40) -> DataFrame:
    """``records`` with ``shard`` (0 to n_shards - 1, bytes near equal) and ``slot`` (gapless from 0).

    The columns of ``records`` stay; a shard is the run of records, in key order, whose middle byte
    falls into its part of all bytes.
    """
    spark = records.sparkSession
    kept = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    key, weight, span, before, bytes_in, rows_in, row, at, bytes_before, rows_before, all_bytes, number, place, first, of = unused(
        records, "_key", "_weight", "_range", "_before", "_bytes", "_rows", "_row", "_at", "_bytes_before", "_rows_before", "_all_bytes",
        "_number", "_place", "_first", "_of")
    keyed = records.withColumns({key: record_key(group, identity), weight: size.cast("long")})
    ranges = max(n_shards * RANGES_PER_SHARD, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = keyed.withColumn(span, range_of(F.col(key), splitters(keyed, key, weight, ranges)))

    totals = ranged.groupBy(span).agg(F.sum(weight).alias(bytes_in), F.count(F.lit(1)).alias(rows_in))
    # One row a range: bounded by the number of ranges, so one window over it is small.
    earlier = Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = written(totals.select(
        F.col(span).alias(at), F.coalesce(F.sum(bytes_in).over(earlier), F.lit(0)).alias(bytes_before),
        F.coalesce(F.sum(rows_in).over(earlier), F.lit(0)).alias(rows_before), F.sum(bytes_in).over(everything).alias(all_bytes)), "ranges")

    inside = Window.partitionBy(span).orderBy(key, *_orderable(records))
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({row: F.row_number().over(inside), before: F.coalesce(F.sum(weight).over(upto), F.lit(0))})
    placed = placed.join(F.broadcast(offsets), F.col(span) == F.col(at))  # at most one row a range
    middle = (F.col(bytes_before) + F.col(before)).cast("double") + F.col(weight) / 2
    part = F.least(F.floor(middle * n_shards / F.greatest(F.col(all_bytes), F.lit(1))), F.lit(n_shards - 1)).cast("int")
    placed = written(placed.select(*kept, part.alias(number), (F.col(rows_before) + F.col(row) - 1).alias(place)), "placed")
    # Shards are runs of places, so a slot is a place less the first place of its shard.
    starts = placed.groupBy(F.col(number).alias(of)).agg(F.min(place).alias(first))
    return placed.join(F.broadcast(starts), F.col(number) == F.col(of)).select(  # one row a shard
        *kept, F.col(number).alias("shard"), (F.col(place) - F.col(first)).alias("slot"))


def _orderable(df: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in df.schema.fields if not f.dataType.typeName() in ("map", "variant")]
