"""Ordered operations that do not put a whole key into one task.

A window partitioned by a key sends every row of the key to one task, which does not hold up when
one key owns a third of the table. Here rows are first cut into chunks: columns that follow the
order inside a key, such as the day of a timestamp or a block of positions. The window runs inside
(key, chunk); what has to cross chunk borders is one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour(df: DataFrame, keys: list[str], chunk: list[Column], order: list[str], value: Column, out: str,
              following: bool = False) -> DataFrame:
    """``out`` = ``value`` on the previous (or following) row of the key in ``order``; NULL at the end.

    ``chunk`` must be monotone in ``order``; ``order`` should be unique inside a key.
    """
    chunk_names = [f"_chunk{i}" for i in range(len(chunk))]
    tagged = df.withColumns({n: c for n, c in zip(chunk_names, chunk)}).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, *chunk_names).orderBy(*order)
    position = F.struct(*order)
    if following:
        moved, edge, across = F.lead("_value").over(inside), F.min_by("_value", position), Window.partitionBy(*keys).orderBy(*[F.desc(n) for n in chunk_names])
    else:
        moved, edge, across = F.lag("_value").over(inside), F.max_by("_value", position), Window.partitionBy(*keys).orderBy(*chunk_names)
    edges = tagged.groupBy(*keys, *chunk_names).agg(edge.alias("_edge"))
    borders = edges.withColumn("_border", F.lag("_edge").over(across)).drop("_edge")
    return (
        tagged.withColumn("_moved", moved)
        .join(borders, [*keys, *chunk_names])
        .withColumn(out, F.coalesce("_moved", "_border")["v"])
        .drop("_moved", "_border", "_value", *chunk_names)
    )


def numbered(df: DataFrame, keys: list[str], chunk: list[Column], order: list[Column | str], out: str) -> DataFrame:
    """``out`` = 1, 2, 3... inside each key: position in the chunk plus the rows of earlier chunks."""
    chunk_names = [f"_chunk{i}" for i in range(len(chunk))]
    tagged = df.withColumns({n: c for n, c in zip(chunk_names, chunk)})
    across = Window.partitionBy(*keys).orderBy(*chunk_names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(*keys, *chunk_names).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, *chunk_names).orderBy(*order)
    return (
        tagged.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*keys, *chunk_names])
        .withColumn(out, F.col("_at") + F.col("_before"))
        .drop("_at", "_before", *chunk_names)
    )


def running_sum(df: DataFrame, keys: list[str], chunk: list[Column], order: list[Column | str], value: Column, out: str) -> DataFrame:
    """``out`` = sum of ``value`` from the first row of the key to this one."""
    chunk_names = [f"_chunk{i}" for i in range(len(chunk))]
    tagged = df.withColumns({n: c for n, c in zip(chunk_names, chunk)}).withColumn("_value", value)
    across = Window.partitionBy(*keys).orderBy(*chunk_names).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, *chunk_names).agg(F.sum("_value").alias("_total"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, *chunk_names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.withColumn("_sum", F.sum("_value").over(inside))
        .join(offsets, [*keys, *chunk_names])
        .withColumn(out, F.col("_sum") + F.col("_before"))
        .drop("_sum", "_before", "_value", *chunk_names)
    )


def running_max(df: DataFrame, keys: list[str], chunk: list[Column], order: list[Column | str], value: Column, out: str) -> DataFrame:
    """``out`` = greatest ``value`` of the rows of the key before this one; NULL on the first."""
    return _so_far(df, keys, chunk, order, value, out, F.max, F.max("_value"), False)


def last_known(df: DataFrame, keys: list[str], chunk: list[Column], order: list[str], value: Column, out: str, following: bool = False) -> DataFrame:
    """``out`` = the nearest ``value`` that is not NULL on a row of the key before (or after) this one."""
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    edge = F.min_by("_value", position) if following else F.max_by("_value", position)
    return _so_far(df, keys, chunk, order, value, out, lambda c: F.last(c, ignorenulls=True), edge, following)


def _so_far(df: DataFrame, keys: list[str], chunk: list[Column], order: list[Column | str], value: Column, out: str,
            fold: Callable[[str], Column], edge: Column, following: bool) -> DataFrame:
    """``fold`` of the values before each row: those of its chunk, else (or with) the ``edge`` of each earlier chunk."""
    turned = (lambda c: F.desc(c) if isinstance(c, str) else c.desc()) if following else (lambda c: c)
    chunk_names = [f"_chunk{i}" for i in range(len(chunk))]
    tagged = df.withColumns({n: c for n, c in zip(chunk_names, chunk)}).withColumn("_value", value)
    across = Window.partitionBy(*keys).orderBy(*[turned(n) for n in chunk_names]).rowsBetween(Window.unboundedPreceding, -1)
    edges = tagged.groupBy(*keys, *chunk_names).agg(edge.alias("_edge"))
    before = edges.select(*keys, *chunk_names, fold("_edge").over(across).alias("_before"))
    inside = Window.partitionBy(*keys, *chunk_names).orderBy(*[turned(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    joined = tagged.withColumn("_inside", fold("_value").over(inside)).join(before, [*keys, *chunk_names])
    both = F.greatest("_inside", "_before") if fold is F.max else F.coalesce("_inside", "_before")
    return joined.withColumn(out, both).drop("_inside", "_before", "_value", *chunk_names)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int, out: str = "rank") -> DataFrame:
    """First k rows of each key. Spark limits each input partition to k rows per key before the
    shuffle (a rank compared with a literal), so a hot key reaches its task already cut down."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Order statistics ceil(p*n) per key, NULL values left out.

    Values are counted first, so a hot key arrives as its distinct values (whole milliseconds), not
    as its rows; the running count is then compared with the wanted rank.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by_value = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(by_value), "_total": F.sum("_n").over(whole)})
    return ranked.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_total") / F.lit(100)), F.col(value))).alias(name)
        for name, p in percents.items()
    ])
