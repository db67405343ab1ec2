"""Table contracts: upsert, verified copies, text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.operators.ordered import top_per_key
from lumbrera.sources import versioned


def upsert(target: DataFrame, batch: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """Target with the batch inserted or replacing by key. In a batch the last by ``order`` wins."""
    position = F.lit(0) if order is None else order
    rows = target.withColumns({"_new": F.lit(0), "_order": F.lit(None)}).unionByName(
        batch.withColumns({"_new": F.lit(1), "_order": position}), allowMissingColumns=True)
    return top_per_key(rows, key, [F.desc("_new"), F.desc_nulls_last("_order")], 1).drop("_new", "_order", "rank")


class CopyRefused(RuntimeError):
    """The target already holds rows and replacing was not asked for."""


def upsert_stored(batch: DataFrame, path: str, key: list[str], order: str | None = None, buckets: int = versioned.BUCKETS) -> versioned.Manifest:
    """Merge ``batch`` into the stored table at ``path``, which is made where there is none.

    Only buckets with a key of the batch are read and written; the others keep their files. In a batch
    the last by the column ``order`` wins, which is not stored; columns of the table that the batch lacks
    become null in its rows.
    """
    spark = batch.sparkSession
    live = versioned.current(spark, path)
    if live is None:
        stored = batch.drop(order) if order else batch
        rows = upsert(stored.limit(0), batch, key, F.col(order) if order else None).select(stored.columns)
        return versioned.replace(rows, path, key, buckets, None)
    if list(live.key) != key:
        raise ValueError(f"the table at {path} has the key {list(live.key)}")
    touched = [r[0] for r in batch.select(versioned.bucket_of(key, live.buckets)).distinct().collect()]  # at most one number a bucket
    old = versioned.read(spark, path, live, touched)
    merged = upsert(old, batch, key, F.col(order) if order else None).select(old.columns)
    fresh = versioned.stage(merged, path, key, live.buckets)
    kept = {b: f for b, f in live.folders.items() if b not in touched}
    return versioned.commit(spark, path, live, old.schema, key, live.buckets, kept | fresh)


def copy_table(spark: SparkSession, source: DataFrame, path: str, key: list[str], force: bool = False, dry_run: bool = False) -> DataFrame:
    """Copy a table to ``path``: common columns only, a non-empty target refused unless forced.

    A forced copy replaces by ``key``: rows of the target that the source does not have stay. The target
    is a versioned table: the copy becomes visible by one commit, and a copy that stops before leaves what was there.
    ``dry_run`` writes nothing. Returns one row: rows read, rows at the target afterwards, and whether
    every key of the source is there.
    """
    live = versioned.current(spark, path)
    existing, merged = None, source
    if live is not None:
        existing = versioned.read(spark, path, live)
        common = [c for c in source.columns if c in existing.columns]
        if not force and not existing.isEmpty():
            raise CopyRefused(f"{path} already holds rows")
        others = existing.select(*common).join(source.select(*key).distinct(), key, "left_anti").select(*common)
        merged = others.unionByName(source.select(*common))
    if not dry_run:
        existing = versioned.read(spark, path, versioned.replace(merged, path, [], 1, live))
    found = source.limit(0) if existing is None else existing
    missing = source.select(*key).distinct().join(found.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("missing"))
    counts = source.agg(F.count("*").alias("rows_in_source")).crossJoin(found.agg(F.count("*").alias("rows_in_target"))).crossJoin(missing)  # one row each
    return counts.select("rows_in_source", "rows_in_target", (F.col("missing") == 0).alias("complete"))


def export_text(adapted: DataFrame, fmt: str = "md") -> DataFrame:
    """One text per document: header, warnings if any, body.

    ``adapted``: doc_id, adapted_text, applied, total_proposals, warnings (array).
    """
    applied = F.format_string("%d de %d", "applied", "total_proposals")
    has = F.size("warnings") > 0
    if fmt == "md":
        header = F.concat(
            F.lit("# Material Adaptado\n\n**ID de análisis:** `"), F.col("doc_id").cast("string"), F.lit("`  \n**Propuestas aplicadas:** "), applied, F.lit("\n\n---\n\n"))
        warned = F.when(has, F.concat(
            F.lit("> **Advertencias:**\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("> - "), w)), "\n"), F.lit("\n\n"))).otherwise("")
    else:
        header = F.concat(
            F.lit("MATERIAL ADAPTADO\nID de análisis: "), F.col("doc_id").cast("string"), F.lit("\nPropuestas aplicadas: "), applied, F.lit("\n" + "=" * 60 + "\n\n"))
        warned = F.when(has, F.concat(
            F.lit("ADVERTENCIAS:\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("  - "), w)), "\n"), F.lit("\n\n"))).otherwise("")
    return adapted.select("doc_id", F.concat(header, warned, "adapted_text").alias("content"))


def write_text(exported: DataFrame, path: str, buckets: int = 256) -> None:
    """Text files, one record per document, spread over folders by document so none grows with the corpus."""
    parts = exported.select(F.pmod(F.col("doc_id"), F.lit(buckets)).alias("bucket"), F.col("content").alias("value"))
    parts.write.mode("overwrite").partitionBy("bucket").option("lineSep", "\n\f\n").text(path)
