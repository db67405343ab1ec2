"""Helpers of the training-data operators: intermediate tables on shared storage, words, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_records: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of ``spark.checkpoint.dir``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for record in _records:
        record.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that :func:`scratch` gives out inside the block."""
    made: list[str] = []
    _records.append(made)
    try:
        yield made
    finally:
        _records.remove(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of :func:`scratch` that no result reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Later readers neither repeat the work nor depend on the executors that did it, and Spark plans
    them with the table's true size (a small one is broadcast by Spark's own threshold).
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separator: str) -> Column:
    """Non-empty pieces of ``text`` between runs of ``separator``; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names, each with underscores in front until no column of ``df`` has it (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
