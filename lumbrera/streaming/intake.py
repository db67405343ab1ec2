"""Account of the files of an event source: which were read, which drifted from the declared schema, which could not be read.

The stream reads with the declared schema: a missing column is null, another one is left out, a file
that cannot be read with it gives no rows and does not stop the stream. So every batch writes, beside its
rows, a ledger: for each file its rows and how often each column has a value. Afterwards the folder is
compared with the ledger. Columns that the schema does not name are looked for in the merged schema of
all files, one job if there are none; only where there are some, the files are halved until they are found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

ACCOUNT = "file string, status string, rows long, absent array<string>, extra array<string>"


def stream_accounted(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """The source with the path of each row's file; unreadable files are passed over."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.option("ignoreCorruptFiles", "true").parquet(folder).withColumn("_file", F.col("_metadata.file_path"))


def writer(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows, then their ledger, each in a folder of the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rows/batch={batch_id}")
        values = F.array(*[F.struct(F.lit(n).alias("name"), F.count(f"`{n}`").alias("n")) for n in schema.names])
        stored.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("rows"), values.alias("values")).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")

    return write


def take_in(spark: SparkSession, folder: str, schema: StructType, path: str, glob: str = "*.parquet", files_per_batch: int = 1000) -> StreamingQuery:
    """Started query that reads what is in ``folder`` now and has not been read."""
    stream = stream_accounted(spark, folder, schema, glob, files_per_batch)
    return stream.writeStream.foreachBatch(writer(path, schema)).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()


def rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows taken in, with the declared columns."""
    return spark.read.schema(schema).parquet(f"{path}/rows")


def extra_columns(spark: SparkSession, files: list[str], declared: StructType) -> dict[str, list[str]]:
    """Columns of each file that ``declared`` does not name, for the files that have some."""
    known, found = set(declared.names), {}

    def visit(group: list[str]) -> None:
        try:
            merged = spark.read.option("mergeSchema", "true").parquet(*group).schema.names
        except PySparkException:  # types that cannot be merged: ask the halves
            merged = None if len(group) > 1 else []
        if merged is not None and set(merged) <= known:
            return
        if len(group) == 1:
            found[group[0]] = sorted(set(merged or []) - known)
            return
        visit(group[: len(group) // 2])
        visit(group[len(group) // 2 :])

    if files:
        visit(files)
    return found


def accounts(spark: SparkSession, folder: str, schema: StructType, path: str, glob: str = "*.parquet") -> DataFrame:
    """(file, status, rows, absent, extra) of every file of ``folder``.

    ``accepted``: read, with every column; ``drifted``: read, but columns of the schema have no value in
    it (``absent``) or it has others (``extra``); ``rejected``: no row could be read from it.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    listed = listed.select(plain(F.col("path")).alias("file"))  # the contents are not read
    ledger = spark.read.parquet(f"{path}/ledger").groupBy(plain(F.col("file")).alias("file")).agg(F.sum("rows").alias("rows"), F.flatten(F.collect_list("values")).alias("values"))
    both = listed.join(ledger, "file", "left")
    readable = [r["file"] for r in both.where("rows IS NOT NULL").select("file").collect()]  # names of files
    extra = spark.createDataFrame(list(extra_columns(spark, readable, schema).items()), "file string, extra array<string>")
    absent = F.array_sort(F.transform(F.filter("values", lambda v: v["n"] == 0), lambda v: v["name"]))
    told = both.join(extra, "file", "left").withColumns({"absent": F.coalesce(absent, F.array().cast("array<string>")), "extra": F.coalesce("extra", F.array().cast("array<string>"))})
    status = F.when(F.col("rows").isNull(), "rejected").when((F.size("absent") > 0) | (F.size("extra") > 0), "drifted").otherwise("accepted")
    return told.select("file", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "absent", "extra")
