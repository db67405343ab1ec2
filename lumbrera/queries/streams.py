"""Continuous queries run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbrera.bindings import SQL, _SPARK_SQL, entity, table
from lumbrera.queries.lifecycle import PER_DAY, PER_MINUTE
from lumbrera.queries.metrics import iso, iso_sql
from lumbrera.queries.registry import query
from lumbrera.session import checkpoint_dir
from lumbrera.streaming import events as S
from lumbrera.streaming import intake, late


def fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def source(spark, sf, base: str) -> DataFrame:
    """The streamed base table, which is one file or a folder of files."""
    schema, path = table(spark, sf, base).schema, f"{sf.rstrip('/')}/{base}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return S.stream_events(spark, path, schema)
    return S.stream_events(spark, sf, schema, glob=f"{base}.parquet")


def projected(spark, sf, base: str, entity: str) -> DataFrame:
    """The entity's projection over the streamed base table."""
    source(spark, sf, base).createOrReplaceTempView(base)
    return spark.sql(_SPARK_SQL.get(entity, SQL[entity]))


@query("w01_event_source", """
SELECT CASE event_id % 5 WHEN 4 THEN 'drifted' ELSE 'accepted' END AS status, CASE event_id % 5 WHEN 4 THEN 'props' END AS absent, CASE event_id % 5 WHEN 4 THEN 'origin' END AS extra,
  count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS id_sum, CAST(count(CASE event_id % 5 WHEN 4 THEN NULL ELSE props END) AS BIGINT) AS with_props FROM events GROUP BY 1, 2, 3
UNION ALL SELECT 'rejected', NULL, NULL, 0, NULL, NULL""")
def event_source(spark, sf):
    """The events in an inbox of several drops: four with the declared columns, one without ``props`` and with another column, one that is no Parquet."""
    events, folder = table(spark, sf, "events"), fresh(spark, "intake")
    part = F.col("event_id") % 5
    events.withColumn("drop", part).where("drop < 4").write.partitionBy("drop").parquet(f"{folder}/inbox/whole")
    events.where(part == 4).drop("props").withColumn("origin", F.lit("import")).write.parquet(f"{folder}/inbox/drifted")
    events.select(F.lit("no rows in here").alias("value")).limit(1).write.text(f"{folder}/inbox/damaged", lineSep="\n")
    _suffixed(spark, f"{folder}/inbox/damaged")
    intake.take_in(spark, f"{folder}/inbox", events.schema, f"{folder}/taken").awaitTermination()
    told = intake.accounts(spark, f"{folder}/inbox", events.schema, f"{folder}/taken")
    taken = spark.read.parquet(f"{folder}/taken/rows").groupBy(F.regexp_replace("_file", "^file:/+", "/").alias("file")).agg(F.sum("event_id").alias("id_sum"), F.count("props").alias("with_props"))
    names = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return told.join(taken, "file", "left").groupBy("status", names("absent").alias("absent"), names("extra").alias("extra")).agg(
        F.sum("rows").alias("n_rows"), F.sum("id_sum").alias("id_sum"), F.sum("with_props").alias("with_props"))


def _suffixed(spark, folder: str) -> None:
    """Name the text files of ``folder`` as Parquet files are named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.listStatus(at):
        name = found.getPath()
        if name.getName().endswith(".txt"):
            files.rename(name, name.suffix(".parquet"))


@query("w02_stream_usage", f"""
SELECT {iso_sql("time_bucket(INTERVAL 1 HOUR, created_at)")} AS bucket_start, outcome, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM ai_usage_events
WHERE time_bucket(INTERVAL 1 HOUR, created_at) + INTERVAL 1 HOUR <= date_trunc('milliseconds', (SELECT max(created_at) FROM ai_usage_events)) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def stream_usage(spark, sf):
    out = S.run_to_table(S.stream_usage(projected(spark, sf, "events", "ai_usage_events")), fresh(spark, "usage"))
    return out.select(iso(F.col("bucket_start")).alias("bucket_start"), "outcome", "calls", "tokens")


@query("w03_stream_trailing")
def stream_trailing(spark, sf):
    out = S.run_to_table(S.stream_trailing(projected(spark, sf, "events", "ai_usage_events"), "connection_id"), fresh(spark, "trailing"))
    return out.select(iso(F.col("as_of")).alias("as_of"), "connection_id", "hits")


@query("w04_stream_limiter")
def stream_limiter(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    calls = projected(spark, sf, "events", "ai_usage_events")
    return S.run_to_table(S.stream_limiter(calls, "connection_id", PER_MINUTE, PER_DAY), fresh(spark, "limiter"))


@query("w05_stream_gate")
def stream_gate(spark, sf):
    folder = fresh(spark, "gate")
    stream = projected(spark, sf, "documents", "materials")
    S.stream_gate(stream, f"{folder}/clear", f"{folder}/blocked", f"{folder}/_state").awaitTermination()
    read = [spark.read.parquet(f"{folder}/{p}").select("doc_id", F.lit(p).alias("route")) for p in ("clear", "blocked")]
    return read[0].unionByName(read[1])


@query("w06_stream_decisions", """
SELECT doc_id, proposal_id, barrier_id, arg_max(to_status, seq) AS status FROM decision_log GROUP BY 1, 2, 3""")
def stream_decisions(spark, sf):
    out = S.run_to_table(S.stream_decisions(projected(spark, sf, "lineitem", "decision_log")), fresh(spark, "decisions"), "update")
    return out.groupBy("doc_id", "proposal_id", "barrier_id").agg(F.max_by("status", "seq").alias("status"))


ARRIVALS, LATENESS_US = 5, 600_000_000


def arrivals(events: DataFrame) -> DataFrame:
    """Events with the slot of time in which they arrive: every eleventh up to sixteen hours after it happened."""
    at = F.unix_micros(F.col("created_at").cast("timestamp")) + F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 97 * 600_000_000).otherwise(0)
    timed = events.withColumn("at", at)
    ends = timed.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends["first"] is None:
        return timed.withColumn("slot", F.lit(0)).drop("at")
    return timed.withColumn("slot", F.floor((F.col("at") - ends["first"]) * ARRIVALS / F.lit(ends["last"] - ends["first"] + 1)).cast("int")).drop("at")


@query("w07_late_data", f"""
SELECT * FROM (WITH a AS (SELECT event_id, epoch_us(created_at) AS t, epoch_us(created_at) + CASE WHEN event_id % 11 = 0 THEN event_id % 97 * 600000000 ELSE 0 END AS due FROM ai_usage_events),
s AS (SELECT *, (due - (SELECT min(due) FROM a)) * {ARRIVALS} // ((SELECT max(due) FROM a) - (SELECT min(due) FROM a) + 1) AS slot FROM a),
m AS (SELECT slot, max(max(t)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {LATENESS_US} AS mark FROM s GROUP BY slot)
SELECT slot AS batch, count(*) AS n_rows, count(*) FILTER (mark IS NULL OR t > mark) AS accepted, count(*) FILTER (t <= mark) AS dropped, count(*) FILTER (t <= mark) AS dropped_in_progress,
  CAST(coalesce(sum(event_id) FILTER (t <= mark), 0) AS BIGINT) AS late_ids FROM s JOIN m USING (slot) GROUP BY slot)""")
def late_data(spark, sf):
    """What arrives in each slot, routed by the watermark, beside what the engine's own operator drops."""
    folder = fresh(spark, "late")
    arriving = arrivals(entity(spark, sf, "ai_usage_events").select("event_id", "created_at"))
    arriving.write.partitionBy("slot").parquet(f"{folder}/all")
    schema = arriving.drop("slot").schema
    slots = sorted(r[0] for r in spark.read.parquet(f"{folder}/all").select("slot").distinct().collect())
    counted = []
    for batch, slot in enumerate(slots):
        spark.read.schema(schema).parquet(f"{folder}/all/slot={slot}").write.parquet(f"{folder}/in/slot{slot}")
        stream = S.stream_events(spark, f"{folder}/in/*", schema, None)
        late.route(stream, f"{folder}/routed", "created_at", LATENESS_US // 1000).awaitTermination()
        own = late.stream_distinct(stream, ["event_id"], "created_at", f"{LATENESS_US // 1_000_000} seconds").writeStream.format("noop").option("checkpointLocation", f"{folder}/own").trigger(availableNow=True).start()
        own.awaitTermination()
        counted.append((batch, slot, late.dropped_rows(own)))
    dropped = spark.createDataFrame(counted, "batch long, slot long, dropped_in_progress long")
    ids = late.rows(spark, f"{folder}/routed", True).groupBy("batch").agg(F.sum("event_id").alias("late_ids"))
    return late.marks(spark, f"{folder}/routed").join(dropped, "batch").join(ids, "batch", "left").select(
        F.col("slot").alias("batch"), F.col("rows").alias("n_rows"), "accepted", "dropped", "dropped_in_progress", F.coalesce("late_ids", F.lit(0)).alias("late_ids"))
