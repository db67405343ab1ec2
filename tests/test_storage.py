"""Stored tables under crashes and concurrent writers, the account of late rows and of source files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumbrera.sources import tables, versioned
from lumbrera.streaming import events as S
from lumbrera.streaming import intake, late

T0 = datetime(2024, 1, 1)


def stored(spark, path):
    return sorted(map(tuple, versioned.read(spark, path).collect()))


class Stop(BaseException):
    """As if the process were killed."""


def stopping(monkeypatch, owner, name, after):
    """``owner.name`` stops before its work, or after it."""
    real = getattr(owner, name)

    def run(*args, **kwargs):
        if after:
            real(*args, **kwargs)
        raise Stop

    monkeypatch.setattr(owner, name, run)


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize(("owner", "name", "after", "new"), [
    (versioned, "stage", False, False), (versioned, "stage", True, False), (versioned._Files, "write", False, False), (versioned._Files, "write", True, False),
    (versioned._Files, "rename_new", False, False), (versioned._Files, "rename_new", True, True)])
def test_a_copy_that_stops_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, first, owner, name, after, new):
    path = str(tmp_path / "t")
    old, fresh = [(1, "a"), (2, "b")], [(1, "a"), (2, "new"), (3, "c")]
    if not first:
        tables.copy_table(spark, spark.createDataFrame(old, "id long, v string"), path, ["id"])
    source = spark.createDataFrame([(2, "new"), (3, "c")] if not first else fresh, "id long, v string")
    with monkeypatch.context() as patched:
        stopping(patched, owner, name, after)
        with pytest.raises(Stop):
            tables.copy_table(spark, source, path, ["id"], force=True)
    if new:
        assert stored(spark, path) == fresh
    elif first:
        assert versioned.current(spark, path) is None
    else:
        assert stored(spark, path) == old
    # What is left over does not hinder the next copy, and goes.
    assert tables.copy_table(spark, source, path, ["id"], force=True).first()["complete"] and stored(spark, path) == fresh
    versioned.vacuum(spark, path)
    assert stored(spark, path) == fresh and len(list((tmp_path / "t" / "data").iterdir())) == 1 and len(list((tmp_path / "t" / "_log").glob("*.json"))) == 1


def test_of_two_writers_from_one_version_one_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    base = versioned.replace(rows, path, [], 1, None)
    versioned.replace(rows.withColumn("v", F.lit("first")), path, [], 1, base)
    with pytest.raises(versioned.CommitConflict):
        versioned.replace(rows.withColumn("v", F.lit("second")), path, [], 1, base)
    assert stored(spark, path) == [(1, "first")]


def files_of(tmp_path, spark, path):
    live = versioned.current(spark, path)
    return {b: sorted(f.name for f in (tmp_path / "t" / folder).glob("*.parquet")) for b, folder in live.folders.items()}


def test_upsert_rewrites_the_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(400).select(F.col("id"), F.lit("old").alias("v"), F.lit(None).cast("int").alias("w"))
    tables.upsert_stored(rows, path, ["id"], buckets=16)
    before = files_of(tmp_path, spark, path)
    batch = spark.createDataFrame([(7, "x", 1), (7, "y", 2), (1000, "new", 1)], "id long, v string, at int")
    tables.upsert_stored(batch, path, ["id"], "at")
    after = files_of(tmp_path, spark, path)
    touched = {r[0] for r in spark.createDataFrame([(7,), (1000,)], "id long").select(versioned.bucket_of(["id"], 16)).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and len(after) == 16
    want = sorted([(i, "y" if i == 7 else "old", None) for i in range(400)] + [(1000, "new", None)])
    assert stored(spark, path) == want
    tables.upsert_stored(batch.limit(0), path, ["id"], "at")
    assert stored(spark, path) == want and files_of(tmp_path, spark, path) == after
    versioned.vacuum(spark, path)
    assert stored(spark, path) == want
    with pytest.raises(ValueError, match="key"):
        tables.upsert_stored(batch, path, ["v"], "at")


def test_upsert_of_an_empty_table_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert_stored(spark.createDataFrame([], "id long, v string"), path, ["id"])
    assert stored(spark, path) == []
    tables.upsert_stored(spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "id long, v string"), path, ["id"])
    assert len(versioned.read(spark, path).collect()) == 2  # null is one key


def test_late_rows_are_kept_aside_as_the_engine_drops_them(spark, tmp_path):
    """Batches with rows at, before and after the watermark, null times, and a batch that runs twice."""
    at = lambda minutes, ms=0: T0 + timedelta(minutes=minutes, milliseconds=ms)
    drops = [[at(0), at(60)], [at(49), at(50), at(50, 1), at(61), None], [at(30), at(51), at(52)], [at(200)], [at(190), at(189), at(191)]]
    schema, n = "event_id long, created_at timestamp", 0
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    engine = []
    for i, times in enumerate(drops):
        spark.createDataFrame([(n + k, t) for k, t in enumerate(times)], schema).coalesce(1).write.parquet(f"{folder}/{i}")
        n += len(times)
        stream = S.stream_events(spark, f"{folder}/*", spark.read.parquet(f"{folder}/0").schema, None)
        late.route(stream, path).awaitTermination()
        own = late.stream_distinct(stream, ["event_id"]).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "own")).trigger(availableNow=True).start()
        own.awaitTermination()
        engine.append(late.dropped_rows(own))
    told = {r["batch"]: (r["rows"], r["accepted"], r["dropped"]) for r in late.marks(spark, path).collect()}
    assert [told[i][2] for i in range(5)] == engine == [0, 2, 2, 0, 2]
    assert [told[i][0] for i in range(5)] == [len(t) for t in drops]
    dropped = {r["event_id"] for r in late.rows(spark, path, True).collect()}
    assert dropped == {2, 3, 7, 8, 11, 12} and late.rows(spark, path, False).count() == n - 6
    before = sorted(map(tuple, late.rows(spark, path, False).collect()), key=str)
    late.writer(path, "created_at", 600_000)(spark.read.parquet(f"{folder}/4"), 4)
    assert sorted(map(tuple, late.rows(spark, path, False).collect()), key=str) == before
    # Rows of a batch without its mark are not read.
    spark.read.parquet(f"{folder}/0").withColumn("late", F.lit(False)).write.partitionBy("late").parquet(f"{path}/rows/batch=9")
    assert late.rows(spark, path, False).count() == len(before)


def test_files_are_accounted_for(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a", T0), (2, None, T0)], "id long, v string, at timestamp").coalesce(1)
    rows.write.parquet(str(inbox / "good"))
    rows.drop("v").withColumns({"x": F.lit(1), "y": F.lit(2)}).write.parquet(str(inbox / "drift"))
    rows.withColumn("id", F.lit("text")).write.parquet(str(inbox / "type"))
    (inbox / "broken").mkdir()
    (inbox / "broken" / "a.parquet").write_bytes(b"PAR1 nothing")
    intake.take_in(spark, str(inbox), rows.schema, out).awaitTermination()
    told = {r["file"].split("/")[-2]: (r["status"], r["rows"], r["absent"], r["extra"]) for r in intake.accounts(spark, str(inbox), rows.schema, out).collect()}
    assert told == {"good": ("accepted", 2, [], []), "drift": ("drifted", 2, ["v"], ["x", "y"]), "type": ("rejected", 0, [], []), "broken": ("rejected", 0, [], [])}
    assert intake.rows(spark, out, rows.schema).count() == 4
    rows.withColumn("id", F.col("id") + 10).write.parquet(str(inbox / "next"))
    intake.take_in(spark, str(inbox), rows.schema, out).awaitTermination()
    assert sorted(r["id"] for r in intake.rows(spark, out, rows.schema).collect()) == [1, 1, 2, 2, 11, 12]
    assert {r["status"] for r in intake.accounts(spark, str(inbox), rows.schema, out).collect() if "next" in r["file"]} == {"accepted"}
