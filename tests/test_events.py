import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumbrera.bindings import entity
from lumbrera.operators import lifecycle, ordered, usage
from lumbrera.operators.windows import ReportWindow
from lumbrera.queries import streams
from lumbrera.streaming import events as S

CALL = "who string, event_id long, created_at timestamp"
T0 = datetime(2024, 1, 1)


def calls(spark, seconds):
    return spark.createDataFrame([("a", i, T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)], CALL)


def random_calls(n, spread, seed):
    rng = random.Random(seed)
    return [(rng.choice("abc"), i, T0 + timedelta(seconds=rng.randint(0, spread))) for i in range(n)]


@pytest.mark.parametrize("per_minute, per_day, spread", [(3, 0, 900), (0, 20, 200_000), (2, 15, 90_000), (5, 50, 600), (0, 0, 100)])
def test_replay_accepts_exactly_what_the_limits_allow(spark, per_minute, per_day, spread):
    """Two statements fix every verdict: a call is accepted if and only if the accepted calls before it leave room, and the wait is the least that would."""
    rows = random_calls(400, spread, spread)
    got = {r["event_id"]: (r["accepted"], r["retry_after"]) for r in lifecycle.replay_limiter(spark.createDataFrame(rows, CALL), "who", per_minute, per_day).collect()}
    assert len(got) == len(rows)
    ordered_rows = sorted(rows, key=lambda r: (r[2], r[1]))
    for at_row, (who, i, at) in enumerate(ordered_rows):
        before = [t for w, j, t in ordered_rows[:at_row] if w == who and got[j][0]]

        def room(when, before=before):
            return all(not n or sum(when - span < t for t in before) < n for n, span in ((per_minute, timedelta(seconds=60)), (per_day, timedelta(days=1))))

        accepted, retry = got[i]
        assert accepted == room(at)
        if accepted:
            assert retry is None
        else:
            assert room(at + timedelta(seconds=retry)) and (retry == 1 or not room(at + timedelta(seconds=retry - 1)))


def test_refused_calls_are_free_and_the_minute_slides(spark):
    got = lifecycle.replay_limiter(calls(spark, [0, 10, 20, 30, 59, 60, 61]), "who", 2, 0).orderBy("event_id").collect()
    assert [r["accepted"] for r in got] == [True, True, False, False, False, True, False]
    assert got[2]["retry_after"] == 40


def test_trailing_counts_match_a_scan(spark):
    rows = random_calls(500, 200_000, 5) + random_calls(200, 300, 6)
    rows = [(w, i, at) for i, (w, _, at) in enumerate(rows)]
    got = {r["event_id"]: (r["last_minute"], r["last_day"]) for r in lifecycle.trailing_counts(spark.createDataFrame(rows, CALL), "who").collect()}
    for who, i, at in rows:
        want = tuple(sum(1 for w, _, t in rows if w == who and at - span < t <= at) for span in (timedelta(seconds=60), timedelta(days=1)))
        assert got[i] == want


def test_stream_limiter_agrees_with_the_replay(spark, sf):
    events = entity(spark, sf, "ai_usage_events")
    streamed = S.run_to_table(S.stream_limiter(streams.projected(spark, sf, "events", "ai_usage_events"), "connection_id", 2, 40), streams.fresh(spark, "t"))
    batch = lifecycle.replay_limiter(events, "connection_id", 2, 40)
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0 and streamed.count() == batch.count()


def test_late_events_are_dropped(spark, tmp_path):
    def write(name, rows):
        spark.createDataFrame(rows, "created_at timestamp, outcome string, total_tokens long").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    write("a", [(T0 + timedelta(hours=h), "ok", 1) for h in (0, 1, 5)])
    schema = spark.read.parquet(str(tmp_path / "in" / "a")).schema
    target = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        return {r["bucket_start"]: r["calls"] for r in S.run_to_table(S.stream_usage(stream), target).collect()}

    assert run() == {T0: 1, T0 + timedelta(hours=1): 1}
    write("b", [(T0 + timedelta(minutes=5), "ok", 1), (T0 + timedelta(hours=9), "ok", 1)])
    assert run() == {T0: 1, T0 + timedelta(hours=1): 1, T0 + timedelta(hours=5): 1}


def test_ordered_operations_cross_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    chunk = [F.floor(F.col("pos") / 7)]
    back = {r["pos"]: r["x"] for r in ordered.neighbour(df, ["k"], chunk, ["pos"], F.col("v"), "x").collect()}
    ahead = {r["pos"]: r["x"] for r in ordered.neighbour(df, ["k"], chunk, ["pos"], F.col("v"), "x", following=True).collect()}
    number = {r["pos"]: r["x"] for r in ordered.numbered(df, ["k"], chunk, ["pos"], "x").collect()}
    total = {r["pos"]: r["x"] for r in ordered.running_sum(df, ["k"], chunk, ["pos"], F.col("v"), "x").collect()}
    greatest = {r["pos"]: r["x"] for r in ordered.running_max(df, ["k"], chunk, ["pos"], F.col("v"), "x").collect()}
    some = F.when(F.col("v") > 6, F.col("v"))
    known = {r["pos"]: r["x"] for r in ordered.last_known(df, ["k"], chunk, ["pos"], some, "x").collect()}
    coming = {r["pos"]: r["x"] for r in ordered.last_known(df, ["k"], chunk, ["pos"], some, "x", following=True).collect()}
    for key in "ab":
        own = sorted(r for r in rows if r[0] == key)
        for i, (_, pos, _) in enumerate(own):
            assert greatest[pos] == max((v for _, _, v in own[:i]), default=None)
            assert known[pos] == next((v for _, _, v in reversed(own[:i]) if v > 6), None)
            assert coming[pos] == next((v for _, _, v in own[i + 1 :] if v > 6), None)
        for i, (_, pos, v) in enumerate(own):
            assert back[pos] == (own[i - 1][2] if i else None)
            assert ahead[pos] == (own[i + 1][2] if i + 1 < len(own) else None)
            assert number[pos] == i + 1 and total[pos] == sum(r[2] for r in own[:i + 1])


def test_kpis_on_a_fixed_clock(spark):
    rows = [(T0 + timedelta(hours=h), o, ms, 10) for h, o, ms in ((1, "ok", 1000), (2, "ok", 3000), (3, "error", 9000))]
    events = spark.createDataFrame(rows, "created_at timestamp, outcome string, latency_ms long, total_tokens long")
    got = {r["period"]: r for r in usage.kpis(events, ReportWindow("24h", T0 + timedelta(hours=12))).collect()}
    now = got["current"]
    assert (now["calls"], now["tokens"], now["latency_p95"], now["error_rate"]) == (3, 30, 3000, 33.3)
    assert (got["previous"]["calls"], got["previous"]["latency_p95"], got["previous"]["error_rate"]) == (0, None, None)


def test_days_start_where_the_viewer_is():
    w = ReportWindow("7d", datetime(2024, 1, 10, 1, 0), 180)
    assert w.start == datetime(2024, 1, 3, 3, 0) and w.end == datetime(2024, 1, 10, 3, 0)


def test_streamed_table_may_be_a_folder(spark, sf, tmp_path):
    from lumbrera.queries.registry import QUERIES

    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    routed = {r["doc_id"]: r["route"] for r in QUERIES["w05_stream_gate"](spark, str(tmp_path)).collect()}
    assert routed == {r["doc_id"]: r["route"] for r in QUERIES["w05_stream_gate"](spark, sf).collect()} and set(routed.values()) == {"clear", "blocked"}
