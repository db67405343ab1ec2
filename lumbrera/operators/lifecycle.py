"""Retention, links, quotas and rate limits."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbrera.operators.ordered import running_sum
from lumbrera.operators.usage import connection_status
from lumbrera.operators.windows import epoch, moment, values

MINUTE_US = 60 * 1_000_000
DAY_US = 24 * 60 * MINUTE_US
# A pending upload is abandoned after its URL's life plus a margin.
UPLOAD_URL_SECONDS = 300
ABANDON_MARGIN = timedelta(minutes=10)


def unexpired(df: DataFrame, now: datetime, owner=None) -> DataFrame:
    live = df.filter(F.col("expires_at") > moment(df, "expires_at", now))
    return live if owner is None else live.filter(F.col("user_id") == owner)


def purge_expired(df: DataFrame, cutoff: datetime, column: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by age or expiry. Rows without a date are kept."""
    old = F.coalesce(F.col(column) < moment(df, column, cutoff), F.lit(False))
    return df.filter(~old), df.filter(old)


def cleanup_plan(files: DataFrame, now: datetime) -> DataFrame:
    """Files to delete, soonest expiry first: expired, or pending longer than an upload can take."""
    expired = F.col("expires_at") <= moment(files, "expires_at", now)
    before = now - timedelta(seconds=UPLOAD_URL_SECONDS) - ABANDON_MARGIN
    abandoned = (F.col("status") == "pending") & (F.col("created_at") < moment(files, "created_at", before))
    return files.filter(expired | abandoned).select(
        "file_id", "status", "expires_at", F.when(expired, "expired").otherwise("abandoned").alias("reason")
    ).orderBy("expires_at", "file_id")


def cascade_delete(parents: DataFrame, children: DataFrame, removed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children left once the removed parents are gone."""
    gone = removed.select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def effective_expiry(files: DataFrame, diagnoses: DataFrame, hours: int, max_hours: int) -> DataFrame:
    """Expiry of each file: the configured hours within the maximum, an export no later than its diagnosis.

    ``diagnoses``: file_id, diagnosis_expires_at.
    """
    own = F.col("created_at").cast("timestamp") + F.make_dt_interval(hours=F.lit(min(hours, max_hours)))
    capped = F.when(F.col("kind") == "export", F.least(own, F.col("diagnosis_expires_at").cast("timestamp"))).otherwise(own)
    return files.join(diagnoses, "file_id", "left").withColumn("effective_expires_at", capped).drop("diagnosis_expires_at")


def active_links(shares: DataFrame, now: datetime) -> DataFrame:
    return shares.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > moment(shares, "expires_at", now)))


def resolve_links(shares: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """Links that open a file now: not revoked, nothing expired, upload finished. Both sides are filtered before the join."""
    ready = unexpired(files.filter(F.col("status") == "uploaded"), now).select("file_id", "filename", "kind", "user_id")
    return active_links(shares, now).select("share_id", "file_id").join(ready, "file_id")


def link_access_totals(opens: DataFrame, key: str) -> DataFrame:
    return opens.groupBy(key).agg(F.count("*").alias("access_count"), F.max("created_at").alias("last_access_at"))


# --- trailing counts -------------------------------------------------------------------------------

def _trailing(events: DataFrame, key: str, horizon: int, blocks: int, out: str) -> DataFrame:
    """Hits of the key in the half-open window (t - horizon, t], t included.

    Time is cut into blocks of horizon/blocks. The count at t is: hits in the whole blocks between,
    plus hits of t's own block up to t, minus hits of the oldest block that have left the window.
    The last two come from one window inside (key, block), where hits of one horizon ago are laid
    over as rows that subtract; the first from a window over the block counts. No task ever holds
    more of a key than one block of it, twice.
    """
    size = horizon // blocks
    native = events.select(key, "event_id", F.col("at").alias("at"), F.lit(1).alias("sign"))
    leaving = events.select(key, F.lit(None).cast("long").alias("event_id"), (F.col("at") + horizon).alias("at"), F.lit(-1).alias("sign"))
    both = native.unionByName(leaving).withColumn("block", F.floor(F.col("at") / size))
    upto = Window.partitionBy(key, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.sum("sign").over(upto)).filter("event_id is not null")
    counts = events.groupBy(key, F.floor(F.col("at") / size).alias("block")).agg(F.count("*").alias("_n"))
    span = Window.partitionBy(key).orderBy("block").rangeBetween(-blocks, -1)
    earlier = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(span), F.lit(0))).drop("_n")
    return inside.join(earlier, [key, "block"]).select(
        key, "event_id", "at", (F.col("_inside") + F.col("_earlier")).alias(out))


def trailing_counts(events: DataFrame, key: str, column: str = "created_at") -> DataFrame:
    """Hits per key in the last 60 seconds and the last 24 hours at every hit."""
    base = events.select(key, "event_id", epoch(F.col(column)).alias("at"))
    minute = _trailing(base, key, MINUTE_US, 1, "last_minute")
    day = _trailing(base, key, DAY_US, 24, "last_day")
    return minute.join(day.drop("at"), [key, "event_id"])


# --- limiter ---------------------------------------------------------------------------------------

class Limiter:
    """Sliding limits of one key, told by the time at which the next call passes.

    With a limit of n calls in a span, a call passes once the n-th last accepted call is a span old. So
    the only state is the last accepted times, as many as the larger limit. Refused calls leave no
    trace; 0 means no limit.
    """

    def __init__(self, per_minute: int, per_day: int):
        self.limits = [(n, span) for n, span in ((per_minute, MINUTE_US), (per_day, DAY_US)) if n > 0]
        self.accepted: deque[int] = deque(maxlen=max((n for n, _ in self.limits), default=1))

    def reset(self, times=()) -> None:
        self.accepted.clear()
        self.accepted.extend(times)

    def passes_at(self) -> int | None:
        """Earliest time of the next accepted call; None when nothing holds it back."""
        return max((self.accepted[-n] + span for n, span in self.limits if n <= len(self.accepted)), default=None)

    def offer(self, now: int, n: int) -> tuple[int, int | None]:
        """(accepted of n simultaneous calls, wait in microseconds told to the rest)."""
        for done in range(n):
            free = self.passes_at()
            if free is not None and free > now:
                return done, free - now
            self.accepted.append(now)
        return n, None


def retry_seconds(wait_us: float) -> int:
    return max(1, math.ceil(wait_us / 1_000_000))


def replay_limiter(events: DataFrame, key: str, per_minute: int, per_day: int, column: str = "created_at") -> DataFrame:
    """accepted and retry_after (seconds) for every call, as a limiter in front of them would have said.

    Calls are split where the limiter must be empty (a silence as long as its memory), and only
    stretches whose trailing counts ever pass a limit are replayed: elsewhere everything passes.
    Simultaneous calls travel as one row with a count. The replay reads sorted partitions as a
    stream and keeps no more than the limit's worth of times.
    """
    counted = trailing_counts(events, key, column)
    over = F.lit(False)
    if per_minute > 0:
        over = over | (F.col("last_minute") > per_minute)
    if per_day > 0:
        over = over | (F.col("last_day") > per_day)
    # An instant follows a silence when its trailing count is no more than its own calls.
    instants = counted.groupBy(key, "at").agg(
        F.count("*").alias("n"), F.max(over.cast("int")).alias("over"), F.min("last_day").alias("last_day"), F.min("last_minute").alias("last_minute"))
    alone = F.col("last_day") == F.col("n") if per_day > 0 else F.col("last_minute") == F.col("n")
    stretched = running_sum(instants, [key], [F.floor(F.col("at") / DAY_US)], ["at"], alone.cast("long"), "stretch")
    contested = stretched.groupBy(key, "stretch").agg(F.max("over").alias("contested"))
    marked = stretched.join(contested, [key, "stretch"])
    free = marked.filter("contested = 0").select(key, "at", F.col("n").alias("passed"), F.lit(None).cast("long").alias("wait"))
    key_type = events.schema[key].dataType.simpleString()

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter, current = Limiter(per_minute, per_day), None
        for pdf in batches:
            passed, waits = [], []
            for k, stretch, at, n in zip(pdf[key], pdf["stretch"], pdf["at"], pdf["n"]):
                if (k, stretch) != current:
                    current = (k, stretch)
                    limiter.reset()
                accepted, wait = limiter.offer(int(at), int(n))
                passed.append(accepted)
                waits.append(wait)
            yield pd.DataFrame({key: pdf[key], "at": pdf["at"], "passed": passed, "wait": pd.array(waits, dtype="Int64")})

    replayed = (
        marked.filter("contested = 1").select(key, "stretch", "at", "n")
        .repartition(key, "stretch").sortWithinPartitions(key, "stretch", "at")
        .mapInPandas(replay, schema=f"{key} {key_type}, at long, passed long, wait long")
    )
    verdicts = free.unionByName(replayed)
    turn = F.row_number().over(Window.partitionBy(key, "at").orderBy("event_id"))
    calls = counted.select(key, "event_id", "at").withColumn("turn", turn)
    accepted = F.col("turn") <= F.col("passed")
    return calls.join(verdicts, [key, "at"]).select(
        key, "event_id", accepted.alias("accepted"),
        F.when(~accepted, F.greatest(F.lit(1), F.ceil(F.col("wait") / 1_000_000))).cast("long").alias("retry_after"))


# --- quotas and connections ---------------------------------------------------------------------------

def quota_counters(events: DataFrame) -> DataFrame:
    """Requests and tokens per connection and UTC minute, with the running UTC-day totals left to a second row set."""
    base = events.filter(F.col("connection_id").isNotNull())
    per_minute = base.groupBy("connection_id", F.date_trunc("minute", "created_at").alias("since")).agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"))
    per_day = per_minute.groupBy("connection_id", F.date_trunc("day", "since").alias("since")).agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))
    return per_minute.withColumn("span", F.lit("minute")).unionByName(per_day.withColumn("span", F.lit("day")))


def pick_connection(connections: DataFrame, require_vision: bool = False) -> DataFrame:
    """The usable connection with the lowest priority number, ties by id: one row or none."""
    usable = connection_status(connections).filter(F.col("status").isin("active", "standby", "near-limit"))
    if require_vision:
        usable = usable.filter("supports_vision")
    return usable.orderBy("priority", "id").limit(1).select("id", "label", "priority")


# Fixed values, from best to worst.
SERVICE_STATES = ("unconfigured", "ok", "degraded", "down")


def service_status(checks: DataFrame) -> DataFrame:
    """Current state of every service and since when it holds.

    ``checks``: service, at, check_id, state. Islands are not numbered: the state holds since the
    first check after the last one that said otherwise, which takes two partial aggregates.
    """
    spot = F.struct("at", "check_id")
    last = checks.groupBy("service", "state").agg(F.max(spot).alias("last"))
    newest = last.groupBy("service").agg(F.max_by("state", "last").alias("current"))
    other = last.join(newest, "service").filter(F.col("state") != F.col("current")).groupBy("service").agg(F.max("last").alias("other"))
    edges = newest.join(other, "service", "left")
    held = checks.join(edges, "service").filter(F.col("other").isNull() | (spot > F.col("other")))
    return held.groupBy("service", F.col("current").alias("state")).agg(F.min("at").alias("since"))


def service_rollup(checks: DataFrame) -> DataFrame:
    """Counts of services by state, with the worst configured state on every row."""
    status = service_status(checks)
    counts = status.groupBy("state").agg(F.count("*").alias("services"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SERVICE_STATES]), F.col("state"))
    worst = status.filter(F.col("state") != "unconfigured").agg(
        F.coalesce(F.max_by("state", rank), F.lit("unconfigured")).alias("overall"))
    return values(checks.sparkSession, "state", SERVICE_STATES).join(counts, "state", "left").na.fill(0, ["services"]).crossJoin(F.broadcast(worst))
