"""Usage, latency, product and file metrics over event tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.functions.text import file_format
from lumbrera.operators.ordered import nearest_rank
from lumbrera.operators.windows import (
    ReportWindow, assign_bucket, between, crosstab, fill, label_period, moment, spine, values,
)


def count_of(condition: Column) -> Column:
    return F.count_if(condition)


def sum_of(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def rate(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; NULL without a base."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1))


def usage_series(events: DataFrame, w: ReportWindow) -> DataFrame:
    facts = assign_bucket(events, w).groupBy("bucket").agg(
        F.count("*").alias("calls"), sum_of(F.col("total_tokens")).alias("tokens"),
        count_of(F.col("outcome") != "ok").alias("errors"),
    )
    return fill(spine(events.sparkSession, w), facts, ["bucket"], ["calls", "tokens", "errors"])


def outcome_series(events: DataFrame, w: ReportWindow) -> DataFrame:
    facts = crosstab(assign_bucket(events, w), "bucket", "outcome", cfg.USAGE_OUTCOMES)
    return fill(spine(events.sparkSession, w), facts, ["bucket"], list(cfg.USAGE_OUTCOMES))


def tokens_by_provider(events: DataFrame, w: ReportWindow, top: int = cfg.PROVIDER_SERIES) -> DataFrame:
    """Tokens per bucket for the leading providers (ties by name) with the rest folded together."""
    spark = events.sparkSession
    facts = assign_bucket(events, w).groupBy("provider", "bucket").agg(sum_of(F.col("total_tokens")).alias("tokens"))
    leaders = (
        facts.groupBy("provider").agg(F.sum("tokens").alias("total")).orderBy(F.desc("total"), "provider").limit(top)
        .select("provider", F.col("provider").alias("series"))
    )
    folded = (
        facts.join(F.broadcast(leaders), "provider", "left")
        .groupBy(F.coalesce("series", F.lit(cfg.OTHERS)).alias("series"), "bucket").agg(F.sum("tokens").alias("tokens"))
    )
    frame = folded.select("series").distinct().crossJoin(F.broadcast(spine(spark, w)))
    return fill(frame, folded, ["series", "bucket"], ["tokens"])


def tts_series(events: DataFrame, w: ReportWindow, kind: str = "tts") -> DataFrame:
    """Calls, characters, minutes and errors of one kind per bucket, with a total row (bucket -1)."""
    sums = assign_bucket(events.filter(F.col("kind") == kind), w).groupBy("bucket").agg(
        F.count("*").alias("calls"), sum_of(F.col("characters")).alias("characters"),
        F.sum("audio_seconds").alias("seconds"), count_of(F.col("outcome") != "ok").alias("errors"),
    )
    filled = fill(spine(events.sparkSession, w).select("bucket"), sums, ["bucket"], ["calls", "characters", "seconds", "errors"])
    rolled = filled.rollup("bucket").agg(*[F.sum(c).alias(c) for c in ("calls", "characters", "seconds", "errors")])
    return rolled.select(
        F.coalesce("bucket", F.lit(-1)).alias("bucket"), "calls", "characters",
        F.bround(F.col("seconds") / 60, 1).alias("minutes"), "errors",
    )


def kpis(events: DataFrame, w: ReportWindow) -> DataFrame:
    """Calls, tokens, p95 of successful calls and error rate, for the window and the one before."""
    labelled = label_period(events, w)
    totals = labelled.groupBy("period").agg(
        F.count("*").alias("calls"), sum_of(F.col("total_tokens")).alias("tokens"),
        count_of(F.col("outcome") != "ok").alias("failed"),
    )
    p95 = nearest_rank(labelled.filter(F.col("outcome") == "ok"), ["period"], "latency_ms", {"latency_p95": 95})
    frame = values(events.sparkSession, "period", ("current", "previous"))
    filled = fill(frame, totals, ["period"], ["calls", "tokens", "failed"]).join(p95, "period", "left")
    return filled.select("period", "calls", "tokens", "latency_p95", rate(F.col("failed"), F.col("calls")).alias("error_rate"))


def latency_by_model(events: DataFrame, w: ReportWindow) -> DataFrame:
    ok = between(events, w.start, w.end).filter(F.col("outcome") == "ok")
    calls = ok.groupBy("provider", "model").agg(F.count("*").alias("calls"))
    ranks = nearest_rank(ok, ["provider", "model"], "latency_ms", {"p50": 50, "p95": 95})
    return calls.join(ranks, ["provider", "model"]).orderBy(F.desc("p95"), "provider", "model")


def _thresholds(columns: list[str]) -> list[tuple[Column, Column]]:
    pairs = [
        ("rpm_threshold", "minute_request_count"), ("tpm_threshold", "minute_token_count"),
        ("rpd_threshold", "request_count"), ("tpd_threshold", "total_token_count"),
    ]
    return [(F.col(t), F.col(c)) for t, c in pairs if t in columns]


def connection_status(connections: DataFrame) -> DataFrame:
    """Adds usage_pct, the tightest limit in percent, and the state it puts the connection in."""
    pairs = _thresholds(connections.columns)
    exhausted = F.lit(False)
    for limit, used in pairs:
        exhausted = exhausted | F.coalesce(used >= limit, F.lit(False))
    ratios = [F.when(limit != 0, used / limit) for limit, used in pairs]
    usage = F.coalesce(F.greatest(*ratios), F.lit(0.0))
    near = usage >= cfg.NEAR_LIMIT_RATIO
    status = (
        F.when(~F.col("enabled"), "disabled").when(exhausted, "exhausted").when(near, "near-limit")
        .when(F.col("is_current"), "active").otherwise("standby")
    )
    return connections.withColumns({"status": status, "usage_pct": F.bround(usage * 100, 1)})


def connection_metrics(connections: DataFrame, events: DataFrame, w: ReportWindow) -> DataFrame:
    """Status of every connection with its calls, errors, latency and the tokens of the current day."""
    used = between(events, w.start, w.end).filter(F.col("connection_id").isNotNull())
    today = moment(events, "created_at", w.end - (w.step if w.unit == "day" else w.step * 24))
    totals = used.groupBy("connection_id").agg(
        F.count("*").alias("calls"), count_of(F.col("outcome") != "ok").alias("errors"),
        sum_of(F.when(F.col("created_at") >= today, F.col("total_tokens"))).alias("tokens_today"),
    )
    ranks = nearest_rank(used.filter(F.col("outcome") == "ok"), ["connection_id"], "latency_ms", {"p50": 50, "p95": 95})
    facts = totals.join(ranks, "connection_id", "left").withColumnRenamed("connection_id", "id")
    return connection_status(connections).join(facts, "id", "left").na.fill(0, ["calls", "errors", "tokens_today"])


def alerts(connections: DataFrame) -> DataFrame:
    return connection_status(connections).filter(F.col("status").isin("near-limit", "exhausted")).select("label", "status", "usage_pct")


def score_histogram(scores: DataFrame, column: str = "score") -> DataFrame:
    """Ten bins of ten points (100 in the last), with the overall average on every row."""
    spark = scores.sparkSession
    known = scores.filter(F.col(column).isNotNull())
    bins = known.groupBy(F.least(F.floor(F.col(column) / 10), F.lit(9)).cast("int").alias("bin")).agg(
        F.count("*").alias("documents"), F.sum(column).alias("points")
    )
    average = bins.agg(F.bround(F.sum("points") / F.sum("documents"), 0).cast("int").alias("average"))
    frame = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    return fill(frame, bins.drop("points"), ["bin"], ["documents"]).crossJoin(F.broadcast(average))


def materials_by_source(materials: DataFrame) -> DataFrame:
    counts = materials.groupBy("source_type").agg(F.count("*").alias("documents"))
    return fill(values(materials.sparkSession, "source_type", cfg.SOURCE_TYPES), counts, ["source_type"], ["documents"])


_DIAGNOSTIC = "estimated_score INT, barriers ARRAY<STRUCT<category: STRING, severity: STRING>>"


def parse_diagnostics(analyses: DataFrame) -> DataFrame:
    """Diagnostic JSON as columns; rows whose JSON cannot be read are dropped."""
    parsed = F.from_json("diagnostic_json", f"{_DIAGNOSTIC}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    rows = analyses.withColumn("d", parsed).filter("d is not null and d._broken is null")
    return rows.select("id", "source_type", "created_at", F.col("d.estimated_score").alias("score"), F.col("d.barriers").alias("barriers"))


def barrier_matrix(diagnostics: DataFrame) -> DataFrame:
    exploded = diagnostics.select(F.inline("barriers"))
    counts = crosstab(exploded, "category", "severity", cfg.SEVERITIES)
    return fill(values(diagnostics.sparkSession, "category", cfg.CATEGORIES), counts, ["category"], list(cfg.SEVERITIES))


def decision_matrix(proposals: DataFrame) -> DataFrame:
    """Adaptation type by status, with the acceptance rate over everything reviewed."""
    counts = fill(
        values(proposals.sparkSession, "adaptation_type", cfg.ADAPTATION_TYPES),
        crosstab(proposals, "adaptation_type", "status", cfg.PROPOSAL_STATUSES), ["adaptation_type"], list(cfg.PROPOSAL_STATUSES),
    )
    accepted = F.sum(F.col("aceptada") + F.col("editada"))
    reviewed = F.sum(F.col("aceptada") + F.col("editada") + F.col("descartada"))
    overall = counts.agg(F.when(reviewed > 0, F.bround(accepted / reviewed * 100, 0).cast("int")).alias("acceptance_rate"))
    return counts.crossJoin(F.broadcast(overall))


def transformation_matrix(transformations: DataFrame, now: datetime) -> DataFrame:
    live = transformations.filter(F.col("expires_at") > moment(transformations, "expires_at", now))
    state = F.when(F.col("status") == "failed", "fallida").otherwise(F.col("review_status"))
    counts = crosstab(live.withColumn("state", state), "format", "state", cfg.TRANSFORMATION_STATES)
    return fill(values(live.sparkSession, "format", cfg.TRANSFORMATION_FORMATS), counts, ["format"], list(cfg.TRANSFORMATION_STATES))


def recent(df: DataFrame, n: int, id_column: str) -> DataFrame:
    """Last n rows, newest first, ties by descending id: a top-k, not a global sort."""
    return df.orderBy(F.desc("created_at"), F.desc(id_column)).limit(n)


def file_activity_series(events: DataFrame, w: ReportWindow) -> DataFrame:
    facts = assign_bucket(events, w).groupBy("bucket").agg(
        *[count_of(F.col("event") == e).alias(e) for e in cfg.FILE_ACTIVITY],
        sum_of(F.when(F.col("event") == "upload", F.col("size_bytes"))).alias("uploaded_bytes"),
    )
    return fill(spine(events.sparkSession, w), facts, ["bucket"], [*cfg.FILE_ACTIVITY, "uploaded_bytes"])


def files_by_format(events: DataFrame, w: ReportWindow) -> DataFrame:
    counts = crosstab(between(events, w.start, w.end), "format", "event", cfg.FILE_KINDS)
    return fill(values(events.sparkSession, "format", cfg.FILE_FORMATS), counts, ["format"], list(cfg.FILE_KINDS))


def exports_by_delivery(events: DataFrame, w: ReportWindow) -> DataFrame:
    exports = between(events, w.start, w.end).filter((F.col("event") == "export") & F.col("detail").isNotNull())
    parts = F.split("detail", ":", 2)
    split = exports.select(parts[0].alias("document"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("delivery"))
    counts = crosstab(split, "document", "delivery", cfg.EXPORT_DELIVERIES)
    return fill(values(events.sparkSession, "document", cfg.EXPORT_DOCUMENTS), counts, ["document"], list(cfg.EXPORT_DELIVERIES))


def file_kpis(events: DataFrame, w: ReportWindow) -> DataFrame:
    def n(event: str) -> Column:
        return count_of(F.col("event") == event)

    facts = label_period(events, w).groupBy("period").agg(
        n("upload").alias("uploads"), n("export").alias("exports"), n("share_created").alias("shares_created"),
        n("share_opened").alias("share_opens"), n("upload_rejected").alias("rejected_uploads"),
        n("share_revoked").alias("revoked_shares"),
        sum_of(F.when(F.col("event") == "upload", F.col("size_bytes"))).alias("uploaded_bytes"),
    )
    frame = values(events.sparkSession, "period", ("current", "previous"))
    return fill(frame, facts, ["period"], [c for c in facts.columns if c != "period"])


def share_state(shares: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """Links with their file's kind and state: revoked, else expired (link or file), else active."""
    owner = files.select("file_id", "kind", "filename", F.col("expires_at").alias("file_expires_at"))
    joined = shares.join(owner, "file_id", "left")
    expired = (F.col("expires_at") <= moment(shares, "expires_at", now)) | F.coalesce(
        F.col("file_expires_at") <= moment(files, "expires_at", now), F.lit(False)
    )
    return joined.withColumn(
        "state", F.when(F.col("revoked_at").isNotNull(), "revocado").when(expired, "vencido").otherwise("activo")
    )


def shares_by_kind(shares: DataFrame, files: DataFrame, w: ReportWindow, now: datetime) -> DataFrame:
    """Links created in the window: kind by state, plus links opened and times opened."""
    states = share_state(between(shares, w.start, w.end), files, now)
    counts = states.groupBy("kind").agg(
        *[count_of(F.col("state") == s).alias(s) for s in cfg.SHARE_STATES],
        count_of(F.col("access_count") > 0).alias("opened"), sum_of(F.col("access_count")).alias("opens"),
    )
    return fill(values(shares.sparkSession, "kind", cfg.FILE_KINDS), counts, ["kind"], [*cfg.SHARE_STATES, "opened", "opens"])


def recent_shares(shares: DataFrame, files: DataFrame, w: ReportWindow, now: datetime, n: int = cfg.RECENT_ROWS) -> DataFrame:
    """Latest links of the window; only the extension of the file is shown. The top-k runs before the join."""
    latest = between(shares, w.start, w.end).orderBy(F.desc("created_at"), F.desc("share_id")).limit(n)
    return share_state(latest, files, now).select(
        "created_at", file_format(F.col("filename")).alias("format"), "kind", "state", "access_count"
    )
