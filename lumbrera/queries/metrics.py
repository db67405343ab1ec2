"""Usage, product, file and user metrics on the event tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.bindings import entity
from lumbrera.operators import decisions, usage, users, windows
from lumbrera.operators.windows import ReportWindow
from lumbrera.queries.oracle_views import quoted
from lumbrera.queries.registry import query

NOW = datetime(2024, 1, 30, 21, 30)
WEEK = ReportWindow("7d", NOW, 180)
DAY = ReportWindow("24h", NOW)
MONTH = ReportWindow("30d", NOW)
FILES_NOW = datetime(1998, 1, 31)
FILES_MONTH = ReportWindow("30d", datetime(1998, 1, 30, 12))


def iso(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ts(at: datetime) -> str:
    return f"TIMESTAMP '{at.isoformat(sep=' ')}'"


def iso_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"


def inside(w: ReportWindow, column: str = "created_at") -> str:
    return f"{column} >= {ts(w.start)} AND {column} < {ts(w.end)}"


def bucket_sql(w: ReportWindow) -> str:
    step = int(w.step.total_seconds() * 1_000_000)
    return f"CAST((epoch_us(created_at) - epoch_us({ts(w.start)})) // {step} AS INT)"


def spine_sql(w: ReportWindow) -> str:
    """Buckets as a subquery."""
    return (f"(SELECT CAST(i AS INT) AS bucket, {iso_sql(f'{ts(w.start)} + INTERVAL 1 {w.unit.upper()} * i')} AS bucket_start "
            f"FROM range({w.count}) r(i))")


def enum_sql(column: str, items) -> str:
    return f"(SELECT unnest([{quoted(items)}]) AS {column})"


def period_sql(w: ReportWindow) -> str:
    return f"CASE WHEN created_at >= {ts(w.start)} THEN 'current' ELSE 'previous' END"


def both_sql(w: ReportWindow) -> str:
    return f"created_at >= {ts(w.previous_start)} AND created_at < {ts(w.end)}"


def counts_sql(column: str, items, cond: str = "true") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{i}' AND {cond}) AS {i}" for i in items)


def zero(cols, extra: str = "") -> str:
    return ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in cols)


def series_sql(w: ReportWindow, source: str, aggs: str, cols) -> str:
    return (f"SELECT s.bucket, s.bucket_start, {zero(cols)} FROM {spine_sql(w)} s LEFT JOIN ("
            f"SELECT {bucket_sql(w)} AS bucket, {aggs} FROM {source} WHERE {inside(w)} GROUP BY 1) f ON f.bucket = s.bucket")


def usage_events(spark, sf):
    return entity(spark, sf, "ai_usage_events")


def activity(spark, sf):
    return entity(spark, sf, "user_activity")


def shown(df):
    return df.withColumn("bucket_start", iso(F.col("bucket_start")))


@query("m01_bucket_spine", f"""
SELECT CAST(i AS INT) AS bucket, {iso_sql("date_trunc('day', e - INTERVAL 180 MINUTE) + INTERVAL 180 MINUTE - INTERVAL 1 DAY * (6 - i)")} AS bucket_start
FROM (SELECT max(created_at) AS e FROM ai_usage_events), range(7) r(i)""")
def bucket_spine(spark, sf):
    ends = usage_events(spark, sf).agg(F.max("created_at").alias("end"))
    return shown(windows.bucket_spine(ends, "7d", 180))


@query("m02_assign_bucket", f"SELECT event_id, {bucket_sql(WEEK)} AS bucket FROM ai_usage_events WHERE {inside(WEEK)}")
def assign_bucket(spark, sf):
    return windows.assign_bucket(usage_events(spark, sf), WEEK).select("event_id", "bucket")


@query("m03_usage_series", series_sql(
    WEEK, "ai_usage_events", "count(*) AS calls, sum(total_tokens) AS tokens, count(*) FILTER (WHERE outcome <> 'ok') AS errors", ("calls", "tokens", "errors")))
def usage_series(spark, sf):
    return shown(usage.usage_series(usage_events(spark, sf), WEEK))


@query("m04_outcome_series", series_sql(DAY, "ai_usage_events", counts_sql("outcome", cfg.USAGE_OUTCOMES), cfg.USAGE_OUTCOMES))
def outcome_series(spark, sf):
    return shown(usage.outcome_series(usage_events(spark, sf), DAY))


@query("m05_tokens_by_provider", f"""
SELECT x.series, s.bucket, s.bucket_start, CAST(coalesce(t.tokens, 0) AS BIGINT) AS tokens
FROM (SELECT DISTINCT series FROM tagged_tokens) x CROSS JOIN {spine_sql(WEEK)} s
LEFT JOIN (SELECT series, bucket, sum(tokens) AS tokens FROM tagged_tokens GROUP BY 1, 2) t ON t.series = x.series AND t.bucket = s.bucket""".replace(
    "tagged_tokens", f"""(SELECT CASE WHEN rk <= 3 THEN provider ELSE 'otros' END AS series, bucket, tokens FROM (
      SELECT provider, {bucket_sql(WEEK)} AS bucket, sum(total_tokens) AS tokens FROM ai_usage_events WHERE {inside(WEEK)} GROUP BY 1, 2) JOIN (
      SELECT provider, row_number() OVER (ORDER BY sum(total_tokens) DESC, provider) AS rk FROM ai_usage_events WHERE {inside(WEEK)} GROUP BY provider) USING (provider))"""))
def tokens_by_provider(spark, sf):
    return shown(usage.tokens_by_provider(usage_events(spark, sf), WEEK))


@query("m06_tts_series", f"""
SELECT coalesce(bucket, -1) AS bucket, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(characters) AS BIGINT) AS characters,
  round_even(sum(seconds) / 60, 1) AS minutes, CAST(sum(errors) AS BIGINT) AS errors FROM (
  SELECT s.bucket, coalesce(calls, 0) AS calls, coalesce(characters, 0) AS characters, coalesce(seconds, 0) AS seconds, coalesce(errors, 0) AS errors
  FROM {spine_sql(WEEK)} s LEFT JOIN (
    SELECT {bucket_sql(WEEK)} AS bucket, count(*) AS calls, sum(characters) AS characters, sum(audio_seconds) AS seconds, count(*) FILTER (WHERE outcome <> 'ok') AS errors
    FROM ai_usage_events WHERE kind = 'tts' AND {inside(WEEK)} GROUP BY 1) f ON f.bucket = s.bucket) GROUP BY ROLLUP (bucket)""")
def tts_series(spark, sf):
    return usage.tts_series(usage_events(spark, sf), WEEK)


@query("m07_kpis", f"""
SELECT p.period, coalesce(calls, 0) AS calls, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, latency_p95, error_rate FROM {enum_sql('period', ('current', 'previous'))} p LEFT JOIN (
  SELECT {period_sql(WEEK)} AS period, count(*) AS calls, sum(total_tokens) AS tokens, quantile_disc(latency_ms, 0.95) FILTER (WHERE outcome = 'ok') AS latency_p95,
    round_even(count(*) FILTER (WHERE outcome <> 'ok') / count(*) * 100, 1) AS error_rate
  FROM ai_usage_events WHERE {both_sql(WEEK)} GROUP BY 1) f USING (period)""")
def kpis(spark, sf):
    return usage.kpis(usage_events(spark, sf), WEEK)


@query("m08_nearest_rank", "SELECT kind, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM ai_usage_events GROUP BY kind")
def nearest_rank(spark, sf):
    from lumbrera.operators.ordered import nearest_rank as ranks

    return ranks(usage_events(spark, sf), ["kind"], "latency_ms", {"p50": 50, "p95": 95})


@query("m09_latency_by_model", f"""
SELECT provider, model, count(*) AS calls, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95
FROM ai_usage_events WHERE outcome = 'ok' AND {inside(WEEK)} GROUP BY 1, 2""")
def latency_by_model(spark, sf):
    return usage.latency_by_model(usage_events(spark, sf), WEEK)


_STATUS = """
SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN request_count >= rpd_threshold OR coalesce(total_token_count >= tpd_threshold, false) THEN 'exhausted'
  WHEN ratio >= 0.8 THEN 'near-limit' WHEN is_current THEN 'active' ELSE 'standby' END AS status, round_even(ratio * 100, 1) AS usage_pct
FROM (SELECT *, greatest(request_count / rpd_threshold, total_token_count / tpd_threshold) AS ratio FROM connections)"""


@query("m10_connection_metrics", f"""
SELECT id, status, usage_pct, coalesce(calls, 0) AS calls, coalesce(errors, 0) AS errors, CAST(coalesce(tokens_today, 0) AS BIGINT) AS tokens_today, p50, p95
FROM ({_STATUS}) c LEFT JOIN (SELECT connection_id, count(*) AS calls, count(*) FILTER (WHERE outcome <> 'ok') AS errors,
  sum(total_tokens) FILTER (WHERE created_at >= {ts(WEEK.end - WEEK.step)}) AS tokens_today,
  quantile_disc(latency_ms, 0.5) FILTER (WHERE outcome = 'ok') AS p50, quantile_disc(latency_ms, 0.95) FILTER (WHERE outcome = 'ok') AS p95
  FROM ai_usage_events WHERE {inside(WEEK)} GROUP BY 1) f ON f.connection_id = c.id""")
def connection_metrics(spark, sf):
    return usage.connection_metrics(entity(spark, sf, "connections"), usage_events(spark, sf), WEEK).select(
        "id", "status", "usage_pct", "calls", "errors", "tokens_today", "p50", "p95")


@query("m11_connection_status", f"SELECT id, status, usage_pct FROM ({_STATUS})")
def connection_status(spark, sf):
    return usage.connection_status(entity(spark, sf, "connections")).select("id", "status", "usage_pct")


@query("m12_alerts", f"SELECT label, status, usage_pct FROM ({_STATUS}) WHERE status IN ('near-limit', 'exhausted')")
def alerts(spark, sf):
    return usage.alerts(entity(spark, sf, "connections"))


_PARSED = """(SELECT id, source_type, created_at, CAST(json_extract(diagnostic_json, '$.estimated_score') AS INT) AS score,
  json_extract(diagnostic_json, '$.barriers') AS barriers FROM analyses WHERE json_valid(diagnostic_json))"""


@query("m13_score_histogram", f"""
SELECT CAST(i AS INT) AS bin, coalesce(documents, 0) AS documents, average FROM range(10) r(i)
LEFT JOIN (SELECT least(score // 10, 9) AS bin, count(*) AS documents FROM {_PARSED} GROUP BY 1) b ON b.bin = i
CROSS JOIN (SELECT CAST(round_even(avg(score), 0) AS INT) AS average FROM {_PARSED})""")
def score_histogram(spark, sf):
    return usage.score_histogram(usage.parse_diagnostics(entity(spark, sf, "analyses")))


@query("m14_materials_by_source", f"""
SELECT source_type, coalesce(documents, 0) AS documents FROM {enum_sql('source_type', cfg.SOURCE_TYPES)} LEFT JOIN (
  SELECT source_type, count(*) AS documents FROM materials GROUP BY 1) USING (source_type)""")
def materials_by_source(spark, sf):
    return usage.materials_by_source(entity(spark, sf, "materials"))


@query("m15_barrier_matrix", f"""
SELECT category, {zero(cfg.SEVERITIES)} FROM {enum_sql('category', cfg.CATEGORIES)} LEFT JOIN (
  SELECT category, {counts_sql('severity', cfg.SEVERITIES)} FROM (
    SELECT json_extract_string(b, '$.category') AS category, json_extract_string(b, '$.severity') AS severity FROM (
      SELECT unnest(CAST(barriers AS JSON[])) AS b FROM {_PARSED})) GROUP BY 1) USING (category)""")
def barrier_matrix(spark, sf):
    return usage.barrier_matrix(usage.parse_diagnostics(entity(spark, sf, "analyses")))


_CURRENT = "(SELECT doc_id, proposal_id, barrier_id, arg_max(adaptation_type, seq) AS adaptation_type, arg_max(to_status, seq) AS status FROM decision_log GROUP BY 1, 2, 3)"


@query("m16_decision_matrix", f"""
SELECT *, (SELECT CAST(round_even(count(*) FILTER (WHERE status IN ('aceptada', 'editada')) / count(*) FILTER (WHERE status <> 'pendiente') * 100, 0) AS INT) FROM {_CURRENT}) AS acceptance_rate
FROM (SELECT adaptation_type, {zero(cfg.PROPOSAL_STATUSES)} FROM {enum_sql('adaptation_type', cfg.ADAPTATION_TYPES)} LEFT JOIN (
  SELECT adaptation_type, {counts_sql('status', cfg.PROPOSAL_STATUSES)} FROM {_CURRENT} GROUP BY 1) USING (adaptation_type))""")
def decision_matrix(spark, sf):
    return usage.decision_matrix(decisions.current_status(entity(spark, sf, "decision_log")))


@query("m17_transformation_matrix", f"""
SELECT format, {zero(cfg.TRANSFORMATION_STATES)} FROM {enum_sql('format', cfg.TRANSFORMATION_FORMATS)} LEFT JOIN (
  SELECT format, {counts_sql('state', cfg.TRANSFORMATION_STATES)} FROM (
    SELECT format, CASE WHEN status = 'failed' THEN 'fallida' ELSE review_status END AS state FROM transformations WHERE expires_at > {ts(NOW)}) GROUP BY 1) USING (format)""")
def transformation_matrix(spark, sf):
    return usage.transformation_matrix(entity(spark, sf, "transformations"), NOW)


@query("m18_recent", f"""
SELECT id, source_type, score, CAST(json_array_length(barriers) AS INT) AS barriers, {iso_sql('created_at')} AS created_at FROM {_PARSED} ORDER BY created_at DESC, id DESC LIMIT 15""")
def recent(spark, sf):
    rows = usage.recent(usage.parse_diagnostics(entity(spark, sf, "analyses")), cfg.RECENT_ROWS, "id")
    return rows.select("id", "source_type", "score", F.size("barriers").alias("barriers"), iso(F.col("created_at")).alias("created_at"))


@query("m19_file_activity_series", series_sql(
    WEEK, "file_events", counts_sql("event", cfg.FILE_ACTIVITY) + ", sum(size_bytes) FILTER (WHERE event = 'upload') AS uploaded_bytes", (*cfg.FILE_ACTIVITY, "uploaded_bytes")))
def file_activity_series(spark, sf):
    return shown(usage.file_activity_series(entity(spark, sf, "file_events"), WEEK))


@query("m20_files_by_format", f"""
SELECT format, {zero(cfg.FILE_KINDS)} FROM {enum_sql('format', cfg.FILE_FORMATS)} LEFT JOIN (
  SELECT format, {counts_sql('event', cfg.FILE_KINDS)} FROM file_events WHERE {inside(WEEK)} GROUP BY 1) USING (format)""")
def files_by_format(spark, sf):
    return usage.files_by_format(entity(spark, sf, "file_events"), WEEK)


@query("m21_exports_by_delivery", f"""
SELECT document, {zero(cfg.EXPORT_DELIVERIES)} FROM {enum_sql('document', cfg.EXPORT_DOCUMENTS)} LEFT JOIN (
  SELECT split_part(detail, ':', 1) AS document, {counts_sql("split_part(detail, ':', 2)", cfg.EXPORT_DELIVERIES)}
  FROM file_events WHERE event = 'export' AND {inside(WEEK)} GROUP BY 1) USING (document)""")
def exports_by_delivery(spark, sf):
    return usage.exports_by_delivery(entity(spark, sf, "file_events"), WEEK)


_FILE_KPIS = {"uploads": "upload", "exports": "export", "shares_created": "share_created", "share_opens": "share_opened",
              "rejected_uploads": "upload_rejected", "revoked_shares": "share_revoked"}


@query("m22_file_kpis", f"""
SELECT period, {zero([*_FILE_KPIS, 'uploaded_bytes'])} FROM {enum_sql('period', ('current', 'previous'))} LEFT JOIN (
  SELECT {period_sql(WEEK)} AS period, {', '.join(f"count(*) FILTER (WHERE event = '{e}') AS {n}" for n, e in _FILE_KPIS.items())},
    sum(size_bytes) FILTER (WHERE event = 'upload') AS uploaded_bytes FROM file_events WHERE {both_sql(WEEK)} GROUP BY 1) USING (period)""")
def file_kpis(spark, sf):
    return usage.file_kpis(entity(spark, sf, "file_events"), WEEK)


_SHARES = f"""(SELECT s.*, f.kind, f.filename, CASE WHEN revoked_at IS NOT NULL THEN 'revocado'
  WHEN s.expires_at <= {ts(FILES_NOW)} OR coalesce(f.expires_at <= {ts(FILES_NOW)}, false) THEN 'vencido' ELSE 'activo' END AS state
  FROM file_shares s LEFT JOIN files f USING (file_id))"""


@query("m23_share_state", f"SELECT state, kind, count(*) AS n, CAST(sum(access_count) AS BIGINT) AS opens FROM {_SHARES} GROUP BY 1, 2")
def share_state(spark, sf):
    states = usage.share_state(entity(spark, sf, "file_shares"), entity(spark, sf, "files"), FILES_NOW)
    return states.groupBy("state", "kind").agg(F.count("*").alias("n"), F.sum("access_count").alias("opens"))


@query("m24_shares_by_kind", f"""
SELECT kind, {zero([*cfg.SHARE_STATES, 'opened', 'opens'])} FROM {enum_sql('kind', cfg.FILE_KINDS)} LEFT JOIN (
  SELECT kind, {counts_sql('state', cfg.SHARE_STATES)}, count(*) FILTER (WHERE access_count > 0) AS opened, sum(access_count) AS opens
  FROM {_SHARES} WHERE {inside(FILES_MONTH)} GROUP BY 1) USING (kind)""")
def shares_by_kind(spark, sf):
    return usage.shares_by_kind(entity(spark, sf, "file_shares"), entity(spark, sf, "files"), FILES_MONTH, FILES_NOW)


@query("m24_recent_shares", f"""
SELECT {iso_sql('created_at')} AS created_at, CASE WHEN contains(filename, '.') THEN lower(split_part(filename, '.', -1)) END AS format, kind, state, access_count FROM (
  SELECT * FROM {_SHARES} WHERE {inside(FILES_MONTH)} ORDER BY created_at DESC, share_id DESC LIMIT 15)""")
def recent_shares(spark, sf):
    rows = usage.recent_shares(entity(spark, sf, "file_shares"), entity(spark, sf, "files"), FILES_MONTH, FILES_NOW)
    return rows.withColumn("created_at", iso(F.col("created_at")))


# --- users -------------------------------------------------------------------------------------------

_SOURCE = "CASE WHEN user_id = 'anon' THEN 'anon' WHEN starts_with(user_id, 'test-web_') THEN 'test_web' ELSE 'frontend' END"
_NAME = "CASE WHEN user_id = 'anon' THEN 'Usuario anónimo' WHEN starts_with(user_id, 'test-web_') THEN regexp_replace(user_id[10:], '^[^_]*_', '') END"
_PRODUCT = f"action IN ({quoted(cfg.PRODUCT_ACTIONS)})"


@query("u01_identity", f"""
SELECT user_id, {_SOURCE} AS source, {_NAME} AS name, CASE WHEN starts_with(user_id, 'test-web_') THEN split_part(user_id[10:], '_', 1) END AS login FROM api_users""")
def identity(spark, sf):
    return users.identity(entity(spark, sf, "api_users")).select("user_id", "source", "name", "login")


@query("u02_totals_by_user", f"""
SELECT user_id, action, detail, count(*) AS n, count(*) FILTER (WHERE mock) AS mock, CAST(sum(tokens) AS BIGINT) AS tokens,
  {iso_sql('min(created_at)')} AS first_at, {iso_sql('max(created_at)')} AS last_at FROM user_activity GROUP BY 1, 2, 3""")
def totals_by_user(spark, sf):
    return users.totals_by_user(activity(spark, sf)).withColumns({"first_at": iso(F.col("first_at")), "last_at": iso(F.col("last_at"))})


def _stats_sql(prefix: str = "") -> str:
    def n(name, cond):
        return f"count(*) FILTER (WHERE {cond}) AS {prefix}{name}"

    counted = {"analyses": "analysis", "proposals": "proposal", "uploads": "upload", "uploads_rejected": "upload_rejected", "exports": "export",
               "downloads": "download", "shares_created": "share_created", "share_opens": "share_opened", "shares_revoked": "share_revoked",
               "ai_calls": "ai_call", "rate_limited": "rate_limited", "transformations": "transformation"}
    parts = [n("actions", _PRODUCT)] + [n(k, f"action = '{v}'") for k, v in counted.items()]
    parts += [n(f"mock_{k}", f"action = '{counted[k]}' AND mock") for k in ("analyses", "proposals", "transformations")]
    parts += [n(f"decision_{d}", f"action = 'decision' AND detail = '{d}'") for d in ("aceptada", "editada", "descartada", "deshacer")]
    parts += [n(f"review_{d}", f"action = 'transformation_decision' AND detail = '{d}'") for d in ("aceptada", "editada", "descartada")]
    parts += [n("transformations_failed", "action = 'transformation' AND detail = 'failed'"), n("ai_errors", "action = 'ai_call' AND coalesce(detail <> 'ok', true)")]
    parts += [f"CAST(coalesce(sum(tokens) FILTER (WHERE action = 'ai_call'), 0) AS BIGINT) AS {prefix}tokens"]
    return ", ".join(parts)


@query("u03_user_stats", f"SELECT user_id, {_stats_sql()} FROM user_activity WHERE {inside(WEEK)} GROUP BY user_id")
def user_stats(spark, sf):
    return users.user_stats(windows.between(activity(spark, sf), WEEK.start, WEEK.end))


@query("u04_all_time_stats", f"""
SELECT user_id, {_stats_sql()}, {iso_sql('min(created_at)')} AS first_at, {iso_sql('max(created_at)')} AS last_at FROM user_activity GROUP BY user_id""")
def all_time_stats(spark, sf):
    stats = users.all_time_stats(users.totals_by_user(activity(spark, sf)))
    return stats.withColumns({"first_at": iso(F.col("first_at")), "last_at": iso(F.col("last_at"))})


_DIRECTORY = f"""(SELECT user_id, {_SOURCE} AS source, {_NAME} AS name, p.role, coalesce(p.first_seen_at, a.first_at) AS first_seen_at,
  coalesce(p.last_seen_at, a.last_at) AS last_seen_at, a.actions, a.tokens, coalesce(r.range_actions, 0) AS range_actions,
  coalesce(r.range_tokens, 0) AS range_tokens, coalesce(r.range_ai_calls, 0) AS range_ai_calls, coalesce(r.range_rate_limited, 0) AS range_rate_limited
FROM api_users p
FULL JOIN (SELECT user_id, {_stats_sql()}, min(created_at) AS first_at, max(created_at) AS last_at FROM user_activity GROUP BY user_id) a USING (user_id)
LEFT JOIN (SELECT user_id, {_stats_sql('range_')} FROM user_activity WHERE {inside(WEEK)} GROUP BY user_id) r USING (user_id))"""
_DIR_COLS = ("user_id", "source", "name", "role", "actions", "tokens", "range_actions", "range_tokens")


@query("u05_user_directory", f"""
SELECT {', '.join(_DIR_COLS)}, {iso_sql('first_seen_at')} AS first_seen_at, {iso_sql('last_seen_at')} AS last_seen_at FROM {_DIRECTORY}""")
def user_directory(spark, sf):
    found = users.user_directory(entity(spark, sf, "api_users"), activity(spark, sf), WEEK)
    return found.select(*_DIR_COLS, iso(F.col("first_seen_at")).alias("first_seen_at"), iso(F.col("last_seen_at")).alias("last_seen_at"))


@query("u06_active_users_series", series_sql(
    WEEK, "user_activity", "count(DISTINCT user_id) FILTER (WHERE action <> 'share_opened') AS active_users", ("active_users",)))
def active_users_series(spark, sf):
    return shown(users.active_users_series(activity(spark, sf), WEEK))


@query("u07_actions_by_source_series", series_sql(
    WEEK, "user_activity", counts_sql(_SOURCE, cfg.USER_SOURCES, _PRODUCT) + ", sum(tokens) AS tokens", (*cfg.USER_SOURCES, "tokens")))
def actions_by_source_series(spark, sf):
    return shown(users.actions_by_source_series(activity(spark, sf), WEEK))


@query("u08_user_kpis", f"""
SELECT period, {zero(('active_users', 'new_users', 'actions', 'tokens', 'rate_limited'))}, (SELECT count(DISTINCT user_id) FROM user_activity) AS total_users
FROM {enum_sql('period', ('current', 'previous'))} LEFT JOIN (
  SELECT {period_sql(WEEK)} AS period, count(DISTINCT user_id) FILTER (WHERE action <> 'share_opened') AS active_users,
    count(*) FILTER (WHERE {_PRODUCT}) AS actions, sum(tokens) AS tokens, count(*) FILTER (WHERE action = 'rate_limited') AS rate_limited
  FROM user_activity WHERE {both_sql(WEEK)} GROUP BY 1) USING (period) LEFT JOIN (
  SELECT {period_sql(WEEK)} AS period, count(*) AS new_users FROM (SELECT user_id, min(created_at) AS created_at FROM user_activity GROUP BY 1) WHERE {both_sql(WEEK)} GROUP BY 1) USING (period)""")
def user_kpis(spark, sf):
    return users.user_kpis(activity(spark, sf), entity(spark, sf, "api_users"), WEEK)


@query("u09_usage_by_source", f"""
SELECT source, {zero(('users', 'actions'))} FROM {enum_sql('source', cfg.USER_SOURCES)} LEFT JOIN (
  SELECT {_SOURCE} AS source, count(DISTINCT user_id) FILTER (WHERE action <> 'share_opened') AS users, count(*) FILTER (WHERE {_PRODUCT}) AS actions
  FROM user_activity WHERE {inside(WEEK)} GROUP BY 1) USING (source)""")
def usage_by_source(spark, sf):
    return users.usage_by_source(activity(spark, sf), WEEK)


@query("u10_rankings", f"""
SELECT user_id, {_NAME} AS name, {_SOURCE} AS source, tokens AS value FROM (
  SELECT user_id, CAST(sum(tokens) FILTER (WHERE action = 'ai_call') AS BIGINT) AS tokens FROM user_activity WHERE {inside(WEEK)} GROUP BY 1)
WHERE tokens > 0 ORDER BY tokens DESC, user_id LIMIT 10""")
def rankings(spark, sf):
    return users.rankings(users.user_stats(windows.between(activity(spark, sf), WEEK.start, WEEK.end)), "tokens")


_GROUPS = {g: [a for a, x in cfg.ACTIVITY_GROUPS.items() if x == g] for g in dict.fromkeys(cfg.ACTIVITY_GROUPS.values())}


@query("u11_user_activity_series", series_sql(
    MONTH, "(SELECT * FROM user_activity WHERE user_id = 'anon')",
    ", ".join(f"count(*) FILTER (WHERE action IN ({quoted(a)})) AS {g}" for g, a in _GROUPS.items()) + ", sum(tokens) AS tokens", (*_GROUPS, "tokens")))
def user_activity_series(spark, sf):
    return shown(users.user_activity_series(activity(spark, sf), "anon", MONTH))


@query("u12_user_formats", f"""
SELECT user_id, action, format, n, CAST(row_number() OVER (PARTITION BY user_id, action ORDER BY n DESC, format) AS INT) AS rank FROM (
  SELECT user_id, action, format, count(*) AS n FROM user_activity WHERE action IN ('analysis', 'upload', 'export') AND format IS NOT NULL AND {inside(WEEK)} GROUP BY 1, 2, 3)""")
def user_formats(spark, sf):
    return users.user_formats(activity(spark, sf), WEEK)


@query("u13_user_adaptations", f"""
SELECT user_id, adaptation_type, count(*) FILTER (WHERE action = 'proposal') AS propuestas, {counts_sql('detail', ('aceptada', 'editada', 'descartada', 'deshacer'), "action = 'decision'")}
FROM user_activity WHERE action IN ('proposal', 'decision') AND adaptation_type IS NOT NULL AND {inside(WEEK)} GROUP BY 1, 2""")
def user_adaptations(spark, sf):
    return users.user_adaptations(activity(spark, sf), WEEK)


@query("u13_user_transformations", f"""
SELECT user_id, format, count(*) FILTER (WHERE action = 'transformation') AS pedidas, count(*) FILTER (WHERE action = 'transformation' AND detail = 'failed') AS fallidas,
  {counts_sql('detail', ('aceptada', 'editada', 'descartada'), "action = 'transformation_decision'")}
FROM user_activity WHERE action IN ('transformation', 'transformation_decision') AND format IS NOT NULL AND {inside(WEEK)} GROUP BY 1, 2""")
def user_transformations(spark, sf):
    return users.user_transformations(activity(spark, sf), WEEK)


@query("u14_user_models", f"""
SELECT user_id, provider, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE coalesce(detail <> 'ok', true)) AS errors
FROM user_activity WHERE action = 'ai_call' AND {inside(WEEK)} GROUP BY 1, 2, 3""")
def user_models(spark, sf):
    return users.user_models(activity(spark, sf), WEEK)


@query("u15_user_recent", f"""
SELECT user_id, event_id, action, {iso_sql('created_at')} AS created_at, CAST(rk AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS rk FROM user_activity) WHERE rk <= 50""")
def user_recent(spark, sf):
    return users.user_recent(activity(spark, sf)).select("user_id", "event_id", "action", iso(F.col("created_at")).alias("created_at"), "rank")


_CALLS = "(SELECT user_id, CASE event_id % 2 WHEN 0 THEN 'docente' ELSE 'admin' END AS role, created_at AS seen_at FROM user_activity WHERE action = 'ai_call')"


@query("u16_touch_users", f"""
SELECT user_id, {_SOURCE} AS source, coalesce(c.role, p.role) AS role, {iso_sql('coalesce(p.first_seen_at, c.lo)')} AS first_seen_at,
  {iso_sql('greatest(p.last_seen_at, c.hi)')} AS last_seen_at
FROM api_users p FULL JOIN (
  SELECT user_id, min(seen_at) AS lo, max(seen_at) AS hi, arg_max(role, (seen_at, role)) AS role FROM {_CALLS} GROUP BY 1) c USING (user_id)""")
def touch_users(spark, sf):
    calls = activity(spark, sf).filter("action = 'ai_call'").select(
        "user_id", F.when(F.col("event_id") % 2 == 0, "docente").otherwise("admin").alias("role"), F.col("created_at").alias("at"))
    touched = users.touch_users(entity(spark, sf, "api_users"), calls)
    return touched.select("user_id", "source", "role", iso(F.col("first_seen_at")).alias("first_seen_at"), iso(F.col("last_seen_at")).alias("last_seen_at"))


@query("u17_stale_profiles", f"""
SELECT user_id FROM api_users WHERE source = 'frontend' AND (profile_fetched_at IS NULL OR profile_fetched_at < TIMESTAMP '2024-01-02 00:00:00') ORDER BY last_seen_at DESC, user_id LIMIT 25""")
def stale_profiles(spark, sf):
    return users.stale_profiles(entity(spark, sf, "api_users"), datetime(2024, 1, 2), 25)


@query("u18_search_users", f"""
SELECT {', '.join(_DIR_COLS)} FROM {_DIRECTORY} WHERE source = 'frontend' AND (range_actions > 0 OR range_ai_calls > 0 OR range_rate_limited > 0)
  AND (coalesce(contains(lower(name), '1'), false) OR contains(lower(user_id), '1'))""")
def search_users(spark, sf):
    found = users.user_directory(entity(spark, sf, "api_users"), activity(spark, sf), WEEK)
    return users.search_users(found, source="frontend", only_active=True, text="1").select(*_DIR_COLS)
