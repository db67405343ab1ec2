"""Retention, links, quotas and rate limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lumbrera.bindings import entity
from lumbrera.operators import lifecycle
from lumbrera.queries.metrics import iso, iso_sql, ts
from lumbrera.queries.oracle_views import quoted
from lumbrera.queries.registry import query

NOW = datetime(1998, 1, 31)
PER_MINUTE, PER_DAY = 5, 50


def files(spark, sf):
    return entity(spark, sf, "files")


def shares(spark, sf):
    return entity(spark, sf, "file_shares")


@query("l01_unexpired", f"SELECT file_id, user_id FROM files WHERE expires_at > {ts(NOW)}")
def unexpired(spark, sf):
    return lifecycle.unexpired(files(spark, sf), NOW).select("file_id", "user_id")


@query("l01_unexpired_of_owner", f"SELECT file_id FROM files WHERE expires_at > {ts(NOW)} AND user_id = 7")
def unexpired_of_owner(spark, sf):
    return lifecycle.unexpired(files(spark, sf), NOW, owner=7).select("file_id")


@query("l02_purge_expired", f"SELECT CASE WHEN expires_at < {ts(NOW)} THEN 'removed' ELSE 'kept' END AS part, count(*) AS n, CAST(sum(file_id) AS BIGINT) AS ids FROM files GROUP BY 1")
def purge_expired(spark, sf):
    kept, removed = lifecycle.purge_expired(files(spark, sf), NOW)
    parts = kept.withColumn("part", F.lit("kept")).unionByName(removed.withColumn("part", F.lit("removed")))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("file_id").alias("ids"))


_PLAN = f"""(SELECT file_id, status, expires_at, CASE WHEN expires_at <= {ts(NOW)} THEN 'expired' ELSE 'abandoned' END AS reason
  FROM files WHERE expires_at <= {ts(NOW)} OR (status = 'pending' AND created_at < {ts(NOW)} - INTERVAL 900 SECOND))"""


@query("l03_cleanup_plan", f"SELECT file_id, status, reason, {iso_sql('expires_at')} AS expires_at FROM {_PLAN}")
def cleanup_plan(spark, sf):
    return lifecycle.cleanup_plan(files(spark, sf), NOW).withColumn("expires_at", iso(F.col("expires_at")))


@query("l04_cascade_delete", f"""
SELECT 'files' AS part, count(*) AS n FROM files WHERE file_id NOT IN (SELECT file_id FROM {_PLAN})
UNION ALL SELECT 'links', count(*) FROM file_shares WHERE file_id NOT IN (SELECT file_id FROM {_PLAN})""")
def cascade_delete(spark, sf):
    plan = lifecycle.cleanup_plan(files(spark, sf), NOW)
    parents, children = lifecycle.cascade_delete(files(spark, sf), shares(spark, sf), plan, "file_id")
    return parents.select(F.lit("files").alias("part")).unionByName(children.select(F.lit("links").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query("l05_effective_expiry", f"""
SELECT f.file_id, {iso_sql("CASE WHEN f.kind = 'export' THEN least(f.created_at + INTERVAL 24 HOUR, coalesce(d.at_end, f.created_at + INTERVAL 24 HOUR)) ELSE f.created_at + INTERVAL 24 HOUR END")} AS effective_expires_at
FROM files f LEFT JOIN (SELECT o_orderkey AS file_id, o_orderdate + INTERVAL 1 HOUR * (o_custkey % 40) AS at_end FROM orders WHERE o_orderkey % 4 <> 3) d USING (file_id)""")
def effective_expiry(spark, sf):
    from lumbrera.bindings import table

    diagnoses = table(spark, sf, "orders").filter("o_orderkey % 4 <> 3").selectExpr(
        "o_orderkey as file_id", "o_orderdate + INTERVAL '1' HOUR * (o_custkey % 40) as diagnosis_expires_at")
    found = lifecycle.effective_expiry(files(spark, sf), diagnoses, hours=24, max_hours=168)
    return found.select("file_id", iso(F.col("effective_expires_at")).alias("effective_expires_at"))


_ACTIVE = f"(SELECT * FROM file_shares WHERE revoked_at IS NULL AND expires_at > {ts(NOW)})"


@query("l06_resolve_links", f"""
SELECT s.file_id, f.kind, f.filename, count(*) AS links FROM {_ACTIVE} s JOIN files f USING (file_id)
WHERE f.status = 'uploaded' AND f.expires_at > {ts(NOW)} GROUP BY 1, 2, 3""")
def resolve_links(spark, sf):
    found = lifecycle.resolve_links(shares(spark, sf), files(spark, sf), NOW)
    return found.groupBy("file_id", "kind", "filename").agg(F.count("*").alias("links"))


@query("l07_active_links", f"SELECT file_id, access_count, {iso_sql('created_at')} AS created_at FROM {_ACTIVE}")
def active_links(spark, sf):
    return lifecycle.active_links(shares(spark, sf), NOW).select("file_id", "access_count", iso(F.col("created_at")).alias("created_at"))


@query("l08_link_access_totals", f"""
SELECT user_id, count(*) AS access_count, {iso_sql('max(created_at)')} AS last_access_at FROM file_events WHERE event = 'share_opened' GROUP BY 1""")
def link_access_totals(spark, sf):
    opens = entity(spark, sf, "file_events").filter("event = 'share_opened'")
    return lifecycle.link_access_totals(opens, "user_id").withColumn("last_access_at", iso(F.col("last_access_at")))


@query("l09_trailing_counts", """
SELECT connection_id, event_id,
  count(*) OVER (PARTITION BY connection_id ORDER BY epoch_us(created_at) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS last_minute,
  count(*) OVER (PARTITION BY connection_id ORDER BY epoch_us(created_at) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS last_day
FROM ai_usage_events""")
def trailing_counts(spark, sf):
    return lifecycle.trailing_counts(entity(spark, sf, "ai_usage_events"), "connection_id").select("connection_id", "event_id", "last_minute", "last_day")


@query("l10_replay_limiter")
def replay_limiter(spark, sf):
    return lifecycle.replay_limiter(entity(spark, sf, "ai_usage_events"), "connection_id", PER_MINUTE, PER_DAY)


def _quota(span: str) -> str:
    return f"SELECT connection_id, '{span}' AS span, {iso_sql(f'''date_trunc('{span}', created_at)''')} AS since, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM ai_usage_events GROUP BY 1, 2, 3"


@query("l11_quota_counters", _quota("minute") + " UNION ALL " + _quota("day"))
def quota_counters(spark, sf):
    return lifecycle.quota_counters(entity(spark, sf, "ai_usage_events")).withColumn("since", iso(F.col("since")))


_USABLE = """(SELECT * FROM connections WHERE enabled AND request_count < rpd_threshold AND NOT coalesce(total_token_count >= tpd_threshold, false))"""


@query("l12_pick_connection", f"SELECT id, label, priority FROM {_USABLE} WHERE supports_vision ORDER BY priority, id LIMIT 1")
def pick_connection(spark, sf):
    return lifecycle.pick_connection(entity(spark, sf, "connections"), require_vision=True)


def _checks(spark, sf):
    return entity(spark, sf, "service_checks").withColumnRenamed("at_time", "at")


_SINCE = """(SELECT service, state, min(at_time) AS since FROM (
  SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY at_time, check_id ROWS UNBOUNDED PRECEDING) AS island,
    sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY service) AS final FROM (
    SELECT *, state IS DISTINCT FROM lag(state) OVER (PARTITION BY service ORDER BY at_time, check_id) AS changed FROM service_checks))
  WHERE island = final GROUP BY 1, 2)"""


@query("l13_service_status", f"SELECT service, state, {iso_sql('since')} AS since FROM {_SINCE}")
def service_status(spark, sf):
    return lifecycle.service_status(_checks(spark, sf)).withColumn("since", iso(F.col("since")))


@query("l13_service_rollup", f"""
SELECT state, coalesce(services, 0) AS services, (SELECT coalesce(arg_max(state, list_position([{quoted(lifecycle.SERVICE_STATES)}], state)), 'unconfigured') FROM {_SINCE} WHERE state <> 'unconfigured') AS overall
FROM (SELECT unnest([{quoted(lifecycle.SERVICE_STATES)}]) AS state) LEFT JOIN (SELECT state, count(*) AS services FROM {_SINCE} GROUP BY 1) USING (state)""")
def service_rollup(spark, sf):
    return lifecycle.service_rollup(_checks(spark, sf))
