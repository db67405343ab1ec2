"""Per-user metrics over the activity log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.operators.ordered import top_per_key
from lumbrera.operators.usage import sum_of
from lumbrera.operators.windows import (
    ReportWindow, assign_bucket, between, crosstab, fill, label_period, moment, spine, values,
)


def source_of(user_id: Column) -> Column:
    return (
        F.when(user_id == cfg.ANONYMOUS, "anon").when(user_id.startswith(cfg.TEST_WEB_PREFIX), "test_web").otherwise("frontend")
    )


def identity(users: DataFrame) -> DataFrame:
    """Display name, source and login kind; test-web ids carry kind and user name in the id itself."""
    source = source_of(F.col("user_id"))
    rest = F.expr(f"substring(user_id, {len(cfg.TEST_WEB_PREFIX) + 1})")
    login = F.nullif(F.substring_index(rest, "_", 1), F.lit(""))
    name = F.when(F.contains(rest, F.lit("_")), F.nullif(F.regexp_replace(rest, "^[^_]*_", ""), F.lit("")))
    return users.withColumns({
        "source": source,
        "login": F.when(source == "test_web", login),
        "name": F.when(source == "test_web", F.coalesce(name, F.col("user_id"))).when(source == "anon", "Usuario anónimo"),
    })


def totals_by_user(activity: DataFrame) -> DataFrame:
    return activity.groupBy("user_id", "action", "detail").agg(
        F.count("*").alias("n"), F.count_if("mock").alias("mock"), sum_of(F.col("tokens")).alias("tokens"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


# Output name of each counted action (fixed values).
_COUNTED = {
    "analysis": "analyses", "proposal": "proposals", "upload": "uploads", "upload_rejected": "uploads_rejected",
    "export": "exports", "download": "downloads", "share_created": "shares_created", "share_opened": "share_opens",
    "share_revoked": "shares_revoked", "ai_call": "ai_calls", "rate_limited": "rate_limited",
    "transformation": "transformations",
}
_DECISIONS = ("aceptada", "editada", "descartada", "deshacer")
_REVIEWS = ("aceptada", "editada", "descartada")


def stat_columns(n: Column, mock: Column, tokens: Column) -> list[Column]:
    """The 26 statistics of one user as aggregates over rows, or over totals that stand for rows."""
    action, detail = F.col("action"), F.col("detail")
    failed = F.coalesce(detail != "ok", F.lit(True))

    def total(condition: Column, amount: Column = n) -> Column:
        return sum_of(F.when(condition, amount))

    return [
        total(action.isin(*cfg.PRODUCT_ACTIONS)).alias("actions"),
        *[total(action == a).alias(name) for a, name in _COUNTED.items()],
        *[total(action == a, mock).alias(f"mock_{name}") for a, name in _COUNTED.items() if a in ("analysis", "proposal", "transformation")],
        *[total((action == "decision") & (detail == d)).alias(f"decision_{d}") for d in _DECISIONS],
        *[total((action == "transformation_decision") & (detail == d)).alias(f"review_{d}") for d in _REVIEWS],
        total((action == "transformation") & (detail == "failed")).alias("transformations_failed"),
        total((action == "ai_call") & failed).alias("ai_errors"),
        total(action == "ai_call", tokens).alias("tokens"),
    ]


def user_stats(activity: DataFrame) -> DataFrame:
    """One row per user, from rows."""
    return activity.groupBy("user_id").agg(*stat_columns(F.lit(1), F.col("mock").cast("int"), F.col("tokens")))


def all_time_stats(totals: DataFrame) -> DataFrame:
    """One row per user, from the pre-aggregated totals."""
    return totals.groupBy("user_id").agg(
        *stat_columns(F.col("n"), F.col("mock"), F.col("tokens")),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )


STATS = (
    "actions", *_COUNTED.values(), "mock_analyses", "mock_proposals", "mock_transformations",
    *[f"decision_{d}" for d in _DECISIONS], *[f"review_{d}" for d in _REVIEWS], "transformations_failed", "ai_errors", "tokens",
)


def user_directory(profiles: DataFrame, activity: DataFrame, w: ReportWindow) -> DataFrame:
    """Everyone known from a profile or from activity, with window and all-time figures."""
    all_time = all_time_stats(totals_by_user(activity))
    in_range = user_stats(between(activity, w.start, w.end)).select("user_id", *[F.col(c).alias(f"range_{c}") for c in STATS])
    known = profiles.select("user_id", "role", "first_seen_at", "last_seen_at", "profile_fetched_at")
    joined = known.join(all_time, "user_id", "full_outer").join(in_range, "user_id", "left")
    named = identity(joined).withColumns({
        "first_seen_at": F.coalesce("first_seen_at", "first_at"), "last_seen_at": F.coalesce("last_seen_at", "last_at"),
    })
    return named.drop("first_at", "last_at").na.fill(0, [*STATS, *[f"range_{c}" for c in STATS]])


def is_actor() -> Column:
    """The row was made by the user; a link is opened by somebody else."""
    return F.col("action") != "share_opened"


def active_users_series(activity: DataFrame, w: ReportWindow) -> DataFrame:
    facts = assign_bucket(activity.filter(is_actor()), w).groupBy("bucket").agg(F.count_distinct("user_id").alias("active_users"))
    return fill(spine(activity.sparkSession, w), facts, ["bucket"], ["active_users"])


def actions_by_source_series(activity: DataFrame, w: ReportWindow) -> DataFrame:
    tagged = assign_bucket(activity, w).withColumn("source", source_of(F.col("user_id")))
    product = F.col("action").isin(*cfg.PRODUCT_ACTIONS)
    facts = tagged.groupBy("bucket").agg(
        *[F.count_if(product & (F.col("source") == s)).alias(s) for s in cfg.USER_SOURCES], sum_of(F.col("tokens")).alias("tokens")
    )
    return fill(spine(activity.sparkSession, w), facts, ["bucket"], [*cfg.USER_SOURCES, "tokens"])


def user_kpis(activity: DataFrame, profiles: DataFrame, w: ReportWindow) -> DataFrame:
    """Active and new users, actions, tokens and refusals, for the window and the one before."""
    spark = activity.sparkSession
    facts = label_period(activity, w).groupBy("period").agg(
        F.count_distinct(F.when(is_actor(), F.col("user_id"))).alias("active_users"),
        F.count_if(F.col("action").isin(*cfg.PRODUCT_ACTIONS)).alias("actions"),
        sum_of(F.col("tokens")).alias("tokens"), F.count_if(F.col("action") == "rate_limited").alias("rate_limited"),
    )
    seen = (
        activity.groupBy("user_id").agg(F.min("created_at").alias("first_at"))
        .join(profiles.select("user_id", "first_seen_at"), "user_id", "full_outer")
        .select("user_id", F.coalesce("first_seen_at", "first_at").alias("created_at"))
    )
    new = label_period(seen, w).groupBy("period").agg(F.count("*").alias("new_users"))
    total = seen.agg(F.count("*").alias("total_users"))
    frame = values(spark, "period", ("current", "previous"))
    counted = fill(frame, facts.join(new, "period", "full_outer"), ["period"], ["active_users", "new_users", "actions", "tokens", "rate_limited"])
    return counted.crossJoin(F.broadcast(total))


def usage_by_source(activity: DataFrame, w: ReportWindow) -> DataFrame:
    rows = between(activity, w.start, w.end).withColumn("source", source_of(F.col("user_id")))
    facts = rows.groupBy("source").agg(
        F.count_distinct(F.when(is_actor(), F.col("user_id"))).alias("users"),
        F.count_if(F.col("action").isin(*cfg.PRODUCT_ACTIONS)).alias("actions"),
    )
    return fill(values(activity.sparkSession, "source", cfg.USER_SOURCES), facts, ["source"], ["users", "actions"])


def rankings(stats: DataFrame, key: str, n: int = cfg.RANKING_SIZE) -> DataFrame:
    """Leading users by one figure, ties by id, zeros left out."""
    top = stats.filter(F.col(key) > 0).orderBy(F.desc(key), "user_id").limit(n)
    return identity(top).select("user_id", "name", "source", F.col(key).alias("value"))


def user_activity_series(activity: DataFrame, user_id: str, w: ReportWindow) -> DataFrame:
    group = F.create_map(*[F.lit(x) for pair in cfg.ACTIVITY_GROUPS.items() for x in pair])
    rows = assign_bucket(activity.filter(F.col("user_id") == user_id), w).withColumn("grp", F.try_element_at(group, F.col("action")))
    groups = tuple(dict.fromkeys(cfg.ACTIVITY_GROUPS.values()))
    facts = rows.groupBy("bucket").agg(
        *[F.count_if(F.col("grp") == g).alias(g) for g in groups], sum_of(F.col("tokens")).alias("tokens"))
    return fill(spine(activity.sparkSession, w), facts, ["bucket"], [*groups, "tokens"])


def user_formats(activity: DataFrame, w: ReportWindow) -> DataFrame:
    """Formats of analyses, uploads and exports per user, most common first."""
    rows = between(activity, w.start, w.end).filter(F.col("action").isin("analysis", "upload", "export") & F.col("format").isNotNull())
    counts = rows.groupBy("user_id", "action", "format").agg(F.count("*").alias("n"))
    w_rank = Window.partitionBy("user_id", "action").orderBy(F.desc("n"), "format")
    return counts.withColumn("rank", F.row_number().over(w_rank))


def user_adaptations(activity: DataFrame, w: ReportWindow) -> DataFrame:
    rows = between(activity, w.start, w.end).filter(F.col("action").isin("proposal", "decision") & F.col("adaptation_type").isNotNull())
    return rows.groupBy("user_id", "adaptation_type").agg(
        F.count_if(F.col("action") == "proposal").alias("propuestas"),
        *[F.count_if((F.col("action") == "decision") & (F.col("detail") == d)).alias(d) for d in _DECISIONS],
    )


def user_transformations(activity: DataFrame, w: ReportWindow) -> DataFrame:
    rows = between(activity, w.start, w.end).filter(
        F.col("action").isin("transformation", "transformation_decision") & F.col("format").isNotNull())
    asked = F.col("action") == "transformation"
    return rows.groupBy("user_id", "format").agg(
        F.count_if(asked).alias("pedidas"), F.count_if(asked & (F.col("detail") == "failed")).alias("fallidas"),
        *[F.count_if(~asked & (F.col("detail") == d)).alias(d) for d in _REVIEWS],
    )


def user_models(activity: DataFrame, w: ReportWindow) -> DataFrame:
    calls = between(activity, w.start, w.end).filter(F.col("action") == "ai_call")
    return calls.groupBy("user_id", "provider", "model").agg(
        F.count("*").alias("calls"), sum_of(F.col("tokens")).alias("tokens"),
        F.count_if(F.coalesce(F.col("detail") != "ok", F.lit(True))).alias("errors"),
    )


def user_recent(activity: DataFrame, n: int = cfg.RECENT_ACTIVITY) -> DataFrame:
    return top_per_key(activity, ["user_id"], [F.desc("created_at"), F.desc("event_id")], n)


def touch_users(users: DataFrame, calls: DataFrame) -> DataFrame:
    """Users after a batch of calls (user_id, role, at): newest role, latest visit, first visit kept."""
    known = users.select("user_id", "role", F.col("first_seen_at").alias("first_at"), F.col("last_seen_at").alias("last_at"), F.lit(0).alias("fresh"))
    seen = calls.select("user_id", "role", F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.lit(1).alias("fresh"))
    return known.unionByName(seen).groupBy("user_id").agg(
        F.max_by("role", F.struct("fresh", "last_at", "role")).alias("role"),
        F.coalesce(F.min(F.when(F.col("fresh") == 0, F.col("first_at"))), F.min("first_at")).alias("first_seen_at"),
        F.max("last_at").alias("last_seen_at"),
    ).withColumn("source", source_of(F.col("user_id")))


def stale_profiles(users: DataFrame, before: datetime, n: int) -> DataFrame:
    old = F.col("profile_fetched_at").isNull() | (F.col("profile_fetched_at") < moment(users, "profile_fetched_at", before))
    return users.filter((F.col("source") == "frontend") & old).orderBy(F.desc("last_seen_at"), "user_id").limit(n).select("user_id")


def search_users(directory: DataFrame, source: str | None = None, only_active: bool = False, text: str | None = None) -> DataFrame:
    found = directory
    if source:
        found = found.filter(F.col("source") == source)
    if only_active:
        found = found.filter((F.col("range_actions") > 0) | (F.col("range_ai_calls") > 0) | (F.col("range_rate_limited") > 0))
    if text:
        needle = F.lit(text.strip().lower())
        hits = [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in ("name", "user_id")]
        found = found.filter(hits[0] | hits[1])
    return found
