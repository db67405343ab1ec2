"""Test-tracking reports: sessions, results, bugs, evidence, synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.operators.usage import sum_of
from lumbrera.operators.windows import crosstab, fill, values


def applicable_cases(cases: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cases to run in each session: active ones of its area, destructive ones not in production.

    Sessions repeat a few (area, environment) pairs, so cases are matched to the pairs.
    """
    live = cases.filter("active").select("case_id", "area", "section", "title", "destructive")
    return live.join(sessions.select("area", "environment").distinct(), "area").filter(
        (F.col("environment") != "produccion") | ~F.col("destructive"))


def session_progress(sessions: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    totals = applicable_cases(cases, sessions).groupBy("area", "environment").agg(F.count("*").alias("total"))
    counts = crosstab(results, "session_id", "status", cfg.RESULT_STATES)
    joined = sessions.join(totals, ["area", "environment"], "left").join(counts, "session_id", "left").na.fill(0, ["total", *cfg.RESULT_STATES])
    registered = sum((F.col(s) for s in cfg.RESULT_STATES[1:]), F.col(cfg.RESULT_STATES[0]))
    return joined.select("session_id", "total", *cfg.RESULT_STATES, F.greatest(F.col("total") - registered, F.lit(0)).alias("pendiente"))


def case_history(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Results with the session they belong to, newest first inside a case."""
    return results.join(sessions, "session_id").orderBy("case_id", F.desc("updated_at"), F.desc("session_id"))


def bug_summary(bugs: DataFrame) -> DataFrame:
    counts = bugs.groupBy("status").agg(F.count("*").alias("n"))
    return fill(values(bugs.sparkSession, "status", cfg.BUG_STATES), counts, ["status"], ["n"])


def evidence_usage(evidence: DataFrame) -> DataFrame:
    """Count and bytes by kind, zero filled, with the grand total under kind NULL."""
    sums = evidence.groupBy("kind").agg(F.count("*").alias("n"), sum_of(F.col("size_bytes")).alias("bytes"))
    filled = fill(values(evidence.sparkSession, "kind", cfg.EVIDENCE_KINDS), sums, ["kind"], ["n", "bytes"])
    return filled.rollup("kind").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def _open_published(bugs: DataFrame) -> DataFrame:
    return bugs.filter(F.col("issue_number").isNotNull() & F.col("status").isin(*cfg.OPEN_BUG_STATES)).select("bug_id", "issue_number", "case_id")


def closure_proposals(bugs: DataFrame, results: DataFrame) -> DataFrame:
    """Published open bugs whose case passed: in how many sessions, and the latest of them.

    Passes are counted per case before the join, so a case with many bugs and many sessions is not
    multiplied out.
    """
    passed = results.filter(F.col("status") == "paso").groupBy("case_id").agg(
        F.count("*").alias("sessions"), F.max("session_id").alias("latest_session"))
    return _open_published(bugs).join(passed, "case_id")


def closure_proposals_of(bugs: DataFrame, results: DataFrame, session_id: int) -> DataFrame:
    """Published open bugs whose case passed in one session."""
    passed = results.filter((F.col("session_id") == session_id) & (F.col("status") == "paso")).select("case_id")
    return _open_published(bugs).join(passed, "case_id", "left_semi")


def execution_table(results: DataFrame, bugs: DataFrame, evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """Per session and catalogued case: result, latest published bug, evidence ids in order."""
    published = bugs.filter(F.col("issue_number").isNotNull()).groupBy("case_id").agg(F.max_by("issue_number", "bug_id").alias("issue_number"))
    proof = evidence.groupBy("session_id", "case_id").agg(F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("evidence"))
    joined = results.join(cases.select("case_id", "title"), "case_id").join(published, "case_id", "left").join(proof, ["session_id", "case_id"], "left")
    return joined.select("session_id", "case_id", "title", "status", "issue_number", F.coalesce("evidence", F.lit("")).alias("evidence"))


def search_bugs(bugs: DataFrame, statuses=(), severities=(), created_from: str | None = None, created_to: str | None = None,
                before_id: int | None = None, limit: int = 50) -> DataFrame:
    """One page, newest id first, with one row more than the page to tell whether another follows."""
    found = bugs
    if statuses:
        found = found.filter(F.col("status").isin(*statuses))
    if severities:
        found = found.filter(F.col("severity").isin(*severities))
    if created_from:
        found = found.filter(F.col("created_at") >= F.lit(created_from).cast(found.schema["created_at"].dataType))
    if created_to:
        found = found.filter(F.col("created_at") < F.date_add(F.lit(created_to).cast("date"), 1))
    if before_id:
        found = found.filter(F.col("bug_id") < before_id)
    return found.orderBy(F.desc("bug_id")).limit(limit + 1)


def search_cases(cases: DataFrame, text: str | None = None, section: str | None = None, destructive: bool | None = None) -> DataFrame:
    found = cases
    if section:
        found = found.filter(F.col("section") == section)
    if destructive is not None:
        found = found.filter(F.col("destructive") == destructive)
    if text:
        haystack = F.lower(F.concat_ws(" ", F.col("case_id").cast("string"), "title"))
        found = found.filter(F.contains(haystack, F.lit(text.strip().lower())))
    return found


def section_counts(cases: DataFrame, area: str) -> DataFrame:
    return cases.filter((F.col("area") == area) & F.col("active")).groupBy("section").agg(F.count("*").alias("cases"))


def next_case_id(cases: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Next free id of every area: the largest number ever used plus one. ``cases``: code, area."""
    spark = cases.sparkSession
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("long")
    used = cases.groupBy("area").agg(F.max(number).alias("last"))
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.col("area"))
    digits = (F.coalesce("last", F.lit(0)) + 1).cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return values(spark, "area", prefixes).join(used, "area", "left").select("area", F.concat(F.lit("QA-"), prefix, F.lit("-"), padded).alias("next_id"))


# How a closing reason reads in the change log.
_REASONS = {"not_planned": "no planificado", "duplicate": "duplicado"}


def sync_status(bugs: DataFrame, external: DataFrame) -> DataFrame:
    """Change-log rows: bugs whose external issue puts them in another state, and why.

    ``external``: issue_number, state, reason, board, previous_state.
    """
    seen = bugs.filter(F.col("issue_number").isNotNull()).join(external, "issue_number")
    now, reason, board = F.col("status"), F.coalesce("reason", F.lit("")), F.lower(F.coalesce("board", F.lit("")))
    done = now.isin("resuelto", "verificado", "descartado")
    closed = F.col("state") == "closed"
    refused = closed & reason.isin(*_REASONS)
    reopened = ~closed & ((F.coalesce("previous_state", F.lit("")) == "closed") | ((reason == "reopened") & done))
    moving = ~closed & ~reopened & board.isin("in progress", "in review") & now.isin("abierto", "reabierto")
    finished = ~closed & ~reopened & ~moving & (board == "done") & ~done
    target = (
        F.when(refused, F.when(now != "descartado", "descartado"))
        .when(closed, F.when(~now.isin("resuelto", "verificado"), "resuelto"))
        .when(reopened, F.when(now != "reabierto", "reabierto"))
        .when(moving, "en_curso").when(finished, "resuelto")
    )
    spoken = F.try_element_at(F.create_map(*[F.lit(x) for kv in _REASONS.items() for x in kv]), reason)
    note = (
        F.when(refused, F.concat(F.lit("Cerrado como "), spoken)).when(closed, "Cerrado como completado")
        .when(reopened, "Reabierto").when(moving, F.concat(F.lit("En el tablero: "), "board")).when(finished, F.lit("En el tablero: Done"))
    )
    return seen.select("bug_id", now.alias("from_status"), target.alias("to_status"), note.alias("note")).filter("to_status is not null")


def import_comments(incoming: DataFrame, known: DataFrame, bugs: DataFrame) -> DataFrame:
    """External comments to insert: one per new id, on bugs that are tracked, none already known."""
    tracked = bugs.filter(F.col("issue_number").isNotNull()).select("issue_number", "bug_id")
    fresh = incoming.join(known.select("comment_id"), "comment_id", "left_anti")
    first = fresh.groupBy("comment_id", "issue_number").agg(F.min(F.struct("created_at", "author")).alias("c"))
    return first.join(tracked, "issue_number").select("bug_id", "comment_id", F.col("c.author").alias("author"), F.col("c.created_at").alias("created_at"))


def duplicate_bugs(bugs: DataFrame) -> DataFrame:
    """Active bugs that share their case with other active bugs, and how many others there are.

    Answers "is there another one" for every bug with counts instead of listing all pairs of a case.
    """
    active = bugs.filter(F.col("status").isin(*cfg.ACTIVE_BUG_STATES)).groupBy("case_id").agg(
        F.count("*").alias("active"), F.max("bug_id").alias("newest"))
    own = F.col("status").isin(*cfg.ACTIVE_BUG_STATES).cast("int")
    return bugs.join(active, "case_id").withColumn("others", F.col("active") - own).filter("others > 0").select("bug_id", "case_id", "others", "newest")


def duplicates_of(bugs: DataFrame, bug_id: int) -> DataFrame:
    """Other active bugs on the case of one bug, newest first."""
    case = bugs.filter(F.col("bug_id") == bug_id).select("case_id")
    others = bugs.filter((F.col("bug_id") != bug_id) & F.col("status").isin(*cfg.ACTIVE_BUG_STATES))
    return others.join(F.broadcast(case), "case_id", "left_semi").orderBy(F.desc("bug_id"))


def missing_fields(reports: DataFrame) -> DataFrame:
    """Mandatory fields left empty and whether the report is ready. Columns: titulo, pasos, esperado, obtenido."""
    names = {"titulo": "título", "pasos": "pasos para reproducir", "esperado": "resultado esperado", "obtenido": "resultado obtenido"}

    def empty(column: str) -> Column:
        return F.trim(F.coalesce(column, F.lit(""))) == ""

    missing = F.array_compact(F.array(*[F.when(empty(c), F.lit(n)) for c, n in names.items()]))
    return reports.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0)
