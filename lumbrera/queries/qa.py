"""Test-tracking reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.bindings import entity, table
from lumbrera.operators import qa
from lumbrera.queries.metrics import counts_sql, enum_sql, iso, iso_sql, zero
from lumbrera.queries.oracle_views import quoted
from lumbrera.queries.registry import query

_APPLICABLE = """(SELECT s.session_id, c.case_id FROM qa_sessions s JOIN qa_cases c ON c.area = s.area WHERE c.active AND (s.environment <> 'produccion' OR NOT c.destructive))"""


@query("q01_session_progress", f"""
SELECT session_id, total, {', '.join(cfg.RESULT_STATES)}, greatest(total - ({' + '.join(cfg.RESULT_STATES)}), 0) AS pendiente FROM (
  SELECT s.session_id, coalesce(t.total, 0) AS total, {zero(cfg.RESULT_STATES)} FROM qa_sessions s
  LEFT JOIN (SELECT session_id, count(*) AS total FROM {_APPLICABLE} GROUP BY 1) t USING (session_id)
  LEFT JOIN (SELECT session_id, {counts_sql('status', cfg.RESULT_STATES)} FROM qa_results GROUP BY 1) r USING (session_id))""")
def session_progress(spark, sf):
    return qa.session_progress(entity(spark, sf, "qa_sessions"), entity(spark, sf, "qa_results"), entity(spark, sf, "qa_cases"))


@query("q02_applicable_cases", """
SELECT c.case_id, s.environment FROM (SELECT DISTINCT area, environment FROM qa_sessions) s JOIN qa_cases c USING (area)
WHERE c.active AND (s.environment <> 'produccion' OR NOT c.destructive)""")
def applicable_cases(spark, sf):
    return qa.applicable_cases(entity(spark, sf, "qa_cases"), entity(spark, sf, "qa_sessions")).select("case_id", "environment")


@query("q03_case_history", f"""
SELECT case_id, session_id, status, environment, {iso_sql('updated_at')} AS updated_at FROM qa_results JOIN qa_sessions USING (session_id)""")
def case_history(spark, sf):
    found = qa.case_history(entity(spark, sf, "qa_results"), entity(spark, sf, "qa_sessions"))
    return found.select("case_id", "session_id", "status", "environment", iso(F.col("updated_at")).alias("updated_at"))


@query("q04_bug_summary", f"""
SELECT status, coalesce(n, 0) AS n FROM {enum_sql('status', cfg.BUG_STATES)} LEFT JOIN (SELECT status, count(*) AS n FROM qa_bugs GROUP BY 1) USING (status)""")
def bug_summary(spark, sf):
    return qa.bug_summary(entity(spark, sf, "qa_bugs"))


@query("q05_evidence_usage", f"""
SELECT kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT kind, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes FROM {enum_sql('kind', cfg.EVIDENCE_KINDS)} LEFT JOIN (
    SELECT kind, count(*) AS n, sum(size_bytes) AS bytes FROM qa_evidence GROUP BY 1) USING (kind)) GROUP BY ROLLUP (kind)""")
def evidence_usage(spark, sf):
    return qa.evidence_usage(entity(spark, sf, "qa_evidence"))


_OPEN = f"(SELECT bug_id, issue_number, case_id FROM qa_bugs WHERE issue_number IS NOT NULL AND status IN ({quoted(cfg.OPEN_BUG_STATES)}))"


@query("q06_closure_proposals", f"""
SELECT b.bug_id, b.issue_number, b.case_id, r.sessions, r.latest_session FROM {_OPEN} b
JOIN (SELECT case_id, count(*) AS sessions, max(session_id) AS latest_session FROM qa_results WHERE status = 'paso' GROUP BY 1) r USING (case_id)""")
def closure_proposals(spark, sf):
    return qa.closure_proposals(entity(spark, sf, "qa_bugs"), entity(spark, sf, "qa_results"))


@query("q06_closure_proposals_of_session", f"""
SELECT b.bug_id, b.issue_number, b.case_id FROM {_OPEN} b WHERE case_id IN (SELECT case_id FROM qa_results WHERE status = 'paso' AND session_id = 3)""")
def closure_proposals_of_session(spark, sf):
    return qa.closure_proposals_of(entity(spark, sf, "qa_bugs"), entity(spark, sf, "qa_results"), 3)


@query("q07_execution_table", """
SELECT r.session_id, r.case_id, c.title, r.status, b.issue_number, coalesce(e.evidence, '') AS evidence FROM qa_results r JOIN qa_cases c USING (case_id)
LEFT JOIN (SELECT case_id, arg_max(issue_number, bug_id) AS issue_number FROM qa_bugs WHERE issue_number IS NOT NULL GROUP BY 1) b USING (case_id)
LEFT JOIN (SELECT session_id, case_id, string_agg(CAST(evidence_id AS STRING), ',' ORDER BY evidence_id) AS evidence
  FROM (SELECT DISTINCT session_id, case_id, evidence_id FROM qa_evidence) GROUP BY 1, 2) e ON e.session_id = r.session_id AND e.case_id = r.case_id""")
def execution_table(spark, sf):
    return qa.execution_table(*[entity(spark, sf, n) for n in ("qa_results", "qa_bugs", "qa_evidence", "qa_cases")])


@query("q08_search_bugs", f"""
SELECT bug_id, status, severity, {iso_sql('created_at')} AS created_at FROM qa_bugs WHERE status IN ('abierto', 'reabierto') AND severity IN ('1-URGENT', '2-HIGH')
  AND created_at >= TIMESTAMP '1996-01-01' AND created_at < DATE '1999-12-31' + INTERVAL 1 DAY AND bug_id < 1000000 ORDER BY bug_id DESC LIMIT 51""")
def search_bugs(spark, sf):
    found = qa.search_bugs(entity(spark, sf, "qa_bugs"), ("abierto", "reabierto"), ("1-URGENT", "2-HIGH"), "1996-01-01", "1999-12-31", 1_000_000, 50)
    return found.select("bug_id", "status", "severity", iso(F.col("created_at")).alias("created_at"))


@query("q08_search_cases", """
SELECT case_id, section, title FROM qa_cases WHERE NOT destructive AND contains(lower(CAST(case_id AS STRING) || ' ' || title), 'ring')""")
def search_cases(spark, sf):
    return qa.search_cases(entity(spark, sf, "qa_cases"), text=" Ring", destructive=False).select("case_id", "section", "title")


@query("q09_section_counts", "SELECT section, count(*) AS cases FROM qa_cases WHERE area = 'backend' AND active GROUP BY 1")
def section_counts(spark, sf):
    return qa.section_counts(entity(spark, sf, "qa_cases"), "backend")


_PREFIXES = {"backend": "BE", "frontend": "FE"}


@query("q10_next_case_id", f"""
SELECT area, 'QA-' || CASE area WHEN 'backend' THEN 'BE' ELSE 'FE' END || '-' || CASE WHEN n < 100 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END AS next_id FROM (
  SELECT area, coalesce(max(case_id), 0) + 1 AS n FROM {enum_sql('area', _PREFIXES)} LEFT JOIN qa_cases USING (area) GROUP BY 1)""")
def next_case_id(spark, sf):
    code = F.concat(F.when(F.col("area") == "backend", "QA-BE-").otherwise("QA-FE-"), F.col("case_id").cast("string"))
    return qa.next_case_id(entity(spark, sf, "qa_cases").select("area", code.alias("code")), _PREFIXES)


@query("q11_sync_status", """
SELECT bug_id, status AS from_status, to_status, note FROM (SELECT *, CASE
    WHEN state = 'closed' AND reason IN ('not_planned', 'duplicate') THEN CASE WHEN status <> 'descartado' THEN 'descartado' END
    WHEN state = 'closed' THEN CASE WHEN status NOT IN ('resuelto', 'verificado') THEN 'resuelto' END
    WHEN previous_state = 'closed' OR (reason = 'reopened' AND status IN ('resuelto', 'verificado', 'descartado')) THEN CASE WHEN status <> 'reabierto' THEN 'reabierto' END
    WHEN lower(board) IN ('in progress', 'in review') AND status IN ('abierto', 'reabierto') THEN 'en_curso'
    WHEN lower(board) = 'done' AND status NOT IN ('resuelto', 'verificado', 'descartado') THEN 'resuelto' END AS to_status,
  CASE WHEN state = 'closed' AND reason = 'not_planned' THEN 'Cerrado como no planificado' WHEN state = 'closed' AND reason = 'duplicate' THEN 'Cerrado como duplicado'
    WHEN state = 'closed' THEN 'Cerrado como completado'
    WHEN previous_state = 'closed' OR (reason = 'reopened' AND status IN ('resuelto', 'verificado', 'descartado')) THEN 'Reabierto'
    WHEN lower(board) = 'done' THEN 'En el tablero: Done' ELSE 'En el tablero: ' || board END AS note
  FROM qa_bugs JOIN issue_states USING (issue_number)) WHERE to_status IS NOT NULL""")
def sync_status(spark, sf):
    return qa.sync_status(entity(spark, sf, "qa_bugs"), entity(spark, sf, "issue_states"))


@query("q12_import_comments", f"""
SELECT b.bug_id, c.comment_id, c.author, {iso_sql('c.created_at')} AS created_at FROM (
  SELECT comment_id, issue_number, (min(struct_pack(created_at := created_at, author := author))).created_at AS created_at,
    (min(struct_pack(created_at := created_at, author := author))).author AS author
  FROM issue_comments WHERE comment_id NOT IN (SELECT comment_id FROM known_comments) GROUP BY 1, 2) c JOIN qa_bugs b USING (issue_number)""")
def import_comments(spark, sf):
    found = qa.import_comments(entity(spark, sf, "issue_comments"), entity(spark, sf, "known_comments"), entity(spark, sf, "qa_bugs"))
    return found.withColumn("created_at", iso(F.col("created_at")))


@query("q13_duplicate_bugs", f"""
SELECT b.bug_id, b.case_id, count(*) AS others, max(o.newest) AS newest FROM qa_bugs b
JOIN (SELECT bug_id, case_id, max(bug_id) OVER (PARTITION BY case_id) AS newest FROM qa_bugs WHERE status IN ({quoted(cfg.ACTIVE_BUG_STATES)})) o
  ON o.case_id = b.case_id AND o.bug_id <> b.bug_id GROUP BY 1, 2""")
def duplicate_bugs(spark, sf):
    return qa.duplicate_bugs(entity(spark, sf, "qa_bugs"))


@query("q13_duplicates_of", f"""
SELECT bug_id, status FROM qa_bugs WHERE bug_id <> 3 AND status IN ({quoted(cfg.ACTIVE_BUG_STATES)}) AND case_id = (SELECT case_id FROM qa_bugs WHERE bug_id = 3)""")
def duplicates_of(spark, sf):
    return qa.duplicates_of(entity(spark, sf, "qa_bugs"), 3).select("bug_id", "status")


@query("q14_missing_fields", """
SELECT c_custkey AS report_id, ready, missing FROM (SELECT c_custkey,
  NOT (a OR b OR c OR d) AS ready,
  concat_ws('|', CASE WHEN a THEN 'título' END, CASE WHEN b THEN 'pasos para reproducir' END, CASE WHEN c THEN 'resultado esperado' END, CASE WHEN d THEN 'resultado obtenido' END) AS missing
FROM (SELECT c_custkey, c_custkey % 5 = 0 AS a, c_custkey % 3 = 0 AS b, c_custkey % 7 = 0 AS c, c_acctbal < 0 AS d FROM customer))""")
def missing_fields(spark, sf):
    reports = table(spark, sf, "customer").selectExpr(
        "c_custkey as report_id", "case when c_custkey % 5 = 0 then '  ' else c_name end as titulo",
        "case when c_custkey % 3 <> 0 then '1. abrir' end as pasos", "case when c_custkey % 7 <> 0 then 'ok' else '' end as esperado",
        "case when c_acctbal >= 0 then 'error' end as obtenido")
    return qa.missing_fields(reports).select("report_id", "ready", F.array_join("missing", "|").alias("missing"))
