"""Entity tables as projections of the given tables.

Each projection is portable SQL, run unchanged by Spark here and by the oracle engine in the
correctness check. Two Spark projections differ from the oracle's in form only: ``fragments`` and
``decision_log`` carry their natural order as a number or struct instead of a ``row_number`` over
the whole document, because a dense number would send every row of one document to one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_LINE_NUMBER = f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS INT)"

SQL: dict[str, str] = {
    "materials": """
SELECT doc_id, lang, source,
  CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'pptx' END AS source_type,
  CASE WHEN doc_id % 10 = 3 THEN text || chr(10) || 'Alumno: Juan Pérez' || chr(10) || 'DNI: '
         || CAST(20000000 + (doc_id * 7919) % 9999999 AS STRING) || chr(10)
         || 'Nota final: ' || CAST(1 + doc_id % 10 AS STRING)
       WHEN doc_id % 10 = 6 THEN text || chr(10)
         || 'Leé el texto, subrayá las ideas, completá el cuadro y respondé las preguntas.' || chr(10)
         || 'Las correctas en verde y las incorrectas en rojo. Ver el gráfico de la derecha.'
       ELSE text END AS raw_text,
  CAST(1 + doc_id % 12 AS INT) AS page_count, CAST(doc_id % 5 AS INT) AS image_count,
  CAST(doc_id % 3 AS INT) AS images_with_alt_text,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id AS created_at,
  TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' MINUTE * doc_id AS expires_at,
  'user_' || CAST(doc_id % 50 AS STRING) AS user_id
FROM documents""",
    "ai_scores": """
SELECT doc_id, CAST(40 + (doc_id * 37) % 61 AS INT) AS ai_score FROM documents WHERE doc_id % 7 <> 0""",
    "headings": """
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(1 + (doc_id * 5 + pos * pos) % 3 AS INT) AS level,
  'Sección ' || CAST(pos AS STRING) AS text
FROM documents CROSS JOIN (SELECT 1 AS pos UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) p
WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0""",
    "fragments": f"""
SELECT l_orderkey AS doc_id, {_LINE_NUMBER} AS frag_id, CAST(1 + l_linenumber % 3 AS INT) AS para_id,
  CAST(1 + l_linenumber % 4 AS INT) AS page_number, repeat('palabra ', CAST(l_quantity AS INT)) AS text,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(6 + l_partkey % 12 AS DOUBLE) END AS size,
  CASE l_suppkey % 6 WHEN 0 THEN '#000000' WHEN 1 THEN '#C0392B' WHEN 2 THEN '#6B7A1E' WHEN 3 THEN '#999999'
    WHEN 4 THEN '#CCCCCC' ELSE NULL END AS color,
  '#FFFFFF' AS background, l_partkey % 5 = 0 AS bold, l_returnflag = 'R' AS italic, l_linestatus = 'O' AS underline,
  l_linenumber % 5 = 0 AS link, l_linenumber <> 7 AS visible,
  CASE l_partkey % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'ABCDEF+BrushScriptMT-Italic' WHEN 2 THEN 'Verdana' ELSE NULL END AS font,
  l_partkey % 7 = 0 AS caps
FROM lineitem""",
    "paragraph_formats": """
SELECT l_orderkey AS doc_id, CAST(1 + l_linenumber % 3 AS INT) AS para_id, max(l_suppkey) % 3 = 0 AS justified,
  CASE max(l_partkey) % 4 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(1.15 AS DOUBLE) WHEN 2 THEN CAST(1.5 AS DOUBLE) END AS line_spacing
FROM lineitem GROUP BY l_orderkey, CAST(1 + l_linenumber % 3 AS INT)""",
    "ai_usage_events": """
SELECT event_id, ts AS created_at, user_id % 12 AS connection_id, 'prov' || CAST(user_id % 5 AS STRING) AS provider,
  'model' || CAST(user_id % 3 AS STRING) AS model,
  CASE event_id % 10 WHEN 0 THEN 'tts' WHEN 1 THEN 'vision' ELSE 'text' END AS kind,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'server_error' ELSE 'rate_limited' END
    ELSE 'ok' END AS outcome,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS total_tokens,
  CASE WHEN event_id % 10 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS characters,
  CASE WHEN event_id % 10 = 0 THEN value ELSE 0.0 END AS audio_seconds
FROM events""",
    "user_activity": """
SELECT event_id, ts AS created_at,
  CASE WHEN user_id % 25 = 0 THEN 'anon' WHEN user_id % 10 = 1 THEN 'test-web_local_u' || CAST(user_id AS STRING)
    ELSE 'user_' || CAST(user_id AS STRING) END AS user_id,
  CASE event_id % 14 WHEN 0 THEN 'analysis' WHEN 1 THEN 'proposal' WHEN 2 THEN 'decision' WHEN 3 THEN 'upload'
    WHEN 4 THEN 'upload_rejected' WHEN 5 THEN 'export' WHEN 6 THEN 'download' WHEN 7 THEN 'share_created'
    WHEN 8 THEN 'share_opened' WHEN 9 THEN 'share_revoked' WHEN 10 THEN 'ai_call' WHEN 11 THEN 'rate_limited'
    WHEN 12 THEN 'transformation' ELSE 'transformation_decision' END AS action,
  CASE WHEN event_id % 14 IN (2, 13) THEN CASE user_id % 4 WHEN 0 THEN 'aceptada' WHEN 1 THEN 'editada' WHEN 2 THEN 'descartada' ELSE 'deshacer' END
    WHEN event_id % 14 = 10 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END
    WHEN event_id % 14 = 12 AND event_type = 'error' THEN 'failed'
    WHEN event_id % 14 = 5 THEN CASE user_id % 2 WHEN 0 THEN 'content:file' ELSE 'report:link' END END AS detail,
  CASE user_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'pptx' ELSE 'txt' END AS format,
  event_type = 'view' AS mock, CAST(floor(value * 1000) AS BIGINT) AS size_bytes,
  CASE WHEN event_id % 14 = 10 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) ELSE 0 END AS tokens,
  CASE WHEN event_id % 14 IN (1, 2) THEN CASE event_id % 4 WHEN 0 THEN 'lenguaje_claro' WHEN 1 THEN 'consigna_en_pasos'
    WHEN 2 THEN 'reorganizar' ELSE 'mejorar_estructura' END END AS adaptation_type,
  CASE WHEN event_id % 14 = 10 THEN 'prov' || CAST(user_id % 5 AS STRING) END AS provider,
  CASE WHEN event_id % 14 = 10 THEN 'model' || CAST(user_id % 3 AS STRING) END AS model
FROM events""",
    "file_events": """
SELECT event_id, created_at, action AS event, format, size_bytes, detail, user_id FROM user_activity
WHERE action IN ('upload', 'upload_rejected', 'export', 'download', 'share_created', 'share_opened', 'share_revoked')""",
    "api_users": """
SELECT user_id, CASE WHEN user_id = 'anon' THEN 'anon' WHEN user_id LIKE 'test-web@_%' ESCAPE '@' THEN 'test_web' ELSE 'frontend' END AS source,
  CASE length(user_id) % 2 WHEN 0 THEN 'docente' ELSE 'admin' END AS role,
  min(created_at) AS first_seen_at, max(created_at) AS last_seen_at,
  CASE WHEN length(user_id) % 3 = 0 THEN NULL ELSE min(created_at) END AS profile_fetched_at
FROM user_activity GROUP BY user_id""",
    "files": """
SELECT o_orderkey AS file_id, o_custkey AS user_id, CASE o_orderkey % 2 WHEN 0 THEN 'upload' ELSE 'export' END AS kind,
  'f' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' ELSE '' END AS filename,
  CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'uploaded' END AS status,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS created_at,
  o_orderdate + INTERVAL '1' DAY * (o_orderkey % 400) AS expires_at
FROM orders""",
    "file_shares": f"""
SELECT l_orderkey * 100 + {_LINE_NUMBER} AS share_id, l_orderkey AS file_id, l_shipdate AS created_at,
  l_shipdate + INTERVAL '1' DAY * (l_partkey % 90) AS expires_at,
  CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS revoked_at, CAST(floor(l_quantity) AS BIGINT) AS access_count
FROM lineitem""",
    "connections": """
SELECT s_suppkey AS id, s_name AS label, s_suppkey % 4 AS priority, s_suppkey % 5 <> 0 AS enabled, s_suppkey = 1 AS is_current,
  s_suppkey % 2 = 0 AS supports_vision, CAST(100 AS BIGINT) AS rpd_threshold, (s_suppkey * 17) % 120 AS request_count,
  CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE CAST(1000 AS BIGINT) END AS tpd_threshold, (s_suppkey * 311) % 1300 AS total_token_count
FROM supplier""",
    "decision_log": f"""
SELECT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS proposal_id, 'bar-' || CAST(1 + l_linenumber % 4 AS STRING) AS barrier_id,
  CASE l_partkey % 4 WHEN 0 THEN 'lenguaje_claro' WHEN 1 THEN 'consigna_en_pasos' WHEN 2 THEN 'reorganizar' ELSE 'mejorar_estructura' END AS adaptation_type,
  CASE l_suppkey % 4 WHEN 0 THEN 'aceptada' WHEN 1 THEN 'editada' WHEN 2 THEN 'descartada' ELSE 'pendiente' END AS to_status,
  CASE WHEN l_suppkey % 3 = 0 THEN 'aceptada' ELSE 'pendiente' END AS from_status,
  l_shipdate AS created_at, {_LINE_NUMBER} AS seq
FROM lineitem""",
    "qa_cases": """
SELECT p_partkey AS case_id, CASE p_partkey % 3 WHEN 0 THEN 'frontend' ELSE 'backend' END AS area, p_brand AS section,
  p_name AS title, p_size % 7 = 0 AS destructive, p_size % 11 <> 0 AS active
FROM part""",
    "qa_sessions": """
SELECT s_suppkey AS session_id, CASE s_suppkey % 3 WHEN 0 THEN 'frontend' ELSE 'backend' END AS area,
  CASE s_suppkey % 3 WHEN 0 THEN 'produccion' WHEN 1 THEN 'staging' ELSE 'local' END AS environment
FROM supplier""",
    "qa_results": """
SELECT l_suppkey AS session_id, l_partkey AS case_id,
  CASE max(l_linenumber) % 4 WHEN 0 THEN 'paso' WHEN 1 THEN 'fallo' WHEN 2 THEN 'bloqueado' ELSE 'omitido' END AS status,
  max(l_shipdate) AS updated_at
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "qa_bugs": """
SELECT o_orderkey AS bug_id, o_custkey AS case_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'borrador' WHEN 1 THEN 'abierto' WHEN 2 THEN 'en_curso' WHEN 3 THEN 'resuelto'
    WHEN 4 THEN 'verificado' WHEN 5 THEN 'reabierto' ELSE 'descartado' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS issue_number, o_orderpriority AS severity, o_orderdate AS created_at
FROM orders""",
    "qa_evidence": """
SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_suppkey AS session_id, l_partkey AS case_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'imagen' WHEN 1 THEN 'texto' ELSE 'pdf' END AS kind,
  CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes
FROM lineitem""",
    "issue_states": """
SELECT o_orderkey AS issue_number,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
  CASE o_custkey % 5 WHEN 0 THEN 'not_planned' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'reopened' WHEN 3 THEN 'completed' END AS reason,
  CASE o_custkey % 4 WHEN 0 THEN 'In Progress' WHEN 1 THEN 'Done' WHEN 2 THEN 'in review' END AS board,
  CASE WHEN o_custkey % 6 = 0 THEN 'closed' ELSE 'open' END AS previous_state
FROM orders WHERE o_orderkey % 3 = 0""",
    "issue_comments": """
SELECT l_orderkey AS issue_number, l_orderkey * 10 + l_linenumber AS comment_id,
  'autor' || CAST(l_suppkey % 20 AS STRING) AS author, l_shipdate AS created_at
FROM lineitem WHERE l_orderkey % 3 = 0""",
    "known_comments": """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS comment_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'plataforma' ELSE 'github' END AS origin
FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 3""",
    "ai_findings": """
SELECT doc_id, CAST(1 AS INT) AS pos, 'comprension' AS category,
  CASE doc_id % 2 WHEN 0 THEN 'barrera_detectada' ELSE 'para_revisar' END AS severity, 'Vocabulario' AS issue,
  substring(split_part(text, chr(10), 1), 1, 80) AS original_text
FROM documents WHERE doc_id % 7 <> 0
UNION ALL
SELECT doc_id, CAST(2 AS INT), 'estructura', 'para_revisar', 'Bloque denso', substring(split_part(text, chr(10), 2), 1, 60) || '...'
FROM documents WHERE doc_id % 7 <> 0
UNION ALL
SELECT doc_id, CAST(3 AS INT), 'comprension', 'para_revisar', 'Cita inventada', 'texto que no aparece ' || CAST(doc_id AS STRING)
FROM documents WHERE doc_id % 7 <> 0""",
    "ai_dimensions": """
SELECT doc_id, 'comprension' AS category,
  CASE doc_id % 3 WHEN 0 THEN 'correcta' WHEN 1 THEN 'para_revisar' ELSE 'barrera_detectada' END AS status,
  'Lectura del modelo.' AS comment
FROM documents WHERE doc_id % 7 <> 0
UNION ALL
SELECT doc_id, 'estructura', CASE doc_id % 2 WHEN 0 THEN 'correcta' ELSE 'para_revisar' END, 'Organización del modelo.'
FROM documents WHERE doc_id % 7 <> 0
UNION ALL
SELECT doc_id, 'accesibilidad_visual', 'correcta', 'Sin imágenes.' FROM documents WHERE doc_id % 7 <> 0""",
    "analyses": """
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'pptx' END AS source_type,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id % 700) AS created_at,
  TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' MINUTE * doc_id AS expires_at,
  CASE WHEN doc_id % 13 = 0 THEN '{"estimated_score": 50, "barriers": [' ELSE
    '{"estimated_score": ' || CAST(40 + (doc_id * 37) % 61 AS STRING) || ', "barriers": [{"category": "comprension", "severity": "'
    || CASE doc_id % 2 WHEN 0 THEN 'barrera_detectada' ELSE 'para_revisar' END || '"}, {"category": "'
    || CASE doc_id % 3 WHEN 0 THEN 'estructura' WHEN 1 THEN 'accesibilidad_visual' ELSE 'otra' END
    || '", "severity": "para_revisar"}]}' END AS diagnostic_json
FROM documents""",
    "transformations": """
SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN 'no_images' WHEN 1 THEN 'mind_map' WHEN 2 THEN 'infographic' WHEN 3 THEN 'audio' ELSE 'otro' END AS format,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'aceptada' WHEN 1 THEN 'editada' WHEN 2 THEN 'descartada' ELSE 'pendiente' END AS review_status,
  ts + INTERVAL '1' DAY * (user_id % 60) AS expires_at
FROM events WHERE event_id % 14 = 12""",
    "service_checks": """
SELECT event_id AS check_id, 'prov' || CAST(user_id % 5 AS STRING) AS service, ts AS at_time,
  CASE WHEN user_id % 5 = 4 THEN 'unconfigured' WHEN event_type = 'error' THEN 'down' WHEN event_type = 'click' THEN 'degraded' ELSE 'ok' END AS state
FROM events""",
    "images": """
SELECT p_partkey % 40 AS doc_id, p_partkey AS image_id, CAST(1 + p_partkey % 6 AS INT) AS page_number,
  CAST(p_size * 9 AS DOUBLE) AS width_pt, CAST(p_partkey % 37 * 11 AS DOUBLE) AS height_pt,
  CAST(p_partkey % 100 AS DOUBLE) / 100 AS y_norm, CAST(p_partkey % 100 AS DOUBLE) / 100 - CAST(p_partkey % 37 * 11 AS DOUBLE) / 1684 AS top_norm,
  CAST(p_partkey % 100 AS DOUBLE) / 100 + CAST(p_partkey % 37 * 11 AS DOUBLE) / 1684 AS bottom_norm,
  CAST(p_size * (9 + p_partkey % 4) AS BIGINT) AS width_px, CAST(p_partkey % 37 * (11 + p_partkey % 3) AS BIGINT) AS height_px,
  CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'image' || CAST(p_partkey AS STRING) || '.png' WHEN 2 THEN '' ELSE NULL END AS alt,
  p_partkey % 9 = 0 AS decorative, p_partkey % 5 = 0 AS relies_on_color, p_partkey % 6 = 0 AS has_untranscribed_text
FROM part""",
    "nodes": """
SELECT r_regionkey AS doc_id, r_regionkey AS node_id, CAST(NULL AS INT) AS parent_id, CAST(0 AS INT) AS depth, CAST(0 AS INT) AS pos, r_name AS text
FROM region
UNION ALL
SELECT n_regionkey, 100 + n_nationkey, n_regionkey, CAST(1 AS INT), n_nationkey, n_name FROM nation""",
    "ai_runs": """
SELECT user_id AS sample, 'v' || CAST(event_id % 2 AS STRING) AS mode, event_id AS run, value / 10 AS latency_s,
  CAST(floor(value) AS BIGINT) % 101 AS score, event_type <> 'error' AS ok, CAST(50 + user_id * 13 % 400 AS BIGINT) AS words,
  'prov' || CAST(event_id % 3 AS STRING) || '/model' || CAST(user_id % 2 AS STRING) AS model, event_id % 700 AS prompt_tokens, event_id % 90 AS output_tokens,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 11 END AS thinking_tokens, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 101 END AS ai_score,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id % 4 + event_id % 2 * 7 END AS rules_score, event_id % 8 AS findings, user_id % 5 AS rule_findings,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 3 END AS unverified,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'barrera_detectada' WHEN 2 THEN 'para_revisar' ELSE 'correcta' END AS status_comprension,
  CASE user_id % 3 WHEN 0 THEN 'correcta' ELSE CASE event_id % 2 WHEN 0 THEN 'para_revisar' ELSE 'correcta' END END AS status_estructura FROM events""",
}

# Spark forms that keep the ordering columns instead of numbering a whole document in one task.
_SPARK_SQL = {"decision_log": SQL["decision_log"].replace(_LINE_NUMBER, f"struct({_LINE_ORDER})")}
_SPARK_SQL["fragments"] = SQL["fragments"].replace(_LINE_NUMBER, f"struct({_LINE_ORDER})")
_SPARK_SQL["file_shares"] = SQL["file_shares"].replace(
    f"l_orderkey * 100 + {_LINE_NUMBER} AS share_id", f"struct(l_orderkey, {_LINE_ORDER}) AS share_id"
)


def references(sql: str, names) -> list[str]:
    """Names used in ``sql`` as whole words, in the order of ``names``."""
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return [n for n in names if n in words]


# Tables and entities whose rows cost far more to judge than to move.
_HEAVY = ("documents", "pages", "fragments")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer splits than there are cores.

    Text rules are bound by the work on a row, and one row group would keep it all on one core. What
    counts is splits, not files: a table that gives every core a split comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read with the schema its footer declares (one footer read per table and session)."""
    cache = spark.__dict__.setdefault("_lumbrera_schemas", {})
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in cache:
        cache[path] = spark.read.parquet(path).schema
    df = spark.read.schema(cache[path]).parquet(path)
    return spread(df) if name in _HEAVY else df


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entity table derived from the given tables, as a lazy DataFrame."""
    sql = _SPARK_SQL.get(name, SQL[name])
    for base in references(sql, BASE_TABLES):
        df = table(spark, sf_dir, base)
        (spread(df) if name == "fragments" else df).createOrReplaceTempView(base)
    for derived in references(sql, [n for n in SQL if n != name]):
        entity(spark, sf_dir, derived).createOrReplaceTempView(derived)
    return spark.sql(sql)
