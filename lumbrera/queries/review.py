"""Sources, merge of findings, personal data, and review decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.bindings import entity, table
from lumbrera.functions import privacy as P
from lumbrera.operators import decisions, merge, privacy
from lumbrera.plans import closing_report, diagnosis
from lumbrera.queries import rules as rule_queries
from lumbrera.queries.metrics import counts_sql, iso, iso_sql
from lumbrera.queries.oracle_views import NOT_WS, WORD, collapse, trim, wc
from lumbrera.queries.registry import query
from lumbrera.session import checkpoint_dir, cut
from lumbrera.sources import materials as M
from lumbrera.sources import tables, versioned


def materials(spark, sf):
    return entity(spark, sf, "materials")


# --- sources -----------------------------------------------------------------------------------------

@query("s01_load_materials", f"""
SELECT doc_id, lang, source, source_type, length(raw_text) AS chars, page_count, image_count, images_with_alt_text, user_id, {iso_sql('created_at')} AS created_at FROM materials""")
def load_materials(spark, sf):
    return materials(spark, sf).to(M.MATERIAL_SCHEMA).select(
        "doc_id", "lang", "source", "source_type", F.length("raw_text").alias("chars"), "page_count", "image_count", "images_with_alt_text", "user_id",
        iso(F.col("created_at")).alias("created_at"))


@query("s02_admit", f"""
SELECT doc_id, CASE WHEN {trim('raw_text')} = '' THEN 'empty' WHEN length(raw_text) < 10 THEN 'too_short' WHEN length(raw_text) > 20000 THEN 'too_long' ELSE 'accepted' END AS outcome FROM materials""")
def admit(spark, sf):
    ok, rejected = M.admit(materials(spark, sf), hi=cfg.MAX_SAMPLE_CHARS)
    return ok.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(rejected.select("doc_id", F.col("reason").alias("outcome")))


@query("s03_profile_text", f"""
SELECT doc_id, source_type, word_count, CAST(length({trim('raw_text')}) AS INT) AS character_count, coalesce(list_items, 0) AS list_items, is_scanned, word_count = 0 AS is_empty,
  concat_ws('|', CASE WHEN word_count > 3000 THEN 'El material es extenso (' || word_count || ' palabras): se analizan las primeras 3000.' END,
    CASE WHEN word_count = 0 THEN 'El texto no contiene palabras reconocibles.' END, CASE WHEN is_scanned THEN 'El documento parece escaneado.' END,
    CASE WHEN image_count > 0 THEN 'Se detectaron ' || image_count || ' imagen(es) en el documento.' END) AS warnings
FROM sized LEFT JOIN (SELECT doc_id, list_items FROM paragraph_facts) USING (doc_id)""")
def profile_text(spark, sf):
    return M.profile_text(materials(spark, sf)).withColumn("warnings", F.array_join("warnings", "|"))


@query("s04_truncate_words", f"""
SELECT doc_id, {wc('raw_text')} > 3000 AS is_truncated, CASE WHEN {wc('raw_text')} > 3000 THEN list_aggregate(regexp_extract_all(raw_text, '{WORD}')[1:3000], 'string_agg', ' ') ELSE {trim('raw_text')} END AS analysis_text
FROM materials""")
def truncate_words(spark, sf):
    return M.analysis_text(materials(spark, sf)).select("doc_id", "is_truncated", "analysis_text")


@query("s05_reflow")
def reflow(spark, sf):
    return M.reflow(materials(spark, sf))


@query("s06_extract_blocks")
def extract_blocks(spark, sf):
    return M.extract_blocks(table(spark, sf, "pages"))


@query("s06_join_blocks")
def join_blocks(spark, sf):
    return M.join_blocks(M.extract_blocks(table(spark, sf, "pages")))


_ALT = r"((coalesce(trim(alt), '') <> '' AND NOT regexp_matches(trim(alt), '(?i)^[\w\-. ]+\.(?:png|jpe?g|gif|bmp|tiff?|emf|wmf|svg|webp)$')) OR decorative)"


@query("s07_image_inventory", f"""
SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE {_ALT}) AS with_alt, count(*) FILTER (WHERE NOT {_ALT}) AS pending FROM images GROUP BY 1""")
def image_inventory(spark, sf):
    return M.image_inventory(entity(spark, sf, "images"))


_RELEVANT = "relevant_pictures"


@query("s08_relevant_images", f"SELECT doc_id, image_id, page_number, image_index, position FROM {_RELEVANT}")
def relevant_images(spark, sf):
    return M.relevant_images(entity(spark, sf, "images")).select("doc_id", "image_id", "page_number", "image_index", "position")


@query("s09_scanned_flag", f"SELECT doc_id, {wc('raw_text')} = 0 OR ({wc('raw_text')} < 25 AND image_count >= page_count) AS scanned FROM materials")
def scanned_flag(spark, sf):
    return M.scanned_documents(materials(spark, sf))


@query("s10_upsert", """
SELECT file_id, status, size_bytes FROM files WHERE file_id % 3 <> 0
UNION ALL SELECT file_id, CASE WHEN file_id % 6 = 0 THEN 'second' ELSE 'first' END, size_bytes + CASE WHEN file_id % 6 = 0 THEN 2 ELSE 1 END FROM files WHERE file_id % 3 = 0
UNION ALL SELECT file_id + 1000000000, 'first', size_bytes + 1 FROM files WHERE file_id % 7 = 0""")
def upsert(spark, sf):
    files = entity(spark, sf, "files").select("file_id", "status", "size_bytes")
    first = files.filter("file_id % 3 = 0").select("file_id", F.lit("first").alias("status"), (F.col("size_bytes") + 1).alias("size_bytes"), F.lit(1).alias("at"))
    second = files.filter("file_id % 6 = 0").select("file_id", F.lit("second").alias("status"), (F.col("size_bytes") + 2).alias("size_bytes"), F.lit(2).alias("at"))
    new = files.filter("file_id % 7 = 0").select((F.col("file_id") + 1_000_000_000).alias("file_id"), F.lit("first").alias("status"), (F.col("size_bytes") + 1).alias("size_bytes"), F.lit(1).alias("at"))
    batch = first.unionByName(second).unionByName(new)
    return tables.upsert(files, batch, ["file_id"], F.col("at")).select("file_id", "status", "size_bytes")


@query("s10_upsert_stored", """
SELECT file_id, CASE WHEN file_id % 1000 < 5 THEN 'late' ELSE status END AS status, size_bytes + CASE WHEN file_id % 1000 < 5 THEN 3 ELSE 0 END AS size_bytes FROM files
UNION ALL SELECT max(file_id) + 1, 'late', CAST(7 AS BIGINT) FROM files""")
def upsert_stored(spark, sf):
    files = entity(spark, sf, "files").select("file_id", "status", "size_bytes")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}/files"
    tables.upsert_stored(files, folder, ["file_id"])
    changed = files.filter("file_id % 1000 < 5").select("file_id", F.lit("late").alias("status"), (F.col("size_bytes") + 3).alias("size_bytes"), F.lit(1).alias("at"))
    earlier = changed.withColumns({"status": F.lit("early"), "at": F.lit(0)})
    new = files.agg((F.max("file_id") + 1).alias("file_id")).select("file_id", F.lit("late").alias("status"), F.lit(7).cast("long").alias("size_bytes"), F.lit(0).alias("at"))
    tables.upsert_stored(changed.unionByName(earlier).unionByName(new), folder, ["file_id"], "at")
    return versioned.read(spark, folder)


@query("s11_copy_tables", "SELECT count(*) AS rows_in_source, count(*) AS rows_in_target, true AS complete FROM files")
def copy_tables(spark, sf):
    folder = f"{checkpoint_dir(spark).rstrip('/')}/copies/{spark.sparkContext.applicationId}/files"
    return tables.copy_table(spark, entity(spark, sf, "files"), folder, ["file_id"], force=True)


# --- proposals derived from the log and the model findings ----------------------------------------------

def current(spark, sf):
    return decisions.current_status(entity(spark, sf, "decision_log"))


def proposals(spark, sf):
    """Proposals on model findings: quote from the finding, state from the log, text from the deterministic rewrite."""
    quotes = entity(spark, sf, "ai_findings").select(
        "doc_id", F.concat(F.lit("bar-"), F.col("pos").cast("string")).alias("barrier_id"), F.regexp_replace("original_text", r"\.\.\.$", "").alias("original_text"))
    joined = current(spark, sf).join(quotes, ["doc_id", "barrier_id"])
    proposed = decisions.rewrite(F.col("original_text"), F.col("adaptation_type"))
    edited = F.concat(F.lit("[editado] "), "original_text")
    return joined.withColumn("replacement", F.when(F.col("status") == "editada", edited).otherwise(proposed))


def barriers(spark, sf):
    return entity(spark, sf, "ai_findings").select("doc_id", F.concat(F.lit("bar-"), F.col("pos").cast("string")).alias("barrier_id"), F.col("pos").alias("n"), "original_text")


@query("s12_export_text")
def export_text(spark, sf):
    return tables.export_text(closing_report.final_version(materials(spark, sf), proposals(spark, sf)), "md")


_CURRENT = "(SELECT doc_id, proposal_id, barrier_id, arg_max(adaptation_type, seq) AS adaptation_type, arg_max(to_status, seq) AS status FROM decision_log GROUP BY 1, 2, 3)"
_PRIORITY = "list_position(['editada', 'aceptada', 'descartada', 'pendiente'], status)"
_RESOLUTION = f"""(SELECT b.doc_id, b.barrier_id, p.proposal_id, coalesce(p.status, 'pendiente') AS resolution_status FROM (SELECT doc_id, 'bar-' || pos AS barrier_id FROM ai_findings) b
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, barrier_id ORDER BY {_PRIORITY}, proposal_id) AS rk FROM {_CURRENT}) p ON p.doc_id = b.doc_id AND p.barrier_id = b.barrier_id AND p.rk = 1)"""


# --- merge ----------------------------------------------------------------------------------------------

@query("f01_cap_per_document", f"SELECT doc_id, pos, category, severity, issue, original_text FROM ai_findings WHERE pos <= {cfg.MODEL_FINDINGS_PER_DOCUMENT}")
def cap_per_document(spark, sf):
    return merge.cap_per_document(entity(spark, sf, "ai_findings"))


@query("f02_verify_quotes")
def verify_quotes(spark, sf):
    return merge.verify_quotes(entity(spark, sf, "ai_findings"), materials(spark, sf)).select("doc_id", "pos", "fragment_found")


@query("f02_unverified_counts")
def unverified_counts(spark, sf):
    return merge.unverified_counts(merge.verify_quotes(entity(spark, sf, "ai_findings"), materials(spark, sf)))


def _rule_findings(spark, sf):
    return cut(diagnosis.all_findings(rule_queries.inputs(spark, sf)))


@query("f03_suppress_covered")
def suppress_covered(spark, sf):
    verified = merge.verify_quotes(entity(spark, sf, "ai_findings"), materials(spark, sf))
    return merge.suppress_covered(_rule_findings(spark, sf), verified).select("doc_id", "rule", "pos", "severity", "original_text")


def _repeated(spark, sf):
    """Model findings twice over, so there is something to drop."""
    found = entity(spark, sf, "ai_findings").select("doc_id", "pos", "issue", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("original_text")).alias("original_text"))
    return found.unionByName(found.withColumn("pos", F.col("pos") + 10))


@query("f04_drop_repeated", f"""
SELECT doc_id, pos, issue, original_text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, {collapse("lower(original_text)")}, issue ORDER BY pos) AS copy FROM (
    SELECT doc_id, pos, issue, CASE WHEN doc_id % 5 = 0 THEN '' ELSE original_text END AS original_text FROM ai_findings
    UNION ALL SELECT doc_id, pos + 10, issue, CASE WHEN doc_id % 5 = 0 THEN '' ELSE original_text END FROM ai_findings))
WHERE copy = 1 OR {collapse('original_text')} = ''""")
def drop_repeated(spark, sf):
    return merge.drop_repeated(_repeated(spark, sf), ["pos"]).select("doc_id", "pos", "issue", "original_text")


@query("f05_order_and_number", """
SELECT doc_id, 'bar-' || row_number() OVER (PARTITION BY doc_id ORDER BY severity <> 'barrera_detectada', rule_order, pos) AS barrier_id, rule, pos, severity FROM findings""")
def order_and_number(spark, sf):
    tagged = _rule_findings(spark, sf).withColumn("origin", F.lit(merge.RULES))
    return merge.order_and_number(tagged).select("doc_id", "barrier_id", "rule", "pos", "severity")


def _signal(flag: str, order: int, title: str) -> str:
    return f"SELECT doc_id, CAST({order} AS INT) AS rule_order, image_id AS pos, '{title} (Página ' || page_number || ', ' || position || ')' AS issue FROM {_RELEVANT} WHERE {flag}"


@query("f06_vision_signal_findings", _signal("relies_on_color", 1, "Imagen con información dependiente solo del color") + " UNION ALL "
       + _signal("has_untranscribed_text", 2, "Imagen con texto incrustado ausente en el documento"))
def vision_signal_findings(spark, sf):
    return merge.vision_signal_findings(M.relevant_images(entity(spark, sf, "images"))).select("doc_id", "rule_order", "pos", "issue")


@query("f07_fallback_diagnosis", """
SELECT doc_id, ai_score, CASE WHEN ai_score IS NULL THEN 'rules' ELSE 'ai' END AS provider, CASE WHEN ai_score IS NULL THEN 0.0 ELSE 0.7 END::DOUBLE AS ai_weight,
  CASE WHEN ai_score IS NULL THEN 1.0 ELSE 0.3 END::DOUBLE AS rules_weight FROM materials LEFT JOIN ai_scores USING (doc_id)""")
def fallback_diagnosis(spark, sf):
    return merge.fallback_diagnosis(materials(spark, sf), entity(spark, sf, "ai_scores"))


@query("f08_group_by_quote", f"""
SELECT doc_id, key AS quote_key, min(pos) AS first, count(*) AS findings, {counts_sql('resolution_status', cfg.PROPOSAL_STATUSES)} FROM (
  SELECT a.doc_id, a.pos, r.resolution_status, CASE WHEN coalesce(a.original_text, '') = '' THEN 'global:bar-' || a.pos
    ELSE {collapse("regexp_replace(replace(lower(a.original_text), '…', '...'), '[\"''“”‘’«»]', '', 'g')")} END AS key
  FROM ai_findings a JOIN {_RESOLUTION} r ON r.doc_id = a.doc_id AND r.barrier_id = 'bar-' || a.pos) GROUP BY 1, 2""")
def group_by_quote(spark, sf):
    return merge.group_by_quote(decisions.barrier_resolution(barriers(spark, sf), current(spark, sf)))


@query("f09_merged_findings")
def merged_findings(spark, sf):
    vision = merge.vision_signal_findings(M.relevant_images(entity(spark, sf, "images")))
    return merge.merge_findings(entity(spark, sf, "ai_findings"), vision, _rule_findings(spark, sf), materials(spark, sf)).select(
        "doc_id", "barrier_id", "source", "category", "severity", "issue", "original_text", "fragment_found")


# --- personal data ----------------------------------------------------------------------------------------

def pii(spark, sf):
    return privacy.detect_pii(materials(spark, sf))


@query("p01_detect_pii")
def detect_pii(spark, sf):
    return pii(spark, sf)


@query("p02_resolve_overlaps")
def resolve_overlaps(spark, sf):
    found = P.personal_data(materials(spark, sf).select("doc_id", "raw_text"), "raw_text", "found")
    return found.select("doc_id", F.size("found").alias("findings"), F.to_json(F.transform("found", lambda m: F.struct(m["start"], m["end"], m["type"]))).alias("spans"))


@query("p03_accept_lowercase_name")
def accept_lowercase_name(spark, sf):
    values = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("value")).filter("value <> ''")
    return values.select("conv_id", "turn", P.accept_lowercase_name(F.col("value")).alias("accepted"))


_DIGITS = r"regexp_extract(value, '^([^0-9]*[0-9])(.*)([0-9][^0-9]*)$', {0})"


@query("p04_mask", f"""
SELECT kind, c_custkey AS id, CASE kind WHEN 'dni' THEN {_DIGITS.format(1)} || regexp_replace({_DIGITS.format(2)}, '[0-9]', '*', 'g') || {_DIGITS.format(3)}
  WHEN 'nombre_rotulado' THEN list_aggregate(list_transform(regexp_extract_all(value, '{NOT_WS}+'), lambda w: w[1] || '***'), 'string_agg', ' ') ELSE '***' END AS masked FROM (
  SELECT c_custkey, 'dni' AS kind, CAST(20000000 + c_custkey * 7919 % 9999999 AS STRING) AS value FROM customer
  UNION ALL SELECT c_custkey, 'nombre_rotulado', c_name || ' Apellido' FROM customer UNION ALL SELECT c_custkey, 'calificacion', '10' FROM customer)""")
def mask(spark, sf):
    base = table(spark, sf, "customer")
    values = (
        base.selectExpr("c_custkey", "'dni' as kind", "cast(20000000 + c_custkey * 7919 % 9999999 as string) as value")
        .unionByName(base.selectExpr("c_custkey", "'nombre_rotulado' as kind", "c_name || ' Apellido' as value"))
        .unionByName(base.selectExpr("c_custkey", "'calificacion' as kind", "'10' as value")))
    return values.select("kind", F.col("c_custkey").alias("id"), P.mask(F.col("kind"), F.col("value")).alias("masked"))


def _dismissed(found):
    """Reviewers of half the documents dismissed everything found there."""
    return found.filter("doc_id % 20 = 3")


@query("p05_gate_pii")
def gate_pii(spark, sf):
    judged = cut(privacy.with_findings(materials(spark, sf)).select("doc_id", "findings"))
    found = judged.select("doc_id", F.inline("findings"))
    return privacy.route(judged, _dismissed(found)).select("doc_id", F.when(F.col("blocked"), "blocked").otherwise("clear").alias("route"))


@query("p06_pii_report")
def pii_report(spark, sf):
    return privacy.report_of(privacy.with_findings(materials(spark, sf)))


def _redact_sql() -> str:
    sql = "SELECT doc_id, raw_text AS redacted, 0 AS hidden FROM materials"
    for pattern, replacement in P.SECRET_RULES:
        p = pattern.replace("'", "''")
        r = replacement.replace("$", "\\")
        sql = (f"SELECT doc_id, regexp_replace(redacted, '{p}', '{r}', 'g') AS redacted, hidden + CAST(len(list_filter(regexp_extract_all(redacted, '{p}'), "
               f"lambda m: NOT contains(m, '{P.HIDDEN}'))) AS INT) AS hidden FROM ({sql})")
    return sql


@query("p07_redact_secrets", _redact_sql())
def redact_secrets(spark, sf):
    return privacy.redact_secrets(materials(spark, sf).select("doc_id", "raw_text"), "raw_text").select("doc_id", "redacted", "hidden")


# --- decisions --------------------------------------------------------------------------------------------

@query("d01_resolve_fragment")
def resolve_fragment(spark, sf):
    quotes = entity(spark, sf, "ai_findings").select(
        "doc_id", F.col("pos").alias("quote_id"), "original_text", F.when(F.col("doc_id") % 2 == 0, "consigna_en_pasos").otherwise("lenguaje_claro").alias("adaptation_type"))
    return decisions.resolve_fragment(materials(spark, sf), quotes)


@query("d02_rewrite")
def rewrite(spark, sf):
    kinds = F.array(*[F.lit(k) for k in cfg.ADAPTATION_TYPES])
    return materials(spark, sf).select("doc_id", F.inline(decisions.rewrite_each(F.col("raw_text"), kinds)))


@query("d03_current_status", f"SELECT doc_id, proposal_id, barrier_id, adaptation_type, status FROM {_CURRENT}")
def current_status(spark, sf):
    return current(spark, sf).drop("decided_at")


@query("d04_invalid_transitions", f"""
SELECT proposal_id, from_status, previous_status, to_status, {iso_sql('created_at')} AS created_at FROM (
  SELECT *, lag(to_status) OVER (PARTITION BY proposal_id ORDER BY seq) AS previous_status FROM decision_log) WHERE from_status <> previous_status""")
def invalid_transitions(spark, sf):
    return decisions.invalid_transitions(entity(spark, sf, "decision_log")).select(
        "proposal_id", "from_status", "previous_status", "to_status", iso(F.col("created_at")).alias("created_at"))


@query("d05_pending_conflicts", f"SELECT doc_id, barrier_id, count(*) AS pending FROM {_CURRENT} WHERE status = 'pendiente' GROUP BY 1, 2 HAVING count(*) > 1")
def pending_conflicts(spark, sf):
    return decisions.pending_conflicts(current(spark, sf))


@query("d06_decision_log", f"SELECT doc_id, proposal_id, to_status, {iso_sql('created_at')} AS created_at FROM decision_log")
def decision_log(spark, sf):
    return decisions.decision_history(entity(spark, sf, "decision_log")).select("doc_id", "proposal_id", "to_status", iso(F.col("created_at")).alias("created_at"))


@query("d07_select_replacements")
def select_replacements(spark, sf):
    return decisions.select_replacements(decisions.proposal_spans(proposals(spark, sf), materials(spark, sf)))


@query("d08_apply_replacements")
def apply_replacements(spark, sf):
    adapted, _ = closing_report.adapted_documents(materials(spark, sf), proposals(spark, sf))
    return adapted.select("doc_id", "adapted_text")


@query("d09_final_version_counts")
def final_version_counts(spark, sf):
    found = proposals(spark, sf)
    _, verdicts = closing_report.adapted_documents(materials(spark, sf), found)
    return decisions.final_version_counts(found, verdicts)


@query("d10_barrier_resolution", f"SELECT doc_id, barrier_id, proposal_id, resolution_status FROM {_RESOLUTION}")
def barrier_resolution(spark, sf):
    return decisions.barrier_resolution(barriers(spark, sf), current(spark, sf)).select("doc_id", "barrier_id", "proposal_id", "resolution_status")


def _before(spark, sf):
    return diagnosis.scores_and_penalties(rule_queries.inputs(spark, sf), entity(spark, sf, "ai_scores"))


@query("c10_score_after")
def score_after(spark, sf):
    from lumbrera.operators import scoring

    scores, penalties = _before(spark, sf)
    adapted, _ = closing_report.adapted_documents(materials(spark, sf), proposals(spark, sf))
    return scoring.score_after(scores, penalties, adapted)


@query("d11_final_report")
def final_report(spark, sf):
    scores, penalties = _before(spark, sf)
    return closing_report.final_report(scores, penalties, materials(spark, sf), proposals(spark, sf), barriers(spark, sf))


_LABEL = "CASE adaptation_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in decisions.TYPE_LABELS.items()) + " END"


@query("d12_executive_summary", f"""
SELECT m.doc_id, coalesce(nullif(concat_ws('|', a.texts, CASE WHEN r.pending > 0 THEN 'Quedaron ' || r.pending || ' barrera(s) sin decisión tomada: el texto original se preserva en esas secciones.' END,
  CASE WHEN r.discarded > 0 THEN 'El docente optó por mantener el texto original en ' || r.discarded || ' barrera(s) detectada(s).' END), ''), 'No se aplicaron adaptaciones en este material.') AS summary
FROM materials m LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN n = 1 THEN 'Se aplicó 1 adaptación de ' || label || '.' ELSE 'Se aplicaron ' || n || ' adaptaciones de ' || label || '.' END, '|' ORDER BY n DESC, lead) AS texts FROM (
    SELECT doc_id, {_LABEL} AS label, count(*) AS n, min(proposal_id) AS lead FROM {_CURRENT} WHERE status IN ('aceptada', 'editada') GROUP BY 1, 2) GROUP BY 1) a USING (doc_id)
LEFT JOIN (SELECT doc_id, {counts_sql('resolution_status', ('pendiente', 'descartada')).replace('AS pendiente', 'AS pending').replace('AS descartada', 'AS discarded')} FROM {_RESOLUTION} GROUP BY 1) r USING (doc_id)""")
def executive_summary(spark, sf):
    resolution = decisions.barrier_resolution(barriers(spark, sf), current(spark, sf))
    found = decisions.executive_summary(materials(spark, sf), current(spark, sf), resolution)
    return found.withColumn("summary", F.array_join("summary", "|"))
