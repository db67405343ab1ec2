"""Segmentation, scalar functions and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.bindings import entity, table
from lumbrera.functions import color as C
from lumbrera.functions import text as T
from lumbrera.operators import rules_text, segments
from lumbrera.queries.oracle_rules import DECORATIVE, LINEAR, luminance, rgb, simulated
from lumbrera.queries.oracle_views import NOT_WS, WORD, WS, collapse, excerpt, is_action, syllables, trim, wc
from lumbrera.queries.registry import query


@query("t01_words", rf"""
SELECT doc_id, {wc('raw_text')} AS words, list_aggregate(regexp_extract_all(raw_text, '{WORD}'), 'string_agg', '|') AS tokens FROM materials""")
def words(spark, sf):
    return entity(spark, sf, "materials").select(
        "doc_id",
        T.count_words(F.col("raw_text")).alias("words"),
        F.nullif(F.array_join(T.words(F.col("raw_text")), "|"), F.lit("")).alias("tokens"),
    )


@query("t02_paragraphs", "SELECT doc_id, pos, text FROM paragraphs")
def paragraphs(spark, sf):
    return segments.paragraphs(entity(spark, sf, "materials"))


@query("t03_sentences", "SELECT doc_id, para, pos, text FROM sentences")
def sentences(spark, sf):
    return segments.sentences(segments.paragraphs(entity(spark, sf, "materials")))


@query("t04_excerpt", f"SELECT doc_id, pos, {excerpt('text', 25)} AS excerpt FROM paragraphs")
def excerpts(spark, sf):
    return segments.paragraphs(entity(spark, sf, "materials")).select("doc_id", "pos", T.excerpt(F.col("text")).alias("excerpt"))


@query("t05_clip", f"""
SELECT doc_id, CASE WHEN length(line) <= 80 THEN line ELSE rtrim(line[1:79]) || '…' END AS clipped
FROM (SELECT doc_id, {collapse('raw_text')} AS line FROM materials)""")
def clip(spark, sf):
    return entity(spark, sf, "materials").select("doc_id", T.clip(F.col("raw_text"), cfg.MAP_TEXT_CHARS).alias("clipped"))


@query("t06_word_excerpt", f"""
SELECT doc_id, pos, coalesce(list_aggregate(ts[1:40], 'string_agg', ' '), '') || CASE WHEN len(ts) > 40 THEN '…' ELSE '' END AS excerpt
FROM (SELECT doc_id, pos, regexp_extract_all(text, '{NOT_WS}+') AS ts FROM paragraphs)""")
def word_excerpt(spark, sf):
    return segments.paragraphs(entity(spark, sf, "materials")).select("doc_id", "pos", T.word_excerpt(F.col("text")).alias("excerpt"))


@query("t07_syllables", f"""
SELECT word, CAST({syllables('word')} AS INT) AS syllables, CAST(n AS BIGINT) AS n FROM (SELECT word, count(*) AS n FROM doc_words GROUP BY word)""")
def syllable_counts(spark, sf):
    tokens = entity(spark, sf, "materials").select(F.explode(T.words(F.col("raw_text"))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n")).select("word", T.syllables_es(F.col("word")).alias("syllables"), "n")


def _norm(expr: str) -> str:
    return collapse(f"regexp_replace(lower(nfc_normalize({expr})), '[\"''“”‘’«»]', '', 'g')")


# No value of the given tables changes under NFKC but for the ellipsis.
@query("t08_normalize_quote", f"SELECT doc_id, {_norm("replace(raw_text, '…', '...')")} AS normal FROM materials")
def normalize_quote(spark, sf):
    return entity(spark, sf, "materials").select("doc_id", T.normalize_quote(F.col("raw_text")).alias("normal"))


@query("t09_fragment_parts", f"""
SELECT doc_id, pos, array_to_string(list_filter(list_transform(string_split({_norm("regexp_replace(original_text, '[.]{3}|…', chr(1), 'g')")}, chr(1)), lambda x: {trim('x')}), lambda x: x <> ''), '|') AS parts
FROM ai_findings""")
def fragment_parts(spark, sf):
    return entity(spark, sf, "ai_findings").select("doc_id", "pos", F.array_join(T.fragment_parts(F.col("original_text")), "|").alias("parts"))


@query("t10_is_placeholder", r"""
SELECT conv_id, turn, '[' || trim(text) || ']' LIKE '[%]' AS bracketed, regexp_matches(text, '^\s*\[.*\]\s*$', 's') AS placeholder FROM conversations""")
def is_placeholder(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        T.is_placeholder(F.concat(F.lit("["), F.trim("text"), F.lit("]"))).alias("bracketed"),
        T.is_placeholder(F.col("text")).alias("placeholder"),
    )


@query("t11_find_span", """
SELECT doc_id, pos, CAST(nullif(place, 0) - 1 AS INT) AS "start", CAST(nullif(place, 0) - 1 + length(quote) AS INT) AS "end" FROM (
  SELECT doc_id, pos, quote, CASE WHEN trim(quote) = '' THEN 0 ELSE strpos(raw_text, quote) END AS place FROM (SELECT doc_id, pos, regexp_replace(original_text, '[.]{3}$', '') AS quote FROM ai_findings) JOIN materials USING (doc_id))""")
def find_span(spark, sf):
    quotes = entity(spark, sf, "ai_findings").select("doc_id", "pos", F.regexp_replace("original_text", r"\.\.\.$", "").alias("quote"))
    docs = entity(spark, sf, "materials").select("doc_id", "raw_text")
    return quotes.join(docs, "doc_id").select("doc_id", "pos", T.find_span(F.col("raw_text"), F.col("quote")).alias("span")).select(
        "doc_id", "pos", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


@query("t12_context_around", f"""
SELECT doc_id, quote_id, concat_ws(chr(10) || '[...]' || chr(10), right(prev_text, 600), left(next_text, 600)) AS context FROM (
  SELECT q.doc_id, q.pos AS quote_id, p.pos AS para, p.prev_text, p.next_text,
    row_number() OVER (PARTITION BY q.doc_id, q.pos ORDER BY p.pos) AS rn
  FROM (SELECT doc_id, pos, list_filter(list_transform(string_split_regex(original_text, '[.]{{3}}|…'), lambda x: {_norm('x')}), lambda x: x <> '')[1] AS part FROM ai_findings) q
  JOIN (SELECT doc_id, pos, {_norm('text')} AS norm, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM paragraphs
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) p ON p.doc_id = q.doc_id AND contains(p.norm, q.part) AND q.part <> ''
) WHERE rn = 1""")
def context_around(spark, sf):
    quotes = entity(spark, sf, "ai_findings").select("doc_id", F.col("pos").alias("quote_id"), F.col("original_text").alias("fragment"))
    return segments.context_around(entity(spark, sf, "materials"), quotes)


def _text_and_pictures(spark, sf):
    """Paragraphs with every fifth one standing for a picture."""
    return segments.paragraphs(entity(spark, sf, "materials")).withColumn(
        "kind", F.when((F.col("doc_id") + F.col("pos")) % 5 == 3, "image").otherwise("text"))


@query("t13_image_context", f"""
SELECT doc_id, pos, CASE WHEN len(ts) > 120 THEN list_aggregate(ts[1:120], 'string_agg', ' ') || '...' ELSE snippet END AS context FROM (
  SELECT doc_id, pos, snippet, regexp_extract_all(snippet, '{NOT_WS}+') AS ts FROM (
    SELECT doc_id, pos, kind, concat_ws(' [...] ',
      last_value(CASE WHEN kind = 'text' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      first_value(CASE WHEN kind = 'text' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS snippet
    FROM (SELECT doc_id, pos, text, CASE WHEN (doc_id + pos) % 5 = 3 THEN 'image' ELSE 'text' END AS kind FROM paragraphs))
  WHERE kind = 'image')""")
def image_context(spark, sf):
    return segments.image_context(_text_and_pictures(spark, sf))


@query("t14_chunk_text")
def chunk_text(spark, sf):
    return segments.chunk_text(entity(spark, sf, "materials"), 1000)


@query("t15_file_format", """
SELECT file_id, CASE WHEN contains(filename, '.') THEN lower(split_part(filename, '.', -1)) END AS format FROM files""")
def file_format(spark, sf):
    return entity(spark, sf, "files").select("file_id", T.file_format(F.col("filename")).alias("format"))


@query("t16_action_verbs", f"""
SELECT m.doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(verbs, '') AS verbs FROM materials m LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(word, '|' ORDER BY i) AS verbs FROM (
    SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (
      SELECT doc_id, regexp_extract_all(lower(raw_text), '{WORD}') AS ws FROM materials))
  WHERE {is_action('word')} GROUP BY doc_id) v USING (doc_id)""")
def action_verbs(spark, sf):
    return entity(spark, sf, "materials").select("doc_id", T.action_verbs(F.col("raw_text")).alias("v")).select(
        "doc_id", F.size("v").alias("n"), F.array_join("v", "|").alias("verbs"))


@query("t17_contrast_ratio", f"""
SELECT color, background, n, round_even((greatest(la, lb) + 0.05) / (least(la, lb) + 0.05), 6) AS ratio FROM (
  SELECT color, background, n, {luminance('color')} AS la, {luminance('background')} AS lb FROM (
    SELECT color, background, count(*) AS n FROM fragments WHERE color IS NOT NULL GROUP BY color, background))""")
def contrast_ratio(spark, sf):
    pairs = entity(spark, sf, "fragments").filter("color is not null").groupBy("color", "background").agg(F.count("*").alias("n"))
    pairs = pairs.withColumns({"a": C.parse_hex(F.col("color")), "b": C.parse_hex(F.col("background"))})
    return pairs.select("color", "background", "n", F.bround(C.contrast_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def _cvd_sql() -> str:
    seen = ", ".join(f"round_even({simulated(kind, c)}, 4) AS {kind}_{c}" for kind in cfg.CVD_MATRICES for c in "rgb")
    lin = ", ".join(f"({LINEAR.format(c=rgb('color', at))}) AS l{c}" for c, at in (("r", 2), ("g", 4), ("b", 6)))
    return f"SELECT color, n, {seen} FROM (SELECT color, n, {lin} FROM (SELECT color, count(*) AS n FROM fragments WHERE color IS NOT NULL GROUP BY color))"


@query("t18_simulate_cvd", _cvd_sql())
def simulate_cvd(spark, sf):
    colors = entity(spark, sf, "fragments").filter("color is not null").groupBy("color").agg(F.count("*").alias("n"))
    seen = colors.withColumn("rgb", C.parse_hex(F.col("color")))
    for kind in cfg.CVD_MATRICES:
        seen = seen.withColumn(kind, C.simulate(F.col("rgb"), kind))
    return seen.select("color", "n", *[
        F.bround(F.col(f"{kind}.{c}"), 4).alias(f"{kind}_{c}") for kind in cfg.CVD_MATRICES for c in "rgb"])


@query("t19_is_decorative_font", f"SELECT font, n, {DECORATIVE} AS decorative FROM (SELECT font, count(*) AS n FROM fragments GROUP BY font)")
def is_decorative_font(spark, sf):
    fonts = entity(spark, sf, "fragments").groupBy("font").agg(F.count("*").alias("n"))
    return fonts.select("font", "n", C.is_decorative_font(F.col("font")).alias("decorative"))


@query("t20_caps_counts", rf"""
SELECT doc_id, pos, CAST(len(list_filter(ls, lambda w: regexp_full_match(w, '\p{{Lu}}+'))) AS INT) AS caps, CAST(len(ls) AS INT) AS counted FROM (
  SELECT doc_id, pos, list_filter(list_transform(regexp_extract_all(text, '{NOT_WS}+'), lambda w: regexp_replace(w, '[^\p{{L}}]+', '', 'g')), lambda w: length(w) >= 2) AS ls
  FROM paragraphs)""")
def caps_counts(spark, sf):
    return segments.paragraphs(entity(spark, sf, "materials")).select(
        "doc_id", "pos", T.caps_counts(F.col("text")).alias("c")).select("doc_id", "pos", "c.caps", "c.counted")


# --- rules -------------------------------------------------------------------------------------------

_TOP = "row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, pos)"


def _findings(spark, sf, *rules):
    """Findings of rules that need the text only."""
    return rules_text.run(rules_text.plain_profile(entity(spark, sf, "materials")), *rules).drop("rule_order", "rule")


def _structure_findings(spark, sf, *rules):
    assessed = rules_text.assess(entity(spark, sf, "materials"), entity(spark, sf, "headings"))
    return rules_text.run(assessed, *rules).drop("rule_order", "rule")


@query("r01_long_sentences", f"""
SELECT doc_id, CAST(rn AS INT) AS pos, 'comprension' AS category,
  CASE WHEN words >= 50 THEN 'barrera_detectada' ELSE 'para_revisar' END AS severity,
  'Oración extensa (' || words || ' palabras)' AS issue, text AS original_text, text AS anchor
FROM (SELECT *, {_TOP} AS rn FROM doc_sentences WHERE words > 35) WHERE rn <= 3""")
def r_long_sentences(spark, sf):
    return _findings(spark, sf, "long_sentences")


@query("r02_long_paragraphs", f"""
SELECT doc_id, CAST(rn AS INT) AS pos, 'estructura' AS category,
  CASE WHEN words >= 250 THEN 'barrera_detectada' ELSE 'para_revisar' END AS severity,
  'Párrafo extenso sin divisiones (' || words || ' palabras)' AS issue, {excerpt('text', 25)} AS original_text, text AS anchor
FROM (SELECT *, {_TOP} AS rn FROM paragraphs WHERE words > 150) WHERE rn <= 3""")
def r_long_paragraphs(spark, sf):
    return _findings(spark, sf, "long_paragraphs")


@query("r03_multi_action_prompts", f"""
SELECT doc_id, CAST(rn AS INT) AS pos, 'comprension' AS category,
  CASE WHEN actions >= 4 THEN 'barrera_detectada' ELSE 'para_revisar' END AS severity,
  'Consigna con múltiples acciones (' || actions || ' acciones simultáneas)' AS issue, {excerpt('text', 30)} AS original_text, text AS anchor
FROM (SELECT s.doc_id, s.text, a.actions, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS rn
  FROM doc_sentences s JOIN sentence_actions a ON a.doc_id = s.doc_id AND a.pos = s.pos WHERE a.actions >= 3) WHERE rn <= 3""")
def r_multi_action(spark, sf):
    return _findings(spark, sf, "multi_action_prompts")


@query("r04_readability", "SELECT m.doc_id, readability FROM materials m LEFT JOIN readable USING (doc_id)")
def r_readability(spark, sf):
    return segments.profile(entity(spark, sf, "materials")).select("doc_id", "readability")


@query("r05_visual_references", """
SELECT doc_id, pos, 'accesibilidad_visual' AS category, 'para_revisar' AS severity,
  'Referencia basada únicamente en la posición o aspecto visual' AS issue, frag AS original_text, frag AS anchor FROM visual_refs""")
def r_visual(spark, sf):
    return _findings(spark, sf, "visual_references")


@query("r06_color_only_references", """
SELECT doc_id, pos, 'accesibilidad_visual' AS category, 'para_revisar' AS severity,
  'Información transmitida solo mediante color (WCAG 1.4.1)' AS issue, frag AS original_text, frag AS anchor FROM color_refs""")
def r_color(spark, sf):
    return _findings(spark, sf, "color_only_references")


@query("r07_scanned_or_no_alt", """
SELECT doc_id, CAST(1 AS INT) AS pos, 'accesibilidad_visual' AS category,
  CASE WHEN is_scanned THEN 'barrera_detectada' ELSE 'para_revisar' END AS severity,
  CASE WHEN is_scanned THEN 'PDF escaneado sin capa de texto' ELSE 'Imágenes sin descripción verificable' END AS issue,
  CASE WHEN is_scanned THEN '[Documento completo: PDF]'
    WHEN images_with_alt_text > 0 THEN '[' || (image_count - images_with_alt_text) || ' imagen(es) sin texto alternativo en el documento]'
    ELSE '[' || image_count || ' imagen(es) en el documento]' END AS original_text, CAST(NULL AS STRING) AS anchor
FROM sized WHERE is_scanned OR image_count > images_with_alt_text""")
def r_scanned(spark, sf):
    return _findings(spark, sf, "scanned_or_no_alt")


@query("r08_no_headings", """
SELECT doc_id, CAST(1 AS INT) AS pos, 'estructura' AS category, 'barrera_detectada' AS severity,
  'Documento extenso sin títulos ni estructura definida' AS issue,
  '[Documento ' || upper(source_type) || ': ' || page_count || ' ' || CASE source_type WHEN 'pptx' THEN 'diapositiva(s)' ELSE 'página(s)' END
    || ', ' || word_count || ' palabras]' AS original_text, CAST(NULL AS STRING) AS anchor
FROM sized WHERE source_type <> 'text' AND NOT is_scanned AND word_count >= 150 AND doc_id NOT IN (SELECT doc_id FROM headings)""")
def r_no_headings(spark, sf):
    return _structure_findings(spark, sf, "no_headings")


@query("r09_heading_skips", """
SELECT doc_id, CAST(rn AS INT) AS pos, 'estructura' AS category, 'para_revisar' AS severity,
  'Salto de jerarquía en títulos (de H' || previous_level || ' a H' || level || ')' AS issue, text AS original_text, text AS anchor
FROM (SELECT h.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM heading_steps h JOIN sized z USING (doc_id)
  WHERE level > previous_level + 1 AND z.source_type <> 'text' AND NOT z.is_scanned) WHERE rn <= 2""")
def r_heading_skips(spark, sf):
    return _structure_findings(spark, sf, "heading_skips")


@query("r10_long_sections", f"""
SELECT doc_id, CAST(rn AS INT) AS pos, 'estructura' AS category, 'para_revisar' AS severity,
  'Sección extensa sin subdivisiones (' || words || ' palabras)' AS issue, {excerpt('head', 15)} AS original_text, head AS anchor
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS rn FROM long_section_rows) WHERE rn <= 3""")
def r_long_sections(spark, sf):
    return _structure_findings(spark, sf, "long_sections")
