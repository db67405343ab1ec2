"""Oracle views of references, layout rules, findings, penalties and scores."""

from __future__ import annotations

from lumbrera import config as cfg
from lumbrera.queries.oracle_views import NOT_WS, VIEWS, WORD, excerpt, quoted, trim, wc


def rgb(col: str, at: int) -> str:
    return f"CAST('0x' || substring({col}, {at}, 2) AS INT)"


LINEAR = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
SRGB = "255.0::DOUBLE * (CASE WHEN {v} <= 0.0031308 THEN 12.92::DOUBLE * {v} ELSE 1.055::DOUBLE * pow({v}, 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END)"


def luminance(col: str) -> str:
    parts = [f"{w}::DOUBLE * ({LINEAR.format(c=rgb(col, at))})" for w, at in ((0.2126, 2), (0.7152, 4), (0.0722, 6))]
    return "(" + " + ".join(parts) + ")"


def simulated(kind: str, channel: str) -> str:
    """One channel of a hex colour as seen with a deficiency; needs lr, lg, lb."""
    row = cfg.CVD_MATRICES[kind]["rgb".index(channel)]
    mix = " + ".join(f"({w})::DOUBLE * l{c}" for w, c in zip(row, "rgb"))
    return SRGB.format(v=f"(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {mix})))")


FAMILY = "regexp_replace(lower(regexp_replace(regexp_replace(font, '^[A-Z]{6}[+]', ''), '[-,].*$', '')), '[^a-z0-9]', '', 'g')"
DECORATIVE = (
    f"(coalesce(regexp_matches({FAMILY}, '^(?:{'|'.join(cfg.DECORATIVE_FONTS)})') OR regexp_matches({FAMILY}, '{'|'.join(cfg.DECORATIVE_KEYWORDS)}'), false) "
    f"AND NOT coalesce(starts_with({FAMILY}, 'comicsans'), false))")


def marked(pattern: str) -> str:
    """A word pattern for text whose words are wrapped in ‹›, for an engine without Unicode word borders."""
    optional = r"(?:gr[aá]fico|imagen|figura|cuadro|tabla)?\s*"
    pattern = pattern.replace(optional, r"(?:(?:gr[aá]fico|imagen|figura|cuadro|tabla)\s+)?")
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    body = body.replace(r"\s+", "›[\\s\\p{Z}]+‹").replace(" ", "› ‹")
    return "(?i)‹" + body + "›"


def references(patterns, rule: str) -> str:
    """Distinct fragments of a pattern family, in pattern then text order, first three."""
    parts = [
        f"SELECT doc_id, {k} AS p, generate_subscripts(fs, 1) AS i, unnest(fs) AS frag FROM (SELECT doc_id, regexp_extract_all(t, '{marked(p)}') AS fs FROM word_marked)"
        for k, p in enumerate(patterns)]
    return f"""
SELECT doc_id, frag, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS INT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lower(frag) ORDER BY p, i) AS copy FROM (
    SELECT doc_id, p, i, replace(replace(frag, '‹', ''), '›', '') AS frag FROM ({' UNION ALL '.join(parts)})))
WHERE copy = 1 QUALIFY pos <= 3"""


def spaced(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{NOT_WS}+')) AS INT)"


def _tag(rule: str, cond: str, key: str = "NULL", words: str = "words", counted: str = "words", quoted_: str = "true") -> str:
    return (f"SELECT doc_id, para_id, frag_id, page_number, text, chars, '{rule}' AS rule, CAST({key} AS STRING) AS key, "
            f"{words} AS words, {counted} AS counted, {quoted_} AS quoted FROM frag_m WHERE {cond}")


_MARKED_WORDS = [f"(rule = 'cursiva' AND words >= {cfg.MIN_ITALIC_WORDS})", f"(rule = 'subrayado' AND words >= {cfg.MIN_UNDERLINE_WORDS})",
                 f"(rule = 'fuente_decorativa' AND words >= {cfg.MIN_DECORATIVE_WORDS})",
                 f"(rule = 'mayusculas' AND words >= {cfg.MIN_CAPS_WORDS} AND words / counted >= {cfg.MIN_CAPS_RATIO})"]
_ORDER = f"list_position([{quoted(cfg.TYPOGRAPHY_RULES)}], rule)"


def pt(expr: str) -> str:
    return f"replace(regexp_replace(CAST({expr} AS STRING), '[.]0$', ''), '.', ',')"


def place(page: str) -> str:
    return f"CASE source_type WHEN 'pdf' THEN ' (página ' || {page} || ')' WHEN 'pptx' THEN ' (diapositiva ' || {page} || ')' ELSE '' END"


_TITLES = {"cursiva": "Pasajes largos en cursiva", "mayusculas": "Texto largo en MAYÚSCULAS sostenidas", "subrayado": "Texto subrayado que no es un enlace",
           "justificado": "Texto justificado", "interlineado": "Interlineado menor a 1,5"}
_F = "CAST({o} AS INT) AS rule_order, {rule} AS rule, CAST({pos} AS INT) AS pos, '{cat}' AS category, {sev} AS severity, {issue} AS issue, {quote} AS original_text, {anchor} AS anchor"


def _f(o, rule, pos, cat, sev, issue, quote, anchor="CAST(NULL AS STRING)"):
    return _F.format(o=o, rule=rule if rule.startswith(("'", "(")) else f"'{rule}'", pos=pos, cat=cat, sev=sev, issue=issue, quote=quote, anchor=anchor)


def _sev(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'barrera_detectada' ELSE 'para_revisar' END"


VIS = "accesibilidad_visual"
_RANK_WORDS = "row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, pos)"

VIEWS.update({
    "word_marked": f"SELECT doc_id, regexp_replace(raw_text, '({WORD})', '‹\\1›', 'g') AS t FROM materials",
    "visual_refs": references(cfg.VISUAL_REFERENCE_PATTERNS, "referencias_visuales"),
    "color_candidates": references(cfg.COLOR_ONLY_PATTERNS, "solo_color"),
    "color_refs": """
SELECT doc_id, frag, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS pos FROM color_candidates c
WHERE NOT EXISTS (SELECT 1 FROM visual_refs v WHERE v.doc_id = c.doc_id AND lower(v.frag) = lower(c.frag))""",
    # --- layout
    "frag_m": f"""
SELECT *, coalesce(ratio < CASE WHEN large OR size IS NULL THEN 3.0 ELSE 4.5 END, false) AS fails FROM (
  SELECT *, CASE WHEN color IS NOT NULL AND background IS NOT NULL THEN (greatest(l_fg, l_bg) + 0.05) / (least(l_fg, l_bg) + 0.05) END AS ratio FROM (
  SELECT doc_id, para_id, frag_id, page_number, size, bold, italic, underline, link, visible, font, caps, color, background, {trim('text')} AS text,
    CAST(length({trim('text')}) AS INT) AS chars, {spaced(trim('text'))} AS words, round_even(size, 1) AS pt,
    nullif(trim(regexp_replace(font, '^[A-Z]{{6}}[+]', '')), '') AS face, {DECORATIVE} AS decorative,
    coalesce(size >= 18 OR (bold AND size >= 14), false) AS large,
    CASE WHEN color IS NOT NULL THEN {luminance('color')} END AS l_fg, CASE WHEN background IS NOT NULL THEN {luminance('background')} END AS l_bg,
    list_filter(list_transform(regexp_extract_all(CASE WHEN caps THEN upper(text) ELSE text END, '{NOT_WS}+'), lambda w: regexp_replace(w, '[^\\p{{L}}]+', '', 'g')), lambda w: length(w) >= 2) AS letters
  FROM fragments)) WHERE text <> ''""",
    "frag_tags": " UNION ALL ".join([
        _tag("letra_chica_pasajes", f"pt < {cfg.SMALL_PASSAGE_PT}", "pt"),
        _tag("contraste_insuficiente", "fails", "color || background || large"),
        _tag("fuente_decorativa", "visible AND decorative AND face IS NOT NULL", "face"),
        _tag("cursiva", "visible AND italic"),
        _tag("mayusculas", "visible", words="CAST(len(list_filter(letters, lambda w: regexp_full_match(w, '\\p{Lu}+'))) AS INT)", counted="CAST(len(letters) AS INT)",
             quoted_="len(list_filter(letters, lambda w: regexp_full_match(w, '\\p{Lu}+'))) > 0"),
        _tag("subrayado", "visible AND underline AND NOT link"),
        _tag("parrafo", "visible"),
    ]),
    "frag_keys": """
SELECT doc_id, para_id, rule, key, sum(words) AS words, sum(counted) AS counted, sum(chars) AS chars, min(frag_id) AS lead, min(page_number) AS page_number
FROM frag_tags GROUP BY 1, 2, 3, 4""",
    "passages": """
SELECT doc_id, para_id, rule, CAST(sum(words) AS BIGINT) AS words, CAST(sum(counted) AS BIGINT) AS counted, min(page_number) AS page_number,
  max(key) FILTER (WHERE rk = 1) AS key FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, para_id, rule ORDER BY CASE rule WHEN 'fuente_decorativa' THEN words ELSE chars END DESC, lead) AS rk FROM frag_keys)
GROUP BY 1, 2, 3""",
    "key_ratio": "SELECT DISTINCT color || background || large AS key, color, background, large, round_even(ratio, 2) AS ratio FROM frag_m WHERE fails",
    "frag_quotes": """
SELECT doc_id, para_id, rule, list_aggregate(ws[1:40], 'string_agg', ' ') || CASE WHEN len(ws) > 40 THEN '…' ELSE '' END AS example FROM (
  SELECT t.doc_id, t.para_id, t.rule, regexp_extract_all(string_agg(t.text, ' ' ORDER BY CASE t.rule WHEN 'contraste_insuficiente' THEN k.lead END, t.frag_id), '[^ ]+') AS ws
  FROM frag_tags t JOIN frag_keys k ON k.doc_id = t.doc_id AND k.para_id = t.para_id AND k.rule = t.rule AND k.key IS NOT DISTINCT FROM t.key
  WHERE t.quoted GROUP BY 1, 2, 3)""",
    "body_sizes": """
SELECT doc_id, pt AS body_pt FROM (SELECT doc_id, pt, row_number() OVER (PARTITION BY doc_id ORDER BY sum(chars) DESC, min(frag_id)) AS rk
  FROM frag_m WHERE pt IS NOT NULL GROUP BY doc_id, pt) WHERE rk = 1""",
    "body_faces": """
SELECT doc_id, face AS body_font FROM (SELECT doc_id, face, row_number() OVER (PARTITION BY doc_id ORDER BY sum(chars) DESC, min(frag_id)) AS rk
  FROM frag_m WHERE face IS NOT NULL AND visible GROUP BY doc_id, face) WHERE rk = 1""",
    "small_rows": f"""
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS pos, count(*) OVER (PARTITION BY doc_id) AS total FROM passages
WHERE rule = 'letra_chica_pasajes' AND words >= {cfg.MIN_SMALL_PASSAGE_WORDS} AND doc_id NOT IN (SELECT doc_id FROM body_sizes WHERE body_pt < {cfg.MIN_BODY_PT})""",
    "contrast_rows": f"""
SELECT p.*, k.color, k.background, k.large, k.ratio, row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS stored, count(*) OVER (PARTITION BY doc_id) AS total
FROM passages p JOIN key_ratio k USING (key) WHERE rule = 'contraste_insuficiente' AND words >= {cfg.MIN_LOW_CONTRAST_WORDS}""",
    "contrast_worst": f"""
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ratio, para_id) AS pos, count(*) OVER (PARTITION BY doc_id) AS kept,
  count(*) FILTER (WHERE ratio < 3.0) OVER (PARTITION BY doc_id) AS severe FROM contrast_rows WHERE stored <= {cfg.STORED_PASSAGES}""",
    "plain_long": f"SELECT * FROM passages JOIN paragraph_formats USING (doc_id, para_id) WHERE rule = 'parrafo' AND words >= {cfg.MIN_LAYOUT_WORDS}",
    "typo_rows": f"""
SELECT doc_id, para_id, rule, words, page_number, CASE rule WHEN 'fuente_decorativa' THEN key END AS detail FROM passages WHERE {' OR '.join(_MARKED_WORDS)}
UNION ALL SELECT doc_id, para_id, 'justificado', words, page_number, NULL FROM plain_long WHERE justified
UNION ALL SELECT doc_id, para_id, 'interlineado', words, page_number, replace(regexp_replace(printf('%.2f', line_spacing), '[.]?0+$', ''), '.', ',') FROM plain_long WHERE line_spacing < 1.5 - 1e-6""",
    "typo_pages": f"""
SELECT doc_id, rule, list_sort(list(page_number)) AS pages FROM (
  SELECT doc_id, rule, page_number, row_number() OVER (PARTITION BY doc_id, rule ORDER BY min(para_id), page_number) AS rk FROM typo_rows GROUP BY 1, 2, 3)
WHERE rk <= {cfg.STORED_PAGES} GROUP BY 1, 2""",
    "typo_details": """
SELECT doc_id, rule, detail FROM (SELECT doc_id, rule, detail, row_number() OVER (PARTITION BY doc_id, rule ORDER BY sum(words) DESC, min(para_id)) AS rk
  FROM typo_rows WHERE detail IS NOT NULL GROUP BY 1, 2, 3) WHERE rk = 1""",
    "typo_issues": f"""
SELECT s.doc_id, s.rule, s.passages, s.words, coalesce(q.example, '') AS example, p.pages, d.detail, CAST({_ORDER.replace('rule', 's.rule')} AS INT) AS issue_order,
  coalesce(s.rule = 'fuente_decorativa' AND b.body_font = d.detail AND EXISTS (SELECT 1 FROM frag_m m WHERE m.face = b.body_font AND m.decorative), false) AS severe
FROM (SELECT doc_id, rule, count(*) AS passages, CAST(sum(words) AS BIGINT) AS words, min(para_id) AS para_id FROM typo_rows GROUP BY 1, 2) s
LEFT JOIN frag_quotes q ON q.doc_id = s.doc_id AND q.para_id = s.para_id AND q.rule = CASE WHEN s.rule IN ('justificado', 'interlineado') THEN 'parrafo' ELSE s.rule END
JOIN typo_pages p ON p.doc_id = s.doc_id AND p.rule = s.rule LEFT JOIN typo_details d ON d.doc_id = s.doc_id AND d.rule = s.rule LEFT JOIN body_faces b ON b.doc_id = s.doc_id""",
    "text_colors": f"""
SELECT *, {', '.join(f"{simulated(k, c)} AS {k}_{c}" for k in cfg.CVD_MATRICES for c in 'rgb')} FROM (
  SELECT *, {', '.join(f"({LINEAR.format(c=c)}) AS l{c}" for c in 'rgb')}, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, lead) AS rk FROM (
    SELECT doc_id, color, {rgb('color', 2)} AS r, {rgb('color', 4)} AS g, {rgb('color', 6)} AS b, sum(chars) AS chars, min(frag_id) AS lead,
      arg_min(page_number, frag_id) AS page_number, arg_min(CASE WHEN length(text) <= 80 THEN text ELSE text[1:77] || '...' END, frag_id) AS sample
    FROM frag_m WHERE color IS NOT NULL GROUP BY doc_id, color)
  WHERE greatest(r, g, b) - least(r, g, b) >= {cfg.MIN_CHROMA} AND chars >= {cfg.MIN_COLOR_CHARS}) WHERE rk <= {cfg.CHROMATIC_CANDIDATES}""",
    "color_pairs": f"""
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS INT) AS pos FROM (
  SELECT doc_id, i, j, color_a, color_b, sample_a, sample_b, page_number, concat_ws(',', {', '.join(f"CASE WHEN d_{k} < {cfg.MAX_SIMULATED_DISTANCE} AND d_{k} / d < {cfg.MAX_SIMULATED_RATIO} THEN '{k}' END" for k in cfg.CVD_MATRICES)}) AS deficiencies FROM (
    SELECT a.doc_id, a.rk AS i, b.rk AS j, a.color AS color_a, b.color AS color_b, a.sample AS sample_a, b.sample AS sample_b, a.page_number,
      sqrt(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) AS d,
      {', '.join(f"sqrt(pow(a.{k}_r - b.{k}_r, 2) + pow(a.{k}_g - b.{k}_g, 2) + pow(a.{k}_b - b.{k}_b, 2)) AS d_{k}" for k in cfg.CVD_MATRICES)}
    FROM text_colors a JOIN text_colors b ON a.doc_id = b.doc_id AND a.rk < b.rk) WHERE d >= {cfg.MIN_NORMAL_COLOR_DISTANCE})
WHERE deficiencies <> '' QUALIFY pos <= {cfg.MAX_COLOR_PAIRS}""",
    "layout_docs": "SELECT doc_id, source_type FROM sized WHERE source_type <> 'text' AND NOT is_scanned AND trim(raw_text) <> ''",
    # --- findings
    "findings": " UNION ALL ".join([
        f"SELECT doc_id, {_f(1, 'oraciones_extensas', 'rn', 'comprension', _sev('words >= 50'), chr(39) + 'Oración extensa (' + chr(39) + ' || words || ' + chr(39) + ' palabras)' + chr(39), 'text', 'text')} FROM (SELECT *, {_RANK_WORDS} AS rn FROM doc_sentences WHERE words > 35) WHERE rn <= 3",
        f"SELECT doc_id, {_f(2, 'consignas_multiaccion', 'rn', 'comprension', _sev('actions >= 4'), chr(39) + 'Consigna con múltiples acciones (' + chr(39) + ' || actions || ' + chr(39) + ' acciones simultáneas)' + chr(39), excerpt('text', 30), 'text')} FROM (SELECT s.doc_id, s.text, a.actions, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS rn FROM doc_sentences s JOIN sentence_actions a ON a.doc_id = s.doc_id AND a.pos = s.pos WHERE a.actions >= 3) WHERE rn <= 3",
        f"SELECT doc_id, {_f(3, 'legibilidad_baja', '1', 'comprension', _sev('readability < 40'), '''printf('Índice de legibilidad bajo (Szigriszt-Pazos: %.1f - ', readability) || CASE WHEN readability < 40 THEN 'Muy difícil' ELSE 'Algo difícil' END || ')' ''', '''printf('[Evaluación global de legibilidad: IFSZ %.1f]', readability)''')} FROM readable WHERE readability < 50",
        f"SELECT doc_id, {_f(4, 'parrafos_extensos', 'rn', 'estructura', _sev('words >= 250'), chr(39) + 'Párrafo extenso sin divisiones (' + chr(39) + ' || words || ' + chr(39) + ' palabras)' + chr(39), excerpt('text', 25), 'text')} FROM (SELECT *, {_RANK_WORDS} AS rn FROM paragraphs WHERE words > 150) WHERE rn <= 3",
        f"SELECT doc_id, {_f(5, 'pdf_sin_titulos', '1', 'estructura', chr(39) + 'barrera_detectada' + chr(39), chr(39) + 'Documento extenso sin títulos ni estructura definida' + chr(39), '''('[Documento ' || upper(source_type) || ': ' || page_count || ' ' || CASE source_type WHEN 'pptx' THEN 'diapositiva(s)' ELSE 'página(s)' END || ', ' || word_count || ' palabras]')''')} FROM sized WHERE source_type <> 'text' AND NOT is_scanned AND word_count >= 150 AND doc_id NOT IN (SELECT doc_id FROM headings)",
        f"SELECT doc_id, {_f(6, 'salto_jerarquia_titulos', 'rn', 'estructura', chr(39) + 'para_revisar' + chr(39), '''('Salto de jerarquía en títulos (de H' || previous_level || ' a H' || level || ')')''', 'text', 'text')} FROM (SELECT h.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM heading_steps h JOIN sized z USING (doc_id) WHERE level > previous_level + 1 AND z.source_type <> 'text' AND NOT z.is_scanned) WHERE rn <= 2",
        f"SELECT doc_id, {_f(7, 'secciones_extensas', 'rn', 'estructura', chr(39) + 'para_revisar' + chr(39), '''('Sección extensa sin subdivisiones (' || words || ' palabras)')''', excerpt('head', 15), 'head')} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS rn FROM long_section_rows) WHERE rn <= 3",
        f"SELECT doc_id, {_f(8, '(CASE WHEN is_scanned THEN ' + chr(39) + 'pdf_escaneado' + chr(39) + ' ELSE ' + chr(39) + 'imagenes_sin_verificar' + chr(39) + ' END)', '1', VIS, _sev('is_scanned'), '''CASE WHEN is_scanned THEN 'PDF escaneado sin capa de texto' ELSE 'Imágenes sin descripción verificable' END''', '''CASE WHEN is_scanned THEN '[Documento completo: PDF]' WHEN images_with_alt_text > 0 THEN '[' || (image_count - images_with_alt_text) || ' imagen(es) sin texto alternativo en el documento]' ELSE '[' || image_count || ' imagen(es) en el documento]' END''')} FROM sized WHERE is_scanned OR image_count > images_with_alt_text",
        f"SELECT doc_id, {_f(9, 'referencias_visuales', 'pos', VIS, chr(39) + 'para_revisar' + chr(39), chr(39) + 'Referencia basada únicamente en la posición o aspecto visual' + chr(39), 'frag', 'frag')} FROM visual_refs",
        f"SELECT doc_id, {_f(10, 'solo_color', 'pos', VIS, chr(39) + 'para_revisar' + chr(39), chr(39) + 'Información transmitida solo mediante color (WCAG 1.4.1)' + chr(39), 'frag', 'frag')} FROM color_refs",
        f"SELECT doc_id, {_f(11, 'letra_chica_cuerpo', '1', VIS, chr(39) + 'barrera_detectada' + chr(39), '''('Letra demasiado chica en el cuerpo del texto (' || ''' + pt('body_pt') + ''' || ' pt)')''', '''('[Cuerpo del texto de el documento: ' || ''' + pt('body_pt') + ''' || ' pt]')''')} FROM body_sizes JOIN layout_docs USING (doc_id) WHERE body_pt < 9",
        f"SELECT s.doc_id, {_f(12, 'letra_chica_pasajes', 'pos', VIS, chr(39) + 'para_revisar' + chr(39), '''('Pasaje con letra muy chica (' || ''' + pt('key') + ''' || ' pt)' || ''' + place('s.page_number') + ')', 'q.example')} FROM small_rows s JOIN layout_docs USING (doc_id) JOIN frag_quotes q ON q.doc_id = s.doc_id AND q.para_id = s.para_id AND q.rule = s.rule WHERE pos <= 3",
        f"SELECT s.doc_id, {_f(13, 'contraste_insuficiente', 'pos', VIS, _sev('ratio < 3.0'), '''('Contraste insuficiente entre el texto y el fondo (' || replace(printf('%.1f', round_even(ratio, 1)), '.', ',') || ':1)' || ''' + place('s.page_number') + ')', 'q.example')} FROM contrast_worst s JOIN layout_docs USING (doc_id) JOIN frag_quotes q ON q.doc_id = s.doc_id AND q.para_id = s.para_id AND q.rule = s.rule WHERE pos <= 3",
        f"SELECT doc_id, CAST(14 AS INT), 'tipografia_' || rule, issue_order, '{VIS}', {_sev('severe')}, CASE WHEN severe THEN 'La fuente principal del texto es decorativa o manuscrita (' || detail || ')' WHEN rule = 'fuente_decorativa' THEN 'Pasajes en una fuente decorativa o manuscrita (' || detail || ')' {' '.join(f'WHEN rule = {chr(39)}{r}{chr(39)} THEN {chr(39)}{t}{chr(39)}' for r, t in _TITLES.items())} END || CASE WHEN source_type NOT IN ('pdf', 'pptx') THEN '' ELSE ' (' || CASE source_type WHEN 'pdf' THEN 'página' ELSE 'diapositiva' END || CASE WHEN len(pages) > 1 THEN 's ' ELSE ' ' END || list_aggregate(list_transform(pages, lambda x: CAST(x AS STRING)), 'string_agg', ', ') || ')' END, example, CAST(NULL AS STRING) FROM typo_issues JOIN layout_docs USING (doc_id)",
        f"SELECT doc_id, {_f(15, 'colores_daltonismo', 'pos', VIS, chr(39) + 'para_revisar' + chr(39), '''('Combinación de colores problemática para daltonismo (' || color_a || ' y ' || color_b || ')' || ''' + place('page_number') + ')', 'sample_a')} FROM color_pairs JOIN layout_docs USING (doc_id) WHERE pos <= 3",
    ]),
    # --- facts, penalties, scores
    "sentence_facts": """
SELECT doc_id, CAST(count(*) AS INT) AS sentence_count, CAST(count(*) FILTER (WHERE words > 35) AS INT) AS long_sentences, CAST(count(*) FILTER (WHERE words >= 50) AS INT) AS severe_long_sentences,
  CAST(max(words) AS INT) AS max_sentence_words FROM doc_sentences GROUP BY 1""",
    "paragraph_facts": """
SELECT doc_id, CAST(count(*) AS INT) AS paragraph_count, CAST(count(*) FILTER (WHERE words > 150) AS INT) AS long_paragraphs, CAST(count(*) FILTER (WHERE words >= 250) AS INT) AS severe_long_paragraphs,
  CAST(max(words) AS INT) AS max_paragraph_words,
  CAST(count(*) FILTER (WHERE regexp_matches(text, '^(?:[-•▪◦*·–]|[0-9]{1,2}[.)]|[a-zA-Z][)])[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]+')) AS INT) AS list_items FROM paragraphs GROUP BY 1""",
    "prompt_facts": "SELECT doc_id, CAST(least(3, count(*)) AS INT) AS multi_action_prompts, CAST(count(*) FILTER (WHERE rn <= 3 AND actions >= 4) AS INT) AS severe_prompts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM sentence_actions WHERE actions >= 3) GROUP BY 1",
    "reference_facts": "SELECT doc_id, CAST(count(*) AS INT) AS visual_only_references FROM (SELECT doc_id FROM visual_refs UNION ALL SELECT doc_id FROM color_refs) GROUP BY 1",
    "facts": """
SELECT z.doc_id, z.source_type, z.is_scanned, z.word_count, z.image_count, z.images_with_alt_text, trim(z.raw_text) <> '' AS has_text, coalesce(sentence_count, 0) AS sentence_count, coalesce(long_sentences, 0) AS long_sentences,
  coalesce(severe_long_sentences, 0) AS severe_long_sentences, coalesce(max_sentence_words, 0) AS max_sentence_words, coalesce(paragraph_count, 0) AS paragraph_count,
  coalesce(long_paragraphs, 0) AS long_paragraphs, coalesce(severe_long_paragraphs, 0) AS severe_long_paragraphs, coalesce(max_paragraph_words, 0) AS max_paragraph_words,
  coalesce(list_items, 0) AS list_items, coalesce(multi_action_prompts, 0) AS multi_action_prompts, coalesce(severe_prompts, 0) AS severe_prompts, readability,
  coalesce(visual_only_references, 0) AS visual_only_references, greatest(0, image_count - images_with_alt_text) AS pending_images,
  coalesce(heading_count, 0) AS heading_count, coalesce(hierarchy_levels, 0) AS hierarchy_levels,
  CASE WHEN z.source_type <> 'text' AND NOT z.is_scanned THEN coalesce(skip_count, 0) ELSE 0 END AS skips, coalesce(long_section_count, 0) AS long_section_count,
  z.source_type <> 'text' AND NOT z.is_scanned AND z.word_count >= 150 AND coalesce(heading_count, 0) = 0 AS missing_headings
FROM sized z LEFT JOIN sentence_facts USING (doc_id) LEFT JOIN paragraph_facts USING (doc_id) LEFT JOIN prompt_facts USING (doc_id) LEFT JOIN readable USING (doc_id)
LEFT JOIN reference_facts USING (doc_id) LEFT JOIN heading_totals USING (doc_id)
LEFT JOIN (SELECT doc_id, CAST(count(*) AS INT) AS long_section_count FROM long_section_rows GROUP BY 1) USING (doc_id)""",
    "text_penalties": """
SELECT doc_id, 1 AS ord, 'oraciones_extensas' AS rule, 'comprension' AS category, long_sentences AS count, CAST(least(30, round_even(100.0::DOUBLE * long_sentences / sentence_count, 0) + 3 * severe_long_sentences) AS INT) AS points, false AS severe FROM facts WHERE long_sentences > 0
UNION ALL SELECT doc_id, 2, 'parrafos_extensos', 'estructura', long_paragraphs, least(30, 6 * (long_paragraphs - severe_long_paragraphs) + 10 * severe_long_paragraphs), false FROM facts WHERE long_paragraphs > 0
UNION ALL SELECT doc_id, 3, 'pdf_escaneado', 'accesibilidad_visual', 1, 40, false FROM facts WHERE is_scanned
UNION ALL SELECT doc_id, 3, 'imagenes_sin_verificar', 'accesibilidad_visual', pending_images, 10, false FROM facts WHERE NOT is_scanned AND pending_images > 0
UNION ALL SELECT doc_id, 7, 'consignas_multiaccion', 'comprension', multi_action_prompts, least(15, 5 * multi_action_prompts), false FROM facts WHERE multi_action_prompts > 0
UNION ALL SELECT doc_id, 8, 'legibilidad_baja', 'comprension', 1, CASE WHEN readability < 40 THEN 15 ELSE 10 END, false FROM facts WHERE readability < 50
UNION ALL SELECT doc_id, 9, 'referencias_visuales', 'accesibilidad_visual', visual_only_references, least(16, 8 * visual_only_references), false FROM facts WHERE visual_only_references > 0""",
    "structure_penalties": """
SELECT doc_id, 4 AS ord, 'pdf_sin_titulos' AS rule, 'estructura' AS category, 1 AS count, 15 AS points, false AS severe FROM facts WHERE missing_headings
UNION ALL SELECT doc_id, 5, 'salto_jerarquia_titulos', 'estructura', skips, least(12, 6 * skips), false FROM facts WHERE skips > 0
UNION ALL SELECT doc_id, 6, 'secciones_extensas', 'estructura', long_section_count, least(10, 5 * long_section_count), false FROM facts WHERE long_section_count > 0""",
    "typography_penalties": f"""
SELECT doc_id, CAST(30 + issue_order AS INT) AS ord, 'tipografia_' || rule AS rule, 'accesibilidad_visual' AS category, CAST(passages AS INT) AS count, CAST(points AS INT) AS points, severe FROM (
  SELECT *, greatest(0, least(whole, {cfg.MAX_TYPOGRAPHY_PENALTY} - coalesce(sum(whole) OVER (PARTITION BY doc_id ORDER BY issue_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS points
  FROM (SELECT *, CASE WHEN severe THEN 8 ELSE 4 END AS whole FROM typo_issues)) WHERE points > 0""",
    "layout_penalties": """
SELECT doc_id, 20 AS ord, 'letra_chica_cuerpo' AS rule, 'accesibilidad_visual' AS category, 1 AS count, 15 AS points, true AS severe FROM body_sizes WHERE body_pt < 9
UNION ALL SELECT doc_id, 21, 'letra_chica_pasajes', 'accesibilidad_visual', CAST(count(*) AS INT), CAST(least(15, 5 * count(*)) AS INT), false FROM small_rows GROUP BY doc_id
UNION ALL SELECT doc_id, 22, 'contraste_insuficiente', 'accesibilidad_visual', CAST(count(*) AS INT), CAST(least(16, 8 * count(*) FILTER (WHERE stored <= 20 AND ratio < 3.0) + 4 * (count(*) - count(*) FILTER (WHERE stored <= 20 AND ratio < 3.0))) AS INT),
  count(*) FILTER (WHERE stored <= 20 AND ratio < 3.0) > 0 FROM contrast_rows GROUP BY doc_id
UNION ALL SELECT * FROM typography_penalties
UNION ALL SELECT doc_id, 40, 'colores_daltonismo', 'accesibilidad_visual', CAST(count(*) AS INT), CAST(least(8, 4 * count(*)) AS INT), false FROM color_pairs GROUP BY doc_id""",
    "penalties": """
SELECT * FROM text_penalties UNION ALL SELECT * FROM structure_penalties UNION ALL SELECT l.* FROM layout_penalties l JOIN layout_docs USING (doc_id)""",
    "rated": f"""
SELECT f.doc_id, a.ai_score, f.has_text, f.is_scanned, CAST(greatest(0, 100 - coalesce(p.points, 0)) AS INT) AS rules_score,
  f.doc_id IN (SELECT doc_id FROM findings WHERE severity = 'barrera_detectada') AS severe
FROM facts f LEFT JOIN ai_scores a USING (doc_id) LEFT JOIN (SELECT doc_id, sum(points) AS points FROM penalties GROUP BY 1) p USING (doc_id)""",
    "combined": f"""
SELECT *, CASE WHEN ai_score IS NULL THEN rules_score ELSE CAST(round_even({cfg.AI_WEIGHT}::DOUBLE * greatest(0, least(100, ai_score)) + {cfg.RULES_WEIGHT}::DOUBLE * rules_score, 0) AS INT) END AS combined,
  CASE WHEN NOT has_text THEN {cfg.NO_TEXT_CAP} WHEN is_scanned THEN {cfg.SCANNED_CAP} WHEN severe THEN {cfg.SEVERE_CAP} END AS limit_ FROM rated""",
    "scores": "SELECT *, CASE WHEN combined > limit_ THEN limit_ END AS cap, least(combined, CASE WHEN combined > limit_ THEN limit_ END) AS final_score FROM combined",
})


def _status_sql(rank: str) -> str:
    return f"CASE {rank} WHEN 2 THEN 'barrera_detectada' WHEN 1 THEN 'para_revisar' ELSE 'correcta' END"


def _too_long(count: str, noun: str, limit: int, longest: str) -> str:
    more = f"CASE WHEN {count} > {cfg.REPORTED_PER_RULE} THEN ' Se listan las {cfg.REPORTED_PER_RULE} más extensas.' ELSE '' END"
    return f"CASE WHEN {count} > 0 THEN {count} || ' {noun} superan las {limit} palabras (la más extensa tiene ' || {longest} || ').' || {more} END"


_NAMES = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{n}'" for r, n in (
    ("fuente_decorativa", "fuente decorativa"), ("cursiva", "cursiva"), ("mayusculas", "mayúsculas sostenidas"), ("subrayado", "subrayado"),
    ("justificado", "texto justificado"), ("interlineado", "interlineado reducido"))) + " END"

VIEWS.update({
    "layout_notes": f"""
SELECT doc_id, 1 AS o, 2 AS r, 'El cuerpo del texto está en ' || {pt('body_pt')} || ' pt (menos de 9 pt).' AS note FROM body_sizes JOIN layout_docs USING (doc_id) WHERE body_pt < {cfg.MIN_BODY_PT}
UNION ALL SELECT doc_id, 2, 1, count(*) || ' pasaje(s) de 20 palabras o más están en menos de 8 pt.' FROM small_rows JOIN layout_docs USING (doc_id) GROUP BY doc_id
UNION ALL SELECT doc_id, 3, CASE WHEN count(*) FILTER (WHERE stored <= {cfg.STORED_PASSAGES} AND ratio < 3.0) > 0 THEN 2 ELSE 1 END,
  count(*) || ' pasaje(s) no alcanzan el contraste mínimo con su fondo (WCAG 1.4.3); el peor tiene ' || replace(printf('%.1f', round_even(min(ratio) FILTER (WHERE stored <= {cfg.STORED_PASSAGES}), 1)), '.', ',') || ':1.'
  FROM contrast_rows JOIN layout_docs USING (doc_id) GROUP BY doc_id
UNION ALL SELECT doc_id, 4, CASE WHEN bool_or(severe) THEN 2 ELSE 1 END, 'Tipografía poco legible: ' || string_agg({_NAMES}, ', ' ORDER BY issue_order) || '.' FROM typo_issues JOIN layout_docs USING (doc_id) GROUP BY doc_id
UNION ALL SELECT doc_id, 5, 1, 'Se detectaron ' || count(*) || ' par(es) de colores en el texto que pueden confundirse con daltonismo.' FROM color_pairs JOIN layout_docs USING (doc_id) GROUP BY doc_id""",
    "layout_said": "SELECT doc_id, max(r) AS layout_rank, string_agg(note, ' ' ORDER BY o) AS layout_comment FROM layout_notes GROUP BY doc_id",
    "dimension_facts": f"""
SELECT f.*, layout_rank, layout_comment, coalesce(readability < {cfg.READABILITY_WARN}, false) AS low,
  long_sentences > 0 OR multi_action_prompts > 0 OR coalesce(readability < {cfg.READABILITY_WARN}, false) AS comp_any,
  severe_long_sentences > 0 OR severe_prompts > 0 OR coalesce(readability < 40, false) AS comp_severe,
  long_paragraphs > 0 OR missing_headings OR skips > 0 OR long_section_count > 0 AS str_any, severe_long_paragraphs > 0 OR missing_headings AS str_severe,
  CASE WHEN is_scanned THEN 2 WHEN image_count > 0 AND pending_images > 0 THEN 1 ELSE 0 END AS image_rank,
  CASE WHEN visual_only_references >= 3 THEN 2 WHEN visual_only_references > 0 THEN 1 ELSE 0 END AS ref_rank
FROM facts f LEFT JOIN layout_said USING (doc_id)""",
    "dimension_rows": f"""
SELECT doc_id, 'comprension' AS category, {_status_sql('CASE WHEN comp_any THEN CASE WHEN comp_severe THEN 2 ELSE 1 END ELSE 0 END')} AS status,
  CASE WHEN comp_any THEN concat_ws(' ', {_too_long('long_sentences', 'oración(es)', cfg.LONG_SENTENCE_WORDS, 'max_sentence_words')},
    CASE WHEN multi_action_prompts > 0 THEN multi_action_prompts || ' consigna(s) encadenan múltiples acciones simultáneas.' END,
    CASE WHEN low THEN printf('Índice de legibilidad Szigriszt-Pazos: %.1f.', readability) END)
  ELSE 'No se detectaron oraciones de más de {cfg.LONG_SENTENCE_WORDS} palabras ni consignas complejas.' END AS comment FROM dimension_facts
UNION ALL
SELECT doc_id, 'estructura', {_status_sql('CASE WHEN str_any THEN CASE WHEN str_severe THEN 2 ELSE 1 END ELSE 0 END')},
  CASE WHEN str_any THEN concat_ws(' ', {_too_long('long_paragraphs', 'párrafo(s)', cfg.LONG_PARAGRAPH_WORDS, 'max_paragraph_words')},
    CASE WHEN missing_headings THEN 'El documento no contiene títulos ni subtítulos estructurados.' END,
    CASE WHEN skips > 0 THEN 'Se detectaron ' || skips || ' salto(s) en la jerarquía de títulos.' END,
    CASE WHEN long_section_count > 0 THEN long_section_count || ' sección(es) superan las {cfg.LONG_SECTION_WORDS} palabras sin subdivisiones.' END)
  WHEN source_type <> 'text' AND heading_count > 0 THEN 'Estructura organizada con ' || heading_count || ' encabezados y ' || hierarchy_levels || ' nivel(es) de jerarquía.'
  ELSE 'No se detectaron párrafos de más de {cfg.LONG_PARAGRAPH_WORDS} palabras sin división.' END FROM dimension_facts
UNION ALL
SELECT doc_id, 'accesibilidad_visual', {_status_sql('greatest(image_rank, ref_rank, coalesce(layout_rank, 0))')},
  concat_ws(' ', CASE WHEN is_scanned THEN 'El PDF parece escaneado: el texto no es seleccionable ni legible por lectores de pantalla.'
    WHEN image_count > 0 AND pending_images = 0 THEN 'Las ' || image_count || ' imagen(es) tienen texto alternativo o están marcadas como decorativas.'
    WHEN image_count > 0 AND images_with_alt_text > 0 THEN 'Se detectaron ' || image_count || ' imagen(es); ' || pending_images || ' no tiene(n) texto alternativo.'
    WHEN image_count > 0 THEN 'Se detectaron ' || image_count || ' imagen(es); su accesibilidad no puede verificarse automáticamente.'
    ELSE 'No se detectaron imágenes en el material.' END,
    CASE WHEN visual_only_references > 0 THEN 'Se detectaron ' || visual_only_references || ' referencia(s) que dependen de la posición o aspecto visual.' END, layout_comment) FROM dimension_facts""",
    "dimension_merged": f"""
SELECT r.doc_id, r.category, CASE WHEN a.status IS NULL THEN r.status WHEN r.status = 'correcta' THEN a.status
    ELSE {_status_sql("greatest(list_position(['correcta', 'para_revisar', 'barrera_detectada'], a.status), list_position(['correcta', 'para_revisar', 'barrera_detectada'], r.status)) - 1")} END AS status,
  CASE WHEN a.status IS NULL THEN r.comment WHEN r.status = 'correcta' THEN a.comment ELSE a.comment || ' Reglas automáticas: ' || r.comment END AS comment
FROM dimension_rows r LEFT JOIN ai_dimensions a ON a.doc_id = r.doc_id AND a.category = r.category AND a.category <> 'accesibilidad_visual'""",
    "picture_signals": """
SELECT doc_id, count(*) FILTER (relies_on_color) + count(*) FILTER (has_untranscribed_text) AS signals FROM relevant_pictures GROUP BY doc_id""",
    "relevant_pictures": """
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, image_id) AS INT) AS image_index,
  CASE WHEN y_norm < 0.35 THEN 'sector superior' WHEN y_norm > 0.65 THEN 'sector inferior' ELSE 'sector central' END AS position FROM images
WHERE width_pt >= 35 AND height_pt >= 35 AND width_px >= 60 AND height_px >= 60 AND width_px / greatest(height_px, 1) BETWEEN 0.125 AND 8
  AND NOT ((bottom_norm < 0.07 OR top_norm > 1::DOUBLE - 0.07::DOUBLE) AND height_pt < 75) QUALIFY image_index <= 5""",
})
