"""Layout rules, all findings, metrics, penalties, scores, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.bindings import entity
from lumbrera.functions import text as T
from lumbrera.operators import merge, rules_layout, rules_text, scoring
from lumbrera.plans import diagnosis
from lumbrera.queries import oracle_rules  # noqa: F401  (registers views)
from lumbrera.queries.registry import query
from lumbrera.session import cut
from lumbrera.sources import materials as M


def frags(spark, sf):
    return entity(spark, sf, "fragments")


def formats(spark, sf):
    return entity(spark, sf, "paragraph_formats")


def layout(spark, sf, *rules: str) -> rules_layout.Layout:
    return rules_layout.read_layout(frags(spark, sf), formats(spark, sf), rules or rules_layout.LAYOUT_RULES)


def inputs(spark, sf) -> diagnosis.Inputs:
    return diagnosis.Inputs(*[entity(spark, sf, n) for n in ("materials", "headings", "fragments", "paragraph_formats")])


@query("r11_body_font_size", "SELECT doc_id, body_pt FROM body_sizes")
def body_font_size(spark, sf):
    return rules_layout.body_font_size(frags(spark, sf))


@query("r12_small_body", "SELECT doc_id, body_pt FROM body_sizes WHERE body_pt < 9")
def small_body(spark, sf):
    return rules_layout.small_body(frags(spark, sf))


@query("r13_small_passages", """
SELECT s.doc_id, s.para_id, CAST(pos AS INT) AS pos, s.page_number, s.words, CAST(key AS DOUBLE) AS font_size, q.example, total FROM small_rows s
JOIN frag_quotes q ON q.doc_id = s.doc_id AND q.para_id = s.para_id AND q.rule = s.rule WHERE pos <= 3""")
def small_passages(spark, sf):
    return rules_layout.small_passages(layout(spark, sf, rules_layout.SMALL))


@query("r14_low_contrast_passages", """
SELECT s.doc_id, s.para_id, CAST(pos AS INT) AS pos, s.page_number, s.words, color AS text_color, background AS background_color, ratio, large AS is_large, q.example, total, kept, severe
FROM contrast_worst s JOIN frag_quotes q ON q.doc_id = s.doc_id AND q.para_id = s.para_id AND q.rule = s.rule WHERE pos <= 3""")
def low_contrast_passages(spark, sf):
    return rules_layout.low_contrast_passages(layout(spark, sf, rules_layout.CONTRAST))


def _typography(name: str, rule: str) -> None:
    sql = f"SELECT doc_id, para_id, words, page_number, detail FROM typo_rows WHERE rule = '{rule}'"

    @query(name, sql)
    def run(spark, sf, rule=rule):
        return rules_layout.passages_of(frags(spark, sf), formats(spark, sf), rule)


for _name, _rule in (
    ("r15_italic_passages", "cursiva"), ("r16_caps_passages", "mayusculas"), ("r17_underlined_passages", "subrayado"),
    ("r18_decorative_passages", "fuente_decorativa"), ("r19_justified_passages", "justificado"), ("r20_tight_line_spacing", "interlineado"),
):
    _typography(_name, _rule)


@query("r21_typography_issues", """
SELECT doc_id, rule, passages, words, example, list_aggregate(list_transform(pages, lambda x: CAST(x AS STRING)), 'string_agg', ',') AS pages, detail, severe, issue_order FROM typo_issues""")
def typography_issues(spark, sf):
    found = rules_layout.typography_issues(layout(spark, sf, *cfg.TYPOGRAPHY_RULES))
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ",")).select(
        "doc_id", "rule", "passages", "words", "example", "pages", "detail", "severe", "issue_order")


@query("r22_colorblind_pairs", "SELECT doc_id, pos, color_a, color_b, deficiencies, sample_a, sample_b, page_number FROM color_pairs")
def colorblind_pairs(spark, sf):
    return rules_layout.colorblind_pairs(frags(spark, sf))


@query("r24_all_findings", "SELECT * FROM findings")
def all_findings(spark, sf):
    return diagnosis.all_findings(inputs(spark, sf))


@query("c01_rule_metrics", f"""
SELECT f.doc_id, {', '.join('f.' + m for m in scoring.METRICS[:14])}, CASE WHEN d.doc_id IS NOT NULL THEN body_pt END AS body_pt,
  CAST(CASE WHEN d.doc_id IS NOT NULL THEN coalesce(s.n, 0) ELSE 0 END AS INT) AS small_text_passages,
  CAST(CASE WHEN d.doc_id IS NOT NULL THEN coalesce(c.n, 0) ELSE 0 END AS INT) AS low_contrast_passages,
  CAST(CASE WHEN d.doc_id IS NOT NULL THEN coalesce(t.n, 0) ELSE 0 END AS INT) AS typography_issues
FROM facts f LEFT JOIN layout_docs d USING (doc_id) LEFT JOIN body_sizes b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM small_rows GROUP BY 1) s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM contrast_rows GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM typo_issues GROUP BY 1) t USING (doc_id)""")
def rule_metrics(spark, sf):
    judged = scoring.counted(rules_text.assess(entity(spark, sf, "materials"), entity(spark, sf, "headings")))
    return scoring.rule_metrics(judged, rules_layout.layout_facts(layout(spark, sf)))


def _counted(spark, sf):
    return scoring.counted(rules_text.assess(entity(spark, sf, "materials"), entity(spark, sf, "headings")))


@query("c02_text_penalties", "SELECT * FROM text_penalties UNION ALL SELECT * FROM structure_penalties")
def text_penalties(spark, sf):
    return scoring.explode_penalties(scoring.text_penalties(_counted(spark, sf)))


@query("c03_structure_penalties", "SELECT * FROM structure_penalties")
def structure_penalties(spark, sf):
    return scoring.explode_penalties(scoring.structure_penalties(_counted(spark, sf)))


@query("c04_legibility_penalties", "SELECT * FROM layout_penalties")
def legibility_penalties(spark, sf):
    return rules_layout.layout_penalties(layout(spark, sf))


@query("c05_typography_penalties", "SELECT * FROM typography_penalties")
def typography_penalties(spark, sf):
    return rules_layout.typography_penalties(layout(spark, sf, *cfg.TYPOGRAPHY_RULES))


def _scores(spark, sf):
    return diagnosis.scores(inputs(spark, sf), entity(spark, sf, "ai_scores"))


@query("c06_combined_score", "SELECT doc_id, ai_score, rules_score, combined FROM scores")
def combined_score(spark, sf):
    return _scores(spark, sf).select("doc_id", "ai_score", "rules_score", "combined")


@query("c07_apply_caps", "SELECT doc_id, severe, cap, final_score FROM scores")
def apply_caps(spark, sf):
    return _scores(spark, sf).select("doc_id", "severe", "cap", "final_score")


@query("c08_dimension_status", "SELECT doc_id, category, status, comment FROM dimension_rows")
def dimension_status(spark, sf):
    return diagnosis.dimensions(inputs(spark, sf))


@query("c09_merge_dimensions", """
SELECT d.doc_id, d.category, CASE WHEN signals > 0 AND category = 'accesibilidad_visual' AND status = 'correcta' THEN 'para_revisar' ELSE status END AS status,
  CASE WHEN signals > 0 AND category = 'accesibilidad_visual'
    THEN trim(comment || ' La IA de visión detectó ' || signals || ' señal(es) de dependencia de color o texto incrustado en imágenes.') ELSE comment END AS comment
FROM dimension_merged d LEFT JOIN picture_signals USING (doc_id)""")
def merge_dimensions(spark, sf):
    vision = merge.vision_signal_findings(M.relevant_images(entity(spark, sf, "images")))
    return scoring.merge_dimensions(entity(spark, sf, "ai_dimensions"), diagnosis.dimensions(inputs(spark, sf)), vision)


@query("00_score_and_longest_sentences", f"""
SELECT s.doc_id, s.final_score, CAST(least(s.final_score // 10, 9) AS INT) AS bin, l.pos, l.words, l.text FROM scores s LEFT JOIN (
  SELECT doc_id, CAST(rn AS INT) AS pos, words, text FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, pos) AS rn FROM doc_sentences WHERE words > {cfg.LONG_SENTENCE_WORDS}) WHERE rn <= 3) l ON l.doc_id = s.doc_id""")
def score_and_longest_sentences(spark, sf):
    """Flagship: the score of every document with its three longest sentences."""
    given = inputs(spark, sf)
    judged = cut(diagnosis.judged(given).select("doc_id", "has_text", "is_scanned", "penalties", "findings"))
    points = rules_layout.layout_penalties(diagnosis.layout(given))
    scored = scoring.scores(judged, points, entity(spark, sf, "ai_scores")).select("doc_id", "final_score")
    longest = judged.select("doc_id", F.inline(F.filter("findings", lambda f: f["rule"] == "oraciones_extensas"))).select(
        "doc_id", "pos", F.col("anchor").alias("text"))
    return scored.join(longest, "doc_id", "left").select(
        "doc_id", "final_score", F.least(F.floor(F.col("final_score") / 10), F.lit(9)).cast("int").alias("bin"), "pos",
        T.count_words(F.col("text")).alias("words"), "text")
