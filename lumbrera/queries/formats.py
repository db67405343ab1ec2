"""Alternative formats, inferred headings, evaluation, streaming parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.bindings import entity, table
from lumbrera.operators import evaluation, formats, segments
from lumbrera.plans import diagnosis
from lumbrera.queries import rules as rule_queries
from lumbrera.queries.oracle_views import collapse
from lumbrera.queries.registry import query
from lumbrera.sources import materials as M


def _described(spark, sf):
    """Relevant pictures with a description and, as their anchor, the opening of a paragraph of the document."""
    images = M.relevant_images(entity(spark, sf, "images"))
    openings = segments.paragraphs(entity(spark, sf, "materials")).select("doc_id", F.col("pos").alias("image_index"), F.left("text", F.lit(60)).alias("anchor"))
    return images.join(openings, ["doc_id", "image_index"], "left").select(
        "doc_id", "image_index", F.format_string("Página %d", "page_number").alias("location"), F.coalesce("alt", F.lit("")).alias("description"), "anchor", "decorative")


@query("x01_insert_image_blocks")
def insert_image_blocks(spark, sf):
    return formats.insert_image_blocks(entity(spark, sf, "materials"), _described(spark, sf))


_CLIP = f"CASE WHEN length({collapse('text')}) <= 80 THEN {collapse('text')} ELSE rtrim({collapse('text')}[1:79]) || '…' END"
_CAPPED = f"""(SELECT doc_id, node_id, parent_id, depth, pos, {_CLIP} AS text, 0 AS dropped_siblings FROM nodes WHERE depth = 0
UNION ALL SELECT doc_id, node_id, parent_id, depth, pos, text, greatest(n - {cfg.MAP_MAX_CHILDREN}, 0) FROM (
  SELECT doc_id, node_id, parent_id, depth, pos, {_CLIP} AS text, row_number() OVER (PARTITION BY parent_id ORDER BY pos, node_id) AS rk, count(*) OVER (PARTITION BY parent_id) AS n
  FROM nodes WHERE depth = 1) WHERE rk <= {cfg.MAP_MAX_CHILDREN})"""


@query("x02_cap_tree", f"SELECT * FROM {_CAPPED}")
def cap_tree(spark, sf):
    return formats.cap_tree(entity(spark, sf, "nodes")).select("doc_id", "node_id", "parent_id", "depth", "pos", "text", "dropped_siblings")


@query("x03_render_outline", f"""
SELECT doc_id, string_agg(repeat('  ', depth) || '- ' || regexp_replace(text, '([\\\\`*_\\[\\]<>#|])', '\\\\\\1', 'g'), chr(10) ORDER BY depth, pos) || chr(10) AS markdown,
  string_agg(CASE WHEN depth = 0 THEN text ELSE repeat('  ', depth - 1) || '- ' || text END, chr(10) ORDER BY depth, pos) || chr(10) AS outline,
  'mindmap' || chr(10) || string_agg(repeat('  ', depth + 1) || CASE WHEN depth = 0 THEN 'root(("' || text || '"))' ELSE 'n' || rk || '["' || text || '"]' END, chr(10) ORDER BY depth, pos) || chr(10) AS diagram
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth, pos) - 1 AS rk FROM {_CAPPED}) GROUP BY doc_id""")
def render_outline(spark, sf):
    return formats.render_outline(formats.cap_tree(entity(spark, sf, "nodes")))


def _sections(spark, sf):
    return segments.paragraphs(entity(spark, sf, "materials")).select(
        "doc_id", F.format_string("Material %d", "doc_id").alias("script_title"), "pos", F.format_string("Parte %d", "pos").alias("title"), "text")


@query("x04_cap_sections", """
SELECT doc_id, pos, title, CASE WHEN upto > 20000 THEN CASE WHEN length(line) <= room THEN line ELSE rtrim(line[1:room - 1]) || '…' END ELSE text END AS text FROM (
  SELECT *, greatest(1, length(text) - (upto - 20000)) AS room, LINE AS line FROM (
    SELECT *, sum(length(title) + 3 + length(text) + CASE WHEN pos = 1 THEN length('Material ' || doc_id) + 3 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM (
      SELECT doc_id, CAST(least(pos, 12) AS INT) AS pos, 'Parte ' || least(pos, 12) AS title,
        CASE WHEN n > 12 AND least(pos, 12) = 12 THEN string_agg('Parte ' || pos || '. ' || text, chr(10) || chr(10) ORDER BY pos) ELSE min(text) END AS text
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM paragraphs) GROUP BY doc_id, least(pos, 12), n)) WHERE upto <= 20000 OR pos = 1)""".replace("LINE", collapse("text")))
def cap_sections(spark, sf):
    return formats.cap_sections(_sections(spark, sf))


def _lines(spark, sf):
    """Printed lines with type, from line items: sizes and weights vary, most text is body."""
    order = F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + order).alias("line_no"),
        (1 + F.col("l_linenumber") % 3).cast("int").alias("page_number"),
        F.concat(F.repeat(F.lit("palabra "), (1 + F.col("l_suppkey") % 14).cast("int")), F.lit("l"), F.col("l_linenumber").cast("string")).alias("text"),
        F.when(F.col("l_partkey") % 3 == 0, 14.0).when(F.col("l_partkey") % 7 == 0, 18.2).otherwise(10.0).alias("size"),
        (F.col("l_partkey") % 5 == 0).alias("bold"), (F.col("l_linenumber") == 7).alias("in_margin"))


@query("r23_infer_headings")
def infer_headings(spark, sf):
    return formats.infer_headings(_lines(spark, sf))


def _run_sets_sql(value: str, expression: str, sep: str) -> str:
    return f"coalesce(nullif(array_to_string(list_sort(list_distinct(list({expression}) FILTER (WHERE ok AND {expression} IS NOT NULL))), '{sep}'), ''), '-') AS {value}"


@query("e01_summarize_runs", f"""
SELECT sample, mode, {_run_sets_sql('models', 'model', ', ')}, arg_min(words, run) AS words, count(*) FILTER (WHERE ok) AS runs_ok, count(*) FILTER (WHERE NOT ok) AS runs_error,
  round_even(avg(latency_s) FILTER (WHERE ok), 1) AS latency_mean,
  round_even(min(latency_s) FILTER (WHERE ok), 1) AS latency_min, round_even(max(latency_s) FILTER (WHERE ok), 1) AS latency_max,
  round_even(avg(prompt_tokens) FILTER (WHERE ok), 1) AS prompt_tokens_mean, round_even(avg(output_tokens) FILTER (WHERE ok), 1) AS output_tokens_mean,
  round_even(avg(coalesce(thinking_tokens, 0)) FILTER (WHERE ok), 1) AS thinking_tokens_mean, round_even(avg(score) FILTER (WHERE ok), 1) AS score_mean,
  coalesce(nullif(concat_ws('-', min(score) FILTER (WHERE ok), max(score) FILTER (WHERE ok)), ''), '-') AS score_range, round_even(stddev_samp(score) FILTER (WHERE ok), 1) AS score_stdev,
  round_even(avg(ai_score) FILTER (WHERE ok), 1) AS ai_score_mean, {_run_sets_sql('rules_score', 'rules_score', '/')},
  coalesce(nullif(concat_ws('-', min(findings) FILTER (WHERE ok), max(findings) FILTER (WHERE ok)), ''), '-') AS findings_range,
  coalesce(nullif(concat_ws('-', min(rule_findings) FILTER (WHERE ok), max(rule_findings) FILTER (WHERE ok)), ''), '-') AS rule_findings_range,
  CAST(coalesce(sum(coalesce(unverified, 0)) FILTER (WHERE ok), 0) AS BIGINT) AS unverified,
  {_run_sets_sql('status_comprension', "coalesce(status_comprension, '-')", '/')}, {_run_sets_sql('status_estructura', "coalesce(status_estructura, '-')", '/')}
FROM ai_runs GROUP BY 1, 2""")
def summarize_runs(spark, sf):
    return evaluation.summarize_runs(entity(spark, sf, "ai_runs"))


def _run_quotes(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("sample"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("mode"), F.col("event_id").alias("run"),
        F.explode(F.array_distinct(F.array(
            F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")), F.concat(F.lit("b"), F.col("event_type")), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))))).alias("quote"))


@query("e02_quote_stability", """
SELECT sample, mode, CAST(n AS BIGINT) AS runs, round_even(total / (n * (n - 1) / 2), 2) AS stability FROM (
  SELECT a.sample, a.mode, max(t.n) AS n, sum(CASE WHEN a.a = b.a AND a.t = b.t AND a.u = b.u THEN CASE WHEN a.k = b.k THEN a.n * (a.n - 1) / 2 ELSE 0 END
      ELSE a.n * b.n * ((a.a = b.a)::INT + (a.t = b.t)::INT + (a.u = b.u)::INT) / (6.0::DOUBLE - ((a.a = b.a)::INT + (a.t = b.t)::INT + (a.u = b.u)::INT)) END) AS total
  FROM run_sets a JOIN run_sets b ON a.sample = b.sample AND a.mode = b.mode AND a.k <= b.k JOIN (SELECT sample, mode, sum(n) AS n FROM run_sets GROUP BY 1, 2) t ON t.sample = a.sample AND t.mode = a.mode
  GROUP BY 1, 2) WHERE n > 1""")
def quote_stability(spark, sf):
    return evaluation.quote_stability(_run_quotes(spark, sf)).filter("runs > 1")


@query("e03_calibration_table", """
SELECT doc_id, word_count, sentence_count, long_sentences || ' (' || severe_long_sentences || ')' AS long_sentences, max_sentence_words, paragraph_count,
  long_paragraphs || ' (' || severe_long_paragraphs || ')' AS long_paragraphs, coalesce(text, '-') AS penalties, CAST(greatest(0, 100 - coalesce(points, 0)) AS INT) AS rules_score
FROM facts LEFT JOIN (SELECT doc_id, string_agg(rule || ' -' || points, ', ' ORDER BY ord) AS text, sum(points) AS points FROM (
  SELECT * FROM text_penalties UNION ALL SELECT * FROM structure_penalties) GROUP BY 1) USING (doc_id)""")
def calibration_table(spark, sf):
    return evaluation.calibration_table(diagnosis.judged(rule_queries.inputs(spark, sf)))


@query("e04_word_error_rate")
def word_error_rate(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    pairs = turns.withColumnRenamed("text", "reference").join(following, ["conv_id", "turn"])
    return evaluation.word_error_rate(pairs).select("conv_id", "turn", "wer")
