"""Model findings checked against the text and merged with rule findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.functions import text as T
from lumbrera.operators.ordered import numbered, top_per_key
from lumbrera.session import cut
from lumbrera.sources.materials import analysis_text

MODEL, VISION, RULES = 0, 1, 2
COLUMNS = ["doc_id", "origin", "rule_order", "pos", "category", "severity", "issue", "original_text", "fragment_found", "source"]


def cap_per_document(ai_findings: DataFrame, k: int = cfg.MODEL_FINDINGS_PER_DOCUMENT) -> DataFrame:
    return top_per_key(ai_findings, ["doc_id"], ["pos"], k).drop("rank")


def verify_quotes(ai_findings: DataFrame, materials: DataFrame) -> DataFrame:
    """Adds fragment_found: every part of the quote occurs in the text the model was given."""
    docs = analysis_text(materials).select("doc_id", T.normalize_quote(F.col("analysis_text")).alias("norm"))
    parted = ai_findings.withColumn("parts", T.fragment_parts(F.col("original_text")))
    return parted.join(docs, "doc_id").withColumn("fragment_found", T.contains_all(F.col("norm"), F.col("parts"))).drop("norm", "parts")


def unverified_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("doc_id").agg(F.count_if(~F.col("fragment_found")).alias("unverified"))


def suppress_covered(rule_findings: DataFrame, verified: DataFrame) -> DataFrame:
    """Rule findings that no verified model finding already points at.

    The join is on the document, with the containment test as its residual. A wall of text only
    counts as covered by a structure finding that quotes its opening.
    """
    long_parts = F.filter(T.fragment_parts(F.col("original_text")), lambda p: F.length(p) >= cfg.MIN_OVERLAP_CHARS)
    model = verified.filter("fragment_found").select("doc_id", F.col("category").alias("m_category"), long_parts.alias("m_parts")).filter(F.size("m_parts") > 0)
    visual = F.col("category") == "accesibilidad_visual"
    anchored = rule_findings.withColumn("norm_anchor", F.when(~visual, T.normalize_quote(F.col("anchor"))))
    anchor, parts = F.col("norm_anchor"), F.col("m_parts")
    opening = (F.col("m_category") == "estructura") & F.startswith(anchor, F.element_at(parts, 1))
    overlap = F.exists(parts, lambda p: F.contains(anchor, p) | F.contains(p, anchor))
    covered = F.when(F.col("category") == "estructura", opening).otherwise(overlap)
    condition = (anchored["doc_id"] == model["doc_id"]) & (F.col("norm_anchor") != "") & covered
    return anchored.join(model, condition, "left_anti").drop("norm_anchor")


def vision_signal_findings(images: DataFrame) -> DataFrame:
    """Findings from what was seen in pictures: colour-only information, text missing from the document."""
    place = F.concat(F.lit("Página "), F.col("page_number").cast("string"), F.lit(", "), F.col("position"))

    def signal(flag: str, order: int, title: str) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), F.struct(
            F.lit(order).alias("rule_order"), F.concat(F.lit(title + " ("), place, F.lit(")")).alias("issue")))

    signals = F.array_compact(F.array(
        signal("relies_on_color", 1, "Imagen con información dependiente solo del color"),
        signal("has_untranscribed_text", 2, "Imagen con texto incrustado ausente en el documento")))
    return images.withColumn("place", place).select("doc_id", "image_id", "place", F.inline(signals)).select(
        "doc_id", F.lit(VISION).alias("origin"), "rule_order", F.col("image_id").alias("pos"), F.lit("accesibilidad_visual").alias("category"),
        F.lit("para_revisar").alias("severity"), "issue", F.col("place").alias("original_text"), F.lit(False).alias("fragment_found"), F.lit("ai").alias("source"))


def _tagged(model: DataFrame, vision: DataFrame, rules: DataFrame) -> DataFrame:
    ai = model.select("doc_id", F.lit(MODEL).alias("origin"), F.lit(0).alias("rule_order"), "pos", "category", "severity", "issue", "original_text", "fragment_found", F.lit("ai").alias("source"))
    own = rules.select("doc_id", F.lit(RULES).alias("origin"), "rule_order", "pos", "category", "severity", "issue", "original_text", "fragment_found", F.lit("rules").alias("source"))
    return ai.unionByName(vision.select(*COLUMNS)).unionByName(own)


# Rules whose finding speaks of the whole document, and those that quote the laid-out file.
_WHOLE_DOCUMENT = ("legibilidad_baja", "pdf_escaneado", "imagenes_sin_verificar", "pdf_sin_titulos", "letra_chica_cuerpo")
_OF_THE_FILE = ("letra_chica_pasajes", "contraste_insuficiente", "colores_daltonismo", *(f"tipografia_{r}" for r in cfg.TYPOGRAPHY_RULES))


def rule_quotes_found(rules: DataFrame, materials: DataFrame) -> DataFrame:
    """Rule findings with fragment_found: true for quotes of the text, NULL without a quote, and for passages of the
    laid-out file whether the text has them, white space aside. Only the last meet the texts."""
    texts = materials.select("doc_id", T.collapse(F.col("raw_text")).alias("collapsed"))
    of_file = F.col("rule").isin(*_OF_THE_FILE)
    quote = T.collapse(F.rtrim(F.coalesce("original_text", F.lit("")), F.lit("…")))
    placed = rules.filter(of_file).join(texts, "doc_id", "left").withColumn("fragment_found", (quote != "") & F.contains("collapsed", quote)).drop("collapsed")
    known = F.when(~F.col("rule").isin(*_WHOLE_DOCUMENT), F.lit(True))
    return rules.filter(~of_file).withColumn("fragment_found", known).unionByName(placed)


def drop_repeated(findings: DataFrame, order: list[str]) -> DataFrame:
    """First of the findings with the same quote and the same issue; findings without a quote all stay."""
    keyed = findings.withColumns({
        "q_key": T.normalize_quote(F.coalesce("original_text", F.lit(""))), "i_key": T.normalize_quote(F.col("issue"))})
    quoted = top_per_key(keyed.filter("q_key <> ''"), ["doc_id", "q_key", "i_key"], order, 1)
    return quoted.drop("rank", "q_key", "i_key").unionByName(keyed.filter("q_key = ''").drop("q_key", "i_key"))


def order_and_number(findings: DataFrame) -> DataFrame:
    """Severe findings first, otherwise in the order they came; barrier_id bar-1, bar-2...

    Numbered through blocks of positions: pictures of one document can be many.
    """
    ranked = findings.withColumn("mild", (F.col("severity") != "barrera_detectada").cast("int"))
    placed = ranked.withColumns({
        # Pictures bring their findings picture by picture; rules bring theirs rule by rule.
        "major": F.when(F.col("origin") == VISION, F.col("pos")).otherwise(F.col("rule_order").cast("long")),
        "minor": F.when(F.col("origin") == VISION, F.col("rule_order").cast("long")).otherwise(F.col("pos")),
    })
    chunk = [F.col("mild"), F.col("origin"), F.floor(F.col("major") / 4096)]
    order = ["major", "minor"]
    done = numbered(placed, ["doc_id"], chunk, order, "n")
    return done.withColumn("barrier_id", F.concat(F.lit("bar-"), F.col("n").cast("string"))).drop("mild", "major", "minor")


def merge_findings(model: DataFrame, vision: DataFrame, rules: DataFrame, materials: DataFrame) -> DataFrame:
    """The report's findings: verified and capped model findings, picture signals, uncovered rule findings.

    What meets the texts is written, since several steps read it again: each text is read once for the model's
    quotes and once for those of the file.
    """
    verified = cut(verify_quotes(cap_per_document(model), materials))
    merged = cut(_tagged(verified, vision, rule_quotes_found(suppress_covered(rules, verified), materials)))
    return order_and_number(cut(drop_repeated(merged, ["origin", "rule_order", "pos"])))


def fallback_diagnosis(documents: DataFrame, ai_scores: DataFrame) -> DataFrame:
    """Who judged each document: the model and the rules, or the rules alone when the model gave nothing."""
    joined = documents.select("doc_id").join(ai_scores, "doc_id", "left")
    alone = F.col("ai_score").isNull()
    return joined.select(
        "doc_id", "ai_score", F.when(alone, "rules").otherwise("ai").alias("provider"),
        F.when(alone, 0.0).otherwise(cfg.AI_WEIGHT).alias("ai_weight"), F.when(alone, 1.0).otherwise(cfg.RULES_WEIGHT).alias("rules_weight"))


def group_by_quote(resolution: DataFrame) -> DataFrame:
    """Findings that cite the same text, counted together with the states they are in.

    ``resolution``: doc_id, n, barrier_id, original_text, resolution_status. Global findings stay apart.
    """
    key = F.when(F.coalesce("original_text", F.lit("")) == "", F.concat(F.lit("global:"), "barrier_id")).otherwise(T.normalize_quote(F.col("original_text")))
    return resolution.withColumn("quote_key", key).groupBy("doc_id", "quote_key").agg(
        F.min("n").alias("first"), F.count("*").alias("findings"),
        *[F.count_if(F.col("resolution_status") == s).alias(s) for s in cfg.PROPOSAL_STATUSES])
