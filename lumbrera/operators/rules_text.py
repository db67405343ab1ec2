"""Text and structure rules.

Each rule is a column: an array of finding structs computed inside the document row. A document
never leaves its row to be judged, so running one rule or all of them costs one scan and no
shuffle; only headings, which are their own table, are brought in by one join on doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.functions import text as T
from lumbrera.operators.ordered import neighbour, top_per_key
from lumbrera.operators.segments import profile

FINDING = "struct<rule_order:int,rule:string,pos:int,category:string,severity:string,issue:string,original_text:string,anchor:string>"
FINDING_ARRAY = f"array<{FINDING}>"


def _severity(severe: Column) -> Column:
    return F.when(severe, "barrera_detectada").otherwise("para_revisar")


def finding(order: int, rule: str, pos, category: str, severity, issue, quote, anchor) -> Column:
    def text(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        F.lit(order).alias("rule_order"),
        F.lit(rule).alias("rule"),
        (pos if isinstance(pos, Column) else F.lit(pos)).cast("int").alias("pos"),
        F.lit(category).alias("category"),
        text(severity).alias("severity"),
        text(issue).alias("issue"),
        text(quote).alias("original_text"),
        text(anchor).alias("anchor"),
    )


def none_found() -> Column:
    return F.array().cast(FINDING_ARRAY)


def _only(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(none_found())


def _longest(items: str, over: int) -> Column:
    """Items over a length, longest first and in reading order within a length."""
    ranked = F.transform(
        F.filter(items, lambda s: s["words"] > over),
        lambda s: F.struct((-s["words"]).alias("rank"), s["pos"].alias("pos"), s["text"].alias("text")),
    )
    return F.slice(F.array_sort(ranked), 1, cfg.REPORTED_PER_RULE)


def long_sentences() -> Column:
    return F.transform(
        _longest("sentences", cfg.LONG_SENTENCE_WORDS),
        lambda s, i: finding(
            1, "oraciones_extensas", i + 1, "comprension", _severity(-s["rank"] >= cfg.SEVERE_SENTENCE_WORDS),
            F.format_string("Oración extensa (%d palabras)", -s["rank"]), s["text"], s["text"],
        ),
    )


def multi_action_prompts() -> Column:
    """Sentences chaining three or more actions; the first three, which is also how many count."""
    found = F.slice(F.filter("sentences", lambda s: F.size(s["actions"]) >= cfg.ACTIONS_WARN), 1, cfg.REPORTED_PER_RULE)
    return F.transform(
        found,
        lambda s, i: finding(
            2, "consignas_multiaccion", i + 1, "comprension", _severity(F.size(s["actions"]) >= cfg.ACTIONS_SEVERE),
            F.format_string("Consigna con múltiples acciones (%d acciones simultáneas)", F.size(s["actions"])),
            T.excerpt(s["text"], cfg.PROMPT_EXCERPT_WORDS), s["text"],
        ),
    )


def readability() -> Column:
    score = F.col("readability")
    severe = score < cfg.READABILITY_SEVERE
    shown = F.format_string("%.1f", score)
    return _only(
        F.coalesce(score < cfg.READABILITY_WARN, F.lit(False)),
        finding(
            3, "legibilidad_baja", 1, "comprension", _severity(severe),
            F.concat(F.lit("Índice de legibilidad bajo (Szigriszt-Pazos: "), shown, F.lit(" - "),
                     F.when(severe, "Muy difícil").otherwise("Algo difícil"), F.lit(")")),
            F.concat(F.lit("[Evaluación global de legibilidad: IFSZ "), shown, F.lit("]")), None,
        ),
    )


def long_paragraphs() -> Column:
    return F.transform(
        _longest("paragraphs", cfg.LONG_PARAGRAPH_WORDS),
        lambda p, i: finding(
            4, "parrafos_extensos", i + 1, "estructura", _severity(-p["rank"] >= cfg.SEVERE_PARAGRAPH_WORDS),
            F.format_string("Párrafo extenso sin divisiones (%d palabras)", -p["rank"]), T.excerpt(p["text"]), p["text"],
        ),
    )


def _structured() -> Column:
    return (F.col("source_type") != "text") & ~F.col("is_scanned")


def missing_headings_flag() -> Column:
    return _structured() & (F.col("word_count") >= cfg.MIN_WORDS_FOR_HEADINGS) & (F.col("heading_count") == 0)


def no_headings() -> Column:
    place = F.when(F.col("source_type") == "pptx", "diapositiva(s)").otherwise("página(s)")
    return _only(
        missing_headings_flag(),
        finding(
            5, "pdf_sin_titulos", 1, "estructura", "barrera_detectada",
            "Documento extenso sin títulos ni estructura definida",
            F.format_string("[Documento %s: %d %s, %d palabras]", F.upper("source_type"), F.col("page_count"), place, F.col("word_count")),
            None,
        ),
    )


def heading_skips() -> Column:
    return F.transform(
        F.when(_structured(), F.col("reported_skips")).otherwise(F.array().cast("array<struct<pos:int,from_level:int,to_level:int,text:string>>")),
        lambda s, i: finding(
            6, "salto_jerarquia_titulos", i + 1, "estructura", "para_revisar",
            F.format_string("Salto de jerarquía en títulos (de H%d a H%d)", s["from_level"], s["to_level"]), s["text"], s["text"],
        ),
    )


def long_sections() -> Column:
    return F.transform(
        F.slice("sections", 1, cfg.REPORTED_PER_RULE),
        lambda s, i: finding(
            7, "secciones_extensas", i + 1, "estructura", "para_revisar",
            F.format_string("Sección extensa sin subdivisiones (%d palabras)", s["words"]),
            T.excerpt(s["head"], cfg.SECTION_EXCERPT_WORDS), s["head"],
        ),
    )


def _pending_images() -> Column:
    return F.greatest(F.lit(0), F.col("image_count") - F.col("images_with_alt_text"))


def scanned_or_no_alt() -> Column:
    pending, total = _pending_images(), F.col("image_count")
    return F.when(
        F.col("is_scanned"),
        F.array(finding(8, "pdf_escaneado", 1, "accesibilidad_visual", "barrera_detectada",
                        "PDF escaneado sin capa de texto", "[Documento completo: PDF]", None)),
    ).when(
        (total > 0) & (pending > 0),
        F.array(finding(
            8, "imagenes_sin_verificar", 1, "accesibilidad_visual", "para_revisar", "Imágenes sin descripción verificable",
            F.when(F.col("images_with_alt_text") > 0, F.format_string("[%d imagen(es) sin texto alternativo en el documento]", pending))
            .otherwise(F.format_string("[%d imagen(es) en el documento]", total)),
            None,
        )),
    ).otherwise(none_found())


def visual_references() -> Column:
    return F.transform("visual_refs", lambda f, i: finding(
        9, "referencias_visuales", i + 1, "accesibilidad_visual", "para_revisar",
        "Referencia basada únicamente en la posición o aspecto visual", f, f))


def color_only_references() -> Column:
    return F.transform("color_refs", lambda f, i: finding(
        10, "solo_color", i + 1, "accesibilidad_visual", "para_revisar",
        "Información transmitida solo mediante color (WCAG 1.4.1)", f, f))


TEXT_RULES = {
    "long_sentences": long_sentences,
    "multi_action_prompts": multi_action_prompts,
    "readability": readability,
    "long_paragraphs": long_paragraphs,
    "no_headings": no_headings,
    "heading_skips": heading_skips,
    "long_sections": long_sections,
    "scanned_or_no_alt": scanned_or_no_alt,
    "visual_references": visual_references,
    "color_only_references": color_only_references,
}


def heading_summary(headings: DataFrame) -> DataFrame:
    """Per document: heading count, levels, level skips (all counted, the first two kept), heading texts.

    Jumps are read in blocks of positions, so a document with endless headings is still split; of
    the skips themselves only the first two per document are gathered.
    """
    block = [F.floor(F.col("pos") / 4096)]
    stepped = neighbour(headings, ["doc_id"], block, ["pos"], F.struct("level"), "previous", following=False)
    skip = F.col("level") > F.col("previous.level") + 1
    totals = stepped.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("heading_count"),
        F.count_distinct("level").cast("int").alias("hierarchy_levels"),
        F.count_if(skip).cast("int").alias("skip_count"),
        F.min_by("text", "pos").alias("first_heading"),
        F.collect_set(F.lower(T.strip(F.col("text")))).alias("heading_texts"),
    )
    first_skips = (
        top_per_key(stepped.filter(skip), ["doc_id"], ["pos"], cfg.REPORTED_SKIPS)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "pos", F.col("previous.level").alias("from_level"), F.col("level").alias("to_level"), "text"
        ))).alias("reported_skips"))
    )
    return totals.join(first_skips, "doc_id", "left")


def _sections() -> Column:
    """Stretches of text under one heading that exceed the limit, by a fold over the paragraphs.

    A paragraph that contains a heading, or is contained in one, starts a new stretch; the first
    stretch runs under the first heading's name even before it appears.
    """
    closed = "array<struct<head:string,words:int>>"
    start = F.struct(
        F.lit(0).alias("words"), F.col("first_heading").alias("head"), F.array().cast(closed).alias("out")
    )

    def close(acc: Column) -> Column:
        entry = F.struct(acc["head"].alias("head"), acc["words"].alias("words"))
        return F.when((acc["words"] > cfg.LONG_SECTION_WORDS) & (acc["head"] != ""), F.concat(acc["out"], F.array(entry))).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        return F.struct(
            F.when(p["is_head"], F.lit(0)).otherwise(acc["words"] + p["words"]).alias("words"),
            F.when(p["is_head"], p["text"]).otherwise(acc["head"]).alias("head"),
            F.when(p["is_head"], close(acc)).otherwise(acc["out"]).alias("out"),
        )

    # A paragraph is put into lower case once, not once a heading.
    heads = F.transform(F.transform("paragraphs", lambda p: F.lower(p["text"])), lambda clean: F.exists(
        "heading_texts", lambda h: F.contains(clean, h) | F.contains(h, clean)))
    told = F.zip_with("paragraphs", heads, lambda p, h: F.struct(p["text"].alias("text"), p["words"].alias("words"), h.alias("is_head")))
    return F.aggregate(told, start, step, close)


def assess(materials: DataFrame, headings: DataFrame) -> DataFrame:
    """Text profile with heading facts attached: what every rule, metric and penalty reads."""
    no_skips = F.array().cast("array<struct<pos:int,from_level:int,to_level:int,text:string>>")
    joined = profile(materials).join(heading_summary(headings), "doc_id", "left").withColumns({
        "heading_count": F.coalesce("heading_count", F.lit(0)),
        "hierarchy_levels": F.coalesce("hierarchy_levels", F.lit(0)),
        "skip_count": F.coalesce("skip_count", F.lit(0)),
        "reported_skips": F.coalesce("reported_skips", no_skips),
    })
    return joined.withColumn(
        "sections",
        F.when(_structured() & (F.col("heading_count") > 0), _sections()).otherwise(
            F.array().cast("array<struct<head:string,words:int>>")
        ),
    )


def plain_profile(materials: DataFrame) -> DataFrame:
    """Profile of pasted text: no headings table, so no join."""
    return profile(materials).withColumns({
        "heading_count": F.lit(0), "hierarchy_levels": F.lit(0), "skip_count": F.lit(0),
        "reported_skips": F.array().cast("array<struct<pos:int,from_level:int,to_level:int,text:string>>"),
        "sections": F.array().cast("array<struct<head:string,words:int>>"),
    })


def with_findings(assessed: DataFrame, rules=tuple(TEXT_RULES)) -> DataFrame:
    """Adds ``findings``, the findings of the named rules in rule order."""
    parts = [TEXT_RULES[r]() for r in rules]
    return assessed.withColumn("findings", reduce(lambda a, b: F.concat(a, b), parts))


def explode_findings(df: DataFrame) -> DataFrame:
    # The outer form: the inner one makes the optimiser test the whole array, and so repeat what made it, in a filter below.
    return df.select("doc_id", F.inline_outer("findings")).filter(F.col("rule").isNotNull())


def run(assessed: DataFrame, *rules: str) -> DataFrame:
    """Findings of the named rules, one row each."""
    return explode_findings(with_findings(assessed, rules))
