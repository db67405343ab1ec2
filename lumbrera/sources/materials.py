"""Materials: contract, admission, text profile, analysis text, HTML blocks, pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from lumbrera import config as cfg
from lumbrera.functions import text as T
from lumbrera.functions.html import decode_references
from lumbrera.operators.ordered import top_per_key
from lumbrera.operators.segments import scanned_flag

MATERIAL_SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("source", StringType()),
    StructField("source_type", StringType()), StructField("raw_text", StringType()), StructField("page_count", IntegerType()),
    StructField("image_count", IntegerType()), StructField("images_with_alt_text", IntegerType()),
    StructField("created_at", TimestampType()), StructField("expires_at", TimestampType()), StructField("user_id", StringType()),
])


def load_materials(spark: SparkSession, path: str) -> DataFrame:
    """Materials table with its declared schema: no inference pass, columns pruned by the reader."""
    return spark.read.schema(MATERIAL_SCHEMA).parquet(path)


def admit(materials: DataFrame, lo: int = cfg.MIN_TEXT_CHARS, hi: int = cfg.MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) by text length."""
    n = F.length(F.coalesce("raw_text", F.lit("")))
    reason = (
        F.when(~F.coalesce(F.col("raw_text").rlike(T.NOT_WHITESPACE), F.lit(False)), "empty")
        .when(n < lo, "too_short").when(n > hi, "too_long"))
    tagged = materials.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def _is_list_item(line: Column) -> Column:
    return F.regexp_like(line, F.lit(T.LIST_ITEM))


def profile_text(materials: DataFrame) -> DataFrame:
    """Word, character and list-item counts of the trimmed text, scan and emptiness flags, warnings."""
    staged = materials.withColumn("clean", T.strip(F.col("raw_text"))).withColumns({
        "word_count": T.count_words(F.col("clean")), "character_count": F.length("clean"),
        "list_items": F.size(F.filter(T.lines(F.col("clean")), _is_list_item)),
    })
    scanned = (F.col("source_type") == "pdf") & scanned_flag(F.col("word_count"), F.col("image_count"), F.col("page_count"))
    warnings = F.array_compact(F.array(
        F.when(F.col("word_count") > cfg.MAX_ANALYSIS_WORDS, F.format_string(
            f"El material es extenso (%d palabras): se analizan las primeras {cfg.MAX_ANALYSIS_WORDS}.", "word_count")),
        F.when(F.col("word_count") == 0, "El texto no contiene palabras reconocibles."),
        F.when(scanned, "El documento parece escaneado."),
        F.when(F.col("image_count") > 0, F.format_string("Se detectaron %d imagen(es) en el documento.", "image_count")),
    ))
    return staged.select(
        "doc_id", "source_type", "word_count", "character_count", "list_items", scanned.alias("is_scanned"),
        (F.col("word_count") == 0).alias("is_empty"), warnings.alias("warnings"))


def analysis_text(materials: DataFrame, n: int = cfg.MAX_ANALYSIS_WORDS) -> DataFrame:
    """Adds analysis_text and is_truncated: the first n words joined by a space where there are more."""
    staged = materials.withColumn("clean", T.strip(F.col("raw_text"))).withColumn("is_truncated", T.count_words(F.col("clean")) > n)
    head = F.array_join(F.slice(T.words(F.col("clean")), 1, n), " ")
    return staged.withColumn("analysis_text", F.when(F.col("is_truncated"), head).otherwise(F.col("clean"))).drop("clean")


def scanned_documents(materials: DataFrame) -> DataFrame:
    words = T.count_words(F.col("raw_text"))
    return materials.select("doc_id", scanned_flag(words, F.col("image_count"), F.col("page_count")).alias("scanned"))


_HYPHEN_END = r"[\p{L}]-$"


def reflow(materials: DataFrame, text: str = "raw_text") -> DataFrame:
    """Printed lines of a block joined into paragraphs: list items keep their line, cut words are rejoined.

    Blank lines part blocks. A fold over the lines of each block; the open line travels apart from the
    finished ones, so each line is appended once.
    """
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        fresh = acc["open"].isNull() | F.regexp_like(line, F.lit(T.LIST_ITEM))
        cut = F.regexp_like(acc["open"], F.lit(_HYPHEN_END)) & F.regexp_like(line, F.lit(r"^\p{IsLowercase}"))
        closed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        joined = F.when(cut, F.concat(F.left(acc["open"], F.length(acc["open"]) - 1), line)).otherwise(F.concat_ws(" ", acc["open"], line))
        return F.struct(F.when(fresh, line).otherwise(joined).alias("open"), F.when(fresh, closed).otherwise(acc["done"]).alias("done"))

    def fold(block: Column) -> Column:
        return F.array_join(F.aggregate(T.lines(block), start, step, lambda acc: F.array_compact(F.concat(acc["done"], F.array(acc["open"])))), "\n")

    blocks = F.transform(F.split(F.col(text), rf"\n{T.WHITESPACE}*\n"), fold)
    return materials.select("doc_id", F.array_join(F.filter(blocks, lambda b: b != ""), "\n").alias("text"))


_BLOCK = "\x01"


def extract_blocks(pages: DataFrame) -> DataFrame:
    """Ordered text blocks of HTML pages: page_id, pos, kind (heading, list, paragraph), level, text, has_link.

    Tags that open a block become a mark followed by what they are; the page is cut at the marks, and
    character references are decoded in the pieces.
    Everything stays in the page's row until the blocks are exploded.
    """
    html = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", " ")
    html = F.regexp_replace(html, r"[\x{01}-\x{03}]", " ")
    html = F.regexp_replace(html, r"[\s]+", " ")
    html = F.regexp_replace(html, r"(?i)<h([1-6])\b[^>]*>", _BLOCK + "h$1\x02")
    html = F.regexp_replace(html, r"(?i)<li\b[^>]*>", _BLOCK + "li\x02")
    html = F.regexp_replace(html, r"(?i)<a\b[^>]*>", "\x03")
    html = F.regexp_replace(html, r"(?i)</?(?:p|div|article|section|nav|ul|ol|footer|header|main|table|tr|td|th|blockquote|br|hr|body|html|h[1-6]|li)\b[^>]*>", _BLOCK + "p\x02")
    text = F.regexp_replace(html, r"<[^>]*>", "")
    staged = pages.select("page_id", text.alias("marked"))
    parts = F.transform(F.split("marked", _BLOCK), lambda b: F.struct(
        F.substring_index(b, "\x02", 1).alias("tag"), F.when(F.contains(b, F.lit("\x02")), F.substring_index(b, "\x02", -1)).otherwise(b).alias("body")))
    blocks = F.filter(F.transform(parts, lambda p: F.struct(
        p["tag"].alias("tag"), T.collapse(decode_references(F.regexp_replace(p["body"], "\x03", ""))).alias("text"), F.contains(p["body"], F.lit("\x03")).alias("has_link"))),
        lambda b: b["text"] != "")
    rows = staged.select("page_id", F.posexplode(blocks).alias("pos", "b"))
    level = F.when(F.col("b.tag").rlike("^h[1-6]$"), F.substring("b.tag", 2, 1).cast("int"))
    kind = F.when(level.isNotNull(), "heading").when(F.col("b.tag") == "li", "list").otherwise("paragraph")
    return rows.select("page_id", (F.col("pos") + 1).alias("pos"), kind.alias("kind"), level.alias("level"), "b.text", "b.has_link")


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Page text: neighbouring list items on consecutive lines, anything else set apart by a blank line."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "kind", "text")))
    grouped = blocks.groupBy("page_id").agg(listed.alias("bs"))

    def piece(b: Column, i: Column) -> Column:
        previous = F.try_element_at(F.col("bs"), F.when(i > 0, i).otherwise(F.size("bs") + 1))
        sep = F.when(previous.isNull(), "").when((b["kind"] == "list") & (previous["kind"] == "list"), "\n").otherwise("\n\n")
        return F.concat(sep, b["text"])

    return grouped.select("page_id", F.array_join(F.transform("bs", piece), "").alias("text"))


_FILE_NAME_ALT = r"(?iU)^[\w\-. ]+\.(?:png|jpe?g|gif|bmp|tiff?|emf|wmf|svg|webp)$"


def has_alt() -> Column:
    """The picture is described or marked as decorative; a file name describes nothing."""
    alt = F.trim(F.coalesce("alt", F.lit("")))
    return ((alt != "") & ~alt.rlike(_FILE_NAME_ALT)) | F.coalesce("decorative", F.lit(False))


def image_inventory(images: DataFrame) -> DataFrame:
    return images.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(has_alt()).alias("with_alt"), F.count_if(~has_alt()).alias("pending"))


def image_position() -> Column:
    return F.when(F.col("y_norm") < 0.35, "sector superior").when(F.col("y_norm") > 0.65, "sector inferior").otherwise("sector central")


def relevant_images(images: DataFrame, k: int = cfg.IMAGES_PER_DOCUMENT) -> DataFrame:
    """First k pictures of each document that are large enough, as drawn and in their own pixels, and no strip, with
    where they sit on the page. A low one that lies wholly in the head or foot margin is left out.

    ``images``: doc_id, image_id, page_number, width_pt, height_pt, width_px, height_px, and of the page's
    height the shares at the picture's top, middle and bottom: top_norm, y_norm, bottom_norm.
    """
    ratio = F.col("width_px") / F.greatest("height_px", F.lit(1))
    margin = ((F.col("bottom_norm") < cfg.IMAGE_MARGIN) | (F.col("top_norm") > 1 - cfg.IMAGE_MARGIN)) & (F.col("height_pt") < cfg.MARGIN_IMAGE_PT)
    drawn = (F.col("width_pt") >= cfg.MIN_IMAGE_PT) & (F.col("height_pt") >= cfg.MIN_IMAGE_PT)
    own = (F.col("width_px") >= cfg.MIN_IMAGE_PX) & (F.col("height_px") >= cfg.MIN_IMAGE_PX)
    sized = images.filter(drawn & own & ratio.between(cfg.MIN_ASPECT, cfg.MAX_ASPECT) & ~margin)
    return top_per_key(sized, ["doc_id"], ["page_number", "image_id"], k, "image_index").withColumn("position", image_position())
