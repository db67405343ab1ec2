"""Documents to paragraphs and sentences, and the per-document text profile the rules read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.functions import text as T
from lumbrera.operators.ordered import last_known


def paragraphs(materials: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per non-blank line: doc_id, pos (from 1), text."""
    return materials.select("doc_id", F.posexplode(T.lines(F.col(text))).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("pos"), "text"
    )


def sentences(paras: DataFrame) -> DataFrame:
    """One row per sentence of each paragraph: doc_id, para, pos (from 1), text."""
    return paras.select(
        "doc_id", F.col("pos").alias("para"), F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "text")
    ).select("doc_id", "para", (F.col("pos") + 1).alias("pos"), "text")


# Letters that equal an ASCII one when case is ignored, but do not become it in lower case.
_ODD_LETTERS = "ſıİ"


def _stems_found(text: Column, lower: str) -> Column:
    """Which sets of stems a text holds one of. A letter that may stand for one of theirs counts as all of them."""
    odd = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in _ODD_LETTERS])
    return F.struct(*[
        reduce(Column.__or__, [odd, *[F.contains(F.col(lower), F.lit(s)) for s in of]]).alias(name) for name, of in cfg.STEMS.items()])


def _all_fragments(text: Column, patterns: tuple[str, ...], stems: tuple[str, ...], found: str) -> Column:
    """Every match of every pattern, stripped, in pattern then text order. Patterns without a stem in the text are passed over."""
    none = F.array().cast("array<string>")
    return F.transform(F.concat(*[
        F.when(F.col(found)[s], F.regexp_extract_all(text, F.lit("(?iuU)" + p), F.lit(0))).when(text.isNotNull(), none)
        for p, s in zip(patterns, stems, strict=True)]), T.strip)


def _first_distinct(found: str, n: int) -> Column:
    """The first n fragments that differ when case is ignored, each as first written."""
    keys = F.transform(found, F.lower)
    return F.slice(F.filter(found, lambda f, i: F.array_position(keys, F.lower(f)) == i + 1), 1, n)


def profile(materials: DataFrame) -> DataFrame:
    """Everything the text rules need, one row per document, in one pass and without a shuffle.

    paragraphs: array<struct<pos,text,words>>; sentences (with at least one word):
    array<struct<pos,text,words,actions>>, actions being the action verbs in order.
    """
    text = F.col("raw_text")
    # Each heavy expression is a column of its own stage: the optimiser keeps stages apart when a
    # column is read more than once, so no regex runs twice.
    stemmed = materials.withColumn("_lower", F.lower(text)).withColumn("_stems", _stems_found(text, "_lower")).drop("_lower")
    staged = stemmed.withColumns({
        "_lines": T.lines(text),
        "_sentences": F.transform(T.split_sentences(text), lambda s: F.struct(s.alias("text"), T.count_words(s).alias("words"))),
        "_visual": _all_fragments(text, cfg.VISUAL_REFERENCE_PATTERNS, cfg.VISUAL_REFERENCE_STEMS, "_stems"),
        "_color": _all_fragments(text, cfg.COLOR_ONLY_PATTERNS, cfg.COLOR_ONLY_STEMS, "_stems"),
        "number_words": T.count_numbers(text),
        "syllables": T.syllable_total(text),
        "has_text": text.rlike(T.NOT_WHITESPACE),
    })
    shaped = staged.withColumns({
        "paragraphs": F.transform(
            "_lines", lambda p, i: F.struct((i + 1).alias("pos"), p.alias("text"), T.count_words(p).alias("words"))
        ),
        "sentences": F.transform(
            F.filter("_sentences", lambda s: s["words"] > 0),
            lambda s, i: F.struct(
                (i + 1).alias("pos"), s["text"].alias("text"), s["words"].alias("words"), T.action_verbs(s["text"]).alias("actions")
            ),
        ),
        "visual_refs": _first_distinct("_visual", cfg.REPORTED_PER_RULE),
        "color_refs": _first_distinct("_color", cfg.REPORTED_PER_RULE),
    }).withColumns({
        # No word reaches over a line break.
        "word_count": F.when(text.isNotNull(), F.aggregate(F.transform("paragraphs", lambda p: p["words"]), F.lit(0), lambda a, b: a + b)),
    }).withColumn("plain_words", F.col("word_count") - F.col("number_words"))
    scanned = (F.col("source_type") == "pdf") & scanned_flag(F.col("word_count"), F.col("image_count"), F.col("page_count"))
    ratio = F.col("syllables") / F.col("plain_words")
    pace = F.col("plain_words") / F.size("sentences")
    seen = F.transform("visual_refs", F.lower)
    return shaped.drop("_lines", "_sentences", "_stems", "_visual", "_color", "number_words").withColumns({
        "color_refs": F.filter("color_refs", lambda c: ~F.array_contains(seen, F.lower(c))),
        "is_scanned": scanned,
        "readability": F.when(
            (F.col("plain_words") >= cfg.MIN_WORDS_FOR_READABILITY) & (F.size("sentences") > 0),
            F.bround(F.lit(206.835) - F.lit(62.3) * ratio - pace, 1),
        ),
    })


def scanned_flag(word_count: Column, images: Column, pages: Column) -> Column:
    """Pages that are pictures: no words at all, or very few and at least one picture per page."""
    return (word_count == 0) | ((word_count < cfg.SCANNED_MAX_WORDS) & (images >= pages))


def context_around(materials: DataFrame, quotes: DataFrame, n: int = cfg.CONTEXT_CHARS) -> DataFrame:
    """Tail of the paragraph before and head of the one after the first paragraph holding the quote.

    ``quotes``: doc_id, quote_id, fragment. The paragraph list stays inside the document row, so the
    only shuffle is the join on doc_id.
    """
    docs = materials.select("doc_id", T.lines(F.col("raw_text")).alias("ps")).withColumn("norm", T.normalize_each(F.col("ps")))
    parted = quotes.withColumn("part", F.try_element_at(T.fragment_parts(F.col("fragment")), F.lit(1))).filter(
        F.col("part").isNotNull()
    )
    joined = parted.join(docs, "doc_id")
    hit = joined.withColumn(
        "at",
        F.array_position(F.transform("norm", lambda p: F.contains(p, F.col("part"))), F.lit(True)).cast("int"),
    ).filter("at > 0")
    before = F.when(F.col("at") > 1, F.right(F.try_element_at("ps", F.col("at") - 1), F.lit(n)))
    after = F.left(F.try_element_at("ps", F.col("at") + 1), F.lit(n))
    return hit.select(
        "doc_id", "quote_id", F.concat_ws("\n[...]\n", before, after).alias("context")
    )


BLOCKS_PER_CHUNK = 4096


def image_context(blocks: DataFrame, limit: int = cfg.CONTEXT_WORDS) -> DataFrame:
    """Nearest text before and after each picture block, joined, at most ``limit`` words.

    ``blocks``: doc_id, pos, kind ('text' or 'image'), text. A document is read in chunks of positions;
    from one chunk to the next goes its first or last text.
    """
    text = F.when(F.col("kind") == "text", F.col("text"))
    chunk = [F.floor(F.col("pos") / BLOCKS_PER_CHUNK)]
    near = last_known(blocks, ["doc_id"], chunk, ["pos"], text, "before")
    near = last_known(near, ["doc_id"], chunk, ["pos"], text, "after", following=True).filter(F.col("kind") == "image")
    snippet = F.concat_ws(" [...] ", T.strip(F.col("before")), T.strip(F.col("after")))
    tokens = T.spaced_words(snippet)
    return near.select(
        "doc_id",
        "pos",
        F.when(F.size(tokens) > limit, F.concat(F.array_join(F.slice(tokens, 1, limit), " "), F.lit("...")))
        .otherwise(snippet)
        .alias("context"),
    )


_SOFT_END = r"(?<=[.!?…:;])" + T.WHITESPACE + "+"


def _pack(pieces: Column, limit: int, sep: str) -> Column:
    """Join neighbouring pieces while they fit in ``limit``; a longer piece stays alone."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, piece: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.length(last) + len(sep) + F.length(piece) <= limit
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(sep), piece)))
        return F.when((F.size(acc) > 0) & fits, grown).otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(pieces, empty, step)


def chunk_text(materials: DataFrame, limit: int, text: str = "raw_text") -> DataFrame:
    """Pieces of at most ``limit`` characters that keep paragraphs, then sentences, then words whole."""

    def units(paragraph: Column) -> Column:
        by_sentence = F.flatten(F.transform(
            F.split(paragraph, _SOFT_END),
            lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(
                _pack(F.transform(T.spaced_words(s), lambda w: F.left(w, F.lit(limit))), limit, " ")
            ),
        ))
        return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(_pack(by_sentence, limit, " "))

    staged = materials.select("doc_id", F.transform(T.lines(F.col(text)), T.collapse).alias("ps"))
    staged = staged.select("doc_id", F.flatten(F.transform("ps", units)).alias("units"))
    return staged.select("doc_id", F.posexplode(_pack(F.col("units"), limit, "\n\n")).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).alias("pos"), "text"
    )
