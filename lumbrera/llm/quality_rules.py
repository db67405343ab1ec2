"""Quality rules whose thresholds follow the data: fences from quantile sketches per language and source.

Every document is measured once, inside its row. A sketch keeps, for each measure, how many
documents have each value, the value rounded down to six significant bits: relative error at most
1/32, a bounded number of counters whatever the number of documents, and two sketches merge by
adding counters. So sketches are summed on the map side, a hot source sends no more counters than a
small one, and the sketch of a language is the sum of those of its sources.

A fence is a quantile of the group, or lies as far beyond one as ``REACH`` times the way from another to it
(``FENCES``). Word length, which every document has, is fenced on both sides of the median by the way
from the first decile to it, which junk does not move until it makes half of a group. The other measures are 0 in
most documents, so their fences are quantiles of the tail: the ninth decile of the symbol rate, so
that a group in which fewer than a tenth have any tolerates none, and one where symbols are usual as many as
are usual there; the quantile 0.995 of repeated lines and words, which clean documents have, too.

A group with few documents has no stable tail: its fence is mixed with that of its language, which is mixed with that of all
documents, in the proportion of its documents to ``PRIOR``. As a sketch rounds down by up to 1/32, a fence
is wider by that much.

Sketches are built from documents that pass the base rules, since documents below 50 words have no
stable ratios.

Defined cases: null or empty text has no words and fails the base rules; null language or source is
a group of its own together with the empty string; documents are judged by value, so equal rows get
equal verdicts; an empty table gives an empty table; columns of the input stay (those with the name
of a measure are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbrera.llm.shared import SPACE_RUN, split_words, unused, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
PRIOR, REACH, SIGNIFICANT_BITS = 200, 4, 6
SYMBOLS = "#*$%&|<>"
# measure -> (near, far, on both sides): quantiles in thousandths; the fence is far + REACH * (far - near), and mirrored if on both sides.
# Symbols per 10 000 words, word length in hundredths, shares in thousandths.
FENCES = {"symbol_rate": (900, 900, False), "word_length": (100, 500, True), "dup_line_share": (995, 995, False), "repeat_share": (995, 995, False)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "base_failed", *FENCES)


def _sorted_grams(words: Column) -> Column:
    """(hash, position) of every 3-word window, equal windows side by side."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.arrays_zip(
        hashed.alias("a"), F.slice(hashed, 2, F.greatest(F.size(hashed) - 1, F.lit(0))).alias("b"),
        F.slice(hashed, 3, F.greatest(F.size(hashed) - 2, F.lit(0))).alias("c"))
    grams = F.transform(windows, lambda g, i: F.struct(F.xxhash64(g["a"], g["b"], g["c"]).alias("g"), i.alias("i")))
    return F.sort_array(F.slice(grams, 1, F.greatest(F.size(words) - 2, F.lit(0))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of its texts, each computed once."""
    out = docs.drop(*[c for c in docs.columns if c.lower() in MEASURES])
    words, lines, grams, twice = unused(out, "_words", "_lines", "_grams", "_twice")
    body = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumns({
        words: split_words(F.col(text), SPACE_RUN),
        lines: F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))})
    out = out.withColumn(grams, _sorted_grams(F.col(words)))
    n = F.size(grams)
    neighbours = F.arrays_zip(
        F.col(grams).alias("own"), F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(F.col(grams), 1, F.greatest(n - 1, F.lit(0)))).alias("left"),
        F.slice(F.col(grams), 2, F.greatest(n - 1, F.lit(0))).alias("right"))
    repeated = F.filter(neighbours, lambda x: x["own"].isNotNull() & (
        x["own"]["g"].eqNullSafe(x["left"]["g"]) | x["own"]["g"].eqNullSafe(x["right"]["g"])))
    out = out.withColumn(twice, F.sort_array(F.transform(repeated, lambda x: x["own"]["i"])))
    # A repeated window covers three words; the next one may start inside it.
    reach = F.zip_with(F.col(twice), F.slice(F.col(twice), 2, F.greatest(F.size(twice) - 1, F.lit(0))), lambda at, after: F.coalesce(F.least(F.lit(3), after - at), F.lit(3)))
    count = lambda c: c.cast("long")
    out = out.withColumns({
        "n_words": count(F.size(words)), "word_chars": count(F.length(F.array_join(F.col(words), ""))),
        "n_symbols": count(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))),
        "n_dup_lines": count(F.size(lines) - F.size(F.array_distinct(F.col(lines)))),
        "n_repeat_words": count(F.aggregate(reach, F.lit(0), lambda a, x: a + x))})
    per = lambda part, factor, whole: F.expr(f"{part} * {factor} div greatest({whole}, 1L)")
    return out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        "symbol_rate": per("n_symbols", 10000, "n_words"), "word_length": per("word_chars", 100, "n_words"),
        "dup_line_share": per("n_dup_lines", 1000, f"CAST(size({lines}) AS BIGINT)"), "repeat_share": per("n_repeat_words", 1000, "n_words"),
    }).drop(words, lines, grams, twice)


def rounded(value: Column) -> Column:
    """``value`` with all but its six leading bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - SIGNIFICANT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, value, n): mergeable counters of the measures of documents that pass the base rules."""
    listed = F.array(*[F.struct(F.lit(m).alias("measure"), rounded(F.col(m)).alias("value")) for m in FENCES])
    rows = measured.where(~F.col("base_failed")).select(*[F.coalesce(F.col(g), F.lit("")).alias(g) for g in groups], F.explode(listed).alias("m"))
    return rows.groupBy(*groups, "m.measure", "m.value").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, measure, low, high) of each group, from its counters."""
    by = [*groups, "measure"]
    merged = sketch.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*by).orderBy("value")  # at most a few thousand counters a group
    ranked = merged.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(Window.partitionBy(*by))})
    level = lambda k: F.create_map(*[F.lit(x) for m, f in FENCES.items() for x in (m, f[k])])[F.col("measure")]
    at = lambda k: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * level(k), F.col("value")))
    quantiles = ranked.groupBy(*by).agg(at(0).alias("near"), at(1).alias("far"), F.max("total").alias("n"))
    # Two quantiles of a narrow distribution may round to one value, though they lie up to 1/32 apart.
    reach = F.when(level(2), REACH * F.greatest(F.col("far") - F.col("near"), F.expr("far div 32"))).otherwise(REACH * (F.col("far") - F.col("near")))
    return quantiles.select(*by, "n", F.when(level(2), F.greatest(F.col("far") - reach, F.lit(0))).otherwise(0).alias("low"), (F.col("far") + reach).alias("high"))


def mixed(n: str, own: str, other: str) -> str:
    """SQL of a group's own fence mixed with another, by its number of documents."""
    return f"({n} * {own} + {PRIOR} * ({other})) div ({n} + {PRIOR})"


def adaptive_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns in ``carry``) with measures, ``base_failed`` and ``kept``."""
    measured = measure(docs, text)
    if carry is not None:
        measured = measured.select(*carry, *[c for c in (lang, source) if c not in carry], *MEASURES)
    measured = written(measured, "measured")
    keys = [lang, source]
    sketch = written(sketches(measured, keys), "sketch")
    own, of_lang, of_all = fences(sketch, keys), fences(sketch, [lang]), fences(sketch, [])
    pick = lambda v: F.expr(mixed("own.n", f"own.{v}", mixed("wide.n", f"wide.{v}", f"every.{v}")))
    chosen = own.alias("own").join(of_lang.alias("wide"), [lang, "measure"]).join(of_all.alias("every"), "measure").select(
        F.col(f"own.{source}").alias("_source"), F.col(lang).alias("_lang"), F.col("measure"), pick("low").alias("low"), pick("high").alias("high"))
    chosen = chosen.withColumns({"low": F.expr("low - low div 32"), "high": F.expr("high + high div 32")})
    limits = written(chosen.groupBy("_lang", "_source").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("_fences")), "fences")  # four entries a group

    of_lang, of_source, held = unused(measured, "_lang", "_source", "_fences")
    limits = limits.toDF(of_lang, of_source, held)
    judged = measured.join(limits, (F.coalesce(F.col(lang), F.lit("")) == F.col(of_lang)) & (F.coalesce(F.col(source), F.lit("")) == F.col(of_source)), "left")
    fence = lambda m: F.col(held)[m]
    inside = [F.coalesce(F.col(m) <= fence(m)["high"], F.lit(True)) & F.coalesce(F.col(m) >= fence(m)["low"], F.lit(True)) for m in FENCES]
    verdict = ~F.col("base_failed")
    for ok in inside:
        verdict = verdict & ok
    return judged.withColumn("kept", verdict).drop(of_lang, of_source, held)
