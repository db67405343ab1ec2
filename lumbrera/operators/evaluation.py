"""Evaluation of model runs and of transcripts."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.functions import text as T
from lumbrera.session import cut


def _mean(value: Column) -> Column:
    return F.bround(F.avg(value), 1)


def _exact_mean(value: Column) -> Column:
    """:func:`_mean` of doubles as the decimals they show (to 12 places), so that no order of adding decides a tie.

    Values that no decimal holds (not a number, 1e18 and beyond) leave the mean of the doubles.
    """
    shown = value.try_cast("decimal(30,12)")
    lost = F.count_if(value.isNotNull() & shown.isNull())
    return F.when(lost == 0, F.bround(F.avg(shown), 1).cast("double")).otherwise(_mean(value))


def _range(value: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws("-", F.min(value), F.max(value)), F.lit("")), F.lit("-"))


def _listed(values: Column, sep: str) -> Column:
    """Different values in order; '-' without any."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(values)), sep), F.lit("")), F.lit("-"))


def summarize_runs(runs: DataFrame) -> DataFrame:
    """Per sample and mode: models, length of the text, runs that worked, latency, tokens, scores, findings, states.

    ``runs``: sample, mode, run, ok, words, model, latency_s, prompt_tokens, output_tokens, thinking_tokens, score,
    ai_score, rules_score, findings, rule_findings, unverified, status_comprension, status_estructura. What a run
    that failed reports is not read; tokens and unverified quotes that are missing count as 0, a missing state as '-'.
    """
    ok = F.col("ok")
    of = lambda c: F.when(ok, F.col(c))
    counted = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0)))
    state = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit("-")))
    return runs.groupBy("sample", "mode").agg(
        _listed(of("model"), ", ").alias("models"), F.min_by("words", "run").alias("words"), F.count_if(ok).alias("runs_ok"), F.count_if(~ok).alias("runs_error"),
        _exact_mean(of("latency_s")).alias("latency_mean"), F.bround(F.min(of("latency_s")), 1).alias("latency_min"), F.bround(F.max(of("latency_s")), 1).alias("latency_max"),
        *[_mean(counted(f"{kind}_tokens")).alias(f"{kind}_tokens_mean") for kind in ("prompt", "output", "thinking")],
        _mean(of("score")).alias("score_mean"), _range(of("score")).alias("score_range"), F.bround(F.stddev_samp(of("score")), 1).alias("score_stdev"),
        _mean(of("ai_score")).alias("ai_score_mean"), _listed(of("rules_score"), "/").alias("rules_score"),
        _range(of("findings")).alias("findings_range"), _range(of("rule_findings")).alias("rule_findings_range"),
        F.coalesce(F.sum(counted("unverified")), F.lit(0)).alias("unverified"), *[_listed(state(f"status_{d}"), "/").alias(f"status_{d}") for d in ("comprension", "estructura")])


LARGEST_COUNTED = 10


def quote_stability(quotes: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Mean Jaccard similarity of the quote sets of all pairs of runs of a sample and mode.

    ``quotes``: sample, mode, run, quote (normalised). ``runs``: sample, mode, run of every run, so that
    those without quotes count: two of them are alike, one and another with quotes are not.

    Pairs are counted, not listed. Quotes that all runs of a group have are set apart. Of what is left, a
    set of up to ``LARGEST_COUNTED`` quotes adds its subsets; how many runs of each size hold a subset tells, for every
    two sizes, how many pairs share at least it, and from the sums over all subsets of each size follows
    how many pairs share exactly i quotes. Larger sets, which no model run of ten findings has, meet the others through
    quotes they share.
    """
    group = ["sample", "mode"]
    sets = quotes.groupBy(*group, "run").agg(F.collect_set("quote").alias("quotes"))
    if runs is not None:
        sets = runs.select(*group, "run").distinct().join(sets, [*group, "run"], "left").withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>")))
    sets = cut(sets)
    totals = sets.groupBy(*group).agg(F.count("*").alias("n"))
    held = sets.select(*group, F.explode("quotes").alias("quote")).groupBy(*group, "quote").agg(F.count("*").alias("holders"))
    everywhere = held.join(totals, group).filter("holders = n").groupBy(*group).agg(F.collect_set("quote").alias("everywhere"))
    rest = F.array_sort(F.array_except("quotes", F.coalesce("everywhere", F.array().cast("array<string>"))))
    own = sets.join(everywhere, group, "left").select(*group, F.coalesce(F.size("everywhere"), F.lit(0)).alias("common"), rest.alias("quotes"))
    weighted = cut(own.groupBy(*group, "common", "quotes").agg(F.count("*").alias("runs")).withColumn("size", F.size("quotes")))
    few, many = weighted.filter(F.col("size") <= LARGEST_COUNTED), weighted.filter(F.col("size") > LARGEST_COUNTED)
    alike = _pairs_by_subsets(few, group).unionByName(_pairs_by_quotes(weighted, many, group))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return totals.join(alike.groupBy(*group).agg(F.sum("total").alias("total")), group, "left").select(
        *group, F.col("n").alias("runs"), F.when(pairs > 0, F.bround(F.coalesce("total", F.lit(0.0)) / pairs, 2)).alias("stability"))


def _similarity(shared: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity of sets of sizes a and b with so many in common; two empty ones are alike."""
    return F.when(a + b - shared == 0, F.lit(1.0)).otherwise(shared / F.greatest(a + b - shared, F.lit(1)))


def _pairs_by_subsets(sets: DataFrame, group: list[str]) -> DataFrame:
    """(group, total): the summed similarity of all pairs of runs with ``sets`` (quotes, size, runs, common)."""
    empty = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("quotes", empty, lambda acc, q: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, q))))
    held = sets.select(*group, "common", "size", "runs", F.explode(subsets).alias("subset"))
    counts = held.groupBy(*group, "common", "subset", "size").agg(F.sum("runs").alias("runs"))
    sizes = counts.groupBy(*group, "common", "subset").agg(F.collect_list(F.struct("size", "runs")).alias("sizes"))  # at most one entry a size
    first = sizes.select(*group, "common", F.size("subset").alias("j"), F.explode("sizes").alias("a"), "sizes")
    both = first.select(*group, "common", "j", "a", F.explode("sizes").alias("b")).filter("a.size <= b.size")
    pairs = F.when(F.col("a.size") == F.col("b.size"), F.col("a.runs") * (F.col("a.runs") - 1) / 2).otherwise(F.col("a.runs") * F.col("b.runs")).cast("decimal(38,0)")
    moments = both.groupBy(*group, "common", "j", F.col("a.size").alias("size_a"), F.col("b.size").alias("size_b")).agg(F.sum(pairs).alias("pairs"))
    # Pairs that share exactly i: alternating sums over the subsets with j >= i of what they share.
    signed = F.element_at(F.array(*[F.array(*[F.lit((-1) ** (j - i) * comb(j, i)) for i in range(j + 1)]) for j in range(LARGEST_COUNTED + 1)]), F.col("j") + 1)
    exact = moments.select(*group, "common", "size_a", "size_b", "pairs", F.posexplode(signed).alias("i", "sign")).groupBy(*group, "common", "size_a", "size_b", "i").agg(
        F.sum(F.col("pairs") * F.col("sign")).cast("double").alias("exactly"))
    shared = F.col("common") + F.col("i")
    value = F.col("exactly") * _similarity(shared, F.col("common") + F.col("size_a"), F.col("common") + F.col("size_b"))
    return exact.filter("exactly <> 0").groupBy(*group).agg(F.sum(value).alias("total"))


def _pairs_by_quotes(sets: DataFrame, large: DataFrame, group: list[str]) -> DataFrame:
    """(group, total): the same for the pairs of which at least one is in ``large``."""
    key = F.array_join("quotes", "\x01").alias("key")
    rows = lambda df: df.select(*group, "common", key, "size", "runs", F.explode("quotes").alias("quote"))
    left, right = rows(large), rows(sets).drop("common").withColumnsRenamed({"key": "key_b", "size": "size_b", "runs": "runs_b"})
    once = (F.col("size_b") <= LARGEST_COUNTED) | (F.col("key") < F.col("key_b"))
    met = left.join(right, [*group, "quote"]).filter(once).groupBy(*group, "common", "key", "key_b", "size", "size_b", "runs", "runs_b").agg(F.count("*").alias("i"))
    both = lambda: (F.col("common") + F.col("size"), F.col("common") + F.col("size_b"))
    extra = _similarity(F.col("common") + F.col("i"), *both()) - _similarity(F.col("common"), *both())
    shared = met.groupBy(*group).agg(F.sum(F.col("runs") * F.col("runs_b") * extra).alias("total"))
    # What every pair has for the common quotes alone; equal sets are alike.
    by_size = lambda df, n: df.groupBy(*group, "common", F.col("size").alias(n)).agg(F.sum("runs").alias(f"r_{n}"))
    crossed = by_size(large, "size").join(by_size(sets, "size_b"), [*group, "common"])
    weight = F.when(F.col("size_b") <= LARGEST_COUNTED, F.col("r_size") * F.col("r_size_b")).when(F.col("size") < F.col("size_b"), F.col("r_size") * F.col("r_size_b")).when(
        F.col("size") == F.col("size_b"), F.col("r_size") * (F.col("r_size") - 1) / 2).otherwise(0)
    base = crossed.groupBy(*group).agg(F.sum(weight * _similarity(F.col("common"), *both())).alias("total"))
    size = F.col("common") + F.col("size")
    same = large.groupBy(*group).agg(F.sum(F.col("runs") * (F.col("runs") - 1) / 2 * (1 - _similarity(F.col("common"), size, size))).alias("total"))
    return shared.unionByName(base).unionByName(same)


def calibration_table(judged: DataFrame) -> DataFrame:
    """Rule metrics and penalties of every document as one readable row. ``judged`` carries the penalties array."""
    text = F.array_join(F.transform("penalties", lambda p: F.concat(p["rule"], F.lit(" -"), p["points"].cast("string"))), ", ")
    points = F.aggregate(F.transform("penalties", lambda p: p["points"]), F.lit(0), lambda a, b: a + b)
    return judged.select(
        "doc_id", "word_count", "sentence_count", F.format_string("%d (%d)", "long_sentences", "severe_long_sentences").alias("long_sentences"),
        "max_sentence_words", "paragraph_count", F.format_string("%d (%d)", "long_paragraphs", "severe_long_paragraphs").alias("long_paragraphs"),
        F.when(text == "", "-").otherwise(text).alias("penalties"), F.greatest(F.lit(0), F.lit(100) - points).alias("rules_score"))


def _as_characters(words: Column, vocabulary: Column) -> Column:
    """A text with one character for each word: the one whose number is the word's place in the vocabulary, past the surrogates."""
    place = lambda w: F.array_position(vocabulary, w)
    number = lambda n: F.when(n + 31 < 0xD800, n + 31).otherwise(n + 31 + 0x800)
    return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(number(place(w))), 8, "0")), "")), "UTF-32")


def word_error_rate(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds wer: words to change in the hypothesis over words of the reference; NULL without any.

    Words become characters, and their edit distance is that of the words. A pair can have as many
    different words as there are characters, about 1 100 000.
    """
    words = lambda c: T.words(F.lower(T.nfkc(F.coalesce(F.col(c), F.lit("")))))
    split = pairs.withColumns({"_reference": words(reference), "_hypothesis": words(hypothesis)})
    known = split.withColumn("_vocabulary", F.array_distinct(F.concat("_reference", "_hypothesis")))
    texts = [_as_characters(F.col(c), F.col("_vocabulary")) for c in ("_reference", "_hypothesis")]
    n = F.size("_reference")
    return known.withColumn("wer", F.when(n > 0, F.levenshtein(*texts) / n)).drop("_reference", "_hypothesis", "_vocabulary")
