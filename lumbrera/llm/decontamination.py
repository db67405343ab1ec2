"""Benchmark decontamination with a distributed positional inverted index.

1. Items are cut into phrases of ``size`` consecutive words (a shorter item is one phrase).
2. The corpus frequency of every term of the phrases is counted over all documents. A phrase with a
   term that never occurs is dropped; of every other phrase the two rarest terms are its seeds.
3. One pass over the documents stores the postings of the seed terms: document, position and the
   words around it, which is all that a phrase through that position can touch. A fixed-size bitmap
   of seed terms lets a row skip other words before anything leaves it; it only saves work.
4. The posting lists of a phrase's two rarest terms, each moved back by the term's offset in the
   phrase, are intersected; what is left counts where the surroundings of the rarest term agree with
   the phrase word by word. Only the outcome of that comparison travels, not the words.
5. With ``slack``, seed terms whose moved positions differ by 1 to ``slack`` words are returned as
   proximity matches. Positions are met through buckets of ``slack`` words, never all with all.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.

Defined cases: null or empty texts have no words, items without words have no phrases; rows with
equal id and text share their matches and are all returned; rows with a null id are told apart by
text; equal items are all reported; an empty corpus or benchmark gives no match; other columns of
the input are ignored by the matches and kept by the caller's join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.shared import NOT_WORD_RUN, ascii_lower, split_words, written

BITMAP_WORDS = 1 << 13  # longs of the bitmap: 64 kB, whatever the number of seed terms


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_WORD_RUN)


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for equal id and text only; never null."""
    return F.concat_ws(":", F.hex(F.xxhash64(text)), F.coalesce(doc_id.cast("string"), F.lit("null")))


@dataclass
class Index:
    """documents: (key, doc_id, n_words). postings: (key, token, pos, first, around). phrases: (number, phrase, terms, seeds). items: (phrase, item_id)."""

    documents: DataFrame
    postings: DataFrame
    phrases: DataFrame
    items: DataFrame


def phrases(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, phrase, terms) of every window of ``size`` words."""
    cut = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    listed = cut.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("terms"))
    return listed.select("item_id", F.array_join("terms", " ").alias("phrase"), "terms").distinct()


def _bit(word: Column) -> tuple[Column, Column]:
    spot = F.pmod(F.xxhash64(word), F.lit(BITMAP_WORDS * 64))
    return F.shiftright(spot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))


def bitmap(terms: DataFrame, column: str) -> Column:
    """A literal array of BITMAP_WORDS longs with the bit of every term set."""
    at, bit = _bit(F.col(column))
    rows = terms.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()  # at most BITMAP_WORDS rows
    bits = [0] * BITMAP_WORDS
    for row in rows:
        bits[row["at"]] = row["bits"]
    return F.from_json(F.lit(str(bits)), "array<bigint>")


def in_bitmap(array: Column, word: Column) -> Column:
    at, bit = _bit(word)
    return F.get(array, at).bitwiseAND(bit) != 0


def build_index(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text") -> Index:
    listed = written(phrases(items, size), "phrases")
    distinct = listed.select("phrase", "terms").distinct()
    vocabulary = written(distinct.select(F.explode("terms").alias("token")).distinct(), "vocabulary")

    read = docs.select(F.explode(words(F.col(text))).alias("token"))
    counts = written(read.join(vocabulary, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "frequencies")

    terms = distinct.select("phrase", "terms", F.posexplode("terms").alias("offset", "token")).join(counts, "token")
    ranked = terms.groupBy("phrase", "terms").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "token"))).alias("seeds"))
    ranked = ranked.where(F.size("seeds") == F.size("terms"))  # every term occurs somewhere
    chosen = written(ranked.select(F.monotonically_increasing_id().alias("number"), "phrase", "terms", F.slice("seeds", 1, 2).alias("seeds")), "seeds")

    wanted = written(chosen.select(F.explode("seeds.token").alias("token")).distinct(), "terms")
    seen = bitmap(wanted, "token")
    split = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    spots = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("token"))), lambda x: in_bitmap(F.col("_bits"), x["token"]))
    first = lambda x: F.greatest(x["pos"] - size + 1, F.lit(0))
    found = F.transform("spots", lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token"), first(x).alias("first"), F.slice(F.col("w"), first(x) + 1, 2 * size - 1).alias("around")))
    # The literal becomes a column of one row's life, so that it is decoded once and not for every word.
    stored = split.withColumn("_bits", seen).select("*", spots.alias("spots")).select("key", "doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found"))
    stored = written(stored, "index")
    postings = stored.select("key", F.explode("found").alias("p")).select("key", "p.*").join(wanted, "token", "left_semi")
    return Index(stored.select("key", "doc_id", "n_words"), postings, chosen, listed.select("phrase", "item_id"))


def _moved(index: Index, which: int) -> DataFrame:
    """(number, key, start, same, n_seeds): postings of each phrase's seed ``which``, moved back by its offset.

    ``same`` tells whether the words around the posting are the phrase.
    """
    seed = F.get("seeds", F.lit(which))
    seeds = index.phrases.where(F.size("seeds") > which).select("number", "terms", F.size("seeds").alias("n_seeds"), seed["token"].alias("token"), seed["offset"].alias("offset"))
    found = index.postings.join(seeds, "token").withColumn("start", F.col("pos") - F.col("offset")).where(F.col("start") >= 0)
    same = F.slice("around", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.size("terms")) == F.col("terms")
    return found.select("number", "key", "start", same.alias("same"), "n_seeds")


def phrase_matches(index: Index) -> DataFrame:
    """(key, phrase, start, length) of every exact occurrence."""
    rarest, second = _moved(index, 0), _moved(index, 1).select("number", "key", "start")
    lone = rarest.where(F.col("n_seeds") == 1)
    both = rarest.where(F.col("n_seeds") > 1).join(second, ["number", "key", "start"], "left_semi")
    found = both.select(*lone.columns).unionByName(lone).where("same")
    return found.join(index.phrases.select("number", "phrase", F.size("terms").alias("length")), "number").select("key", "phrase", "start", "length")


def proximity_matches(index: Index, slack: int) -> DataFrame:
    """(key, phrase, start, distance): both seeds of a phrase nearly, but not exactly, where the phrase puts them."""
    if slack < 1:
        raise ValueError("slack is a number of words above 0")
    bucket = F.floor(F.col("start") / slack)
    rarest = _moved(index, 0).select("key", "number", "start", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    second = _moved(index, 1).select("key", "number", F.col("start").alias("other"), bucket.alias("bucket"))
    near = rarest.join(second, ["key", "number", "bucket"]).withColumn("distance", F.abs(F.col("start") - F.col("other")))
    least = near.where(F.col("distance").between(1, slack)).groupBy("key", "number", "start").agg(F.min("distance").alias("distance"))
    return least.join(index.phrases.select("number", "phrase"), "number").select("key", "phrase", "start", "distance")


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, stop) spans."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto"))
    return F.aggregate(spans, begin, step, lambda a: a["n"])


def report(index: Index) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items): hit words and items of every document, found or not."""
    hits = written(phrase_matches(index).distinct(), "hits")
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"))
    items = hits.select("key", "phrase").distinct().join(index.items, "phrase").groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = spans.join(items, "key").select("key", covered(F.col("spans")).alias("n_hit"), "items")
    return index.documents.join(found, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
