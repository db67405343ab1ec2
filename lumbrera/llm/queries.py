"""The numbered operators as queries over the given tables, with SQL where SQL can say what they return."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbrera.llm import (
    conversation_trie, decontamination, jaccard_join, line_blocks, packing, pairwise_quality, periodic_runs, quality_rules, sharding, surrogates, token_files,
    toxic_sentences, warc)
from lumbrera.llm.shared import SPACE_RUN, scratch, split_words, table, utf8_bytes, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def id_crc32(of: Column) -> Column:
    return F.crc32(F.encode(of.cast("string"), "utf-8"))


SURROGATE_KEY = "production-key-from-the-caller"


@query("op1_surrogates")
def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(table(spark, sf_dir, "documents"), SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long"))


@query("op2_benchmark_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, s, n, item_id FROM g JOIN p USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return decontamination.report(index).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_sampled_splitters")
def sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    records = table(spark, sf_dir, "documents").select(
        "doc_id", (utf8_bytes(F.col("text")) + 16).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    placed = sharding.shard(records, F.col("text_hash"), F.col("doc_id"), F.col("size"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _fences(name: str, by: str) -> str:
    """SQL of the fences of the groups ``by``: the low and high bound of each measure."""
    keys = f"{by}, measure" if by else "measure"
    return f"""
{name}_run AS (SELECT {keys}, value, sum(n) OVER (PARTITION BY {keys} ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total
  FROM (SELECT {keys}, value, sum(n) AS n FROM sketch GROUP BY {keys}, value)),
{name}_q AS (SELECT {keys}, min(value) FILTER (upto * 1000 >= total * near) AS v_near, min(value) FILTER (upto * 1000 >= total * far) AS v_far, max(total) AS n
  FROM {name}_run JOIN levels USING (measure) GROUP BY {keys}),
{name} AS (SELECT {keys}, n, CASE WHEN measure = 'word_length' THEN greatest(v_far - reach, 0) ELSE 0 END AS low, v_far + reach AS high
  FROM (SELECT *, 4 * CASE WHEN measure = 'word_length' THEN greatest(v_far - v_near, v_far // 32) ELSE v_far - v_near END AS reach FROM {name}_q)),"""


def _mixed(v: str) -> str:
    return f"(own.n * own.{v} + 200 * ((wide.n * wide.{v} + 200 * whole.{v}) // (wide.n + 200))) // (own.n + 200)"


@query("op7_adaptive_quality_rules", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rid, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([s, s + 1, s + 2]) AS place FROM r) GROUP BY rid),
counted AS (SELECT rid, doc_id, lang, source, len(l) AS n_lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (rid)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 10000 // greatest(n_words, 1) AS symbol_rate,
  word_chars * 100 // greatest(n_words, 1) AS word_length, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_share, n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_share FROM counted),
long AS (UNPIVOT measured ON symbol_rate, word_length, dup_line_share, repeat_share INTO NAME measure VALUE v),
sketch AS (SELECT lang, source, measure, v >> greatest(length(bin(v)) - 6, 0) << greatest(length(bin(v)) - 6, 0) AS value, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
levels AS (SELECT * FROM (VALUES ('symbol_rate', 900, 900), ('word_length', 100, 500), ('dup_line_share', 995, 995), ('repeat_share', 995, 995)) AS x(measure, near, far)),""" + _fences("own", "lang, source") + _fences("wide", "lang") + _fences("whole", "") + r"""
fence AS (SELECT lang, source, measure, """ + _mixed("low") + " AS low, " + _mixed("high") + r""" AS high FROM own JOIN wide USING (lang, measure) JOIN whole USING (measure)),
verdicts AS (SELECT long.rid, bool_and(v <= high + high // 32 AND v >= low - low // 32) AS inside FROM long JOIN fence USING (lang, source, measure) WHERE NOT base_failed GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM measured LEFT JOIN verdicts USING (rid)""")
def adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.adaptive_filter(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@query("op9_multi_order_jaccard_join")
def multi_order_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_groups(table(spark, sf_dir, "documents"), percent=85, width=4)
    return found.select("doc_id", "n_shingles", "component_id", "n_members")


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """CRC-32 of 16-bit ids written as little-endian unsigned 32-bit numbers."""
    return ids.map(lambda raw: zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()))


@query("op4_token_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))


@query("op5_warc_segments")
def warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, min_bytes=0)
    found = warc.read(spark, path)
    # What a response says of itself is what its reassembled payload is.
    full = F.when(F.col("type") == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("payload")).cast("long")
    return found.select(
        "page_id", full.alias("payload_bytes"), F.coalesce("found_digest", F.when(F.col("type") == "revisit", F.col("payload_digest"))).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


@query("op6_line_blocks")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op8_pairwise_quality")
def pairwise_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pairwise_quality.score(docs, pairwise_quality.train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_histogram_packing")
def histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = written(packing.cut_into_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=1), "pieces")
    return packing.pack(pieces.drop("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op11_toxic_sentences")
def toxic_sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(id_crc32(F.col("doc_id")), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxic_sentences.score(docs, toxic_sentences.train(docs, labels))
    return judged.select("doc_id", held_out.alias("held_out"), "toxicity.score", "toxicity.predicted", "toxicity.sentences")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts in which every tenth document, by its hash, goes on with copies of some of its own words."""
    h = id_crc32(F.col("doc_id"))
    split = docs.withColumns({"w": split_words(F.col("text"), SPACE_RUN), "g": F.floor(h / 10).cast("int")})
    n = F.size("w")
    placed = split.withColumn("a", F.when((h % 10 == 0) & (n > 0), F.col("g") % n))
    rest = n - F.col("a")
    cycle = placed.withColumn("p", 1 + F.floor(rest / (3 + F.col("g") % 8)).cast("int"))
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    copies = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    rebuilt = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), copies), " ")
    return cycle.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))


@query("op12_recompression_runs")
def recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("repeats.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("repeats.runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("repeats.runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("repeats.collapsed"), 256).alias("collapsed_sha256"))


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations, and their turns after a head of other turns, taken from the conversation c - c % 5, replaced their own."""
    numbered = written(conversation_trie.numbered_turns(turns), "numbered-turns")
    lengths = numbered.groupBy("conv_id").agg(F.max("pos").alias("n"))
    sources = lengths.where("conv_id % 5 = 0").select(F.col("conv_id").alias("source"), F.col("n").alias("n_source"))
    heads = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("source"), (id_crc32(F.col("conv_id")) % 9).alias("h"))
    heads = written(heads.join(sources, "source", "left").withColumn("taken", F.least("h", F.coalesce("n_source", F.lit(0)))), "heads")
    own = numbered.join(heads.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "size")
    given = numbered.where("pos <= 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "source").join(heads.select("conv_id", "source", "h"), "source").where("pos <= h")
    return heads.select("conv_id"), own.unionByName(given.select("conv_id", "pos", "id", "size"))


@query("op13_conversation_trie", r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda v, b: list_reduce(range(8), lambda w, i: xor(w >> 1, (w & 1) * 3988292384), xor(v, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
s AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, pos) AS q FROM r GROUP BY conv_id),
w AS (SELECT conv_id, coalesce(q, []) AS q FROM c LEFT JOIN s USING (conv_id)),
m AS (SELECT conv_id, d, q[1:d] AS p, len(q) = d AS ends FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM w)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].text) END AS own FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, p)),
u AS (SELECT a AS d, p[1:a] AS p, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM b) GROUP BY ALL)
SELECT b.conv_id, b.d AS depth, o.conv_id AS parent_conv_id, b.n_convs, b.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, b.ends_sha256
FROM b JOIN u USING (d, p) LEFT JOIN n AS o ON o.d = b.d - 1 AND o.p = b.p[1:b.d - 1]""")
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations, turns = rebuilt_conversations(table(spark, sf_dir, "conversations"))
    return conversation_trie.build(conversations, turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
