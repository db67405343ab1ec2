"""The corpus pipeline: quality rules, near copies, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. A stage is written as Parquet and read again before the next one.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.llm import decontamination, jaccard_join, packing, quality_rules, surrogates
from lumbrera.llm.queries import SURROGATE_KEY
from lumbrera.llm.shared import recorded, remove, table, unused, written


def _as_row(docs: DataFrame, *also: str) -> DataFrame:
    """Documents as one column, so that no name of theirs can clash, beside the columns that a stage reads."""
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), *also)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source.

    Every row is judged by itself; null and empty texts fail the base rules, equal rows get equal verdicts.
    """
    judged = quality_rules.adaptive_filter(_as_row(docs, "text", "lang", "source"), carry=["_row"])
    return judged.where("kept").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id.

    A row is told apart by its id and text: of rows that share an id only the linked ones go, a group whose ids are
    all null keeps one row, and of equal rows one stays. Documents without words are no member of a
    group, so they all stay.
    """
    text_hash = F.xxhash64("text")
    identity = F.struct(F.col("doc_id").isNull().alias("anonymous"), F.col("doc_id").alias("id"), text_hash.alias("hash"))
    groups = jaccard_join.similar_groups(docs.select(identity.alias("who"), "text"), percent=85, width=4, doc_id="who")
    name = lambda c: F.concat_ws(":", F.hex(f"{c}.hash"), F.coalesce(F.col(f"{c}.id").cast("string"), F.lit("null")))
    members = written(groups.where("n_shingles > 0").select(name("doc_id").alias("name"), name("component_id").alias("head")).groupBy("name").agg(
        F.min("head").alias("head"), F.count(F.lit(1)).alias("n")).where("name <> head OR n > 1"), "near-copies")
    key, of, n = unused(docs, "_key", "_of", "_n")
    keyed = docs.withColumn(key, F.concat_ws(":", F.hex(text_hash), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rest, some = None, keyed
    if members.count() <= jaccard_join.BROADCAST_ROWS:  # 8 bytes a row; texts of rows that are no member stay where they are
        few = F.broadcast(members.select(F.xxhash64("name").alias(of)).distinct())
        rest, some = (keyed.join(few, F.xxhash64(key) == F.col(of), how) for how in ("left_anti", "left_semi"))
    single = some.join(members.select(F.col("name").alias(of)), F.col(key) == F.col(of), "left_anti").select(*docs.columns)
    if rest is not None:
        single = single.unionByName(rest.select(*docs.columns))
    heads = some.join(members.where("name = head").select(F.col("name").alias(of)), F.col(key) == F.col(of)).select(key, F.struct(*[f"`{c}`" for c in docs.columns]).alias(n))
    # Equal rows meet before the shuffle; other columns are those of the row with the least hash.
    one = heads.groupBy(key).agg(F.min_by(n, F.xxhash64(n)).alias(n)).select(f"{n}.*")
    return single.unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten consecutive words of a benchmark item.

    A row is told apart by its id and text; null and empty texts have no passage and stay.
    """
    index = decontamination.build_index(docs, table(spark, sf_dir, "benchmark"), size=10)
    key, of = unused(docs, "_key", "_hit")
    hit = written(decontamination.report(index).where("n_hit > 0").select(F.col("key").alias(of)).distinct(), "contaminated")
    keyed = docs.withColumn(key, decontamination.row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(hit, F.col(key) == F.col(of), "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and the length of the new text.

    Null and empty texts stay as they are; equal texts get equal surrogates.
    """
    new = surrogates.pseudonymize(_as_row(docs, "text"), SURROGATE_KEY)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("text"), "n_chars": length}
    return new.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of a document, with its place in a sequence of at most 2048 ids."""
    pieces = written(packing.cut_into_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1), "pieces")
    return packing.pack(pieces.drop("ids"))


_of_last_stage: list[str] = []


def _tidy(stage):
    """The stage, which first deletes the intermediate tables of the stage before it.

    A stage begins when the result of the one before is written and read again, so what that result
    was made from is no longer needed.
    """
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _of_last_stage)
        _of_last_stage.clear()
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _of_last_stage.extend(made)
        return out

    return run


STAGES = [
    ("quality_rules", _tidy(keep_quality)),
    ("near_copies", _tidy(drop_near_copies)),
    ("decontamination", _tidy(drop_contaminated)),
    ("surrogates", _tidy(replace_personal_data)),
    ("packing", _tidy(pack_sequences)),
]

# Tokens, keyed hashes and similarity over all documents cannot be said in SQL at this size; the tests
# compare with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
