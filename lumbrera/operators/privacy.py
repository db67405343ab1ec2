"""Personal-data findings of a corpus, and the gate they feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.functions import privacy as P
from lumbrera.functions import text as T
from lumbrera.operators.ordered import top_per_key


def with_findings(materials: DataFrame, text: str = "raw_text", out: str = "findings") -> DataFrame:
    """``materials`` with their findings in order of appearance: finding_id, type, label, masked, line, start.

    Everything stays in the document's row, and the values themselves do not leave this step. Line breaks
    are counted from one finding to the next.
    """
    found = P.personal_data(materials, text, "_found")
    starts = F.transform("_found", lambda m: m["start"])
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0)))), starts, lambda a, b: F.regexp_count(
        F.substring(F.col(text), a + 1, b - a), F.lit("\n")))
    lines = F.aggregate(gaps, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1)) + n))
    counted = found.withColumn("_lines", F.when(F.size("_found") > 0, lines))
    label = F.create_map(*[F.lit(x) for kv in P.TYPE_LABELS.items() for x in kv])

    def shown(m: Column, line: Column) -> Column:
        masked = T.collapse(F.concat(m["label"], P.mask(m["type"], m["value"]), m["rest"]))
        return F.struct(
            F.concat_ws("-", m["type"], m["start"]).alias("finding_id"), m["type"].alias("type"), F.try_element_at(label, m["type"]).alias("label"),
            masked.alias("masked"), line.alias("line"), m["start"].alias("start"))

    listed = F.when(F.size("_found") > 0, F.zip_with("_found", "_lines", shown)).otherwise(
        F.array().cast("array<struct<finding_id:string,type:string,label:string,masked:string,line:int,start:int>>"))
    return counted.withColumn(out, listed).drop("_found", "_lines")


def detect_pii(materials: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per finding: id, type, label, masked text and line. The value itself never leaves this step."""
    found = with_findings(materials.select("doc_id", text), text)
    return found.select("doc_id", F.inline_outer("findings")).filter(F.col("finding_id").isNotNull())


def route(judged: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """``judged`` documents (see :func:`with_findings`) with ``blocked``: some finding has not been dismissed.

    One detection and no text leaves its row: only the ids of dismissed findings (doc_id, finding_id) are joined.
    """
    ids = F.transform("findings", lambda m: m["finding_id"])
    if dismissed is None:
        return judged.withColumn("blocked", F.size("findings") > 0)
    settled = dismissed.groupBy("doc_id").agg(F.collect_set("finding_id").alias("_dismissed"))
    open_ = F.array_except(ids, F.coalesce("_dismissed", F.array().cast("array<string>")))
    return judged.join(settled, "doc_id", "left").withColumn("blocked", F.size(open_) > 0).drop("_dismissed")


def report_of(judged: DataFrame, k: int = cfg.PII_REPORTED) -> DataFrame:
    """First k findings of each document with the document's total, from the array in its row."""
    rows = judged.select("doc_id", F.size("findings").cast("long").alias("total"), F.posexplode(F.slice("findings", 1, k)).alias("at", "m"))
    return rows.select("doc_id", "m.*", (F.col("at") + 1).alias("rank"), "total")


def gate_pii(materials: DataFrame, findings: DataFrame, dismissed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clear, blocked) documents: blocked while any finding has not been dismissed."""
    pending = findings.join(dismissed.select("doc_id", "finding_id"), ["doc_id", "finding_id"], "left_anti").select("doc_id").distinct()
    return materials.join(pending, "doc_id", "left_anti"), materials.join(pending, "doc_id", "left_semi")


def pii_report(findings: DataFrame, k: int = cfg.PII_REPORTED) -> DataFrame:
    """First k findings of each document with the document's total."""
    totals = findings.groupBy("doc_id").agg(F.count("*").alias("total"))
    return top_per_key(findings, ["doc_id"], ["start"], k).join(totals, "doc_id")


def redact_secrets(texts: DataFrame, column: str) -> DataFrame:
    return P.redact(texts, column)
