"""The pipeline against plain versions of its stages, and each stage on edge cases."""

import collections
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumbrera.llm import jaccard_join, quality_rules
from lumbrera.llm.shared import written

from .cases import CLASH, DOCS, documents, prose, with_clashes
from .test_free_operators import BYTE, groups_by_hand, near_copies
from .test_native_operators import hits_by_hand


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_agree_with_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]

    kept = written(stage("quality_rules")(spark, docs, sf), "s")
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.adaptive_filter(docs).collect()}
    rows = [r for r in rows if verdict[r[0]]]
    assert kept.columns == docs.columns and collections.Counter(map(tuple, kept.collect())) == collections.Counter(rows)

    single = written(stage("near_copies")(spark, kept, sf), "s")
    root = {i: c for i, _, c in groups_by_hand(rows, 85, 4)}
    rows = [r for r in rows if root[r[0]] == r[0]]
    assert collections.Counter(map(tuple, single.collect())) == collections.Counter(rows)

    clean = written(stage("decontamination")(spark, single, sf), "s")
    hit = {i for i, _, n, _ in hits_by_hand(rows, items, 10) if n}
    assert hit
    rows = [r for r in rows if r[0] not in hit]
    assert collections.Counter(map(tuple, clean.collect())) == collections.Counter(rows)

    private = written(stage("surrogates")(spark, clean, sf), "s")
    new = {r["doc_id"]: r for r in private.collect()}
    assert private.columns == docs.columns and set(new) == {r[0] for r in rows}
    for i, text, *_ in rows:
        mails = re.findall(r"[\w.+-]+@[\w.-]+\.\w+|\d+\.\d+\.\d+\.\d+|\b\d{16}\b|[0-9a-f]{40}", text)
        assert not any(m in new[i]["text"] for m in mails) and new[i]["n_chars"] == len(new[i]["text"])

    packed = stage("packing")(spark, private, sf).collect()
    tok = Tokenizer.from_file(BYTE)
    total = sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in new.values())
    assert sum(r["length"] for r in packed) == total and np.unique([r["doc_id"] for r in packed]).size == len(new)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_cases(spark, sf, name):
    docs = spark.createDataFrame(documents() + near_copies()[:30], DOCS)
    out = stage(name)(spark, with_clashes(docs), sf)
    if name != "packing":
        assert out.columns == with_clashes(docs).columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH if c not in docs.columns)
    else:
        assert out.count() > 0
    assert stage(name)(spark, docs.limit(0), sf).count() == 0


def test_near_copies_keep_one_of_each_group(spark, sf):
    docs = spark.createDataFrame(documents() + near_copies(), DOCS)
    left = stage("near_copies")(spark, docs, sf)
    again = jaccard_join.similar_groups(left, 85, 4).where("doc_id <> component_id")
    assert again.count() == 0 and {r["doc_id"] for r in left.where("doc_id BETWEEN 100 AND 103").collect()} == {100}
    assert left.where("doc_id IS NULL").count() == 2 and left.where("doc_id IN (200, 201, 202)").count() == 3
    assert left.where("doc_id = 400").count() == 1  # equal rows


def test_near_copies_tell_rows_with_one_id_apart(spark, sf):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(0, a), (1, a), (1, b), (None, c), (None, c), (7, c + " more"), (None, prose(4, 80)), (9, None), (9, None), (None, ""), (5, b), (6, prose(6, 80)), (6, prose(7, 80))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], DOCS)
    left = sorted(((r["doc_id"], r["text"]) for r in stage("near_copies")(spark, docs, sf).collect()), key=str)
    want = [(0, a), (1, b), (7, c + " more"), (None, rows[6][1]), (9, None), (9, None), (None, ""), (6, rows[11][1]), (6, rows[12][1])]
    assert left == sorted(want, key=str)


def test_near_copies_leave_texts_of_other_rows_where_they_are(spark, sf, monkeypatch):
    docs = spark.createDataFrame(documents() + near_copies(), DOCS)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the members are many
    try:
        left = stage("near_copies")(spark, docs, sf)
        plan = left._jdf.queryExecution().toString()
        assert re.search(r"BroadcastHashJoin .*LeftAnti", plan)
        rows = collections.Counter(map(tuple, left.collect()))
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)  # all is joined by shuffling
        assert collections.Counter(map(tuple, stage("near_copies")(spark, docs, sf).collect())) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
