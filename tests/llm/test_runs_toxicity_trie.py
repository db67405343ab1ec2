"""Toxic sentences, periodic runs and the conversation trie against plain versions and on edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbrera.llm import conversation_trie, periodic_runs, queries, toxic_sentences

from .cases import DOCS, documents, prose, with_clashes


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


def crc(value):
    return zlib.crc32(str(value).encode())


# --- periodic runs ---

def runs_by_hand(w):
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            end = j + q
            if j > i and end - i >= max(6, 4 * q) and not any(w[i : end - r] == w[i + r : end] for r in range(1, q)):
                found.append((i, end - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w):
    gone = {k for s, n, q in runs_by_hand(w) for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def repeating(rnd):
    letters, w = rnd.choice([1, 2, 3, 5, 50]), []
    for _ in range(rnd.randrange(8)):
        unit = [f"w{rnd.randrange(letters)}" for _ in range(rnd.randrange(1, 9))]
        w += (unit * 30)[: rnd.randrange(1, 60)] if rnd.random() < 0.5 else [f"w{rnd.randrange(letters)}" for _ in range(rnd.randrange(20))]
    return w


def test_runs_match_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        texts = [repeating(rnd) for _ in range(rnd.randrange(1, 12))]
        for w, got in zip(texts, periodic_runs._searched([" \n".join(w).encode() for w in texts]), strict=True):
            assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == runs_by_hand(w), w
            assert (got["collapsed"], got["n_words"]) == (collapsed_by_hand(w), len(w))


def test_grammar_gives_the_words_back_and_exact_agreements():
    rnd = np.random.default_rng(3)
    words = np.concatenate([[-1], rnd.integers(0, 3, 200), [-2], np.tile([0, 1, 2, 1], 60), [-3], np.zeros(77, int), [-4]])
    levels, top = periodic_runs.grammar(words)
    assert len(top) == 7  # a symbol for each text, and the signs between
    for level, above in zip(levels, [x.symbols for x in levels[1:]] + [top], strict=True):
        below = {}
        for k, name in enumerate(above.tolist()):
            content = tuple(level.symbols[level.down[k] : level.down[k + 1]].tolist())
            assert below.setdefault(name, content) == content
        assert len(set(below.values())) == len(below)
    i = rnd.integers(1, len(words) - 1, 500)
    j = rnd.integers(1, len(words) - 1, 500)
    i, j = i[i != j], j[i != j]
    got = periodic_runs._agreement(levels, top, i, j)
    for a, b, n in zip(i, j, got, strict=True):
        want = 0
        while max(a, b) + want < len(words) and words[a + want] == words[b + want]:
            want += 1
        assert n == want


def test_runs_query_matches_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.recompression_runs(spark, sf).collect()}
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"]) < 5000]
    assert len(rows) > 100
    for r in rows:
        w, h = r["text"].split(), crc(r["doc_id"])
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        runs = runs_by_hand(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *[hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed_by_hand(w))])
        assert tuple(got[r["doc_id"]])[1:] == want
    assert sum(r["n_runs"] for r in got.values()) > 5


def test_runs_on_edge_cases(spark, docs):
    found = periodic_runs.with_runs(with_clashes(docs).withColumn("repeats", F.lit(1)))
    rows = found.collect()
    assert len(rows) == docs.count() and all(r["values"] == "own values" for r in rows)
    by_text = {r["text"]: r["repeats"] for r in rows}
    assert by_text[None]["runs"] == by_text[""]["runs"] == [] and by_text[None]["collapsed"] == by_text[""]["collapsed"] == ""
    long = ("a b c " * 30_000) + "d"
    row = periodic_runs.with_runs(spark.createDataFrame([(long,)], "text string")).first()["repeats"]
    assert [tuple(r) for r in row["runs"]] == [(0, 90_000, 3)] and row["collapsed"] == "a b c d"
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0


# --- toxic sentences ---

def test_noisy_or_finds_sentences_from_document_labels(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        sentences = [prose(1000 * i + k, 12) for k in range(rnd.randrange(3, 20))]
        if i % 3 == 0:
            sentences[rnd.randrange(len(sentences))] += f" {rnd.choice(['zorrible', 'zawful', 'zmean'])} thing"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxic_sentences.train(docs.where("doc_id < 400"), spark.createDataFrame(labels, "doc_id bigint, label int"))
    got = toxic_sentences.score(docs.where("doc_id >= 400"), model).collect()
    assert sum(r["toxicity"]["predicted"] == int(r["doc_id"] % 3 == 0) for r in got) == len(got)
    for r in got:
        for s in r["toxicity"]["sentences"]:
            assert any(w in r["text"][s["start"] : s["start"] + s["length"]] for w in ("zorrible", "zawful", "zmean"))
        assert bool(r["toxicity"]["sentences"]) == (r["doc_id"] % 3 == 0)


def test_scores_are_the_noisy_or_of_the_sentences():
    model = toxic_sentences.Model({"=bad": 0, "=worse": 1, "^wors": 1}, np.array([2.0, 3.0]), -4.0, -5.0)
    find = toxic_sentences.Sentences(model.chosen)
    text = "All is well. Bad! bad and worse\nWorse " + "x " * 100
    found = find(text)
    assert [(text[a:b].split()[0], sorted(f)) for a, b, f in found] == [("Bad", [0]), ("bad", [0, 1, 1]), ("Worse", [1, 1])]
    logistic = lambda z: 1 / (1 + np.exp(-z))
    want = 1 - (1 - logistic(-5)) * (1 - logistic(-2)) * (1 - logistic(4)) * (1 - logistic(2))
    judged = model.judge(found)
    assert abs(judged["score"] - want) < 1e-12 and [round(s["score"], 6) for s in judged["sentences"]] == [round(logistic(4), 6), round(logistic(2), 6)]


def test_loss_gradient_leads_to_the_planted_weights():
    rng = np.random.default_rng(0)
    sizes, flat, document, label = [], [], [], []
    for d in range(400):
        bad = d % 2
        for k in range(4):
            f = [0] if bad and k == 0 else [1]
            sizes.append(1)
            flat += f
            document.append(d)
        label.append(bad if rng.random() > 0.05 else 1 - bad)
    w, offset, leak = toxic_sentences.fit(np.array(label), np.array(document), np.array(sizes), np.array(flat), 2)
    assert offset + w[0] > 1 and offset + w[1] < -2


def test_toxicity_query_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in queries.toxic_sentence_scores(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (crc(i) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(x["toxic"], got[x["doc_id"]]["predicted"]) for x in labels if got[x["doc_id"]]["held_out"]]
    assert sum(p for t, p in held if not t) == 0
    assert sum(p for t, p in held if t) >= 0.6 * sum(t for t, _ in held)  # 500 labels: the rarer languages have too few


def test_toxicity_on_edge_cases(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(None, 1), (9999, 1), (3, None), (400, 1), (400, 0)], "doc_id bigint, label int")
    model = toxic_sentences.train(docs, labels)
    rows = toxic_sentences.score(with_clashes(docs).withColumn("toxicity", F.lit(0)), model).collect()
    assert len(rows) == docs.count() and all(r["score"] == "own score" and 0 <= r["toxicity"]["score"] <= 1 for r in rows)
    none = toxic_sentences.train(docs, labels.limit(0))
    assert not none.chosen and {r["toxicity"]["predicted"] for r in toxic_sentences.score(docs, none).collect()} == {0}
    assert toxic_sentences.score(docs.limit(0), model).count() == 0
    assert toxic_sentences.train(docs.limit(0), labels).chosen == {}


# --- conversation trie ---

def trie_by_hand(conversations):
    """conversations: {id: [(role, text), ...]} -> {(conv_id, depth): row}."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in TRIE) for r in df.select(*TRIE).collect())


def talk(rnd, letters, n):
    return [(rnd.choice(["user", "assistant"]), "é" * rnd.randrange(3) + rnd.choice("abcdef"[:letters])) for _ in range(n)]


def generated(seed):
    rnd, out = random.Random(seed), {}
    hot = talk(rnd, 3, 7)
    for c in range(150):
        out[c] = list(hot) if c % 3 == 0 else hot[: rnd.randrange(8)] + talk(rnd, 1 + c % 3, rnd.randrange(12))
    out[500] = []
    out[501] = hot * 9
    out[502] = hot * 8 + talk(rnd, 3, 5)
    return out


@pytest.mark.parametrize(("width", "shard_rows", "seed"), [(3, 9, 1), (1, 25, 2), (16, 5, 3), (4, 1000, 4), (2, 3, 5)])
def test_trie_matches_brute_force(spark, width, shard_rows, seed):
    told = generated(seed)
    rows = [(c, k * 10, r, t) for c, turns in told.items() for k, (r, t) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    members = spark.createDataFrame([(c,) for c in told], "conv_id bigint")
    numbered = conversation_trie.numbered_turns(turns, shard_rows=40)
    assert trie_rows(conversation_trie.build(members, numbered, width, shard_rows)) == trie_by_hand(told)


def test_trie_on_edge_cases(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 5, "user", "x" * 100_000), (2, None, "user", "first"), (2, 0, "", ""), (None, 0, "user", "lost"), (3, 1, "a", "same"), (3, 1, "a", "same")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({n: F.lit("own") for n in ("key", "k", "shard", "id", "pos", "kind", "ends")})
    told = {1: [("user", "first"), ("", ""), ("user", "x" * 100_000)], 2: [("user", "first"), ("", "")], 3: [("a", "same")] * 2, 7: []}
    members = spark.createDataFrame([(1,), (2,), (3,), (7,), (7,), (None,)], "conv_id bigint")
    assert trie_rows(conversation_trie.build(members, conversation_trie.numbered_turns(turns))) == trie_by_hand(told)
    assert trie_rows(conversation_trie.build(members.where("conv_id = 7"), conversation_trie.numbered_turns(turns.limit(0)))) == trie_by_hand({7: []})
    assert conversation_trie.build(members.limit(0), conversation_trie.numbered_turns(turns.limit(0))).count() == 0


def test_trie_query_matches_brute_force(spark, sf):
    original = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        original[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    told = {c: original.get(c - c % 5, [])[: crc(c) % 9] + own[crc(c) % 9 :] for c, own in original.items()}
    assert trie_rows(queries.conversation_prefix_trie(spark, sf)) == trie_by_hand(told)
