"""Toxicity of documents and the sentences that cause it, by multiple-instance learning.

Only documents are labelled. A sentence has a score, the logistic function of a weighted sum of its
features, and a document's score is their noisy-or: 1 - (1 - leak) * product of (1 - sentence score).
The leak is the chance of a label that no sentence explains; with it a long text is not suspected for
its length. Weights, offset and leak minimise the logistic loss of the document labels (``STEPS`` of a
full-batch descent with moments, penalty ``PENALTY`` on the weights), so what a sentence
gets follows from labels of documents alone.

A sentence ends at a full stop, exclamation or question mark or line end; one of more than ``SPAN``
words is read as several of that length. Its features are its distinct words and their first letters
(``PREFIXES``), as far as a feature is among the ``FEATURES`` with the largest likelihood ratio
(``LEAST_RATIO`` at least) of those that more of the toxic than of the other documents have. A
sentence without such a feature scores 0.

The fit uses at most ``MAX_LABELLED`` labelled documents with their whole texts, those with the least
hash of their id; scoring covers every document and every sentence.

Defined cases: null and empty texts and texts without such a feature score the leak; labels that are
null or of unknown documents are ignored, a document with both labels counts as toxic, and of several
rows with one labelled id the least text is learned from; without labelled rows, or with one kind
only, no feature is chosen; very long texts are scored whole; equal rows get equal results; an
empty table gives an empty table; columns of the input stay, but one named like ``out`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbrera.llm.shared import written

MAX_LABELLED, FEATURES, LEAST_RATIO, LEAST_DOCS, PREFIXES, SPAN, CUT = 20_000, 4096, 10.0, 3, (4, 5, 6), 40, 0.3
STEPS, RATE, PENALTY, START = 400, 0.1, 0.3, (-2.0, -4.0)
CACHED = 500_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
SENTENCE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])
JUDGED = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("sentences", pa.list_(SENTENCE))])
JUDGED_TYPE = (
    T.StructType().add("score", "double").add("predicted", "integer")
    .add("sentences", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("score", "double"))))


def features(word: str) -> list[str]:
    word = word.lower()
    return ["=" + word, *["^" + word[:k] for k in PREFIXES if len(word) > k]]


class Sentences:
    """Finds the sentences of a text that hold chosen features."""

    def __init__(self, chosen: dict[str, int]):
        self.chosen = chosen
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, token: str) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = self.known[token] = tuple(self.chosen[f] for f in features(token) if f in self.chosen) if token not in ".!?\n" else ()
        return found

    def __call__(self, text: str | None) -> list[tuple[int, int, list[int]]]:
        """(start, end, features) of the sentences with a feature; a feature stands once for each distinct word that has it."""
        tokens = TOKEN.findall(text or "")
        known = self.known
        if not any([known[t] if t in known else self._of(t) for t in set(tokens)]):
            return []
        out, words, begin, end, n = [], set(), None, 0, 0

        def close():
            found = [f for w in sorted(words) for f in self._of(w)]
            if found:
                out.append((begin, end, found))

        for m, token in zip(TOKEN.finditer(text), tokens, strict=True):
            if token in ".!?\n" or n == SPAN:
                if n:
                    close()
                words, begin, n = set(), None, 0
            if token in ".!?\n":
                continue
            begin, end, n = m.start() if begin is None else begin, m.end(), n + 1
            words.add(token.lower())
        if n:
            close()
        return out


@dataclass
class Model:
    chosen: dict[str, int]
    weights: np.ndarray
    offset: float
    leak: float

    def judge(self, sentences: list[tuple[int, int, list[int]]]) -> dict:
        """Score of a document, and the sentences at or above the threshold, or else the highest of a toxic document."""
        z = np.array([self.offset + self.weights[f].sum() for _, _, f in sentences])
        score = float(-np.expm1(-np.logaddexp(0, self.leak) - np.logaddexp(0, z).sum()))
        each = 1 / (1 + np.exp(-z))
        shown = each >= CUT
        if score >= CUT and len(z) and not shown.any():
            shown = each == each.max()
        return {
            "score": score, "predicted": int(score >= CUT),
            "sentences": [{"start": s, "length": e - s, "score": float(p)} for (s, e, _), p, k in zip(sentences, each, shown, strict=True) if k]}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (feature, documents labelled 1, documents labelled 0) of each batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            words = set(TOKEN.findall(text.as_py() or "")) - set(".!?\n")
            counts[label].update({f for w in words for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0)]], names=["feature", "toxic", "clean"])


def _described(chosen: dict[str, int]):
    """(id, text, label) -> the sentences with features: number of features of each, and all features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Sentences(chosen)
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column("text")]
            sizes, flat = [[len(f) for _, _, f in s] for s in found], [[x for _, _, f in s for x in f] for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(sizes, pa.list_(pa.int32())), pa.array(flat, pa.list_(pa.int32()))], names=["id", "label", "sizes", "features"])

    return run


def _likelihood_ratio(a: Column, b: Column, n: Column, m: Column) -> Column:
    """How far the shares a / n and b / m are from one common share."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (a + b) / (n + m)
    return 2 * (part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share)))


def fit(label: np.ndarray, document: np.ndarray, sizes: np.ndarray, flat: np.ndarray, n_features: int) -> tuple[np.ndarray, float, float]:
    """Weights, offset and leak (as logits). ``document`` and ``sizes`` tell of each sentence whose it is and how many
    of the features ``flat`` belong to it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.append(np.zeros(n_features), START)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1 if len(label) else 1):
        z = theta[-2] + np.bincount(row, theta[flat], len(sizes))
        kept = -np.logaddexp(0, theta[-1]) - np.bincount(document, np.logaddexp(0, z), len(label))  # log of 1 - score
        pull = np.where(label == 1, -np.exp(kept) / np.maximum(-np.expm1(kept), 1e-9), 1.0)
        by_sentence = pull[document] / (1 + np.exp(-z))
        slope = np.append(np.bincount(flat, by_sentence[row], n_features) + PENALTY * theta[:-2], [by_sentence.sum(), pull.sum() / (1 + np.exp(-theta[-1]))])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """A model from ``labels`` (doc_id, label 0 or 1) and the whole texts of the labelled documents."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    wanted = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(wanted), F.col("of") == F.col("id"))  # at most MAX_LABELLED rows
    sample = written(texts.groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
    totals = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n"), (F.count("*") - F.coalesce(F.sum("label"), F.lit(0))).alias("m")).first()
    counts = sample.select("text", "label").mapInArrow(_counted, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n, m = F.lit(totals["n"]), F.lit(totals["m"])
    rated = counts.where(F.col("a") >= LEAST_DOCS).where(F.col("a") * m > F.col("b") * n).withColumn("ratio", _likelihood_ratio(F.col("a"), F.col("b"), n, m))
    names = [r["feature"] for r in rated.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(FEATURES).collect()]
    chosen = {f: k for k, f in enumerate(names)}
    id_type = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(_described(chosen), f"id {id_type}, label int, sizes array<int>, features array<int>").orderBy("id").toPandas()  # at most MAX_LABELLED rows
    joined = lambda lists: np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in lists]])
    document = np.repeat(np.arange(len(rows)), [len(x) for x in rows["sizes"]])
    weights, offset, leak = fit(rows["label"].to_numpy(), document, joined(rows["sizes"]), joined(rows["features"]), len(names))
    return Model(chosen, weights, offset, leak)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct: score, predicted, and the offending sentences (start and length in characters, score)."""
    find = Sentences(model.chosen)

    @F.arrow_udf(JUDGED_TYPE)
    def judged(texts: pa.Array) -> pa.Array:
        return pa.array([model.judge(find(t.as_py())) for t in texts], JUDGED)

    return docs.withColumn(out, judged(F.col(text)))
