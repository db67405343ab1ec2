"""Quality scores from pairwise preferences (Bradley-Terry) on features of the text.

A document labelled good is preferred to one labelled bad. The chance of a preference is the logistic
function of the difference of two scores, and a score is linear in the features, so the weights follow
from logistic loss on feature differences, without an intercept. The fit uses at most ``MAX_LABELLED``
labelled documents, those with the least hash of their id, and ``PAIRS`` preferences drawn among them
with a fixed seed; scoring covers every document.

The threshold is a quantile of the scores of the fitted documents: of all quantiles in steps of
1/``STEPS`` the one with the fewest errors, the middle one of equals. The score that
is returned is the logistic of the distance to that threshold, shifted so that the threshold is 0.3.

Features are functions of the text alone. Rates are taken per word or character and through a square
root, so that a few symbols and many do not differ by the same factor as none and a few.

Defined cases: null or empty text has zero features, no word and is scored like any other; labels of
unknown documents and null labels are ignored; where one kind of label is missing, all weights are 0
and every score is 0.3; repeated rows get equal scores; an empty table gives an empty table; columns of the
input stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.shared import SPACE_RUN, split_words, unused

MAX_LABELLED, PAIRS, STEPS, SEED, PENALTY, CUT = 20_000, 100_000, 200, 7, 1e-3, 0.3
SYMBOLS = "#*$%&|<>{}[]\\^~=+_@"
FEATURES = ("symbols", "pipes", "shouts", "capitals", "digits", "punctuation", "same_words", "same_triples", "same_lines", "word_length", "long_words", "short", "line_words", "non_ascii")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with a column for each feature, and the names of these columns."""
    words, lines, body, hashes, *names = unused(docs, "_words", "_lines", "_body", "_hashes", *[f"_f_{f}" for f in FEATURES])
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({words: split_words(F.col(body), SPACE_RUN), lines: F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")})
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    b, w = F.col(body), F.col(words)
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(body), F.lit(1))
    after = lambda k: F.slice(hashes, k + 1, F.greatest(F.size(hashes) - k, F.lit(0)))
    triples = F.transform(F.arrays_zip(F.col(hashes).alias("a"), after(1).alias("b"), after(2).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    root = lambda x: F.sqrt(x)
    values = {
        "symbols": root(_count(b, SYMBOLS) / n), "pipes": root(_count(b, "|") / n), "shouts": root(_count(b, "!?") / n),
        "capitals": root(_count(b, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars), "digits": root(_count(b, "0123456789") / chars),
        "punctuation": root(_count(b, ".,;:'\"()-") / n), "same_words": 1 - F.size(F.array_distinct(w)) / n, "same_triples": 1 - F.size(F.array_distinct(triples)) / n,
        "same_lines": 1 - F.size(F.array_distinct(F.col(lines))) / F.greatest(F.size(lines), F.lit(1)),
        "word_length": F.least(F.log1p(F.length(body) / n), F.lit(6.0)), "long_words": F.size(F.filter(w, lambda x: F.length(x) > 14)) / n,
        "short": 1 / (1 + F.size(words) / 20), "line_words": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
        "non_ascii": root((F.octet_length(b) - F.length(b)) / chars)}
    out = out.withColumns({c: values[f].cast("double") for c, f in zip(names, FEATURES, strict=True)})
    return out.drop(words, lines, body, hashes), names


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def strength(self, features: list[str]) -> Column:
        """The Bradley-Terry score of a row."""
        out = F.lit(0.0)
        for name, m, s, w in zip(features, self.mean, self.scale, self.weights, strict=True):
            out = out + (F.col(name) - F.lit(float(m))) * F.lit(float(w / s))
        return out

    def score(self, features: list[str]) -> Column:
        shift = float(np.log(CUT / (1 - CUT)))
        away = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (self.strength(features) - F.lit(self.threshold)) / F.lit(self.spread)))
        # At the threshold itself the logistic is 0.3 but for rounding.
        return F.when(away == 0, F.lit(CUT)).otherwise(1 / (1 + F.exp(-(away + F.lit(shift)))))


def fit(x: np.ndarray, label: np.ndarray) -> Ranker:
    """Weights from preferences of label 1 over label 0, by Newton steps on the penalised logistic loss."""
    if len(x):
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    else:
        mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    z = (x - mean) / scale
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(x.shape[1]), 0.0, 1.0)
    rng = np.random.default_rng(SEED)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # chance of the opposite preference
        gradient = -(d * p[:, None]).mean(0) + PENALTY * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + PENALTY * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    cuts = np.quantile(s, np.arange(1, STEPS) / STEPS)
    right = np.array([(s[good] >= c).sum() + (s[bad] < c).sum() for c in cuts])
    best = np.flatnonzero(right == right.max())
    return Ranker(mean, scale, w, float(cuts[best[len(best) // 2]]), float(max(s.std(), 1e-6)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Ranker:
    """A ranker from ``labels`` (doc_id, label 0 or 1) and the texts of the labelled documents."""
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"))
    wanted = wanted.orderBy(F.xxhash64("_id"), "_id", "_label").limit(MAX_LABELLED)
    texts = docs.select(F.col(doc_id).alias("_of"), F.col(text).alias("_text")).join(F.broadcast(wanted), F.col("_of") == F.col("_id"))  # at most MAX_LABELLED rows
    rows, names = with_features(texts, "_text")
    # Repeated ids could bring more rows than labels: one row for each.
    rows = rows.groupBy("_id", "_label").agg(*[F.min(n).alias(n) for n in names]).orderBy("_id", "_label").toPandas()
    return fit(rows[names].to_numpy(float), rows["_label"].to_numpy())


def score(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows, names = with_features(docs.select(*kept), text)
    return rows.select(*kept, ranker.score(names).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
