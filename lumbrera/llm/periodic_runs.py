"""Periodic runs of words, found with a grammar made by recompression.

A run is a stretch of consecutive words with smallest period q, at least ``REPEATS`` * q and ``LEAST``
words long, that no neighbouring word extends. The words of some documents, set one after another with
a sign of its own between two documents, are compressed again and again: first every block of one
symbol becomes a symbol, then every pair of a left and a right symbol. The sides of the symbols are
dealt so that at least a quarter of all pairs goes in the mean. The levels are a run-length grammar:
two symbols of a level are equal exactly if the words below them are. How far two places agree is
asked from the grammar (:func:`_agreement`): up while both places begin a symbol of the next level, or
do so after one step, then down again where the symbols differ. Nothing is hashed and no suffix is sorted.

A run of period q holds at least ``REPEATS`` places that are multiples of q, all with the same word.
So for every q only the places of that grid whose next three multiples have the same word are
candidates (n/1 + n/2 + n/3 ... places in all), and the grammar tells how far each reaches to both sides.
A candidate whose stretch a run of a smaller period covers is left out.

Each document is searched alone and whole, ``WORDS`` words of documents at a time (or one longer
document), so a task holds one bounded piece whatever the number of documents.

Defined cases: null and empty texts have no words and no run, and collapse to the empty text; a very long text is
searched whole; equal rows give equal results; an empty table gives an empty table; columns of the
input stay, but one named like ``out`` is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS, LEAST, REPEATS = 300_000, 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_TYPE = T.StructType().add("n_words", "long").add("runs", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))).add("collapsed", "string")


@dataclass
class Level:
    """``symbols``, and how the next level is made of them."""

    symbols: np.ndarray
    begins: np.ndarray  # of each symbol: does a symbol of the next level begin here
    up: np.ndarray  # of each symbol: the place of the one above
    down: np.ndarray  # of each symbol above: the place of its first one here; then the number of symbols here
    blocks: bool

    def mirrored(self) -> Level:
        ends = np.append(self.begins[1:], True)
        return Level(self.symbols[::-1], ends[::-1], (len(self.down) - 2 - self.up)[::-1], len(self.symbols) - self.down[::-1], self.blocks)


def _named(symbols: np.ndarray, begins: np.ndarray, second: np.ndarray, blocks: bool) -> tuple[Level, np.ndarray]:
    """The level and the symbols above: a name for each kind of (first symbol, ``second``); signs between documents stay."""
    down = np.flatnonzero(begins)
    first = symbols[down]
    above, word = first.copy(), first >= 0
    above[word] = np.unique(first[word] * (second.max() + 2) + second[word], return_inverse=True)[1]
    return Level(symbols, begins, np.cumsum(begins) - 1, np.append(down, len(symbols)), blocks), above


def _sides(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A left or right side for each symbol, another dealing in every turn."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) & np.uint64(1) == 1


def grammar(symbols: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels from ``symbols`` (negative ones, each used once, are never merged) and the symbols on top."""
    levels: list[Level] = []
    turn = 0
    while True:
        new = np.append(True, symbols[1:] != symbols[:-1])
        if not new.all():
            lengths = np.diff(np.append(np.flatnonzero(new), len(symbols)))
            level, symbols = _named(symbols, new, lengths, True)
            levels.append(level)
        joined = (symbols[1:] >= 0) & (symbols[:-1] >= 0)
        if not joined.any():
            return levels, symbols
        side = _sides(symbols, turn)
        turn += 1
        pairs = joined & side[:-1] & ~side[1:]
        other = joined & ~side[:-1] & side[1:]
        pairs = other if other.sum() > pairs.sum() else pairs
        if pairs.any():
            begins = np.append(True, ~pairs)
            at = np.flatnonzero(begins)
            second = np.where(np.append(pairs, False)[at], np.append(symbols, 0)[at + 1] + 1, 0)
            level, symbols = _named(symbols, begins, second, False)
            levels.append(level)


def _agreement(levels: list[Level], top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from places ``i`` and ``j`` on are the same (``i`` and ``j`` differ everywhere)."""
    p, q = i.copy(), j.copy()
    height = np.full(len(i), len(levels))
    live = np.arange(len(i))
    for h, level in enumerate(levels):
        a, b = p[live], q[live]
        step = (level.symbols[a] == level.symbols[b]) & ~(level.begins[a] & level.begins[b])
        if level.blocks:
            rest = np.minimum(level.down[level.up[a] + 1] - a, level.down[level.up[b] + 1] - b)
            a, b = a + rest * step, b + rest * step
        else:
            a, b = a + step, b + step
        same = level.symbols[a] == level.symbols[b]
        p[live], q[live] = np.where(same, level.up[a], a), np.where(same, level.up[b], b)
        height[live[~same]] = h
        live = live[same]
        if not len(live):
            break
    while len(live):
        live = live[top[p[live]] == top[q[live]]]
        p[live] += 1
        q[live] += 1
    for h in range(int(height.max(initial=0)) - 1, -1, -1):
        level = levels[h]
        at = np.flatnonzero(height > h)
        a, b = level.down[p[at]], level.down[q[at]]
        same = level.symbols[a] == level.symbols[b]
        step = np.minimum(level.down[p[at] + 1] - a, level.down[q[at] + 1] - b) if level.blocks else 1
        p[at], q[at] = a + same * step, b + same * step
    return p - i


def _candidates(symbols: np.ndarray, reach: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for the periods from ``low`` to 2 * ``low`` - 1; ``reach[q]`` symbols belong to texts of 4q words or more."""
    places, periods = [], []
    for q in range(low, min(2 * low, len(reach))):
        grid = symbols[: reach[q] : q]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(periods)) if places else (none, none)


def runs_of(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(start, end, period) of every run among ``symbols``, sorted: texts of ``lengths`` words, the longest first, a
    negative sign before each and at the end."""
    found = [np.zeros((0, 3), np.int64)]
    longest = int(lengths.max(initial=0))
    if longest < LEAST:
        return found[0]
    ends = np.cumsum(lengths + 1)
    fits = np.searchsorted(-lengths, -np.arange(longest // REPEATS + 1) * REPEATS, side="right")
    reach = np.append(0, ends)[fits] + 1
    levels, top = grammar(symbols)
    mirrored, size = [level.mirrored() for level in levels], len(symbols)
    low = 1
    while low < len(reach):
        at, period = _candidates(symbols, reach, low)
        if len(at):
            covered = np.zeros(size, np.int64)
            for some in found:
                np.maximum.at(covered, some[:, 0], some[:, 1])
            covered = np.maximum.accumulate(covered)
            open_ = covered[at] < at + 2 * period
            at, period = at[open_], period[open_]
            start = at - _agreement(mirrored, top[::-1], size - at, size - at - period)
            end = at + period + _agreement(levels, top, at, at + period)
            good = (end - start >= REPEATS * period) & (end - start >= LEAST)
            some = np.unique(np.stack([start, end, period], 1)[good], axis=0)
            found.append(some[covered[some[:, 0]] < some[:, 1]])
        low *= 2
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _searched(texts: list[bytes | None]) -> list[dict]:
    """What :data:`FOUND` says of each text."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    words = [(t or b"").split() for t in texts]  # at white space of ASCII
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")
    parts, starts, at = [], np.zeros(len(words), np.int64), 0
    for n, k in enumerate(order):
        parts += [[-1 - n], list(map(ids.__getitem__, words[k]))]
        starts[k] = at + 1
        at += 1 + len(words[k])
    symbols = np.fromiter((x for part in [*parts, [-1 - len(words)]] for x in part), np.int64, at + 1)
    runs = runs_of(symbols, lengths[order])
    out = [{"n_words": len(w), "runs": [], "collapsed": None} for w in words]
    if len(runs):
        drop = np.zeros(at + 2, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 1], -1)
        drop = np.cumsum(drop) > 0
        owner = order[np.searchsorted(starts[order], runs[:, 0], side="right") - 1]
        for k, (start, end, period) in zip(owner.tolist(), runs.tolist(), strict=True):
            out[k]["runs"].append({"start": start - int(starts[k]), "length": end - start, "period": period})
    for k, w in enumerate(words):
        if out[k]["runs"]:
            w = [x for x, d in zip(w, drop[starts[k] : starts[k] + len(w)].tolist(), strict=True) if not d]
        out[k]["collapsed"] = b" ".join(w).decode()
    return out


def _pieces(texts: Iterator[bytes | None]) -> Iterator[list[bytes | None]]:
    """Texts of ``WORDS`` words in all, as far as their bytes tell."""
    piece, size = [], 0
    for t in texts:
        if piece and size + len(t or b"") > 6 * WORDS:
            yield piece
            piece, size = [], 0
        piece.append(t)
        size += len(t or b"") + 1
    if piece:
        yield piece


@F.arrow_udf(FOUND_TYPE)
def periodic(texts: pa.Array) -> pa.Array:
    """Number of words, runs and the text without repeats of each text."""
    parts = [pa.array(_searched(piece), FOUND) for piece in _pieces(x.as_py() for x in texts.cast(pa.binary()))]
    return pa.concat_arrays(parts) if parts else pa.array([], FOUND)


def with_runs(docs: DataFrame, text: str = "text", out: str = "repeats") -> DataFrame:
    """``docs`` with a struct: n_words, runs (start in words, length, period; by start, then period) and collapsed.

    ``collapsed`` is the text's words, joined by one space, without those that lie in a run behind its first period.
    """
    return docs.withColumn(out, periodic(F.col(text)))
