"""Shortest-pack-first histogram packing of token pieces into sequences of a fixed length.

1. A document is its ids with the end id. Full sequences are cut off its front. What remains is one
   piece, or with a ``unit`` below ``size`` a multiple of ``unit`` and a rest, which leaves even less padding.
2. The histogram of piece lengths has at most ``size`` rows, whatever the corpus, and is all that the
   driver sees. Lengths are placed longest first; the pieces of a length go, many at a time, to the
   emptiest packs that have room, and each step changes counts of packing patterns, not packs.
3. A pattern that is used c times is c sequences. Its places of a length are a range of ranks, so a
   piece finds its sequence and offset from its length and its rank among pieces of that length.
   Ranks come from counts per length and salt and numbering inside them: no length, however common,
   is numbered in one task.

Defined cases: null or empty text is the end id alone; repeated rows are separate documents, null ids
are allowed; an empty table gives no piece; columns of the input other than id and text are dropped,
since a row is a piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbrera.llm.shared import unused, written

SALTS = 64


def _cuts(n: int, size: int, unit: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    out = [size] * (n // size)
    rest = n % size
    if rest >= unit:
        out.append(rest // unit * unit)
    if rest % unit:
        out.append(rest % unit)
    return out


def _pieces(tokenizer: str, end: int, size: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumbrera.llm.tokens import encoder

        encode = encoder(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows, starts, lengths, ids, crcs, totals, pieces = [], [], [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    own = encode.ids(text, end)
                    at = 0
                    for number, length in enumerate(_cuts(len(own), size, unit)):
                        piece = own[at : at + length]
                        rows.append(row)
                        pieces.append(number)
                        starts.append(at)
                        lengths.append(length)
                        ids.append(piece.tobytes())
                        crcs.append(zlib.crc32(piece.astype("<u4").tobytes()))
                        totals.append(len(own))
                        at += length
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals)), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def cut_into_pieces(docs: DataFrame, tokenizer: str, end: int = 1, size: int = 2048, unit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids): ids as little-endian unsigned 16-bit numbers."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pieces(tokenizer, end, size, unit), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")


def packing_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs): the lengths of each pattern in the order they were placed."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # used ids -> pattern -> packs
    used = []  # sorted keys of open_packs
    done: dict[tuple[int, ...], int] = defaultdict(int)

    def put(pattern: tuple[int, ...], fill: int, n: int) -> None:
        if fill == size:
            done[pattern] += n
            return
        if fill not in open_packs:
            bisect.insort(used, fill)
        open_packs[fill][pattern] += n

    for length in sorted(histogram, reverse=True):
        left, placed = histogram[length], []
        while left and used and used[0] + length <= size:
            fill = used[0]
            pattern, packs = open_packs[fill].popitem()
            take = min(packs, left)
            left -= take
            if take < packs:
                open_packs[fill][pattern] += packs - take
            if not open_packs[fill]:
                del open_packs[fill]
                used.pop(0)
            # As many of this length as still fit go into the same packs while pieces remain; else one each.
            placed.append(((*pattern, length), fill + length, take))
            if not left or not used or used[0] + length > size:
                for pattern, fill, n in placed:
                    put(pattern, fill, n)
                placed = []
        for pattern, fill, n in placed:
            put(pattern, fill, n)
        if left:
            each = size // length
            if left // each:
                put((length,) * each, length * each, left // each)
            if left % each:
                put((length,) * (left % each), length * (left % each), 1)
    for packs in open_packs.values():
        for pattern, n in packs.items():
            done[pattern] += n
    return sorted(done.items(), key=lambda x: (-sum(x[0]), x[0]))


def rank_ranges(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each range of ranks, in order of rank."""
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            ranges[length].append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in ranges.items()}


def _placed(ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], rank: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column(rank).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, of, off = ranges[int(length)]
                i = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at] = of[i] + ranks[at] - first[i]
                offset[at] = off[i]
            kept = [i for i, n in enumerate(batch.schema.names) if n != rank]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (any columns with ``length`` and ``start``) with ``sequence_id`` and ``offset``."""
    salt, before_, row, rank = unused(pieces, "_salt", "_before", "_row", "_rank")
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    salted = pieces.select(*kept).withColumn(salt, F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    counts = written(salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n")), "histogram")  # at most size x SALTS rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    ranges = rank_ranges(packing_patterns(histogram, size))
    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", salt, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before_))
    order = [c for c in kept if c in ("doc_id", "start", "ids_crc32")]
    inside = Window.partitionBy("length", salt).orderBy(*order)
    ranked = salted.withColumn(row, F.row_number().over(inside)).join(before, ["length", salt])
    ranked = ranked.select(*kept, (F.col(before_) + F.col(row) - 1).alias(rank))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*kept).schema.fields)
    return ranked.mapInArrow(_placed(ranges, rank), f"{kinds}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, size: int = 2048, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens, n_padding) from packed pieces with ``ids``: pieces in order of offset, padded unless a power of two long."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))  # at most size ids
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    power = F.expr("(n_tokens & (n_tokens - 1)) = 0")
    missing = F.when(power, F.lit(0)).otherwise(size - F.col("n_tokens")).cast("int")
    padding = F.unhex(F.repeat(F.lit(pad.to_bytes(2, "little").hex()), missing))
    return whole.select("sequence_id", F.concat(joined, padding).alias("ids"), "n_tokens", missing.alias("n_padding"))
