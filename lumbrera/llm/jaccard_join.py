"""Exact Jaccard join on word n-grams with several global token orders.

Two sets with J >= t share at least ``ceil(t * n)`` tokens, so under ANY order of all tokens they
share one of the first ``p = n - ceil(t * n) + 1`` tokens of each. Every order gives a filter; a node
has to pass all of them. They are intersected on nodes, not on pairs: a pair inside a part may be
verified that shares no prefix token under some order.

1. Every text becomes a set of 64-bit hashes of its n-grams. Equal sets (copies) are one node from
   here on, so a group of copies costs as much as one document.
2. First order: by hash. The first ``p + n // 10`` tokens of a set must include, for any partner, a
   computable number of tokens that another set has too. Nodes without them have no partner. This
   looks at a quarter of the tokens of the corpus; nearly all documents end here.
3. The rest is indexed under two more orders: rarest token first, and tokens that no other set has
   first, then by another hash. Under the second order, nodes that share prefix tokens hang together
   in parts. The third is intersected with it: a node stays only if, inside its part, it shares a
   prefix token of the third order too. No pair is written down.
4. Verification. In each part of the intersection every node is compared with one hub, the node
   with the fewest tokens of its own, which is what an edited copy is an edit of. Nodes that link are
   one component and need no comparison with each other. The others are compared with all nodes of
   their part in blocks of bounded size, and only edges that join components leave a block.
5. Components over the verified links, then over documents.

Truncated hashes (48 bits) stand for tokens in the filters, where a false match only lets more
through; verification compares 64-bit hashes.

Defined cases: null text and text without words have an empty set and link with nothing; fewer
words than n give one n-gram of all words; null ids are members but never the smallest id; rows with
equal ids and different texts are told apart by their sets; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.components import connected
from lumbrera.llm.shared import written

BLOCK = 1500  # nodes of one side of a verification block
BROADCAST_ROWS = 3_000_000  # 8-byte keys
DF_LIMIT = (1 << 15) - 1  # above a count that is written before 48 bits of a token
EXTRA = 10  # the first order looks at n // EXTRA tokens beyond the prefix
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Shingler:
    """Sets of n-gram hashes: a polynomial over the bytes of n words joined by one space, then mixed."""

    def __init__(self, width: int):
        self.width = width
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n, 2 * len(self.powers))
        with np.errstate(over="ignore"):
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE_INVERSE, np.uint64))])

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
        if not parts:
            return np.empty(0, np.uint64)
        raw = np.frombuffer(b" ".join(parts), np.uint8)
        if len(raw) >= len(self.powers):
            self._grow(len(raw) + 1)
        gaps = np.flatnonzero(raw == 32)
        starts, stops = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        if len(parts) < self.width:
            starts, stops = starts[:1], stops[-1:]
        else:
            starts, stops = starts[: len(parts) - self.width + 1], stops[self.width - 1 :]
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], dtype=np.uint64)])
            h = (sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.unique(h ^ (h >> np.uint64(31)))


def needed(n, percent: int):
    """ceil(n * percent / 100): tokens that a partner shares at least."""
    return -(-n * percent // 100)


def _signed(tokens: np.ndarray) -> list[int]:
    return tokens.view(np.int64)


def _sets(width: int, percent: int, whole: bool):
    """Arrow batches with ``text`` last -> the other columns, node, n and either the first tokens or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                nodes, sizes, tokens, offsets = [], [], [], [0]
                for text in part.column(part.num_columns - 1).to_pylist():
                    own = shingle(text)
                    n = len(own)
                    nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if n else None)
                    sizes.append(n)
                    if not whole:
                        own = own[: n - needed(n, percent) + 1 + n // EXTRA] >> np.uint64(16)
                    tokens.append(own)
                    offsets.append(offsets[-1] + len(own))
                flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(flat), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), listed],
                    names=[*part.schema.names[:-1], "node", "n", "tokens"])

    return run


def _prefix_length(percent: int) -> str:
    return f"(n - (n * {percent} + 99) div 100 + 1)"


def _key(node: Column) -> Column:
    """48 bits of a node's digest."""
    return F.shiftrightunsigned(F.conv(F.left(node, F.lit(15)), 16, 10).cast("long"), 12)


def _survivors(sets: DataFrame, percent: int) -> DataFrame:
    """Keys of nodes whose first tokens are shared often enough for a partner to exist."""
    full = sets.where("n > 0")
    # Copies of a set would make all its tokens look shared: one row speaks for each.
    owners = full.groupBy("node").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("c")).where("c > 1").select("node", F.col("rid").alias("owner"))
    silent = written(full.join(owners, "node").where("rid <> owner").select("rid"), "copies")
    rows = full.join(silent, "rid", "left_anti").select(_key(F.col("node")).alias("key"), F.explode("tokens").alias("t"))
    shared = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("t")
    found = rows.join(shared, "t").groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    least = f"((n * {percent} + 99) div 100) div {EXTRA} + 1"  # of the smallest partner that the size allows
    return found.join(full.select(_key(F.col("node")).alias("key"), "n").distinct(), "key").where(f"m >= {least}").select("key").distinct()


def _indexed(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, own, first, second): tokens of its own, and shared prefix tokens under two orders.

    A token is one number from here on: its count, ``DF_LIMIT`` at most, and the token. Those numbers are the first order.
    """
    rows = nodes.select("node", "n", F.explode("tokens").alias("t")).select("node", "n", F.shiftrightunsigned("t", 16).alias("t"))
    shared = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    number = F.shiftleft(F.least("df", F.lit(DF_LIMIT).cast("long")), 48).bitwiseOR(F.col("t"))
    listed = rows.join(shared, "t").groupBy("node", "n").agg(F.collect_list(number).alias("s"))
    listed = listed.withColumn("own", F.col("n") - F.size("s")).where(f"size(s) >= (n * {percent} + 99) div 100")
    # Tokens of its own come first under both orders and match nothing.
    left = F.expr(f"CAST({_prefix_length(percent)} - own AS INT)")
    first = F.slice(F.sort_array("s"), F.lit(1), left)
    second = F.slice(F.sort_array(F.transform("s", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("t")))), F.lit(1), left)
    return listed.select("node", "n", "own", first.alias("first"), second["t"].alias("second"))


def _parts(indexed: DataFrame) -> DataFrame:
    """(node, part, n, own) of nodes that hang together by the first order and share a token inside their part by the second."""
    rows = indexed.select("node", F.explode("first").alias("t"))
    least = rows.groupBy("t").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "b")
    roots = connected(rows.join(least, "t").select(F.col("node").alias("a"), "b")).withColumnRenamed("root", "part")
    inside = indexed.join(roots, "node").select("node", "part", "n", "own", F.explode("second").alias("t"))
    shared = inside.groupBy("part", "t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("part", "t")
    return inside.join(shared, ["part", "t"], "left_semi").select("node", "part", "n", "own").distinct()


def _similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _verified_block(percent: int):
    def run(key: tuple, some: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        """Links that join components: nodes of ``some`` against nodes of ``every``."""
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(some) or not len(every):
            return empty
        sizes = every["n"].to_numpy()
        tokens = np.concatenate(every["tokens"].to_list())
        owner = np.repeat(np.arange(len(every)), [len(t) for t in every["tokens"]])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        root = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        names, known = every["node"].to_numpy(), every["comp"].to_numpy()
        out = []
        for node, n, own, comp in zip(some["node"], some["n"], some["tokens"], some["comp"], strict=True):
            lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            length = hi - lo
            spots = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            both = np.bincount(owner[spots], minlength=len(every))
            for i in np.flatnonzero(both * 100 >= (n + sizes - both) * percent):
                a, b = find(comp), find(known[i])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((node, names[i]))
        return pd.DataFrame(out, columns=["a", "b"]) if out else empty

    return run


def links(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links between distinct sets that connect every component; pairs inside one need not all be listed."""
    indexed = written(_indexed(nodes, percent), "indexed")
    parts = written(_parts(indexed), "parts")
    hubs = parts.groupBy("part").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node")).alias("h"), F.count(F.lit(1)).alias("members"))
    hubs = hubs.where("members > 1").select("part", F.col("h.node").alias("hub"), "members")
    member = parts.join(hubs, "part").select("part", "members", "node", "n", "hub")
    # All tokens meet the parts once; later steps read those of nodes in parts, a hub is a member of its part.
    held = written(member.join(nodes.select("node", "tokens"), "node"), "members")
    compared = held.join(held.where("node = hub").select("part", F.col("tokens").alias("hub_tokens")), "part")
    judged = written(compared.select("part", "members", "node", "n", "hub", _similar(F.col("tokens"), F.col("hub_tokens"), percent).alias("linked")), "judged")

    with_hub = judged.where(F.col("linked") & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    apart = judged.where(~F.col("linked")).groupBy("part").agg(F.count(F.lit(1)).alias("minors"))
    side = written(judged.join(apart, "part").withColumn("comp", F.when(F.col("linked"), F.col("hub")).otherwise(F.col("node"))).join(held.select("node", "tokens"), "node"), "sides")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    columns = ["part", "i", "j", "node", "n", "comp", "tokens"]
    some = side.where(~F.col("linked")).withColumn("i", own("minors")).withColumn("j", upto("members")).select(*columns)
    fresh = side.select(*[F.col(c).alias(c) for c in side.columns])  # columns of their own for the other side
    every = fresh.where(F.col("node") != F.col("hub")).withColumn("j", own("members")).withColumn("i", upto("minors")).select(*columns)
    found = some.groupBy("part", "i", "j").cogroup(every.groupBy("part", "i", "j")).applyInPandas(_verified_block(percent), "a long, b long")
    return with_hub.unionByName(found)


def similar_groups(docs: DataFrame, percent: int = 85, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) of every document; ``percent`` of Jaccard similarity links two."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    hashed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = "text_hash bigint, node string, n bigint, tokens array<bigint>"
    sets = written(hashed.mapInArrow(_sets(width, percent, False), f"rid bigint, doc_id {id_type}, {schema}"), "sets")

    kept = _survivors(sets, percent)
    distinct = sets.where("n > 0").withColumn("key", _key(F.col("node"))).join(kept, "key", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    read = written(distinct.select("text_hash").distinct(), "read")
    if read.count() <= BROADCAST_ROWS:
        read = F.broadcast(read)  # 8 bytes a row; more than that is joined by shuffling
    again = hashed.select("text_hash", "text").join(read, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    once = again.mapInArrow(_sets(width, percent, True), schema).drop("text_hash").dropDuplicates(["node"])
    nodes = written(once.withColumn("number", F.monotonically_increasing_id()), "nodes")

    numbered = nodes.select(F.col("number").alias("node"), "n", "tokens")  # 8 bytes for 32 letters; the written table keeps them
    roots = connected(links(numbered, percent)).withColumnRenamed("node", "number").join(nodes.select("number", "node"), "number")
    roots = roots.select("node", F.col("root").cast("string").alias("root"))  # at most 19 digits, never 32 letters
    member = sets.select("doc_id", "n", "node").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    smallest = member.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_members"))
    return member.join(smallest, "group", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_members", F.lit(1).cast("long")).alias("n_members"))
