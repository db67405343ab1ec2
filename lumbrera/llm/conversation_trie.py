"""Prefix trie of conversations: every distinct sequence of first turns is a node with its counts.

Turns are 16-byte ids (MD5 of role and text). A conversation is a row of turn ids, padded with zeros to
``WIDTH``; a longer one is several rows, each with the key of what stands before it (a sum of hashes of
the rows before, in three lanes of 40 bits), so all rows of all depths are sorted at once. Rows are dealt to
shards by ranges of (key, ids), equal rows by conversation id, so copies of one conversation fill as
many shards as they need. In a shard:

* ``np.lexsort`` puts the rows of every node next to each other;
* a column of a row has changed if it, or one before it, differs from the row above (the OR accumulated
  along the columns): there a node starts, for the first row compared with the last row of the shard
  before;
* ``reduceat`` between the starts of a column sums up all nodes of that depth.

Sums over a subtree are sums over its members. A leaf counts at its last row: one that is not the
beginning of the next row. A node's text counts at the row where the node starts. What
conversations hold in their later rows is added to their earlier ones by their id. So no step walks the
depths, and a very long conversation costs its rows.

A node that goes on in the next shard is a boundary node, at most 2 * ``WIDTH`` of a shard: their parts are
summed by key, and nodes below ask them for the parent's id by a join. The ids of conversations that
end in a node are hashed in the shard; those of boundary nodes are put in pieces of ``PIECE`` ids, which one task
streams through the hash in order (SHA-256 can only be computed in order), with one batch in memory.

On the driver: the first and last key of every shard (at most 300 bytes each).

Defined cases: rows without a conversation id are left out; null role and text are empty; turns are ordered by
turn, nulls first, equal turns by their id (MD5); repeated rows are turns of their own; a conversation without
turns is a member of the root alone; very long texts count by their bytes; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbrera.llm.shared import written

WIDTH, SHARD_ROWS, PIECE, BLOCK = 16, 50_000, 500, 1024
LANES = ("l1", "l2", "l3")
NODE = (
    "kind int, key binary, parent_key binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends string, shard int, piece bigint")
NODE_ARROW = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), *[(n, pa.int64()) for n in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    ("ends", pa.string()), ("shard", pa.int32()), ("piece", pa.int64())])
FINAL, PART, ENDS = 0, 1, 2


def turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _shards(rows: DataFrame, shard_rows: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard_rows))


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(conv_id, pos from 1, id, size in bytes) of every turn.

    Rows are dealt by ranges of the whole order, so the turns of one conversation may lie in several ranges;
    they are numbered in a range, after the counts of the ranges before.
    """
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("size"), F.monotonically_increasing_id().alias("tie"))
    rows = written(rows, "turns")
    ranged = rows.repartitionByRange(_shards(rows, shard_rows), "conv_id", F.col("turn").asc_nulls_first(), "id", "tie")
    ranged = written(ranged.withColumn("range", F.spark_partition_id()).drop("tie"), "ranged-turns")
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "id")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before > 0")
    placed = ranged.withColumn("at", F.row_number().over(inside)).join(counts.select("conv_id", "range", "before"), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "size")


def _before(rows: DataFrame, values: list[str], following: bool = False) -> DataFrame:
    """``rows`` with the sum of each of ``values`` over the rows of the conversation with smaller (larger) k, in blocks of rows."""
    order = F.col("k").desc() if following else F.col("k")
    blocked = rows.withColumn("block", F.floor(F.col("k") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy(F.desc("block") if following else F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("conv_id", "block").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    totals = totals.select("conv_id", "block", *[F.sum(f"t_{v}").over(across).alias(f"o_{v}") for v in values]).where(F.col(f"o_{values[0]}").isNotNull())
    summed = blocked.withColumns({f"s_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(totals, ["conv_id", "block"], "left")
    out = {f"b_{v}": F.col(f"s_{v}") + F.coalesce(f"o_{v}", F.lit(0)) for v in values}
    return summed.withColumns(out).drop("block", *[f"{p}_{v}" for p in "so" for v in values])


def matrix_rows(conversations: DataFrame, turns: DataFrame, width: int, shard_rows: int) -> DataFrame:
    """Rows of up to ``width`` turns, dealt to shards: conv_id, k (number of the row), the key before it (k and
    lanes), the lanes' growth, ids, sizes, whether more turns follow, and their bytes."""
    cut = turns.withColumn("k", F.floor((F.col("pos") - 1) / width).cast("int"))
    rows = cut.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "size"))).alias("t"))  # at most width turns
    hexed = F.array_join(F.transform("t.id", lambda x: F.hex(x)), "")
    digest = F.md5(F.concat_ws(":", "k", hexed))
    lane = lambda n: F.conv(F.substring(digest, 1 + 10 * n, 10), 16, 10).cast("long")
    rows = rows.select(
        "conv_id", "k", F.unhex(hexed).alias("ids"), F.col("t.size").alias("sizes"), F.aggregate("t.size", F.lit(0).cast("long"), lambda s, x: s + x).alias("bytes"),
        *[lane(n).alias(f"d{n + 1}") for n in range(3)])
    rows = written(rows, "turn-rows")
    deep = _before(rows.join(rows.where("k = 1").select("conv_id"), "conv_id", "left_semi"), ["d1", "d2", "d3"])
    deep = deep.join(_before(deep.select("conv_id", "k", "bytes"), ["bytes"], following=True).select("conv_id", "k", "b_bytes"), ["conv_id", "k"])
    last = rows.where("k > 0").groupBy("conv_id").agg(F.max("k").alias("last"))
    deep = deep.join(last, "conv_id").withColumn("more", F.col("k") < F.col("last")).drop("last")
    none = F.lit(0).cast("long")
    flat = rows.join(rows.where("k = 1").select("conv_id"), "conv_id", "left_anti").withColumns({f"b_{v}": none for v in ("d1", "d2", "d3", "bytes")}).withColumn("more", F.lit(False))
    silent = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct().join(rows.where("k = 0").select("conv_id"), "conv_id", "left_anti")
    silent = silent.select("conv_id", F.lit(0).alias("k"), F.lit(b"").alias("ids"), F.array().cast("array<int>").alias("sizes"), *[none.alias(n) for n in ("bytes", "d1", "d2", "d3", "b_d1", "b_d2", "b_d3", "b_bytes")], F.lit(False).alias("more"))
    every = flat.unionByName(deep).unionByName(silent).withColumnsRenamed({"b_d1": "l1", "b_d2": "l2", "b_d3": "l3", "b_bytes": "after_bytes"}).drop("bytes")
    key = F.concat(F.unhex(F.concat(F.lpad(F.hex("k"), 8, "0"), *[F.lpad(F.hex(n), 16, "0") for n in LANES])), F.col("ids"))
    every = written(every.withColumn("key", key), "keyed-rows")
    ranged = every.repartitionByRange(_shards(every, shard_rows), "key", "more", "conv_id").withColumn("shard", F.spark_partition_id())
    return written(ranged, "shards")


@dataclass
class Edges:
    """The keys that stand directly before and after each shard."""

    before: dict[int, bytes]
    after: dict[int, bytes]
    deepest: int
    width: int


def edges_of(rows: DataFrame, width: int) -> Edges:
    """One row of keys a shard, brought to the driver."""
    found = rows.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max("k").alias("k")).orderBy("shard").collect()
    pairs = list(zip(found[:-1], found[1:], strict=True))
    return Edges({b["shard"]: bytes(a["last"]) for a, b in pairs}, {a["shard"]: bytes(b["first"]) for a, b in pairs}, max((r["k"] for r in found), default=0), width)


def _columns(key: list[bytes], width: int) -> np.ndarray:
    """Keys as rows of unsigned numbers: k, three lanes and two numbers for each turn id, zeros where there is none."""
    size = 32 + 16 * width
    return np.frombuffer(b"".join((b"\0\0\0\0" + x).ljust(size, b"\0") for x in key), ">u8").reshape(len(key), size // 8).astype(np.uint64)


class Shard:
    """The sorted rows of a shard and where nodes start and leaves end in it."""

    def __init__(self, table: pa.Table, edges: Edges):
        table, width = table.combine_chunks(), edges.width
        self.width = width
        number = lambda n: table.column(n).to_numpy().astype(np.int64)
        key, conv, more = table.column("key").to_pylist(), number("conv_id"), table.column("more").to_numpy()
        cells = _columns(key, width)
        order = np.lexsort((conv, more, *cells.T[::-1]))
        self.id = int(table.column("shard")[0].as_py())
        self.cells, self.conv, self.more, self.order = cells[order], conv[order], more[order], order
        self.length = np.array([(len(x) - 28) // 16 for x in key])[order]
        self.k = number("k")[order]
        sizes = np.zeros((len(key), width), np.int64)
        sizes[np.arange(width) < np.array([(len(x) - 28) // 16 for x in key])[:, None]] = table.column("sizes").combine_chunks().flatten().to_numpy()
        self.sizes, self.table = sizes[order], table
        before, after = edges.before.get(self.id), edges.after.get(self.id)
        above = _columns([before], width) if before is not None else ~self.cells[:1]
        below = _columns([after], width) if after is not None else ~self.cells[-1:]
        padded = np.concatenate([above, self.cells, below])
        differs = padded[1:] != padded[:-1]
        # One column for the key before the row, then one for each turn.
        joined = np.concatenate([differs[:, :4].any(1, keepdims=True), differs[:, 4::2] | differs[:, 5::2]], 1)
        changed = np.logical_or.accumulate(joined, axis=1)
        self.changed, self.following = changed[:-1], changed[1:]
        self.has = np.arange(width) < self.length[:, None]
        self.starts = self.changed[:, 1:] & self.has
        self.leaf = ~self.more & self.following[np.arange(len(conv)), self.length]

    def taken(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy().astype(np.int64)[self.order]

    def marks(self) -> pa.Table:
        """For every row: bytes of the nodes that start in it, whether a leaf ends in it, whether its first turn starts a node."""
        return pa.table({
            "conv_id": self.conv, "k": self.k.astype(np.int32), "own_bytes": (self.sizes * self.starts).sum(1), "leaf": self.leaf.astype(np.int64),
            "first": self.starts[:, 0].astype(np.int64)})

    def keys(self, rows: np.ndarray, column: int, ahead: dict[str, np.ndarray]) -> list[bytes]:
        """Key of the node in ``column`` of each of ``rows``; after the last column it is the key before the next row."""
        out = []
        for r in rows.tolist():
            if column == self.width - 1:
                out.append(np.array([self.k[r] + 1], ">u4").tobytes() + np.array([ahead[n][r] for n in LANES], ">u8").tobytes())
            else:
                out.append(self.cells[r, : 4 + 2 * (column + 1)].astype(">u8").tobytes()[4:])
        return out

    def nodes(self, root: int) -> Iterator[pa.Table]:
        """A table for each depth: whole nodes, parts of boundary nodes, and pieces of the ids that end in those."""
        n = len(self.conv)
        fresh = self.sizes * ~self.starts  # bytes that another conversation has already
        saved = fresh[:, ::-1].cumsum(1)[:, ::-1] + (self.taken("after_bytes") - self.taken("after_own"))[:, None]
        leaves, next_first = self.leaf + self.taken("after_leaf"), self.taken("next_first")
        ahead = {lane: self.taken(lane) + self.taken(f"d{i + 1}") for i, lane in enumerate(LANES)}
        up_start = up_least = up_part = None
        for j in range(-1, self.width):
            begins = self.changed[:, j + 1].copy()
            begins[0] = True
            at = np.flatnonzero(begins)
            real = self.length[at] > j if j >= 0 else self.k[at] == 0
            part = np.zeros(len(at), bool)
            part[0] |= not self.changed[0, j + 1]
            part[-1] |= not self.following[-1, j + 1]
            part |= j < 0
            least = np.minimum.reduceat(self.conv, at)
            children = np.add.reduceat((self.starts[:, j + 1] if j + 1 < self.width else next_first).astype(np.int64), at)
            ends = np.add.reduceat(((self.length == j + 1) & ~self.more).astype(np.int64), at)
            parent, asks = np.full(len(at), root), np.zeros(len(at), bool)
            if j > 0:
                of = np.searchsorted(up_start, at, side="right") - 1
                parent, asks = up_least[of], up_part[of]
            elif j == 0:
                asks = self.k[at] > 0
            keyed = part | ((j == self.width - 1) & (children > 0))
            rows = np.flatnonzero(real)
            if len(rows):
                size, first = len(rows), at[rows]
                lists = [",".join(map(str, self.conv[s : s + e].tolist())) for s, e in zip(first.tolist(), np.where(part[rows], 0, ends[rows]).tolist(), strict=True)]
                masked = lambda values, mask: pa.array(values, mask=mask)
                key, ask = np.full(size, None, object), np.full(size, None, object)
                key[keyed[rows]] = self.keys(first[keyed[rows]], j, ahead)
                if j >= 0:
                    ask[asks[rows]] = self.keys(first[asks[rows]], j - 1, ahead)
                yield pa.table([
                    pa.array(np.where(part[rows], PART, FINAL), pa.int32()), pa.array(key, pa.binary()), pa.array(ask, pa.binary()), pa.array(self.k[first] * self.width + j + 1, pa.int64()),
                    pa.array(least[rows]), masked(parent[rows], asks[rows] | (j < 0)), pa.array(np.add.reduceat(np.ones(n, np.int64), at)[rows]), pa.array(children[rows]),
                    pa.array(np.add.reduceat(leaves, at)[rows]), pa.array(np.add.reduceat(saved[:, max(j, 0)], at)[rows]),
                    pa.array([None if p else hashlib.sha256(x.encode()).hexdigest() for x, p in zip(lists, part[rows].tolist(), strict=True)], pa.string()),
                    pa.array(np.full(size, self.id), pa.int32()), pa.array(np.zeros(size, np.int64))], schema=NODE_ARROW)
                for r in rows[part[rows] & (ends[rows] > 0)]:
                    ids = self.conv[at[r] : at[r] + ends[r]].tolist()
                    texts = [",".join(map(str, ids[s : s + PIECE])) for s in range(0, len(ids), PIECE)]
                    yield pa.Table.from_pylist([{"kind": ENDS, "key": self.keys(at[[r]], j, ahead)[0], "ends": t, "shard": self.id, "piece": i} for i, t in enumerate(texts)], schema=NODE_ARROW)
            up_start, up_least, up_part = at, least, part


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends), sorted -> (key, SHA-256 of all its pieces joined by commas)."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    now, digest = None, None
    for batch in batches:
        done = []
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)


def _with_later_rows(rows: DataFrame, edges: Edges) -> DataFrame:
    """``rows`` with what their conversations' later rows hold: own bytes, leaves, and whether the next row starts a node."""
    none = F.lit(0).cast("long")
    if edges.deepest == 0:
        return rows.withColumns({n: none for n in ("after_own", "after_leaf", "next_first")})

    def marks(table: pa.Table) -> pa.Table:
        return Shard(table, edges).marks()

    later = rows.join(rows.where("k > 0").select("shard").distinct(), "shard", "left_semi").groupBy("shard").applyInArrow(marks, "conv_id bigint, k int, own_bytes bigint, leaf bigint, first bigint")
    later = written(later.where("k > 0"), "marks")
    # A row of no weight stands for the conversation's first row.
    every = later.unionByName(later.where("k = 1").select("conv_id", F.lit(0).alias("k"), none.alias("own_bytes"), none.alias("leaf"), none.alias("first")))
    sums = _before(every, ["own_bytes", "leaf"], following=True).select("conv_id", "k", F.col("b_own_bytes").alias("after_own"), F.col("b_leaf").alias("after_leaf"))
    following = later.select("conv_id", (F.col("k") - 1).alias("k"), F.col("first").alias("next_first"))
    joined = rows.join(sums, ["conv_id", "k"], "left").join(following, ["conv_id", "k"], "left")
    return joined.fillna(0, ["after_own", "after_leaf", "next_first"])


def build(conversations: DataFrame, turns: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, pos, id, size); ``conversations`` (conv_id) names every member."""
    rows = matrix_rows(conversations, turns, width, shard_rows)
    edges = edges_of(rows, width)
    root = rows.agg(F.min("conv_id")).first()[0] or 0

    def nodes(table: pa.Table) -> pa.Table:
        return pa.concat_tables(Shard(table, edges).nodes(root))

    found = written(_with_later_rows(rows, edges).groupBy("shard").applyInArrow(nodes, NODE), "nodes")
    sums = [F.sum(n).alias(n) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    boundary = found.where(F.col("kind") == PART).groupBy("key").agg(
        F.first("parent_key", True).alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent_conv_id", True).alias("parent_conv_id"), *sums)
    pieces = found.where(F.col("kind") == ENDS).select("key", "shard", "piece", "ends")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ends").mapInArrow(_hashed, "key binary, ends_sha256 string")
    boundary = boundary.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    columns = ["key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = found.where(F.col("kind") == FINAL).withColumnRenamed("ends", "ends_sha256").select(columns).unionByName(written(boundary.select(columns), "boundary"))
    parents = whole.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("asked"))
    asking = whole.where("parent_key IS NOT NULL").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("asked"))
    out = [c for c in columns if c not in ("key", "parent_key")]
    return whole.where("parent_key IS NULL").select(out).unionByName(asking.select(out))
