"""Prefix trie of conversations: ternary search trees per range shard, merged at the shards' edges.

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. **Dictionary.** Turns are sorted by conversation once and numbered (two passes, no window over a conversation).
   Distinct turns (role and text, by their SHA-256) get whole-number ids; from there on only ids and text lengths travel.
2. **Pieces.** A conversation is cut into pieces of ``PIECE`` turns, so that one conversation of any length is never a
   single row. A node is known by a chained 128-bit hash of its turn ids; a piece hangs under the node before it.
3. **Range shards.** Equal pieces are counted together first (a group of copies is one row), then dealt by ranges of
   their ids. A shard builds a ternary search tree by inserting its sorted pieces median first, which keeps sibling
   trees balanced, and goes once backwards over the nodes: members, children, leaves and savings add up.
4. **Edges.** Only nodes on the paths of a shard's first and last piece can lie in two shards: at most ``2 * (PIECE + 1)``
   rows a shard, which are merged before they are final.
5. Pieces are worked on from the last of the longest conversation to the first (one round for up to ``PIECE`` turns);
   what lies under a piece's last node comes from the round before.

Defined cases: null roles and texts are empty; null turns come first; rows of one turn number are ordered by role and text, and equal
ones are all kept; rows without a conversation id belong to none and are left out; an empty table has no node; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, materialize, n_parts
from nomen.operators.windows import number_rows

PIECE = 4096
ROOT = b""
NODE = "key binary, parent binary, depth long, conv long, parent_conv long, n long, len long, children long, leaves long, saved long, edge boolean"


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(turns, conversations)``: ``conv, pos`` (from 1)``, id, len`` and ``conv, first, turns``."""
    t = conversations.select(col(conv).cast("long").alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"),
                             F.coalesce(col(text), F.lit("")).alias("text")).where("conv is not null")
    t = (t.withColumn("sha", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
         .withColumn("len", F.char_length("text").cast("long")))
    t = number_rows(t, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).select("conv", "n", "sha", "len")
    convs = materialize(t.groupBy("conv").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("turns")), "trie-convs")
    ids = materialize(t.groupBy("sha").agg(F.min("n").alias("id")), "trie-turns")   # the number of a turn's first row is its id
    turns = t.join(ids, "sha").join(convs.select("conv", "first"), "conv").select("conv", (F.col("n") - F.col("first") + 1).alias("pos"), "id", "len")
    return materialize(turns, "trie-numbered"), convs


# --- pieces ----------------------------------------------------------------------------------------------------------

def _child_key(key: bytes, turn: int) -> bytes:
    return hashlib.blake2b(key + turn.to_bytes(8, "little"), digest_size=16).digest()


def _chain(batches):
    """Adds the keys of the node before and the last node of each piece; pieces of a conversation arrive in order."""
    conv, key = None, ROOT
    for b in batches:
        roots, ends = [], []
        for c, ids in zip(b.column("conv").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if c != conv:
                conv, key = c, ROOT
            roots.append(key)
            for i in ids:
                key = _child_key(key, i)
            ends.append(key)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.binary()), pa.array(ends, pa.binary())], names=[*b.schema.names, "root", "end"])


def _pieces(turns: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """``conv, seg, ids, lens, last, root, end``; a conversation without turns has one empty piece."""
    p = (turns.groupBy("conv", F.expr(f"(depth - 1) div {size}").alias("seg"))
         .agg(F.sort_array(F.collect_list(F.struct("depth", "id", "len"))).alias("t")))                  # at most ``size`` turns
    total = turns.groupBy("conv").agg(F.max("depth").alias("total"))
    p = (convs.select("conv").join(total, "conv", "left").join(p, "conv", "left")
         .select("conv", F.coalesce("seg", F.lit(0).cast("long")).alias("seg"), F.coalesce(F.col("t.id"), F.array().cast("array<long>")).alias("ids"),
                 F.coalesce(F.col("t.len"), F.array().cast("array<long>")).alias("lens"), F.coalesce("total", F.lit(0).cast("long")).alias("total")))
    p = materialize(p.withColumn("last", F.col("total") <= (F.col("seg") + 1) * size), "trie-cut")
    schema = "conv long, seg long, ids array<long>, lens array<long>, total long, last boolean, root binary, end binary"
    short = p.where(f"total <= {size}").mapInArrow(_chain, schema)
    long = p.where(f"total > {size}").repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_chain, schema)
    return materialize(short.unionByName(long), "trie-pieces")


# --- shards ----------------------------------------------------------------------------------------------------------

class TernaryTree:
    """Ternary search tree over sequences of numbers. Node 0 is the root of the trie; every other node is a turn under
    its ``parent`` and stands in the search tree of its siblings by ``lo`` and ``hi``; ``eq`` is the first child's place."""

    def __init__(self):
        self.turn, self.lo, self.hi, self.eq, self.parent, self.len = [None], [-1], [-1], [-1], [-1], [0]

    def insert(self, ids, lens) -> list[int]:
        """Nodes of the path, the root first."""
        path, at = [0], 0
        for turn, size in zip(ids, lens, strict=True):
            link, where, node = self.eq, at, self.eq[at]
            while node >= 0 and self.turn[node] != turn:
                link = self.lo if turn < self.turn[node] else self.hi
                where, node = node, link[node]
            if node < 0:
                node = link[where] = len(self.turn)
                for field, value in ((self.turn, turn), (self.lo, -1), (self.hi, -1), (self.eq, -1), (self.parent, at), (self.len, size)):
                    field.append(value)
            path.append(node)
            at = node
        return path


def median_order(n: int):
    """0 .. n-1, each range's middle before its halves."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


def _tries(rows: list[dict], seg: int, size: int, edges: set[int]):
    """Nodes of the pieces of one root, sorted by ids. ``edges``: which of the pieces lie on an edge of the shard."""
    tree, ends = TernaryTree(), {}
    on_edge = set()
    for i in median_order(len(rows)):
        path = tree.insert(rows[i]["ids"], rows[i]["lens"])
        ends[path[-1]] = rows[i]
        if i in edges:
            on_edge.update(path)
    m = len(tree.turn)
    n, conv, children, leaves, saved = [0] * m, [None] * m, [0] * m, [0] * m, [0] * m
    key, depth = [rows[0]["root"]] * m, [seg * size] * m
    for i in range(1, m):                               # parents are made before their children
        key[i], depth[i] = _child_key(key[tree.parent[i]], tree.turn[i]), depth[tree.parent[i]] + 1
    for i in range(m - 1, -1, -1):
        edge = i in on_edge
        if (r := ends.get(i)) is not None:
            n[i] += r["n"]
            conv[i] = r["conv"] if conv[i] is None else min(conv[i], r["conv"])
            children[i] += r["children"]
            leaves[i] += r["leaves"]
            saved[i] += r["saved"]
        if not edge:
            leaves[i] = leaves[i] if children[i] else 1
            saved[i] += (n[i] - 1) * tree.len[i]
        p = tree.parent[i]
        if p >= 0:
            n[p] += n[i]
            conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
            if not edge:                                # what lies on an edge is added when edges are merged
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
    for i in range(m):
        p = tree.parent[i]
        yield (key[i], key[p] if p >= 0 else None, depth[i], conv[i], conv[p] if p > 0 and p not in on_edge else None, n[i], tree.len[i], children[i], leaves[i], saved[i], i in on_edge)


def _node_batches(rows, chunk=20000):
    types = (pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.bool_())
    names = [x.split()[0] for x in NODE.split(", ")]
    todo = []
    for r in rows:
        todo.append(r)
        if len(todo) == chunk:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*todo, strict=True), types, strict=True)], names=names)
            todo = []
    if todo:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*todo, strict=True), types, strict=True)], names=names)


def _shard(seg: int, size: int):
    def nodes(batches):
        rows, last = [], None
        first_root = True
        for b in batches:
            for r in b.to_pylist():
                if last is not None and r["root"] != last:
                    yield from _tries(rows, seg, size, {0} if first_root else set())
                    rows, first_root = [], False
                last = r["root"]
                rows.append(r)
        if rows:
            yield from _tries(rows, seg, size, {0, len(rows) - 1} if first_root else {len(rows) - 1})

    return lambda batches: _node_batches(nodes(batches))


def _merge_edges(batches):
    """Final rows of the edge nodes: parts of a node added up, then children into parents, deepest first."""
    nodes: dict[bytes, list] = {}
    for b in batches:
        for r in b.to_pylist():
            at = nodes.setdefault(r["key"], [r["parent"], r["depth"], r["conv"], 0, r["len"], 0, 0, 0])
            at[2] = min(at[2], r["conv"])
            for i, k in ((3, "n"), (5, "children"), (6, "leaves"), (7, "saved")):
                at[i] += r[k]
    def finished():
        for key, at in sorted(nodes.items(), key=lambda x: -x[1][1]):
            at[6] = at[6] if at[5] else 1
            at[7] += (at[3] - 1) * at[4]
            up = nodes.get(at[0])
            if up:
                up[5] += 1
                up[6] += at[6]
                up[7] += at[7]
        for key, (parent, depth, conv, n, size, children, leaves, saved) in nodes.items():
            up = nodes.get(parent)
            # the node above a later piece belongs to the round after: its smallest member is looked up there
            yield key, parent, depth, conv, up[2] if up and up[0] is not None else None, n, size, children, leaves, saved, True
    yield from _node_batches(finished())


def _ends(batches):
    """SHA-256 of the ascending ids that end at each node; a node's ids arrive together and in order, and are
    hashed as they come (the digest is serial by definition, so a node's ids are one task's stream, never held)."""
    key, digest, n, out = None, None, 0, []
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if digest:
                    out.append((key, digest.hexdigest()))
                key, digest, n = k, hashlib.sha256(), 0
            digest.update(b"%s%d" % (b"," if n else b"", c))
            n += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["key", "ends_sha256"])
            out = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member)``, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. ``turns`` is ``conv, depth`` (1 ..)``, id, len``, ``convs`` all conversations (``conv``)."""
    parts = n_parts(turns.sparkSession)
    pieces = _pieces(turns, convs, piece)
    deepest = pieces.agg(F.max("seg")).first()[0] or 0
    rounds, below = [], None
    for seg in range(deepest, -1, -1):
        here = pieces.where(F.col("seg") == seg).groupBy("root", "ids", "lens", "end").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
        if below is None:
            here = here.select("*", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        else:
            here = here.join(below, "end", "left").fillna(0, ["children", "leaves", "saved"])
        shards = here.drop("end").repartitionByRange(parts, "root", "ids").sortWithinPartitions("root", "ids")
        nodes = materialize(shards.mapInArrow(_shard(seg, piece), NODE), "trie-shards")
        merged = materialize(nodes.where("edge").repartition(1).mapInArrow(_merge_edges, NODE), "trie-edges")
        nodes = nodes.where("not edge").unionByName(merged)
        if seg:
            # the root of a later piece is the last node of the piece before: only what lies under it goes on
            below = nodes.where("parent is null").select(F.col("key").alias("end"), "children", "leaves", "saved")
            nodes = nodes.where("parent is not null")
        rounds.append(nodes)
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
    unknown = F.col("parent_conv").isNull() & F.col("parent").isNotNull()
    above = materialize(nodes.where(F.col("edge") | (F.col("depth") % piece == 0)).select(F.col("key").alias("parent"), F.col("conv").alias("up")), "trie-parents")
    nodes = nodes.where(~unknown).unionByName(nodes.where(unknown).join(above, "parent").withColumn("parent_conv", F.col("up")).drop("up"))
    ends = (pieces.where("last").select("end", "conv").repartition("end").sortWithinPartitions("end", "conv").mapInArrow(_ends, "key binary, ends_sha256 string"))
    return (nodes.join(ends, "key", "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def rebuilt(turns: DataFrame, convs: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """``conv, depth, id, len``: the first h turns of conversation ``c - c % group``, then c's own after its first h;
    h = crc32(c) % ``heads``."""
    c = convs.select("conv", "turns", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    c = materialize(c.join(convs.select(F.col("conv").alias("base"), F.col("turns").alias("there")), "base", "left")
                    .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "trie-rebuilt")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "base")
    taken = c.join(first, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "id", "len")
    own = turns.join(c.select("conv", "h", "taken"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "id", "len")
    return materialize(taken.unionByName(own), "trie-turns-rebuilt")
