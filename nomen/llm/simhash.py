"""SimHash near-duplicate groups by covering-code anchors.

Fingerprints (64 bits from XXH64, seed 42, of word shingles) link at ``max_bits`` or fewer
differing bits; the result is the connected component of every document.

Method. Anchors are the codewords of a covering code on 46 of the 64 bits: the product of
two binary Golay codes [23, 12], each of which covers its 23 bits with radius 3. A
fingerprint is replicated to the anchors within covering radius plus threshold; fingerprints
are then compared per anchor. Two prunings keep that exact and small:

* the radius is met block by block, so only the sum of what exceeds 3 in either block counts
  against the threshold;
* two fingerprints at distance <= t have a midpoint z, at most floor(t/2) from one and
  ceil(t/2) from the other. Both meet at z's anchor when every fingerprint goes to all
  anchors with an excess of at most ceil(t/2) (2 instead of 3: 61 anchors on average).
  Every pair with t or fewer differing bits so meets at an anchor.

All 64 bits are compared. Equal fingerprints are one node, so copies cost nothing. Per
anchor a spanning forest of the links is written, never all pairs of a dense group. Members
of an anchor stream through a task; an anchor with over ``CHUNK`` members is cut into chunks
whose pairs are compared in separate tasks. Components are found by alternating large-star
and small-star rounds over checkpointed edge tables.

Defined cases: a null or word-free text has fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle; a null id is reported as null and is
never a component id unless the component has no other; an empty table gives an empty result; extra columns are
ignored unless carried.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, materialize, n_parts
from nomen.llm._text import ragged, text_buffers

CHUNK = 4096
SMALL = 24          # groups up to this size are compared pair by pair at once
GOLAY = 0b101011100011   # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
RADIUS = 3
BLOCK_BITS = 23


# ---------------------------------------------------------------- fingerprints

def simhash(text: bytes, shingle: int, digest) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    k = min(shingle, len(words))
    s, e = starts[: len(words) - k + 1].tolist(), (ends[k - 1:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(s), 1 << 16):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(s[lo: lo + (1 << 16)], e[lo: lo + (1 << 16)], strict=True)), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 128 * 128
        counts += bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(s), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: list[Column] | None) -> DataFrame:
    """(id, fp, n): one row per input row; fp is the unsigned value's bits as a long, n numbers the rows. With
    ``carry`` also ``text`` and the struct ``row``."""
    wide = carry is not None
    t = docs.select(col(id_col).alias("id"), *([F.struct(*(carry or [F.lit(True).alias("_")])).alias("row")] if wide else []), col(text_col).alias("text"))
    names = t.columns if wide else ["id"]

    def run(batches):
        from xxhash import xxh64_intdigest
        for b in batches:
            data, off = text_buffers(b.column("text"))
            fp = np.array([simhash(data[off[i]: off[i + 1]].tobytes(), shingle, xxh64_intdigest) for i in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fp.view(np.int64))], names=[*names, "fp"])

    return t.mapInArrow(run, t.select(names).schema.add("fp", "long")).withColumn("n", F.monotonically_increasing_id())


# ---------------------------------------------------------------- anchors

def remainder(words: np.ndarray) -> np.ndarray:
    """Words of 23 bits modulo the Golay generator: the 11-bit syndrome."""
    r = words.copy()
    for i in range(BLOCK_BITS - 1, 10, -1):
        r ^= np.where((r >> i) & 1, GOLAY << (i - 11), 0)
    return r


def coset_tables(excess: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For e = 0 .. excess: (offsets by syndrome, counts, anchor XORs) of the error patterns that lead from a
    word to the codewords at distance <= 3 (e = 0) or exactly 3 + e."""
    out = []
    for e in range(excess + 1):
        weights = range(RADIUS + 1) if e == 0 else [RADIUS + e]
        pats = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BLOCK_BITS), w)], np.int64)
        syn = remainder(pats)
        order = np.argsort(syn, kind="stable")
        counts = np.bincount(syn, minlength=2048)
        out.append((np.concatenate([[0], np.cumsum(counts)[:-1]]), counts, (pats[order] >> 11)))
    return out


def anchors_of(fp: np.ndarray, max_bits: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each replica of the fingerprints (uint64)."""
    half = (max_bits + 1) // 2
    x = (fp & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
    y = ((fp >> np.uint64(BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
    sx, sy = remainder(x), remainder(y)
    rows, found = [], []
    for e1 in range(half + 1):
        for e2 in range(half + 1 - e1):
            (o1, c1, v1), (o2, c2, v2) = tables[e1], tables[e2]
            n2 = c2[sy]
            n = c1[sx] * n2
            row = np.repeat(np.arange(len(fp)), n)
            k = ragged(np.zeros(len(fp), np.int64), n)
            a1 = (x[row] >> 11) ^ v1[o1[sx[row]] + k // n2[row]]
            a2 = (y[row] >> 11) ^ v2[o2[sy[row]] + k % n2[row]]
            rows.append(row)
            found.append(a1 << 12 | a2)
    return np.concatenate(rows), np.concatenate(found)


def _replicate(max_bits: int):
    def run(batches):
        tables = coset_tables((max_bits + 1) // 2)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 2000):
                row, anchor = anchors_of(fp[lo: lo + 2000], max_bits, tables)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[lo + row].view(np.int64))], names=["anchor", "fp"])
    return run


# ---------------------------------------------------------------- comparison

def forest(f: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints, by search from each unseen one."""
    out, left = [], f
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(left ^ x) <= max_bits
            if hit.any():
                new = left[hit]
                out.append((np.full(len(new), x, np.uint64), new))
                todo.extend(new)
                left = left[~hit]
    return out


def links(group: np.ndarray, f: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal ``group`` (sorted): all of small groups, a spanning forest of others."""
    if not len(f):
        return f, f
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [len(f)]]))
    a, b = [], []
    small = start[(size > 1) & (size <= SMALL)]
    n_small = size[(size > 1) & (size <= SMALL)]
    at, rest = ragged(small, n_small), np.repeat(small + n_small, n_small) - 1
    rest = rest - at
    k = 1
    while len(at):
        keep = rest >= k
        at, rest = at[keep], rest[keep]
        near = np.bitwise_count(f[at] ^ f[at + k]) <= max_bits
        a.append(f[at[near]])
        b.append(f[at[near] + k])
        k += 1
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        for x, y in forest(f[s: s + n], max_bits):
            a.append(x)
            b.append(y)
    a, b = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (a, b))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


OUT = "a long, b long, anchor int, chunk int"


def _out(a, b, anchor=None, chunk=None):
    n = len(a)
    return pa.RecordBatch.from_arrays([
        pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
        pa.nulls(n, pa.int32()) if anchor is None else pa.array(np.full(n, anchor, np.int32)),
        pa.nulls(n, pa.int32()) if chunk is None else pa.array(np.full(n, chunk, np.int32))], names=["a", "b", "anchor", "chunk"])


def _compare(max_bits: int, chunk_size: int):
    """Rows sorted by anchor in; links out. Members of anchors over ``chunk_size`` come out as
    chunks (anchor and chunk set) to be compared in further tasks; at most a chunk is held."""
    def run(batches):
        held_a, held_f, cut = np.zeros(0, np.int64), np.zeros(0, np.uint64), {}

        def done(group, f):
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(f) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([start, [len(f)]]))
            big = (size > chunk_size) | np.isin(group[start], list(cut))
            for s, n in zip(start[big], size[big], strict=True):
                yield from chunks(int(group[s]), f[s: s + n])
            keep = np.repeat(~big, size)
            a, b = links(group[keep], f[keep], max_bits)
            if len(a):
                yield _out(a, b)

        def chunks(anchor, f):
            for lo in range(0, len(f), chunk_size):
                cut[anchor] = cut.get(anchor, -1) + 1
                part = f[lo: lo + chunk_size]
                yield _out(part, part, anchor, cut[anchor])

        for b in batches:
            group = np.concatenate([held_a, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
            f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(f):
                continue
            last = int(np.searchsorted(group, group[-1]))
            yield from done(group[:last], f[:last])
            held_a, held_f = group[last:], f[last:]
            if len(held_f) > chunk_size:
                whole = len(held_f) // chunk_size * chunk_size
                yield from chunks(int(held_a[0]), held_f[:whole])
                held_a, held_f = held_a[whole:], held_f[whole:]
        yield from done(held_a, held_f)
    return run


def near_links(fps: DataFrame, max_bits: int = 3, chunk_size: int = CHUNK) -> DataFrame:
    """Links (a, b), a < b unsigned, that connect all distinct ``fp`` within ``max_bits``: per anchor a forest."""
    spark = fps.sparkSession
    parts = n_parts(spark)
    found = materialize(fps.select("fp").mapInArrow(_replicate(max_bits), "anchor int, fp long")
                        .repartition(parts, "anchor").sortWithinPartitions("anchor")
                        .mapInArrow(_compare(max_bits, chunk_size), OUT), "simhash-links")
    edges = found.where("anchor is null").select("a", "b")
    large = found.where("anchor is not null").select("anchor", "chunk", F.col("a").alias("fp"))
    n = large.groupBy("anchor").agg((F.max("chunk") + 1).alias("n"))
    if not n.isEmpty():
        pairs = (large.join(n, "anchor").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
                 .select(F.xxhash64("anchor", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("task"), "fp"))
        more = (pairs.repartition(parts, "task").sortWithinPartitions("task")
                .mapInArrow(_compare(max_bits, 1 << 30), OUT).select("a", "b"))
        edges = edges.unionByName(more)
    return edges.distinct()


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long): root is the component's smallest node."""
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def large_star(e: DataFrame) -> DataFrame:
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        each = e.join(low, "a")
        return (each.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(low.select("a", F.col("m").alias("b"))).distinct())

    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    last = state(cur)
    while last[0]:
        cur = materialize(small_star(large_star(cur)), "stars")
        now = state(cur)
        if now == last:
            break
        last = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
                   carry: list[Column] | None = None, chunk_size: int = CHUNK) -> DataFrame:
    """One row per input row: ``<id_col>, fp, component_id, kept``; one row of each component is kept. With ``carry`` also
    ``text`` and the struct ``row`` of those columns."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, carry), "simhash-fp")
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "n"))
    nodes = materialize(rows.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    comp = components(near_links(nodes, max_bits, chunk_size))
    rooted = (nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    best = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_fp = rooted.select("fp", "root").join(best, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.n").alias("keep_n"))
    more = ["text", "row"] if carry is not None else []
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id", (F.col("n") == F.col("keep_n")).alias("kept"), *more)
