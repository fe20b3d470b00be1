"""Language-model scoring by context-tree weighting (CTW) over bytes.

* **Binary decomposition.** A byte is eight binary decisions, most significant first; a decision is named by the bits
  before it (node 1 .. 255). A text is its UTF-8 bytes and one end byte (0xFF, never part of UTF-8); before the first
  byte the context is 0xFF as well.
* **Estimates.** Under each of the last 0 .. ``depth`` bytes and each node stand the zeros and ones seen in training
  and their Krichevsky-Trofimov probability.
* **Weighting.** The weighted probability of a context is half its own estimate and half the product of
  its longer contexts' weighted probabilities; that of the longest is its estimate. A decision's probability mixes the
  estimates of all depths with the weights that follow. A context without any training count has no
  estimate: the one before it stands in. Both bits of a decision have the same contexts, so probabilities still sum to one.

The counts are frozen after training, so a text's score is a sum over its byte ``depth + 1``-grams, and the work on Spark
is a counted lookup of them all:

1. The texts are written once, packed, in blocks of about ``BLOCK`` bytes.
2. Each block asks for its distinct grams (and distinct words, for the base score), with their training counts. A
   common gram is one entry a block, however often it occurs. Asks go to buckets by a hash of the key.
3. Buckets sum the counts. Distinct grams are dealt by their last ``TOP`` context bytes (at most 256**(depth - TOP + 1)
   grams each, so no such group grows with the input), where the weights of the longer contexts are found; the
   contexts of up to ``TOP - 1`` bytes are Spark aggregations of those.
4. Log-probabilities return to the buckets, answers to the blocks, and every block adds up its texts.

The base score is a unigram word model smoothed by one half. Words are known by a 64-bit hash (XXH3).

Defined cases: a null text is empty; an empty text has the probability of the end byte (and end token) alone; without training rows
every decision has probability one half; rows with a null id are never learnt from; repeated rows are scored each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, materialize, n_parts
from nomen.llm._text import mix64, slices, text_buffers

DEPTH = 5
TOP = 3                  # contexts of this length and more are weighted inside a task
BLOCK = 32 << 20         # bytes of text that ask together
PIECE = 1 << 20          # bytes of text that are packed together (a longer text is packed alone)
CHUNK = 4 << 20          # positions worked on at a time
LOAD = 4_000_000         # keys meant for one task
GRAM, WORD = 0, 1
END = 0xFF
LN2 = math.log(2.0)
ASK = "kind int, bucket int, block long, n int, keys binary, counts binary"


# --- keys of a block -------------------------------------------------------------------------------------------------

def grams(data: np.ndarray, off: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, row) of every coded byte of a slice, at most ``CHUNK`` at a time. A gram holds the ``depth`` bytes
    before, the latest lowest, and the byte itself in its low eight bits."""
    m = len(off) - 1
    padded = np.full(len(data) + (m + 1) * depth + 1, END, np.uint8)
    start = off[:-1] + (np.arange(m) + 1) * depth                # first byte of each text; its end byte is padding
    length = np.diff(off) + 1
    ends = np.cumsum(length)
    if len(data):
        padded[np.arange(len(data)) + np.repeat((np.arange(m) + 1) * depth, length - 1)] = data
    for lo in range(0, int(ends[-1]) if m else 0, CHUNK):
        hi = min(lo + CHUNK, int(ends[-1]))
        at = np.arange(lo, hi)
        row = np.searchsorted(ends, at, "right")
        at += (start - (ends - length))[row]
        first = int(at[0]) - depth
        win = padded[first: int(at[-1]) + 1].astype(np.uint64)
        n = len(win) - depth
        g = np.zeros(n, np.uint64)
        for i in range(depth + 1):
            g = (g << np.uint64(8)) | win[i: i + n]
        yield g[at - depth - first], row


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the distinct words, place of each word among them, row of each word) of a slice, A-Z lower-cased."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(low)))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    row, flat = row[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    keys = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    return keys, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys + np.uint64(kind + 1) * np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int32)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unpack(body: bytes, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, n).T).reshape(-1).view(kind)


def _pack_keys(k: np.ndarray) -> bytes:
    return _pack(np.diff(k, prepend=np.uint64(0)))


def _unpack_keys(body: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(body, n, np.uint64), dtype=np.uint64)


def _pieces(size: int):
    """Texts packed into compressed pieces of about ``PIECE`` bytes, and the block that each belongs to."""
    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for lo, hi, d, o in slices(*text_buffers(b.column(2)), PIECE):
                out.append((part << 32 | total // size, lo, hi, len(d), zlib.compress(np.diff(o).tobytes(), 1), pa.compress(d.tobytes(), "zstd", asbytes=True)))
                total += len(d) + hi - lo
            if out:
                block, lo, hi, n, sizes, texts = zip(*out, strict=True)
                at = pa.array([*lo, hi[-1]], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, b.column(0)), pa.ListArray.from_arrays(at, b.column(1)), pa.array(block, pa.int64()), pa.array(n, pa.int64()),
                                                  pa.array(sizes, pa.binary()), pa.array(texts, pa.binary())], names=["rows", "held", "block", "n", "sizes", "texts"])
    return run


def _piece(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a piece."""
    off = np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(row["sizes"]), np.int64))])
    return np.frombuffer(pa.decompress(row["texts"], row["n"], "zstd", asbytes=True), np.uint8), off


class Asked:
    """Distinct keys of a block with their training counts."""

    def __init__(self, depth: int):
        self.depth, self.waiting, self.size = depth, [], 0
        self.have = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in (GRAM, WORD)]

    def add(self, data, off, train):
        self.waiting.append((data, np.diff(off), train))
        self.size += len(data)
        if self.size >= CHUNK:
            self.merge()

    def merge(self):
        if not self.waiting:
            return
        data, length, train = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        off = np.concatenate([[0], np.cumsum(length)])
        self.waiting, self.size = [], 0
        parts = [self.have[GRAM]]
        for g, row in grams(data, off, self.depth):
            v = np.sort(g << np.uint64(1) | train[row].astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            many = np.diff(np.concatenate([first, [len(v)]]))
            parts.append((v[first] >> np.uint64(1), np.where(v[first] & np.uint64(1), many, 0)))
        self.have[GRAM] = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        keys, at, row = words(data, off)
        n = np.bincount(at, train[row], len(keys)).astype(np.int64)
        self.have[WORD] = summed(np.concatenate([self.have[WORD][0], keys]), np.concatenate([self.have[WORD][1], n]))

    def asks(self, block: int, buckets: int):
        """One row per kind and bucket."""
        self.merge()
        for kind in (GRAM, WORD):
            keys, n = self.have[kind]
            b = _bucket(kind, keys, buckets)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(cut)):
                at = order[cut[i]: cut[i + 1]]
                yield kind, int(i), block, len(at), _pack_keys(keys[at]), _pack(n[at])


def _asks(depth: int, buckets: int):
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def batch(asked, block):
        rows = list(asked.asks(block, buckets))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "bucket", "block", "n", "keys", "counts"])

    def run(batches):
        block, asked = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != block:
                    if asked:
                        yield from batch(asked, block)
                    block, asked = r["block"], Asked(depth)
                asked.add(*_piece(r), ~np.array(r["held"], bool))
        if asked:
            yield from batch(asked, block)
    return run


def _counts(batches):
    """Reduce side of the asks: (kind, bucket, key, n), each key once."""
    parts: dict[tuple[int, int], list] = {}
    for b in batches:
        for r in b.to_pylist():
            parts.setdefault((r["kind"], r["bucket"]), []).append((r["keys"], r["counts"], r["n"]))
    for (kind, bucket), rows in parts.items():
        keys, n = summed(np.concatenate([_unpack_keys(k, m) for k, _, m in rows]), np.concatenate([_unpack(c, m, np.int64) for _, c, m in rows]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.full(len(keys), bucket, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)],
                                         names=["kind", "bucket", "key", "n"])


# --- the tree --------------------------------------------------------------------------------------------------------

def _lgamma(x):
    """log Gamma for x > 0: Stirling's series at x + 7."""
    y, p = x + 7.0, np.ones_like(x)
    for i in range(7):
        p = p * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(p)


def log_kt(a, b):
    """Natural log of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    a, b = a.astype(float), b.astype(float)
    return np.where(a + b == 0, 0.0, _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Tree:
    """Nodes of the contexts of ``top`` .. ``depth`` bytes of some grams; all grams of a ``top``-byte context are here.

    ``level[d][k]`` holds, for the contexts of ``d`` bytes and the nodes of ``k`` bits: keys (context then bits), zeros,
    ones, log estimate, log product of the longer contexts, log weighted probability."""

    def __init__(self, g: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.grams, self.depth, self.top, self.level = g, depth, top, {}
        for d in range(depth, top - 1, -1):
            if d < depth:
                g, n = summed(g & _mask(8 * d + 8), n)
            self.level[d] = [self._nodes(g, n, d, k) for k in range(8)]

    def _nodes(self, g, n, d, k):
        prefix = g >> np.uint64(8 - k)
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(g) else np.zeros(0, np.int64)
        one = (g >> np.uint64(7 - k)) & np.uint64(1) == 1
        keys = prefix[first]
        a, b = (np.add.reduceat(np.where(x, n, 0), first) if len(first) else n[:0] for x in (~one, one))
        own = log_kt(a, b)
        if d == self.depth:
            return keys, a, b, own, None, own
        child = self.level[d + 1][k]
        longer = np.bincount(np.searchsorted(keys, child[0] & _mask(8 * d + k)), child[5], len(keys))
        return keys, a, b, own, longer, np.logaddexp(own, longer) - LN2

    def top_rows(self):
        """(key, zeros, ones, log weighted probability) of the shortest contexts here; key is context << 8 | node."""
        out = []
        for k, (keys, a, b, _, _, w) in enumerate(self.level[self.top]):
            out.append((_node_key(keys, k), a, b, w))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def log10(self, key: np.ndarray, done: np.ndarray, rest: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte, given what the shorter contexts say of the nodes ``key``."""
        order = np.argsort(key)
        key, state = key[order], [x[order] for x in (done, rest, before)]
        total = np.zeros(len(self.grams))
        for k in range(8):
            keys = self.level[self.top][k][0]
            p, r, last = (x[np.searchsorted(key, _node_key(keys, k))] for x in state)
            for d in range(self.top, self.depth + 1):
                keys, a, b, own, longer, _ = self.level[d][k]
                p, r, last = _mix(a, b, own, longer, p, r, last)
                if d < self.depth:
                    at = np.searchsorted(keys, self.level[d + 1][k][0] & _mask(8 * d + k))
                    p, r, last = p[at], r[at], last[at]
            zero = p[np.searchsorted(keys, self.grams >> np.uint64(8 - k))]
            total += np.log10(np.where((self.grams >> np.uint64(7 - k)) & np.uint64(1) == 1, 1 - zero, zero))
        return total


def _node_key(keys: np.ndarray, k: int) -> np.ndarray:
    return keys >> np.uint64(k) << np.uint64(8) | np.uint64(1 << k) | keys & _mask(k)


def _mix(a, b, own, longer, p, rest, last):
    """One depth further: the mixed probability of a zero so far, the weight left for longer contexts, this estimate."""
    seen = a + b > 0
    zero = (a + 0.5) / (a + b + 1.0)
    share = np.ones(len(a)) if longer is None else 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
    return np.where(seen, p + rest * share * zero, p + rest * last), np.where(seen, rest * (1 - share), 0.0), zero


def _read_all(batches, names):
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _up(depth: int):
    def run(batches):
        got = _read_all(batches, ("key", "n"))
        if got is not None and len(got[0]):
            g, n = summed(got[0].view(np.uint64), got[1])
            key, a, b, w = Tree(g, n, depth, TOP).top_rows()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(a), pa.array(b), pa.array(w)], names=["key", "a", "b", "w"])
    return run


def _down(depth: int, buckets: int):
    def run(batches):
        got = _read_all(batches, ("is_gram", "key", "n", "p", "rest", "last"))
        if got is None or not len(got[0]):
            return
        gram = got[0].astype(bool)
        g, n = summed(got[1][gram].view(np.uint64), np.nan_to_num(got[2][gram]).astype(np.int64))
        value = Tree(g, n, depth, TOP).log10(got[1][~gram].view(np.uint64), *(x[~gram].astype(float) for x in got[3:]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), GRAM, np.int32)), pa.array(_bucket(GRAM, g, buckets)), pa.array(g.view(np.int64)), pa.array(value)],
                                         names=["kind", "bucket", "key", "value"])
    return run


def _lgamma_sql(x: Column) -> Column:
    y, p = x + 7.0, x
    for i in range(1, 7):
        p = p * (x + float(i))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - F.log(p)


def _shorter(nodes: DataFrame, length: int) -> DataFrame:
    """Nodes of the contexts of ``length`` bytes from those one byte longer (``key, a, b, w``)."""
    t = nodes.groupBy(_parent(length).alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("longer"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    t = t.withColumn("own", F.when(a + b == 0, F.lit(0.0)).otherwise(_lgamma_sql(a + 0.5) + _lgamma_sql(b + 0.5) - math.log(math.pi) - _lgamma_sql(a + b + 1.0)))
    high, low = F.greatest("own", "longer"), F.least("own", "longer")
    return materialize(t.withColumn("w", high + F.log1p(F.exp(low - high)) - LN2), "ctw-nodes")


def _parent(length: int) -> Column:
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * length)) - 1))
    return F.shiftleft(context, 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))


def _mixed(t: DataFrame) -> DataFrame:
    """``key, p, rest, last`` one depth further (see :func:`_mix`)."""
    seen, zero = F.col("a") + F.col("b") > 0, (F.col("a") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    share = 1 / (1 + F.exp(F.least(F.greatest(F.col("longer") - F.col("own"), F.lit(-700.0)), F.lit(700.0))))
    return t.select("key", F.when(seen, F.col("p") + F.col("rest") * share * zero).otherwise(F.col("p") + F.col("rest") * F.col("last")).alias("p"),
                    F.when(seen, F.col("rest") * (1 - share)).otherwise(F.lit(0.0)).alias("rest"), zero.alias("last"))


def gram_log10(counted: DataFrame, depth: int, buckets: int, parts: int) -> DataFrame:
    """``kind, bucket, key, value``: the log10 probability of the byte of each gram (``key, n``)."""
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * TOP)) - 1))
    mine = counted.select("key", "n").repartition(parts, context)
    top = materialize(mine.mapInArrow(_up(depth), "key long, a long, b long, w double"), "ctw-top")
    levels = [top]
    for length in range(TOP - 1, -1, -1):
        levels.append(_shorter(levels[-1], length))
    state = _mixed(levels.pop().withColumns({"p": F.lit(0.0), "rest": F.lit(1.0), "last": F.lit(0.5)}))
    for length in range(TOP):
        longer = levels.pop().withColumn("above", _parent(length))
        t = longer.join(state.withColumnRenamed("key", "above"), "above").drop("above")
        state = _mixed(t) if levels else t.select("key", "p", "rest", "last")
    both = (counted.select(F.lit(True).alias("is_gram"), "key", "n", context.alias("context"))
            .unionByName(state.select(F.lit(False).alias("is_gram"), "key", "p", "rest", "last", context.alias("context")), allowMissingColumns=True))
    return both.repartition(parts, "context").mapInArrow(_down(depth, buckets), "kind int, bucket int, key long, value double")


# --- answers ---------------------------------------------------------------------------------------------------------

def _answers(batches):
    asks, known = [], {}
    for b in batches:
        ask = ~pc.is_null(b.column("block")).to_numpy(zero_copy_only=False)
        asks += b.filter(pa.array(ask)).select(["kind", "bucket", "block", "n", "keys"]).to_pylist()
        rest = b.filter(pa.array(~ask))              # without nulls, so that keys stay whole numbers
        kind, bucket, key, value = (rest.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "bucket", "key", "value"))
        group = kind.astype(np.int64) << 32 | bucket.astype(np.int64)
        for k in np.unique(group):
            known.setdefault(int(k), []).append((key[group == k].view(np.uint64), value[group == k]))
    tables = {}
    for k, v in known.items():
        key, value = (np.concatenate(x) for x in zip(*v, strict=True))
        order = np.argsort(key)
        tables[k] = key[order], value[order]
    del known
    for r in asks:
        key, value = tables[r["kind"] << 32 | r["bucket"]]
        got = value[np.searchsorted(key, _unpack_keys(r["keys"], r["n"]))]
        got = got.astype(np.float32) if r["kind"] == GRAM else got
        yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([r["kind"]], pa.int32()), pa.array([r["n"]], pa.int32()), pa.array([r["keys"]], pa.binary()), pa.array([_pack(got)], pa.binary())],
                                         names=["block", "kind", "n", "keys", "values"])


def _scores(depth: int, tokens: int, kinds: int, ends: int):
    """Adds up the texts of a block. Word values are training counts; ``ends`` training texts end."""
    def table(answers, kind, dtype):
        rows = [(_unpack_keys(r["keys"], r["n"]), _unpack(r["values"], r["n"], dtype)) for r in answers.filter(pc.equal(answers["kind"], kind)).to_pylist()]
        keys, values = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.uint64), np.zeros(0, dtype))
        keys, first = np.unique(keys, return_index=True)
        return pd.Index(keys), values[first].astype(float)

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        gram_keys, gram_values = table(told, GRAM, np.float32)
        word_keys, word_counts = table(told, WORD, np.float64)
        word_log = lambda c: np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))
        out = []
        for b in texts.select(["held", "n", "sizes", "texts"]).to_batches(1):
            r = b.to_pylist()[0]
            d, o = _piece(r)
            m = len(o) - 1
            score = np.zeros(m)
            for g, row in grams(d, o, depth):
                score += np.bincount(row, gram_values[gram_keys.get_indexer(g)], m)
            keys, at, row = words(d, o)
            c = word_counts[word_keys.get_indexer(keys)] if len(keys) else np.zeros(0)
            base = np.bincount(row, word_log(c)[at], m) + word_log(np.float64(ends))
            out.append((np.array(r["held"], bool), np.bincount(row, minlength=m) + 1, (np.bincount(row, (c > 0)[at], m) + (ends > 0)).astype(np.int64), np.full(m, tokens, np.int64),
                        base, score, -score / math.log10(2) / (np.diff(o) + 1)))
        rows = pa.concat_arrays([x.flatten() for x in texts.column("rows").chunks])
        names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
        return pa.table({"row": rows} | {k: np.concatenate(v) for k, v in zip(names, zip(*out, strict=True), strict=True)})
    return run


def context_tree_scores(docs: DataFrame, held: Column, carry: list[Column], text_col: str = "text", depth: int = DEPTH,
                        block_bytes: int = BLOCK) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte``. Rows for which ``held`` is true (or null) are not learnt from."""
    if not TOP <= depth <= 6:
        raise ValueError(f"depth is {TOP} to 6 bytes")
    spark = docs.sparkSession
    t = docs.select(F.struct(*carry).alias("row"), F.coalesce(held, F.lit(True)).alias("held"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    row_type = t.schema["row"].dataType.simpleString()
    t = materialize(t.mapInArrow(_pieces(block_bytes), f"rows array<{row_type}>, held array<boolean>, block long, n long, sizes binary, texts binary"), "ctw-texts")
    buckets = 4 * n_parts(spark)
    asks = materialize(t.drop("rows").mapInArrow(_asks(depth, buckets), ASK), "ctw-asks")
    asked = asks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(n_parts(spark), min(buckets, -(-asked // LOAD)))
    counted = materialize(asks.repartition(parts, "kind", "bucket").mapInArrow(_counts, "kind int, bucket int, key long, n long"), "ctw-counts")

    ends = t.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()[0]
    kinds, tokens = counted.where(f"kind = {WORD} and n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds, tokens = kinds + (ends > 0), tokens + ends

    values = (gram_log10(counted.where(f"kind = {GRAM}"), depth, buckets, parts)
              .unionByName(counted.where(f"kind = {WORD}").select("kind", "bucket", "key", F.col("n").cast("double").alias("value"))))
    both = asks.drop("counts").unionByName(values, allowMissingColumns=True)
    answers = both.repartition(parts, "kind", "bucket").mapInArrow(_answers, "block long, kind int, n int, keys binary, values binary")
    out = f"row {row_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return t.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(depth, tokens, kinds, ends), out)
