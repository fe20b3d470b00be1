"""Byte-level BPE encoding and decoding in length-bucketed numpy matrices.

Texts are split by the tokenizer's pattern; every distinct piece is encoded once. The
pieces of one length bucket form a padded matrix of token ids, one row a piece. In
every round each unfinished row merges its leftmost pair of minimum rank, and the row closes up
over the gap. Ranks of pairs come from an open-addressing hash table of (left id,
right id) -> merged id in two numpy arrays; after a merge only the two pairs beside it are
looked up again.

Most pieces repeat, so texts are first cut before single spaces, where the pattern cuts
anyway, and each distinct cut is split and encoded once per process (a bounded cache). Texts with
white space next to a space in other ways go through the pattern whole.

The rank file is read once by the driver from a path parameter and broadcast (its size is the
vocabulary's). Special tokens are not recognised: their strings are ordinary text.

Defined cases: a null text counts as empty and has no tokens; a piece that is a token as a whole is that
token; a very long piece takes one round per merge; an empty table gives an empty result; extra columns are
ignored unless carried.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col
from nomen.llm._text import mix64, ragged, slices, text_buffers

NONE = np.int32(1 << 30)
CACHE_CUTS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> merged id by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(4 * len(left) - 1).bit_length()) if len(left) else 16
        self.mask = np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 1
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = key[free[first]], merged[free[first]]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id or ``NONE``; ids below 0 (padding) find nothing."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        key[(left < 0) | (right < 0)] = -2
        out, slot, todo = np.full(key.shape, NONE, np.int32).ravel(), self._slot(key).ravel(), None
        key = key.ravel()
        todo = np.flatnonzero(key >= 0)
        for _ in range(self.probes):
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & self.mask
        return out.reshape(left.shape)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        #: a space with white space on both sides, or one at the end after white space
        self.unsafe = regex.compile(r"\s (?:\s|\Z)")
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.reset()

    def reset(self) -> None:
        """Empty the cache of cuts: 'x' is the text x, a cut in `spaced` stands for ' ' + x."""
        self.plain, self.spaced, self.new = _Cuts(), _Cuts(), []
        self.plain.owner = self.spaced.owner = self
        self.spaced.lead = " "
        self.n_cuts = 0
        self.flat, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, pieces of a length bucket at a time."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif p:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
            else:
                out[i] = np.zeros(0, np.int32)
        for width, own in buckets.items():
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(own), step):
                part = own[lo: lo + step]
                for i, ids in zip(part, self._merge_matrix([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        n = np.array([len(p) for p in pieces])
        width = int(n.max())
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.repeat(np.arange(len(pieces)), n), ragged(np.zeros(len(n), np.int64), n)] = self.byte_ids[raw]
        rank = np.full((len(pieces), width), NONE, np.int32)   # rank[:, j]: of the pair (j, j + 1)
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        done: list[np.ndarray | None] = [None] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            j = rank.argmin(axis=1)
            r = np.arange(len(row))
            best = rank[r, j]
            over = best == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    done[row[i]] = ids[i][ids[i] >= 0]
                keep = ~over
                row, ids, rank, j, best = row[keep], ids[keep], rank[keep], j[keep], best[keep]
                if not len(row):
                    break
                longest = int((ids >= 0).sum(axis=1).max())
                ids, rank = ids[:, :longest], rank[:, :longest]
                r = np.arange(len(row))
            # close up over position j + 1
            w = ids.shape[1]
            ids[r, j] = best
            cols = np.arange(w)
            if w > 1:
                gone = cols[None, :] == (j + 1)[:, None]
                ids = np.concatenate([ids[~gone].reshape(len(row), w - 1), np.full((len(row), 1), -1, np.int32)], axis=1)
                rank = np.concatenate([rank[~gone].reshape(len(row), w - 1), np.full((len(row), 1), NONE, np.int32)], axis=1)
            right = np.where(j + 1 < w, ids[r, np.minimum(j + 1, w - 1)], -1)
            rank[r, j] = self.pairs.find(ids[r, j], right)
            has = j > 0
            rank[r[has], j[has] - 1] = self.pairs.find(ids[r[has], j[has] - 1], ids[r[has], j[has]])
        return done

    def _learn(self) -> None:
        """Encode the cuts met for the first time and append them to the store."""
        split = [self.pattern.findall(c) for c in self.new]
        distinct = {}
        for ps in split:
            for p in ps:
                distinct.setdefault(p, len(distinct))
        encoded = self.merge([p.encode() for p in distinct])
        size = np.array([len(x) for x in encoded], np.int64)
        flat = np.concatenate([*encoded, np.zeros(0, np.int32)])
        at = np.cumsum(size) - size
        n_pieces = np.array([len(ps) for ps in split], np.int64)
        piece = np.fromiter((distinct[p] for ps in split for p in ps), np.int64, int(n_pieces.sum()))
        ends = np.concatenate([[0], np.cumsum(size[piece])])
        cut_end = np.cumsum(n_pieces)
        lengths = ends[cut_end] - ends[cut_end - n_pieces]
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lengths) - lengths])
        self.len = np.concatenate([self.len, lengths])
        self.flat = np.concatenate([self.flat, flat[ragged(at[piece], size[piece])]])
        self.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        if self.n_cuts > CACHE_CUTS:
            self.reset()
        cuts, n = [], []
        for t in texts:
            if self.unsafe.search(t):
                own = [self.plain[p] for p in self.pattern.findall(t)]
            else:
                first, *rest = t.split(" ")
                own = [self.plain[first]] if first else []
                own.extend(map(self.spaced.__getitem__, rest))
            cuts.extend(own)
            n.append(len(own))
        if self.new:
            self._learn()
        cut = np.array(cuts, np.int64)
        size = self.len[cut]
        ids = self.flat[ragged(self.at[cut], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens."""
        return self.token_bytes[ragged(self.token_at[ids], self.token_len[ids])]


class _Cuts(dict):
    lead = ""

    def __missing__(self, cut: str) -> int:
        i = self[cut] = self.owner.n_cuts
        self.owner.n_cuts += 1
        self.owner.new.append(self.lead + cut)
        return i


_BPE: dict[tuple, Bpe] = {}


def bpe_of(key: tuple, ranks: dict[bytes, int], pattern: str) -> Bpe:
    if key not in _BPE:
        _BPE[key] = Bpe(ranks, pattern)
    return _BPE[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """One row per input row: the carried columns, ``ids`` (unsigned 32-bit little-endian, as binary), ``n_tokens``, and
    ``decoded``: the bytes that the ids decode to."""
    t = docs.select(*(carry or []), col(text_col).alias("_text"))
    names = t.columns[:-1]
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = (ranks_path, pattern)

    def run(batches):
        bpe = bpe_of(key, ranks.value, pattern)
        for b in batches:
            data, off = text_buffers(b.column(len(names)))
            for lo, hi, d, o in slices(data, off):
                raw = d.tobytes()
                ids, at = bpe.encode([raw[o[i]: o[i + 1]].decode() for i in range(hi - lo)])
                decoded = bpe.decode(ids)
                size = np.concatenate([[0], np.cumsum(bpe.token_len[ids])])[at]
                raw_ids = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in b.columns[:-1]), pa.array([raw_ids[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                     pa.array(np.diff(at)), pa.array([decoded[s:e].tobytes() for s, e in zip(size[:-1], size[1:], strict=True)], pa.binary())],
                    names=[*names, "ids", "n_tokens", "decoded"])

    schema = t.select(names).schema
    for name, kind in (("ids", "binary"), ("n_tokens", "long"), ("decoded", "binary")):
        schema = schema.add(name, kind)
    return t.mapInArrow(run, schema)
