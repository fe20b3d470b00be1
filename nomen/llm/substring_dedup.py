"""Substring dedup by seed and extend: remove words of repeats of ``window`` words or more.

A window is ``window`` consecutive words of one document; a word goes when a window over it
also starts in a document with a smaller id, judged on the input.

1. **Seeds.** Of the k-grams of every window the one with the smallest hash (the leftmost of equal ones) is
   its anchor, so equal windows have equal anchors and neighbouring windows mostly
   share one (winnowing: about 2 of 10 positions are anchors). Documents are joined on anchors:
   an anchor is a seed if it occurs in two documents.
2. **Extension.** Around every seed the document is extended both ways to all windows that the
   anchor stands for, and windows are joined exactly: each window's smallest document id is
   found, and it repeats if that is smaller than its own.
3. **Maximal repeats.** Neighbouring repeated windows run together; the words they cover go.

The two joins are one shuffle each: a task puts its hashes into one sorted array per bucket (the
bucket comes from a second hash, so equality rests on 64 bits and the bucket number), and a task
of the other side merges a bucket's arrays. Before the shuffle every Arrow batch settles what it can
see itself and sends one entry per distinct hash, so text that a third of all documents share
costs one entry per batch. No pairs of documents are made. Answers go back to the
documents as positions, joined by document.

Defined cases: a null or word-free text has no words and an empty kept text; a null id
counts as larger than any other and null-id rows as one document; rows equal in id and text are one document
and get the same answer; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, n_parts
from nomen.llm._text import mix64, prefix_hash, ragged, run_hash, slices, span_hash, text_buffers, word_spans

WINDOW = 13
ANCHOR = 5
NO_ID = (1 << 63) - 1
#: bucket -1: (id, tag, run) is an answer already; else body holds hashes of a bucket with their owners
ASK = "bucket int, id long, tag int, run long, body binary"
#: a run is a first number and a count, packed by :func:`_pack`
ANSWER = "id long, tag int, run long"


def _pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | n.astype(np.int64)


def _unpack_runs(runs: np.ndarray) -> np.ndarray:
    return ragged(runs >> 32, runs & 0xFFFFFFFF)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n)).astype(np.int32)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``w`` values."""
    n = len(x) - w + 1
    best, at = x[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, w):
        less = x[i: i + n] < best
        best = np.where(less, x[i: i + n], best)
        at[less] = i
    return at + np.arange(n)


class Words:
    """Word hashes, windows and their anchors of the documents of a slice."""

    def __init__(self, data, off, window, k):
        self.starts, self.ends, self.row = word_spans(data, off)
        h = span_hash(prefix_hash(data), self.starts, self.ends)
        n = len(h)
        self.first = np.searchsorted(self.row, np.arange(len(off)))          # first word of each row
        ok = np.zeros(0, bool) if n < window else self.row[window - 1:] == self.row[: n - window + 1]
        self.at = np.flatnonzero(ok)                                         # windows by first word
        grams, self.hash = run_hash(h, k), run_hash(h, window)
        self.anchor_at = sliding_min(grams, window - k + 1)[self.at] if len(self.at) else self.at
        self.grams = grams


def _send(h, row, spot, alone, buckets: int, ids, tags):
    """One body per bucket: asks with owners, document by document, then ``alone``: hashes without owners."""
    bucket, bucket2 = _bucket(h, buckets), _bucket(alone, buckets)
    order = np.lexsort((spot, row, bucket))
    h, row, spot, bucket = h[order], row[order], spot[order], bucket[order]
    alone = alone[np.argsort(bucket2, kind="stable")]
    cut, cut2 = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(np.sort(bucket2), np.arange(buckets + 1))
    for k in range(buckets):
        s, e, s2, e2 = cut[k], cut[k + 1], cut2[k], cut2[k + 1]
        if s == e and s2 == e2:
            continue
        own, n = np.unique(row[s:e], return_counts=True)
        yield k, b"".join([np.array([e - s, len(own), e2 - s2], np.int64).tobytes(), h[s:e].tobytes(), alone[s2:e2].tobytes(), ids[own].tobytes(),
                           n.astype(np.int32).tobytes(), tags[own].tobytes(), spot[s:e].astype(np.int32).tobytes()])


def _unpack(body: bytes):
    n, m, k = np.frombuffer(body, np.int64, 3)
    at, out = 24, []
    for kind, count in ((np.uint64, n), (np.uint64, k), (np.int64, m), (np.int32, m), (np.int32, m), (np.int32, n)):
        out.append(np.frombuffer(body, kind, count, at))
        at += int(count) * np.dtype(kind).itemsize
    h, alone, ids, count, tags, spot = out
    return h, np.repeat(ids, count), np.repeat(tags, count), spot, alone


def _runs(ids, tags, spots):
    """(id, tag, run) of parallel arrays: consecutive numbers of a document form a run."""
    if not len(ids):
        return ids, tags, spots
    order = np.lexsort((spots, tags, ids))
    i, t, s = ids[order], tags[order], spots[order].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)]))
    return i[cut], t[cut], _pack(s[cut], np.diff(np.concatenate([cut, [len(i)]])))


def _asks(window: int, k: int, buckets: int, stage: int):
    """Map side. Stage 1 asks whether anchors are seeds; stage 2 asks for the smallest id of the windows of seeds."""
    def run(batches):
        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, off = text_buffers(b.column(2))
            if stage == 2:
                seeds, seed_at = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            hs, rows, spots = [], [], []
            for lo, _, d, o in slices(data, off):
                w = Words(d, o, window, k)
                if not len(w.at):
                    continue
                # anchors are numbered within their document
                new = np.concatenate([[True], np.diff(w.anchor_at) != 0])
                first = np.flatnonzero(new)
                number, row1 = np.cumsum(new) - 1, w.row[w.anchor_at[first]]
                base = np.searchsorted(row1, np.arange(len(o)))
                if stage == 1:
                    h, row, spot = w.grams[w.anchor_at[first]], row1, np.arange(len(first)) - base[row1]
                else:
                    is_seed = np.zeros(len(first), bool)
                    for r in np.unique(row1):
                        is_seed[base[r] + _unpack_runs(seeds[seed_at[lo + r]: seed_at[lo + r + 1]])] = True
                    at = w.at[is_seed[number]]
                    h, row, spot = w.hash[at], w.row[at], at - w.first[w.row[at]]
                hs.append(h)
                rows.append(row + lo)
                spots.append(spot)
            if not hs:
                continue
            h, row, spot = np.concatenate(hs), np.concatenate(rows), np.concatenate(spots)
            order = np.lexsort((spot, tags[row], ids[row], h))
            h, row, spot = h[order], row[order], spot[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            lowest, ends = ids[row[first]], np.concatenate([first[1:], [len(h)]]) - 1
            several = ids[row[ends]] != lowest
            if stage == 1:
                # seen in two documents here: a seed, known without asking; others hear of it by its hash alone
                known, send, alone = several[group], ~several[group], h[first[several]]
            else:
                known, alone = ids[row] > lowest[group], h[:0]
                send = ~known
            # documents equal in id and text give equal entries: one is enough
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (ids[row[1:]] == ids[row[:-1]]) & (tags[row[1:]] == tags[row[:-1]]) & (spot[1:] == spot[:-1])])
            send &= ~same
            known &= ~same
            i, t, runs = _runs(ids[row[known]], tags[row[known]], spot[known])
            asks = list(_send(h[send], row[send], spot[send], alone, buckets, ids, tags))
            n, m = len(i), len(asks)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(n, -1), [a[0] for a in asks]]).astype(np.int32)),
                pa.concat_arrays([pa.array(i, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(t, pa.int32()), pa.nulls(m, pa.int32())]),
                pa.concat_arrays([pa.array(runs, pa.int64()), pa.nulls(m, pa.int64())]), pa.array([None] * n + [a[1] for a in asks], pa.binary())],
                names=["bucket", "id", "tag", "run", "body"])
    return run


def _answers(stage: int):
    """Reduce side: merge a bucket's arrays and answer the documents that are to know."""
    def run(batches):
        parts, told = [], []
        for b in batches:
            buckets = b.column(0).to_numpy(zero_copy_only=False)
            here = np.flatnonzero(buckets < 0)
            if len(here):
                yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(here)) for i in (1, 2, 3)], names=["id", "tag", "run"])
            for i in np.flatnonzero(buckets >= 0):
                *v, alone = _unpack(b.column(4)[int(i)].as_buffer())
                parts.append((*v, np.full(len(v[0]), buckets[i], np.int32)))
                told.append((alone, np.full(len(alone), buckets[i], np.int32)))
        if not parts:
            return
        h, ids, tags, spot, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        alone, bucket2 = (np.concatenate(x) for x in zip(*told, strict=True))
        del parts, told
        order = np.lexsort((ids, h, bucket))
        h, ids, bucket = h[order], ids[order], bucket[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])]) if len(h) else np.zeros(0, bool)
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        lowest, highest = ids[first], ids[np.concatenate([first[1:], [len(h)]]) - 1] if len(h) else ids[first]
        if stage == 1:
            seed = lowest != highest
            if len(alone):
                # hashes of different buckets in one task are told apart by the bucket mixed in
                mark = lambda x, k: mix64(x ^ k.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                seed |= np.isin(mark(h[first], bucket[first]), mark(alone, bucket2))
            say = seed[group]
        else:
            say = ids > lowest[group]
        i, t, runs = _runs(ids[say], tags[order[say]], spot[order[say]])
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(t), pa.array(runs)], names=["id", "tag", "run"])
    return run


def _joined(docs: DataFrame, keyed: DataFrame, window: int, k: int, buckets: int, stage: int) -> DataFrame:
    """Per document the list of runs that the join of a stage gives back: numbers of anchors (1) or windows (2)."""
    parts = n_parts(docs.sparkSession)
    asks = keyed.mapInArrow(_asks(window, k, buckets, stage), ASK)
    # answers known on the map side are spread by document, asks go by bucket
    spread = asks.repartition(parts, F.when(F.col("bucket") < 0, F.xxhash64("id", "tag")).otherwise(F.col("bucket").cast("long")))
    return (spread.mapInArrow(_answers(stage), ANSWER)
            .groupBy("id", "tag").agg(F.collect_list("run").alias(f"runs{stage}")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: ``<id_col>, n_words, n_removed, kept_text``."""
    out = _kept(docs, id_col, text_col, window, anchor, digest=False)
    return out.withColumnRenamed("kept", "kept_text")


def substring_dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The same with the SHA-256 of the kept text instead of the text itself."""
    return _kept(docs, id_col, text_col, window, anchor, digest=True).withColumnRenamed("kept", "kept_sha256")


def _kept(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, digest: bool) -> DataFrame:
    buckets = 4 * n_parts(docs.sparkSession)
    t = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.hash(col(text_col)).alias("tag"), col(text_col).alias("text"))
    seeds = _joined(docs, t, window, anchor, buckets, 1)
    # both joins by document read the same exchange of the texts
    with_seeds = t.join(seeds, ["id", "tag"], "left").select("id", "tag", "text", "runs1")
    covered = _joined(docs, with_seeds.where("runs1 is not null"), window, anchor, buckets, 2)
    final = t.join(covered, ["id", "tag"], "left").select("id", "text", "runs2")

    def finish(batches):
        for b in batches:
            data, off = text_buffers(b.column(1))
            hits_at = b.column(2).offsets.to_numpy()
            hits = b.column(2).values.to_numpy(zero_copy_only=False)
            n_words, n_removed, kept = [], [], []
            for lo, hi, d, o in slices(data, off):
                starts, ends, row = word_spans(d, o)
                first = np.searchsorted(row, np.arange(len(o)))
                raw = d.tobytes()
                for r in range(hi - lo):
                    s, e = starts[first[r]: first[r + 1]], ends[first[r]: first[r + 1]]
                    v = hits[hits_at[lo + r]: hits_at[lo + r + 1]]
                    words = raw[o[r]: o[r + 1]].split()
                    n_words.append(len(s))
                    if len(v):
                        edge = np.zeros(len(s) + 1, np.int64)
                        np.add.at(edge, v >> 32, 1)
                        np.add.at(edge, (v >> 32) + (v & 0xFFFFFFFF) + window - 1, -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        n_removed.append(int(gone.sum()))
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    else:
                        n_removed.append(0)
                    text = b" ".join(words)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["id", "n_words", "n_removed", "kept"])

    out = final.mapInArrow(finish, "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")
