"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

* **Random indexing.** Every word has a fixed sparse index vector of +-1 in ``NONZERO`` of ``DIM`` places, drawn
  from its hash. A word's context vector is the sum of the index vectors of the words up to ``REACH``
  places beside it, over all documents. Words share ``BUCKETS`` rows by hash: the table has the same
  size for any corpus, each task sums its own copy, and rows are added up by a shuffle.
* **Pooling.** A document is the mean and the spread of its words' context vectors, the mean of
  index vectors of the words, their first and last three bytes, and a few lengths.
* **Network.** Two layers in numpy, trained by Adam on at most ``SAMPLE`` labelled documents (a
  bounded, hash-picked sample); a fifth of it is set aside to fit the temperature that the
  logits are divided by, so scores are probabilities.

Defined cases: a null or empty text has zero features and gets the network's score for them; without labels
of both kinds the score is the (smoothed) share of label 1; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, labelled_sample
from nomen.llm._text import mix64, prefix_hash, slices, span_hash, text_buffers, word_spans

DIM = 32
BUCKETS = 1 << 14
NONZERO = 2
REACH = 2
SAMPLE = 6000
FORM = 64        # places of the index vectors of word forms
FEATURES = 2 * DIM + FORM + 4


def index_places(h: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, sign) of the nonzero entries of the index vector of each hash."""
    out = []
    for k in range(NONZERO):
        x = h >> np.uint64(12 * k + 3)
        out.append(((x % np.uint64(dim)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(40 + k)) & np.uint64(1)).astype(float)))
    return out


def _contexts(batches):
    """Per task one row per bucket that occurs: the sums of its neighbours' index vectors."""
    total = np.zeros(BUCKETS * DIM)
    for b in batches:
        for _, _, d, o in slices(*text_buffers(b.column(0))):
            s, e, row = word_spans(d, o)
            h = span_hash(prefix_hash(d), s, e)
            bucket = (h % np.uint64(BUCKETS)).astype(np.int64) * DIM
            at, sign = [], []
            for place, sg in index_places(mix64(h), DIM):
                for k in range(1, REACH + 1):
                    same = row[k:] == row[:-k]
                    at += [(bucket[:-k] + place[k:])[same], (bucket[k:] + place[:-k])[same]]
                    sign += [sg[k:][same], sg[:-k][same]]
            if at and len(h) > 1:
                total += np.bincount(np.concatenate(at), np.concatenate(sign), BUCKETS * DIM)
    total = total.reshape(BUCKETS, DIM).astype(np.int64)
    used = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, i]) for i in range(DIM))], names=["bucket", *(f"v{i}" for i in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIM) context vectors of length at most 1 from every document."""
    names = [f"v{i}" for i in range(DIM)]
    rows = (docs.select(col(text_col).alias("text")).mapInArrow(_contexts, "bucket long, " + ", ".join(f"{n} long" for n in names))
            .groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow())   # at most BUCKETS rows
    table = np.zeros((BUCKETS, DIM), np.float32)
    if rows.num_rows:
        v = np.stack([rows.column(n).to_numpy() for n in names], axis=1).astype(float)
        table[rows.column("bucket").to_numpy()] = v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1.0)
    return table


def pooled(d: np.ndarray, o: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of a slice."""
    m = len(o) - 1
    out = np.zeros((m, FEATURES), np.float32)
    s, e, row = word_spans(d, o)
    if not len(s):
        return out
    ph = prefix_hash(d)
    h = span_hash(ph, s, e)
    n = np.bincount(row, minlength=m)
    some = np.maximum(n, 1)[:, None]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    at = row[first]
    v = table[(h % np.uint64(BUCKETS)).astype(np.int64)]
    mean = np.zeros((m, DIM))
    square = np.zeros((m, DIM))
    mean[at] = np.add.reduceat(v, first, axis=0)
    square[at] = np.add.reduceat(v * v, first, axis=0)
    mean /= some
    out[:, :DIM] = mean * 5
    out[:, DIM: 2 * DIM] = np.sqrt(np.maximum(0, square / some - mean * mean)) * 5
    form = np.zeros(m * FORM)
    for key in (h, span_hash(ph, s, np.minimum(e, s + 3)) + np.uint64(1), span_hash(ph, np.maximum(s, e - 3), e) + np.uint64(2)):
        for place, sign in index_places(mix64(key), FORM):
            form += np.bincount(row * FORM + place, sign, m * FORM)
    form = form.reshape(m, FORM) / some
    out[:, 2 * DIM: 2 * DIM + FORM] = form * 3
    size = np.bincount(row, (e - s).astype(float), m)
    out[:, -4] = np.log1p(n)
    out[:, -3] = size / some[:, 0]
    out[:, -2] = (form * form).sum(axis=1)
    out[:, -1] = np.diff(o) / (size + 1.0)
    return out


class Network:
    """Two layers: tanh, then a logit; inputs are standardised; the temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.prior = (y.sum() + 1.0) / (len(y) + 2.0)
        self.fitted = 0 < y.sum() < len(y)
        if not self.fitted:
            return
        order = rng.permutation(len(y))
        aside, train = order[: len(y) // 5], order[len(y) // 5:]
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.std
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m1, m2, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), batch):
                i = train[lo: lo + batch]
                a = np.tanh(z[i] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(g, p[2]) * (1 - a * a)
                grads = [z[i].T @ back + decay * p[0], back.sum(axis=0), a.T @ g + decay * p[2], g.sum(keepdims=True)]
                t += 1
                for k, grad in enumerate(grads):
                    m1[k] = 0.9 * m1[k] + 0.1 * grad
                    m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                    p[k] = p[k] - rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(aside):
            logit, ya = self.logit(x[aside]), y[aside]
            grid = np.geomspace(0.25, 8, 60)
            loss = [np.mean(np.logaddexp(0, logit / g) - ya * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _pool(table, put):
    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column(1))
            for lo, hi, d, o in slices(data, off):
                yield put(b, lo, hi, pooled(d, o, table.value))
    return run


def fit(docs: DataFrame, labels: DataFrame, table, label: str, mod: int, remainder: int, sample: int) -> Network:
    picked = labelled_sample(docs, labels, label, mod, remainder, sample).select("y", "text", "_id")

    def put(b, lo, hi, x):
        return pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary()), b.column(2).slice(lo, hi - lo)], names=["y", "x", "id"])

    kind = picked.schema["_id"].dataType.simpleString()
    rows = picked.mapInArrow(_pool(table, put), f"y int, x binary, id {kind}").toArrow()      # at most `sample` rows
    y = rows.column("y").to_numpy().astype(float)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
    order = np.lexsort((x.sum(axis=1), rows.column("id").to_numpy())) if len(y) else np.zeros(0, int)
    return Network(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
                   mod: int = 4, remainder: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, score``. Labels of rows with crc32(id) mod ``mod`` = ``remainder`` are not learnt."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(word_vectors(docs, text_col))          # BUCKETS x DIM floats
    t = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    net = sc.broadcast(fit(t, labels, table, label, mod, remainder, sample))

    def put(b, lo, hi, x):
        return pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(net.value.score(x.astype(float)))], names=["doc_id", "score"])

    return t.mapInArrow(_pool(table, put), t.select("doc_id").schema.add("score", "double")).withColumnRenamed("doc_id", id_col)
