"""Toxicity: noisy-channel deobfuscation by Viterbi decoding, then a classifier on the restored text.

**Lattice.** A word written with look-alike signs (``1d10t``), with a letter once more than needed (``stuupid``) or
cut by separators (``l o s e r``, ``l.o.s.e.r``, ``lo ser``, ``id.iot``) is a lattice: a sign may stand for its look-alike
letters or for nothing, a repeated letter for itself or for nothing, a separator for nothing or for a word edge. Each
arc has a channel cost. Three or more single letters in a row are decoded as one run; so are neighbours of which one has at
most ``SHORT`` letters, if the language model reads them better joined.

**Language model.** Letter n-grams of up to ``ORDER`` letters within words (a-z, one class for all other letters, and
the word edge), counted over all documents by a Spark aggregation; the counts grow with the n-grams met, up to
``CLASSES ** ORDER``. Each order backs off to the next lower one (Witten-Bell). Viterbi finds the cheapest reading of each suspicious
span; words without such signs have one reading and skip the decoder. Spans are decoded together in numpy, once per distinct span.

**Score.** Restored words, and their first ``STEM`` letters, fall into ``BUCKETS`` hash buckets. A bucket's smoothed
log-odds of toxic documents come from a bounded labelled sample (at most ``SAMPLE`` documents); a logistic
calibrator on a document's highest log-odds, fitted across folds of the sample, gives the probability.

Defined cases: a null or empty text has no words and gets the calibrator's score for that; without labels of both
kinds the score is the smoothed share of label 1; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, labelled_sample
from nomen.llm._text import prefix_hash, ragged, slices, span_hash, text_buffers, word_spans

BUCKETS = 1 << 18
STEM = 4
SAMPLE = 8000
PRIOR = 5.0          # documents by which the counts of a bucket are smoothed
CACHE = 200_000

# fixed values: signs and the letters they are used for
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
COST_SIGN = 1.0      # a sign for its letter
COST_DROP = 5.0      # a sign for nothing ...
COST_END = 1.0       # ... or one after the last letter or digit of a word: punctuation
COST_REPEAT = 0.7    # a letter again for nothing, where it stands three times or more ...
COST_DOUBLE = 9.0    # ... or just twice: most doubled letters are meant, also in words that the model does not know
COST_WORD = 1.0      # a separator between single letters for a word edge (for nothing: free)
COST_JOIN = 4.0      # any other separator for nothing (for a word edge: free)
SHORT = 4            # letters of the shorter of two neighbours that may be one word

EDGE, OTHER, CLASSES = 0, 27, 28
ORDER = 5
CONTEXTS = CLASSES ** (ORDER - 1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = np.arange(97, 123)
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = OTHER
SIGN = np.zeros(256, bool)
for _c in LOOKS_LIKE:
    SIGN[ord(_c)] = True


# ---------------------------------------------------------------- language model

def _contexts(c: np.ndarray) -> np.ndarray:
    """For each class, the code of the ``ORDER - 1`` classes before it, back to the last word edge."""
    out = np.zeros(len(c), np.int64)
    open_ = np.ones(len(c), bool)
    for k in range(1, ORDER):
        before = np.zeros(len(c), np.int64)
        before[k:] = c[:-k]
        open_ &= before != EDGE
        out += np.where(open_, before, 0) * CLASSES ** (k - 1)
    return out


def _ngrams(batches):
    codes, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merged():
        at, back = np.unique(np.concatenate([codes, *(x for x, _ in waiting)]), return_inverse=True)
        return at, np.bincount(back, np.concatenate([counts, *(n for _, n in waiting)]), len(at)).astype(np.int64)

    for b in batches:
        for _, _, d, o in slices(*text_buffers(b.column(0))):
            edge = np.zeros(len(d) + 1, bool)          # texts do not run on into each other
            edge[o] = True
            c = np.insert(CLASS[d], np.flatnonzero(edge), EDGE)
            c = c[np.insert((d & 0xC0) != 0x80, np.flatnonzero(edge), True)]
            c = np.concatenate([[EDGE], c, [EDGE]])
            c = c[np.concatenate([[True], (c[1:] != EDGE) | (c[:-1] != EDGE)])]
            waiting.append(np.unique((_contexts(c) * CLASSES + c)[1:], return_counts=True))
            if len(waiting) == 8:
                (codes, counts), waiting = merged(), []
    codes, counts = merged()
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["gram", "n"])


class LetterModel:
    """Costs -log P(class | context) from n-gram counts; the table is worked out where it is first used."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts, self._costs = codes.astype(np.int32), counts, None

    def __getstate__(self):
        return {**self.__dict__, "_costs": None}

    @property
    def costs(self) -> np.ndarray:
        if self._costs is None:
            p = np.full(CLASSES, 1 / CLASSES, np.float32)
            for k in range(1, ORDER + 1):
                size = CLASSES ** k
                code, back = np.unique(self.codes % size, return_inverse=True)
                n = np.bincount(back, self.counts, len(code))
                total = np.bincount(code // CLASSES, n, size // CLASSES).astype(np.float32)
                kinds = np.bincount(code // CLASSES, minlength=size // CLASSES).astype(np.float32)
                kinds[total == 0] = 1                      # a context not met: all from the shorter one
                p = (np.tile(p, CLASSES) if k > 1 else p).reshape(-1, CLASSES)
                p *= kinds[:, None]
                p.reshape(-1)[code] += n
                p /= (total + kinds)[:, None]
                p = p.reshape(-1)
            np.log(p, out=p)
            self._costs = np.negative(p, out=p)
        return self._costs


def letter_model(docs: DataFrame, text_col: str = "text") -> LetterModel:
    """Letter n-grams of all documents."""
    t = (docs.select(col(text_col).alias("t")).mapInArrow(_ngrams, "gram long, n long")
         .groupBy("gram").agg(F.sum("n").alias("n")).toArrow())      # at most CLASSES ** ORDER rows
    return LetterModel(t["gram"].to_numpy(), t["n"].to_numpy())


# ---------------------------------------------------------------- decoder

def _arcs(word: str) -> list[tuple[list[int], float, float, float]]:
    """Per character: (classes it may stand for, cost of that, cost of standing for nothing, cost of a word edge)."""
    out, before = [], ""
    # signs after the last letter or digit of a word, or of the span where they stand alone
    trailing, at = [False] * len(word), max((i for i, c in enumerate(word) if c.isalnum()), default=-1) + 1
    for m in re.finditer(r"[^\s]+", word):
        end = max((i for i in range(m.start(), m.end()) if word[i].isalnum()), default=max(m.start(), at) - 1)
        trailing[end + 1: m.end()] = [True] * max(0, m.end() - end - 1)
    solid = [c.isalnum() or ord(c) >= 128 or c in LOOKS_LIKE for c in word]
    alone = [x and not (i and solid[i - 1]) and not (i + 1 < len(word) and solid[i + 1]) for i, x in enumerate(solid)]
    last = -1                                              # the letter or sign before
    after = [-1] * (len(word) + 1)                         # the one after
    for i in range(len(word) - 1, -1, -1):
        after[i] = i if solid[i] else after[i + 1]
    for i, c in enumerate(word):
        again = np.inf if c != before else COST_REPEAT if c in (word[i - 2: i - 1], word[i + 1: i + 2]) else COST_DOUBLE
        if "a" <= c <= "z":
            out.append(([CLASS[ord(c)]], 0.0, again, np.inf))
        elif c in LOOKS_LIKE:
            out.append(([CLASS[ord(x)] for x in LOOKS_LIKE[c]], COST_SIGN, COST_END if trailing[i] else COST_DROP, np.inf))
        elif ord(c) >= 128:
            out.append(([OTHER], 0.0, again, np.inf))
        elif i and not solid[i - 1]:                       # more of the same separator
            out.append(([], 0.0, 0.0, np.inf))
        elif last >= 0 and after[i] >= 0 and alone[last] and alone[after[i]]:
            out.append(([], 0.0, 0.0, COST_WORD))
        else:
            out.append(([], 0.0, COST_JOIN if last >= 0 and after[i] >= 0 else 0.0, 0.0))
        before = c
        if solid[i]:
            last = i
    return out


def viterbi(words: list[str], model: LetterModel) -> list[str]:
    """Cheapest readings of lower-case spans; words are parted by one blank."""
    done: list[str] = [""] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        width = len(words[order[at]])
        size = max(1, min(4000, (1 << 17) // max(1, 2 * width)))
        part = [i for i in order[at: at + size] if len(words[i]) <= 2 * width + 8]
        at += len(part)
        for i, w in zip(part, _viterbi([words[i] for i in part], model.costs), strict=True):
            done[i] = w
    return done


def _viterbi(words: list[str], costs: np.ndarray) -> list[str]:
    n, t_max = len(words), max(map(len, words))
    emit = np.full((2, n, t_max), -1, np.int64)            # up to two letters per character
    cost = np.zeros((n, t_max))
    skip = np.zeros((n, t_max))                            # past the end: nothing, free
    edge = np.full((n, t_max), np.inf)
    for i, w in enumerate(words):
        for t, (letters, c, drop, cut) in enumerate(_arcs(w)):
            for k, x in enumerate(letters):
                emit[k, i, t] = x
            cost[i, t], skip[i, t], edge[i, t] = c, drop, cut
    # the cheapest reading up to here per span and context, in order of both
    who, ctx, score = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    back = []                                              # per character: (reading before, class; -1: nothing)
    for t in range(t_max):
        parts = []
        at = np.flatnonzero(np.isfinite(skip[who, t]))
        parts.append((at, ctx[at], score[at] + skip[who[at], t], np.full(len(at), -1, np.int64)))
        for k in range(2):
            at = np.flatnonzero(emit[k, who, t] >= 0)
            if len(at):
                e = emit[k, who[at], t]
                g = ctx[at] * CLASSES + e
                parts.append((at, g % CONTEXTS, score[at] + cost[who[at], t] + costs[g], e))
        at = np.flatnonzero(np.isfinite(edge[who, t]))
        if len(at):
            closing = np.where(ctx[at] > 0, costs[ctx[at] * CLASSES + EDGE], 0.0)
            parts.append((at, np.zeros(len(at), np.int64), score[at] + edge[who[at], t] + closing, np.full(len(at), EDGE)))
        at, ctx, score, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        who = who[at]
        order = np.lexsort((score, who * CONTEXTS + ctx))
        key = (who * CONTEXTS + ctx)[order]
        order = order[np.concatenate([[True], key[1:] != key[:-1]])]
        who, ctx, score = who[order], ctx[order], score[order]
        back.append((at[order], e[order]))
    score = score + np.where(ctx > 0, costs[ctx * CLASSES + EDGE], 0.0)
    order = np.lexsort((score, who))
    state = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])]
    kept = np.zeros((n, t_max), np.int64)
    for t in range(t_max - 1, -1, -1):
        kept[:, t] = back[t][1][state]
        state = back[t][0][state]
    return [" ".join("".join(" " if k == EDGE else chr(96 + k) if k < OTHER else c for c, k in zip(w, row, strict=False) if k >= 0).split(" ")).strip()
            for w, row in zip(words, kept.tolist(), strict=True)]


class Restorer:
    """Finds suspicious spans of a slice and keeps the readings of those it has met."""

    def __init__(self, model: LetterModel):
        self.model, self.known = model, {}

    def read(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(dict.fromkeys(words))
        for w, v in zip(new, viterbi([w.decode(errors="replace") for w in new], self.model), strict=True):
            self.known[w] = v.encode()
        return [self.known[w] for w in words]

    def joins(self, d: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Pairs (last byte of one, first byte of the next) of letter runs that the model reads better as one word."""
        at = np.flatnonzero((CLASS[d] > 0) & ((d & 0xC0) != 0x80))
        if len(at) < 2:
            return np.zeros((0, 2), np.int64)
        c = CLASS[d[at]]
        letter = (CLASS[d] > 0).astype(np.int64)
        gap = np.concatenate([[0], np.cumsum(1 - letter)])
        inside = gap[at[1:]] == gap[at[:-1]]
        text = np.searchsorted(o, at, "right")
        inside &= text[1:] == text[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~inside]))
        size = np.diff(np.concatenate([first, [len(at)]]))
        # one edge before each run, so that contexts end there
        spread = np.insert(c, first, EDGE)
        ctx = _contexts(spread)[np.arange(len(at)) + np.repeat(np.arange(len(first)) + 1, size)]
        sign = np.concatenate([[0], np.cumsum(SIGN[d])])
        a, b = first[1:] - 1, first[1:]                    # last letter before, first letter after
        ok = ((text[a] == text[b]) & (np.minimum(size[:-1], size[1:]) <= SHORT) & (sign[at[b]] == sign[at[a]])
              & (gap[at[b]] - gap[at[a]] <= 3))
        a, b, left = a[ok], b[ok], size[1:][ok]
        costs, joined = self.model.costs, (ctx[a] * CLASSES + c[a]) % CONTEXTS
        gain = costs[joined * CLASSES + EDGE].astype(float)     # of the word edge, then of what follows it
        for k in range(ORDER - 1):
            has = np.flatnonzero(left > k)
            x = c[b[has] + k]
            g = joined[has] * CLASSES + x
            gain[has] += costs[ctx[b[has] + k] * CLASSES + x] - costs[g]
            joined[has] = g % CONTEXTS
        better = gain > COST_JOIN
        return np.stack([at[a[better]], at[b[better]]], axis=1)

    def spans(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row, whether only joining is in question) of the suspicious spans of a slice of lower-case bytes."""
        s, e, row = word_spans(d, o)
        if not len(s):
            return s, e, row, np.zeros(0, bool)
        cls = CLASS[d]
        ascii_letter, letter = (cls > 0) & (cls < OTHER), cls > 0
        run = np.zeros(len(d), bool)
        run[1:] = letter[1:] & (d[1:] == d[:-1]) & (d[1:] < 128)
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        n_letter, n_sign, n_run, n_first = (np.concatenate([[0], np.cumsum(x)]) for x in (ascii_letter, SIGN[d], run, first))
        per = lambda c: c[e] - c[s]
        letters, signs, runs, parts = per(n_letter), per(n_sign), np.where(e - s > 1, n_run[e] - n_run[np.minimum(s + 1, e)], 0), per(n_first)
        odd = ((letters > 0) & (signs > 0)) | (runs > 0) | ((letters >= 3) & (letters == parts) & (letters < e - s) & (letters * 2 - 1 <= e - s))
        single = (letters + signs >= 1) & (e - s <= 2) & ((letters == 1) | ((e - s == 1) & (signs == 1))) & ~((e - s == 2) & (letters + signs > 1))
        # three or more single letters in a row of one document, and neighbours better joined: one span
        grp = np.cumsum(np.concatenate([[True], ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))]))
        start = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        size = np.diff(np.concatenate([start, [len(s)]]))
        spaced = np.repeat(size >= 3, size)
        linked = np.zeros(len(s), bool)                    # with the word before
        linked[1:] = spaced[1:] & spaced[:-1] & (grp[1:] == grp[:-1])
        pairs = np.searchsorted(s, self.joins(d, o), "right") - 1
        linked[pairs[pairs[:, 0] < pairs[:, 1], 1]] = True
        asked = spaced | odd
        cut = asked | linked
        cut[pairs.ravel()] = True
        begin = np.flatnonzero(~linked)
        any_of = lambda x: np.logical_or.reduceat(x, begin)
        take = np.flatnonzero(any_of(cut))
        end = np.concatenate([begin[1:], [len(s)]]) - 1
        return s[begin[take]], e[end[take]], row[begin[take]], ~any_of(asked)[take]

    def tokens(self, data: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of the restored words and stems of a slice, once per row each. Words that were only joined
        count as written, too."""
        d = FOLD[data]
        s, e, row, joined = self.spans(d, o)
        raw = d.tobytes()
        restored = self.read([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        plain = d.copy()
        plain[ragged(s[~joined], (e - s)[~joined])] = 32
        plain[CLASS[plain] == 0] = 32
        size = np.array([w.count(b" ") + 1 if w else 0 for w in restored], np.int64)
        extra = np.frombuffer(b" ".join(restored), np.uint8) if restored else np.zeros(0, np.uint8)
        rows, keys = [], []
        for x, off, who in ((plain, o, None), (extra, np.array([0, len(extra)]), np.repeat(row, size))):
            if not len(x):
                continue
            ws, we, wr = word_spans(x, off)
            if not len(ws):
                continue
            h = prefix_hash(x)
            who = wr if who is None else who
            rows += [who, who]
            keys += [span_hash(h, ws, we), span_hash(h, ws, np.minimum(we, ws + STEM)) + np.uint64(1)]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(rows) * BUCKETS + (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64))
        return both // BUCKETS, both % BUCKETS


def restore(text: str, model: LetterModel) -> str:
    """The text in lower case with suspicious spans replaced by their readings."""
    raw = np.frombuffer(text.encode(), np.uint8)
    d = FOLD[raw]
    r = Restorer(model)
    s, e, *_ = r.spans(d, np.array([0, len(d)]))
    out, at, body = [], 0, d.tobytes()
    for a, b in sorted(zip(s.tolist(), e.tolist(), strict=True)):
        out += [body[at:a], r.read([body[a:b]])[0]]
        at = b
    return b"".join([*out, body[at:]]).decode()


# ---------------------------------------------------------------- classifier

TOP = 3
FOLDS = 4
CLEAR = 2.0


def features(row: np.ndarray, odds: np.ndarray, m: int) -> np.ndarray:
    """Per row: highest log-odds, mean of the ``TOP`` highest, log count and share of clearly toxic buckets."""
    x = np.zeros((m, 4))
    n = np.maximum(np.bincount(row, minlength=m), 1)
    order = np.lexsort((-odds, row))
    row, odds = row[order], odds[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
    x[row[first], 0] = odds[first]
    top = place < TOP
    x[:, 1] = np.bincount(row[top], odds[top], m) / TOP
    clear = np.bincount(row[odds > CLEAR], minlength=m)
    x[:, 2], x[:, 3] = np.log1p(clear), clear / n * 10
    return x


class Classifier:
    def __init__(self, docs: list[tuple[int, np.ndarray]]):
        y = np.array([v for v, _ in docs], float)
        self.prior = (y.sum() + 1.0) / (len(y) + 2.0)
        fold = np.arange(len(y)) % FOLDS
        self.fitted = all(0 < y[fold != f].sum() < (fold != f).sum() for f in range(FOLDS))
        if not self.fitted:
            return
        # the calibrator sees each document with log-odds that the other folds gave
        x = np.zeros((len(y), 4))
        for f in range(FOLDS):
            odds = self._odds([docs[i] for i in np.flatnonzero(fold != f)])
            for i in np.flatnonzero(fold == f):
                b = docs[i][1]
                x[i] = features(np.zeros(len(b), np.int64), odds[b], 1)[0]
        self.weights = self._logistic(x, y)
        self.odds = self._odds(docs).astype(np.float32)

    @staticmethod
    def _odds(docs) -> np.ndarray:
        n = [np.full(BUCKETS, 0.0), np.full(BUCKETS, 0.0)]
        size = [0, 0]
        for y, b in docs:
            np.add.at(n[int(y)], b, 1.0)
            size[int(y)] += 1
        part = [PRIOR * k / sum(size) for k in size]      # a bucket not seen has log-odds 0, a rare one little
        return np.log((n[1] + part[1]) / size[1]) - np.log((n[0] + part[0]) / size[0])

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
        z = np.column_stack([x, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.diag([ridge] * x.shape[1] + [0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + penalty @ w
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-6 * np.eye(len(w)), grad)
            step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def score(self, row: np.ndarray, bucket: np.ndarray, m: int) -> np.ndarray:
        if not self.fitted:
            return np.full(m, self.prior)
        x = features(row, self.odds[bucket].astype(float), m)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(m)]) @ self.weights, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
                    mod: int = 3, remainder: int = 1, sample: int = SAMPLE, carry=None) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, score``; with ``carry``, also ``text`` and the struct ``row`` of those columns. Labels of rows with crc32(id) mod ``mod`` =
    ``remainder`` are not learnt."""
    sc = docs.sparkSession.sparkContext
    letters = sc.broadcast(letter_model(docs, text_col))
    t = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    picked = labelled_sample(t, labels, label, mod, remainder, sample)

    def learn(batches):
        r = Restorer(letters.value)
        for b in batches:
            for lo, hi, d, o in slices(*text_buffers(b.column("text"))):
                row, bucket = r.tokens(d, o)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo),
                                                  pa.array([bucket[a:e].astype(np.int32).tobytes() for a, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["_id", "y", "b"])

    kind = picked.schema["_id"].dataType.simpleString()
    rows = picked.select("_id", "y", "text").mapInArrow(learn, f"_id {kind}, y int, b binary").toArrow().to_pylist()    # at most `sample` rows
    rows.sort(key=lambda r: r["_id"])
    rng = np.random.default_rng(3)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    model = sc.broadcast(Classifier([(r["y"], np.frombuffer(r["b"], np.int32)) for r in rows]))

    wide = carry is not None
    carried = docs.select(col(id_col).alias("doc_id"), *([F.struct(*(carry or [F.lit(True).alias("_")])).alias("row")] if wide else []), col(text_col).alias("text"))
    names = carried.columns if wide else ["doc_id"]

    def run(batches):
        r = Restorer(letters.value)
        for b in batches:
            for lo, hi, d, o in slices(*text_buffers(b.column("text"))):
                row, bucket = r.tokens(d, o)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in names), pa.array(model.value.score(row, bucket, hi - lo))], names=[*names, "score"])

    return carried.mapInArrow(run, carried.select(names).schema.add("score", "double")).withColumnRenamed("doc_id", id_col)
