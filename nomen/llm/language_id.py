"""Language identification by language-bitmask n-gram filters (bit-sliced Bloom filters).

One Bloom filter per language, stored bit-sliced: slot i of the table is a word whose bit l is slot i of
language l's filter. The ``HASHES`` slots of an n-gram, ANDed, give all languages that contain it at
once. A text counts per language the n-grams with its bit set; with n n-grams, h hits and a
filter whose false-positive rate is f (its fill to the power ``HASHES``), (h/n - f) / (1 - f) estimates
the share of n-grams the language really has. The largest share decides.

A language's filter holds the n-grams (``GRAM`` bytes of the text, A-Z lower-cased, other ASCII
characters but letters as one space) whose relative frequency in that language is at least ``SHARE`` of the
greatest over all languages, so that stray foreign words do not count. Counts cover all documents that
may be learnt from. The table has ``SLOTS`` words per 62 languages whatever the input: that bounds what is
broadcast; a fuller filter raises f, which is corrected for.

Defined cases: a null text or one without letters is ``und`` with score 0; if no language
can be learnt all are; a text whose n-grams no filter holds gets the language with most learnt n-grams, score 0;
equal shares go to the language first in order; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col
from nomen.llm._text import mix64, slices, text_buffers

GRAM = 4
SLOTS = 1 << 20
HASHES = 3
SHARE = 0.1
LANGS_PER_WORD = 62
UNKNOWN = "und"

FOLD = np.full(256, 32, np.uint8)
for _c in [*range(97, 123), *range(128, 256)]:
    FOLD[_c] = _c
FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram as an integer) of a slice; n-grams with two spaces in a row are left out."""
    x = FOLD[data]
    if len(x) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    n = len(x) - GRAM + 1
    g = np.zeros(n, np.uint64)
    ok = row[:n] == row[GRAM - 1:]
    for i in range(GRAM):
        g = g << np.uint64(8) | x[i: i + n]
        if i:
            ok &= (x[i: i + n] != 32) | (x[i - 1: i - 1 + n] != 32)
    at = np.flatnonzero(ok)
    return row[at], g[at]


def slots(g: np.ndarray) -> list[np.ndarray]:
    h = mix64(g + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(21 * i)) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


def _count(langs: list[str]):
    index = {v: i for i, v in enumerate(langs)}

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column(0))
            lang = np.array([index.get(v, -1) for v in b.column(1).to_pylist()], np.int64)
            held: dict = {}
            for lo, hi, d, o in slices(data, off, 1 << 22):
                row, g = grams(d, o)
                key = lang[lo: hi][row].astype(np.uint64) << np.uint64(32) | g
                if len(key):
                    keys, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                                                      pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
    return run


def learn_filters(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, bit-sliced table (SLOTS, words), n-grams learnt per language) from all rows of ``docs``."""
    spark = docs.sparkSession
    t = docs.select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    langs = sorted(r[0] for r in t.select("lang").distinct().collect())   # one value per language
    words = max(1, -(-len(langs) // LANGS_PER_WORD))
    table = np.zeros((SLOTS, words), np.uint64)
    if not langs:
        return langs, table, np.zeros(0)
    counts = (t.mapInArrow(_count(langs), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    per = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("l"))   # at most one entry per language
    totals = {r["lang"]: r["n"] for r in t.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    scale = F.array(*[F.lit(1.0 / max(1, totals[x])) for x in langs])
    per = per.select("gram", F.transform("l", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] * F.element_at(scale, x["lang"] + 1)).alias("f"))).alias("l"))
    per = per.withColumn("most", F.array_max(F.transform("l", lambda x: x["f"])))
    per = per.select("gram", F.transform(F.filter("l", lambda x: x["f"] >= SHARE * F.col("most")), lambda x: x["lang"]).alias("l"))

    def word(k: int) -> Column:
        mine = F.filter(F.col("l"), lambda x: F.floor(x / LANGS_PER_WORD) == k)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(LANGS_PER_WORD)))))

    masks = per.select("gram", *[word(k).alias(f"w{k}") for k in range(words)])

    def place(batches):
        for b in batches:
            s = slots(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            for x in s:
                yield pa.RecordBatch.from_arrays([pa.array(x), *b.columns[1:]], names=["slot", *b.schema.names[1:]])

    kinds = ", ".join(f"w{k} long" for k in range(words))
    sliced = masks.mapInArrow(place, f"slot long, {kinds}").groupBy("slot").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(words)])
    got = sliced.toArrow()      # at most SLOTS rows
    at = got.column(0).to_numpy()
    for k in range(words):
        table[at, k] = got.column(k + 1).to_numpy().astype(np.uint64)
    return langs, table, np.array([totals[x] for x in langs], float)


def identify(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, lang_pred, score``; filters are learnt from ``learn``."""
    langs, table, size = learn_filters(learn, text_col, lang_col)
    n = len(langs)
    fill = np.array([np.mean((table[:, i // LANGS_PER_WORD] >> np.uint64(i % LANGS_PER_WORD)) & np.uint64(1)) for i in range(n)])
    false = np.minimum(fill ** HASHES, 0.999)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    usual = int(size.argmax()) if n else -1
    t = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))

    def run(batches):
        filters = shared.value
        for b in batches:
            data, off = text_buffers(b.column(1))
            for lo, hi, d, o in slices(data, off):
                m = hi - lo
                hits, total = np.zeros((m, n)), np.zeros(m)
                row, g = grams(d, o)
                if len(g) and n:
                    total = np.bincount(row, minlength=m).astype(float)
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    places = slots(g)
                    for w in range(filters.shape[1]):
                        col_w = filters[:, w]
                        mask = col_w[places[0]]
                        for p in places[1:]:
                            mask &= col_w[p]
                        for i in range(w * LANGS_PER_WORD, min(n, (w + 1) * LANGS_PER_WORD)):
                            bit = ((mask >> np.uint64(i % LANGS_PER_WORD)) & np.uint64(1)).astype(np.int64)
                            hits[row[first], i] = np.add.reduceat(bit, first)
                share = np.maximum(0, (hits / np.maximum(total, 1)[:, None] - false) / (1 - false))
                total_share = share.sum(axis=1)
                low = FOLD[d]
                ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low < 123))])
                letters = ascii_letter[o[1:]] > ascii_letter[o[:-1]]
                raw = None
                pred, score = [], []
                for r in range(m):
                    if not letters[r]:
                        raw = raw if raw is not None else d.tobytes()
                        letters[r] = any(c.isalpha() for c in raw[o[r]: o[r + 1]].decode())
                    if not letters[r] or not n:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                    elif total_share[r] <= 0:
                        pred.append(langs[usual])
                        score.append(0.0)
                    else:
                        best = int(share[r].argmax())
                        pred.append(langs[best])
                        score.append(float(share[r, best] / total_share[r]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, m), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    schema = t.select("id").schema.add("lang_pred", "string").add("score", "double")
    return t.mapInArrow(run, schema).withColumnRenamed("id", id_col)
