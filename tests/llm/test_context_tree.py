"""Context-tree weighting against a plain-Python model, and its defined cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nomen.llm import context_tree
from nomen.llm._spark import held_out

SCHEMA = "doc_id long, text string, row string, n int, held boolean, block long, score string"
TEXTS = ["abra cadabra abra", "abra cadabra", "", None, " \n\t", "Ünï cödé 漢字 abra", "ABRA Cadabra\x0babra\x1fabra", "zzz", "a", "the river the stone " * 400,
         "abra cadabra abra", "\xa0abra\xa0", "q" * 3000]


def rows():
    out = [(i, t) for i, t in enumerate(TEXTS)] + [(3 * i + 40, f"the stone {i} and the river {i * i}") for i in range(30)]
    return [(*r, "x", 1, True, 7, "s") for r in [*out, out[0], (None, "never learnt words"), (None, None)]]


def is_held(i, mod, rem):
    return i is None or zlib.crc32(str(i).encode()) % mod == rem


def brute(all_rows, depth, mod, rem):
    """{(id, text): (n_tokens, n_known, train_tokens, base, score)}"""
    count, node = Counter(), defaultdict(lambda: [0, 0])

    def tokens(t):
        return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + [None]

    def bits(t):
        s = b"\xff" * depth + t.encode() + b"\xff"
        for i in range(depth, len(s)):
            at = 1
            for k in range(7, -1, -1):
                bit = s[i] >> k & 1
                yield s[i - depth: i], at, bit
                at = at * 2 + bit

    for r in all_rows:
        if not is_held(r[0], mod, rem):
            count.update(tokens(r[1] or ""))
            for ctx, at, bit in bits(r[1] or ""):
                for d in range(depth + 1):
                    node[ctx[depth - d:], at][bit] += 1
    kids = defaultdict(list)
    for ctx, at in node:
        if ctx:
            kids[ctx[1:], at].append((ctx, at))
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted, longer = {}, {}
    for key in sorted(node, key=lambda x: -len(x[0])):
        own = kt(*node[key])
        if len(key[0]) == depth:
            weighted[key] = own
            continue
        longer[key] = sum(weighted[c] for c in kids[key])
        hi, lo = max(own, longer[key]), min(own, longer[key])
        weighted[key] = hi + math.log1p(math.exp(lo - hi)) - math.log(2)

    def p_bit(ctx, at, bit, d, last):
        key = (ctx[depth - d:], at)
        if key not in node:
            return last
        c = node[key]
        own = (c[bit] + .5) / (sum(c) + 1)
        if d == depth:
            return own
        beta = math.exp(min(700, kt(*c) - longer[key]))
        return (beta * own + p_bit(ctx, at, bit, d + 1, own)) / (beta + 1)

    n, v = sum(count.values()), len(count)
    out = {}
    for r in all_rows:
        t = r[1] or ""
        base = sum(math.log10((count[w] + .5) / (n + .5 * (v + 1))) for w in tokens(t))
        out[r[0], r[1]] = (len(tokens(t)), sum(w in count for w in tokens(t)), n, base, sum(math.log10(p_bit(*x, 0, .5)) for x in bits(t)))
    return out


def scored(df, depth=5, block=context_tree.BLOCK, mod=5, rem=1):
    out = context_tree.context_tree_scores(df, held_out("doc_id", mod, rem), carry=[F.col("doc_id"), F.col("text")], depth=depth, block_bytes=block)
    return out.collect()


@pytest.mark.parametrize(("depth", "block"), [(3, 1 << 24), (5, 500)])
def test_against_plain_model(spark, depth, block, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    want = brute(rows(), depth, 5, 1)
    got = scored(df, depth, block)
    assert len(got) == len(rows())
    for r in got:
        w = want[r.row.doc_id, r.row.text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.held_out == is_held(r.row.doc_id, 5, 1)
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=2e-6)


def test_probabilities_sum_to_one(spark):
    """After "ab", the 256 possible next bytes share a probability of one (0xFF ends the text)."""
    import numpy as np

    g = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 400).astype(np.uint64))
    n = np.arange(len(g)) % 3
    every = (np.uint64(0x616263 << 8) | np.arange(256, dtype=np.uint64))
    keys, counts = context_tree.summed(np.concatenate([g, every]), np.concatenate([n, np.arange(256) % 5]))
    t = spark.createDataFrame([(int(np.int64(k)), int(c)) for k, c in zip(keys, counts, strict=True)], "key long, n long")
    out = {r.key: r.value for r in context_tree.gram_log10(t, 3, 8, 4).collect()}
    assert sum(10 ** out[int(k)] for k in every) == pytest.approx(1)


def test_defined_cases(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert scored(df.limit(0)) == []
    # nothing learnt: every bit one half
    got = scored(df, mod=1, rem=0)
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    for r in got:
        assert r.score == pytest.approx(-8 * math.log10(2) * (len((r.row.text or "").encode()) + 1), rel=1e-6)
    with pytest.raises(ValueError):
        scored(df, depth=9)
