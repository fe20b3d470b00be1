"""Prefix trie against a plain-Python trie of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from nomen.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, conv long, id string, depth int"


def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(0, 40), *range(100, 130), 201, 305, 306, 1000, -7]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "Ünï", "hello there"])))
    out += [(50, None, "user", "x"), (50, None, "system", "x"), (50, 3, "user", "x"), (50, 3, "user", "x"), (50, 3, "assistant", "x"), (None, 1, "user", "lost")]
    out += [(c, t, "user", "same") for c in (60, 61, 62) for t in range(30)]
    return [(*r, 9, "z", 4) for r in out]


def brute(all_rows):
    convs = defaultdict(list)
    for c, t, r, x, *_ in all_rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: [v[2:] for v in sorted(t)] for c, t in convs.items()}
    full = {}
    for c in seqs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(seqs.get(base, [])[:h] + seqs[c][h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in full.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=lambda x: -len(x)):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize(("piece", "parts"), [(pt.PIECE, 7), (4, 5)])
def test_against_all_prefixes(spark, piece, parts):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns, convs = pt.numbered_turns(df)
        got = sorted(tuple(r) for r in pt.prefix_trie(pt.rebuilt(turns, convs), convs, piece).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows())


def test_empty_and_tree(spark):
    turns, convs = pt.numbered_turns(spark.createDataFrame([], SCHEMA))
    assert pt.prefix_trie(pt.rebuilt(turns, convs), convs).count() == 0
    assert sorted(pt.median_order(9)) == list(range(9)) and next(pt.median_order(9)) == 4
    tree = pt.TernaryTree()
    assert tree.insert([5, 6], [1, 1]) == [0, 1, 2] and tree.insert([3], [1]) == [0, 3] and tree.insert([5, 7], [1, 1]) == [0, 1, 4]
    assert (tree.lo[1], tree.hi[2]) == (3, 4)
