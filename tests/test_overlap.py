"""Many-to-many joins of the concurrent matcher against all pairs, with hot words, short and odd names."""

import random
import re

import pytest

from nomen.operators import overlap as OV

rng = random.Random(8)
WORDS = ["the", "of", "Alpha", "beta", "gamma", "delta", "river", "stone", "ÉTÉ", "x", "ab", "été", "a1", "漢字"]


def name(n):
    return " ".join(rng.choice(WORDS[:2] if rng.random() < .3 else WORDS) for _ in range(n))


OWNERS = [name(rng.randrange(1, 11)) for _ in range(60)] + ["", None, " - ", "x", "ab!", "THE", "the the of", "Q", "nothing shared whatsoever", "the", "the"]
COMPANIES = [name(rng.randrange(1, 9)) + rng.choice(["", " Inc.", " & Co"]) for _ in range(120)] + ["The of", "X", None, "", "a", "The river-stone", "THE RIVER STONE"]


def norm(x):
    return " ".join(re.findall(r"\w+", x.lower()))


def brute(kind):
    out = {}
    for o in {o for o in OWNERS if o is not None and norm(o)}:
        for c in {c for c in COMPANIES if c is not None and norm(c)}:
            a, b = norm(o), norm(c)
            score = 0.0
            if kind != "overlap" and (a in b or b in a):
                score = 1.0
            elif kind != "contains":
                r = len(set(a.split()) & set(b.split())) / len(set(a.split()))
                score = r if r >= 0.7 else 0.0
            if score:
                out[o] = min(out.get(o, (0.0, "")), (-score, c)) if o in out else (-score, c)
    return {o: (c, -s) for o, (s, c) in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame([(o, 1) for o in OWNERS], "owner string, company int").repartition(3),
            spark.createDataFrame([(c, "z") for c in COMPANIES], "company_name string, norm string").repartition(3))


@pytest.mark.parametrize("hot", [None, 3])
def test_joins_against_all_pairs(tables, hot):
    for kind, join in (("overlap", OV.best_overlap), ("contains", OV.best_containment)):
        got = {r.owner: (r.matched_name, r.confidence) for r in join(*tables, min_hot_rows=hot).collect()}
        assert got == brute(kind), kind


def test_whole_rule(tables):
    rows = OV.best_match_overlap(*tables).collect()
    want = brute("both")
    assert len(rows) == len(set(OWNERS))
    for r in rows:
        assert (r.matched_name, r.confidence, r.is_match) == (*want.get(r.owner, (None, 0.0)), r.owner in want)


def test_empty_tables(tables):
    o, c = tables
    assert OV.best_overlap(o, c.limit(0)).count() == OV.best_containment(o.limit(0), c).count() == 0


def test_frequent_words_are_keys_only_without_rarer_ones(tables, spark):
    """An owner of five words is looked for by its two rarest."""
    o = spark.createDataFrame([("the of alpha beta gamma",)], "owner string")
    c = spark.createDataFrame([(f"the of {w}",) for w in "abcdefgh"] + [("the of alpha beta",), ("alpha beta gamma the",), ("gamma",)], "company_name string")
    assert OV.best_overlap(o, c).collect()[0].asDict() == {"owner": "the of alpha beta gamma", "matched_name": "alpha beta gamma the", "confidence": 0.8}
