"""Randomised agreement between the Spark expressions and the DuckDB brute force."""

import random


from nomen.functions import names as N
from nomen.operators import match as M
from tests import brute

VOCAB = ["acme", "north", "northland", "farms", "the", "and", "of", "société", "éco", "ñas", "zoë",
         "co", "coop", "co-op", "co op", "cooperative", "inc", "inc.", "ltd", "limited", "corp", "p c",
         "professional corporation", "as", "ab", "&", "+", "w/", "o'neil's", "(ontario)", "[old]",
         "-", "--", "alpha-beta", "2020", "x", "mtd", "products", "holdings", "trust", "ßtraße", "a"]


def _names(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 5)
        w = [rnd.choice(VOCAB) for _ in range(k)]
        s = " ".join(w)
        if rnd.random() < 0.3:
            s = s.upper()
        if rnd.random() < 0.2:
            s = "  " + s + " "
        out.append(s)
    return out


def test_profiles_agree(spark):
    names = _names(7, 400)
    df = spark.createDataFrame([(x,) for x in names], "name string")
    want = brute.profiles(names)
    for r in N.with_name_profile(df, "name").collect():
        assert (r.norm, set(r.vars), set(r.terms)) == want[r.name], repr(r.name)


def test_pair_scores_agree(spark):
    a, b = _names(11, 150), _names(12, 150)
    df = spark.createDataFrame(list(zip(a, b)), "s string, c string")
    want = brute.scores(a, b)
    for r in M.score_pairs(df, "s", "c").collect():
        assert r.confidence == want[r.s, r.c], (r.s, r.c)
        assert r.confidence in (0.0, 0.7, 0.85, 0.95)


def test_best_match_random_registry(spark):
    owners = spark.createDataFrame([(x,) for x in _names(21, 120)], "owner string")
    comps = spark.createDataFrame([(x,) for x in _names(22, 120)], "company string")
    got = {r.owner: (r.matched_name, r.confidence) for r in M.best_match(owners, comps, "owner", "company").collect()}
    want = brute.best([r.owner for r in owners.collect()], [r.company for r in comps.collect()])
    assert got == want
