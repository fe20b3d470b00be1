"""Steps whose time or memory must not grow faster than the tables: what they hold and sort, and their results."""

import random

import pytest
from pyspark.sql import functions as F

from nomen.operators import overlap as OV
from nomen.operators import pages as P
from nomen.operators import stats as ST
from nomen.operators import tree as E
from nomen.operators import udf as U
from tests.test_tree import stdlib
from tests.test_windows_stream import _walk


def _shape(node):
    return node[0], set(node[1]), [c if isinstance(c, str) else _shape(c) for c in node[2]]


def test_plain_pages_are_read_without_the_parser(monkeypatch):
    rng = random.Random(3)
    bits = ['<div class="a b">', "</div>", "<span>", "</span>", '<b class="x" class="y">', "</b>", "<br>", "</br>", "<title>", "</title>",
            " t ", "&amp;", "&#69;x", "x > y", "&", "<img>", "<a href='q'>", "<!-- c -->", "<P>", "<!DOCTYPE html>", "1 < 2", "<script>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(10))) for _ in range(3000)]
    for h in pages:
        assert _shape(U._root(h)) == _shape(stdlib(h)), h
    block = f'<div class="{P.BLOCK_CLASS}"><div class="{" ".join(P.STATUS_CLASSES)}"><span class="{P.VALUE_CLASS}">Act&#105;ve <b>now</b></span></div></div>'
    want = U.parse_business_details("s", "<p x=1>" + block * 2)
    monkeypatch.setattr(U, "_Tree", None)
    assert U.parse_business_details("s", block * 2) == want and [r["status"] for r in want] == ["Activenow"] * 2


@pytest.mark.parametrize("bits", [1, 4])
def test_prefix_ranges_are_bounded(spark, monkeypatch, bits):
    kept = {}

    def keep(df, name):
        kept[name] = df = df.localCheckpoint()
        return df
    monkeypatch.setattr(ST, "materialize", keep)
    monkeypatch.setattr(ST, "RANGE_BITS", bits)
    rng = random.Random(bits)
    names = [(rng.choice(["x", None]), "".join(rng.choice("aab") for _ in range(rng.randrange(1, 7)))) for _ in range(200)]
    got = {(r.kind, r.prefix, r.depth): r.n_names for r in ST.prefix_partition(spark.createDataFrame(names, "kind string, name string").coalesce(1), "name", ["kind"], cap=5).collect()}
    assert got == _walk(names, 5)
    assert kept["prefix-ranges"].groupBy("_part").count().agg(F.max("count")).first()[0] <= 2 ** bits


def _names(spark):
    o = spark.createDataFrame([("big red ring",), ("blue",), ("a b c d old ring ltd x",), ("x",)], "owner string")
    c = spark.createDataFrame([("Big Red Ring Inc",), ("A Big Red Ring",), ("old ring",), ("b c",), ("c e d",), (None,)], "company_name string")
    return o, c


def test_best_companies_are_kept_without_sorting_pairs(spark):
    o, c = _names(spark)
    for best, want in ((OV.best_overlap, {"big red ring": "A Big Red Ring"}),
                       (OV.best_containment, {"big red ring": "A Big Red Ring", "a b c d old ring ltd x": "b c"})):
        df = best(o, c)
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.owner: r.matched_name for r in df.collect()} == want


def test_needles_with_unknown_inner_words_are_not_cut(spark):
    needles = spark.createDataFrame([("a b c",), ("d red ring x",), ("q",), ("q z",)], "needle string")
    hays = spark.createDataFrame([("old red ring",)], "hay string")
    assert {r.needle for r in OV._known_words(needles, hays).collect()} == {"d red ring x", "q", "q z"}


def test_names_are_normalised_once_for_both_rules(spark, monkeypatch):
    calls = []
    forms = OV._forms
    monkeypatch.setattr(OV, "_forms", lambda *a: calls.append(a) or forms(*a))
    o, c = _names(spark)
    got = {r.owner: (r.matched_name, r.tier) for r in OV.best_match_overlap(o, c).collect()}
    assert len(calls) == 2 and got["big red ring"] == ("A Big Red Ring", "contains") and got["blue"] == (None, "none")


def test_slices_make_their_array_once():
    text = str(E.inside(F.col("part")))
    assert text.count("part") == 1
