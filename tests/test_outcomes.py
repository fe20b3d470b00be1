"""Outcomes of lookups and searches, sections of a search report, registry filter, samples, co-op spellings."""

import os

from pyspark.sql import functions as F

from nomen.functions import names as N
from nomen.operators import match as M
from nomen.operators import owners as O
from nomen.operators import pages as P
from nomen.operators import reports as R
from nomen.plans import pipelines as PL
from nomen.sources import readers as S

RECORD = "owner string, record_id int, company_name string, error string"


def _records(spark, rows):
    empty = [F.lit(None).cast("string").alias(c) for c in ("corporation_number", "registry_type", "status", "address", "business_type", "registration_date")]
    return spark.createDataFrame(rows, RECORD).select("*", *empty)


def test_error_outcome(spark):
    owners = spark.createDataFrame([("ANN LEE",), ("JOHN SMITH",), ("MARY BROWN",), ("ZED QUUX",)], "owner string")
    res = _records(spark, [("ANN LEE", 1, None, "page could not be read"), ("ANN LEE", 2, "LEE ANN INC", None),
                           ("JOHN SMITH", 1, "SMITH JOHN LTD", None), ("JOHN SMITH", 2, None, "late"), ("MARY BROWN", 1, None, None)])
    got = {r.owner: r for r in PL.owner_pipeline(owners, res).collect()}
    assert {o: r.status for o, r in got.items()} == {"ANN LEE": "error", "JOHN SMITH": "scored", "MARY BROWN": "not_parsed", "ZED QUUX": "no_page"}
    assert "\nERROR PROCESSING: ANN LEE\n" + "-" * 80 + "\nError: page could not be read\n" in got["ANN LEE"].entry
    assert "ERROR" not in got["JOHN SMITH"].entry
    # without an error column nothing changes
    plain = {r.owner: r.status for r in PL.owner_pipeline(owners, res.drop("error")).collect()}
    assert plain["ANN LEE"] == "not_parsed" and plain["JOHN SMITH"] == "scored"


def _page(text):
    return f'<p><a href="#v">{text}</a></p><span class="appMinimalValue">Inactive</span><span>Credit Union One</span>'


def test_concurrent_flow(spark):
    owners = spark.createDataFrame([("JOHN SMITH",), ("ANN LEE",), ("MARY BROWN",), ("TOM GREEN",), ("ZED QUUX",), ("ACME LTD",), (None,), ("ANN LEE",),
                                    ("NO RESULT",), ("OLD TIMER",)], "owner string")
    cols = "search_no int, business_name string, html_content string, success boolean, error_message string, search_time double, extra int"
    searches = spark.createDataFrame([
        (1, "JOHN SMITH", _page("SMITH FOODS &amp; JOHN (12)"), True, None, 1.5, 0),
        (2, "ANN LEE", _page("OTHER NAME (13)"), True, None, 1.5, 0),
        (1, "ANN LEE", None, False, "timeout", 1234.5, 0),                       # the first search counts
        (1, "MARY BROWN", "<p>nothing to see</p>", True, None, 2.0, 0),
        (1, "TOM GREEN", '<div><span>GREEN TOM THINGS (99)</span></div>', True, None, 2.0, 0),
        (1, "ACME LTD", _page("ACME LTD (1)"), True, None, 2.0, 0),              # left out by the rule chain
        (1, "NO RESULT", "<p>No results found</p>", True, None, 2.0, 0),
        (1, "OLD TIMER", _page("OLD TIMER (5)"), None, None, None, 0),           # an unknown outcome is a failure
    ], cols)
    got = {r.owner: r for r in PL.owner_pipeline_concurrent(owners, searches, batch=2, lanes=2).collect()}
    assert {o: r.status for o, r in got.items()} == {
        "JOHN SMITH": "scored", "ANN LEE": "search_failed", "MARY BROWN": "not_parsed", "TOM GREEN": "scored", "ZED QUUX": "not_searched",
        "NO RESULT": "scored", "OLD TIMER": "search_failed"}
    assert [(r.n, r.batch, r.batch_pos, r.lane) for r in sorted(got.values(), key=lambda r: r.n)] == [
        (i + 1, i // 2 + 1, i % 2 + 1, i % 2) for i in range(7)]
    j = got["JOHN SMITH"]
    assert (j.company_name, j.corporation_number, j.company_status, j.business_type) == ("SMITH FOODS & JOHN", "12", "Inactive", "Credit Union One")
    assert (j.is_match, j.confidence) == (True, 1.0) and "\nMATCH FOUND: YES\nCONFIDENCE: 100%\nCLOSEST MATCH: SMITH FOODS & JOHN\n" in j.entry
    assert j.entry.count("COMPANY NAME: SMITH FOODS & JOHN\nSTATUS: Inactive\nBUSINESS TYPE: Credit Union One\n") == 2
    assert got["TOM GREEN"].company_status == "Found" and got["TOM GREEN"].confidence == 1.0
    a = got["ANN LEE"]
    assert a.company_name is None and not a.is_match
    assert a.entry.endswith("SEARCH RESULTS FOR: ANN LEE\n" + "-" * 80 + "\nSTATUS: Search failed\nREASON: timeout\nSEARCH TIME: 1234.50 seconds\n" + "-" * 80 + "\n\n")
    assert "REASON: No search result\n" + "-" * 80 in got["ZED QUUX"].entry
    assert (got["NO RESULT"].company_status, got["NO RESULT"].company_name) == ("No Results Found", "NO RESULT")
    # every owner without the rule chain; empty tables
    assert PL.owner_pipeline_concurrent(owners, searches, classify=False).count() == 8
    none = PL.owner_pipeline_concurrent(owners, searches.limit(0))
    assert {r.status for r in none.collect()} == {"not_searched"}
    assert PL.owner_pipeline_concurrent(owners.limit(0), searches).count() == 0


def test_sections_of_a_search_report(spark, tmpdir_path):
    rule = "\n" + "=" * 60 + "\n\n"
    text = ("REPORT" + rule + "SEARCH: a (Co-operative with Share)\n" + "-" * 40 + "\nStatus: ✅ Found\nTime: 1,234.50s\nSaved HTML: a.html\nResults Found: 2\n\n"
            "--- Result #1 ---\nBusiness Name: A1\nStatus: Active\n\n--- Result #2 ---\nBusiness Name: A2\nStatus: Inactive\n\n" + rule
            + "SEARCH: plain label\n" + "-" * 40 + "\nStatus: Error\nTime: 0.00s\nError: search failed\n" + rule
            + "SEARCH: c (t)\n" + "-" * 40 + "\nTime: soon\n--- Result #1 ---\n\n--- Result #2 ---\nBusiness Name: C2\n" + rule)
    p = os.path.join(tmpdir_path, "search.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    want = [("a (Co-operative with Share)", "a", "Co-operative with Share", "Found", 1234.5, "a.html", 2,
             ["Business Name: A1\nStatus: Active", "Business Name: A2\nStatus: Inactive"]),
            ("plain label", None, None, "Error", 0.0, None, None, []),
            ("c (t)", "c", "t", None, None, None, None, ["Business Name: C2"])]
    read = [tuple(r)[1:] for r in S.read_search_sections(spark, p).collect()]
    assert read == want
    mem = R.split_search_sections(spark.createDataFrame([(7, text), (8, ""), (9, None)], "file_no int, value string")).orderBy("section").collect()
    assert [tuple(r)[2:] for r in mem] == want and {r.file_no for r in mem} == {7}
    # small splits give the same sections
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert sorted(map(str, [tuple(r)[1:] for r in S.read_search_sections(spark, p).collect()])) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    blocks = S.read_search_report(spark, p).collect()
    assert [(r.search, r.status, r.block) for r in blocks] == [
        ("a (Co-operative with Share)", "Found", want[0][7][0]), ("a (Co-operative with Share)", "Found", want[0][7][1]), ("c (t)", None, "Business Name: C2")]


def test_registry_predicate_and_samples(spark):
    d = spark.createDataFrame([("A", "Corporation", "Not-for-Profit Corporation", "Active"), ("B", "Business Name", "Not-for-Profit Corporation", "Active"),
                               ("C", None, "Not-for-Profit Corporation", "Active"), ("D", "Corporation", "Other", "Active"),
                               ("E", "Corporation", "Not-for-Profit Corporation", "Inactive")],
                              "company_name string, registry_type string, business_type string, status string")
    types = ["Not-for-Profit Corporation"]
    assert [r.company_name for r in P.filter_registry(d, types, registry="Corporation").collect()] == ["A"]
    assert sorted(r.company_name for r in P.filter_registry(d, types).collect()) == ["A", "B", "C"]
    o = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("c",)], "owner string")
    assert [r.owner for r in O.take_sample(o, 2).collect()] == ["a", "b"]
    assert O.take_sample(o, 0).count() == 0 and O.take_sample(o.limit(0), 3).count() == 0


def test_coop_first(spark):
    names = ["Green Co-op Ltd", "Green Co op", "Green Coop", "Green Co-operative Inc", "Co. Green", "Cooperative of Co", "", None]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r.i: (r.a, r.b) for r in d.select("i", N.normalize_name("n").alias("a"), N.normalize_name("n", coop_first=True).alias("b")).collect()}
    assert [got[i][1] for i in range(8)] == ["green co-op", "green co-op", "green co-op", "green co-op", "green", "co-op of", "", ""]
    assert got[0][0] == "green -op" and got[2][0] == "green co-op"      # by default only solid spellings
    flags = {r.i: r.coop for r in N.with_name_profile(d, "n", coop_first=True).select("i", "coop").collect()}
    assert [flags[i] for i in range(6)] == [True, True, True, True, False, True]


def test_dictionary_substrings_hold_every_term(spark):
    """Against all substrings: none that equals a term is lost, and none is left that begins or ends as no term."""
    words = ["farm", "armada", "xyz", "a-b", "ada"]
    long = ["bigfarmarmada", "xy", "xyz", "q" * 50 + "xyz" + "q" * 50, "a-b-ada", "farmfarm"]
    sp = spark.createDataFrame([(words,), ([],)], "terms array<string>")
    df = spark.createDataFrame([(t, sorted({len(w) for w in words})) for t in long if len(t) > 2], "t string, _lens array<int>")
    got = [(r.t, r.s) for r in M.dictionary_substrings(df, "t", "s", sp).collect()]
    every = [(t, t[i:i + n]) for t in long if len(t) > 2 for n in {len(w) for w in words} for i in range(len(t) - n + 1)]
    assert sorted(x for x in got if x[1] in words) == sorted(x for x in every if x[1] in words)
    starts, ends = {w[:3] for w in words}, {w[-3:] for w in words}
    assert sorted(got) == sorted(x for x in every if x[1][:3] in starts and x[1][-3:] in ends)
