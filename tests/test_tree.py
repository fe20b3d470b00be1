"""The element tree against the standard library's parser, and the page flows built on it."""

import random
import re

from pyspark.sql import functions as F

from nomen.operators import pages as P
from nomen.operators import tree as E
from nomen.operators import udf as U

ODD = [
    "<DIV CLASS='registerItemSearch-results-page-line x'><div class=\"appMinimalAttr Status\"><SPAN class='appMinimalValue'>Active</SPAN></div>"
    "<div class=addressSearchResultBox><div class='appAttrValue'>1 Main <b>St</b></div></div></DIV>",
    '<div class="registerItemSearch-results-page-line"><div class="appMinimalAttr Status"><span class="appMinimalValue">Act<i>ive</span></div>'
    '<p>open<div class="registerItemSearch-results-page-line"><div class="addressSearchResultBox"><div class="appAttrValue">Nested &amp; odd</div></b></div></div></div>tail',
    '<p>No results found</p>', "", None, "plain text", "a < b <div title='x > y' class='registerItemSearch-results-page-line'>z</div>",
    '<script>if (a < "<div class=registerItemSearch-results-page-line>") {}</script><!-- <div class="registerItemSearch-results-page-line"> -->',
    '<br/><div class="registerItemSearch-results-page-line"><div class="appMinimalAttr Status"/><span class="appMinimalValue">no</span></div>',
]


def random_pages(n):
    rng = random.Random(6)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            tag = rng.choice(["div", "p", "b", "DIV", "span", "a", "li"])
            parts.append(rng.choice([f"<{tag}>", f"<{tag} class='x y'>", f'<{tag} class="y" title="<q>">', f"</{tag}>", f"</{tag} >", "<br>", " t ", "&amp;u", "w  v", "<img src=a/>"]))
        out.append("".join(parts))
    return out


def stdlib(html):
    p = U._Tree()
    p.feed(html)
    p.close()
    return p.root


def test_tree_equals_the_standard_parser(spark):
    pages = random_pages(150) + [x for x in ODD if x]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, html string").select("i", E.elements("html").alias("n"))
    any_tag = E.sel()
    rows = df.select("i", F.transform(E.each(F.col("n"), any_tag), lambda x: F.struct(x[0]["tag"].alias("tag"), F.trim(x[0]["cls"]).alias("cls"), E.glued(x).alias("text"))).alias("e"),
                     F.transform(E.first_children(F.col("n")), lambda n: n["tag"]).alias("firsts")).collect()
    for r in rows:
        nodes = list(U._inside(stdlib(pages[r.i])))
        # the tree gives a void element the text behind it; nothing selects those for their text
        want = [(n[0], "" if n[0] in U._VOID else U._text(n) or "") for n in nodes]
        got = [(e.tag, "" if e.tag in U._VOID else e.text) for e in r.e]
        assert got == want, pages[r.i]
        assert [set(e.cls.split()) for e in r.e] == [n[1] for n in nodes]

        def firsts(node):
            kids = [c for c in node[2] if not isinstance(c, str)]
            return [c for k, c in enumerate(kids) if k == 0] + [x for c in kids for x in firsts(c)]
        assert sorted(r.firsts) == sorted(n[0] for n in firsts(stdlib(pages[r.i])))


def test_parse_pages_equals_the_fallback(spark):
    pages = spark.createDataFrame([(f"s{i}", h, 1) for i, h in enumerate(ODD)], "search string, html string, success int")
    cols = [f.name for f in U.DETAILS_SCHEMA]
    a = sorted(map(str, (tuple(r) for r in P.parse_pages(pages).select(*cols).collect())))
    b = sorted(map(str, (tuple(r) for r in U.parse_pages_with(pages).select(*cols).collect())))
    assert a == b and len(a) > len(ODD)
    # the listing is the blocks of the same rows
    blocks = [r for r in P.parse_pages(pages).collect() if r.success and r.business_name not in ("s2", "s3", "s5", "s7")]
    listing = P.tree_listing(pages, keys=("search",)).collect()
    assert sorted((r.search, str(r.business_name), str(r.status), str(r.location)) for r in listing) == sorted(
        (r.business_name, str(r.company_name), str(r.status), str(r.location)) for r in blocks)


def test_regular(spark):
    cases = [("<div><p>x</p><br></div>", True), ("<div><p></div>", False), ("</div>", False), ("<div>", False), ("", True), (None, True), ("<DIV></div>", True)]
    got = {r.html: r.ok for r in spark.createDataFrame([(h,) for h, _ in cases], "html string").select("html", E.regular("html").alias("ok")).collect()}
    assert got == dict(cases)


def test_candidates_rows_and_link(spark):
    pages = [
        (1, "<section><div>Whole first child</div><p>x</p><h2>Long Heading Name Ltd</h2><a href='/view/1'>View</a></section>"),
        (2, "<p><a href='http://x'>http://x.org</a> <a>No address</a> <a href='/c/2'><i>it</i></a><i></i><a href='/c/3'>Fallback Co</a></p>"),
        (3, "<table><tr><td>Status: Active</td></tr></table><p><b>Type</b> Corporation</p><div class='field-1'>Type: Other</div>"),
        (4, "<div class='c'><i></i><div>Inner: deep</div></div>"), (5, None), (6, ""),
    ]
    out = {r.page_id: r for r in P.company_candidate(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert (out[1].company_name, out[1].source) == ("Long Heading Name Ltd", "candidate")
    assert (out[2].company_name, out[2].source) == ("http://x.org", "candidate")          # a:first-child is a candidate like any other
    assert out[3].details["TYPE"] == "Corporation</p>"                                     # rows are read as mark-up, up to their end
    assert any(re.search("STATUS$", k) for k in out[3].details)
    assert any(k.endswith("INNER") for k in out[4].details)
    assert out[5].company_name is None and out[6].company_name is None and out[5].details == {}
    link = spark.createDataFrame([("<i>n</i><a href='www.q'>www.q.org</a><a>none</a><a href='/'><b>b</b></a><a href='/z'>Linked Co</a>",)], "html string")
    assert link.select(P.first_link_text(E.elements("html")).alias("t")).first().t == "Linked Co"


def test_alternative_label_search(spark):
    """A row whose value carries no value class: the element after its label."""
    block = ('<div class="registerItemSearch-results-page-line"><div class="field-row"><span class="Label">Office:</span><span class="text">Ottawa</span></div>'
             "<DIV class='appMinimalAttr'><SPAN class='appMinimalLabel'>Kind</SPAN><SPAN class='appMinimalValue'>Quoted</SPAN></DIV></div>")
    info = P.extract_company_fields(spark.createDataFrame([(block,)], "block string")).first().info
    assert info["OFFICE"] == "Ottawa" and info["KIND"] == "Quoted"


def test_only_irregular_pages_reach_python(spark):
    pages = spark.createDataFrame([(f"s{i}", h) for i, h in enumerate(ODD)], "search string, html string")
    regular = {r.search for r in pages.where(E.regular("html")).collect()}

    def parser(name, html):
        if name in regular:
            raise AssertionError(name)
        return U.parse_business_details(name, html)
    got = sorted(map(str, (tuple(r) for r in U.parse_irregular_with(pages, parser).collect())))
    cols = U.DETAILS_SCHEMA.fieldNames()
    assert got == sorted(map(str, (tuple(r) for r in U.parse_pages_with(pages).select(*cols).collect()))) and 0 < len(regular) < len(ODD)
