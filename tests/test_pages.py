from pyspark.sql import functions as F

from nomen.functions import text as T
from nomen.operators import pages as P
from nomen.operators import udf as U

REC = [("A & B <Trading>", "1234567", "Corporation", "Active", "Not-for-Profit Corporation",
        "January 06, 2025", "Town, Region, Canada"),
       ("SECOND ONE", "7654321", "Business Name", None, "Co-operative with Share", "September 15 2008", "X")]


def _pages(spark):
    df = spark.createDataFrame(REC, "n string, num string, reg string, st string, bt string, d string, a string")
    blk = P.render_result_block(*[F.col(c) for c in ["n", "num", "reg", "st", "bt", "d", "a"]])
    blocks = df.select(F.lit("p1").alias("page_key"), blk.alias("b"))
    g = blocks.groupBy("page_key").agg(F.collect_list("b").alias("bs"))
    pages = g.select("page_key", F.lit("a (x)").alias("search"), P.render_page(F.col("bs"), F.size("bs")).alias("html"))
    empty = spark.createDataFrame([("p0", "z (x)")], "page_key string, search string") \
        .select("page_key", "search", P.render_page(F.array().cast("array<string>"), F.lit(0)).alias("html"))
    return pages.unionByName(empty)


def test_render_parse_round_trip(spark):
    pages = _pages(spark)
    blocks = P.split_result_blocks(pages, keys=("page_key",))
    d = {r.corporation_number: r for r in P.extract_details(blocks).collect()}
    a = d["1234567"]
    assert a.company_name == "A & B <Trading>"           # entities decoded
    assert (a.registry_type, a.status, a.business_type) == ("Corporation", "Active", "Not-for-Profit Corporation")
    assert str(a.incorporation_day) == "2025-01-06"
    b = d["7654321"]
    assert b.status is None and str(b.incorporation_day) == "2008-09-15"   # missing field, comma-less date
    lst = {r.business_name: r for r in P.extract_listing(blocks).collect()}
    assert lst["SECOND ONE (7654321)"].status == "N/A"
    assert sorted(r.pos for r in blocks.collect()) == [1, 2]


def test_counts_and_flags(spark):
    pages = _pages(spark).select("page_key", P.count_results("html").alias("n"),
                                 P.saturated_page("html").alias("sat"),
                                 P.page_size("html").alias("size")).collect()
    m = {r.page_key: r for r in pages}
    assert m["p1"].n == 2 and m["p0"].n == 0 and not m["p1"].sat
    banner = spark.range(1).select(P.saturated_page(F.lit('<div class="appPagerBanner">1 - 200 of 200</div>')).alias("s"))
    assert banner.first().s is True


def test_python_parser_and_errors(spark):
    pages = _pages(spark)
    # unclosed tags and a script holding tag text
    bad = spark.createDataFrame([("b (x)", '<script>var t="</span>";</script><div class="registerItemSearch-results-page-line">'
                                  '<div class="registerItemSearch-results-page-line-ItemBox-resultLeft-viewMenu"><a>'
                                  '<span class="left"></span><span>BROKEN CO (42)</span><p>no close'),
                                 ("c (x)", None)], "search string, html string")
    rows = U.parse_pages_with(pages.select("search", "html").unionByName(bad)).collect()
    assert sorted(r.company_name for r in rows if r.business_name == "a (x)") == ["A & B <Trading> (1234567)", "SECOND ONE (7654321)"]
    out = {r.business_name: r for r in rows}
    assert out["b (x)"].company_name == "BROKEN CO (42)" and out["b (x)"].success
    assert out["c (x)"].success is False and out["c (x)"].error_message == "no page"


def test_generic_page_features(spark):
    html = ("<html><head><title>Big &amp; Co</title></head><body><h1>Big &amp; Co Ltd</h1>"
            "<ul><li><a href='/view'>view</a></li><li>x</li></ul><p>No results found</p></body></html>")
    r = P.page_features(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (r.title, r.h1, r.n_items, r.n_links, r.no_results) == ("Big & Co", "Big & Co Ltd", 2, 1, True)
    assert r.best_candidate == "Big & Co Ltd"


def test_previous_names_and_first_block(spark):
    blk = ('<div class="previousNameSearchResult"><div><span class="appMinimalLabel">Previously known as</span>'
           '<span class="appMinimalValue">OLD  NAME</span><span class="appMinimalValue">OLD NAME</span>'
           '<span class="appMinimalValue">OTHER</span></div></div>')
    r = spark.range(1).select(P.extract_previous_names(F.lit(blk)).alias("p"),
                              P.first_result_block(F.lit('<p>x</p><div class="result-item">R</div>')).alias("f")).first()
    assert r.p == ["OLD NAME", "OTHER"]
    assert r.f.startswith('<div class="result-item">')


def test_extract_company_fields_map(spark):
    blk = ('<div class="registerItemSearch-results-page-line appMinimalBox ItemBox">'
           '<div class="registerItemSearch-results-page-line-ItemBox-resultLeft-viewMenu"><a class="viewMenu">'
           '<span class="left"></span><span>ACME  FOODS (42)</span><span class="right"></span></a></div>'
           '<div class="registerItemSearch-results-page-line-item1 registryInfo">Corporation</div>'
           '<div class="appMinimalAttr Status"><span class="appMinimalLabel">Status:</span>'
           '<span class="appMinimalValue">Active</span></div>'
           '<div class="appMinimalAttr Other"><span class="appMinimalLabel">Status</span>'
           '<span class="appMinimalValue">Ignored</span></div>'
           '<div class="appMinimalAttr X"><span class="appMinimalLabel">CompanyName</span>'
           '<span class="appMinimalValue">ALIAS</span></div>'
           '<div class="appMinimalAttr RegistrationDate"><span class="appMinimalLabel">Amalgamation Date</span>'
           '<span class="appMinimalValue">May 05, 2001</span></div>'
           '<div class="appMinimalBox addressSearchResultBox"><div class="appAttrValue">1 Road</div></div>'
           '<div class="appMinimalBox addressSearchResultBox"><div class="appAttrValue">1 Long Road, Town</div></div>'
           '<div class="previousNameSearchResult"><div><span class="appMinimalValue">OLD ONE</span>'
           '<span class="appMinimalValue">OLD TWO</span></div></div></div>')
    df = spark.createDataFrame([(1, blk)], "page_key int, block string")
    m = P.extract_company_fields(df).first().info
    assert m["COMPANY NAME"] == "ACME FOODS" and m["CORPORATION NUMBER"] == "42"
    assert m["STATUS"] == "Active"                    # first wins
    assert m["ADDRESS"] == "1 Long Road, Town"        # longest address
    assert m["PREVIOUS NAMES"] == "OLD ONE; OLD TWO"
    assert m["AMALGAMATION DATE"] == "May 05 2001"    # date label: commas removed
    assert m["INCORPORATION DATE"] == "May 05, 2001"  # registration attribute fallback
    assert "COMPANYNAME" in m                         # alias kept: canonical key already present


def test_company_candidates_selector_order(spark):
    blk = ('<div class="x"><a class="viewMenu" href="#view"><span class="left"></span><span>ACME FOODS (42)</span>'
           '<span class="right"></span></a><div class="the-name">  ACME  </div><strong>View</strong>'
           '<b>An Unusually Long Bold Label That Wins On Length</b><h1>Hi</h1></div>')
    r = spark.range(1).select(P.extract_company_candidates(F.lit(blk)).alias("c"),
                              P.extract_company_candidates(F.lit(blk.replace("<b>An Unusually Long Bold Label That Wins On Length</b>", ""))).alias("d")).first()
    assert r.c == "An Unusually Long Bold Label That Wins On Length"
    assert r.d == "ACME FOODS (42)"          # view link text, spans glued; 'View' and 'Hi' filtered


BLOCK = ('<div class="registerItemSearch-results-page-line"><div class="registerItemSearch-results-page-line-ItemBox-resultLeft-viewMenu">'
         '<a class="viewMenu"><span>CAF&eacute; L&#233;A &#x26; CO (7)</span></a></div>%s</div>'
         '<div class="footer"><div class="appMinimalBox addressSearchResultBox"><div class="appAttrValue">FOOTER OFFICE</div></div></div>')


def _one(spark, inner):
    pages = spark.createDataFrame([("p", "s", BLOCK % inner)], "page_key string, search string, html string")
    blocks = P.split_result_blocks(pages, keys=("page_key",))
    d = P.extract_details(blocks).first()
    py = U.parse_pages_with(pages).first()
    assert (py.company_name, py.status, py.business_type, py.location) == (
        f"{d.company_name} ({d.corporation_number})", d.status, d.business_type, d.address)
    return d, P.extract_company_fields(blocks).first().info


def test_fields_stay_inside_their_element(spark):
    d, m = _one(spark, '<div class="appMinimalAttr Status"></div><div class="registryInfo">Corporation</div>'
                       '<div class="appMinimalAttr EntitySubTypeCode"><p><span class="appMinimalValue">Not-for-Profit\n<b>Corporation</b></span></p></div>'
                       '<div class="appMinimalBox addressSearchResultBox"></div>'
                       '<div class="appMinimalAttr Date"><span>Amalgamation Date</span> <span>May 05, 2001</span></div>')
    assert d.company_name == "CAFé LéA & CO" and d.corporation_number == "7"
    assert d.status is None and d.address is None                 # not the next element's, not the footer's
    assert d.registry_type is None and m["REGISTRY TYPE"] == "Corporation"
    assert d.incorporation_date is None and d.amalgamation_date == "May 05, 2001"
    assert "STATUS" not in m and "ADDRESS" not in m


def test_company_fields_alternative_classes_and_values_without_row(spark):
    _, m = _one(spark, '<div class="company-status"><em class="value">Dissolved soon</em></div><div class="address">1 Road<br>Town</div>'
                       '<div class="business-type"><span class="value">Co-operative</span></div>'
                       '<p><span class="label">Officer:</span><span class="value">Ann Lee</span></p>')
    assert m["STATUS"] == "Dissolved soon" and m["ADDRESS"] == "1 Road Town" and m["BUSINESS TYPE"] == "Co-operative"
    assert m["OFFICER"] == "Ann Lee"


def test_previous_names_selectors(spark):
    cases = [('<div class="previous-names"><span class="oldName">A ONE</span></div>', ["A ONE"]),
             ('<div class="previousNamesBox"><div class="x"><div><span class="appMinimalValue">A ONE</span></div></div>'
              '<span class="appMinimalValue">B TWO</span></div>', ["A ONE", "B TWO"]),
             ('<div class="appMinimalBox"><span class="appMinimalLabel">Previously known as</span><span class="appMinimalValue">C</span></div>', ["C"]),
             ('<div class="previous-names"><p>Previously</p><p>Old Firm</p><p>ab</p></div>', ["Old Firm"]),
             ('<div class="other"></div>', []), ('', [])]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, block string")
    got = {r.i: r.p for r in df.select("i", P.extract_previous_names("block").alias("p")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_pages_without_blocks_have_sections(spark):
    from nomen.plans import pipelines as PL
    pages = spark.createDataFrame([("a", "a (x)", "<p>No results found</p>"), ("b", "b (x)", None)], "page_key string, search string, html string")
    v = {r.file_no: r.value for r in PL.search_sections(pages).collect()}
    assert "Status: No Data" in v["a"] and "Results Found: 0" in v["a"] and "Status: Error" in v["b"]


def test_unescape_references(spark):
    texts = ["&amp;lt; &eacute;&#128512;&#x41;", "a & b &nosuch; &", "&#0;&#xD800;", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", T.unescape(F.col("t")).alias("u")).collect()}
    assert got == {0: "&lt; é😀A", 1: "a & b &nosuch; &", 2: "&#0;&#xD800;", 3: "", 4: None}
