from pyspark.sql import functions as F

from nomen.functions import text as T
from nomen.operators import owners as O
from nomen.operators import pages as P
from nomen.operators import reports as R


def test_text_helpers(spark):
    r = spark.range(1).select(
        T.extract_date(F.lit("Incorporation Date October 03, 1998")).alias("d"),
        T.extract_date(F.lit("Amalgamation on May 5 2001")).alias("a"),
        T.split_search_label(F.lit("ab (Co-operative with Share)")).alias("l"),
        T.format_percent(F.lit(0.95)).alias("p"), T.parse_percent(F.lit("x\nCONFIDENCE: 85%\n")).alias("q"),
        T.percent_value(F.lit("70%")).alias("v"), T.safe_name(F.lit("Not-for-Profit Corp (x)")).alias("s"),
        T.truncate_raw(F.lit("abcdef"), 3).alias("t"), T.strip_number(F.lit("ACME (123) ")).alias("n"),
        T.trailing_number(F.lit("ACME ( 123 )")).alias("m")).first()
    assert (r.d.incorporation_date, r.d.amalgamation_date) == ("October 03, 1998", None)
    assert r.a.amalgamation_date == "May 5 2001"
    assert (r.l.prefix, r.l.business_type) == ("ab", "Co-operative with Share")
    assert (r.p, r.q, r.v) == ("95%", "85%", 0.7)
    assert r.s == "not-for-profit_corp__x_"
    assert (r.t, r.n, r.m) == ("abc...", "ACME", "123")


def test_label_value_and_concurrent(spark):
    rows = spark.createDataFrame([("<p>Status： Active now</p>",), ("<b>Number</b> 12345<br>",), ("short",)], "r string")
    got = [x.lv for x in rows.select(P.extract_label_value("r").alias("lv")).collect()]
    assert (got[0].label, got[0].value) == ("<P>STATUS", "Active now</p>")
    assert (got[1].label, got[1].value) == ("NUMBER", "12345")
    assert got[2] is None
    html = ('<a href="#">ACME FOODS (998877)</a><span class="appMinimalValue">Inactive</span>'
            '<span>Ontario Business Corporation</span><span>March 04, 2010</span>'
            '<div class="appAttrValue">1 Road, Toronto, Ontario, Canada</div>')
    r = spark.range(1).select(P.extract_concurrent_fields(F.lit(html), F.lit("acme")).alias("c"),
                              P.extract_concurrent_fields(F.lit("<p>No results found</p>"), F.lit("acme")).alias("n")
                              ).first()
    assert (r.c.company_name, r.c.corporation_number, r.c.status) == ("ACME FOODS", "998877", "Inactive")
    assert (r.c.business_type, r.c.incorporation_date) == ("Ontario Business Corporation", "March 04, 2010")
    assert r.c.location == "1 Road, Toronto, Ontario, Canada"
    assert (r.n.company_name, r.n.status) == ("acme", "No Results Found")
    a = spark.range(1).select(P.longest_address(F.array(F.lit("a b"), F.lit("abc d"), F.lit("xyz w"))).alias("a")).first().a
    assert a == "abc d"


def test_maps_and_samples(spark):
    m = F.create_map(F.lit("COMPANYNAME"), F.lit("X"), F.lit("STATUS"), F.lit("A"))
    d = F.create_map(F.lit("STATUS"), F.lit("B"))
    r = spark.range(1).select(R.standardize_fields(m).alias("s"), R.overlay_details(m, d).alias("o")).first()
    assert r.s == {"STATUS": "A", "COMPANY NAME": "X"}
    assert r.o == {"COMPANYNAME": "X", "STATUS": "B"}
    cl = O.classify_owners(spark.createDataFrame([(f"ANN LEE{c}",) for c in "ABCDEFG"], "owner string"))
    top, more = O.sample_owners(cl, 5)
    assert [x.owner for x in top.collect()] == [f"ANN LEE{c}" for c in "ABCDE"]
    assert spark.range(1).select(more.alias("m")).first().m == 2


def test_union_and_json(spark):
    from nomen.operators import stats as ST
    a = spark.createDataFrame([("x", 1)], "name string, n int")
    b = spark.createDataFrame([("y",)], "name string")
    u = ST.union_batches(a, b)
    assert sorted((r.name, r.n) for r in u.collect()) == [("x", 1), ("y", None)]
    r = u.select(T.to_json_record("name", "n").alias("j")).orderBy("j").collect()
    assert [x.j for x in r] == ['{"name":"x","n":1}', '{"name":"y"}']
    back = spark.range(1).select(T.parse_json(F.lit('{"k": 5, "s": "é"}'), "k INT, s STRING").alias("p")).first().p
    assert (back.k, back.s) == (5, "é")
