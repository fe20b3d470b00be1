"""Blocks and fields cut at plain div pieces equal those cut by pattern; one pass over pages and records."""

import pytest
from pyspark.sql import functions as F

from nomen.operators import pages as P
from nomen.operators import udf as U
from nomen.plans import inputs as I

BLOCK = (f'<div class="{P.BLOCK_CLASS} appMinimalBox"><div class="statusSearchResult"><div class="appMinimalAttr Status">'
         '<span class="appMinimalValue">Active</span></div></div><div class="addressSearchResultBox"><div class="appAttrValue">1 A St</div></div></div>\n')
PAGES = [
    f"<html><div class='x'>head</div>{BLOCK}{BLOCK}<div>foot</div></html>",
    BLOCK + BLOCK,
    BLOCK.replace("</div></div></div>", ""),                              # never closed
    BLOCK.replace("</div>", "</div >") + "<p>",
    BLOCK.replace("<div class=\"addressSearchResultBox", "<DIV class=\"addressSearchResultBox").replace("1 A St</div></div>", "1 A St</div></DIV>") + BLOCK,
    BLOCK.replace("Status\">", "Status\" title=\"a <div b\">") + BLOCK,   # a tag's name inside a tag
    BLOCK.replace("appMinimalAttr Status", "appMinimalAttr > Status") + "<div",
    "<p>nothing</p>", "",
]


def _old_blocks(h):
    return F.transform(F.filter(F.split(h, P.BLOCK_OPEN_RE), lambda p: p.rlike(P.START_RE)), P.balanced)


def test_blocks_and_fields_equal_those_by_pattern(spark):
    d = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)] + [(99, None)], "page_id int, html string").repartition(2)
    rows = d.select("page_id", P.result_blocks(F.col("html")).alias("new"), _old_blocks(F.col("html")).alias("old"), P.tidy(F.col("html")).alias("tidy")).collect()
    assert all(r["new"] == r["old"] for r in rows)
    assert {r["tidy"] for r in rows} == {True, False, None} and sum(len(r["new"] or []) for r in rows) >= 10
    b = P.split_result_blocks(d)
    by_pattern = b.select("page_id", "pos", *[s.column(F.col("block")).alias(s.name) for s in P.LISTING_FIELDS],
                          P.attr_dates(F.col("block")).alias("dates"))
    by_pieces = b.select("page_id", "pos", "block", P.tidy_pieces(F.col("block")).alias("ps"))
    by_pieces = by_pieces.select("page_id", "pos", *[s.column(F.col("block"), F.col("ps")).alias(s.name) for s in P.LISTING_FIELDS],
                                 P.attr_dates(F.col("block"), F.col("ps")).alias("dates"))
    assert sorted(map(str, by_pattern.collect())) == sorted(map(str, by_pieces.collect()))


def test_no_tree_for_blocks_without_previous_names(spark):
    named = '<div class="appMinimalBox"><span class="appMinimalLabel">PREVIOUSLY known as</span><span class="appMinimalValue">OLD CO</span></div>'
    hidden = named.replace("known", "<!-- x -->known")
    d = spark.createDataFrame([(1, BLOCK), (2, named), (3, hidden)], "k int, block string").repartition(2)
    got = {r["k"]: r["n"] for r in d.select("k", P.extract_previous_names("block").alias("n")).collect()}
    assert got == {1: [], 2: ["OLD CO"], 3: ["OLD CO"]}


def test_mixed_parse_makes_pages_once(spark, tmp_path):
    """The pages are evaluated once; they were evaluated for each of the two branches."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def mark(h):
        seen.add(1)
        return h
    rows = [("a", PAGES[0]), ("b", "<div><p>open"), ("c", None), ("d", PAGES[7])]
    d = spark.createDataFrame(rows, "search string, html string").repartition(1).select("search", mark.asNondeterministic()("html").alias("html"))
    got = sorted((r["business_name"], r["success"], r["error_message"], r["status"]) for r in U.parse_irregular_with(d).collect())
    assert seen.value == len(rows)
    want = sorted((r["business_name"], r["success"], r["error_message"], r["status"])
                  for r in U.parse_pages_with(spark.createDataFrame(rows, "search string, html string")).collect())
    assert str(got) == str(want)


def test_page_rows_travel_without_mark_up(spark):
    """The shuffle that gathers a page's records holds their values, not their rendered blocks."""
    plan = I.registry_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("collect_list(")
    assert P.VALUE_CLASS not in plan[at:].split("\n", 1)[1]


@pytest.mark.parametrize("link,want", [
    ("<a>A CO (12)</a><span class=\"appMinimalValue\">Inactive</span>", ("A CO", "Inactive", "12")),
    ("<a>A CO (12)</a>", ("A CO", "Active", "12")),
    ("<span>B &amp; C (7)</span>", ("B & C", "Found", "7")),
    ("<p>none</p>", None),
])
def test_concurrent_fields(spark, link, want):
    r = spark.createDataFrame([(link,)], "h string").select(P.extract_concurrent_fields("h", F.lit("s")).alias("c")).first()["c"]
    assert (r and (r["company_name"], r["status"], r["corporation_number"])) == want


def test_orders_without_a_customer(spark, tmp_path):
    """Null customer keys, and lines without an order: a record each, without a business type."""
    for t in ["part", "customer", "nation", "region"]:
        I.table(spark, "/root/testdata/sf0.001", t).write.parquet(f"{tmp_path}/{t}.parquet")
    o = I.table(spark, "/root/testdata/sf0.001", "orders").limit(3).collect()
    schema = I.table(spark, "/root/testdata/sf0.001", "orders").schema
    rows = [dict(r.asDict(), o_orderkey=i + 1, o_custkey=None if i else r["o_custkey"]) for i, r in enumerate(o)]
    spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 1), (2, None, 1), (9, 1, 1), (None, 1, 2)], "l_orderkey long, l_partkey long, l_linenumber long") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = I.registry_records(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"] or 0, r["business_type"] is None, r["address"] == "Canada") for r in got) == [
        (0, True, True), (9, False, False), (17, True, True), (24, True, True), (73, True, True)]
