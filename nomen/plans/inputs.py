"""Inputs derived from the driver's tables by plain column expressions.

No owner data ships with the test tables, so owner names, search names and a
registry are derived with SQL-expressible rules (the DuckDB oracle in
``nomen.plans.oracle`` writes the same rules). All derivations read whole
tables; the ``% k`` below picks a *form* per row, it never filters rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

N_OWNER_FORMS = 16
N_COMPANY_FORMS = 8
N_BLOCK_FORMS = 8  # shapes of a rendered result block, chosen by record


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owner_form(base, key) -> F.Column:
    """One of 16 owner-name shapes chosen by ``key % 16`` around ``base``
    (upper case); each shape exercises one rule of the classifier."""
    b = F.upper(base)
    k = F.pmod(key, F.lit(N_OWNER_FORMS))
    forms = [
        F.concat(b, F.lit(" INC")),
        F.concat(b, F.lit(" LTD")),
        F.concat(b, F.lit(" LIMITED")),
        F.concat(F.lit("123 "), b),
        F.concat(b, F.lit(" 45")),
        F.concat(b, F.lit(" 2020 TRUST")),
        F.concat(F.lit("PRIVATE "), b),
        F.concat(b, F.lit(" CO-OP")),
        F.concat(F.lit("THE "), b, F.lit(" & CO.")),
        F.concat(b, F.lit(" ("), key.cast("string"), F.lit(")")),
        F.concat(F.lit("  "), b, F.lit("  ")),
        F.concat(b, F.lit(" 2020")),
        F.concat(F.lit("2020 "), b),
        F.substring(b, 1, 2),
        F.concat(b, F.lit(" & SONS")),
        F.concat(F.lit("MR "), b),
    ]
    e = F.when(k == 0, forms[0])
    for i, f in enumerate(forms[1:], start=1):
        e = e.when(k == i, f)
    return e


def part_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(owner_id, raw_owner)``: one owner-name per part row."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select(F.col("p_partkey").alias("owner_id"),
                    owner_form(F.col("p_name"), F.col("p_partkey")).alias("raw_owner"))


# White space between words, spelled out so that Java and RE2 agree.
WORD_RE = r"[^\x20\x09-\x0D]+"
PIECE_RE = WORD_RE + r"(?:[\x20\x09-\x0D]+" + WORD_RE + "){0,2}"


def text_pieces(text) -> F.Column:
    """The whole text cut into consecutive pieces of three words (the last
    may be shorter), words joined by one space."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE_RE), 0),
                       lambda p: F.regexp_replace(p, r"[\x20\x09-\x0D]+", " "))


def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, piece_no, search_name)``: every three-word piece of every
    whole document."""
    d = table(spark, sf_dir, "documents").select("doc_id", text_pieces(F.col("text")).alias("ps"))
    return d.select("doc_id", F.posexplode("ps").alias("piece_no", "search_name"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, piece_no, search_name, company_name)``: every piece with the
    registry spelling of the three words that start one word later, so the
    two overlap partly, as an owner and its registry entry do."""
    d = table(spark, sf_dir, "documents").select("doc_id", text_pieces(F.col("text")).alias("ps"))
    two = d.select("doc_id", F.posexplode(F.transform("ps", lambda p, i: F.struct(
        p.alias("search_name"), F.concat_ws(" ", p, F.get("ps", i + 1)).alias("w")))).alias("piece_no", "x"))
    later = F.array_join(F.slice(F.split(F.col("x.w"), " "), 2, 3), " ")
    # pieces are spread before they are scored: scoring a pair costs far more than
    # moving it, and one long document is one task's rows otherwise
    two = two.repartition("doc_id", "piece_no")
    return two.select("doc_id", "piece_no", F.col("x.search_name").alias("search_name"),
                      company_form(later, F.col("doc_id") + F.col("piece_no")).alias("company_name"))


def company_form(base, key) -> F.Column:
    """Registry-style spelling of a name: 8 shapes chosen by ``key % 8``."""
    k = F.pmod(key, F.lit(N_COMPANY_FORMS))
    b = F.upper(base)
    forms = [
        F.concat(b, F.lit(" INC.")),
        F.concat(b, F.lit(" LIMITED")),
        F.concat(F.lit("THE "), b, F.lit(" CORPORATION")),
        F.concat(b, F.lit(" CO-OPERATIVE")),
        F.concat(b, F.lit(" (ONTARIO) LTD")),
        b,
        F.concat(b, F.lit(" & ASSOCIATES")),
        F.concat(b, F.lit(" HOLDINGS")),
    ]
    e = F.when(k == 0, forms[0])
    for i, f in enumerate(forms[1:], start=1):
        e = e.when(k == i, f)
    return e


def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(company_name)``: the name of every registry record in one of the
    registry spellings, chosen by its part."""
    r = registry_records(spark, sf_dir)
    return r.select(company_form(F.col("company_name"), F.coalesce("part_key", F.lit(0))).alias("company_name"))


# Registry vocabulary used to render synthetic result pages.
STATUSES = {"F": "Active", "O": "Inactive", "P": "Refer to Ministry"}
BUSINESS_TYPES = ["Not-for-Profit Corporation", "Ontario Business Corporation",
                  "Co-operative Non-Share", "Co-operative with Share", "Extra-Provincial Corporation"]
REGISTRY_TYPES = ["Corporation", "Business Name"]


def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry record per ``lineitem`` row, plus one per order without
    lines: company name from the part (name, type and key), status and
    registration date from the order, business type by customer, address
    from the customer's nation and region. No line and no order is dropped;
    a line repeated in the table gives a record as often.

    ``record_id`` is ``order key * 8 + line number``. All equi joins;
    nation/region are the fixed 25/5-row dimension tables and are broadcast."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    bt = F.array(*[F.lit(x) for x in BUSINESS_TYPES])
    st = F.create_map(*[x for kv in STATUSES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    # texts are made once per part and order, and orders meet customers before
    # lines do: the lines, by far the most rows, are moved twice and kept narrow
    p = p.select("p_partkey", F.upper("p_name").alias("_p_name"), F.upper("p_type").alias("_p_type"))
    o = (o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
         .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .select("o_orderkey", st[F.col("o_orderstatus")].alias("_status"),
                 F.pmod(F.col("o_custkey"), F.lit(len(BUSINESS_TYPES))).cast("int").alias("_type"),
                 F.concat_ws(", ", F.col("n_name"), F.col("r_name"), F.lit("Canada")).alias("_address"),
                 F.date_format(F.col("o_orderdate"), "MMMM dd, yyyy").alias("_date")))
    # orders are the hashed side: the lines are not sorted for the join
    out = (li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
           .join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"), "full"))
    order = F.coalesce("l_orderkey", "o_orderkey")
    rid = order * LINES_PER_ORDER + F.coalesce("l_linenumber", F.lit(0))
    return out.select(
        rid.alias("record_id"),
        F.col("p_partkey").alias("part_key"),
        F.concat_ws(" ", F.when(F.pmod(rid, F.lit(N_BLOCK_FORMS)) == 4, F.lit("CAFÉ")),
                    F.coalesce("_p_name", F.lit("ORDER")), "_p_type",
                    F.coalesce("p_partkey", order).cast("string")).alias("company_name"),
        (F.lit(1000000) + rid).cast("string").alias("corporation_number"),
        F.when(F.pmod(rid, F.lit(5)) == 0, F.lit(REGISTRY_TYPES[1]))
         .otherwise(F.lit(REGISTRY_TYPES[0])).alias("registry_type"),
        F.col("_status").alias("status"),
        F.get(bt, F.col("_type")).alias("business_type"),
        # a line without an order has an address of its own: the country alone
        F.coalesce("_address", F.lit("Canada")).alias("address"),
        F.col("_date").alias("registration_date"),
    )


LINES_PER_ORDER = 8  # line numbers are 1-7; 0 stands for an order without lines
FULL_PAGE = 8
PAGE_SIZE = 400  # record ids per synthetic result page: 50 orders, split by search


def search_label(name, business_type) -> F.Column:
    """``prefix (type)``: the search a record is found by (first letter)."""
    return F.concat(F.lower(F.substring(name, 1, 1)), F.lit(" ("), business_type, F.lit(")"))


def registry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages rendered from ``registry_records``: one page per
    ``(search, record_id div PAGE_SIZE)``, blocks in record order: a page holds
    the lines of 50 orders that belong to one search. Its banner says 200 (the
    most a search shows) from ``FULL_PAGE`` blocks on. Every supplier is one
    more search, with a page that says there are no results."""
    from nomen.operators.pages import render_page, render_result_block
    r = registry_records(spark, sf_dir)
    cols = ["company_name", "corporation_number", "registry_type", "status", "business_type", "registration_date", "address"]
    # the record's values travel, not its mark-up, which is several times as long
    b = r.select(search_label(F.col("company_name"), F.col("business_type")).alias("search"),
                 F.floor(F.col("record_id") / PAGE_SIZE).alias("page_no"),
                 F.struct("record_id", *cols).alias("rb"))
    g = b.groupBy("search", "page_no").agg(F.collect_list("rb").alias("rbs"))
    g = g.select("search", "page_no", F.array_sort(F.transform("rbs", lambda x: F.struct(
        x["record_id"].alias("record_id"),
        render_result_block(*[x[c] for c in cols], F.pmod(x["record_id"], F.lit(N_BLOCK_FORMS))).alias("block")))).alias("rbs"))
    full = F.size("rbs") >= FULL_PAGE
    found = g.select(
        F.concat("search", F.lit("#"), F.col("page_no").cast("string")).alias("page_key"),
        "search",
        render_page(F.transform("rbs", lambda x: x["block"]), F.size("rbs"),
                    F.when(full, F.lit(200)).otherwise(F.size("rbs"))).alias("html"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("search"))
    none = s.select(F.concat("search", F.lit("#0")).alias("page_key"), "search",
                    render_page(F.array().cast("array<string>"), F.lit(0)).alias("html"))
    return found.unionByName(none)


N_SEARCH_FORMS = 6


def owner_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(search_no, business_name, html_content, success, error_message, search_time)``: a search by its part's owner
    name per registry record, with one of six outcomes: a page with a plain link and all fields (0), with a link
    alone (1), in the registry's own mark-up (2), without a company (3) or results (4), or a failure (5)."""
    from nomen.functions import text as T
    from nomen.functions.names import py_strip
    from nomen.operators.pages import ADDRESS_VALUE_CLASS, VALUE_CLASS, render_page, render_result_block
    o = part_owners(spark, sf_dir).select("owner_id", py_strip(F.col("raw_owner")).alias("business_name"))
    r = o.hint("shuffle_hash").join(registry_records(spark, sf_dir), F.col("owner_id") == F.col("part_key"))
    k = F.pmod(F.col("record_id"), F.lit(N_SEARCH_FORMS))

    def v(x):
        return F.coalesce(T.escape(x), F.lit(""))
    link = F.concat(F.lit('<p><a href="#view">'), v(F.col("company_name")), F.lit(" ("), v(F.col("corporation_number")), F.lit(")</a></p>"))
    fields = F.concat(F.lit(f'<span class="{VALUE_CLASS}">'), v(F.col("status")), F.lit("</span><span>"), v(F.col("business_type")),
                      F.lit("</span><span>"), v(F.col("registration_date")), F.lit(f'</span><div class="{ADDRESS_VALUE_CLASS}">'),
                      v(F.replace(F.col("address"), F.lit(", Canada"), F.lit(", Ontario, Canada"))), F.lit("</div>"))
    block = render_result_block(*[F.col(c) for c in ("company_name", "corporation_number", "registry_type", "status", "business_type",
                                                     "registration_date", "address")])
    html = (F.when(k == 0, F.concat(link, fields)).when(k == 1, link).when(k == 2, render_page(F.array(block), F.lit(1)))
            .when(k == 3, F.lit("<p>Please try again later</p>")).when(k == 4, render_page(F.array().cast("array<string>"), F.lit(0))))
    return r.select(F.col("record_id").alias("search_no"), "business_name", html.alias("html_content"), (k != 5).alias("success"),
                    F.when(k == 5, F.lit("timeout")).alias("error_message"), (F.col("record_id") / F.lit(100.0)).alias("search_time"))
