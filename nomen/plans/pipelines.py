"""Composed pipelines (functions of DataFrames).

* ``owner_pipeline`` — distinct -> classify -> number -> join first result ->
  overlay page details -> score -> report entries.
* ``owner_pipeline_overlap`` — the same with the overlap matcher and batches.
* ``owner_pipeline_concurrent`` — classify -> number -> batches and lanes -> searches with their
  pages -> concurrent fields -> overlap matcher -> report entries.
* ``business_type_report`` / ``unmatched_report`` — report files -> entries ->
  parse -> filter -> numbered summary.
* ``search_report_to_json`` — search report files -> blocks -> distinct ->
  pairs -> sorted records.
* ``single_lookup`` — the owner pipeline for one name.
* ``lookup_stats_pipeline`` — search log -> success filter -> stats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.functions import names as N
from nomen.functions import score as S
from nomen.functions import text as T
from nomen.operators import match as M
from nomen.operators import owners as O
from nomen.operators import pages as P
from nomen.operators import reports as R
from nomen.operators import stats as ST
from nomen.operators import windows as W
from nomen.sinks import writers as WR
from nomen.sources import readers as RD

ENTRIES_PER_FILE = 100


def detail_columns(prefix: str = "", amalgamation: bool = False) -> dict:
    p = prefix
    return {
        "COMPANY NAME": F.col(p + "company_name"),
        "CORPORATION NUMBER": F.col(p + "corporation_number"),
        "REGISTRY TYPE": F.col(p + "registry_type"),
        "STATUS": F.col(p + "status"),
        "ADDRESS": F.col(p + "address"),
        "BUSINESS TYPE": F.col(p + "business_type"),
        "INCORPORATION DATE": T.standardize_date(F.col(p + "registration_date")),
        **({"AMALGAMATION DATE": T.standardize_date(F.col(p + "amalgamation_date"))} if amalgamation else {}),
    }


#: record columns that the details of a result page overlay, by detail field
OVERLAID = {"company_name": "company_name", "corporation_number": "corporation_number", "registry_type": "registry_type",
            "status": "status", "address": "address", "business_type": "business_type",
            "registration_date": "incorporation_date", "amalgamation_date": "amalgamation_date"}


def overlay_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """``records`` (one per ``owner``) with the values that the owner's result
    page gives laid over their own; an owner with a page alone becomes a
    record. ``pages``: ``owner, html``; the first result block of a page counts,
    of several pages of one owner the least."""
    first = M.first_per_group(pages.select("owner", "html").where(F.col("html").isNotNull()), "owner", ["html"])
    d = P.extract_details(P.split_result_blocks(first, keys=("owner",)).where("pos = 1"))
    d = d.select(F.col("owner").alias("_owner"), *[F.col(f).alias("_d_" + c) for c, f in OVERLAID.items()])
    kinds = {f.name: f.dataType for f in records.schema.fields}
    j = records.join(d, F.col("owner") == F.col("_owner"), "full")
    return j.select(
        F.coalesce("owner", "_owner").alias("owner"),
        *[F.coalesce("_d_" + c, c).alias(c) if c in kinds else F.col("_d_" + c).alias(c) for c in OVERLAID],
        *[c for c in records.columns if c not in OVERLAID and c != "owner"])


def lookups(owners: DataFrame, results: DataFrame, owner_col: str = "owner", order_col: str = "record_id", min_len: int = 3,
            classify: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """Numbered owners with their record and its score: ``lookup_number, owner, found, is_match, confidence`` and
    the record columns. See :func:`owner_pipeline`."""
    o = owners.select(F.col(owner_col).alias("owner")).where(F.col("owner").isNotNull()).distinct()
    if classify:
        o = o.where(O.classify_owner("owner", min_len)["keep"])
    numbered = W.number_rows(o, ["owner"], "lookup_number")
    first = M.first_per_group(results, "owner", [order_col])
    if pages is not None:
        first = overlay_pages(first, pages)
    j = (numbered.where(F.length("owner") >= min_len)
         .join(first.withColumn("found", F.lit(True)), "owner", "left"))
    return M.score_pairs(j.withColumn("found", F.coalesce("found", F.lit(False))), "owner", "company_name")


def owner_pipeline(owners: DataFrame, results: DataFrame, owner_col: str = "owner",
                   order_col: str = "record_id", min_len: int = 3, classify: bool = False,
                   pages: DataFrame | None = None) -> DataFrame:
    """Numbered lookup entries: ``lookup_number, owner, status, is_match,
    confidence, entry``.

    ``owners``: one owner name per row (duplicates allowed); ``classify``
    leaves out those that the rule chain skips before they are numbered.
    ``results``: the registry records found for each owner (``owner`` + record
    columns), ordered by ``order_col``; the first is scored, or, where it has a message
    in an ``error`` column, reported as an error. ``pages``: result
    pages (``owner, html``), whose details overlay that record. Numbers follow
    the sorted distinct owners (numbers of skipped short names stay unused).
    """
    scored = lookups(owners, results, owner_col, order_col, min_len, classify, pages)
    dc = detail_columns(amalgamation="amalgamation_date" in scored.columns)
    found = F.col("found")
    error = F.col("error") if "error" in scored.columns else None
    entry = R.render_lookup_entry(F.col("lookup_number"), F.col("owner"), dc, found,
                                  F.col("is_match"), F.col("confidence"), R.record_pairs(dc), error)
    return scored.select("lookup_number", "owner", R.lookup_status(found, F.col("company_name"), error).alias("status"),
                         "is_match", "confidence", entry.alias("entry"))


def parsed_report(entries: DataFrame, per_file: int = ENTRIES_PER_FILE) -> DataFrame:
    """Report files assembled from entries, then cut and parsed back."""
    files = R.assemble_files(entries, "lookup_number", "entry", per_file)
    return R.parse_entries(R.split_report_entries(files))


def business_type_report(parsed: DataFrame, business_type: str = "Not-for-Profit Corporation") -> DataFrame:
    f = R.filtered_summary(R.filter_business_type(parsed, business_type))
    n = W.number_rows(f, ["lookup_number"], "i")
    return n.select("i", "search_name", "company_display", "status_display", "address_display",
                    R.render_summary_line(F.col("i"), F.col("company_display"), F.col("status_display"),
                                          F.col("address_display")).alias("line"))


def unmatched_report(parsed: DataFrame) -> DataFrame:
    f = R.filter_unmatched(parsed)
    n = W.number_rows(f, ["lookup_number"], "i")
    d = F.col("detail")
    return n.select("i", "search_name",
                    T.lookup_default(d["COMPANY NAME"], F.col("closest_match")).alias("found"),
                    d["STATUS"].alias("status"), d["ADDRESS"].alias("address"),
                    T.lookup_default(F.col("match_found")).alias("match_found"),
                    T.lookup_default(F.col("confidence"), default="N/A").alias("confidence"),
                    "original_entry")


def search_sections(pages: DataFrame, seconds=None) -> DataFrame:
    """One search-report section per page: ``file_no, value``. A page without
    result blocks gives a section with status ``No Data`` and no results, a
    search without a page (``html`` NULL) one with status ``Error``."""
    status = F.when(F.col("html").isNull(), "Error").when(F.size("rs") > 0, "Found").otherwise("No Data")
    # a page's rows stay in its own row: nothing is exploded, grouped or joined
    d = pages.select("page_key", "search", "html", P.page_listing("html").alias("rs")).select("page_key", "search", "rs", status.alias("status"))
    secs = seconds if seconds is not None else F.size("rs") / F.lit(10.0)
    sect = R.render_search_section(F.col("search"), F.col("status"), secs,
                                   F.concat(T.safe_name(F.col("search")), F.lit(".html")), F.col("rs"))
    head = F.lit("NON-PROFIT CORPORATION SEARCH REPORT\n" + R.RULE60 + "\n\n")
    return d.select(F.col("page_key").alias("file_no"), F.concat(head, sect).alias("value"))


def search_report_sink(pages: DataFrame, path: str, batch_id: int, seconds=None) -> bool:
    """Sections of a batch of pages appended to the report at ``path``; a batch run twice is there once."""
    return WR.append_search_report(search_sections(pages, seconds), path, batch_id=batch_id)


def search_report_to_json(reports: DataFrame) -> DataFrame:
    return R.report_to_records(reports)


def latest_search_report_to_json(spark, folder: str, out: str, prefix: str = "", suffix: str = ".txt") -> DataFrame:
    """The newest report file of a folder as sorted, de-duplicated records, written as JSON lines to ``out``
    and read back."""
    newest = RD.latest_file(spark, folder, prefix, suffix).first()
    if newest is None:
        raise FileNotFoundError(f"no report {prefix}*{suffix} in {folder}")
    records = R.blocks_to_records(RD.read_search_report(spark, newest["path"]))
    WR.write_json_records(records, out)
    return spark.read.schema(records.schema).json(out)


def single_lookup(owners: DataFrame, results: DataFrame, name: str, owner_col: str = "owner") -> DataFrame:
    return owner_pipeline(owners.where(F.col(owner_col) == name), results.where(F.col("owner") == name), owner_col)


def owner_pipeline_overlap(owners: DataFrame, results: DataFrame, batch: int = 5,
                           owner_col: str = "owner", order_col: str = "record_id") -> DataFrame:
    """Owners scored with the overlap matcher, with batch and lane numbers."""
    o = owners.select(F.col(owner_col).alias("owner")).distinct()
    numbered = W.number_rows(o, ["owner"], "n")
    first = M.first_per_group(results, "owner", [order_col])
    j = numbered.join(first, "owner", "left")
    j = j.select("*", N.normalize_words("owner").alias("_sn"), N.normalize_words("company_name").alias("_cn"))
    sc = S.match_score_overlap(F.col("owner"), F.col("company_name"), "_sn", "_cn")
    return j.select("n", W.batch_number(F.col("n"), batch).alias("batch"),
                    W.batch_position(F.col("n"), batch).alias("batch_pos"),
                    "owner", "company_name", sc["is_match"].alias("is_match"),
                    sc["confidence"].alias("confidence"))


def owner_pipeline_concurrent(owners: DataFrame, searches: DataFrame, batch: int = 5, lanes: int = 3, owner_col: str = "owner",
                              order_col: str = "search_no", min_len: int = 3, classify: bool = True) -> DataFrame:
    """The concurrent flow as a whole, one row per owner: the rule chain (``classify``), numbers in sort order with batch, place in the
    batch and lane, the owner's search (the first by ``order_col`` of several), the company that its page names, the overlap
    matcher's verdict and the report entry.

    ``searches``: ``business_name, html_content, success, error_message, search_time`` and ``order_col``; ``success`` NULL counts
    as a failure, and an owner without a search is kept as ``not_searched``. Pages are parsed where they lie; only fields travel."""
    o = owners.select(F.col(owner_col).alias("owner")).where(F.col("owner").isNotNull()).distinct()
    if classify:
        o = o.where(O.classify_owner("owner", min_len)["keep"])
    numbered = W.number_rows(o, ["owner"], "n")
    parsed = searches.select(F.col("business_name").alias("owner"), F.col(order_col).alias("_order"), F.coalesce("success", F.lit(False)).alias("success"),
                             "error_message", "search_time",
                             F.when(F.col("success"), P.extract_concurrent_fields("html_content", F.col("business_name"))).alias("_c"))
    got = parsed.select("owner", "_order", "success", "error_message", "search_time", F.col("_c.company_name"), F.col("_c.corporation_number"),
                        F.col("_c.status").alias("company_status"), F.col("_c.business_type"), F.col("_c.incorporation_date"), F.col("_c.location"))
    j = numbered.join(M.first_per_group(got, "owner", ["_order"]), "owner", "left")
    j = j.select("*", R.search_outcome("success", "company_name").alias("status"),
                 N.normalize_words("owner").alias("_sn"), N.normalize_words("company_name").alias("_cn"))
    j = j.select("*", S.match_score_overlap(F.col("owner"), F.col("company_name"), "_sn", "_cn").alias("_m"))
    j = j.select("*", F.col("_m.is_match").alias("is_match"), F.col("_m.confidence").alias("confidence"))
    company = {"COMPANY NAME": F.col("company_name"), "STATUS": F.col("company_status"), "BUSINESS TYPE": F.col("business_type"),
               "INCORPORATION DATE": F.col("incorporation_date")}
    entry = R.render_search_entry(F.col("n"), F.col("owner"), F.col("status"), F.col("error_message"), F.col("search_time"), company,
                                  F.col("is_match"), F.col("confidence"))
    return j.select("n", W.batch_number("n", batch).alias("batch"), W.batch_position("n", batch).alias("batch_pos"), W.round_robin("n", lanes).alias("lane"),
                    "owner", "status", "company_name", "corporation_number", "company_status", "business_type", "incorporation_date", "location",
                    "is_match", "confidence", entry.alias("entry"))


def lookup_stats_pipeline(log: DataFrame, by: list | None = None) -> DataFrame:
    return ST.lookup_stats(log.where(F.col("success")), *([by] if by else []))


__all__ = ["lookups", "overlay_pages", "owner_pipeline", "parsed_report", "business_type_report", "unmatched_report",
           "search_sections", "search_report_sink", "search_report_to_json", "latest_search_report_to_json", "single_lookup", "owner_pipeline_overlap", "owner_pipeline_concurrent",
           "lookup_stats_pipeline"]
