"""The registered queries (one per operator family of the survey inventory).

Every query reads whole driver tables (or data Spark derives from them).
Each ``@register`` pairs the Spark plan with its DuckDB oracle text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nomen.functions import names as N
from nomen.functions import score as S
from nomen.operators import owners as O
from nomen.plans import inputs as I
from nomen.plans import oracle as Q
from nomen.plans.catalog import register

# ---------------------------------------------------------------------------
# owners: projection, classification, counts

_OWNERS_SQL = (f"SELECT DISTINCT {Q.py_strip('raw_owner')} AS owner FROM ({Q.part_owners()}) "
               f"WHERE {Q.py_strip('raw_owner')} <> ''")
_CLASSIFIED_SQL = (f"SELECT owner, rule IN ('private', 'person') AS keep, rule, "
                   f"{Q.exclusion_reason('owner', 'rule IN (' + chr(39) + 'private' + chr(39) + ', ' + chr(39) + 'person' + chr(39) + ')')} AS reason "
                   f"FROM (SELECT owner, {Q.classify_rule('owner')} AS rule FROM ({_OWNERS_SQL}))")


def _owner_records(spark, sf):
    """The registry records of every part owner. Owners are the hashed side: the records, by far the more and wider rows,
    are not sorted for the join."""
    raw = I.part_owners(spark, sf).select("owner_id", N.py_strip("raw_owner").alias("owner"))
    return raw.hint("shuffle_hash").join(I.registry_records(spark, sf), F.col("owner_id") == F.col("part_key"))


def _owners(spark, sf):
    raw = I.part_owners(spark, sf)
    o = raw.select(N.py_strip("raw_owner").alias("owner")).where(F.col("owner") != "")
    return o


@register("classify_owner", _CLASSIFIED_SQL)
def q_classify_owner(spark, sf):
    """project_owner -> distinct -> classify_owner + exclusion_reason."""
    return O.classify_owners(_owners(spark, sf))


_CLASSIFIED_NOLEN_SQL = (f"SELECT owner, rule IN ('private', 'person') AS keep, rule "
                         f"FROM (SELECT owner, {Q.classify_rule('owner', 0)} AS rule FROM ({_OWNERS_SQL}))")


@register("classify_owner_no_min_len", _CLASSIFIED_NOLEN_SQL)
def q_classify_owner_nolen(spark, sf):
    """classify_owner(min_len=0): the variant without the length rule."""
    return O.classify_owners(_owners(spark, sf), min_len=0).drop("reason")


@register("owner_counts", f"SELECT keep, rule, count(*) AS n_owners FROM ({_CLASSIFIED_SQL}) GROUP BY ROLLUP (keep, rule)")
def q_owner_counts(spark, sf):
    """owner_counts: owners per (keep, rule) with rollup totals (distinct_owners first)."""
    return O.owner_counts(O.classify_owners(_owners(spark, sf)))


@register("reason_counts",
          f"SELECT CAST(count_if(keep) AS BIGINT) AS n_kept, CAST(count_if(NOT keep) AS BIGINT) AS n_excluded, "
          f"CAST(count_if(reason = 'LTD/LIMITED') AS BIGINT) AS n_ltd_limited FROM ({_CLASSIFIED_SQL})")
def q_reason_counts(spark, sf):
    """Kept / excluded totals and the LTD/LIMITED reason group (exclusion_reason)."""
    return O.reason_counts(O.classify_owners(_owners(spark, sf)))


# ---------------------------------------------------------------------------
# name functions on the search names (every three-word piece of every document)

_NAMES_SQL = f"SELECT DISTINCT search_name AS name FROM ({Q.search_names()})"


@register("normalize_name",
          f"SELECT name, norm, {Q.set_key('vars')} AS variations, {Q.set_key('terms')} AS terms, coop, "
          f"{Q.normalize_words('name')} AS words, {Q.normalize_name_simple('name')} AS simple, "
          f"{Q.abbreviation(Q.normalize_name_simple('name'))} AS abbr "
          f"FROM ({Q.profile_select(_NAMES_SQL, 'name')})")
def q_normalize_name(spark, sf):
    """normalize_name, name_variations, name_terms, coop_flag, normalize_words,
    normalize_name_simple and abbreviation on every distinct search name."""
    names = I.search_names(spark, sf).select(F.col("search_name").alias("name")).distinct()
    p = N.with_name_profile(names, "name")
    p = p.select("*", N.normalize_name_simple("name").alias("simple"))
    return p.select(
        "name", "norm", N.set_key("vars").alias("variations"), N.set_key("terms").alias("terms"), "coop",
        N.normalize_words("name").alias("words"), "simple", N.initials(F.split("simple", " ")).alias("abbr"))


# ---------------------------------------------------------------------------
# match joins: owner names (one per part) against the names of all registry
# records (one per order line)

from nomen.operators import match as M  # noqa: E402

_S_PROFILE = Q.profile_select(
    f"SELECT DISTINCT raw_owner AS owner FROM ({Q.part_owners()}) WHERE raw_owner IS NOT NULL", "owner")
_C_PROFILE = Q.profile_select(
    f"SELECT DISTINCT company_name AS company FROM ({Q.registry_names()}) WHERE company_name IS NOT NULL", "company")
_BEST_SQL = f"""
WITH s AS ({_S_PROFILE}), c AS ({_C_PROFILE}),
p AS (SELECT s.owner, c.company, {Q.tier_sql('s.vars', 's.terms', 's.coop', 'c.vars', 'c.terms', 'c.coop')} AS conf
      FROM s CROSS JOIN c),
r AS (SELECT owner, company, conf, row_number() OVER (PARTITION BY owner ORDER BY conf DESC, company) AS rn FROM p)
SELECT owner, CASE WHEN conf > 0 THEN company END AS matched_name, CAST(conf AS DOUBLE) AS confidence,
       {Q.tier_name('conf')} AS tier, conf > 0 AS is_match
FROM r WHERE rn = 1
"""


@register("match_join_best", _BEST_SQL)
def q_match_join_best(spark, sf):
    """Flagship: blocked owner x registry match, one best company per owner
    (match_join_direct + match_join_terms + match_join_substring + best_match).
    The oracle is the brute-force cross join of all pairs."""
    return M.best_match(I.part_owners(spark, sf), I.registry_names(spark, sf),
                        owner_col="raw_owner", company_col="company_name")


# ---------------------------------------------------------------------------
# 1:1 scores (zip_results: each search name with its own registry name), over
# every three-word piece of every document

from nomen.functions import text as T  # noqa: E402
from nomen.operators import pages as P  # noqa: E402
from nomen.operators import reports as R  # noqa: E402
from nomen.operators import windows as W  # noqa: E402

_PAIRS_SQL = Q.name_pairs()
_SC_S = Q.profile_select(_PAIRS_SQL, "search_name")
_SC_SC = ("SELECT doc_id, piece_no, search_name, company_name, vars AS s_vars, terms AS s_terms, coop AS s_coop "
          f"FROM ({_SC_S})")
_SC_ALL = Q.profile_select(_SC_SC, "company_name")
_SW = "list_distinct(list_filter(string_split(sn, ' '), lambda w: w <> ''))"
_CW = "list_distinct(list_filter(string_split(cn, ' '), lambda w: w <> ''))"
_OVER = f"len(list_intersect({_SW}, {_CW})) / len({_SW})"
_NS, _NC = Q.normalize_name_simple("search_name"), Q.normalize_name_simple("company_name")
_SCORES_SQL = f"""
SELECT doc_id, piece_no, search_name, company_name, CAST(conf AS DOUBLE) AS confidence, {Q.tier_name('conf')} AS tier,
       CASE WHEN sn <> '' AND cn <> '' AND (contains(cn, sn) OR contains(sn, cn)) THEN 1.0
            WHEN len({_SW}) > 0 AND {_OVER} >= 0.7 THEN {_OVER} ELSE 0.0 END AS overlap_confidence,
       coalesce(ns <> '' AND nc <> '' AND (
         len(list_filter(string_split(ns, ' '), lambda w: NOT list_contains(string_split(nc, ' '), w))) = 0
         OR len(list_filter(string_split(nc, ' '), lambda w: NOT list_contains(string_split(ns, ' '), w))) = 0
         OR contains({Q.abbreviation('nc')}, {Q.abbreviation('ns')}) OR contains({Q.abbreviation('ns')}, {Q.abbreviation('nc')})
         OR len(list_filter(string_split(ns, ' '), lambda w: contains(nc, w))) > 0
         OR len(list_filter(string_split(nc, ' '), lambda w: contains(ns, w))) > 0), false) AS loose_match
FROM (SELECT *, {Q.tier_sql('s_vars', 's_terms', 's_coop', 'vars', 'terms', 'coop')} AS conf,
             {Q.normalize_words('search_name')} AS sn, {Q.normalize_words('company_name')} AS cn,
             {_NS} AS ns, {_NC} AS nc FROM ({_SC_ALL}))
"""


@register("match_scores_1to1", _SCORES_SQL)
def q_match_scores(spark, sf):
    """zip_results + match_score + match_score_overlap + match_loose: every
    three-word piece of a document against its own registry spelling."""
    scored = M.score_pairs(I.name_pairs(spark, sf), "search_name", "company_name")
    staged = scored.select("*", N.normalize_words("search_name").alias("_sn"),
                           N.normalize_words("company_name").alias("_cn"),
                           N.normalize_name_simple("search_name").alias("_ns"),
                           N.normalize_name_simple("company_name").alias("_nc"))
    # once per pair: the matcher asks for either abbreviation twice
    staged = staged.select("*", N.initials(F.split("_ns", " ")).alias("_sa"), N.initials(F.split("_nc", " ")).alias("_ca"))
    ov = S.match_score_overlap(F.col("search_name"), F.col("company_name"), "_sn", "_cn")
    return staged.select("doc_id", "piece_no", "search_name", "company_name", "confidence", "tier",
                         ov["confidence"].alias("overlap_confidence"),
                         S.match_loose(F.col("search_name"), F.col("company_name"), "_ns", "_nc", "_sa", "_ca").alias("loose_match"))


# ---------------------------------------------------------------------------
# page extraction on result pages rendered from the registry (src oracle)

_REG = Q.registry_records()
_SEEN = Q.page_records()


@register("extract_listing",
          f"SELECT company_name || ' (' || corporation_number || ')' AS business_name, "
          f"coalesce(business_type, 'N/A') AS business_type, coalesce(registration_date, 'N/A') AS inc_date, "
          f"coalesce(address, 'N/A') AS location, coalesce(status, 'N/A') AS status FROM ({_SEEN})")
def q_extract_listing(spark, sf):
    """split_result_blocks + extract_listing over rendered result pages."""
    blocks = P.split_result_blocks(I.registry_pages(spark, sf), keys=("page_key",))
    return P.extract_listing(blocks).select("business_name", "business_type", "inc_date", "location", "status")


@register("extract_details",
          f"SELECT company_name, corporation_number, full_registry_type AS registry_type, status, address, business_type, "
          f"incorporation_date, amalgamation_date, CASE WHEN incorporation_date IS NOT NULL THEN registration_day END AS incorporation_day, "
          f"CASE WHEN amalgamation_date IS NOT NULL THEN registration_day END AS amalgamation_day FROM ({_SEEN})")
def q_extract_details(spark, sf):
    """extract_details (name without number, number, registry, status,
    address, type, both dates as text and DATE) over rendered result pages."""
    blocks = P.split_result_blocks(I.registry_pages(spark, sf), keys=("page_key",))
    return P.extract_details(blocks).drop("page_key", "pos")


@register("extract_previous_names",
          f"SELECT company_name || ' (' || corporation_number || ')' AS business_name, CASE WHEN form = 7 THEN "
          f"'OLD ' || company_name || '; EX ' || company_name ELSE '' END AS previous_names FROM ({_SEEN})")
def q_extract_previous_names(spark, sf):
    """extract_previous_names of every result block (name list joined by "; ")."""
    blocks = P.split_result_blocks(I.registry_pages(spark, sf), keys=("page_key",))
    return blocks.select(P.LISTING_FIELDS[0].column(F.col("block")).alias("business_name"),
                         F.array_join(P.extract_previous_names("block"), "; ").alias("previous_names"))


_NO_PAGES = "SELECT 'supplier ' || CAST(s_suppkey AS VARCHAR) AS search FROM supplier"


@register("count_results",
          f"SELECT {Q.page_key('company_name', 'business_type', 'record_id')} AS page_key, CAST(count(*) AS INTEGER) AS n_results, "
          f"count(*) >= 8 AS saturated, false AS no_results FROM ({_REG}) GROUP BY 1 "
          f"UNION ALL SELECT search || '#0', 0, false, true FROM ({_NO_PAGES})")
def q_count_results(spark, sf):
    """count_results + saturated_page + no_results_flag per rendered page."""
    pg = I.registry_pages(spark, sf)
    return pg.select("page_key", P.count_results("html").alias("n_results"),
                     P.saturated_page("html").alias("saturated"), T.no_results_flag("html").alias("no_results"))


@register("extract_concurrent_fields",
          f"SELECT company_name, corporation_number, 'Found' AS status FROM ({_REG})")
def q_extract_concurrent_fields(spark, sf):
    """extract_concurrent_fields: name and number of the link text of every result block."""
    blocks = P.split_result_blocks(I.registry_pages(spark, sf), keys=("page_key", "search"))
    c = P.extract_concurrent_fields("block", F.col("search"))
    return blocks.select(c.alias("c")).select("c.company_name", "c.corporation_number", "c.status")


@register("no_results_record",
          f"SELECT search AS company_name, 'No Results Found' AS status, 'N/A' AS location FROM ({_NO_PAGES})")
def q_no_results_record(spark, sf):
    """no_results_record: the placeholder of every page that says there are no results."""
    pg = I.registry_pages(spark, sf).where(T.no_results_flag("html"))
    return pg.select(P.no_results_record(F.col("search")).alias("r")).select("r.company_name", "r.status", "r.location")


@register("label_values",
          f"SELECT record_id, part_key, 'STATUS' AS label, status AS value FROM ({_REG}) WHERE status IS NOT NULL "
          f"UNION ALL SELECT record_id, part_key, 'REGISTERED', registration_date FROM ({_REG})")
def q_label_values(spark, sf):
    """extract_label_value: ``label: value`` and ``<b>label</b> value`` rows of every record."""
    rows = F.array(F.concat(F.lit("Status: "), F.col("status")),
                   F.concat(F.lit("<b>Registered</b> "), F.col("registration_date"), F.lit("<br>")))
    # read in the record's own row: a filter on rows of their own would read each of them a second time
    found = F.filter(F.transform(rows, P.extract_label_value), lambda x: x.isNotNull())
    x = I.registry_records(spark, sf).select("record_id", "part_key", F.explode_outer(found).alias("x"))
    return x.where(F.col("x").isNotNull()).select("record_id", "part_key", "x.label", "x.value")


@register("field_maps",
          f"SELECT record_id, part_key, company_name AS name, coalesce(status, 'unknown') AS status, business_type AS type, "
          f"address, 4 AS n_keys FROM ({_REG})")
def q_field_maps(spark, sf):
    """standardize_fields (alias keys renamed) and overlay_details (detail values win) on every record."""
    r = I.registry_records(spark, sf)
    info = F.create_map(F.lit("COMPANY-NAME"), F.col("company_name"), F.lit("BUSINESS-TYPE"), F.col("business_type"),
                        F.lit("STATUS"), F.lit("unknown"), F.lit("ADDRESS"), F.lit("unknown"))
    r = r.select("record_id", "part_key", "status", "address", R.standardize_fields(info).alias("info"))
    detail = F.map_filter(F.create_map(F.lit("STATUS"), F.col("status"), F.lit("ADDRESS"), F.col("address")), lambda k, v: v.isNotNull())
    r = r.select("record_id", "part_key", R.overlay_details("info", detail).alias("m"))
    m = F.col("m")
    return r.select("record_id", "part_key", m["COMPANY NAME"].alias("name"), m["STATUS"].alias("status"),
                    m["BUSINESS TYPE"].alias("type"), m["ADDRESS"].alias("address"), F.size("m").alias("n_keys"))


def _cands_sql():
    def stripped(x):
        v = rf"regexp_replace({x}, '\s*<[^>]+>\s*', '', 'g')"
        for ent, ch in Q.ENTITIES:
            v = f"replace({v}, {Q.q(ent)}, {Q.q(ch)})"
        return f"trim({v})"
    parts = ", ".join(f"regexp_extract_all(html, {Q.q(f'(?is){start}(.*?)</{tag}>')}, 1)" for start, tag in Q.CANDIDATE_TAGS)
    nav = ", ".join(Q.q(w) for w in Q.NAV_WORDS)
    return (f"list_filter(list_transform(flatten([{parts}]), lambda x: {stripped('x')}), "
            f"lambda x: length(x) BETWEEN 3 AND 100 AND lower(x) NOT IN ({nav}))")


_CANDS = _cands_sql()
_PAGES_SQL = f"""
SELECT page_id, CAST(length(html) AS INTEGER) AS page_size,
  {Q.element_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  {Q.element_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1,
  CAST(len(regexp_extract_all(html, '(?i)<li[\\s>]')) AS INTEGER) AS n_items,
  CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS INTEGER) AS n_links,
  coalesce(regexp_matches(html, '(?i)no results found|no matches'), false) AS no_results,
  CAST(length(html) AS INTEGER) AS raw_len,
  CASE WHEN len({_CANDS}) = 0 THEN NULL ELSE list_reduce({_CANDS}, lambda acc, x: CASE WHEN length(x) > length(acc) THEN x ELSE acc END) END AS best_candidate
FROM pages
"""


@register("page_features", _PAGES_SQL)
def q_page_features(spark, sf):
    """page_size, title/h1 text, item and link counts, no_results_flag,
    the uncut page, extract_company_candidates on the pages table."""
    return P.page_features(I.table(spark, sf, "pages"))


# ---------------------------------------------------------------------------
# lookup report: owners (part) with their first registry result, rendered,
# cut back into entries and parsed (src oracle: the same facts from the rows)

from nomen.plans import pipelines as PL  # noqa: E402


def _report_parsed(spark, sf):
    owners = _owners(spark, sf)
    res = _owner_records(spark, sf)
    entries = PL.owner_pipeline(owners, res)
    return PL.parsed_report(entries)


_OWN_ALL = f"SELECT owner_id, {Q.py_strip('raw_owner')} AS owner FROM ({Q.part_owners()})"
# the first registry record of every owner name
_FIRST_OF_OWNER = f"""
SELECT * EXCLUDE (rn, owner_id) FROM (
  SELECT w.owner, w.owner_id, r.*, row_number() OVER (PARTITION BY w.owner ORDER BY r.record_id, w.owner_id) AS rn
  FROM ({_OWN_ALL}) w JOIN ({_REG}) r ON r.part_key = w.owner_id) WHERE rn = 1
"""
_ENTRY_SRC = f"""
SELECT n.lookup_number, r.* FROM
  (SELECT owner, row_number() OVER (ORDER BY owner) AS lookup_number
     FROM (SELECT DISTINCT owner FROM ({_OWN_ALL}) WHERE owner <> '')) n
  JOIN ({_FIRST_OF_OWNER}) r ON r.owner = n.owner
WHERE length(n.owner) >= 3
"""
_E1 = Q.profile_select(_ENTRY_SRC, "owner")
_E2 = ("SELECT lookup_number, owner, company_name, corporation_number, registry_type, status, address, "
       "business_type, registration_date, vars AS s_vars, terms AS s_terms, coop AS s_coop FROM (" + _E1 + ")")
_E3 = Q.profile_select(_E2, "company_name")
_DIRECT = (f"len(list_filter({Q.debug_variations(Q.normalize_words('owner'))}, "
           f"lambda v: contains({Q.normalize_words('lower(company_name)')}, v))) > 0")
_PARSED_SRC = f"""
SELECT lookup_number, owner AS search_name, company_name, business_type, status, address,
       CASE WHEN conf > 0 THEN 'YES' ELSE 'NO' END AS match_found,
       CASE WHEN conf > 0 THEN {Q.format_percent('conf')} END AS confidence,
       CASE WHEN conf > 0 THEN company_name END AS closest_match,
       (conf > 0 AND {_DIRECT}) AS direct_match,
       (company_name IS NOT NULL)::INT + (corporation_number IS NOT NULL)::INT + (registry_type IS NOT NULL)::INT
       + (status IS NOT NULL)::INT + (address IS NOT NULL)::INT + (business_type IS NOT NULL)::INT
       + (registration_date IS NOT NULL)::INT AS n_detail
FROM (SELECT *, {Q.tier_sql('s_vars', 's_terms', 's_coop', 'vars', 'terms', 'coop')} AS conf FROM ({_E3}))
"""


@register("lookup_report_parse",
          "SELECT CAST(lookup_number AS INTEGER) AS lookup_number, search_name, company_name AS company, business_type, match_found, confidence, "
          f"closest_match, direct_match, n_detail FROM ({_PARSED_SRC})")
def q_lookup_report_parse(spark, sf):
    """owner_pipeline -> render_lookup_report -> report files ->
    split_report_entries -> parse_entry_direct (round trip)."""
    p = _report_parsed(spark, sf)
    d = F.col("detail")
    return p.select("lookup_number", "search_name", d["COMPANY NAME"].alias("company"),
                    d["BUSINESS TYPE"].alias("business_type"), "match_found", "confidence", "closest_match",
                    "direct_match", F.size("detail").alias("n_detail"))


@register("filter_business_type",
          "SELECT row_number() OVER (ORDER BY lookup_number) AS i, search_name, "
          "coalesce(company_name, search_name, 'Unknown') AS company_display, coalesce(status, 'Unknown') AS status_display, "
          f"coalesce(address, 'Unknown') AS address_display FROM ({_PARSED_SRC}) "
          "WHERE lower(trim(coalesce(business_type, ''))) = lower('Not-for-Profit Corporation')")
def q_filter_business_type(spark, sf):
    """filter_business_type (default type) + numbered summary (number_rows)."""
    return PL.business_type_report(_report_parsed(spark, sf)).drop("line")


@register("filter_unmatched",
          "SELECT row_number() OVER (ORDER BY lookup_number) AS i, search_name, "
          "coalesce(company_name, closest_match, 'Unknown') AS found, coalesce(match_found, 'Unknown') AS match_found, "
          f"coalesce(confidence, 'N/A') AS confidence FROM ({_PARSED_SRC}) WHERE NOT coalesce(direct_match, false)")
def q_filter_unmatched(spark, sf):
    """filter_unmatched (no direct match in the debug section) + numbering."""
    return PL.unmatched_report(_report_parsed(spark, sf)).drop("original_entry", "status", "address")


@register("available_types",
          f"SELECT DISTINCT business_type FROM ({_PARSED_SRC}) WHERE business_type IS NOT NULL")
def q_available_types(spark, sf):
    """available_types over all entries (limit=None)."""
    return R.available_types(_report_parsed(spark, sf))


# ---------------------------------------------------------------------------
# search report (prefix searches) -> blocks -> distinct -> pairs -> records

@register("search_report_records",
          f"SELECT DISTINCT company_name || ' (' || corporation_number || ')' AS business_name, "
          f"coalesce(business_type, 'N/A') AS business_type, coalesce(registration_date, 'N/A') AS inc_date, "
          f"coalesce(address, 'N/A') AS location, coalesce(status, 'N/A') AS status FROM ({_SEEN})")
def q_search_report_records(spark, sf):
    """render search-report sections per page -> split_search_blocks ->
    keep_data_blocks -> dedupe_blocks -> parse_pairs_strict -> records."""
    return PL.search_report_to_json(PL.search_sections(I.registry_pages(spark, sf)))


# ---------------------------------------------------------------------------
# search-log statistics on events (error = failed search, value = seconds)

from nomen.operators import stats as ST  # noqa: E402


def search_log(spark, sf):
    """``events`` as a search log (F6 shape)."""
    e = I.table(spark, sf, "events")
    return e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("business_name"),
                    # every seventh search finds a page that says there are no results
                    F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("<p>No results found</p>")).otherwise(F.col("props")).alias("html_content"),
                    (F.col("event_type") != "error").alias("success"),
                    F.when(F.col("event_type") == "error", F.lit("search failed")).alias("error_message"),
                    F.col("value").alias("search_time"),
                    F.length("props").cast("long").alias("response_size"),
                    "user_id", "event_type", "ts")


_LOG_SQL = ("SELECT 'user ' || CAST(user_id AS VARCHAR) AS business_name, event_type <> 'error' AS success, "
            "value AS search_time, user_id FROM events")


@register("lookup_stats",
          "SELECT user_id, count(*) AS n_searches, CAST(count_if(success) AS BIGINT) AS n_success, round(sum(search_time), 6) AS total_seconds, "
          "round(sum(search_time) / count(*), 6) AS avg_seconds, round(count(*) / sum(search_time), 6) AS per_second, "
          "round(count(*) * 10.0 / sum(search_time), 6) AS speedup, "
          "round(CASE WHEN sum(search_time) / count(*) > 0 THEN (sum(search_time) / count(*) - "
          "sum(CASE WHEN success THEN search_time END) / count_if(success)) / (sum(search_time) / count(*)) * 100 END, 6) AS gain_pct "
          f"FROM ({_LOG_SQL}) GROUP BY user_id")
def q_lookup_stats(spark, sf):
    """lookup_stats + relative_gain per user of the search log."""
    return ST.lookup_stats(search_log(spark, sf), ["user_id"])


@register("search_success_counts",
          "SELECT count(*) AS n_searches, CAST(count_if(success) AS BIGINT) AS n_success, round(sum(search_time) / count(*), 6) AS avg_seconds "
          f"FROM ({_LOG_SQL})")
def q_search_success_counts(spark, sf):
    """search_success_counts: searches, successes, average seconds (events as a search log)."""
    return ST.search_success_counts(search_log(spark, sf))


@register("results_per_search",
          f"SELECT lower(left(company_name, 1)) || ' (' || business_type || ')' AS search, count(*) AS n_results "
          f"FROM ({_REG}) GROUP BY 1 UNION ALL SELECT search, 0 FROM ({_NO_PAGES})")
def q_results_per_search(spark, sf):
    """results_per_search: result blocks per search label over the rendered pages, searches without results too."""
    return ST.results_per_search(I.registry_pages(spark, sf))


@register("search_sections",
          f"SELECT {Q.page_key('company_name', 'business_type', 'record_id')} AS page_key, 'Found' AS status, "
          f"CAST(count(*) AS INTEGER) AS n_results FROM ({_REG}) GROUP BY 1 "
          f"UNION ALL SELECT search || '#0', 'No Data', 0 FROM ({_NO_PAGES})")
def q_search_sections(spark, sf):
    """search_report_sink: a section per search page, with its status; searches without results have one too."""
    s = PL.search_sections(I.registry_pages(spark, sf))
    return s.select(F.col("file_no").alias("page_key"), F.regexp_extract("value", "\nStatus: (.*)\n", 1).alias("status"),
                    F.regexp_extract("value", "\nResults Found: (\\d+)\n", 1).cast("int").alias("n_results"))


@register("search_report_sections",
          f"SELECT {Q.page_key('company_name', 'business_type', 'record_id')} AS file_no, lower(left(company_name, 1)) AS prefix, business_type, "
          f"'Found' AS status, round(count(*) / 10, 2) AS seconds, CAST(count(*) AS INTEGER) AS n_results, CAST(count(*) AS INTEGER) AS n_blocks "
          f"FROM ({_REG}) GROUP BY ALL UNION ALL SELECT search || '#0', NULL, NULL, 'No Data', 0.0, 0, 0 FROM ({_NO_PAGES})")
def q_search_report_sections(spark, sf):
    """A search report written and read back by section: label taken apart, status, time, and the number of results as
    stated and as found."""
    s = R.split_search_sections(PL.search_sections(I.registry_pages(spark, sf)))
    return s.select("file_no", "prefix", "business_type", "status", "seconds", "n_results", F.size("blocks").alias("n_blocks"))


@register("lookup_stats_success",
          "SELECT user_id, count(*) AS n_searches, CAST(count(*) AS BIGINT) AS n_success, round(sum(search_time), 6) AS total_seconds "
          f"FROM ({_LOG_SQL}) WHERE success GROUP BY user_id")
def q_lookup_stats_success(spark, sf):
    """lookup_stats_pipeline: statistics of the successful searches per user."""
    return PL.lookup_stats_pipeline(search_log(spark, sf), ["user_id"]).select("user_id", "n_searches", "n_success", "total_seconds")


# ---------------------------------------------------------------------------
# prefix partition of registry names per business type (cap 20, no depth limit)

PREFIX_CAP = 20


def _prefix_sql(cap=PREFIX_CAP):
    """Level by level; only names under a saturated prefix go on."""
    return f"""
WITH RECURSIVE b AS (SELECT business_type, lower(company_name) AS nm, count(*) AS c FROM ({_REG})
                     WHERE company_name IS NOT NULL AND company_name <> '' GROUP BY 1, 2),
w AS (SELECT business_type, nm, c, 1 AS depth, CAST(sum(c) OVER (PARTITION BY business_type, left(nm, 1)) AS BIGINT) AS n FROM b
      UNION ALL
      SELECT business_type, nm, c, depth + 1, CAST(sum(c) OVER (PARTITION BY business_type, left(nm, depth + 1)) AS BIGINT)
      FROM w WHERE n >= {cap} AND length(nm) >= depth)
SELECT DISTINCT business_type, left(nm, depth) AS prefix, CAST(depth AS INTEGER) AS depth, n AS n_names
FROM w WHERE n < {cap} OR length(nm) < depth
"""


@register("prefix_partition", _prefix_sql())
def q_prefix_partition(spark, sf):
    """prefix_partition: leaf name prefixes with < cap names per business type."""
    r = I.registry_records(spark, sf)
    return ST.prefix_partition(r, "company_name", ["business_type"], cap=PREFIX_CAP) \
        .select("business_type", "prefix", "depth", "n_names")


# ---------------------------------------------------------------------------
# owner lists, numbering, batches, lanes, counts

@register("owner_lists",
          f"SELECT row_number() OVER (PARTITION BY keep ORDER BY owner) AS i, owner, keep, reason FROM ({_CLASSIFIED_SQL})")
def q_owner_lists(spark, sf):
    """write_owner_lists as a table: split_owners -> sort_owners ->
    number_rows per list (kept / excluded)."""
    kept, skipped = O.split_owners(O.classify_owners(_owners(spark, sf)))
    k = W.number_rows(kept, ["owner"], "i")
    s = W.number_rows(skipped, ["owner"], "i")
    return k.unionByName(s).select("i", "owner", "keep", "reason")


@register("rule_trace", f"SELECT owner FROM ({_CLASSIFIED_SQL}) WHERE rule NOT IN ('empty', 'short', 'ltd')")
def q_rule_trace(spark, sf):
    """write_rule_trace: names that passed the LTD/LIMITED rule."""
    return O.rule_trace(O.classify_owners(_owners(spark, sf)))


@register("batch_lanes",
          "SELECT n, (n - 1) // 5 + 1 AS batch, (n - 1) % 5 + 1 AS batch_pos, CAST((n - 1) % 2 AS INTEGER) AS lane, owner "
          f"FROM (SELECT owner, row_number() OVER (ORDER BY owner) AS n FROM ({_OWNERS_SQL}))")
def q_batch_lanes(spark, sf):
    """batch_number (batches of 5) and round_robin (2 lanes) over numbered owners."""
    n = W.number_rows(_owners(spark, sf).distinct(), ["owner"], "n")
    return n.select("n", W.batch_number(F.col("n"), 5).alias("batch"), W.batch_position(F.col("n"), 5).alias("batch_pos"),
                    W.round_robin(F.col("n"), 2).alias("lane"), "owner")


@register("match_counts", f"SELECT CAST(count_if(is_match) AS BIGINT) AS n_matched, count(*) AS n_total FROM ({_BEST_SQL})")
def q_match_counts(spark, sf):
    """match_counts over the flagship best-match result."""
    return ST.match_counts(q_match_join_best(spark, sf))


@register("owners_matched",
          f"SELECT owner FROM ({_BEST_SQL}) WHERE is_match")
def q_owners_matched(spark, sf):
    """owners_matched: left_semi join of owners with their matches."""
    owners = I.part_owners(spark, sf).select(F.col("raw_owner").alias("owner")).distinct()
    return M.owners_matched(owners, q_match_join_best(spark, sf))


# ---------------------------------------------------------------------------
# Python fallback parser (mapInPandas) and the streaming path

import uuid  # noqa: E402

from nomen.operators import udf as U  # noqa: E402
from nomen.session import checkpoint_dir  # noqa: E402
from nomen.streaming import search_log as SL  # noqa: E402

_ALL_BLOCKS = f"""
SELECT lower(left(company_name, 1)) || ' (' || business_type || ')' AS business_name, true AS success,
       NULL::VARCHAR AS error_message, company_name || ' (' || corporation_number || ')' AS company_name,
       status, business_type, registration_date AS incorporation_date, address AS location
FROM ({_SEEN}) r
UNION ALL SELECT search, true, NULL, NULL, NULL, NULL, NULL, NULL FROM ({_NO_PAGES})
"""


@register("parse_pages_python", _ALL_BLOCKS)
def q_parse_pages_python(spark, sf):
    """parse_pages_with(parse_business_details): the standard-library HTML
    parser in mapInPandas, every result block of every page."""
    return U.parse_pages_with(I.registry_pages(spark, sf))


@register("parse_pages_tree", _ALL_BLOCKS)
def q_parse_pages_tree(spark, sf):
    """parse_business_details on the element tree: every result block of every page, no Python."""
    return P.parse_pages(I.registry_pages(spark, sf))


@register("parse_pages_mixed", _ALL_BLOCKS)
def q_parse_pages_mixed(spark, sf):
    """parse_pages_with only for pages with ill-fitting tags, expressions for the rest."""
    return U.parse_irregular_with(I.registry_pages(spark, sf))


@register("page_candidates")
def q_page_candidates(spark, sf):
    """The general flow on every page: candidate name (all selectors, else the first link) and label/value rows."""
    return P.company_candidate(I.table(spark, sf, "pages")).select("page_id", "company_name", "source", F.map_entries("details").alias("details"))


@register("stream_listing",
          f"SELECT company_name || ' (' || corporation_number || ')' AS business_name, "
          f"coalesce(business_type, 'N/A') AS business_type, coalesce(registration_date, 'N/A') AS inc_date, "
          f"coalesce(address, 'N/A') AS location, coalesce(status, 'N/A') AS status FROM ({_SEEN})")
def q_stream_listing(spark, sf):
    """stream_search_log: pages written as files are parsed by a streaming
    query (availableNow) and appended; the appended table is returned."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    I.registry_pages(spark, sf).write.parquet(f"{base}/src")
    q = SL.stream_listing(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("business_name", "business_type", "inc_date", "location", "status")


# ---------------------------------------------------------------------------
# cleaned results per page, registry filter, search status, JSON, dates

_FIRST_REC = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {Q.page_key('company_name', 'business_type', 'record_id')}
                                            ORDER BY record_id, company_name) AS rn FROM ({_SEEN})) WHERE rn = 1
"""


@register("cleaned_results",
          f"SELECT {Q.page_key('company_name', 'business_type', 'record_id')} AS page_key, "
          f"company_name || ' (' || corporation_number || ')' AS company, status, "
          f"replace(registration_date, ',', '') AS incorporation_date, 6 - (status IS NULL)::INT - (address IS NULL)::INT - (full_registry_type IS NULL)::INT AS n_keys, company_name AS first_name "
          f"FROM ({_FIRST_REC})")
def q_cleaned_results(spark, sf):
    """extract fields per block -> min_fields -> number_valid_results ->
    render_cleaned_results per page -> parse_result_sections (RESULT #1) +
    parse_first_name; standardize_date on date labels."""
    pages = I.registry_pages(spark, sf)
    blocks = P.split_result_blocks(pages, keys=("page_key",))
    f = P.extract_fields(blocks, P.LISTING_FIELDS + [P.REGISTRY_FIELD])
    pairs = F.filter(F.array(
        F.struct(F.lit("COMPANY NAME").alias("k"), F.col("business_name").alias("v")),
        F.struct(F.lit("REGISTRY TYPE").alias("k"), F.col("registry_type").alias("v")),
        F.struct(F.lit("STATUS").alias("k"), F.col("status").alias("v")),
        F.struct(F.lit("ADDRESS").alias("k"), F.col("location").alias("v")),
        F.struct(F.lit("BUSINESS TYPE").alias("k"), F.col("business_type").alias("v")),
        F.struct(F.lit("INCORPORATION DATE").alias("k"), T.standardize_date(F.col("inc_date")).alias("v"))),
        lambda e: e["v"].isNotNull())
    per_page = (f.select("page_key", F.struct("pos", pairs.alias("kv")).alias("x"))
                .groupBy("page_key").agg(F.array_sort(F.collect_list("x")).alias("xs")))
    text = R.render_cleaned_results(F.transform("xs", lambda x: x["kv"]))
    d = per_page.select("page_key", text.alias("t")).select("page_key", R.parse_result_sections("t").alias("m"),
                                                          R.parse_first_name("t").alias("first_name"))
    return d.select("page_key", F.col("m")["COMPANY NAME"].alias("company"), F.col("m")["STATUS"].alias("status"),
                    F.col("m")["INCORPORATION DATE"].alias("incorporation_date"), F.size("m").alias("n_keys"),
                    "first_name")


_NFP_TYPES = ["Co-operative Non-Share", "Co-operative with Share", "Not-for-Profit Corporation"]


@register("filter_registry",
          f"SELECT company_name || ' (' || corporation_number || ')' AS business_name, business_type, status "
          f"FROM ({_SEEN}) WHERE business_type IN ({', '.join(Q.q(t) for t in _NFP_TYPES)}) AND status = 'Active'")
def q_filter_registry(spark, sf):
    """filter_registry: business type in the three non-profit types, Active."""
    blocks = P.split_result_blocks(I.registry_pages(spark, sf), keys=("page_key",))
    return P.filter_registry(P.extract_listing(blocks), _NFP_TYPES).select("business_name", "business_type", "status")


@register("filter_registry_corporations",
          f"SELECT company_name, corporation_number, business_type, status FROM ({_SEEN}) "
          f"WHERE full_registry_type = 'Corporation' AND business_type IN ({', '.join(Q.q(t) for t in _NFP_TYPES)}) AND status = 'Active'")
def q_filter_registry_corporations(spark, sf):
    """filter_registry with all three predicates: the registry of corporations, the three non-profit types, Active."""
    blocks = P.split_result_blocks(I.registry_pages(spark, sf), keys=("page_key",))
    kept = P.filter_registry(P.extract_details(blocks), _NFP_TYPES, registry="Corporation")
    return kept.select("company_name", "corporation_number", "business_type", "status")


@register("search_status",
          "SELECT CASE WHEN event_type = 'error' THEN 'Error' WHEN event_id % 7 = 0 THEN 'No Data' "
          "ELSE 'Found' END AS status, count(*) AS n FROM events GROUP BY 1")
def q_search_status(spark, sf):
    """search_status (Found / No Data / Error) + filter_success counts."""
    log = search_log(spark, sf)
    return log.groupBy(P.search_status(F.col("success"), F.col("html_content")).alias("status")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("parse_json_props",
          "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_parse_json_props(spark, sf):
    """parse_json: JSON text of the search log -> typed column."""
    e = I.table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@register("registry_dates",
          f"SELECT record_id, part_key, replace(registration_date, ',', '') AS std_date, registration_day AS day_from_std, "
          f"registration_day AS day_from_text, "
          f"CAST(round(1.0 * count(*) OVER () * 7 / (5 * 2) / 60, 6) AS DOUBLE) AS planned_minutes FROM ({_REG})")
def q_registry_dates(spark, sf):
    """standardize_date, to_date in both spellings, expected_minutes."""
    r = I.registry_records(spark, sf)
    std = T.standardize_date(F.col("registration_date"))
    n = r.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated by Spark
    return r.select("record_id", "part_key", std.alias("std_date"), T.to_date_any(std).alias("day_from_std"),
                    T.to_date_any(F.col("registration_date")).alias("day_from_text"),
                    F.round(T.expected_minutes(n, 5, 2), 6).alias("planned_minutes"))


@register("lookup_status_counts",
          f"SELECT 'scored' AS status, count(*) AS n FROM ({_ENTRY_SRC}) "
          "UNION ALL SELECT 'no_page', count(DISTINCT s_name) FROM supplier "
          "UNION ALL SELECT 'not_parsed', count(DISTINCT c_name) FROM customer "
          "UNION ALL SELECT 'error', count(DISTINCT user_id) FROM events WHERE event_type = 'error' HAVING count(*) > 0")
def q_lookup_status_counts(spark, sf):
    """lookup_status: outcome per owner, counted. Part owners have registry records,
    suppliers no page, customers a page on which no company was found, users of the search log a failed search."""
    sup = I.table(spark, sf, "supplier").select(F.col("s_name").alias("owner"))
    cus = I.table(spark, sf, "customer").select(F.col("c_name").alias("owner"), F.col("c_custkey").alias("record_id"))
    res = _owner_records(spark, sf)
    bad = search_log(spark, sf).where(~F.col("success")).select(F.col("business_name").alias("owner"), F.col("error_message").alias("error")).distinct()
    owners = _owners(spark, sf).unionByName(sup).unionByName(cus.select("owner")).unionByName(bad.select("owner"))
    found = res.unionByName(cus, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
    return PL.owner_pipeline(owners, found).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("owner_pipeline_pages",
          "SELECT n.lookup_number, n.owner, s.company_name, s.corporation_number, coalesce(s.status, 'Listed') AS status, "
          "coalesce(s.address, 'Listed') AS address, s.amalgamation_date FROM "
          f"(SELECT owner, row_number() OVER (ORDER BY owner) AS lookup_number FROM ({_CLASSIFIED_SQL}) WHERE keep) n "
          f"JOIN ({_FIRST_OF_OWNER}) r ON r.owner = n.owner JOIN (SELECT DISTINCT * FROM ({_SEEN})) s ON s.record_id = r.record_id AND s.part_key = r.part_key")
def q_owner_pipeline_pages(spark, sf):
    """owner_pipeline with its classify step and overlay_details: kept owners only, numbered, with the first listed record
    of each under the details of its result page."""
    found = _owner_records(spark, sf)
    first = M.first_per_group(found, "owner", ["record_id"])
    block = P.render_result_block(*[F.col(c) for c in ("company_name", "corporation_number", "registry_type", "status", "business_type",
                                                       "registration_date", "address")], F.pmod("record_id", F.lit(I.N_BLOCK_FORMS)))
    pages = first.select("owner", P.render_page(F.array(block), F.lit(1)).alias("html"))
    listed = found.select("owner", "record_id", "company_name", F.lit("Listed").alias("status"), F.lit("Listed").alias("address"))
    got = PL.lookups(_owners(spark, sf), listed, classify=True, pages=pages)
    return got.select("lookup_number", "owner", "company_name", "corporation_number", "status", "address", "amalgamation_date")


@register("owners_without_page", "SELECT DISTINCT s_name AS owner FROM supplier")
def q_owners_without_page(spark, sf):
    """owners_without_page: owners (part owners and suppliers) that no registry record was found for."""
    res = _owner_records(spark, sf)
    sup = I.table(spark, sf, "supplier").select(F.col("s_name").alias("owner"))
    return M.owners_without_page(_owners(spark, sf).unionByName(sup).distinct(), res)


_OV_SN = Q.normalize_words("owner")
_OV_CN = Q.normalize_words("company_name")
_OV_SW = f"list_distinct(list_filter(string_split({_OV_SN}, ' '), lambda w: w <> ''))"
_OV_CW = f"list_distinct(list_filter(string_split({_OV_CN}, ' '), lambda w: w <> ''))"
_OV_R = f"len(list_intersect({_OV_SW}, {_OV_CW})) / len({_OV_SW})"
_OVERLAP_SQL = f"""
SELECT n, (n - 1) // 5 + 1 AS batch, (n - 1) % 5 + 1 AS batch_pos, owner, company_name,
  CASE WHEN company_name IS NULL OR company_name = '' THEN false
       WHEN {_OV_SN} <> '' AND {_OV_CN} <> '' AND (contains({_OV_CN}, {_OV_SN}) OR contains({_OV_SN}, {_OV_CN})) THEN true
       WHEN len({_OV_SW}) > 0 AND {_OV_R} >= 0.7 THEN true ELSE false END AS is_match,
  CASE WHEN company_name IS NULL OR company_name = '' THEN 0.0
       WHEN {_OV_SN} <> '' AND {_OV_CN} <> '' AND (contains({_OV_CN}, {_OV_SN}) OR contains({_OV_SN}, {_OV_CN})) THEN 1.0
       WHEN len({_OV_SW}) > 0 AND {_OV_R} >= 0.7 THEN {_OV_R} ELSE 0.0 END AS confidence
FROM (SELECT o.owner, row_number() OVER (ORDER BY o.owner) AS n, r.company_name
      FROM (SELECT DISTINCT owner FROM ({_OWN_ALL}) WHERE owner <> '') o
      JOIN ({_FIRST_OF_OWNER}) r ON r.owner = o.owner)
"""


@register("owner_pipeline_overlap", _OVERLAP_SQL)
def q_owner_pipeline_overlap(spark, sf):
    """owner_pipeline_overlap: numbered owners in batches of 5, each scored
    with the overlap matcher against its first registry result."""
    owners = _owners(spark, sf)
    res = _owner_records(spark, sf)
    return PL.owner_pipeline_overlap(owners, res)


# what the page of a search says, by the form of its search (see inputs.owner_searches)
_SEARCHED_SQL = f"""
SELECT owner, record_id, k = 5 AS failed, k = 3 AS unparsed,
  CASE WHEN k < 3 THEN company_name WHEN k = 4 THEN owner END AS company_name,
  CASE WHEN k < 3 THEN corporation_number WHEN k = 4 THEN 'N/A' END AS corporation_number,
  CASE k WHEN 0 THEN coalesce(status, 'Active') WHEN 1 THEN 'Active' WHEN 2 THEN 'Found' WHEN 4 THEN 'No Results Found' END AS company_status,
  CASE WHEN k = 0 THEN coalesce(business_type, 'N/A') WHEN k < 3 OR k = 4 THEN 'N/A' END AS business_type,
  CASE WHEN k = 0 THEN coalesce(registration_date, 'N/A') WHEN k < 3 OR k = 4 THEN 'N/A' END AS incorporation_date,
  CASE WHEN k = 0 THEN replace(address, ', Canada', ', Ontario, Canada') WHEN k < 3 OR k = 4 THEN 'N/A' END AS location
FROM (SELECT *, record_id % 6 AS k FROM ({_FIRST_OF_OWNER}))
"""
_CONCURRENT_SQL = f"""
SELECT n, (n - 1) // 5 + 1 AS batch, (n - 1) % 5 + 1 AS batch_pos, CAST((n - 1) % 3 AS INTEGER) AS lane, owner,
  CASE WHEN record_id IS NULL THEN 'not_searched' WHEN failed THEN 'search_failed' WHEN unparsed THEN 'not_parsed' ELSE 'scored' END AS status,
  company_name, corporation_number, company_status, business_type, incorporation_date, location,
  confidence > 0 AS is_match, confidence,
  CASE WHEN company_name IS NOT NULL THEN CASE WHEN confidence > 0 THEN 'YES' ELSE 'NO' END END AS entry_match,
  CASE WHEN record_id IS NULL THEN 'No search result' WHEN failed THEN 'timeout'
       WHEN unparsed THEN 'Search completed but could not parse company details' ELSE '' END AS entry_reason,
  CASE WHEN failed OR unparsed THEN CAST(record_id / 100 AS DOUBLE) END AS entry_seconds
FROM (SELECT o.owner, o.n, s.* EXCLUDE (owner),
        CASE WHEN company_name IS NULL OR company_name = '' THEN 0.0
             WHEN {_OV_SN.replace('owner', 'o.owner')} <> '' AND {_OV_CN} <> ''
                  AND (contains({_OV_CN}, {_OV_SN.replace('owner', 'o.owner')}) OR contains({_OV_SN.replace('owner', 'o.owner')}, {_OV_CN})) THEN 1.0
             WHEN len({_OV_SW.replace('owner', 'o.owner')}) > 0 AND {_OV_R.replace('owner', 'o.owner')} >= 0.7 THEN {_OV_R.replace('owner', 'o.owner')}
             ELSE 0.0 END AS confidence
      FROM (SELECT owner, row_number() OVER (ORDER BY owner) AS n FROM ({_CLASSIFIED_SQL}) WHERE keep) o
      LEFT JOIN ({_SEARCHED_SQL}) s ON s.owner = o.owner)
"""


@register("owner_pipeline_concurrent", _CONCURRENT_SQL)
def q_owner_pipeline_concurrent(spark, sf):
    """owner_pipeline_overlap with all its steps: classify, numbers, batches and lanes, one search per owner, the
    company of its page by extract_concurrent_fields (link, span, placeholder, none), the overlap matcher, and of the
    report entry the verdict, reason and time read back."""
    got = PL.owner_pipeline_concurrent(_owners(spark, sf), I.owner_searches(spark, sf))
    verdict = F.regexp_extract("entry", "\nMATCH FOUND: (.*)\n", 1)
    seconds = F.regexp_extract("entry", "\nSEARCH TIME: (.*) seconds\n", 1)
    return got.select(*[c for c in got.columns if c != "entry"], F.when(verdict != "", verdict).alias("entry_match"),
                      F.regexp_extract("entry", "\nREASON: (.*)\n", 1).alias("entry_reason"),
                      F.when(seconds != "", seconds).cast("double").alias("entry_seconds"))


@register("take_sample", f"SELECT owner FROM ({_OWNERS_SQL}) ORDER BY owner LIMIT 10")
def q_take_sample(spark, sf):
    """take_sample: the first ten distinct owner names (a top-k report)."""
    return O.take_sample(_owners(spark, sf), 10)


@register("sample_owners",
          f"SELECT owner, (SELECT greatest(count(*) - 5, 0) FROM ({_CLASSIFIED_SQL}) WHERE keep) AS more FROM ({_CLASSIFIED_SQL}) WHERE keep ORDER BY owner LIMIT 5")
def q_sample_owners(spark, sf):
    """sample_owners: the first five kept names and how many more there are (a top-k report)."""
    top, more = O.sample_owners(O.classify_owners(_owners(spark, sf)), 5)
    return top.select("owner", more.alias("more"))


@register("extract_company_fields",
          f"SELECT company_name AS company, corporation_number AS number, registry_type, status, long_address AS address, "
          f"business_type AS type, business_type, replace(registration_date, ',', '') AS std_date, "
          f"CASE WHEN form = 7 THEN 'OLD ' || company_name || '; EX ' || company_name END AS previous_names, "
          f"CASE form WHEN 1 THEN 7 WHEN 5 THEN 9 WHEN 7 THEN 9 ELSE 8 END AS n_keys FROM ({_SEEN})")
def q_extract_company_fields(spark, sf):
    """extract_company_fields: the full first-wins field map of every block."""
    blocks = P.split_result_blocks(I.registry_pages(spark, sf), keys=("page_key",))
    m = F.col("info")
    return P.extract_company_fields(blocks).select(
        m["COMPANY NAME"].alias("company"), m["CORPORATION NUMBER"].alias("number"),
        m["REGISTRY TYPE"].alias("registry_type"), m["STATUS"].alias("status"), m["ADDRESS"].alias("address"),
        m["TYPE"].alias("type"), m["BUSINESS TYPE"].alias("business_type"),
        T.standardize_date(F.coalesce(m["AMALGAMATION DATE"], m["INCORPORATION DATE"])).alias("std_date"),
        m["PREVIOUS NAMES"].alias("previous_names"), F.size(m).alias("n_keys"))


_PARTIAL = ("len(list_filter(s.terms, lambda a: len(list_filter(c.terms, lambda b: contains(b, a) OR contains(a, b))) > 0)) > 0")
_TIERS_SQL = f"""
WITH s AS ({_S_PROFILE}), c AS ({_C_PROFILE})
SELECT s.owner,
  min(c.company) FILTER (WHERE len(list_intersect(s.vars, c.vars)) > 0) AS direct,
  min(c.company) FILTER (WHERE len(list_intersect(s.terms, c.terms)) > 0) AS term,
  min(c.company) FILTER (WHERE {_PARTIAL} OR s.coop OR c.coop) AS partial
FROM s CROSS JOIN c GROUP BY s.owner
"""


@register("match_join_tiers", _TIERS_SQL)
def q_match_join_tiers(spark, sf):
    """match_join_direct / match_join_terms / match_join_substring, each on
    its own: the smallest company per tier per owner (no pairs built). The
    oracle is the brute-force cross join."""
    return M.best_per_tier(I.part_owners(spark, sf), I.registry_names(spark, sf),
                           owner_col="raw_owner", company_col="company_name")


# ---------------------------------------------------------------------------
# the concurrent matcher over the whole registry (many to many)

from nomen.operators import overlap as OV  # noqa: E402

_MM_O = f"SELECT owner, {Q.normalize_words('owner')} AS sn FROM (SELECT DISTINCT raw_owner AS owner FROM ({Q.part_owners()})) WHERE owner IS NOT NULL"
_MM_C = f"SELECT cn, min(company_name) AS company FROM (SELECT company_name, {Q.normalize_words('company_name')} AS cn FROM (SELECT DISTINCT company_name FROM ({Q.registry_names()}))) WHERE cn <> '' GROUP BY cn"
_MM_OVERLAP_SQL = f"""
WITH o AS (SELECT owner, list_distinct(string_split(sn, ' ')) AS sw FROM ({_MM_O}) WHERE sn <> ''),
c AS (SELECT company, list_distinct(string_split(cn, ' ')) AS cw FROM ({_MM_C})),
ow AS (SELECT owner, len(sw) AS n, unnest(sw) AS word FROM o),
cw AS (SELECT company, unnest(cw) AS word FROM c),
p AS (SELECT owner, company, count(*) / any_value(n) AS confidence FROM ow JOIN cw USING (word) GROUP BY owner, company)
SELECT owner, arg_min(company, (-confidence, company)) AS matched_name, max(confidence) AS confidence
FROM p WHERE confidence >= 0.7 GROUP BY owner
"""
_MM_CONTAIN_SQL = f"""
SELECT owner, min(company) AS matched_name, CAST(1.0 AS DOUBLE) AS confidence
FROM ({_MM_O}) o, ({_MM_C}) c WHERE sn <> '' AND (contains(cn, sn) OR contains(sn, cn)) GROUP BY owner
"""


def _mm_owners(spark, sf):
    return I.part_owners(spark, sf).select(F.col("raw_owner").alias("owner"))


@register("match_join_overlap", _MM_OVERLAP_SQL)
def q_match_join_overlap(spark, sf):
    """match_overlap many to many: every owner's best company by shared words (0.7 or more), over the whole registry."""
    return OV.best_overlap(_mm_owners(spark, sf), I.registry_names(spark, sf))


@register("match_join_containment", _MM_CONTAIN_SQL)
def q_match_join_containment(spark, sf):
    """match_containment many to many: every owner's smallest company that contains it or lies in it."""
    return OV.best_containment(_mm_owners(spark, sf), I.registry_names(spark, sf))


_MM_BEST_SQL = f"""
SELECT o.owner, b.matched_name, coalesce(b.confidence, 0.0) AS confidence,
       CASE WHEN b.confidence = 1.0 THEN 'contains' WHEN b.confidence > 0 THEN 'overlap' ELSE 'none' END AS tier, b.confidence IS NOT NULL AS is_match
FROM (SELECT DISTINCT owner FROM ({_MM_O})) o LEFT JOIN (
  SELECT owner, arg_min(matched_name, (-confidence, matched_name)) AS matched_name, max(confidence) AS confidence
  FROM (SELECT * FROM ({_MM_OVERLAP_SQL}) UNION ALL SELECT * FROM ({_MM_CONTAIN_SQL})) GROUP BY owner) b USING (owner)
"""


@register("match_join_concurrent", _MM_BEST_SQL)
def q_match_join_concurrent(spark, sf):
    """The concurrent matcher as a whole: containment either way, else word overlap, best company per owner."""
    return OV.best_match_overlap(_mm_owners(spark, sf), I.registry_names(spark, sf))
