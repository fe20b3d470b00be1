"""DuckDB SQL text of the same computations, for the driver's oracle check.

DuckDB's RE2 has ASCII-only ``\\b``/``\\w`` and no look-ahead, so the SQL here
spells word boundaries out: words are wrapped in the control characters
``chr(1)`` / ``chr(2)`` before the entity-word and co-op rules, which makes
"whole word" an explicit part of the pattern. Lambdas use the ``lambda x:``
syntax of DuckDB 2.
"""

from __future__ import annotations

# Fixed values, written out here and not taken from the code under test, so that a wrong
# entry there shows.
ENTITY_SUFFIXES = [
    "inc", "llc", "ltd", "llp", "corp", "corporation", "limited", "incorporated",
    "llc.", "ltd.", "inc.", "corp.", "limited.", "incorporated.",
    "gmbh", "ag", "sarl", "srl", "pte", "ltee", "bv", "nv", "oyj", "ab", "as",
    "company", "co", "lp", "plc", "llp", "lllp", "lc", "p c", "pc", "pa",
    "professional corporation", "professional association",
    "societe", "société", "societe en nom collectif", "société en nom collectif",
    "societe en commandite", "société en commandite", "societe anonyme", "société anonyme",
]
REPLACEMENTS = [
    ("&", "and"), ("+", "and"), ("@", "at"), ("w/", "with"), ("w /", "with"), ("w.o.", "without"), ("vs.", "versus"),
    ("'s", ""), ("'", ""), ('"', ""), (",", " "), (".", " "), (";", " "), (":", " "), ("  ", " "),
]
STOP_WORDS = ["the", "and", "of", "for", "in", "at", "on", "by", "to", "with", "a", "an"]
SIMPLE_SUFFIXES = ["inc", "llc", "ltd", "llp", "co", "corp", "corporation", "cooperative", "co-op", "coop"]
COOP_TERMS = ["coop", "co-op"]
VOWELS = "AEIOU"
YEAR_MIN, YEAR_MAX = 1900, 2100
BUSINESS_TYPES = ["Not-for-Profit Corporation", "Ontario Business Corporation", "Co-operative Non-Share", "Co-operative with Share",
                  "Extra-Provincial Corporation"]
REGISTRY_TYPES = ["Corporation", "Business Name"]
NAV_WORDS = ["view", "details", "more"]
# name candidates: opening tags in the order in which they are tried, each with its closing tag
CANDIDATE_TAGS = [
    (r'<a\b[^>]*\bclass="[^"]*viewMenu[^"]*"[^>]*>', "a"), (r'<div\b[^>]*\bclass="[^"]*name[^"]*"[^>]*>', "div"),
    (r"<h3\b[^>]*>", "h3"), (r"<h2\b[^>]*>", "h2"), (r"<h1\b[^>]*>", "h1"),
    (r'<span\b[^>]*\bclass="[^"]*title[^"]*"[^>]*>', "span"), (r'<div\b[^>]*\bclass="[^"]*title[^"]*"[^>]*>', "div"),
    (r'<a\b[^>]*\bhref="[^"]*view[^"]*"[^>]*>', "a"), (r"<strong\b[^>]*>", "strong"), (r"<b\b[^>]*>", "b"),
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


WORD = r"[\p{L}\p{N}_]"
B, E = "chr(1)", "chr(2)"


def mark_words(x: str) -> str:
    return f"regexp_replace({x}, '({WORD}+)', {B} || '\\1' || {E}, 'g')"


def unmark(x: str) -> str:
    return f"replace(replace({x}, {B}, ''), {E}, '')"


def _marked_alt(words) -> str:
    parts = []
    for w in words:
        w = w.replace(".", r"\.")
        parts.append(q(w).replace(" ", "' || " + E + " || ' ' || " + B + " || '"))
    return " || '|' || ".join(parts)


def upper(x: str) -> str:
    """Upper case as Java and Python do it (DuckDB maps ß to ẞ, they to SS)."""
    return f"upper(replace({x}, 'ß', 'SS'))"


def py_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalize_name(x: str) -> str:
    n = f"{py_strip(f'lower({x})')}"
    n = rf"regexp_replace({n}, '\s*[\(\[].*?[\]\)]', ' ', 'g')"
    n = mark_words(n)
    n = f"regexp_replace({n}, {B} || '(?:' || {_marked_alt(ENTITY_SUFFIXES)} || ')' || {E}, '', 'g')"
    coop = (f"{B} || '(?:co' || {E} || '[\\s-]' || {B} || 'op(?:erative)?|coop(?:erative)?)' || {E}")
    n = f"regexp_replace({n}, {coop}, 'co-op', 'g')"
    n = unmark(n)
    for old, new in REPLACEMENTS:
        n = f"replace({n}, {q(old)}, {q(new)})"
    n = rf"regexp_replace({n}, '[^a-z0-9\s-]', ' ', 'g')"
    n = rf"regexp_replace({n}, '\s+-\s+', '-', 'g')"
    n = rf"regexp_replace({n}, '-+', '-', 'g')"
    n = rf"regexp_replace({n}, '\s+', ' ', 'g')"
    n = f"trim({n}, ' -')"
    return f"coalesce({n}, '')"


def name_words(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda w: length(w) > 1)"


def name_variations(norm: str, ws: str) -> str:
    """``ws`` must be the column holding ``name_words(norm)``."""
    acr = f"array_to_string(list_transform({ws}, lambda w: left(w, 1)), '')"
    kept = f"list_filter({ws}, lambda w: NOT list_contains({in_list(STOP_WORDS)}, w))"
    cand = ", ".join([
        norm,
        f"replace({norm}, '-', ' ')",
        f"CASE WHEN length({acr}) > 1 THEN {acr} END",
        f"CASE WHEN len({ws}) > 1 THEN left({ws}[1], 1) || left({ws}[2], 1) END",
        f"CASE WHEN len({ws}) > 0 THEN {ws}[1] END",
        f"CASE WHEN len({ws}) > 1 THEN {ws}[1] || ' ' || {ws}[2] END",
        f"CASE WHEN len({kept}) > 0 AND len({kept}) < len({ws}) THEN array_to_string({kept}, ' ') END",
        f"CASE WHEN len({ws}) = 2 THEN {ws}[2] || ' ' || {ws}[1] END",
    ])
    return f"CASE WHEN {norm} = '' THEN []::VARCHAR[] ELSE list_distinct([{cand}]) END"


def name_terms(vars_: str) -> str:
    return (f"list_distinct(list_filter(flatten(list_transform({vars_}, lambda v: string_split(v, ' '))),"
            f" lambda t: length(t) > 2))")


def coop_flag(terms: str) -> str:
    return f"len(list_filter({terms}, lambda t: list_contains({in_list(COOP_TERMS)}, t))) > 0"


def set_key(arr: str) -> str:
    return f"array_to_string(list_sort({arr}), '|')"


def profile_select(src: str, name_col: str, keep_cols: str = "*") -> str:
    """SELECT adding norm, ws, vars, terms, coop for ``name_col`` of ``src``."""
    s1 = f"SELECT {keep_cols}, {normalize_name(name_col)} AS norm FROM ({src})"
    s2 = f"SELECT *, {name_words('norm')} AS ws FROM ({s1})"
    s3 = f"SELECT *, {name_variations('norm', 'ws')} AS vars FROM ({s2})"
    s4 = f"SELECT *, {name_terms('vars')} AS terms FROM ({s3})"
    return f"SELECT *, {coop_flag('terms')} AS coop FROM ({s4})"


def tier_sql(sv, st, scoop, cv, ct, ccoop) -> str:
    partial = (f"len(list_filter({st}, lambda a: len(list_filter({ct}, lambda b: contains(b, a) OR contains(a, b))) > 0)) > 0")
    return (f"CASE WHEN len(list_intersect({sv}, {cv})) > 0 THEN 0.95 "
            f"WHEN len(list_intersect({st}, {ct})) > 0 THEN 0.85 "
            f"WHEN {partial} OR {scoop} OR {ccoop} THEN 0.70 ELSE 0.0 END")


def tier_name(conf: str) -> str:
    return (f"CASE WHEN {conf} = 0.95 THEN 'direct' WHEN {conf} = 0.85 THEN 'term' "
            f"WHEN {conf} = 0.70 THEN 'partial' ELSE 'none' END")


def normalize_words(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '{WORD}+'), ' ')"


def py_split(x: str) -> str:
    return rf"list_filter(string_split_regex({py_strip(x)}, '\s+'), lambda w: length(w) > 0)"


def normalize_name_simple(x: str) -> str:
    n = rf"regexp_replace(regexp_replace(lower({x}), '\([^)]*\)', '', 'g'), '[^a-z0-9\s]', ' ', 'g')"
    return f"array_to_string(list_filter({py_split(n)}, lambda w: NOT list_contains({in_list(SIMPLE_SUFFIXES)}, w)), ' ')"


def abbreviation(x: str) -> str:
    return (f"array_to_string(list_transform(list_filter({py_split(x)}, lambda w: length(w) > 1),"
            f" lambda w: upper(left(w, 1))), '')")


# ---------------------------------------------------------------------------
# classifier


def classify_rule(name: str, min_len: int = 3) -> str:
    u = py_strip(upper(name))
    w = py_split(u)
    dig = r"regexp_full_match({x}, '[0-9]+')"
    isd = lambda x: dig.format(x=x)
    year = (lambda x: f"(length(regexp_replace({x}, '^0+', '')) = 4 AND regexp_replace({x}, '^0+', '') "
            f"BETWEEN '{YEAR_MIN}' AND '{YEAR_MAX}')")
    n = f"len({w})"
    has_num = f"len(list_filter({w}, lambda x: {isd('x')})) > 0"
    has_year = f"len(list_filter({w}, lambda x: {isd('x')} AND {year('x')})) > 0"
    lead = f"({n} >= 2 AND {isd(w + '[1]')} AND length({w}[1]) <= 4 AND length({w}[2]) > 2)"
    trail = f"({n} >= 2 AND {isd(w + '[-1]')} AND length({w}[-1]) <= 4 AND length({w}[-2]) > 2)"
    private = f"list_contains({w}, 'PRIVATE')"
    person = (f"({n} BETWEEN 2 AND 4 AND len(list_filter({w}, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}'))) = 0 "
              f"AND len(list_filter({w}, lambda x: length(x) > 2 AND NOT regexp_matches(x, '[{VOWELS}]'))) = 0)")
    return (f"CASE WHEN {name} IS NULL OR {u} = '' THEN 'empty' "
            f"WHEN length({u}) < {min_len} THEN 'short' "
            f"WHEN contains({u}, 'LTD') OR contains({u}, 'LIMITED') THEN 'ltd' "
            f"WHEN {n} = 0 THEN 'no_words' "
            f"WHEN {has_num} AND NOT ({has_year}) THEN 'number' "
            f"WHEN {lead} THEN 'leading_number' "
            f"WHEN {trail} THEN 'trailing_number' "
            f"WHEN {private} THEN 'private' "
            f"WHEN {person} THEN 'person' ELSE 'other' END")


def exclusion_reason(name: str, keep: str) -> str:
    return (f"CASE WHEN {keep} THEN NULL WHEN contains({upper(name)}, 'LTD') OR contains({upper(name)}, 'LIMITED') "
            f"THEN 'LTD/LIMITED' ELSE 'OTHER' END")


# ---------------------------------------------------------------------------
# derived inputs (same rules as nomen.plans.inputs)

OWNER_FORMS_SQL = [
    "{b} || ' INC'", "{b} || ' LTD'", "{b} || ' LIMITED'", "'123 ' || {b}", "{b} || ' 45'",
    "{b} || ' 2020 TRUST'", "'PRIVATE ' || {b}", "{b} || ' CO-OP'", "'THE ' || {b} || ' & CO.'",
    "{b} || ' (' || CAST({k} AS VARCHAR) || ')'", "'  ' || {b} || '  '", "{b} || ' 2020'",
    "'2020 ' || {b}", "left({b}, 2)", "{b} || ' & SONS'", "'MR ' || {b}",
]

COMPANY_FORMS_SQL = [
    "{b} || ' INC.'", "{b} || ' LIMITED'", "'THE ' || {b} || ' CORPORATION'", "{b} || ' CO-OPERATIVE'",
    "{b} || ' (ONTARIO) LTD'", "{b}", "{b} || ' & ASSOCIATES'", "{b} || ' HOLDINGS'",
]


def _forms(forms, base, key) -> str:
    b = upper(base)
    arms = " ".join(f"WHEN {i} THEN {f.format(b=b, k=key)}" for i, f in enumerate(forms))
    return f"CASE (({key}) % {len(forms)} + {len(forms)}) % {len(forms)} {arms} END"


def part_owners() -> str:
    return f"SELECT p_partkey AS owner_id, {_forms(OWNER_FORMS_SQL, 'p_name', 'p_partkey')} AS raw_owner FROM part"


W3 = r"[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,2}"


def _pieces() -> str:
    return (f"SELECT doc_id, list_transform(regexp_extract_all(text, '{W3}'), "
            r"lambda p: regexp_replace(p, '[\x20\x09-\x0D]+', ' ', 'g')) AS ps FROM documents")


def search_names() -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS piece_no, ps[i] AS search_name FROM ({_pieces()}), unnest(range(1, len(ps) + 1)) AS u(i)"


def name_pairs() -> str:
    later = "array_to_string(list_slice(string_split(concat_ws(' ', ps[i], ps[i + 1]), ' '), 2, 4), ' ')"
    base = (f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS piece_no, ps[i] AS search_name, {later} AS later "
            f"FROM ({_pieces()}), unnest(range(1, len(ps) + 1)) AS u(i)")
    return (f"SELECT doc_id, piece_no, search_name, {_forms(COMPANY_FORMS_SQL, 'later', 'doc_id + piece_no')} AS company_name "
            f"FROM ({base})")


def registry_names() -> str:
    return (f"SELECT {_forms(COMPANY_FORMS_SQL, 'company_name', 'coalesce(part_key, 0)')} AS company_name "
            f"FROM (SELECT DISTINCT part_key, company_name FROM ({registry_records()}))")


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'Inactive' WHEN 'P' THEN 'Refer to Ministry' END"


def registry_records() -> str:
    bt = in_list(BUSINESS_TYPES)
    rid = "(coalesce(l.l_orderkey, o.o_orderkey) * 8 + coalesce(l.l_linenumber, 0))"
    return f"""SELECT {rid} AS record_id, p.p_partkey AS part_key,
      concat_ws(' ', CASE WHEN {rid} % 8 = 4 THEN 'CAFÉ' END, coalesce({upper('p.p_name')}, 'ORDER'), {upper('p.p_type')},
                CAST(coalesce(p.p_partkey, l.l_orderkey, o.o_orderkey) AS VARCHAR)) AS company_name,
      CAST(1000000 + {rid} AS VARCHAR) AS corporation_number,
      CASE WHEN {rid} % 5 = 0 THEN {q(REGISTRY_TYPES[1])} ELSE {q(REGISTRY_TYPES[0])} END AS registry_type,
      {STATUS_SQL} AS status,
      ({bt})[(o.o_custkey % {len(BUSINESS_TYPES)}) + 1] AS business_type,
      concat_ws(', ', g.n_name, g.r_name, 'Canada') AS address,
      strftime(o.o_orderdate, '%B %d, %Y') AS registration_date,
      CAST(o.o_orderdate AS DATE) AS registration_day
    FROM lineitem l FULL JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN part p ON l.l_partkey = p.p_partkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g
      ON c.c_nationkey = g.n_nationkey"""


# the references that occur in the driver's pages ("&amp;" last)
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def page_records() -> str:
    """What a page says of each record: the block forms leave out or change some fields."""
    return f"""SELECT record_id, part_key, company_name, corporation_number, business_type, registration_date, registration_day, registry_type,
      record_id % 8 AS form,
      CASE WHEN record_id % 8 <> 1 THEN status END AS status,
      CASE WHEN record_id % 8 <> 7 THEN address END AS address,
      CASE WHEN record_id % 8 = 6 THEN address || ', Second Floor' WHEN record_id % 8 <> 7 THEN address END AS long_address,
      CASE WHEN record_id % 8 <> 3 THEN registry_type END AS full_registry_type,
      CASE WHEN record_id % 8 <> 5 THEN registration_date END AS incorporation_date,
      CASE WHEN record_id % 8 = 5 THEN registration_date END AS amalgamation_date
    FROM ({registry_records()})"""


def element_text(x: str) -> str:
    v = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for ent, ch in ENTITIES:
        v = f"replace({v}, {q(ent)}, {q(ch)})"
    return rf"regexp_replace(regexp_replace({v}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


def format_percent(conf: str) -> str:
    return f"CAST(CAST(round({conf} * 100) AS INTEGER) AS VARCHAR) || '%'"


def debug_variations(ns: str) -> str:
    w = f"string_split({ns}, ' ')"
    return (f"CASE WHEN len({w}) >= 2 AND {w}[1] <> '' THEN list_distinct([array_to_string({w}, ' '), "
            f"array_to_string(list_reverse({w}), ' '), {w}[1] || ' ' || left({w}[2], 1), "
            f"left({w}[1], 1) || left({w}[2], 1)]) ELSE []::VARCHAR[] END")


def page_key(name: str, btype: str, rid: str) -> str:
    return f"lower(left({name}, 1)) || ' (' || {btype} || ')' || '#' || CAST({rid} // 400 AS VARCHAR)"
