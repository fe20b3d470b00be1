"""Name functions: ``Column -> Column`` built from Spark's own expressions.

Everything here stays inside Catalyst / whole-stage codegen: ``lower``,
``regexp_replace``, ``split`` and higher-order array functions. Regular
expressions carry ``(?U)`` wherever the meaning of ``\\b``, ``\\w`` or ``\\s``
depends on Unicode, so that accented letters count as word characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results), in their order.
# ---------------------------------------------------------------------------

# Business entity words removed anywhere in a name, in the order of the
# alternation (the order matters: the first alternative that fits wins).
ENTITY_SUFFIXES = [
    "inc", "llc", "ltd", "llp", "corp", "corporation", "limited", "incorporated",
    "llc.", "ltd.", "inc.", "corp.", "limited.", "incorporated.",
    "gmbh", "ag", "sarl", "srl", "pte", "ltee", "bv", "nv", "oyj", "ab", "as",
    "company", "co", "lp", "plc", "llp", "lllp", "lc", "p c", "pc", "pa",
    "professional corporation", "professional association",
    "societe", "société", "societe en nom collectif", "société en nom collectif",
    "societe en commandite", "société en commandite", "societe anonyme", "société anonyme",
]

# Literal replacements applied one after the other.
REPLACEMENTS = [
    ("&", "and"), ("+", "and"), ("@", "at"), ("w/", "with"), ("w /", "with"),
    ("w.o.", "without"), ("vs.", "versus"), ("'s", ""), ("'", ""), ('"', ""),
    (",", " "), (".", " "), (";", " "), (":", " "), ("  ", " "),
]

# Words dropped for the "without stop words" variation.
STOP_WORDS = ["the", "and", "of", "for", "in", "at", "on", "by", "to", "with", "a", "an"]

# Suffix words dropped by the simple normaliser of the loose matcher.
SIMPLE_SUFFIXES = ["inc", "llc", "ltd", "llp", "co", "corp", "corporation", "cooperative", "co-op", "coop"]

# Terms that switch on the co-operative rule.
COOP_TERMS = ["coop", "co-op"]

# ---------------------------------------------------------------------------


def _alt(words: list[str]) -> str:
    """Regex alternation; only '.' needs escaping in these word lists."""
    return "|".join(w.replace(".", r"\.") for w in words)


STRIPPED_RE = r"(?Us)^\S(?:.*\S)?\z"
SUFFIX_RE = r"(?U)\b(" + _alt(ENTITY_SUFFIXES) + r")\b"
COOP_RE = r"(?U)\b(co[\s-]?op(?:erative)?|coop(?:erative)?)\b"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def py_strip_once(x) -> Column:
    """:func:`py_strip` of an expression that is made once; most texts have no white space at either end."""
    from nomen.functions.text import let
    return let(_c(x), lambda v: F.when(v.rlike(STRIPPED_RE), v).otherwise(py_strip(v)))


def py_split(x) -> Column:
    """Python ``str.split()``: white-space separated tokens, no empty tokens."""
    return F.filter(F.split(py_strip(x), r"(?U)\s+"), lambda w: F.length(w) > 0)


def normalize_name(x, coop_first: bool = False) -> Column:
    """Normalise an organisation name for comparison.

    lower + strip, drop bracketed text, drop entity words anywhere, unify the
    co-op spellings, literal replacements, everything but ``[a-z0-9]``, white
    space and hyphens becomes a space, hyphen/space clean-up, strip `` -``.
    NULL in, empty string out (NULL means "no name", scored as no match).
    By default ``co`` is dropped before the co-op spellings are unified, so that
    only the solid ones give ``co-op``; ``coop_first`` makes all of them solid first.
    """
    # the blanks at the ends go with the last step; everything but letters, digits and hyphens
    # becomes one space in one pass, so the replacements by a space need no step of their own
    n = F.lower(_c(x))
    n = F.regexp_replace(n, r"(?U)\s*[(\[].*?[\])]", " ")
    if coop_first:
        n = F.regexp_replace(n, COOP_RE, "coop")
    n = F.regexp_replace(n, SUFFIX_RE, "")
    n = F.regexp_replace(n, COOP_RE, "co-op")
    for old, new in REPLACEMENTS:
        if new != " ":
            n = F.replace(n, F.lit(old), F.lit(new))
    n = F.regexp_replace(n, r"[^a-z0-9-]+", " ")
    n = F.replace(n, F.lit(" - "), F.lit("-"))
    n = F.regexp_replace(n, r"--+", "-")
    n = F.btrim(n, F.lit(" -"))
    return F.coalesce(n, F.lit(""))


def name_words(norm) -> Column:
    """Words of a normalised name longer than one character."""
    return F.filter(F.split(_c(norm), " "), lambda w: F.length(w) > 1)


def name_variations(norm, ws=None, kept=None, acronym=None) -> Column:
    """Set of variations of a *normalised* name (array, distinct, no NULLs).

    full; hyphens as spaces; acronym of >=2 letters; first two initials; first
    word; first two words; without stop words (only when some were dropped);
    reversed when exactly two words. Empty name -> empty array.

    ``ws`` / ``kept`` / ``acronym`` may name already computed columns (see
    ``with_name_profile``) so the expression tree stays small.
    """
    n = _c(norm)
    ws = _c(ws) if ws is not None else name_words(n)
    nw = F.size(ws)
    acronym = _c(acronym) if acronym is not None else name_acronym(ws)
    kept = _c(kept) if kept is not None else name_kept(ws)
    cand = F.array(
        n,
        F.replace(n, F.lit("-"), F.lit(" ")),
        F.when(F.length(acronym) > 1, acronym),
        F.when(nw > 1, F.concat(F.substring(ws[0], 1, 1), F.substring(ws[1], 1, 1))),
        F.when(nw > 0, ws[0]),
        F.when(nw > 1, F.concat_ws(" ", ws[0], ws[1])),
        F.when((F.size(kept) > 0) & (F.size(kept) < nw), F.array_join(kept, " ")),
        F.when(nw == 2, F.concat_ws(" ", ws[1], ws[0])),
    )
    return F.when(n == "", F.array().cast("array<string>")).otherwise(
        F.array_except(cand, F.array(F.lit(None).cast("string"))))   # distinct, without nulls


def name_acronym(ws) -> Column:
    return F.array_join(F.transform(_c(ws), lambda w: F.substring(w, 1, 1)), "")


def name_kept(ws) -> Column:
    return F.filter(_c(ws), lambda w: ~w.isin(*STOP_WORDS))


def with_name_profile(df, col: str, prefix: str = "", coop_first: bool = False):
    """Add ``{prefix}norm, vars, terms, coop`` for ``col`` as staged
    projections: each stage reads the previous stage's column, so no
    sub-expression is evaluated twice (Catalyst keeps expensive projections
    apart instead of inlining them)."""
    p = prefix
    keep = [F.col(c) for c in df.columns]
    d = df.select(*keep, normalize_name(col, coop_first).alias(p + "norm"))
    d = d.select("*", name_words(p + "norm").alias(p + "_ws"))
    d = d.select("*", name_kept(p + "_ws").alias(p + "_kept"), name_acronym(p + "_ws").alias(p + "_acr"))
    d = d.select("*", name_variations(p + "norm", p + "_ws", p + "_kept", p + "_acr").alias(p + "vars"))
    d = d.select("*", profile_terms(p + "norm", p + "_acr").alias(p + "terms"))
    d = d.drop(p + "_ws", p + "_kept", p + "_acr")
    return d.select("*", coop_flag(p + "terms").alias(p + "coop"))


def name_terms(variations) -> Column:
    """Distinct tokens of all variations that are longer than two characters."""
    toks = F.flatten(F.transform(_c(variations), lambda v: F.split(v, " ")))
    return F.array_distinct(F.filter(toks, lambda t: F.length(t) > 2))


def profile_terms(norm, acronym) -> Column:
    """:func:`name_terms` of the variations of a normalised name without making them again: their tokens are the name's,
    with hyphens and with spaces for hyphens, and the acronym; the two initials are too short."""
    n = _c(norm)
    spaced = F.when(F.contains(n, F.lit("-")), F.split(F.replace(n, F.lit("-"), F.lit(" ")), " ")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.split(n, " "), spaced, F.array(_c(acronym))), lambda t: F.length(t) > 2))


def acronyms(variations) -> Column:
    """Variations of at most four letters, letters only."""
    return F.filter(_c(variations), lambda v: (F.length(v) <= 4) & v.rlike(r"^[a-z]+$"))


def coop_flag(terms) -> Column:
    """A term equal to ``coop`` or ``co-op`` (implies a term containing one)."""
    return F.exists(_c(terms), lambda t: t.isin(*COOP_TERMS))


def normalize_words(x) -> Column:
    """lower, ``\\w+`` tokens joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(?U)(\w+)"), 1), " ")


def normalize_name_simple(x) -> Column:
    """lower, drop ``(...)``, non-alphanumerics to space, drop suffix words."""
    n = F.lower(_c(x))
    n = F.regexp_replace(n, r"\([^)]*\)", "")
    ws = F.filter(F.split(n, r"[^a-z0-9]+"), lambda w: ~w.isin("", *SIMPLE_SUFFIXES))
    return F.array_join(ws, " ")


def abbreviation(x) -> Column:
    """Upper-case initials of the words longer than one character."""
    return initials(py_split(_c(x)))


def initials(words) -> Column:
    """Upper-case initials of an array's words longer than one character."""
    ws = F.filter(_c(words), lambda w: F.length(w) > 1)
    return F.upper(F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), ""))


def debug_variations(norm_words) -> Column:
    """Report variations of a ``normalize_words`` string (needs two words):
    full, reversed, first word + initial of the second, two initials."""
    ws = F.split(_c(norm_words), " ")
    ok = (F.size(ws) >= 2) & (ws[0] != "")
    v = F.array(
        F.array_join(ws, " "),
        F.array_join(F.reverse(ws), " "),
        F.concat(ws[0], F.lit(" "), F.substring(ws[1], 1, 1)),
        F.concat(F.substring(ws[0], 1, 1), F.substring(ws[1], 1, 1)),
    )
    return F.when(ok, F.array_distinct(v)).otherwise(F.array().cast("array<string>"))


def debug_direct(variations, norm_company) -> Column:
    """Variations that occur inside the normalised company name."""
    return F.filter(_c(variations), lambda v: F.contains(_c(norm_company), v))


def set_key(arr) -> Column:
    """Order-free text form of a string set (for display and comparison)."""
    return F.array_join(F.sort_array(_c(arr)), "|")
