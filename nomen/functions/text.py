"""Text helpers (``Column -> Column``): white space, tags, entities, numbers
in brackets, percent, dates, file-safe labels."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references: those of HTML 4, and apos; a non-breaking space reads as a space.
ENTITIES = {k: chr(c) for k, c in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
ENTITY_RE = r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
CLEAN_RE = r"^[!-%'-~]++(?: [!-%'-~]++)*+\z"
NO_RESULTS_RE = r"[nN](?i:o results found|o matches)"   # only what starts with the letter is looked at closer
DATE_FORMATS = ["MMMM d yyyy", "MMMM d, yyyy"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_space(x) -> Column:
    """Any white-space run -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """References decoded, spaces collapsed; most texts are words of plain letters with single spaces already."""
    return F.when(x.rlike(CLEAN_RE), x).otherwise(collapse_space(unescape(x)))


def strip_tags(x) -> Column:
    return F.regexp_replace(_c(x), r"<[^>]+>", "")


def let(x, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    # x is the start of a fold over nothing: unlike the elements of a transform, it and the result are not copied
    return F.aggregate(F.array().cast("array<int>"), x, lambda acc, _: acc, f)


def _decoded(part: Column) -> Column:
    """A piece of text that starts with ``&``: its character reference decoded, if it is one."""
    names = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in ENTITIES.items())), F.lit("\x02"), F.lit("\x01"))

    def char(name):
        digits = F.substring(name, F.lit(2), F.length(name))
        point = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)) \
            .otherwise(digits).cast("int")
        valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(F.startswith(name, F.lit("#")),
                      F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))).otherwise(names[name])
    return let(F.regexp_extract(part, ENTITY_RE, 1), lambda name: F.when(name == "", part).otherwise(
        F.coalesce(F.concat(char(name), F.substring(part, F.length(name) + 3, F.length(part))), part)))


def unescape(x) -> Column:
    """Character references decoded once: numeric ones and the HTML names."""
    return let(_c(x), lambda v: F.when(F.contains(v, F.lit("&")), F.array_join(
        F.transform(F.split(v, "(?=&)"), lambda p: F.when(F.startswith(p, F.lit("&")), _decoded(p)).otherwise(p)), "")).otherwise(v))


def escape(x) -> Column:
    v, some = _c(x), F.lit(False)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        v, some = F.replace(v, F.lit(a), F.lit(b)), some | F.contains(_c(x), F.lit(a))
    return F.when(some, v).otherwise(_c(x))   # most texts have none of the four


def element_text(x) -> Column:
    """Text of a mark-up fragment: tags removed, entities decoded, spaces collapsed."""
    return collapse_space(unescape(strip_tags(_c(x))))


def strip_number(x) -> Column:
    """Name without a trailing ``(digits)``."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"\s*\(\s*\d+\s*\)\s*$", ""), r"^\s+|\s+$", "")


def trailing_number(x) -> Column:
    """Digits of a trailing ``(digits)``, NULL when absent."""
    v = F.regexp_extract(_c(x), r"\(\s*(\d+)\s*\)\s*$", 1)
    return F.when(v != "", v)


def truncate_raw(x, limit: int | None = None) -> Column:
    """The raw text; with a ``limit``, its first ``limit`` characters plus ``...`` when longer."""
    v = _c(x)
    if limit is None:
        return v
    return F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit), F.lit("..."))).otherwise(v)


def no_results_flag(x) -> Column:
    return F.coalesce(_c(x).rlike(NO_RESULTS_RE), F.lit(False))


def safe_name(x) -> Column:
    """Lower case, spaces and every other non-word character to ``_``."""
    return F.regexp_replace(F.replace(F.lower(_c(x)), F.lit(" "), F.lit("_")), r"(?U)[^\w\-_]", "_")


def format_percent(conf) -> Column:
    """0.95 -> ``95%`` (half-even rounding of the percentage, no decimals)."""
    return F.concat(F.format_number(F.bround(_c(conf) * 100, 0), 0), F.lit("%"))


def parse_percent(text) -> Column:
    """``CONFIDENCE: 95%`` -> ``95%`` text."""
    v = F.regexp_extract(_c(text), r"CONFIDENCE: (\d+%)", 1)
    return F.when(v != "", v)


def percent_value(p) -> Column:
    """``95%`` -> 0.95."""
    return F.regexp_extract(_c(p), r"(\d+)%", 1).cast("double") / 100


def standardize_date(x) -> Column:
    """Remove commas (``January 06, 2025`` -> ``January 06 2025``)."""
    return F.replace(_c(x), F.lit(","), F.lit(""))


def to_date_any(x) -> Column:
    """``September 15 2008`` or ``January 06, 2025`` -> DATE (NULL if neither)."""
    v = _c(x)
    # a format that does not fit costs an exception: only the one that has a comma, or has none, as the text does is tried
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.when(F.contains(v, F.lit(",")) == ("," in f), v), F.lit(f))) for f in DATE_FORMATS])


def format_timestamp(ts, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_c(ts), fmt)


def relative_gain(a, b) -> Column:
    """(a - b) / a * 100 when a > 0, else NULL."""
    a, b = _c(a), _c(b)
    return F.when(a > 0, (a - b) / a * 100)


def expected_minutes(rows, batch: int, lanes: int, seconds_per_row: float = 7.0) -> Column:
    """Planned minutes: rows * seconds / (batch * lanes) / 60."""
    return _c(rows) * F.lit(seconds_per_row) / F.lit(batch * lanes) / 60


def lookup_default(*cols, default: str = "Unknown") -> Column:
    return F.coalesce(*[_c(c) for c in cols], F.lit(default))


DATE_IN_TEXT_RE = r"(?i)(incorporation|amalgamation).*?(\w+\s+\d{1,2},?\s+\d{4})"


def extract_date(text) -> Column:
    """``Month d, yyyy`` after Incorporation / Amalgamation -> struct of the
    two dates (the word decides the column; NULL when absent)."""
    t = _c(text)
    kind = F.upper(F.regexp_extract(t, DATE_IN_TEXT_RE, 1))
    val = F.regexp_extract(t, DATE_IN_TEXT_RE, 2)
    return F.struct(F.when(kind == "INCORPORATION", val).alias("incorporation_date"),
                    F.when(kind == "AMALGAMATION", val).alias("amalgamation_date"))


def split_search_label(label) -> Column:
    """``prefix (type)`` -> struct(prefix, business_type)."""
    t = _c(label)
    return F.struct(F.regexp_extract(t, r"^(.*?) \((.*)\)$", 1).alias("prefix"),
                    F.regexp_extract(t, r"^(.*?) \((.*)\)$", 2).alias("business_type"))


def to_json_record(*cols) -> Column:
    """A record as JSON text (NULL fields dropped, non-ASCII kept)."""
    return F.to_json(F.struct(*[_c(c) for c in cols]), {"ignoreNullFields": "true"})


def parse_json(text, schema: str) -> Column:
    """JSON text -> typed struct by a DDL schema."""
    return F.from_json(_c(text), schema)
