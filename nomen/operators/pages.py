"""Result-page extraction: pages -> result blocks -> fields.

Pages arrive as a table ``(page_id, url, html)`` (or files, see
``nomen.sources``). Blocks are cut with a look-ahead ``split`` on the opening
tag of a result container (at plain ``<div`` where no div tag is odd), each up to its own closing tag, and exploded with
their position; fields are values found by class markers (``FieldSpec``) inside
their container element, never beyond it — all built-in expressions, one narrow
stage, no shuffle. Badly formed pages can go
through ``nomen.operators.udf.parse_pages_with`` (standard-library HTML
parser in ``mapInPandas``) instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.functions import text as T
from nomen.operators import tree as E

# Class markers of the registry's result mark-up.
BLOCK_CLASS = "registerItemSearch-results-page-line"
ITEM_BOX = ["appMinimalBox", "ItemBox"]
NAME_CLASS = "registerItemSearch-results-page-line-ItemBox-resultLeft-viewMenu"
REGISTRY_CLASSES = ["registerItemSearch-results-page-line-item1", "registryInfo"]
STATUS_CLASSES = ["appMinimalAttr", "Status"]
TYPE_CLASSES = ["appMinimalAttr", "EntitySubTypeCode"]
DATE_CLASSES = ["appMinimalAttr", "RegistrationDate"]
ADDRESS_CLASSES = ["addressSearchResultBox"]
VALUE_CLASS = "appMinimalValue"
ADDRESS_VALUE_CLASS = "appAttrValue"
LABEL_CLASS = "appMinimalLabel"
ATTR_CLASS = "appMinimalAttr"
BOX_CLASS = "appMinimalBox"
PREVIOUS_CLASSES = ["previousNameSearchResult", "previous-names", "previousNamesBox"]
# class markers of the full field map; either of the names suffices
LINK_LIKE = "viewMenu"
REGISTRY_LIKE = "registerItemSearch-results-page-line-item1|registryInfo"
STATUS_LIKE = "Status|status"
ADDRESS_LIKE = "ItemAddress|address"
ROW_LIKE = "row|appMinimalAttr|field-row|appMinimalBox"
LABEL_LIKE = "appMinimalLabel|label|field-label"
ROW_VALUE_LIKE = "appMinimalValue|value|field-value|appAttrValue"
VALUE_LIKE = "appMinimalValue|value"
SUBTYPE_LIKE = "EntitySubTypeCode|business-type"
REGISTERED_LIKE = "RegistrationDate|incorporation-date"
COMMON_VALUES = ["active", "inactive", "dissolved"]
PAGER_CLASS = "appPagerBanner"
NOT_AVAILABLE = "N/A"
DEFAULT_BUSINESS_TYPE = "Not-for-Profit Corporation"
# result selectors tried in order for the first block
FIRST_BLOCK_MARKERS = [BLOCK_CLASS, "search-result", "result-item", "result", "item"]



def _token(c: str) -> str:
    """A whole class token inside a class attribute value."""
    return r'(?<=["\s])' + c + r'(?=["\s])'


def _holds(c: str) -> str:
    """From the start of a class attribute's value: what is up to, and with, the whole token ``c``, word by word."""
    return r'(?:[^"\s]*+\s)*?' + c + r'(?=["\s])'


BLOCK_OPEN_RE = r'(?=<div[^>]*class="[^"]*' + _token(BLOCK_CLASS) + ")"
START_RE = r'^<div[^>]*class="[^"]*' + _token(BLOCK_CLASS)


def _has_classes(classes: list[str]) -> str:
    """Regex for a class attribute holding all ``classes`` (any order)."""
    # the last is the one that tells most
    return 'class="' + "".join("(?=" + _holds(c) + ")" for c in reversed(classes)) + '[^"]*"'


DIV_TAG_RE = r"(?i)(?=</?div[\s>])"
# A plain div in one pattern, with the divs in it up to NESTED deep: tags in small letters, with their end, and
# without "<", or "<" or ">" in quotes, before it.
NESTED = 8
_NO_DIV = r"(?:[^<]++|<(?!/?[dD][iI][vV]))*+"
_DIV_REST = r"""(?=[\s>])(?:[^<>"']++|"[^"<>]*+")*+>"""
_DIV_END = r"</div(?=[\s>])"
UNREAD = "<div"   # what closed_div_re finds of a div that is not plain


def closed_div_re(attr: str, alone: bool = False) -> str:
    """Pattern of a ``div`` whose opening tag matches ``attr``, up to the ``>`` of its own closing tag, which is left out; of one
    that is not plain (or with ``alone``, that holds another of its kind) it finds ``UNREAD`` only. Every repeat in it is
    possessive: what it reads is read once."""
    opening = "(?=[^>]*?" + attr + ")"
    inner = ""
    for _ in range(NESTED):
        inner = "(?:<div" + (f"(?!{opening})" if alone else "") + _DIV_REST + _NO_DIV + inner + _DIV_END + _NO_DIV + ")*+"
    return f"<div{opening}(?:{_DIV_REST}{_NO_DIV}{inner}{_DIV_END}|)"


def balanced(fragment) -> Column:
    """The ``div`` that a fragment starts with, up to its own closing tag (the
    whole fragment when it is never closed)."""
    def cut(pieces):
        def step(acc, p):
            depth = acc["depth"] + F.when(F.startswith(p, F.lit("</")), -1).otherwise(1)
            return F.when(acc["closed"], acc).otherwise(F.struct(
                depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth <= 0).alias("closed")))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed"))
        return T.let(F.aggregate(pieces, start, step), lambda a: F.when(
            a["closed"], F.concat(F.array_join(F.slice(pieces, F.lit(1), F.greatest(a["n"] - 1, F.lit(0))), ""), F.lit("</div>")))
            .otherwise(F.array_join(pieces, "")))
    # most have no div inside: closed by the next div tag, and nothing behind it is looked at
    return T.let(F.split(fragment, DIV_TAG_RE, 3), lambda near: F.when(
        (F.size(near) > 1) & F.startswith(near[1], F.lit("</")), F.concat(near[0], F.lit("</div>")))
        .otherwise(T.let(F.split(fragment, DIV_TAG_RE), cut)))


def first_div(block, attr: str) -> Column:
    """The first ``div`` whose opening tag matches ``attr``, as mark-up; empty when there is none."""
    b = block if isinstance(block, Column) else F.col(block)
    cut = T.let(F.regexp_extract(b, "(?s)(<div[^>]*" + attr + ".*)", 1), lambda x: F.when(x == "", x).otherwise(balanced(x)))
    # most are plain: read in one go
    return T.let(F.regexp_extract(b, closed_div_re(attr), 0), lambda x: F.when(x == "", x).when(x == UNREAD, cut).otherwise(F.concat(x, F.lit(">"))))


# Mark-up all of whose div tags the plain cut below can take: in small letters, with their end, and without
# "<", or "<" or ">" in quotes, before it.
TIDY_RE = r"""^(?:[^<]++|<(?!/?[dD][iI][vV])|</div(?=[\s>])|<div(?=[\s>])(?:[^<>"]++|"[^"<>]*+")*+>)*+\z"""
DIV, END_DIV = "<div", "</div"


def tidy(mark_up: Column) -> Column:
    """All div tags are plain: cut at ``<div``, every piece after the first holds one whole opening tag. For such mark-up
    the ``*_of`` functions below give what the patterns give, with plain string functions."""
    return mark_up.rlike(TIDY_RE)


def div_pieces(mark_up: Column) -> Column:
    """The pieces behind each ``<div``; what stands before the first is left out."""
    return T.let(F.split(mark_up, DIV), lambda ps: F.slice(ps, F.lit(2), F.size(ps)))


def _opens(p: Column, attr: str, marker: str) -> Column:
    """The opening tag that a piece starts with matches ``attr``; ``marker``: a plain text that such a tag holds."""
    return F.contains(p, F.lit(marker)) & p.rlike("^[^>]*" + attr)


def balanced_of(pieces: Column) -> Column:
    """:func:`balanced` of tidy mark-up, as its pieces, the first that of the opening tag."""
    def step(acc, p):
        depth = acc["depth"] + 1
        ends = ((F.octet_length(p) - F.octet_length(F.replace(p, F.lit(END_DIV), F.lit("")))) / len(END_DIV)).cast("int")
        return F.when(acc["at"] > 0, acc).otherwise(F.struct(
            F.when(ends >= depth, depth).otherwise(depth - ends).alias("depth"), (acc["n"] + 1).alias("n"),
            F.when(ends >= depth, acc["n"] + 1).otherwise(0).alias("at")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def cut(a):
        whole = F.transform(F.slice(pieces, F.lit(1), a["at"] - 1), lambda p: F.concat(F.lit(DIV), p))
        return F.when(a["at"] > 0, F.concat(F.array_join(whole, ""), F.lit(DIV), F.call_function("substring_index", pieces[a["at"] - 1], F.lit(END_DIV), a["depth"]), F.lit("</div>"))) \
            .otherwise(F.concat(F.lit(DIV), F.array_join(pieces, DIV)))
    return T.let(F.aggregate(pieces, start, step), cut)


def first_div_of(pieces: Column, attr: str, marker: str) -> Column:
    """:func:`first_div` of tidy mark-up, as its pieces."""
    def cut(p):
        # most have no div inside: their piece holds their end
        at = F.array_position(F.transform(pieces, lambda x: _opens(x, attr, marker)), True).cast("int")
        return F.when(p.isNull(), F.lit("")).when(F.contains(p, F.lit(END_DIV)), F.concat(F.lit(DIV), F.substring_index(p, END_DIV, 1), F.lit("</div>"))) \
            .otherwise(T.let(at, lambda a: balanced_of(F.slice(pieces, a, F.size(pieces)))))
    return T.let(F.get(F.filter(pieces, lambda p: _opens(p, attr, marker)), F.lit(0)), cut)


def all_divs_of(pieces: Column, attr: str, marker: str) -> Column:
    """:func:`all_elements` of the divs of tidy mark-up, as its pieces."""
    hits = F.filter(F.transform(pieces, lambda p, i: F.when(_opens(p, attr, marker), i + 1)), lambda i: i.isNotNull())
    return F.transform(hits, lambda i: T.let(pieces[i - 1], lambda p: F.when(
        F.contains(p, F.lit(END_DIV)), F.concat(F.lit(DIV), F.substring_index(p, END_DIV, 1), F.lit("</div>")))
        .otherwise(balanced_of(F.slice(pieces, i, F.size(pieces))))))


def result_blocks(html: Column) -> Column:
    """The mark-up of every result container of a page, in order; null for null."""
    by_pattern = F.transform(F.filter(F.split(html, BLOCK_OPEN_RE), lambda p: p.rlike(START_RE)), balanced)
    attr = 'class="' + _holds(BLOCK_CLASS)

    def cut(pieces):
        starts = F.filter(F.transform(pieces, lambda p, i: F.when(_opens(p, attr, BLOCK_CLASS), i + 1)), lambda i: i.isNotNull())
        return T.let(starts, lambda ss: F.transform(ss, lambda s, k: T.let(
            F.slice(pieces, s, F.coalesce(F.get(ss, k + 1), F.size(pieces) + 1) - s), balanced_of)))
    odd = F.when(tidy(html), T.let(div_pieces(html), cut)).otherwise(by_pattern)
    # most pages have plain blocks, none in another: read in one go
    return T.let(F.regexp_extract_all(html, F.lit(closed_div_re(attr, alone=True)), 0), lambda bs: F.when(F.array_contains(bs, UNREAD), odd)
                 .otherwise(F.transform(bs, lambda b: F.concat(b, F.lit(">")))))


def all_elements(block: Column, tags: str, attr: str) -> Column:
    """Mark-up of every element of ``tags`` whose opening tag matches ``attr``,
    in page order, nested ones included."""
    def each(parts):
        return F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                                    lambda x: x["p"].rlike("^" + opening)),
                           lambda x: element(F.array_join(F.slice(parts, x["i"] + 1, F.size(parts)), "")))
    opening = f"<(?:{tags})\\b[^>]*{attr}"
    return T.let(F.split(block, f"(?={opening})"), each)


def element(fragment: Column) -> Column:
    """The element that a fragment starts with."""
    return F.when(F.startswith(fragment, F.lit("<div")), balanced(fragment)).otherwise(
        F.regexp_extract(fragment, r"(?s)^(<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>.*?(?:</\2\s*>|$))", 1))


def glued_text(x) -> Column:
    """Text of an element: pieces trimmed and glued, entities decoded, spaces collapsed."""
    return T.let(F.regexp_replace(x, r"\s*<[^>]+>\s*", ""), T.clean)


def spaced_text(x) -> Column:
    """Text of an element with a space between its pieces."""
    return T.let(F.regexp_replace(x, r"<[^>]+>", " "), T.clean)


def class_like(names: str) -> str:
    """Regex for a class attribute that holds one of ``names`` (a|b|c) anywhere."""
    return f'class="[^"]*(?:{names})[^"]*"'


@dataclass(frozen=True)
class FieldSpec:
    """A field: the ``div`` holding all ``container`` classes, then the first
    element inside it with ``value`` class (or the container's own text when
    ``value`` is None). ``exclude`` skips value elements with a class."""
    name: str
    container: tuple
    value: str | None = None
    tag: str | None = None
    exclude: tuple = ()

    def raw(self, block, pieces: Column | None = None) -> Column:
        """The value's text, empty when absent. ``pieces``: those of the block, null unless it is tidy."""
        attr = _has_classes(list(self.container))
        box = first_div(block, attr)
        if pieces is not None:
            box = F.when(pieces.isNull(), box).otherwise(first_div_of(pieces, attr, self.container[-1]))
        b = block if isinstance(block, Column) else F.col(block)
        general = F.when(~F.contains(b, F.lit(self.container[-1])), F.lit("")).otherwise(T.let(box, lambda x: F.when(x == "", x).otherwise(self._text(x))))
        # most values are text alone, with no div tag before them: read with their container in one go
        return T.let(F.regexp_extract(b, self._near_re(), 1 if self.value is None and self.tag is None else 2), lambda v: F.when(v == "", general).otherwise(T.clean(v)))

    def _value_re(self) -> tuple[str, str]:
        """Patterns of the value element's name and of what its opening tag must hold behind it."""
        excl = "".join('(?![^>]*?class="' + _holds(e) + ")" for e in self.exclude)
        return self.tag or "[a-zA-Z][a-zA-Z0-9]*", excl + ("[^>]*?" + _has_classes([self.value]) if self.value else "")

    def _near_re(self) -> str:
        """Pattern that finds the last class of the container where a block first holds it and, in its last group, the text
        of the value, if that class stands in a plain div (its first attribute, behind the end of another tag), nothing but other tags
        than div is between the two and nothing but text in the value; else the class alone. The search is for a fixed text."""
        last, others = self.container[-1], "".join("(?=" + _holds(c) + ")" for c in self.container[:-1])
        opened = rf'(?<=(?:\A|>)\s{{0,4}}<div\sclass="{others}(?:[^"<>]{{0,150}}\s)?{last})(?=["\s])[^"<>]*+"(?:[^<>"\']++|"[^"<>]*+")*+>'
        if self.value is None and self.tag is None:
            return f"{last}(?:{opened}([^<]*+){_DIV_END}|)"
        tag, rest = self._value_re()
        return (f"{last}(?:{opened}(?:[^<]++|<(?!(?:{tag})\\b{rest}[^>]*>|/?[dD][iI][vV]))*+"
                f"<({tag})\\b{rest}[^>]*+>([^<]*+)</\\1\\s*>|)")

    def _text(self, box: Column) -> Column:
        if self.value is None and self.tag is None:
            return glued_text(box)
        tag, rest = self._value_re()
        # behind the container's own opening tag; "<" of other tags are passed by without a try at what follows them
        found = F.regexp_extract(box, r"(?s)^<[^>]*+>(?:[^<]++|<(?!(?:" + tag + r")\b" + rest + r"[^>]*>))*+(<(" + tag + r")\b[^>]*>.*?(?:</\2\s*>|$))", 1)
        return glued_text(found)

    def column(self, block, pieces: Column | None = None) -> Column:
        return T.let(self.raw(block, pieces), lambda v: F.when(v != "", v))

    def find(self, part: Column) -> Column:
        """The same value from a block's slice of the element tree: quotes and case of the mark-up do not matter."""
        box = E.first(part, E.sel("div", self.container))
        hit = box
        if self.value is not None or self.tag is not None:
            hit = T.let(box, lambda b: E.first(E.inside(b), E.sel(self.tag, [self.value] if self.value else [], without=self.exclude)))
        return T.let(E.glued(hit), lambda v: F.when(v != "", v))


# Field list of the listing extractor and of the detail extractor.
LISTING_FIELDS = [
    FieldSpec("business_name", (NAME_CLASS,), tag="span", exclude=("left", "right")),
    FieldSpec("business_type", tuple(TYPE_CLASSES), VALUE_CLASS),
    FieldSpec("inc_date", tuple(DATE_CLASSES), VALUE_CLASS),
    FieldSpec("location", tuple(ADDRESS_CLASSES), ADDRESS_VALUE_CLASS),
    FieldSpec("status", tuple(STATUS_CLASSES), VALUE_CLASS),
]
REGISTRY_FIELD = FieldSpec("registry_type", tuple(REGISTRY_CLASSES))


def compile_fields(block, specs) -> list[Column]:
    return [s.column(block).alias(s.name) for s in specs]


# ---------------------------------------------------------------------------


def split_result_blocks(pages: DataFrame, html: str = "html", keys=("page_id",)) -> DataFrame:
    """One row per result container: ``keys..., pos (1-based), block``."""
    d = pages.select(*keys, F.posexplode(result_blocks(F.col(html))).alias("pos", "block"))
    return d.select(*keys, (F.col("pos") + 1).cast("int").alias("pos"), "block")


def tidy_pieces(block: Column) -> Column:
    """The pieces of a block for ``FieldSpec.column``, null unless it is tidy."""
    return F.when(tidy(block), div_pieces(block))


def count_results(html) -> Column:
    """Number of result containers on a page."""
    h = html if isinstance(html, Column) else F.col(html)
    return F.size(F.regexp_extract_all(h, F.lit(r'<div[^>]*class="[^"]*' + _token(BLOCK_CLASS)), 0))


def page_size(html) -> Column:
    return F.length(html if isinstance(html, Column) else F.col(html))


def saturated_page(html, cap: str = "200") -> Column:
    """The pager banner holds the token ``cap`` (the registry shows at most 200)."""
    h = html if isinstance(html, Column) else F.col(html)
    banner = spaced_text(first_div(h, _has_classes([PAGER_CLASS])))
    return F.array_contains(F.split(banner, " "), cap)


def extract_fields(blocks: DataFrame, specs, block: str = "block", keep_block: bool = False) -> DataFrame:
    """Leaf values of ``specs`` as columns (NULL when absent)."""
    b = F.col(block)
    keep = [c for c in blocks.columns if keep_block or c != block]
    return blocks.select(*keep, *[s.column(b).alias(s.name) for s in specs])


def extract_listing(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Five listing fields per block, ``N/A`` when missing."""
    d = extract_fields(blocks, LISTING_FIELDS, block)
    keep = [c for c in blocks.columns if c != block]
    return d.select(*keep, *[F.coalesce(F.col(s.name), F.lit(NOT_AVAILABLE)).alias(s.name) for s in LISTING_FIELDS])


def page_listing(html) -> Column:
    """The listing rows of a page as ``array<struct<pos, ...>>``, in page order: one narrow
    expression for flows that keep a page's rows together. Empty for null."""
    h = html if isinstance(html, Column) else F.col(html)

    def row(b, i):
        return F.struct((i + 1).cast("int").alias("pos"), *[F.coalesce(s.column(b), F.lit(NOT_AVAILABLE)).alias(s.name) for s in LISTING_FIELDS])
    return F.transform(result_blocks(F.coalesce(h, F.lit(""))), row)


def attr_dates(block, pieces: Column | None = None) -> Column:
    """Incorporation and amalgamation date of a block, each from the attribute
    boxes whose text names it (the last such box wins)."""
    attr = _has_classes([ATTR_CLASS])
    found = all_elements(block, "div", attr)
    if pieces is not None:
        found = F.when(pieces.isNull(), found).otherwise(all_divs_of(pieces, attr, ATTR_CLASS))
    else:
        # plain ones, none in another, in one go
        odd, b = found, block if isinstance(block, Column) else F.col(block)
        found = T.let(F.regexp_extract_all(b, F.lit(closed_div_re(attr, alone=True)), 0), lambda xs: F.when(F.array_contains(xs, UNREAD), odd)
                      .otherwise(F.transform(xs, lambda x: F.concat(x, F.lit(">")))))
    # a box without either word, and without a reference that might hide it, has no date
    named = F.filter(found, lambda x: F.contains(x, F.lit("&")) | x.rlike("[iIaA](?i:ncorporation|malgamation)"))
    texts = F.transform(named, lambda x: T.extract_date(spaced_text(x)))

    def last(xs, field):
        dates = F.filter(F.transform(xs, lambda x: x[field]), lambda v: v.isNotNull())
        return T.let(dates, lambda ds: F.get(ds, F.size(ds) - 1)).alias(field)
    return T.let(texts, lambda xs: F.struct(last(xs, "incorporation_date"), last(xs, "amalgamation_date")))


def extract_details(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Detail fields: name without the trailing ``(digits)``, corporation
    number (from the name, else the first ``(digits)`` within the block),
    registry type, status, address, business type, incorporation and
    amalgamation date (the label decides which) and their DATE values."""
    keep = [c for c in blocks.columns if c != block]
    d = extract_fields(blocks, [s for s in LISTING_FIELDS if s.name != "inc_date"] + [REGISTRY_FIELD], block, keep_block=True)
    any_num = F.regexp_extract(F.col(block), r"\((\d+)\)", 1)
    d = d.select(*keep, "business_name", "business_type", "location", "status", "registry_type",
                 F.when(any_num != "", any_num).alias("_num_any"), attr_dates(F.col(block)).alias("_dates"))
    return d.select(
        *keep,
        T.strip_number(F.col("business_name")).alias("company_name"),
        F.coalesce(T.trailing_number(F.col("business_name")), F.col("_num_any")).alias("corporation_number"),
        "registry_type",
        "status",
        F.col("location").alias("address"),
        "business_type",
        F.col("_dates.incorporation_date").alias("incorporation_date"),
        F.col("_dates.amalgamation_date").alias("amalgamation_date"),
        T.to_date_any(F.col("_dates.incorporation_date")).alias("incorporation_day"),
        T.to_date_any(F.col("_dates.amalgamation_date")).alias("amalgamation_day"),
    )


def extract_previous_names(block) -> Column:
    """Previous names of a block's mark-up (see :func:`previous_names`). A block that holds neither a marker of
    the section nor its label (nor a comment, which might hide them) has none: no tree is made of it."""
    b = block if isinstance(block, Column) else F.col(block)
    marked = F.contains(b, F.lit("<!--")) | b.rlike("[pP](?iu:reviously known as)")
    for c in PREVIOUS_CLASSES:
        marked = marked | F.contains(b, F.lit(c))
    return F.when(marked, T.let(E.elements(b), previous_names)).otherwise(F.array().cast("array<string>"))


def previous_names(nodes: Column) -> Column:
    """Previous names, ordered distinct: the texts of name and value elements
    inside the previous-names section (the first marker of the list that
    occurs), labels left out; if there are none, the section's texts of more
    than three characters that do not say "previously"."""
    def labelled(box):
        label = F.get(box, F.lit(1))
        return F.coalesce(E.sel("span", [LABEL_CLASS])(label) & F.contains(F.lower(label["text"]), F.lit("previously known as")), F.lit(False))

    def names(section):
        found = F.filter(F.transform(E.each(E.inside(section), E.sel("div|span", like="Name|" + VALUE_CLASS, without=[LABEL_CLASS])), E.glued),
                         lambda v: (v != "") & ~F.lower(v).isin("previously known as", "name"))
        texts = F.filter(F.transform(E.strings(section), lambda t: T.collapse_space(T.unescape(t))),
                         lambda t: (F.length(t) > 3) & ~F.contains(F.lower(t), F.lit("previously")))
        return T.let(F.array_distinct(found), lambda f: F.when(F.size(f) > 0, f).otherwise(texts))

    boxes = F.filter(E.each(nodes, E.sel("div", [BOX_CLASS])), labelled)
    section = F.coalesce(*[E.first(nodes, E.sel("div", [c])) for c in PREVIOUS_CLASSES], F.get(boxes, F.lit(0)))
    return T.let(section, lambda x: F.when(x.isNull(), F.array().cast("array<string>")).otherwise(names(x)))


def first_result_block(html) -> Column:
    """First container by the ordered selector fallback list: the first
    three are whole class tokens, the last two class substrings. Returns the
    page from that container's opening tag (leaf fields are searched from
    there on)."""
    h = html if isinstance(html, Column) else F.col(html)
    pats = [r'(?s)(<div[^>]*class="[^"]*' + _token(m) + r'.*)' for m in FIRST_BLOCK_MARKERS[:3]]
    pats += [r'(?s)(<div[^>]*class="[^"]*' + m + r'[^"]*".*)' for m in FIRST_BLOCK_MARKERS[3:]]
    cands = [F.regexp_extract(h, p, 1) for p in pats]
    return F.coalesce(*[F.when(c != "", c) for c in cands])


def no_results_record(name) -> Column:
    """Placeholder record for a page that says there are no results."""
    return F.struct(name.alias("company_name"), F.lit("No Results Found").alias("status"),
                    F.lit(NOT_AVAILABLE).alias("business_type"), F.lit(NOT_AVAILABLE).alias("incorporation_date"),
                    F.lit(NOT_AVAILABLE).alias("location"), F.lit(NOT_AVAILABLE).alias("corporation_number"))


def search_status(success, html) -> Column:
    """``Found`` / ``No Data`` (page says no results) / ``Error`` (failed)."""
    return (F.when(~success, "Error")
            .when(F.contains(html, F.lit("No results found")), "No Data")
            .otherwise("Found"))


def filter_registry(listing: DataFrame, types=None, status: str = "Active", registry: str | None = None) -> DataFrame:
    """Registry filters as column predicates: business type in a list, status, and with ``registry`` given
    the registry itself (``registry_type``, which :func:`extract_details` finds; a record without one is dropped)."""
    from nomen.plans.inputs import BUSINESS_TYPES
    types = types or [t for t in BUSINESS_TYPES if t.startswith("Co-operative") or t == DEFAULT_BUSINESS_TYPE]
    kept = F.col("business_type").isin(*types) & (F.col("status") == status)
    return listing.where(kept if registry is None else kept & (F.col("registry_type") == registry))


# ---------------------------------------------------------------------------
# generic page features (the driver's ``pages`` table)


# Name-candidate selectors in order, as (tag, attribute, substring);
# the positional ``:first-child`` ones follow them in ``name_candidates``.
CANDIDATE_SELECTORS = [
    ("a", "class", "viewMenu"), ("div", "class", "name"), ("h3", None, None), ("h2", None, None),
    ("h1", None, None), ("span", "class", "title"), ("div", "class", "title"), ("a", "href", "view"),
    ("strong", None, None), ("b", None, None),
]
NAV_WORDS = ["view", "details", "more"]


def selector_regex(tag: str, attr: str | None, sub: str | None) -> str:
    a = f'[^>]*\\b{attr}="[^"]*{sub}[^"]*"' if attr else ""
    return f"(?is)<{tag}\\b{a}[^>]*>(.*?)</{tag}>"


def stripped_text(x) -> Column:
    """Text of a fragment as a stripped ``get_text`` gives it: text pieces
    trimmed and glued without separators, entities decoded."""
    v = F.regexp_replace(x if isinstance(x, Column) else F.col(x), r"\s*<[^>]+>\s*", "")
    return F.trim(T.unescape(v))


def tag_texts(html, tag: str, attr: str | None = None, sub: str | None = None) -> Column:
    """Texts of all closed matching elements, in page order."""
    h = html if isinstance(html, Column) else F.col(html)
    raw = F.regexp_extract_all(h, F.lit(selector_regex(tag, attr, sub)), 1)
    return F.transform(raw, lambda x: stripped_text(x))


def extract_company_candidates(html) -> Column:
    """Name candidates by the ordered selector list, ordered distinct, not
    a navigation word, 3-100 characters; the longest wins, the first wins
    ties."""
    cands = F.array_distinct(F.concat(*[tag_texts(html, t, a, v) for t, a, v in CANDIDATE_SELECTORS]))
    cands = F.filter(cands, lambda x: (F.length(x) >= 3) & (F.length(x) <= 100)
                     & ~F.lower(x).isin(*NAV_WORDS))
    best = F.aggregate(cands, F.lit(None).cast("string"),
                       lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))
    return best


def page_features(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    title = T.element_text(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    h1 = T.element_text(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return pages.select(
        "page_id",
        page_size(h).alias("page_size"),
        title.alias("title"),
        h1.alias("h1"),
        F.size(F.regexp_extract_all(h, F.lit(r"(?i)<li[\s>]"), 0)).alias("n_items"),
        F.size(F.regexp_extract_all(h, F.lit(r"(?i)<a\s"), 0)).alias("n_links"),
        T.no_results_flag(h).alias("no_results"),
        F.length(T.truncate_raw(h)).alias("raw_len"),
        extract_company_candidates(h).alias("best_candidate"),
    )


# ---------------------------------------------------------------------------
# whole pages on the element tree

def tree_listing(pages: DataFrame, html: str = "html", keys=("page_id",)) -> DataFrame:
    """``keys..., pos`` and the listing fields of every result block, by the element tree: nested and
    badly closed blocks, other quotes and upper-case tags read as the fallback parser reads them. A page
    without blocks gives no row. The tree is made once per page; its blocks are slices of it."""
    d = pages.select(*keys, E.elements(html).alias("_n"))
    d = d.select(*keys, F.posexplode(E.each(F.col("_n"), E.sel("div", [BLOCK_CLASS]))).alias("pos", "_b"))
    return d.select(*keys, (F.col("pos") + 1).alias("pos"), *[s.find(E.inside(F.col("_b"))).alias(s.name) for s in LISTING_FIELDS])


def parse_pages(pages: DataFrame, name_col: str = "search", html_col: str = "html") -> DataFrame:
    """The rows of ``parse_pages_with(parse_business_details)`` without Python: every result block of every page
    with ``success``, a page without blocks as one row without fields, a missing page as one with an error."""
    d = pages.select(F.col(name_col).alias("business_name"), F.col(html_col).isNotNull().alias("success"), tree_rows(E.elements(html_col)).alias("_b"))
    return listing_rows(d)


def tree_rows(nodes: Column) -> Column:
    """The listing fields of every result block of a page's tree, as an array of structs."""
    names = {"business_name": "company_name", "inc_date": "incorporation_date"}
    def row(b):
        return T.let(E.inside(b), lambda part: F.struct(*[s.find(part).alias(names.get(s.name, s.name)) for s in LISTING_FIELDS]))
    return T.let(nodes, lambda ns: F.transform(E.each(ns, E.sel("div", [BLOCK_CLASS])), row))


def listing_rows(pages: DataFrame) -> DataFrame:
    """One row per result block from ``business_name, success`` and the fields that :func:`tree_rows` gave as ``_b``."""
    d = pages.select("business_name", "success", F.when(~F.col("success"), F.lit("no page")).alias("error_message"), F.explode_outer("_b").alias("_b"))
    return d.select("business_name", "success", "error_message",
                    *[F.col("_b")[c].alias(c) for c in ("company_name", "status", "business_type", "incorporation_date", "location")])


# The positional selectors at the end of the candidate list.
FIRST_CHILD_TAGS = ["div", "a"]
# Selectors of rows that may hold a label and a value, in order; "div > div" comes last.
ROW_SELECTORS = [("div", "row"), ("tr", None), ("div", "item"), ("div", "field"), ("div", "detail"), ("p", None)]
LINK_SKIPPED = ["http", "www", "mailto:"]


def _piece_text(part: Column) -> Column:
    """Text pieces trimmed and glued, references decoded."""
    return F.trim(T.unescape(F.array_join(E.strings(part), "")))


def name_candidates(nodes: Column) -> Column:
    """Texts of the ordered selector list, the positional ones included (an element without an element
    before it under its parent), ordered distinct, longer than two characters, no navigation words."""
    found = []
    for tag, attr, sub in CANDIDATE_SELECTORS:
        found.append(E.each(nodes, E.sel(tag, like=sub if attr == "class" else None, href=sub if attr == "href" else None)))
    firsts = E.first_children(nodes)
    for tag in FIRST_CHILD_TAGS:
        found.append(F.transform(F.filter(firsts, E.sel(tag)), lambda n: E.content(nodes, n)))
    texts = F.array_distinct(F.flatten(F.array(*[F.transform(f, _piece_text) for f in found])))
    return F.filter(texts, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*NAV_WORDS))


def label_value_rows(nodes: Column) -> Column:
    """``array<struct<label, value>>`` of every row that the row selectors find, in selector and page order;
    a row that reads both ways (colon, bold) gives two. ``nodes`` with their closing tags."""
    rows = [E.each(nodes, E.sel(tag, like=like)) for tag, like in ROW_SELECTORS]
    children = F.array_sort(F.flatten(F.transform(E.each(nodes, E.sel("div")), lambda part: F.filter(
        part, lambda n: (n["depth"] == part[0]["depth"] + 1) & (n["tag"] == "div")))))
    rows.append(F.transform(children, lambda n: E.content(nodes, n)))
    marks = F.transform(F.flatten(F.array(*rows)), E.mark_up)
    pairs = F.transform(marks, lambda m: F.array(label_value_pair(m, COLON_RE), label_value_pair(m, BOLD_RE)))
    return F.filter(F.flatten(pairs), lambda x: x.isNotNull())


def first_link_text(nodes: Column) -> Column:
    """Text of the first link with an address and nothing but a text of more than two characters that is no address itself."""
    def text(part):
        alone = (F.size(part) == 1) & (part[0]["href"] != "")
        t = _piece_text(part)
        return T.let(t, lambda x: F.when(alone & (F.length(x) > 2) & ~F.lower(x).rlike("^(" + "|".join(LINK_SKIPPED) + ")"), x))
    return F.get(F.filter(F.transform(E.each(nodes, E.sel("a")), text), lambda x: x.isNotNull()), F.lit(0))


def company_candidate(pages: DataFrame, html: str = "html", keys=("page_id",)) -> DataFrame:
    """``keys..., company_name, source, details`` of a page by the general flow: the longest candidate of
    3 to 100 characters, else the first link's text (``source`` tells which), and the label/value rows as a
    map in which a later row wins."""
    d = pages.select(*keys, E.elements(html, closing=True).alias("_n"))
    n = F.col("_n")
    plain = F.filter(n, lambda x: (x["tag"] != "") | (x["text"] != ""))
    fit = F.filter(name_candidates(n), lambda x: F.length(x).between(3, 100))
    d = d.select(*keys, F.aggregate(fit, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc)).alias("_best"),
                 T.let(F.transform(plain, lambda x, i: x.withField("i", i)), first_link_text).alias("_link"), label_value_rows(n).alias("_rows"))
    last = F.filter("_rows", lambda x, i: ~F.exists(F.slice("_rows", i + 2, F.size("_rows")), lambda y: y["label"] == x["label"]))
    return d.select(*keys, F.coalesce("_best", "_link").alias("company_name"),
                    F.when(F.col("_best").isNotNull(), "candidate").when(F.col("_link").isNotNull(), "link").alias("source"),
                    F.map_from_entries(last).alias("details"))


# ---------------------------------------------------------------------------
# rendering registry records as result mark-up (the inverse of the extractors)


def render_result_block(name, number, registry_type, status, business_type, date, address, form=None) -> Column:
    """One result container in the registry's mark-up; values HTML-escaped.

    ``form`` (0-7) picks the shape the container takes: 1 no status value, 2 a
    value inside nested tags, 3 a registry type with one of its two classes, 4
    accents as references, 5 an amalgamation date, 6 a second, longer address, 7
    no address but previous names."""
    k = F.lit(0) if form is None else form

    def v(x):
        return F.coalesce(T.escape(x), F.lit(""))

    def pick(i, special, plain):
        return F.when(k == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in special])).otherwise(
            F.concat(*[F.lit(x) if isinstance(x, str) else x for x in plain]))

    def box(x):
        return [f'<div class="appMinimalBox {" ".join(ADDRESS_CLASSES)}"><div class="{ADDRESS_VALUE_CLASS}">', x, "</div></div>"]
    status_open = f'<div class="appMinimalBox statusSearchResult"><div class="{" ".join(STATUS_CLASSES)}">'
    type_open = (f'<div class="{" ".join(TYPE_CLASSES)}"><span class="{LABEL_CLASS}">Type</span>'
                 f'<span class="{VALUE_CLASS}">')
    date_open = f'<div class="{" ".join(DATE_CLASSES)}"><span class="{LABEL_CLASS}">'
    return F.concat(
        F.lit(f'<div class="{BLOCK_CLASS} {" ".join(ITEM_BOX)}">'),
        F.lit(f'<div class="{NAME_CLASS}"><a class="viewMenu" href="#view">'
              '<span class="left"></span><span>'),
        F.when(k == 4, F.replace(v(name), F.lit("É"), F.lit("&Eacute;"))).otherwise(v(name)), F.lit(" ("), v(number),
        F.lit(')</span><span class="right"></span></a></div>'),
        pick(3, [f'<div class="{REGISTRY_CLASSES[1]}">'], [f'<div class="{" ".join(REGISTRY_CLASSES)}">']),
        v(registry_type), F.lit("</div>"),
        pick(1, [status_open], [status_open, f'<span class="{LABEL_CLASS}">Status</span><span class="{VALUE_CLASS}">', v(status), "</span>"]),
        F.lit("</div></div>"),
        pick(2, [type_open, "<b><i> ", v(business_type), "</i></b>"], [type_open, v(business_type)]), F.lit("</span></div>"),
        pick(5, [date_open, "Amalgamation"], [date_open, "Incorporation"]),
        F.lit(f' Date</span><span class="{VALUE_CLASS}">'), v(date), F.lit("</span></div>"),
        F.when(k == 7, F.concat(
            F.lit(f'<div class="{PREVIOUS_CLASSES[0]}"><span class="{LABEL_CLASS}">Previously known as</span>'
                  f'<div class="inner"><span class="{VALUE_CLASS}">OLD '), v(name),
            F.lit(f'</span></div><span class="{VALUE_CLASS}">&#69;X&nbsp; '), v(name), F.lit("</span></div>")))
        .when(k == 6, F.concat(*[F.lit(x) if isinstance(x, str) else x
                                 for x in box(v(address)) + box(F.concat(v(address), F.lit(", Second Floor")))]))
        .otherwise(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in box(v(address))])),
        F.lit("</div>\n"),
    )


def render_page(blocks, n_results, total=None) -> Column:
    """A result page: header, pager banner (``total`` results in all), the blocks (array, in order)."""
    total = n_results if total is None else total
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Search</title></head><body>"),
        F.lit(f'<div class="{PAGER_CLASS}">Showing 1 - '), n_results.cast("string"),
        F.lit(" of "), total.cast("string"), F.lit(" results</div>\n"),
        F.array_join(blocks, ""),
        F.when(n_results == 0, F.lit("<p>No results found</p>")).otherwise(F.lit("")),
        F.lit(f'<div class="footer"><div class="appMinimalBox {ADDRESS_CLASSES[0]}"><div class="{ADDRESS_VALUE_CLASS}">'
              "FOOTER OFFICE</div></div></div></body></html>"))


# ---------------------------------------------------------------------------
# smaller extractors of the other page flows

LABEL_MAX, VALUE_MAX, ROW_MIN, ROW_MAX = 50, 200, 10, 1000
# Status / type / location patterns of the concurrent flow.
CONCURRENT_STATUS_RE = r"Active|Inactive|Refer to Ministry"
CONCURRENT_TYPE_RE = r"Co-operative|Corporation|Credit Union"


COLON_RE = r"(?is)^(.*?)[:：]\s*(.*)$"
BOLD_RE = r"(?is)<b>(.*?)</b>\s*(.*?)(?=<br|<p|$)"


def label_value_pair(row: Column, pattern: str) -> Column:
    """struct(label upper-cased, value) of one mark-up row read by ``pattern``, NULL outside the limits
    (row 10-1000 chars, label < 50, value < 200)."""
    def pair(lbl, val):
        ok = ((F.length(row) >= ROW_MIN) & (F.length(row) <= ROW_MAX) & (lbl != "") & (val != "")
              & (F.length(lbl) < LABEL_MAX) & (F.length(val) < VALUE_MAX))
        return F.when(ok, F.struct(lbl.alias("label"), val.alias("value")))
    # each pattern group is read once, however often the limits ask for it
    return T.let(F.upper(F.trim(F.regexp_extract(row, pattern, 1))), lambda lbl: T.let(F.trim(F.regexp_extract(row, pattern, 2)), lambda val: pair(lbl, val)))


def extract_label_value(row) -> Column:
    """``label: value`` (ASCII or full-width colon), else ``<b>label</b> value`` of one mark-up row."""
    r = row if isinstance(row, Column) else F.col(row)
    return F.when(r.rlike(COLON_RE), label_value_pair(r, COLON_RE)).otherwise(label_value_pair(r, BOLD_RE))


def longest_address(addresses) -> Column:
    """Longest non-empty text of an address array (first wins ties)."""
    a = F.filter(addresses, lambda x: x.isNotNull() & (x != ""))
    return F.aggregate(a, F.lit(None).cast("string"),
                       lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))


def extract_concurrent_fields(html, search_name) -> Column:
    """First ``NAME (digits)`` link text -> name, number; status, type, date
    and location by text patterns; a no-results page gives the placeholder."""
    h = html if isinstance(html, Column) else F.col(html)
    # a text that no end of its element follows is not looked into
    link = r">(?=[^<]++</a>)([^<]+?)\s*\((\d+)\)\s*</a>"
    span = r"(?s)>(?=[^<]++</span>)([^<]+?)\s*\((\d+)\)\s*</span>"
    date = r"<span[^>]*>\s*(\w+ \d{1,2}, \d{4})\s*<"
    status = r'<span class="' + VALUE_CLASS + r'">\s*(' + CONCURRENT_STATUS_RE + r')\s*<'
    btype = r"<span[^>]*>\s*([^<]*(?:" + CONCURRENT_TYPE_RE + r")[^<]*?)\s*<"
    loc = r'<div class="' + ADDRESS_VALUE_CLASS + r'">\s*([^<]*Ontario[^<]*Canada)\s*<'

    def na(pattern):
        return T.let(F.regexp_extract(h, pattern, 1), lambda x: F.when(x != "", x).otherwise(F.lit(NOT_AVAILABLE)))

    def record(pattern, num, others):
        names = ("status", "business_type", "incorporation_date", "location")
        return F.struct(T.unescape(F.trim(F.regexp_extract(h, pattern, 1))).alias("company_name"),
                        *[v.alias(n) for n, v in zip(names, others)], num.alias("corporation_number"))
    # each pattern runs once: a link is there when its number is (one digit at least), and only a link has the other fields
    linked = [T.let(F.regexp_extract(h, status, 1), lambda x: F.when(x != "", x).otherwise(F.lit("Active"))), na(btype), na(date), na(loc)]
    plain = [F.lit("Found")] + [F.lit(NOT_AVAILABLE)] * 3
    found = T.let(F.regexp_extract(h, link, 2), lambda n: F.when(n != "", record(link, n, linked)).otherwise(
        T.let(F.regexp_extract(h, span, 2), lambda m: F.when(m != "", record(span, m, plain)))))
    return F.when(T.no_results_flag(h), no_results_record(search_name)).otherwise(found)


def _first_wins(entries: Column) -> Column:
    """Keep the first entry of every key (array<struct<k,v>>)."""
    return F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda y: y["k"] == x["k"]))


def _first_like(part: Column, names: str, tag: str | None = None) -> Column:
    """The first element inside a slice with a class like ``names``; null when there is none."""
    return E.first(E.inside(part), E.sel(tag, like=names))


def _row_pair(row: Column) -> Column:
    """Label and value of a row: its first label-like and value-like elements;
    when either is missing, the first of its classed elements that is a
    ``label`` and the one after it."""
    def either(label, value):
        classed = F.filter(E.inside(row), lambda n: E.sel("span|div")(n) & (F.trim(n["cls"]) != ""))

        def search(ns):
            at = F.array_position(F.transform(ns, lambda n: F.contains(n["cls"], F.lit(" label ")) | F.contains(n["cls"], F.lit(" Label "))), True).cast("int")
            return T.let(at, lambda p: F.when((p > 0) & (F.size(ns) > 1), F.struct(
                _label(E.content(row, ns[p - 1])).alias("k"),
                F.when(p < F.size(ns), E.spaced(E.content(row, F.get(ns, p)))).otherwise(E.spaced(value)).alias("v")))
                .otherwise(F.struct(F.lit("").alias("k"), F.lit("").alias("v"))))
        return F.when(label.isNotNull() & value.isNotNull(), F.struct(_label(label).alias("k"), E.spaced(value).alias("v"))).otherwise(T.let(classed, search))
    return T.let(_first_like(row, LABEL_LIKE), lambda label: T.let(_first_like(row, ROW_VALUE_LIKE), lambda value: either(label, value)))


def _kv(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def _label(part: Column) -> Column:
    return F.upper(F.regexp_replace(E.glued(part), r"^:+|:+$", ""))


def extract_company_fields(blocks: DataFrame, block: str = "block") -> DataFrame:
    """The full field map of a result block as ``info MAP<STRING,STRING>``.

    In order, a key set earlier is never overwritten: COMPANY NAME (view
    link, white space collapsed) and CORPORATION NUMBER (its trailing
    digits), REGISTRY TYPE, STATUS, ADDRESS (longest address text), PREVIOUS
    NAMES (joined by "; "), then every label/value row (label upper-cased,
    ':' stripped; values of date labels lose their commas), BUSINESS TYPE
    from the sub-type attribute and INCORPORATION DATE from the registration
    attribute when still absent, then values not yet seen under the last label
    before them; aliases are renamed; the number is removed from the name.
    Staged projections: each expression runs once.
    """
    from nomen.operators import reports as R
    keep = [c for c in blocks.columns if c != block]
    n = F.col("_n")
    boxes = F.filter(E.each(n, E.sel("div", like=ADDRESS_LIKE)), lambda x: ~(
        F.contains(x[0]["cls"], F.lit(f" {ADDRESS_CLASSES[0]} ")) & ~F.exists(E.inside(x), E.sel("div", [ADDRESS_VALUE_CLASS]))))
    d = blocks.select(*keep, E.inside(E.elements(block)).alias("_n"))
    d = d.select(
        *keep, E.glued(E.first(n, E.sel("a", like=LINK_LIKE))).alias("_name"),
        E.glued(E.first(n, E.sel("div", like=REGISTRY_LIKE))).alias("_reg"),
        E.glued(_first_like(E.first(n, E.sel("div", like=STATUS_LIKE)), VALUE_LIKE)).alias("_status"),
        F.transform(boxes, E.spaced).alias("_addrs"),
        previous_names(n).alias("_prev"),
        F.transform(E.each(n, E.sel("div", like=ROW_LIKE)), _row_pair).alias("_rows"),
        E.glued(_first_like(E.first(n, E.sel("div", like=SUBTYPE_LIKE)), VALUE_LIKE)).alias("_subtype"),
        E.glued(_first_like(E.first(n, E.sel("div", like=REGISTERED_LIKE)), VALUE_LIKE, "span")).alias("_regdate"),
        # labels and values in page order
        F.transform(E.each(n, E.sel("div|span", like=ROW_VALUE_LIKE + "|" + LABEL_LIKE)), lambda x: T.let(
            E.sel(like="appMinimalLabel|label")(x[0]), lambda is_label: F.struct(
                is_label.alias("is_label"), F.when(is_label, _label(x)).otherwise(E.spaced(x)).alias("t")))).alias("_seq"))

    pairs = F.transform("_rows", lambda e: _kv(e["k"], F.when(
        F.contains(F.lower(e["k"]), F.lit("date")), F.replace(e["v"], F.lit(","), F.lit(""))).otherwise(e["v"])))
    entries = F.concat(
        F.array(_kv(F.lit("COMPANY NAME"), F.col("_name")), _kv(F.lit("CORPORATION NUMBER"), T.trailing_number(F.col("_name"))),
                _kv(F.lit("REGISTRY TYPE"), F.col("_reg")), _kv(F.lit("STATUS"), F.col("_status")),
                _kv(F.lit("ADDRESS"), longest_address(F.col("_addrs"))),
                _kv(F.lit("PREVIOUS NAMES"), F.when(F.size("_prev") > 0, F.array_join("_prev", "; ")))),
        pairs,
        F.array(_kv(F.lit("BUSINESS TYPE"), F.col("_subtype")),
                _kv(F.lit("INCORPORATION DATE"), F.when(~F.col("_regdate").startswith("Incorporation"), F.col("_regdate")))))
    d = d.select(*keep, "_seq", F.filter(entries, lambda e: e["k"].isNotNull() & (e["k"] != "")
                                         & e["v"].isNotNull() & (e["v"] != "")).alias("_e"))
    d = d.select(*keep, "_seq", _first_wins(F.col("_e")).alias("_e"))

    def under(x, i):
        before = F.filter(F.slice(F.col("_seq"), F.lit(1), i), lambda y: y["is_label"])
        return _kv(F.when(~x["is_label"] & (F.size(before) > 0), F.get(before, F.size(before) - 1)["t"]), x["t"])
    rest = F.filter(F.transform("_seq", under), lambda r: r["k"].isNotNull() & (r["k"] != "") & (F.length(r["v"]) > 2)
                    & ~F.lower(r["v"]).isin(*COMMON_VALUES)
                    & ~F.exists("_e", lambda e: (e["k"] == r["k"]) | (e["v"] == r["v"])))
    d = d.select(*keep, "_e", rest.alias("_rest"))
    d = d.select(*keep, F.concat("_e", F.filter(_first_wins(F.col("_rest")), lambda e, i: ~F.exists(
        F.slice("_rest", F.lit(1), i), lambda y: y["v"] == e["v"]))).alias("_e"))
    d = d.select(*keep, F.map_from_entries("_e").alias("_m"))
    d = d.select(*keep, R.standardize_fields(F.col("_m")).alias("_m"))
    clean = T.strip_number(F.col("_m")["COMPANY NAME"])
    return d.select(*keep, F.when(F.col("_m")["COMPANY NAME"].isNull(), F.col("_m")).otherwise(
        F.map_concat(F.map_filter("_m", lambda k, v: k != "COMPANY NAME"),
                     F.create_map(F.lit("COMPANY NAME"), clean))).alias("info"))
