"""Element tree of a page or block as one array column, made in one pass.

``elements(html)`` gives the nodes in page order: ``tag`` (lower case), ``cls``
(the class attribute with a space at either end), ``href``, ``depth``, ``text``
(what stands between this tag and the next) and the mark-up itself (``raw``).
Closing tags stay as nodes without a tag, on the depth of the element that
they close, where text follows them. An element is followed by its content, up
to the next node that is not deeper; so an element *with* its content is a slice of
the array, and every function here takes and gives such slices
(``array<node>``), the element itself first. Selectors are predicates on a node (``sel``).

Built-in expressions only. Quotes may be single, double or missing, tags in
either case; void elements have no content; a closing tag ends what was left
open inside it, one without an opening is ignored — as in the standard
library's ``html.parser`` under ``nomen.operators.udf``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomen.functions import text as T

# Elements without content; elements whose content is no mark-up.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW_RE = r"(?is)<!--.*?-->|(<(script|style)\b[^>]*+>).*?(</\2\s*>)"
# a tag with its quoted values and the text behind it, or the text before the first tag
TOKEN_RE = r"""</?[a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>[^<]*+(?:<(?!/?[a-zA-Z])[^<]*+)*+|^[^<]++"""
TAG_RE = r"""^</?[a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
SELF_CLOSED_RE = r"""^<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>(?<=/>)"""
# plain mark-up, none of whose tags needs a pattern of its own: names in small letters, double-quoted values that neither hold a tag
# nor look like another attribute; nothing before the first tag
PLAIN_RE = (r"""^(?:<!DOCTYPE html>(?=<))?+(?:<(?:/[a-z][a-z0-9]*+|(?!(?:script|style)[ >])[a-z][a-z0-9]*+(?: (?:href="[^"<>\s]*+"|[a-z]++="[^"<>=]*+"))*+)>"""
            r"""[^<]*+)++\z""")
DEEP = 90    # a plain page nests less deep: a depth is one letter then
DIGITS = 5   # of a depth in the string that the pass collects

FIRST = 34   # the letter of depth 0
ALL = 1 << 30   # length of a slice up to the end; asking for the size would make the array twice

Predicate = Callable[[Column], Column]


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute; empty when absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.when(F.contains(tag, F.lit("=")), F.regexp_replace(F.regexp_extract(tag, pattern, 1), "^[\"']|[\"']$", "")).otherwise(F.lit(""))


def _tokens(html: Column) -> Column:
    """``array<struct<tag, end, void, raw, k>>``: a tag and the text behind it; ``tag`` is empty for leading text."""
    plain = T.let(html, lambda h: F.when(F.contains(h, F.lit("<!--")) | h.rlike("(?i)<script|<style"), F.regexp_replace(h, RAW_RE, "$1$3")).otherwise(h))

    def token(x, k):
        # the name ends at the first white space or ">"; plain string functions, as this runs for every tag
        head = F.substring_index(F.translate(F.substring_index(x, ">", 1), "\t\n\r\f", "    "), " ", 1)
        return T.let(F.when(F.startswith(x, F.lit("<")), F.lower(F.translate(head, "</", ""))).otherwise(F.lit("")), lambda t: F.struct(
            t.alias("tag"), F.startswith(x, F.lit("</")).alias("end"),
            ((t == "") | t.isin(*VOID) | (F.contains(x, F.lit("/>")) & x.rlike(SELF_CLOSED_RE))).alias("void"), x.alias("raw"), k.alias("k")))
    return F.transform(F.regexp_extract_all(plain, F.lit(TOKEN_RE), 0), token)


def _walk(tokens: Column) -> Column:
    """``struct<path, open, depths, regular>`` after all tokens: the tags still open and their number, the depth of every
    token as digits (of a closing tag that of its element; text behind an ignored one is on the depth of its siblings).
    ``regular``: every closing tag fitted the innermost open one."""
    def step(acc, t):
        path, n = acc["path"], acc["open"]
        name = F.concat(F.lit(","), t["tag"], F.lit(","))

        def state(new, count, at, fits):
            return F.struct(new.alias("path"), count.alias("open"), F.concat(acc["depths"], F.lpad(at.cast("string"), DIGITS, "0")).alias("depths"), (acc["regular"] & fits).alias("regular"))

        def misfit(found):
            # everything from the last open element of the name on is closed; without one the tag is ignored
            return T.let(F.when(found > 0, F.substring(path, F.lit(1), F.length(path) - found - F.length(t["tag"]))).otherwise(path), lambda x: T.let(
                F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))) - 1, lambda left: state(x, left, left + 1, F.lit(False))))
        return (F.when(~t["end"] & ~t["void"], state(F.concat(path, t["tag"], F.lit(",")), n + 1, n + 1, F.lit(True)))
                .when(t["end"] & F.endswith(path, name), state(F.substring(path, F.lit(1), F.length(path) - F.length(t["tag"]) - 1), n - 1, n, F.lit(True)))
                .when(t["end"], T.let(F.position(F.reverse(name), F.reverse(path)), misfit))
                .otherwise(state(path, n, n + 1, F.lit(True))))
    return F.aggregate(tokens, F.struct(F.lit(",").alias("path"), F.lit(0).alias("open"), F.lit("").alias("depths"), F.lit(True).alias("regular")), step)


def _plain_nodes(html: Column, closing: bool) -> Column:
    """The nodes of a plain page (``PLAIN_RE``) with plain string functions; null where a closing tag does not fit, an element is
    left open or lies too deep."""
    def piece(p, k):
        return F.struct(p.alias("p"), F.substring_index(F.substring_index(p, ">", 1), " ", 1).alias("t"), k.alias("k"))

    def step(acc, x):
        t, path, n = x["t"], acc["path"], acc["open"]

        def state(new, count, at):
            return F.struct(new.alias("path"), count.alias("open"), F.concat(acc["depths"], F.char(at + FIRST)).alias("depths"))
        # a closing tag is "/name": it fits where the path ends with it
        return (F.when(F.startswith(t, F.lit("/")), state(F.when(F.endswith(path, F.concat(t, F.lit("/"))), F.substring(path, F.lit(1), F.length(path) - F.length(t))), n - 1, n))
                .when(t.isin(*VOID), state(path, n, n + 1))
                .otherwise(state(F.when(n < DEEP, F.concat(path, t, F.lit("/"))), n + 1, n + 1)))

    def nodes(xs):
        start = F.struct(F.lit("/").alias("path"), F.lit(0).alias("open"), F.lit("").alias("depths"))
        kept = xs if closing else F.filter(xs, lambda x: ~(F.startswith(x["t"], F.lit("/")) & F.endswith(x["p"], F.lit(">"))))

        def node(x, i, depths):
            end, p = F.startswith(x["t"], F.lit("/")), x["p"]
            return F.struct(i.alias("i"), F.when(end, F.lit("")).otherwise(x["t"]).alias("tag"),
                            F.when(end, F.lit("")).otherwise(F.concat(F.lit(" "), F.regexp_extract(p, '^[^ >]*+[^>]*? class="([^"]*+)', 1), F.lit(" "))).alias("cls"),
                            F.when(x["t"] == "a", F.regexp_extract(p, '^a[^>]*? href="([^"]*+)', 1)).otherwise(F.lit("")).alias("href"),
                            (F.ascii(F.substring(depths, x["k"] + 1, F.lit(1))) - FIRST).alias("depth"),
                            F.substring(p, F.instr(p, ">") + 1, F.lit(ALL)).alias("text"), F.concat(F.lit("<"), p).alias("raw"))
        return T.let(F.aggregate(xs, start, step), lambda w: F.when(w["path"] == "/", T.let(w["depths"], lambda d: F.transform(kept, lambda x, i: node(x, i, d)))))
    pieces = F.filter(F.split(html, "<"), lambda p: (p != "") & ~F.startswith(p, F.lit("!")))
    return T.let(F.transform(pieces, piece), nodes)


def elements(html, closing: bool = False, only_regular: bool = False) -> Column:
    """The nodes of a page or block (see the module's notes); an empty array for null. Closing tags
    without text are left out unless ``closing`` (only :func:`mark_up` needs them). ``only_regular``: null
    where :func:`regular` is false, told from the same pass."""
    def nodes(tokens):
        def node(t, i, depths):
            return F.struct(i.alias("i"), F.when(t["end"], F.lit("")).otherwise(t["tag"]).alias("tag"),
                            F.when(t["end"], F.lit("")).otherwise(F.concat(F.lit(" "), _attribute(t["raw"], "class"), F.lit(" "))).alias("cls"),
                            F.when((t["tag"] == "a") & ~t["end"], _attribute(t["raw"], "href")).otherwise(F.lit("")).alias("href"),
                            F.substring(depths, t["k"] * DIGITS + 1, F.lit(DIGITS)).cast("int").alias("depth"),
                            F.regexp_replace(t["raw"], TAG_RE, "").alias("text"), t["raw"].alias("raw"))
        kept = tokens if closing else F.filter(tokens, lambda t: ~t["end"] | ~F.endswith(t["raw"], F.lit(">")))
        return T.let(_walk(tokens), lambda w: T.let(w["depths"], lambda d: F.when(
            w["regular"] & (w["open"] == 0) if only_regular else F.lit(True), F.transform(kept, lambda t, i: node(t, i, d)))))
    h = html if isinstance(html, Column) else F.col(html)
    # most pages are plain and regular: their nodes need no pattern for a tag
    return T.let(F.coalesce(h, F.lit("")), lambda x: T.let(F.when(x.rlike(PLAIN_RE), _plain_nodes(x, closing)), lambda ns: F.when(
        ns.isNotNull(), ns).otherwise(T.let(_tokens(x), nodes))))


def regular(html) -> Column:
    """Every closing tag fits the innermost open element and none is left open: pages of which all parsers make one tree."""
    h = html if isinstance(html, Column) else F.col(html)
    return T.let(_walk(_tokens(F.coalesce(h, F.lit("")))), lambda w: w["regular"] & (w["open"] == 0))


def sel(tag: str | None = None, cls: tuple | list = (), like: str | None = None, without: tuple | list = (), href: str | None = None) -> Predicate:
    """Opening tags: of ``tag`` (``a|b`` for several), with all class tokens of ``cls`` and none of ``without``, with one
    of the names of ``like`` (``a|b``) anywhere in the class attribute, with ``href`` in the link."""
    def test(n):
        ok = n["tag"].isin(*tag.split("|")) if tag else n["tag"] != ""
        spaced = n["cls"]
        for c in cls:
            ok = ok & F.contains(spaced, F.lit(f" {c} "))
        for c in without:
            ok = ok & ~F.contains(spaced, F.lit(f" {c} "))
        if like:
            names = [F.contains(spaced, F.lit(x)) for x in like.split("|")]
            some = names[0]
            for x in names[1:]:
                some = some | x
            ok = ok & some
        return ok & F.contains(n["href"], F.lit(href)) if href else ok
    return test


def content(nodes: Column, n: Column) -> Column:
    """The slice of element ``n`` of ``nodes``: itself and what lies in it."""
    rest = F.slice(nodes, n["i"] - nodes[0]["i"] + 2, F.lit(ALL))
    return T.let(rest, lambda r: T.let(F.array_position(F.transform(r, lambda x: x["depth"] <= n["depth"]), True).cast("int"), lambda p: F.concat(
        F.array(n), F.when(p > 0, F.slice(r, F.lit(1), p - 1)).otherwise(r))))


def each(nodes: Column, test: Predicate) -> Column:
    """The slices of all elements that pass, in page order, nested ones included."""
    return T.let(nodes, lambda ns: F.transform(F.filter(ns, test), lambda n: content(ns, n)))


def first(nodes: Column, test: Predicate) -> Column:
    """The slice of the first element that passes; null when there is none."""
    return T.let(nodes, lambda ns: T.let(F.get(F.filter(ns, test), F.lit(0)), lambda n: F.when(n.isNotNull(), content(ns, n))))


def inside(part: Column) -> Column:
    """What lies in an element, without itself."""
    return F.slice(part, F.lit(2), F.lit(ALL))


def first_children(nodes: Column) -> Column:
    """Elements without an element sibling before them."""
    opening = F.filter(nodes, lambda n: n["tag"] != "")
    return T.let(opening, lambda ns: F.filter(ns, lambda n, i: F.when(i == 0, F.lit(True)).otherwise(F.get(ns, i - 1)["depth"] == n["depth"] - 1)))


def strings(part: Column) -> Column:
    """The texts of a slice, trimmed."""
    return F.transform(F.filter(part, lambda n: n["text"] != ""), lambda n: F.regexp_replace(n["text"], r"^\s+|\s+$", ""))


def glued(part: Column) -> Column:
    """Text of a slice: pieces trimmed and glued, references decoded, spaces collapsed; empty for null."""
    return F.coalesce(T.collapse_space(T.unescape(F.array_join(strings(part), ""))), F.lit(""))


def spaced(part: Column) -> Column:
    """Text of a slice with a space between its pieces; empty for null."""
    return F.coalesce(T.collapse_space(T.unescape(F.array_join(strings(part), " "))), F.lit(""))


def mark_up(part: Column) -> Column:
    """An element as it stands in the page (from ``elements(.., closing=True)``)."""
    return F.concat(F.array_join(F.transform(part, lambda n: n["raw"]), ""), F.lit("</"), part[0]["tag"], F.lit(">"))
