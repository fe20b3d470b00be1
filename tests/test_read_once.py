"""Blocks, fields and trees read in one pattern or by plain functions equal those read step by step; lines are read once."""

import random

import pytest
from pyspark.sql import functions as F

from nomen.functions import names as N
from nomen.functions import text as T
from nomen.operators import pages as P
from nomen.operators import reports as R
from nomen.operators import tree as E
from nomen.operators import udf as U

B = P.BLOCK_CLASS


def _old_has(classes):
    return 'class="' + "".join('(?=[^"]*' + P._token(c) + ")" for c in classes) + '[^"]*"'


def _old_value(spec, block):
    """A field as the patterns of its container and its value find it, one after the other."""
    box = T.let(F.regexp_extract(block, "(?s)(<div[^>]*" + _old_has(spec.container) + ".*)", 1), lambda x: F.when(x == "", x).otherwise(P.balanced(x)))
    if spec.value is not None or spec.tag is not None:
        excl = "".join('(?![^>]*class="[^"]*' + P._token(e) + ")" for e in spec.exclude)
        cls = ("[^>]*" + _old_has([spec.value])) if spec.value else ""
        box = F.regexp_extract(box, r"(?s)^<[^>]*>.*?(<(" + (spec.tag or "[a-zA-Z][a-zA-Z0-9]*") + r")\b" + excl + cls + r"[^>]*>.*?(?:</\2\s*>|$))", 1)
    v = T.collapse_space(T.unescape(F.regexp_replace(box, r"\s*<[^>]+>\s*", "")))
    return F.when(v != "", v)


def _old_blocks(h):
    return F.transform(F.filter(F.split(h, P.BLOCK_OPEN_RE), lambda p: p.rlike(P.START_RE)), P.balanced)


def _random_blocks(n):
    rng = random.Random(4)
    classes = [B, P.VALUE_CLASS, P.ADDRESS_VALUE_CLASS, P.NAME_CLASS, "Status", "appMinimalAttr", "left", "x", "registryInfo", *P.TYPE_CLASSES,
               *P.DATE_CLASSES, *P.ADDRESS_CLASSES, *P.REGISTRY_CLASSES]
    out = []
    for _ in range(n):
        parts = [f'<div class="{B}">']
        for _ in range(rng.randrange(1, 30)):
            cls = " ".join(rng.sample(classes, rng.randrange(1, 4)))
            parts.append(rng.choice([f'<div class="{cls}">', f'<div  class="{cls} ">', f'<div title="a > {cls}" class="{cls}">', f"<div class='{cls}'>", f'<DIV class="{cls}">',
                                     f'<span class="{cls}">', f'<span class="{cls}">', "<span>", "</span>", "</span >", "</div>", "</div>", "</div>", "</div >", "</DIV>", "<divider>", "<div",
                                     " t&amp;u ", "Status", "w  v", "A (12)", "\n", "<b>", "</b>", "é", "a < b", "&#73;ncorporation Date January 06, 2025", "Amalgamation May 7 2001"]))
        out.append("".join(parts))
    deep = f'<div class="{B}">' + "<div>" * 11 + '<div class="appMinimalAttr Status"><span class="appMinimalValue">Deep</span></div>' + "</div>" * 12
    return out + [deep, deep.replace("</div>", "", 3), f'<p <div class="{B} <div class="appMinimalAttr Status"><span class="appMinimalValue">No</span></div>']


def test_blocks_fields_and_dates_equal_those_by_pattern(spark):
    rows = [(i, h) for i, h in enumerate(_random_blocks(400))] + [(-1, ""), (-2, None), (-3, "<p>none</p>")]
    d = spark.createDataFrame(rows, "i int, html string").repartition(4)
    h = F.col("html")
    got = d.select("i", P.result_blocks(h).alias("new"), _old_blocks(h).alias("old")).collect()
    assert [r.i for r in got if r.new != r.old] == [] and sum(len(r.new or []) for r in got) > 400
    fields = P.LISTING_FIELDS + [P.REGISTRY_FIELD]
    for s in fields:
        got = d.select("i", s.column(h).alias("new"), _old_value(s, h).alias("old")).collect()
        assert [r.i for r in got if r.new != r.old] == [], s
        assert any(r.new for r in got), s
    attr = _old_has([P.ATTR_CLASS])
    texts = F.transform(P.all_elements(h, "div", attr), lambda x: T.extract_date(P.spaced_text(x)))
    last = [F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(texts, lambda x: x[f]), lambda v: v.isNotNull())), -1) for f in ("incorporation_date", "amalgamation_date")]
    got = d.where("i >= 0").select("i", P.attr_dates(h).alias("new"), F.struct(*last).alias("old")).collect()
    assert [r.i for r in got if tuple(r.new) != tuple(r.old)] == [] and any(r.new[0] for r in got)


@pytest.mark.parametrize("spec", P.LISTING_FIELDS + [P.REGISTRY_FIELD], ids=lambda s: s.name)
def test_plain_values_are_found_by_their_last_class(spark, spec):
    """The text of a plain value comes out of one pattern that starts with a fixed text."""
    tag = spec.tag or "span"
    inner = "Co &amp; Co" if spec.value is None and spec.tag is None else f'<{tag}{f" class={chr(34)}{spec.value}{chr(34)}" if spec.value else ""}>Co &amp; Co</{tag}>'
    block = f'<div class="{B}"><div class="{" ".join(spec.container)}">{inner}</div></div>'
    group = 1 if spec.value is None and spec.tag is None else 2
    r = spark.createDataFrame([(block,)], "b string").select(F.regexp_extract("b", spec._near_re(), group).alias("near"), spec.column(F.col("b")).alias("v")).first()
    assert (r.near, r.v) == ("Co &amp; Co", "Co & Co")


def test_plain_pages_have_the_tree_of_the_parser(spark):
    rng = random.Random(9)
    pages = ['<div class="a b"><p>x</p><br>t<a href="/q?a=b" class="c">l > k</a></div>', "<!DOCTYPE html><html><body><p>1</p>2</body></html>"]
    for _ in range(150):
        out, todo = [], []
        for _ in range(rng.randrange(1, 30)):
            tag = rng.choice(["div", "p", "b", "span", "a", "li"])
            pick = rng.randrange(5)
            if pick < 2:
                todo.append(tag)
                out.append(rng.choice([f"<{tag}>", f'<{tag} class="x y">', f'<{tag} title="t u" class="z">']))
            elif todo and pick < 4:
                out.append(f"</{todo.pop()}>")
            else:
                out.append(rng.choice([" t ", "<br>", "&amp;u"]) if out else "<br>")
        pages.append("".join(out + [f"</{t}>" for t in reversed(todo)]))
    deep = "<b>" * 120 + "x" + "</b>" * 120
    odd = ["<p><b></p></b>", "<p>", "</p>", "x<p></p>", "<p class='a'></p>", '<p title="a=b" class="q"></p>', "<br/>", "<P></P>", "<script>a</script>", "<p><!-- x --></p>", "", deep]
    d = spark.createDataFrame([(i, h) for i, h in enumerate(pages + odd)], "i int, html string")
    plain = E._plain_nodes(F.col("html"), False)
    rows = d.select("i", F.when(F.col("html").rlike(E.PLAIN_RE), plain).isNotNull().alias("plain"), F.transform(E.each(E.elements("html"), E.sel()), lambda x: F.struct(
        x[0]["tag"].alias("tag"), F.trim(x[0]["cls"]).alias("cls"), x[0]["href"].alias("href"), E.glued(x).alias("text"))).alias("e")).collect()
    for r in rows:
        assert r.plain == (r.i < len(pages)), (pages + odd)[r.i]
        tree = U._Tree()
        tree.feed((pages + odd)[r.i])
        tree.close()
        want = [(n[0], n[1], "" if n[0] in U._VOID else U._text(n) or "") for n in U._inside(tree.root)]
        assert [(e.tag, set(e.cls.split()), "" if e.tag in U._VOID else e.text) for e in r.e] == want, (pages + odd)[r.i]
    assert [e.href for r in rows if r.i == 0 for e in r.e if e.tag == "a"] == ["/q?a=b"]


def test_lines_are_read_once(spark):
    """An expression that a lambda names stands in it as often as it is named: the lines were cut again for every line."""
    for c in (R.parse_pairs_strict("b"), R.pairs_from_lines(F.split("b", "\n")), R.pairs_from_lines(F.split("b", "\n"), last_wins=False)):
        assert str(c).count("split(") == 1
    assert str(T.let(F.upper("b"), lambda v: F.concat(v, v))).count("upper(") == 1
    d = spark.createDataFrame([("k: 1\n x : 2 \nk: 3\nno\n: z\ny:  ",)], "b string")
    r = d.select(R.parse_pairs_strict("b").alias("s"), R.pairs_from_lines(F.split("b", "\n")).alias("l"), R.pairs_from_lines(F.split("b", "\n"), last_wins=False).alias("f")).first()
    assert (r.l, r.f) == ({"K": "3", "X": "2"}, {"K": "1", "X": "2"}) and r.s["k"] == "3"


def test_strip_clean_dates_and_flags(spark):
    rows = ["a", " a", "a ", "a  b", "", " ", " a ", "a\n", "&amp;", "a&b c", "é é", "January 06, 2025", "January 6 2025", "January 06 2025,", ",", "NO RESULTS found", "x No Matches", "no result", None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    old_day = F.coalesce(*[F.to_date(F.try_to_timestamp("v", F.lit(f))) for f in T.DATE_FORMATS])
    got = d.select("v", N.py_strip_once("v").alias("a"), N.py_strip("v").alias("b"), T.clean(F.col("v")).alias("c"), T.collapse_space(T.unescape("v")).alias("d"),
                   T.to_date_any("v").alias("e"), old_day.alias("f"), T.no_results_flag("v").alias("g"),
                   F.coalesce(F.col("v").rlike(r"(?i)no results found|no matches"), F.lit(False)).alias("h")).collect()
    for r in got:
        assert (r.a, r.c, r.e, r.g) == (r.b, r.d, r.f, r.h), r.v
    assert sum(r.e is not None for r in got) == 2 and sum(r.g for r in got) == 2


def test_section_blocks_keep_their_places(spark):
    text = "head\n--- Result #1 ---\n\n--- Result #2 ---\n Business Name: A \n\n" + R.RULE60 + "\n\nSEARCH: x"
    d = spark.createDataFrame([("f", text), ("n", None)], "file_no string, value string")
    assert [tuple(r) for r in R.split_search_blocks(d).collect()] == [("f", 2, "Business Name: A")]
