"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import base64
import functools
import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomen.llm import bpe, exact_dedup, fingerprint, html_extract, language_id, mixing, quality, simhash, substring_dedup, toxicity
from nomen.llm._text import text_buffers

SCHEMA = "doc_id long, text string, lang string, source string, id long, row string, n int, fp string, score string, kept string"
rng = random.Random(4)
VOCAB = [w + s for w in ("alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "ember") for s in ("", "s", "ing", "ed", "er")]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@functools.cache
def rows():
    base, shared = [prose(60) for _ in range(12)], prose(30)
    texts = [*base, base[0], base[0] + " \n", "  " + base[1].replace(" ", "\t"), base[2] + " x", None, "", " \n\t ", "one two",
             f"{prose(20)} {shared} {prose(9)}", f"{prose(5)}\n{shared} {prose(25)}", f"{shared}. {shared}", prose(20000), "Ünï cödé 漢字 " + prose(15), base[3][:200]]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, base[4], None, "s1"), (None, None, None, None)]
    return [(*r, 1, "x", 2, "y", "z", "k") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for r in rows():
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    assert len(got) == len(rows()) and sum(r.kept for r in got) == len(groups)
    keep = {}
    for g in groups.values():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in g:
            keep[r[0]] = (best[0], len(g))
    assert all((r.keep_id, r.group_size) == keep[r.doc_id] for r in got if r.doc_id is not None)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_substring_dedup(docs, none):
    got = substring_dedup.substring_dedup(docs).collect()
    first, words = {}, [(r[0], (r[1] or "").encode().split()) for r in rows()]
    key = lambda i: substring_dedup.NO_ID if i is None else i
    for i, w in words:
        for j in range(len(w) - 12):
            t = tuple(w[j:j + 13])
            first[t] = min(first.get(t, key(i)), key(i))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < key(i):
                gone[j:j + 13] = [True] * 13
        want.append((key(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_winnowing_keeps_an_anchor_of_every_window():
    x = np.array([rng.randrange(50) for _ in range(500)], np.uint64)
    at = substring_dedup.sliding_min(x, 9)
    assert all(i <= a < i + 9 and x[a] == x[i:i + 9].min() and (x[i:a] > x[a]).all() for i, a in enumerate(at))


def test_simhash(docs, none):
    import xxhash
    got = simhash.simhash_groups(docs, chunk_size=2).collect()

    def brute(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(r[0], brute(r[1])) for r in rows()]
    comp = list(range(len(fps)))
    for _ in fps:
        for a, (_, x) in enumerate(fps):
            for b, (_, y) in enumerate(fps):
                if (x ^ y).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    low = {c: min((fps[i][0] for i in range(len(fps)) if comp[i] == c and fps[i][0] is not None), default=None) for c in comp}
    want = sorted(((-1 if i is None else i), x, low[c]) for (i, x), c in zip(fps, comp))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.fp % 2 ** 64, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(set(comp))
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize("chunk", [3, simhash.CHUNK])
def test_anchors_lose_no_pair(spark, chunk):
    r = np.random.default_rng(1)
    base = r.integers(0, 2 ** 64, 60, np.uint64)
    f = [base]
    for _ in range(12):        # dense groups of fingerprints a few bits apart
        x = base.copy()
        for _ in range(3):
            x ^= np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64)
        f.append(x)
    f = np.unique(np.concatenate(f))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    comp = {x.node: x.root for x in simhash.components(simhash.near_links(df, 3, chunk)).collect()}
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    parent = list(range(len(f)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            parent[find(int(j))] = find(i)
    roots = {}
    for x, i in at.items():
        roots.setdefault(find(i), set()).add(comp.get(x, x))
    assert all(len(v) == 1 for v in roots.values()) and len({next(iter(v)) for v in roots.values()}) == len(roots)


def test_golay_code_is_perfect():
    words = np.arange(1 << 11)
    assert len(set(simhash.remainder(words).tolist())) == 2048
    assert (simhash.coset_tables(0)[0][1] == 1).all()


def test_mixing(docs, none):
    got = mixing.taken_words(docs).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, mixing.taken_words(docs.repartition(5)).collect()))
    assert all(0 <= r.taken <= 3 * r.size for r in got) and len(got) == len(rows())
    source = {r[0]: r[3] for r in rows() if r[0] is not None}
    total = sum(r.size for r in got)
    target = {r.target for r in got}
    assert abs(sum(r.taken for r in got) - total) <= 4 and all(t <= 3 * total for t in target)
    by = {}
    for r in got:
        if r.doc_id is not None:
            by.setdefault(source[r.doc_id], [0, r.target])[0] += r.taken
    for r in got:
        if r.doc_id is None:
            by[("s1" if r.size else None)][0] += r.taken
    assert all(abs(a - b) <= 1 for a, b in by.values())
    mixed = mixing.mixed_rows(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    assert mixed and {"_shard", "_place"} <= set(mixed[0].asDict())
    assert mixing.taken_words(none).count() == 0


def test_targets_and_tree():
    assert mixing.weighted_targets([100, 10, 10], [1, 2, 3]) == pytest.approx([60, 30, 30])
    assert mixing.weighted_targets([0, 0], [1, 2]) == [0, 0] and mixing.weighted_targets([], []) == []
    q = np.array([10, 0, 77, 3])
    t = mixing.splitting_tree(q, 7, 1)
    assert t.shape == (7, 4) and (t.sum(axis=0) == q).all() and (t >= 0).all()


def test_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe_encode(docs, path, P.PATTERN, carry=[F.col("text").alias("t"), F.col("id")]).collect()
    for r in got:
        ids = enc.encode_ordinary(r.t or "")
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids) and bytes(r.decoded).decode() == (r.t or "")
    assert bpe.bpe_encode(none, path, P.PATTERN).count() == 0
    own = bpe.Bpe(ranks, P.PATTERN)
    signs = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "Zebra", "'s", "'", "don't", "'LL", "12", "³", "漢字", "é", "é",
             "🙂", "<|endoftext|>", "=" * 300, "!!", "aaaa", "\x00", "ﬁ", "٣"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(4000)]
    ids, at = own.encode(texts)
    bad = [t for t, a, b in zip(texts, at[:-1], at[1:]) if ids[a:b].tolist() != enc.encode_ordinary(t)]
    assert not bad, bad[:5]
    assert own.decode(ids).tobytes().decode() == "".join(texts)


def test_fingerprint(spark, docs, none):
    got = fingerprint.compare_with_edits(docs, ranges=5).collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((-1 if r[0] is None else r[0], len(t), hashlib.sha256((t[:len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.compare_with_edits(none).count() == 0
    t = spark.createDataFrame([("a one\nb two\nc", "c\na one\nb two", "b two", "a one\nc")], "x string, y string, p string, rest string")
    fp = {c: fingerprint.fingerprint(F.col(c)) for c in t.columns}
    r = t.select((fp["x"] == fp["y"]).alias("same"), (fingerprint.delete(fp["x"], fp["p"]) == fp["rest"]).alias("less"),
                 (fingerprint.insert(fp["rest"], fp["p"]) == fp["x"]).alias("more"), (fp["x"] == fp["rest"]).alias("other")).first()
    assert r.same and r.less and r.more and not r.other


def test_fingerprint_of_very_long_texts(spark):
    n = 50_000
    a, b = ([f"line {i} of {x}" for i in range(n)] for x in "ab")
    t = spark.createDataFrame([("\n".join(a), "\n".join(b), "\n".join(a[: n // 2] + b[n // 2:]), "same\n" * n)], "a string, b string, half string, same string")
    t = t.select(*[fingerprint.fingerprint(F.col(c)).alias(c) for c in t.columns]).cache()
    fp = {c: F.col(c) for c in t.columns}
    r = t.select(fingerprint.likeness(fp["a"], fp["b"]).alias("other"), fingerprint.likeness(fp["a"], fp["half"]).alias("half"),
                 fingerprint.likeness(fp["a"], fp["same"]).alias("same"), (fingerprint.delete(fingerprint.insert(fp["a"], fp["same"]), fp["same"]) == fp["a"]).alias("back")).first()
    assert r.other < 0.35 and r.same < 0.35 and 0.3 < r.half < 0.7 and r.back


def test_html():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a></li>"
            "<li>A very long menu entry which reads like prose, with commas and a full stop at its end.</li></ul></nav><!-- x <p>no</p> --><div class=\"ad\">Buy this now, it is the best product there is, says everyone.</div>"
            "<article><h1>Head &amp; line</h1><p><b>First\n  part.<br><p>Some longer paragraph of the article, with &eacute;&#233;&#x41; and so on and so forth.</p><p>Be.</p>"
            "<div class='comments'><p>A reader comment that is rather long and looks like an article paragraph.</p></div></article><form>Your name <input></form><footer>&copy; site</footer>")
    assert html_extract.main_text(page) == "Head & line First part. Some longer paragraph of the article, with ééA and so on and so forth. Be."
    assert html_extract.main_text(None) == "" == html_extract.main_text("<nav>x</nav>") and html_extract.main_text("") == ""


def test_html_attributes_are_read_by_full_name():
    p = "<p>A paragraph of the article, long enough to count as text, with a full stop at its end.</p>"
    want = "A paragraph of the article, long enough to count as text, with a full stop at its end."
    for tag in ('article data-title="The hidden cost"', 'div title="Hidden valleys"', 'div data-overflow="hidden"', 'div data-id="search-12"', "div data-class='sidebar'",
                'div title="x" data-x="id=menu class=nav hidden"', 'div class="story"title="a hidden b"'):
        assert html_extract.main_text(f"<body><{tag}>{p}</{tag.split()[0]}></body>") == want, tag
    for tag in ("div hidden", "div title='x' HIDDEN=''", 'div data-x="y" aria-hidden="true"', "div id=search-12", 'div style="display: none"'):
        assert html_extract.main_text(f"<body><{tag}>{p}</div></body>") == "", tag


def test_html_siblings_have_one_parent():
    long = ["The first paragraph of a text that is long enough to be one of its own, with a full stop at the end. " * 2, "Another paragraph, as long as that, with a full stop at its end as well. " * 3]
    text = "".join(f"<p>{p}</p>" for p in long)
    want = " ".join(p.strip() for p in long)
    teaser = "<p>More on this <a href='/x'>Stories</a></p>"
    assert html_extract.main_text(f"<body><div>{text}</div><div>{teaser}</div></body>") == want
    assert html_extract.main_text(f"<body><div>{text}{teaser}</div></body>") == f"{want} More on this Stories"
    blocks = html_extract.blocks_of("<body><div><h2>a</h2><p>b</p><pre>c</pre></div><div><div><p>d</p></div></div></body>")
    edges = html_extract.edges_of(blocks)
    assert edges[0, 2] == html_extract.SIBLING and edges[0, 1] == edges[1, 2] == html_extract.SAME_PARENT
    assert edges[2, 3] < html_extract.NEIGHBOUR and edges[1, 3] < html_extract.SIBLING / 2


def test_min_cut_is_minimal():
    for _ in range(60):
        n = rng.randrange(1, 8)
        u = [rng.uniform(-2, 2) for _ in range(n)]
        e = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(abs(v) for v, k in zip(u, x) if (v > 0) != k) + sum(w for (i, j), w in e.items() if x[i] != x[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(u, e)) == pytest.approx(best)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "<article><p>x y</p></article>", "v")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df, carry=[F.col("page_id")]).collect()}
    assert got == {1: "", 2: "x y"}
    assert html_extract.extract(df.limit(0)).count() == 0


def test_toxic_words_are_restored(spark):
    clean = spark.createDataFrame([("the idiot told a stupid loser in the radio studio that the priority is to do its duty, so do it",)] * 3, "text string")
    costs = toxicity.letter_model(clean)
    assert toxicity.restore("An 1d10t and a $tup1d one", costs).split()[1::3] == ["idiot", "stupid"]
    assert toxicity.restore("l o s e r", costs) == "loser" and toxicity.restore("s.t.u.p.i.d", costs) == "stupid"
    assert toxicity.restore("stuuuupid", costs) == "stupid"
    assert toxicity.restore("nothing to see", costs) == "nothing to see"


def letters(spark):
    lines = ["you are a loser and a stupid idiot and I hate you", "I hate it when a letter comes, the idiot said", "all i see is a good book that will tell",
             "stupid letter from a loser in a blue flat", "the black flag on a block is in it as if it is an inn"]
    return toxicity.letter_model(spark.createDataFrame([(t,) for t in lines * 20], "text string"))


def test_toxic_separators_are_decoded(spark):
    model = letters(spark)
    assert toxicity.restore("you are a l o s e r", model) == "you are a loser"
    assert toxicity.restore("I h a t e it", model) == "i hate it"
    assert toxicity.restore("s t u p i d i d i o t", model) == "stupid idiot"
    assert toxicity.restore("s.t.u.p.i.d. i.d.i.o.t", model) == "stupid idiot"
    assert [toxicity.restore(t, model) for t in ("a lo ser", "st upid", "id.iot", "stu pid")] == ["a loser", "stupid", "idiot", "stupid"]
    assert toxicity.restore("a stupid idiot and a loser", model) == "a stupid idiot and a loser"


def test_toxic_doubled_letters(spark):
    model = letters(spark)
    assert toxicity.restore("stuupid iddiot losser", model) == "stupid idiot loser"
    assert toxicity.restore("a good letter will tell all", model) == "a good letter will tell all"


def test_letter_model_has_longer_contexts(spark):
    model = letters(spark)
    assert [toxicity.restore(t, model) for t in ("1oser", "|oser", "b1ock", "f1ag")] == ["loser", "loser", "block", "flag"]
    more = toxicity.letter_model(spark.createDataFrame([("other words give other runs of letters",), ("none of both",)], "text string"))
    assert len(model.codes) > len(more.codes) > 30 and len(set(model.codes.tolist())) == len(model.codes)
    assert np.exp(-model.costs.reshape(-1, toxicity.CLASSES).astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-3)


def labelled(spark):
    bad = ["idiot", "1d10t", "loser", "l0ser"]
    out, labels = [], []
    for i in range(400):
        y = i % 4 == 0
        w = prose(30).split()
        if y:
            w[3:3] = [bad[i // 4 % 4], bad[(i // 4 + 1) % 4]]
        out.append((i, " ".join(w)))
        labels.append((i, int(y)))
    out += [(1000, None), (1001, ""), (None, "idiot")]
    labels += [(1000, None), (None, 1), (5, 0)]
    return spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(400)]) > 0.97
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_quality(spark):
    out = [(i, prose(40) if i % 3 else " ".join(w + "$$$" for w in prose(40).split())) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(out, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in range(300)]) > 0.97
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_language(spark):
    words = {"en": "the of and this that with", "de": "der die und nicht ein über", "fr": "le la été dans une pour"}
    out = [(i, " ".join(rng.choice(words[x].split()) for _ in range(25)), x) for i, x in enumerate(["en", "de", "fr"] * 40)]
    learn = spark.createDataFrame(out, "doc_id long, text string, lang string")
    ask = spark.createDataFrame([*out, (900, None, None), (901, "123 !?", None), (902, "漢字", "x")], learn.schema)
    got = {r.doc_id: r for r in language_id.identify(ask, learn).collect()}
    assert all(got[i].lang_pred == x for i, _, x in out) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred in words
    assert {r.lang_pred for r in language_id.identify(ask, learn.limit(0)).collect()} == {"und"}


def test_text_buffers_take_nulls():
    import pyarrow as pa
    data, off = text_buffers(pa.array(["ab", None, "c"]).slice(1))
    assert off[-1] - off[0] == 1 and bytes(data[off[0]:off[-1]]) == b"c"
