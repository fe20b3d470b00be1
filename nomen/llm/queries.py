"""The ``opN_<name>`` queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomen.llm._spark import held_out, read
from nomen.llm.bpe import bpe_encode
from nomen.llm.context_tree import context_tree_scores
from nomen.llm.exact_dedup import exact_dedup, normalised
from nomen.llm.fingerprint import compare_with_edits
from nomen.llm.html_extract import extract
from nomen.llm.language_id import identify
from nomen.llm.mixing import taken_words
from nomen.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt
from nomen.llm.quality import quality_scores
from nomen.llm.simhash import simhash_groups
from nomen.llm.structure_repair import structure_report
from nomen.llm.substring_dedup import substring_dedup_digest
from nomen.llm.toxicity import toxicity_scores

THRESHOLD = 0.7


def _scored(out: DataFrame, mod: int, remainder: int) -> DataFrame:
    return out.select("doc_id", held_out("doc_id", mod, remainder).alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document: doc_id, held_out, score, predicted."""
    return _scored(quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")), 4, 2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 13-word repeats of documents with smaller ids: doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup_digest(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: doc_id, size, source_size, target, taken, copies."""
    return taken_words(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document: doc_id, held_out, score, predicted."""
    return _scored(toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")), 3, 1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out("doc_id", 4, 2)))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = read(spark, sf_dir, "documents")
    out = exact_dedup(docs, carry=[F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")])
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("row.text_sha256").alias("text_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near duplicates (3-word shingles, 3 bits): doc_id, fingerprint, component_id."""
    out = simhash_groups(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    out = extract(read(spark, sf_dir, "pages"), carry=[F.col("page_id"), F.col("url")])
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Byte-level BPE of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers
    out = bpe_encode(read(spark, sf_dir, "documents"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
                     pattern or public_tokenizers.PATTERN, carry=[F.col("doc_id")])
    return bpe_digest(out)


def bpe_digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph multiset fingerprints of texts and edited texts, with likenesses."""
    return compare_with_edits(read(spark, sf_dir, "documents"))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree weighting score of every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    out = context_tree_scores(read(spark, sf_dir, "documents"), held_out("doc_id", 5, 1), carry=[F.col("doc_id")])
    return out.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = numbered_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie(rebuilt(turns, convs), convs)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of the damaged conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return structure_report(read(spark, sf_dir, "conversations"), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_substring_dedup, op3_mixing, op4_toxicity, op5_language_id, op6_exact_dedup,
                            op7_simhash, op8_html_extract, op9_bpe, op10_fingerprint, op11_context_tree, op12_prefix_trie, op13_structure_repair)}

_NORMAL = "translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

def _crc32(x: str) -> str:
    """Unsigned CRC-32 of an ASCII text in SQL: a byte, then eight single-bit steps."""
    steps = f"flatten(list_transform(string_split({x}, ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), "
            "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)")


def _repair_step() -> str:
    """One row further towards the start of a conversation: per state of the pattern (start, after s, after u, after a)
    the least (cost, edits, lines) of the rest, first with the row used up, then with turns inserted before it."""
    def took(letter, cost, after, line="''"):
        return f"{{'c': {cost} + a{after}.c, 's': '{letter}' || a{after}.s, 't': {line} || a{after}.t}}"

    def state(q, keeps, after, role):
        may, extra = "f NOT IN ('b', 'd')", "CASE WHEN f = 't' THEN 5 ELSE 0 END"
        kept = "".join(f", CASE WHEN {may} AND ini = '{i}' THEN {took('K', extra, to, 'role || chr(58) || text || chr(10)')} END" for i, to in keeps)
        line = f"'{role}:' || text || chr(10)"
        return f"list_min([{took('D', 2, q)}{kept}, CASE WHEN {may} THEN {took('R', '1 + ' + extra, after, line)} END]) AS b{q}"

    def insert(q, after, role):
        return f"list_min([b{q}, {{'c': 5 + b{after}.c, 's': 'I' || b{after}.s, 't': '{role}:' || chr(10) || b{after}.t}}]) AS "
    rows = ", ".join([state(0, [("s", 1), ("u", 2)], 2, "user"), state(1, [("u", 2)], 2, "user"), state(2, [("a", 3)], 3, "assistant"), state(3, [("u", 2)], 2, "user")])
    return (f"SELECT conv_id, i, {insert(0, 2, 'user')}a0, {insert(1, 2, 'user')}a1, b2 AS a2, b3 AS a3 FROM ("
            f"SELECT conv_id, i, b0, b1, {insert(2, 3, 'assistant')}b2, {insert(3, 2, 'user')}b3 FROM ("
            f"SELECT m.conv_id, m.i, {rows} FROM v JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.i = v.i - 1))")


ORACLES: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM t, unnest(range(1, len(ws) - 11)) AS u(i)),
        low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        hit AS (SELECT win.doc_id, win.i FROM win JOIN low USING (k) WHERE low.m < win.doc_id),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, unnest(range(0, 13)) AS v(j)),
        word AS (SELECT doc_id, i, ws[i] AS x FROM t, unnest(range(1, len(ws) + 1)) AS u(i)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT t.doc_id, len(t.ws) AS n_words, len(t.ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, {_NORMAL} AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op12_prefix_trie": f"""
        WITH r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
                     PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM r GROUP BY conv_id),
        cc AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
        f AS (SELECT cc.conv_id, r.pos AS depth, role, text FROM cc JOIN r ON r.conv_id = cc.base AND r.pos <= cc.h
              UNION ALL SELECT cc.conv_id, r.pos - cc.h + cc.taken, role, text FROM cc JOIN r ON r.conv_id = cc.conv_id AND r.pos > cc.h),
        s AS (SELECT c.conv_id, coalesce(list(length(role) || ':' || role || text ORDER BY depth) FILTER (depth IS NOT NULL), []) AS t,
                     coalesce(list(length(text) ORDER BY depth) FILTER (depth IS NOT NULL), []) AS l FROM c LEFT JOIN f USING (conv_id) GROUP BY c.conv_id),
        pre AS (SELECT conv_id, d, t[1:d] AS p, CASE WHEN d > 0 THEN l[d] ELSE 0 END AS size, d = len(t) AS at_end FROM s, unnest(range(0, len(t) + 1)) AS u(d)),
        node AS (SELECT p, d, size, min(conv_id) AS conv, count(*) AS n,
                        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (at_end), '')) AS e FROM pre GROUP BY p, d, size),
        kid AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
        full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kid USING (p)),
        sub AS (SELECT p[1:a] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved
                FROM full_node, unnest(range(0, d + 1)) AS v(a) GROUP BY 1)
        SELECT x.conv AS conv_id, x.d AS depth, up.conv AS parent_conv_id, x.n AS n_convs, x.k AS n_children,
               CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.e AS ends_sha256
        FROM full_node x JOIN sub ON sub.p = x.p LEFT JOIN node up ON x.d > 0 AND up.p = x.p[1:x.d - 1]""",
    "op13_structure_repair": f"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS x FROM conversations),
        dm AS (SELECT row_number() OVER () AS uid, conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
                      CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
               FROM o, unnest(range(0, CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS u(k) WHERE x <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, uid) AS i,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, uid) AS seen, count(*) OVER (PARTITION BY conv_id) AS n,
                     rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS ini FROM dm),
        m AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
                     lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM r),
        st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 'b') AS blank, count_if(f = 'd') AS duplicate,
                      count_if(f = 't') AS truncated, count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
        v AS (SELECT DISTINCT conv_id, n + 1 AS i, {{'c': 0, 's': '', 't': ''}} AS a0, {{'c': 10, 's': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS a1,
                     {{'c': 5, 's': 'I', 't': 'assistant:' || chr(10)}} AS a2, {{'c': 0, 's': '', 't': ''}} AS a3 FROM r
              UNION ALL {_repair_step()})
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.a0.c, 0)::BIGINT AS cost, coalesce(v.a0.s, '') AS audit,
               sha256(coalesce(CASE WHEN v.a0.t <> '' THEN left(v.a0.t, length(v.a0.t) - 1) END, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1""",
}
