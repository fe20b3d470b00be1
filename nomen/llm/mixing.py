"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each document of a source belongs to a block, picked by a hash of its id and text, so
a block is a random, disjoint part of its source of about ``total words /
BLOCKS`` words. A source's words are drawn as whole passes over its blocks plus part
of one more pass, in an order permuted anew for each pass; the last block drawn is cut
at the word where the target is met. The blocks to draw per source are the
exact quotas at the root of a binary tree over the output shards: each inner node deals
its quotas to its halves by a multivariate hypergeometric draw, so every shard
gets a random share and the shards add up to the quotas exactly. A shard then takes the next
``quota`` blocks of each source's permuted list (disjoint by construction), and orders
its rows locally by a hash.

Only the block sizes (about ``BLOCKS`` + one per source, whatever the input)
reach the driver; documents meet their plan rows by a broadcast join of that bounded
table. The number of sources is a bounded parameter, ``MAX_SOURCES``.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last;
a source without words has target 0 and is not drawn; documents of size 0 are never
drawn; rows equal in id and text share a block; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomen.llm._spark import col, materialize, n_parts

BLOCKS = 4096
MAX_SOURCES = 100_000
MAX_REPEAT = 3
WORD = "[^\\x20\\x09-\\x0D]+"
PLAN = "src int, block int, pass int, shard int, cut long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(sizes: list[int], weights: list[float], most: float = MAX_REPEAT) -> list[float]:
    """Shares of sum(sizes) by weight, at most ``most`` times a source's size; the
    excess goes to the others by weight until none is above."""
    total = float(sum(sizes))
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def _order(seed: int, *key) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "big")


def splitting_tree(quotas: np.ndarray, shards: int, seed: int, node: int = 1) -> np.ndarray:
    """(shards, sources) quotas: every node deals its vector to its two halves."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    rng = np.random.default_rng([seed, node])
    take = total * left // shards
    part = rng.multivariate_hypergeometric(quotas, take, method="marginals") if 0 < take < total else (
        np.zeros_like(quotas) if not take else quotas)
    return np.concatenate([splitting_tree(part, left, seed, 2 * node),
                           splitting_tree(quotas - part, shards - left, seed, 2 * node + 1)])


def plan_draws(blocks: list[tuple[int, int, int]], targets: list[float], shards: int, seed: int) -> list[tuple]:
    """Rows (src, block, pass, shard, cut): which shard takes which block in which pass.

    ``blocks``: (src, block, words). ``cut``: words to take of a block drawn in part, else null.
    """
    by_src: dict[int, list[tuple[int, int]]] = {}
    for s, b, w in sorted(blocks):
        if w > 0:
            by_src.setdefault(s, []).append((b, w))
    lists: list[list[tuple]] = [[] for _ in targets]
    for s, own in by_src.items():
        need = round(targets[s])
        for p in range(MAX_REPEAT):
            for b, w in sorted(own, key=lambda x: _order(seed, s, p, x[0])):
                if need <= 0:
                    break
                lists[s].append((b, p, None if w <= need else need))
                need -= w
    quotas = splitting_tree(np.array([len(x) for x in lists], np.int64), shards, seed) if targets else np.zeros((shards, 0), np.int64)
    rows, at = [], [0] * len(lists)
    for j in range(shards):
        for s in range(len(lists)):
            for b, p, cut in lists[s][at[s]: at[s] + int(quotas[j, s])]:
                rows.append((s, b, p, j, cut))
            at[s] += int(quotas[j, s])
    return rows


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=lambda i: 1 + i % 3, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sized, draws).

    ``sized``: one row per document: id, key, source, size, source_size, target, src, block.
    ``draws``: the mix: one row per document drawn: src, block, id, key, pass, shard, place
    (order within the shard), taken (words; under size only where the last block is cut).
    ``shards``: number of output shards, one per shuffle partition by default; what is taken does not depend on it.
    """
    spark = docs.sparkSession
    shards = shards or n_parts(spark)
    sized = materialize(docs.select(col(id_col).alias("id"), F.xxhash64(col(id_col), col(text_col)).alias("key"),
                                    col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("size")), "mix-size")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(((r["source"], r["n"]) for r in found), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [n for _, n in sources]
    targets = weighted_targets(sizes, [float(weights(i)) for i in range(len(sources))])
    per = max(1, -(-sum(sizes) // BLOCKS))
    table = [(s, i, n, t, max(1, -(-n // per))) for i, ((s, n), t) in enumerate(zip(sources, targets, strict=True))]
    src = spark.createDataFrame(table, "s string, src int, source_size long, target double, n_blocks int")
    sized = (sized.join(F.broadcast(src), F.col("source").eqNullSafe(F.col("s")))
             .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("n_blocks")).cast("int"))
             .drop("s", "n_blocks"))
    blocks = [tuple(r) for r in sized.groupBy("src", "block").agg(F.sum("size")).collect()]
    plan = F.broadcast(spark.createDataFrame(plan_draws(blocks, targets, shards, seed), PLAN))
    drawn = sized.where("size > 0").select("id", "key", "size", "src", "block").join(plan, ["src", "block"])
    place = F.xxhash64(F.lit(seed + 1), "key", "pass")
    whole = drawn.where("cut is null").select("src", "block", "id", "key", "pass", "shard", place.alias("place"), F.col("size").alias("taken"))
    # at most one block of a source is cut: only its rows are summed up in order
    w = Window.partitionBy("src", "block").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (drawn.where("cut is not null").withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
           .withColumn("taken", F.least(F.col("size"), F.col("cut") - F.col("before"))).where("taken > 0")
           .select("src", "block", "id", "key", "pass", "shard", place.alias("place"), "taken"))
    return sized, whole.unionByName(cut)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    sized, draws = mix(docs, **options)
    zero = sized.select("id", "key", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copy"), F.lit(1).alias("row"))
    each = draws.select("id", "key", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("source_size"),
                        F.lit(None).cast("double").alias("target"), "taken", F.lit(1).alias("copy"), F.lit(0).alias("row"))
    out = (zero.unionByName(each).groupBy("id", "key")
           .agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"),
                F.sum("taken").alias("taken"), F.sum("copy").alias("copies"), F.sum("row").alias("rows")))
    # rows equal in id and text: each shows its own share
    return (out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.floor(F.col("taken") / F.col("rows")) + F.when(F.col("_i") <= F.pmod(F.col("taken"), F.col("rows")), 1).otherwise(0)).cast("long").alias("taken"),
                    F.col("copies").cast("long").alias("copies")))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, once per draw, the cut ones with their first words only,
    with ``_shard`` and ``_place`` to write shards by (columns of ``docs`` with these names give way to
    them). Other columns are unchanged."""
    out = mixed_structs(docs, id_col, text_col, **options)
    names = [c for c in docs.columns if c not in ("_shard", "_place")]
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], F.col("shard").alias("_shard"), F.col("place").alias("_place"))


def mixed_structs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix with each row of ``docs`` but its text in the struct ``row``, whatever its columns are called, beside
    ``text`` (cut where the draw is), ``shard`` and ``place``."""
    _, draws = mix(docs, id_col=id_col, text_col=text_col, **options)
    # equal rows draw as one group each time: count them once per (id, key, pass)
    draws = draws.groupBy("id", "key", "pass").agg(F.min("shard").alias("_shard"), F.min("place").alias("_place"),
                                                    F.max("taken").alias("_taken"), F.count(F.lit(1)).alias("_n"))
    per = draws.groupBy("id", "key").agg(F.collect_list(F.struct("pass", "_shard", "_place", "_taken")).alias("_draws"))  # 3 at most
    keyed = docs.select(F.struct("*").alias("_row"), col(id_col).alias("id"), F.xxhash64(col(id_col), col(text_col)).alias("key"))
    out = (keyed.join(per, keyed["id"].eqNullSafe(per["id"]) & (keyed["key"] == per["key"])).select("_row", F.explode("_draws").alias("_d"))
           .select("_row", "_d._shard", "_d._place", "_d._taken"))
    whole = F.col("_row").getField(text_col)
    words = word_count(whole)
    head = F.regexp_extract(whole, "^[\\x20\\x09-\\x0D]*", 0)
    cut = F.concat(head, F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), 1, F.col("_taken").cast("int")), ""))
    return out.select(F.col("_row").dropFields(f"`{text_col}`").alias("row"), F.when(words > F.col("_taken"), cut).otherwise(whole).alias("text"),
                      F.col("_shard").alias("shard"), F.col("_place").alias("place"))
