"""Exact deduplication by progressive refinement (DataFrame functions only).

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Rows are grouped by normalised length, the groups that
hold more than one row by a hash of the normalised prefix, and only rows of
prefix groups with more than one row get the full hash:

1. one scan writes a narrow signature table (length and prefix hash, no texts);
2. lengths, then (length, prefix hash) pairs that occur once are settled as
   unique by that table; their rows go from the input straight to the result;
3. another scan hashes the full content of the surviving groups.

Survivors of a step are recognised by a slot number of their key; the broadcast slot list
holds at most ``SLOTS`` numbers whatever the input, and no row is shuffled to be
settled. A row that shares a slot by chance goes on too and falls out as a group of one.

Groups are counted by partially aggregated sums, so a group with a third of all
rows sends one row per task; the join back of group results leaves its splitting
to the adaptive skew join.

Defined cases: a null text counts as empty, so null, empty and all-white texts are
equal; of equal texts the row with most code points, then the smallest id (null
last), then one of identical rows stays; an empty table gives an empty result;
extra columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, materialize

WHITE_CHARS = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
SLOTS = 1 << 20
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_CHARS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, carry: list[Column]) -> DataFrame:
    t = docs.select(col(id_col).alias("id"), F.char_length(F.coalesce(col(text_col), F.lit(""))).alias("chars"),
                    normalised(col(text_col)).alias("norm"),
                    (F.struct(*carry) if carry else F.lit(True)).alias("row"))
    return t.select("*", F.char_length("norm").alias("len"),
                    F.xxhash64(F.left("norm", F.lit(PREFIX_CHARS))).alias("pre"))


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def _repeated(sig: DataFrame, *keys: str) -> DataFrame:
    """Slots of the keys that occur more than once: at most ``SLOTS`` rows, to be broadcast."""
    found = sig.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return F.broadcast(materialize(found.select(_slot(*keys).alias("slot")).distinct(), "exact-slots"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[Column] | None = None) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, row``.

    ``row`` is a struct of the ``carry`` columns (``true`` if none are carried).
    """
    signed = _signed(docs, id_col, text_col, carry or [])
    sig = materialize(signed.select("len", "pre"), "exact-sig")
    lengths = _repeated(sig, "len")
    slots = _repeated(sig.select("len", "pre", _slot("len").alias("slot")).join(lengths, "slot", "left_semi"), "len", "pre")

    # rows that the caller carries are read again here and not kept in the signature table: it may hold whole texts
    alone = (signed.withColumn("slot", _slot("len", "pre")).join(slots, "slot", "left_anti")
             .select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                     F.lit(True).alias("kept"), "row"))
    full = (signed.withColumn("slot", _slot("len", "pre")).join(slots, "slot", "left_semi")
            .select("id", "chars", "len", F.sha2(F.col("norm").cast("binary"), 256).alias("hash"), "row",
                    F.monotonically_increasing_id().alias("n")))
    full = materialize(full, "exact-full")
    best = (full.groupBy("len", "hash")
            .agg(F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), "id", "n")).alias("b"),
                 F.count(F.lit(1)).alias("group_size"))
            .select("len", "hash", F.col("b.id").alias("keep_id"), F.col("b.n").alias("keep_n"), "group_size"))
    # a table of its own, so that the join below exchanges both sides and a hot group can be split
    best = materialize(best, "exact-best")
    grouped = (full.join(best, ["len", "hash"])
               .select("id", "keep_id", "group_size", (F.col("n") == F.col("keep_n")).alias("kept"), "row"))
    return alone.unionByName(grouped).withColumnRenamed("id", id_col)
