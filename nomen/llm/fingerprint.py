"""Document fingerprints: a homomorphic multiset hash of paragraphs (DataFrame functions only).

A paragraph (text between line feeds) is hashed to a wide vector; the fingerprint of a
text is the lane-wise sum of the vectors modulo powers of two. Sums commute, so
texts with the same paragraphs in any order have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector
(:func:`insert`, :func:`delete`), without the text.

Lanes:

* ``SUM_LANES`` sums of 32 bits of a hash of the whole paragraph, modulo 2**32: the part
  that decides equality (256 bits);
* ``COUNT_LANES * COUNT_HASHES`` longs of two counters each, modulo 2**30 (exact below 2**30 sentences): each
  sentence of the paragraph adds the 64 bits of its hash to 64 counters. Centred, two such
  counter vectors have a cosine near the share of sentences in common, so
  :func:`likeness` compares texts by their fingerprints alone (the error is about
  ``1 / sqrt(64 * COUNT_HASHES)``);
* the number of sentences and of paragraphs.

Each lane is masked after every addition, so no sum overflows. The next document
in id order is found without a global sort in one task: ids are cut into ranges at
quantiles, ``lead`` runs within a range, and each range holds a copy of the
first row of the next range behind its own rows.

Defined cases: a null text counts as empty, an empty text has one empty paragraph;
null ids come first; rows with one id follow each other by text; a single row is
its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomen.llm._spark import col, n_parts

SUM_LANES = 8
COUNT_HASHES = 2
MASK32 = (1 << 32) - 1
COUNT_LANES = 32
BIT0 = 0x0000000100000001    # one bit of each of two 32-bit counters
MASK30 = 0x3FFFFFFF3FFFFFFF  # counters modulo 2**30: an addition never carries
LANES = SUM_LANES + COUNT_LANES * COUNT_HASHES + 2
BRANCH = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column, lane, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, h: (acc + lane(h)).bitwiseAND(F.lit(mask)))


def _sums(paragraphs: Column, seed: int) -> Column:
    """Two lanes modulo 2**32 of one hash of the paragraphs."""
    return _let(F.transform(paragraphs, lambda p: F.xxhash64(F.lit(seed), p)), lambda hashes: F.array(
        _sum(hashes, lambda h: h.bitwiseAND(F.lit(MASK32)), MASK32), _sum(hashes, lambda h: F.shiftrightunsigned(h, 32), MASK32)))


def _counters(sentences: Column, seed: int) -> Column:
    """``COUNT_LANES`` lanes of two counters of the bits of one hash of the sentences."""
    return _let(F.transform(sentences, lambda s: F.xxhash64(F.lit(seed), s)), lambda hashes: F.array(
        *[_sum(hashes, lambda h, k=k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(BIT0)), MASK30) for k in range(COUNT_LANES)]))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as array<long> of ``LANES`` lanes."""
    whole = F.coalesce(text, F.lit(""))
    by_paragraph = _let(F.split(whole, "\n"), lambda p: F.concat(
        *[_sums(p, i) for i in range(SUM_LANES // 2)], F.array(F.size(p).cast("long"))))
    by_sentence = _let(F.split(whole, "\n|(?<=[.!?]) "), lambda s: F.concat(
        *[_counters(s, 100 + i) for i in range(COUNT_HASHES)], F.array(F.size(s).cast("long"))))
    return _let(by_paragraph, lambda p: F.concat(F.slice(p, 1, SUM_LANES), by_sentence, F.slice(p, SUM_LANES + 1, 1)))


def _lane_mask(i: Column) -> Column:
    return (F.when(i < SUM_LANES, F.lit(MASK32)).when(i < SUM_LANES + COUNT_LANES * COUNT_HASHES, F.lit(MASK30))
            .otherwise(F.lit((1 << 62) - 1)))


def insert(fp: Column, paragraphs: Column) -> Column:
    """Fingerprint after adding the paragraphs that ``paragraphs`` is the fingerprint of."""
    return F.transform(F.arrays_zip(fp.alias("a"), paragraphs.alias("b")),
                       lambda z, i: (z["a"] + z["b"]).bitwiseAND(_lane_mask(i)))


def delete(fp: Column, paragraphs: Column) -> Column:
    """Fingerprint after taking those paragraphs away again."""
    half = SUM_LANES + COUNT_LANES * COUNT_HASHES

    def less(z: Column, i: Column) -> Column:
        borrow = F.when(i < SUM_LANES, F.lit(1 << 32)).when(i < half, F.lit(0x4000000040000000)).otherwise(F.lit(0))
        return (borrow + z["a"] - z["b"]).bitwiseAND(_lane_mask(i))

    return F.transform(F.arrays_zip(fp.alias("a"), paragraphs.alias("b")), less)


def _centred(fp: Column) -> Column:
    """2 * counter - number of sentences, for each of the 64 * COUNT_HASHES counters."""
    n = F.element_at(fp, LANES - 1)
    packed = F.slice(fp, SUM_LANES + 1, COUNT_LANES * COUNT_HASHES)
    return F.flatten(F.transform(packed, lambda x: F.array(
        *[2 * F.shiftrightunsigned(x, 32 * j).bitwiseAND(F.lit(0x3FFFFFFF)) - n for j in range(2)])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the centred counters, 1 for equal fingerprints."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)

    def cosine(x: Column, y: Column) -> Column:
        return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))

    cos = _let(F.struct(_centred(a).alias("x"), _centred(b).alias("y")), lambda z: cosine(z["x"], z["y"]))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cos, F.lit(0.0)))))


def digest(fp: Column) -> Column:
    """Fingerprint as lowercase hex, 16 digits a lane."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _range_of(x: Column, splits: list[int]) -> Column:
    """Number of the last split <= x by search in blocks of ``BRANCH`` (splits[0] is below any x)."""
    stride = 1
    while stride * BRANCH < len(splits):
        stride *= BRANCH
    at = F.lit(0)
    while stride:
        level = F.array(*[F.lit(s).cast("long") for s in splits[::stride]])
        at = at * BRANCH + F.size(F.filter(F.slice(level, at * BRANCH + 1, F.lit(BRANCH)), lambda s: s <= x)) - 1
        stride //= BRANCH
    return at.cast("int")


def with_next(docs: DataFrame, key: str, tie: str, carried: list[str], ranges: int, derive=lambda d: d) -> DataFrame:
    """``docs`` with ``next_<c>`` of the next row in order of (key, tie), after the last row the first. ``derive`` adds
    columns to the rows once they are copied and before they are carried."""
    spark = docs.sparkSession
    low = -(1 << 63)
    cuts = docs.select(key).approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    splits = [low, *sorted({int(c) for c in cuts})]
    ranged = docs.withColumn("_range", _range_of(F.coalesce(F.col(key), F.lit(low)), splits))
    # one row per range that has rows: at most `ranges` of them
    heads = sorted((r["_range"], r["k"] is None, r["k"]) for r in ranged.groupBy("_range").agg(
        F.min(F.struct(F.col(key).isNotNull().alias("z"), F.col(key).alias("k"))).alias("m")).select("_range", "m.k").collect())
    to = [(heads[(i + 1) % len(heads)][2], h[0]) for i, h in enumerate(heads)]
    all_rows = ranged.withColumn("_copy", F.lit(False))
    if to:
        copies = spark.createDataFrame(to, "_k long, _to int")
        first = (docs.join(F.broadcast(copies), F.col(key).eqNullSafe(F.col("_k")))
                 .withColumn("_range", F.col("_to")).withColumn("_copy", F.lit(True)).select(all_rows.columns))
        all_rows = all_rows.unionByName(first)
    w = Window.partitionBy("_range").orderBy("_copy", F.col(key).asc_nulls_first(), tie)
    return (derive(all_rows).withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
            .where(~F.col("_copy")).drop("_copy", "_range"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       ranges: int | None = None) -> DataFrame:
    """Fingerprints of the texts and of their edited texts, with likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many
    (or all) of the next document. ``ranges``: pieces that the id order is cut
    into, four per shuffle partition by default.
    """
    ranges = ranges or 4 * n_parts(docs.sparkSession)
    t = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    t = with_next(t, "id", "text", ["text", "fp"], ranges, lambda d: d.withColumn("fp", fingerprint(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    t = t.withColumns({"n_chars": n.cast("long"),
                       "edited": F.concat(F.left("text", n - half), F.left("next_text", half))})
    t = t.select("id", "n_chars", "fp", "next_fp", "edited", fingerprint(F.col("edited")).alias("edited_fp"))
    return t.select(F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    digest(F.col("fp")).alias("fingerprint"), digest(F.col("edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
