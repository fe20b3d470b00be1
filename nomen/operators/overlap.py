"""Many-to-many joins with the matcher of the concurrent flow.

Every owner meets a whole registry: ``best_overlap`` finds the company that
shares most of the owner's words (0.7 of them or more), ``best_containment``
one whose normalised name contains the owner's or lies in it. Pairs that
cannot match are never built: names meet on their rarest part only.

Both work on distinct normalised forms; ties go to the smallest company name.
Names with an empty normal form match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.functions import names as N
from nomen.functions.score import OVERLAP_MIN
from nomen.operators.joins import lookup_join
from nomen.operators.windows import number_rows
from nomen.session import materialize

Q = 4  # code points of a gram
AT_BITS = 26    # of a gram's place in a name, in a long with the number of its occurrences
RANK_BITS = 40  # of a company's place in order of name, in a long with the words it lacks


def _forms(df: DataFrame, name: str, out: str) -> DataFrame:
    """``out, norm`` of the distinct names."""
    d = df.select(F.col(name).alias(out)).where(F.col(out).isNotNull()).distinct()
    return d.withColumn("norm", N.normalize_words(out)).where("norm <> ''")


def _smallest(companies: DataFrame, name: str) -> DataFrame:
    """``norm, company, rank``: one row per normal form with its smallest company and that company's place in
    order of name. Pairs carry the place: the smallest number is kept in a hash table, while the smallest text
    makes Spark sort the pairs."""
    c = _forms(companies, name, "company").groupBy("norm").agg(F.min("company").alias("company"))
    return materialize(number_rows(c, ["company"], "rank"), "ranked-companies")


def _named(best: DataFrame, companies: DataFrame) -> DataFrame:
    """``best`` with the company of its ``rank``."""
    return best.join(companies.select("rank", F.col("company").alias("matched_name")), "rank")


def words_of(norm) -> Column:
    """Distinct words of a normalised name, in order."""
    return F.array_sort(F.array_distinct(F.split(norm, " ")))


def best_overlap(owners: DataFrame, companies: DataFrame, owner_col: str = "owner",
                 company_col: str = "company_name", min_overlap: float = OVERLAP_MIN,
                 min_hot_rows: int | None = None) -> DataFrame:
    """Best company per owner by shared words / owner words, from
    ``min_overlap`` on: ``owner, matched_name, confidence``. Owners without
    such a company are left out.

    A set-similarity join with a prefix filter: of an owner's n words, put in
    order of rarity, the first ``n - ceil(min_overlap n) + 1`` are its keys. A
    company that shares enough words shares one of them, so frequent words
    are keys only of names that have no rarer ones. Companies are listed under
    those of their words that are keys at all; lists of frequent words are
    split over several tasks (``lookup_join`` with the list as the spread
    side). A pair is checked where it meets and only the best company of an
    owner's word set leaves the task."""
    return _best_overlap(materialize(_forms(owners, owner_col, "owner"), "match-owners"), _smallest(companies, company_col), min_overlap, min_hot_rows)


def _best_overlap(owners: DataFrame, companies: DataFrame, min_overlap: float, min_hot_rows: int | None = None) -> DataFrame:
    """:func:`best_overlap` of ``owner, norm`` and ``norm, company, rank``."""
    o = materialize(owners.select("owner", words_of("norm").alias("sw")), "overlap-owners")
    c = materialize(companies.groupBy(words_of("norm").alias("cw")).agg(F.min("rank").alias("rank")), "overlap-companies")

    listed = c.select("cw", "rank", F.explode("cw").alias("word"))
    rarity = materialize(listed.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "overlap-words")
    sets = o.select("sw").distinct()
    words = lookup_join(sets.select("sw", F.explode("sw").alias("word")), rarity, ["word"], how="left", min_hot_rows=min_hot_rows)
    n = F.size("sw")
    need = F.ceil(n * F.lit(min_overlap) - F.lit(1e-9)).cast("int")
    ordered = words.groupBy("sw").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("w"))
    keys = ordered.select("sw", F.explode(F.slice("w", F.lit(1), n - need + 1)).alias("x")).where("x.df > 0").select("sw", F.col("x.word").alias("word"))
    keys = materialize(keys, "overlap-keys")

    lists = materialize(listed.join(keys.select("word").distinct(), "word", "left_semi"), "overlap-lists")
    hits = lookup_join(lists, keys, ["word"], salt_by="rank", min_hot_rows=min_hot_rows).select("sw", "rank", F.size(F.array_intersect("sw", "cw")).alias("k"))
    # of one owner's companies the one that lacks fewest words, then the smallest: one number
    best = (hits.where(F.col("k") / n >= min_overlap).groupBy("sw")
            .agg(F.min(F.shiftleft((n - F.col("k")).cast("long"), RANK_BITS) + F.col("rank")).alias("b")))
    best = best.select("sw", F.col("b").bitwiseAND(F.lit((1 << RANK_BITS) - 1)).alias("rank"),
                       ((n - F.shiftright("b", RANK_BITS).cast("int")) / n).alias("confidence"))
    return _named(o.join(best, "sw"), companies).select("owner", "matched_name", "confidence")


def _grams(text: str) -> Column:
    """``(gram, at)`` of a name: its code points taken ``Q`` at a time."""
    last = F.char_length(text) - Q + 1
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.substring(F.col(text), i, F.lit(Q)).alias("gram"), i.alias("at")))


def _inside(needles: DataFrame, hays: DataFrame, min_hot_rows: int | None) -> DataFrame:
    """``needle, hay`` for every ``needle`` (with its other columns) that lies in a ``hay``.

    A needle is looked for by its rarest gram and the place of that gram in
    it; each occurrence of the gram in a hay settles one place by comparing
    the text there. Needles shorter than a gram are looked for whole, under
    the substrings of that length; those are cut only at lengths that occur."""
    cols = [c for c in hays.columns if c != "hay"]
    long = hays.where(F.char_length("hay") >= Q).select(*cols, "hay", F.inline(_grams("hay")))
    df = materialize(long.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "inside-grams")
    own = needles.where(F.char_length("needle") >= Q)
    found = lookup_join(own.select("needle", F.inline(_grams("needle"))), df, ["gram"], how="left", min_hot_rows=min_hot_rows)
    # a gram that no hay has is the rarest: such a needle has no key and lies in none
    packed = F.min(F.shiftleft(F.coalesce("df", F.lit(0)).cast("long"), AT_BITS) + F.col("at"))    # one number: nothing is sorted for it
    rarest = found.groupBy("needle").agg(packed.alias("k")).where(F.shiftright("k", AT_BITS) > 0)
    rarest = rarest.select("needle", F.col("k").bitwiseAND(F.lit((1 << AT_BITS) - 1)).cast("int").alias("key_at"))
    rarest = rarest.select("needle", F.substring(F.col("needle"), F.col("key_at"), F.lit(Q)).alias("gram"), "key_at")
    keys = materialize(own.join(rarest, "needle"), "inside-keys")
    lists = materialize(long.join(keys.select("gram").distinct(), "gram", "left_semi"), "inside-lists")
    met = lookup_join(lists, keys, ["gram"], salt_by="hay", min_hot_rows=min_hot_rows)
    start = F.col("at") - F.col("key_at") + 1
    by_gram = met.where((start >= 1) & (F.substring(F.col("hay"), start, F.char_length("needle")) == F.col("needle"))).select(*needles.columns, *hays.columns)

    short = needles.where(F.char_length("needle") < Q)
    lengths = short.agg(F.array_sort(F.collect_set(F.char_length("needle")))).scalar()     # fewer than Q numbers
    cut = F.array_distinct(F.flatten(F.transform(F.coalesce("lengths", F.array().cast("array<int>")), lambda k: F.transform(
        F.when(F.char_length("hay") >= k, F.sequence(F.lit(1), F.char_length("hay") - k + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(F.col("hay"), i, k)))))
    pieces = hays.withColumn("lengths", lengths).select(*hays.columns, F.explode(cut).alias("needle")).join(short.select("needle").distinct(), "needle", "left_semi")
    whole = lookup_join(materialize(pieces, "inside-short"), short, ["needle"], salt_by="hay", min_hot_rows=min_hot_rows)
    return by_gram.unionByName(whole.select(*needles.columns, *hays.columns))


def best_containment(owners: DataFrame, companies: DataFrame, owner_col: str = "owner",
                     company_col: str = "company_name", min_hot_rows: int | None = None) -> DataFrame:
    """Smallest company per owner whose normalised name contains the owner's
    or lies in it: ``owner, matched_name, confidence`` (1.0). Owners without
    one are left out. Both directions are substring joins on the rarest
    gram of the contained name; the smallest company is a map-side
    combined minimum, so no list of pairs is kept."""
    return _best_containment(materialize(_forms(owners, owner_col, "owner"), "match-owners"), _smallest(companies, company_col), min_hot_rows)


def _known_words(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """The needles that can lie in a hay by their words: all but the first and the last, which may be parts of
    longer ones there, are words of some hay. Most needles go before they are cut into grams."""
    known = hays.select(F.explode(F.split("hay", " ")).alias("word")).distinct()
    ws = F.split("needle", " ")
    inner = needles.select("needle", F.explode(F.array_distinct(F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 2, F.lit(0))))).alias("word"))
    unknown = inner.join(known, "word", "left_anti").select("needle").distinct()
    return materialize(needles.join(unknown, "needle", "left_anti"), "inside-needles")


def _best_containment(o: DataFrame, companies: DataFrame, min_hot_rows: int | None = None) -> DataFrame:
    """:func:`best_containment` of ``owner, norm`` and ``norm, company, rank``."""
    sn = materialize(o.select("norm").distinct(), "inside-owners")
    own, all_names = sn.select(F.col("norm").alias("hay")), companies.select(F.col("norm").alias("needle"), "rank")
    a = _inside(sn.select(F.col("norm").alias("needle")), companies.select(F.col("norm").alias("hay"), "rank"), min_hot_rows).select(F.col("needle").alias("norm"), "rank")
    b = _inside(_known_words(all_names, own), own, min_hot_rows).select(F.col("hay").alias("norm"), "rank")
    best = a.unionByName(b).groupBy("norm").agg(F.min("rank").alias("rank"))
    return _named(o.join(best, "norm"), companies).select("owner", "matched_name", F.lit(1.0).alias("confidence"))


def best_match_overlap(owners: DataFrame, companies: DataFrame, owner_col: str = "owner",
                       company_col: str = "company_name", min_overlap: float = OVERLAP_MIN) -> DataFrame:
    """Best company per distinct owner by the whole rule of the concurrent
    matcher: 1.0 for containment either way, else the word overlap.
    ``owner, matched_name, confidence, tier, is_match``; ties go to the
    smallest company."""
    names, ranked = materialize(_forms(owners, owner_col, "owner"), "match-owners"), _smallest(companies, company_col)    # once for both
    a = _best_containment(names, ranked).withColumn("tier", F.lit("contains"))
    b = _best_overlap(names, ranked, min_overlap).withColumn("tier", F.lit("overlap"))
    best = a.unionByName(b).groupBy("owner").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "matched_name", "tier")).alias("b"))
    o = owners.select(F.col(owner_col).alias("owner")).distinct()
    # the 1:1 matcher calls every pair of confidence 1.0 a containment
    conf = F.coalesce(-F.col("b.c"), F.lit(0.0))
    return (o.join(best, "owner", "left")
            .select("owner", F.col("b.matched_name").alias("matched_name"), conf.alias("confidence"),
                    F.when(conf == 1.0, "contains").when(conf > 0, "overlap").otherwise("none").alias("tier"), (conf > 0).alias("is_match")))
