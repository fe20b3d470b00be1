"""Owner-name operators: projection, the ordered classification rule chain,
exclusion reasons, counts and the kept / skipped split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.functions.names import py_split, py_strip

# Fixed values of the classifier.
CORPORATE_MARKERS = ["LTD", "LIMITED"]
PRIVATE_MARKERS = ["PRIVATE"]
VOWELS = "AEIOU"
YEAR_MIN, YEAR_MAX = 1900, 2100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _is_digits(w: Column) -> Column:
    return w.rlike(r"^[0-9]+$")


def _in_year_range(w: Column) -> Column:
    # integer value of a digit word, leading zeros allowed, without overflow
    v = F.regexp_replace(w, r"^0+", "")
    return (F.length(v) == 4) & (v >= F.lit(str(YEAR_MIN))) & (v <= F.lit(str(YEAR_MAX)))


def classify_owner(name, min_len: int = 3) -> Column:
    """Ordered rule chain → struct ``(keep BOOLEAN, rule STRING)``.

    Rules on ``u = upper(strip(name))`` and its white-space words, first hit wins:
    ``empty`` skip; ``short`` (len < ``min_len``; ``min_len=0`` drops the rule)
    skip; ``ltd`` (LTD / LIMITED as a substring) skip; ``no_words`` skip;
    ``number`` (a digit word, none a year 1900-2100) skip; ``leading_number``
    (first word digits of <= 4, second word > 2 chars) skip; ``trailing_number``
    (mirror) skip; ``private`` (a word PRIVATE) keep; ``person`` (2-4 words, each
    starts with an upper-case letter, each word longer than 2 has a vowel) keep;
    else ``other`` skip. A NULL name is skipped, not an error.
    """
    u = py_strip(F.upper(_c(name)))
    w = py_split(u)
    n = F.size(w)
    first, second = w[0], w[1]
    last, before_last = F.element_at(w, -1), F.element_at(w, -2)
    corporate = F.lit(False)
    for m in CORPORATE_MARKERS:
        corporate = corporate | F.contains(u, F.lit(m))
    has_number = F.exists(w, _is_digits)
    has_year = F.exists(w, lambda x: _is_digits(x) & _in_year_range(x))
    lead = (n >= 2) & _is_digits(first) & (F.length(first) <= 4) & (F.length(second) > 2)
    trail = (n >= 2) & _is_digits(last) & (F.length(last) <= 4) & (F.length(before_last) > 2)
    private = F.exists(w, lambda x: x.isin(*PRIVATE_MARKERS))
    vowel_re = "[" + VOWELS + "]"
    person = ((n >= 2) & (n <= 4)
              & F.forall(w, lambda x: x.rlike(r"^\p{Lu}"))
              & F.forall(w, lambda x: (F.length(x) <= 2) | x.rlike(vowel_re)))
    rule = (F.when(_c(name).isNull() | (u == ""), "empty")
            .when(F.length(u) < min_len, "short")
            .when(corporate, "ltd")
            .when(n == 0, "no_words")
            .when(has_number & ~has_year, "number")
            .when(lead, "leading_number")
            .when(trail, "trailing_number")
            .when(private, "private")
            .when(person, "person")
            .otherwise("other"))
    return F.struct(rule.isin("private", "person").alias("keep"), rule.alias("rule"))


def exclusion_reason(name, keep) -> Column:
    """Reason group of a skipped name: ``LTD/LIMITED`` when either word occurs
    (case-insensitive), NULL for kept names, ``OTHER`` otherwise."""
    u = F.upper(_c(name))
    ltd = F.contains(u, F.lit("LTD")) | F.contains(u, F.lit("LIMITED"))
    return F.when(_c(keep), F.lit(None).cast("string")).when(ltd, "LTD/LIMITED").otherwise("OTHER")


def project_owner(features: DataFrame, owner_field: str = "OWNERNAME") -> DataFrame:
    """``trim(properties.<owner_field>)`` of each feature; NULL and empty
    names are skipped (the original aborts the whole file on a NULL)."""
    owner = py_strip(F.col("properties")[owner_field])
    return features.select(owner.alias("owner")).where(F.col("owner").isNotNull() & (F.col("owner") != ""))


def classify_owners(owners: DataFrame, col: str = "owner", min_len: int = 3,
                    distinct: bool = True) -> DataFrame:
    """Distinct owners with ``keep``, ``rule`` and ``reason``.

    ``distinct`` first (one shuffle, map-side combined) so the rule chain runs
    once per name."""
    o = owners.select(F.col(col).alias("owner"))
    if distinct:
        o = o.distinct()
    cls = classify_owner("owner", min_len)
    return (o.select("owner", cls.alias("c"))
            .select("owner", F.col("c.keep").alias("keep"), F.col("c.rule").alias("rule"))
            .withColumn("reason", exclusion_reason("owner", "keep")))


def filter_short(owners: DataFrame, col: str = "owner", min_len: int = 3) -> DataFrame:
    """Drop NULL, empty and shorter-than-``min_len`` owners before lookup."""
    c = F.col(col)
    return owners.where(c.isNotNull() & (F.length(c) >= min_len))


def owner_counts(classified: DataFrame) -> DataFrame:
    """Counts per ``(keep, rule)`` with the rollup totals (NULL = all)."""
    return (classified.rollup("keep", "rule")
            .agg(F.count(F.lit(1)).alias("n_owners")))


def reason_counts(classified: DataFrame) -> DataFrame:
    """Kept / excluded totals and the LTD/LIMITED group size."""
    return classified.agg(
        F.count_if(F.col("keep")).alias("n_kept"),
        F.count_if(~F.col("keep")).alias("n_excluded"),
        F.count_if(F.col("reason") == "LTD/LIMITED").alias("n_ltd_limited"),
    )


def split_owners(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and skipped sets (disjoint; their union is the input)."""
    return classified.where(F.col("keep")), classified.where(~F.col("keep"))


def rule_trace(classified: DataFrame) -> DataFrame:
    """Names that passed the LTD/LIMITED rule (the debug side file)."""
    return classified.where(~F.col("rule").isin("empty", "short", "ltd")).select("owner")


def sample_owners(classified: DataFrame, k: int = 5, keep: bool = True) -> tuple[DataFrame, Column]:
    """First ``k`` names in sort order (a top-k report: ``orderBy.limit`` is
    the feature, planned as TakeOrdered) and the "... and n more" count."""
    d = classified.where(F.col("keep") == keep)
    more = F.greatest(d.agg(F.count(F.lit(1))).scalar() - k, F.lit(0))
    return d.orderBy("owner").limit(k), more


def take_sample(owners: DataFrame, n: int, col: str = "owner") -> DataFrame:
    """The first ``n`` distinct names in sort order, NULL left out (a top-k: ``orderBy.limit`` is the feature)."""
    return owners.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(n)
