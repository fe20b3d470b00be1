from pyspark.sql import functions as F

from nomen.operators import owners as O

# (name, expected keep, expected rule) — one row per rule of the chain
CASES = [
    (None, False, "empty"),
    ("", False, "empty"),
    ("   ", False, "empty"),
    ("AB", False, "short"),
    ("SMITH HOLDINGS LTD", False, "ltd"),
    ("ALTDORF SMITH", False, "ltd"),          # LTD inside a word
    ("JOHN LIMITED", False, "ltd"),
    ("JOHN SMITH 45", False, "number"),       # digits, not a year
    ("123 MAIN STREET", False, "number"),
    ("2020 MAIN", False, "leading_number"),   # a year passes rule 6, not rule 7
    ("JOHN SMITH 2020", False, "trailing_number"),
    ("JOHN 2020 SMITH", False, "other"),      # year in the middle: fails the person rule
    ("PRIVATE", True, "private"),
    ("PRIVATE 2020 TRUST", True, "private"),
    ("JOHN", False, "other"),                 # one word
    ("JOHN SMITH", True, "person"),
    ("JOHN A SMITH", True, "person"),
    ("JOHN SMITH ANNE LEE", True, "person"),  # four words
    ("A B C D E", False, "other"),            # five words
    ("JOHN SMTH", False, "other"),            # no vowel, 4 letters
    ("JOHN MR", True, "person"),              # 2 letters: no vowel needed
    ("JOHN MRS", False, "other"),             # 3 letters without a vowel
    ("JOHN &SMITH", False, "other"),          # word starting with &
    ("JOHN 2ND", False, "other"),             # word starting with a digit
    ("ÉMILE ZOLA", True, "person"),           # accented initial
    ("  john smith  ", True, "person"),       # padded, lower case
]


def test_rule_table(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "owner string")
    got = df.select("owner", O.classify_owner("owner").alias("c")).collect()
    for (name, keep, rule), r in zip(CASES, got):
        assert (r.c.keep, r.c.rule) == (keep, rule), name


def test_min_len_zero(spark):
    df = spark.createDataFrame([("AB",), ("AB CD",)], "owner string")
    got = [r.c.rule for r in df.select(O.classify_owner("owner", min_len=0).alias("c")).collect()]
    assert got == ["other", "person"]  # two 2-letter words need no vowel


def test_counts_and_split(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES if c[0] is not None] + [("JOHN SMITH",)], "owner string")
    cl = O.classify_owners(df)
    assert cl.count() == len([c for c in CASES if c[0] is not None])  # distinct
    kept, skipped = O.split_owners(cl)
    assert kept.count() + skipped.count() == cl.count()
    assert kept.join(skipped, "owner").count() == 0
    rc = O.reason_counts(cl).first()
    assert rc.n_ltd_limited == 3
    tot = O.owner_counts(cl).where(F.col("keep").isNull() & F.col("rule").isNull()).first()
    assert tot.n_owners == cl.count()


def test_project_owner_skips_null(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
    df = spark.createDataFrame([({"OWNERNAME": " A B "},), ({"OWNERNAME": None},), ({"OWNER": "X"},),
                                ({"OWNERNAME": ""},)], schema)
    assert [r.owner for r in O.project_owner(df).collect()] == ["A B"]
