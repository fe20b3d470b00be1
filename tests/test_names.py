import pytest

from nomen.functions import names as N
from nomen.functions import score as S

# worked out by hand from the rules: name, normal form, variations, terms of over two letters
PROFILES = [
    ("ABC Holdings Inc.", "abc holdings", {"abc holdings", "ah", "abc", "holdings abc"}, {"abc", "holdings"}),
    ("Coop Farms", "co-op farms", {"co-op farms", "co op farms", "cf", "co-op", "farms co-op"}, {"co-op", "farms"}),
    ("the of and", "the of and", {"the of and", "toa", "to", "the", "the of"}, {"the", "and", "toa"}),
    ("Inc", "", set(), set()),
    ("", "", set(), set()),
    (None, "", set(), set()),
]


def test_profiles_by_hand(spark):
    df = spark.createDataFrame([(p[0],) for p in PROFILES], "name string")
    got = {r.name: (r.norm, set(r.vars), set(r.terms)) for r in N.with_name_profile(df, "name").collect()}
    for name, *want in PROFILES:
        assert got[name] == tuple(want), name


@pytest.mark.parametrize("name,norm", [
    ("The Smith & Sons Co-op", "the smith and sons -op"),   # 'co' is removed before the co-op rule
    ("Coop Farms", "co-op farms"),
    ("éco Limited", "co"),                                  # é is a word character: 'co' stays
    ("ABC Holdings Inc.", "abc holdings"),
])
def test_normalize_examples(spark, name, norm):
    assert spark.range(1).select(N.normalize_name(N.F.lit(name)).alias("n")).first().n == norm


def test_variations_example(spark):
    r = spark.range(1).select(S.name_profile(N.F.lit("MTD Products")).alias("p")).first().p
    assert set(r.vars) == {"mtd products", "mp", "mtd", "products mtd"}
    assert set(r.terms) == {"mtd", "products"}
    assert r.coop is False


def test_simple_forms(spark):
    F = N.F
    r = spark.range(1).select(
        N.normalize_words(F.lit("Hello, World-2 (x)")).alias("w"),
        N.normalize_name_simple(F.lit("Acme Corp (Ontario) Co-op")).alias("s"),
        N.abbreviation(F.lit("united nations a")).alias("a"),
        N.debug_variations(F.lit("john smith")).alias("d")).first()
    assert r.w == "hello world 2 x"
    assert r.s == "acme op"  # corp and co are suffix words
    assert r.a == "UN"
    assert set(r.d) == {"john smith", "smith john", "john s", "js"}


def _normalised_step_by_step(x):
    """The rules one after the other, as the normaliser's text lists them."""
    F = N.F
    n = N.py_strip(F.lower(x))
    n = F.regexp_replace(n, r"(?U)\s*[(\[].*?[\])]", " ")
    n = F.regexp_replace(F.regexp_replace(n, N.SUFFIX_RE, ""), N.COOP_RE, "co-op")
    for old, new in N.REPLACEMENTS:
        n = F.replace(n, F.lit(old), F.lit(new))
    n = F.regexp_replace(n, r"(?U)[^a-z0-9\s-]", " ")
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(n, r"(?U)\s+-\s+", "-"), r"-+", "-"), r"(?U)\s+", " ")
    return F.coalesce(F.regexp_replace(n, r"^[ -]+|[ -]+$", ""), F.lit(""))


def test_fewer_passes_give_the_same_names(spark):
    import random
    rng = random.Random(4)
    parts = ["Co", "coop", "co-op", "p", "c", "(x)", "[y", "z)", "-", " - ", "--", " ", "  ", "\t", "\n", " ", " ", "é", "😀", "w /", "w/",
             "vs.", "O'Neil's", '"q"', "&", "+", "w.o.", "Ltd.", "société", "a", "9", ",", ";", ".", "_", "İ"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(4000)] + [None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    d = N.with_name_profile(df, "name").select("*", _normalised_step_by_step(N.F.col("name")).alias("slow"), N.name_terms("vars").alias("all_terms"),
                                               N.normalize_name_simple("name").alias("simple"))
    F = N.F
    n = F.regexp_replace(F.regexp_replace(F.lower("name"), r"\([^)]*\)", ""), r"(?U)[^a-z0-9\s]", " ")
    d = d.select("*", F.array_join(F.filter(N.py_split(n), lambda w: ~w.isin(*N.SIMPLE_SUFFIXES)), " ").alias("slow_simple"),
                 N.abbreviation("simple").alias("abbr"), N.initials(F.split("simple", " ")).alias("ini"))
    for r in d.collect():
        assert r.norm == r.slow and r.terms == r.all_terms, r.name
        assert r.simple == r.slow_simple and r.abbr == r.ini, r.name


def test_a_name_is_normalised_in_few_passes(spark):
    plan = spark.range(1).select(N.normalize_name(N.F.col("id").cast("string")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 5
