import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["owner", "matched_name", "confidence", "tier", "is_match"]


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_all_queries_match_oracle_sf0001(spark):
    res = compare(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    assert not bad, bad
