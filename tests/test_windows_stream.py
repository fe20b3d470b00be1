import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nomen.operators import stats as ST
from nomen.operators import windows as W
from nomen.plans import inputs as I
from nomen.streaming import search_log as SL
from tests.conftest import SF_SMALL


def test_number_rows_equals_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"))
    a = {r.k: r.n for r in W.number_rows(df, ["k"], "n").collect()}
    b = {r.k: r.n for r in df.select("k", F.row_number().over(Window.orderBy("k")).alias("n")).collect()}
    assert a == b


def test_batches_lanes(spark):
    r = spark.range(1, 12).select(W.batch_number(F.col("id"), 5).alias("b"), W.round_robin(F.col("id"), 2).alias("l")).collect()
    assert [x.b for x in r] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3]
    assert [x.l for x in r][:4] == [0, 1, 0, 1]


def test_prefix_partition_caps(spark):
    names = spark.createDataFrame([(f"a{i:03d}",) for i in range(500)] + [("b",), ("a",)], "name string")
    names = names.unionByName(spark.createDataFrame([("zz",)] * 60, "name string"))
    leaves = ST.prefix_partition(names, "name", cap=50).collect()
    assert sum(r.n_names for r in leaves) == 562                  # every name in exactly one leaf
    # full leaves are names that end there
    assert {(r.prefix, r.n_names) for r in leaves if r.n_names >= 50} == {("zz", 60)}


def _walk(names, cap, max_depth=None):
    """The prefix walk itself: deepen while a prefix holds ``cap`` names."""
    out, todo = {}, [(g, "", 0) for g in {g for g, _ in names}]
    while todo:
        g, prefix, depth = todo.pop()
        below = {}
        for k, n in names:
            if k == g and n[:depth] == prefix and len(prefix) == depth:
                below[n[:depth + 1]] = below.get(n[:depth + 1], 0) + 1
        for p, n in below.items():
            if n >= cap and len(p) == depth + 1 and depth + 1 != max_depth:
                todo.append((g, p, depth + 1))
            else:
                out[g, p, depth + 1] = n
    return out


@pytest.mark.parametrize(("parts", "max_depth"), [(1, None), (7, None), (7, 2)])
def test_prefix_partition_against_walk(spark, parts, max_depth):
    rng = random.Random(parts)
    names = [(rng.choice(["x", "y", None]), "".join(rng.choice("aab\u00e9\U0001F600") for _ in range(rng.randrange(1, 7)))) for _ in range(600)] + [("x", "long" * 9)] * 8
    df = spark.createDataFrame([(*n, "other") for n in names] + [("x", None, ""), ("x", "", "")], "kind string, name string, prefix string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.kind, r.prefix, r.depth): r.n_names for r in ST.prefix_partition(df, "name", ["kind"], cap=5, max_depth=max_depth).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == _walk(names, 5, max_depth)
    assert ST.prefix_partition(df.limit(0), "name", ["kind"]).count() == 0


def test_stream_equals_batch(spark, tmpdir_path):
    pages = I.registry_pages(spark, SF_SMALL)
    src = os.path.join(tmpdir_path, "src")
    pages.write.parquet(src)
    q = SL.stream_listing(spark, src, os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck"))
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(tmpdir_path, "out")).drop("page_key", "search", "pos")
    from nomen.operators import pages as P
    want = P.extract_listing(P.split_result_blocks(pages, keys=("page_key", "search"))).drop("page_key", "search", "pos")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    d = SL.stream_dedupe(spark.readStream.schema(got.schema).parquet(os.path.join(tmpdir_path, "out")), ["business_name"])
    seen = []
    h = SL.on_result(d, lambda b, i: seen.append(b.count()), os.path.join(tmpdir_path, "ck2"))
    h.awaitTermination()
    assert sum(seen) == want.select("business_name").distinct().count()


def test_stream_dedupe_within_watermark(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "ev")
    ev = I.table(spark, SF_SMALL, "events").select("ts", "user_id", "event_type")
    ev.unionByName(ev).write.parquet(src)                       # every event twice
    s = spark.readStream.schema(ev.schema).parquet(src)
    d = SL.stream_dedupe(s, ["user_id", "event_type", "ts"], event_time="ts", watermark="1 day")
    seen = []
    h = SL.on_result(d, lambda b, i: seen.append(b.count()), os.path.join(tmpdir_path, "ck3"))
    h.awaitTermination()
    assert sum(seen) == ev.distinct().count()


def test_number_rows_with_hot_key(spark):
    # a third of all rows share one sort key
    df = spark.range(0, 6000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 997).alias("k"), "id")
    rows = W.number_rows(df, ["k"], "n").select("k", "n").collect()
    ns = sorted(r.n for r in rows)
    assert ns == list(range(1, 6001))
    by_n = sorted(rows, key=lambda r: r.n)
    assert all(a.k <= b.k for a, b in zip(by_n, by_n[1:]))
    # the tie-break spreads the hot key over several range partitions
    from pyspark.sql import functions as G
    hashable = [G.col(c) for c in df.columns]
    def spread(*keys):
        return (df.repartitionByRange(8, *keys).where(G.col("k") == 500)
                .select(G.spark_partition_id().alias("p")).distinct().count())
    assert spread("k") == 1                               # without: one partition holds the hot key
    assert spread("k", G.xxhash64(*hashable)) > 1         # with the tie-break it is split
