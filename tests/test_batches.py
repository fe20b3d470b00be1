"""Appends that survive replays, exact stream dedupe, newest report to JSON."""

import os
import time

import pytest
from pyspark.sql import functions as F

from nomen.plans import inputs as I
from nomen.plans import pipelines as PL
from nomen.sinks import batches as B
from nomen.streaming import search_log as SL
from tests.conftest import SF_SMALL

SCHEMA = "name string, kind string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_batch_run_twice_is_there_once(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    a, b = frame(spark, [("x", "k", 1), ("x", "k", 1)]), frame(spark, [("y", None, 2)])
    assert B.read_batches(spark, path, SCHEMA).count() == 0 and B.committed(spark, path) == []
    assert B.append_batch(a, path, 0) and B.append_batch(b, path, 1) and not B.append_batch(a, path, 0)
    assert B.committed(spark, path) == [0, 1]
    assert B.read_batches(spark, path, SCHEMA).count() == 3 and B.read_batches(spark, path, SCHEMA, before=1).count() == 2
    # what a lost run left behind is no batch, and is replaced
    lost = os.path.join(path, "batch=2")
    b.write.parquet(lost)
    os.remove(os.path.join(lost, "_SUCCESS"))
    assert B.committed(spark, path) == [0, 1] and B.append_batch(a, path, 2)
    assert B.read_batches(spark, path, SCHEMA).count() == 5


def test_append_new(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    assert B.append_new(frame(spark, [("a", None, 2), ("a", None, 1), ("b", "k", 3)]), path, 0, ["name", "kind"])
    assert B.append_new(frame(spark, [("a", None, 0), ("b", None, 4), (None, None, 5)]), path, 1, ["name", "kind"])
    assert not B.append_new(frame(spark, [("z", None, 0)]), path, 1, ["name", "kind"])
    assert B.append_new(frame(spark, []), path, 2, ["name", "kind"])
    got = sorted((tuple(r) for r in B.read_batches(spark, path, SCHEMA).collect()), key=str)
    assert got == sorted([("a", None, 1), ("b", "k", 3), ("b", None, 4), (None, None, 5)], key=str)


def test_stream_dedupe_is_exact_over_restarts(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("src", "out", "ck"))
    frame(spark, [("a", "k", 1), ("b", "k", 2), ("a", "k", 1)]).write.parquet(src)

    def run():
        SL.dedupe_into(spark.readStream.schema(SCHEMA).parquet(src), out, ["name", "kind"], ck).awaitTermination()
        return sorted(r.name for r in B.read_batches(spark, out, SCHEMA).collect())
    assert run() == ["a", "b"]
    frame(spark, [("a", "k", 9), ("c", "k", 3)]).write.mode("append").parquet(src)
    assert run() == ["a", "b", "c"]                          # a new query on the same checkpoint
    assert run() == ["a", "b", "c"]
    # the last batch is run again as after a failure between the write and the stream's own commit
    commits = os.path.join(ck, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    assert run() == ["a", "b", "c"]


def test_search_report_sink_and_newest_report(spark, tmpdir_path):
    pages = I.registry_pages(spark, SF_SMALL).limit(6).cache()
    report = os.path.join(tmpdir_path, "report")
    assert PL.search_report_sink(pages, report, 7) and not PL.search_report_sink(pages, report, 7)
    text = spark.read.text(os.path.join(report, "batch=7"), wholetext=True)
    assert text.select(F.sum(F.size(F.split("value", "\nSEARCH: ")) - 1)).first()[0] == pages.count()
    folder = os.path.join(tmpdir_path, "reports")
    os.mkdir(folder)
    body = "\n".join(r.value for r in PL.search_sections(pages).collect())
    for k, name in enumerate(["report_old.txt", "report_new.txt", "other.txt"]):
        with open(os.path.join(folder, name), "w") as f:
            f.write(body if name == "report_new.txt" else "--- Result #1 ---\nBusiness Name: WRONG\n")
        os.utime(os.path.join(folder, name), (time.time() - 100 + 10 * k,) * 2)
    out = os.path.join(tmpdir_path, "json")
    got = PL.latest_search_report_to_json(spark, folder, out, "report_")
    want = PL.search_report_to_json(PL.search_sections(pages))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    with pytest.raises(FileNotFoundError):
        PL.latest_search_report_to_json(spark, folder, out, "none_")


def test_debug_switch(spark, tmpdir_path):
    from pyspark.sql.functions import udf

    from nomen.operators import owners as O
    from nomen.sinks import writers as WR
    path = os.path.join(tmpdir_path, "trace")
    scans = spark.sparkContext.accumulator(0)

    @udf("string")
    def seen(x):
        scans.add(1)
        return x
    names = ["JOHN SMITH", "ACME LTD", "", "AB", "PRIVATE 1999", "12 MAIN", "JANE DOE"]
    owners = spark.createDataFrame([(n,) for n in names], "owner string").withColumn("owner", seen("owner"))
    plain = O.classify_owners(owners, distinct=False)
    same, counts = WR.write_rule_trace(plain, path)
    assert same is plain and counts is None and not os.path.exists(path) and scans.value == 0
    got, counts = WR.write_rule_trace(plain, path, debug=True)
    rows = sorted(tuple(r) for r in got.collect())
    assert got.count() == len(names) and scans.value == len(names)                       # later steps read what was written
    want = O.classify_owners(spark.createDataFrame([(n,) for n in names], "owner string"), distinct=False)
    assert rows == sorted(tuple(r) for r in want.collect())
    kept = want.where("keep").count()
    assert counts == {"owners": len(names), "kept": kept, "excluded": len(names) - kept, "past_ltd": O.rule_trace(want).count()}
