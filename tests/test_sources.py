import json
import os
import time

from pyspark.sql import functions as F

from nomen.operators import reports as R
from nomen.sinks import writers as Wr
from nomen.sources import readers as S


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_geojson_collection_and_single(spark, tmpdir_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"OWNERNAME": " JOHN SMITH ", "PROPERTY_ID": "1"},
         "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"OWNERNAME": None}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 1]]]}},
        {"type": "Feature", "geometry": None},
        {"type": "Feature", "properties": {"OWNERNAME": ""}},
        {"type": "Feature", "properties": {"OWNERNAME": "JOHN SMITH"}},
        {"type": "Feature", "properties": {"OWNER": "ONLY OWNER FIELD"}},
    ]}
    single = {"type": "Feature", "properties": {"OWNERNAME": "ANN LEE"}, "geometry": {"type": "Point", "coordinates": [0, 0]}}
    d = os.path.join(tmpdir_path, "geo")
    os.makedirs(d)
    _write(os.path.join(d, "a.geojson"), json.dumps(fc))
    _write(os.path.join(d, "b.geojson"), json.dumps(single))
    owners = sorted(r.owner for r in S.read_owners(spark, d).collect())
    assert owners == ["ANN LEE", "JOHN SMITH", "JOHN SMITH"]
    assert [r.owner for r in S.read_owners(spark, d, owner_field="OWNER").collect()] == ["ONLY OWNER FIELD"]
    geo = {r.geometry for r in S.read_geojson_features(spark, d).collect()}
    assert any(g and "Polygon" in g for g in geo)


def test_lookup_report_reader_equals_in_memory_split(spark, tmpdir_path):
    rule = "=" * 80
    ent = lambda n, name: f"\n{rule}\nBUSINESS LOOKUP #{n}: {name}\n{rule}\n\nMATCH FOUND: NO\n{rule}\n\n\n"
    text = f"{rule}\nBUSINESS LOOKUP DETAILS - COMPREHENSIVE REPORT\n{rule}\n\n" + "".join(ent(i, f"N{i}") for i in range(1, 40))
    p = os.path.join(tmpdir_path, "report.txt")
    _write(p, text)
    a = [r.entry for r in S.read_lookup_report(spark, p).collect()]
    b = [r.entry for r in R.split_report_entries(spark.createDataFrame([(0, text)], "file_no int, value string")).orderBy("pos").collect()]
    assert a == b and len(a) == 39


def test_search_report_reader(spark, tmpdir_path):
    text = ("R\n" + "=" * 60 + "\n\nSEARCH: a (t)\n" + "-" * 40 + "\nStatus: Found\n"
            "--- Result #1 ---\nBusiness Name: A1\nStatus: Active\n\n--- Result #2 ---\nBusiness Name: A2\n"
            "Status: Inactive\n\n\n" + "=" * 60 + "\n\nSEARCH: b (t)\nStatus: Found\n")
    p = os.path.join(tmpdir_path, "search.txt")
    _write(p, text)
    blocks = [r.block for r in S.read_search_report(spark, p).collect()]
    assert blocks == ["Business Name: A1\nStatus: Active", "Business Name: A2\nStatus: Inactive"]


def test_latest_file_and_csv(spark, tmpdir_path):
    for i, name in enumerate(["rep_1.txt", "rep_2.txt", "other.txt"]):
        _write(os.path.join(tmpdir_path, name), "x")
        os.utime(os.path.join(tmpdir_path, name), (time.time() + i * 10, time.time() + i * 10))
    os.utime(os.path.join(tmpdir_path, "rep_1.txt"), (time.time() + 100, time.time() + 100))
    r = S.latest_file(spark, tmpdir_path, "rep_", ".txt").first()
    assert r.path.endswith("rep_1.txt")
    csv = os.path.join(tmpdir_path, "s.csv")
    _write(csv, 'Owner Name,Match Found,Matched Company,Source,Notes\n"A B",No,,X,ok\n"C D",Error: bad, thing,Y,Z,extra\n')
    rows = S.read_summary_csv(spark, csv).collect()
    assert rows[0].owner_name == "A B" and rows[0]._corrupt_record is None
    assert rows[1]._corrupt_record is not None


def test_writers(spark, tmpdir_path):
    from nomen.operators import owners as O
    cl = O.classify_owners(spark.createDataFrame([("JOHN SMITH",), ("ACME LTD",), ("ANN LEE",)], "owner string"))
    out = os.path.join(tmpdir_path, "lists")
    Wr.write_owner_lists(cl, out)
    kept = spark.read.text(os.path.join(out, "list=kept")).collect()
    assert sorted(r.value for r in kept) == ["   1. ANN LEE", "   2. JOHN SMITH"]
    recs = spark.createDataFrame([("B", None), ("A", "x")], "business_name string, status string")
    Wr.write_json_records(recs, os.path.join(tmpdir_path, "json"))
    back = spark.read.json(os.path.join(tmpdir_path, "json")).collect()
    assert {r.business_name for r in back} == {"A", "B"}


def test_per_record_and_append(spark, tmpdir_path):
    recs = spark.createDataFrame([(f"name {i}", f"<html>{i}</html>") for i in range(40)],
                                 "business_name string, html_content string")
    out = os.path.join(tmpdir_path, "per_record")
    Wr.write_per_record(recs, out, buckets=4)
    back = spark.read.parquet(out)
    assert back.count() == 40 and back.select("bucket").distinct().count() <= 4
    assert {r.file_label for r in back.collect()} >= {"name_0", "name_39"}
    files = [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 4                                      # not one of every task and folder
    Wr.write_per_record(recs, out + "_raw", buckets=2, html_col="html_content", files_per_bucket=3)
    pages, js = spark.read.parquet(out + "_raw/pages"), spark.read.json(out + "_raw/records")
    assert {(r.file_label, r.html_content) for r in pages.collect()} == {(f"name_{i}", f"<html>{i}</html>") for i in range(40)}
    assert {r.business_name for r in js.collect()} == {f"name {i}" for i in range(40)} and "html_content" not in js.columns
    rep = os.path.join(tmpdir_path, "rep")
    sec = spark.createDataFrame([("SEARCH: a (t)\n",)], "value string")
    Wr.append_search_report(sec, rep)
    Wr.append_search_report(sec, rep)
    assert spark.read.text(rep).where("value <> ''").count() == 2  # sections end in a newline


def test_lookup_report_split_across_tasks(spark, tmpdir_path):
    rule = "=" * 80
    ent = lambda n, name: (f"\n{rule}\nBUSINESS LOOKUP #{n}: {name}\n{rule}\n\nSEARCH RESULTS FOR: {name}\n"
                           + "x" * (n % 500) + f"\n{rule}\nMATCH FOUND: NO\n{rule}\n\n\n")
    text = f"{rule}\nBUSINESS LOOKUP DETAILS - COMPREHENSIVE REPORT\n{rule}\n\n" + "".join(ent(i, f"N{i}") for i in range(1, 400))
    p = os.path.join(tmpdir_path, "big_report.txt")
    _write(p, text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")    # the file is cut into many splits
    try:
        df = S.read_lookup_report(spark, p)
        assert df.rdd.getNumPartitions() > 10
        got = sorted(r.entry for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted(r.entry for r in R.split_report_entries(
        spark.createDataFrame([(0, text)], "file_no int, value string")).collect())
    assert got == want and len(got) == 399


def test_cleaned_results_and_whole_files(spark, tmpdir_path):
    """One row per file, however many lines it has; the first result's pairs."""
    from nomen.operators import reports as R
    body = "RESULT #1\n" + "-" * 40 + "\nCOMPANY NAME: A & Co\nSTATUS: Active\n\nRESULT #2\n" + "-" * 40 + "\nCOMPANY NAME: B\n"
    _write(os.path.join(tmpdir_path, "x_cleaned.txt"), body)
    _write(os.path.join(tmpdir_path, "y_cleaned.txt"), "no result\n\n")
    _write(os.path.join(tmpdir_path, "z.log"), "other")
    files = {os.path.basename(r.path): r.value for r in S.read_text_files(spark, tmpdir_path, "*_cleaned.txt").collect()}
    assert files == {"x_cleaned.txt": body, "y_cleaned.txt": "no result\n\n"}
    got = {os.path.basename(r.path): r.detail for r in S.read_cleaned_results(spark, tmpdir_path, "*_cleaned.txt").collect()}
    want = spark.createDataFrame([(body,)], "value string").select(R.parse_result_sections(F.col("value")).alias("d")).first().d
    assert got["x_cleaned.txt"] == want and want["COMPANY NAME"] == "A & Co"
