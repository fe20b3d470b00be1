"""The owner flow end to end through files, as a user runs it."""

import json
import os

from pyspark.sql import functions as F

from nomen.operators import owners as O
from nomen.operators import reports as R
from nomen.plans import pipelines as PL
from nomen.sinks import writers as Wr
from nomen.sources import readers as S


def test_geojson_to_filtered_reports(spark, tmpdir_path):
    owners = ["JOHN SMITH", "ANN LEE", "ACME HOLDINGS LTD", "PRIVATE 2020 TRUST", "MARY ANN BROWN",
              "123 MAIN STREET", "JOHN SMITH", "ZED QUUX"]
    fc = {"type": "FeatureCollection",
          "features": [{"type": "Feature", "properties": {"OWNERNAME": o}, "geometry": {"type": "Point", "coordinates": [i, i]}}
                       for i, o in enumerate(owners)]}
    src = os.path.join(tmpdir_path, "parcels.geojson")
    with open(src, "w", encoding="utf-8") as f:
        json.dump(fc, f)

    classified = O.classify_owners(S.read_owners(spark, src))
    kept = classified.where(F.col("keep")).select("owner")
    assert sorted(r.owner for r in kept.collect()) == ["ANN LEE", "JOHN SMITH", "MARY ANN BROWN", "PRIVATE 2020 TRUST", "ZED QUUX"]

    # registry results found for each owner (several for one, none for another)
    reg = spark.createDataFrame([
        ("JOHN SMITH", 2, "SMITH JOHN INC", "Not-for-Profit Corporation", "Active"),
        ("JOHN SMITH", 1, "JOHNSON FOODS LTD", "Ontario Business Corporation", "Active"),
        ("ANN LEE", 1, "LEE ANN CO-OPERATIVE", "Not-for-Profit Corporation", "Inactive"),
        ("MARY ANN BROWN", 1, "BROWN TRADING", "Co-operative with Share", "Active"),
        ("PRIVATE 2020 TRUST", 1, "UNRELATED NAME", "Not-for-Profit Corporation", "Active"),
    ], "owner string, record_id int, company_name string, business_type string, status string")
    reg = reg.select("*", F.lit("1").alias("corporation_number"), F.lit("Corporation").alias("registry_type"),
                     F.lit("Town, Region, Canada").alias("address"), F.lit("May 05, 2001").alias("registration_date"))
    entries = PL.owner_pipeline(kept, reg)
    st = {r.owner: (r.status, r.is_match, r.confidence) for r in entries.collect()}
    # first result by record_id is JOHNSON FOODS: 'john' lies inside 'johnson' -> 0.70
    assert st["JOHN SMITH"][0] == "scored" and st["JOHN SMITH"][2] == 0.70
    assert st["ZED QUUX"][0] == "no_page"

    out = os.path.join(tmpdir_path, "report")
    Wr.write_report(entries, out)
    parsed = R.parse_entries(S.read_lookup_report(spark, out), keep=("path",))
    assert parsed.count() == 5
    nfp = PL.business_type_report(parsed).collect()
    assert [r.search_name for r in nfp] == ["ANN LEE", "PRIVATE 2020 TRUST"]
    unmatched = {r.search_name for r in PL.unmatched_report(parsed).collect()}
    assert "ZED QUUX" in unmatched and "ANN LEE" not in unmatched
