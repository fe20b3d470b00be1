"""Features cut at byte ranges against the whole-file reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from nomen.sources import geojson as G
from nomen.sources import readers as S

rng = random.Random(12)
ODD = ['a { brace', 'two }} {{', 'quote " and {', "back \\ slash", 'end \\" {', "Ünï 漢字", "", '"type": "Feature"', "line\nbreak", "\\"]


def feature(i):
    return {"type": "Feature", "properties": None if i % 7 == 3 else {"OWNERNAME": f"{rng.choice(ODD)} {i}", "x{": rng.choice(ODD)},
            "geometry": {"type": "Polygon", "coordinates": [[[i, j] for j in range(rng.randrange(1, 40))]], "extra": {"deep": {"er": [{}, {"a": "}"}]}}}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("geo")
    big = {"type": "FeatureCollection", "name": "n {", "crs": {"type": "name", "properties": {"name": "EPSG {"}}, "features": [feature(i) for i in range(300)]}
    (d / "a.geojson").write_text(json.dumps(big))
    (d / "b.geojson").write_text(json.dumps(big, indent=1, ensure_ascii=False).replace('"features"', '"features" '))
    (d / "c.geojson").write_text(json.dumps(feature(1)))
    (d / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (d / "e.geojson").write_text(json.dumps({"features": [feature(5)], "type": "FeatureCollection"}, indent=2))
    return str(d)


def rows(df):
    return sorted((r.type, tuple(sorted(r.properties.items())), json.dumps(json.loads(r.geometry), sort_keys=True)) for r in df.collect())


@pytest.mark.parametrize("split", [None, "997", "20000"])
def test_byte_ranges_equal_whole_files(spark, folder, split):
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"} if split else {}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        if split:
            assert S.read_geojson_features(spark, f"{folder}/a.geojson").rdd.getNumPartitions() > 1
            if split == "997":                        # whole features are larger than a split; single-Feature files would be, too
                for name in "abd":
                    assert rows(S.read_geojson_features(spark, f"{folder}/{name}.geojson")) == rows(S.read_geojson_features(spark, f"{folder}/{name}.geojson", multiline=True))
                return
        assert rows(S.read_geojson_features(spark, folder)) == rows(S.read_geojson_features(spark, folder, multiline=True))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_split_states():
    text = json.dumps({"features": [feature(i) for i in range(20)]})
    pieces = text.split("{")
    want = [t for k, t in G.objects(iter(pieces), 0, 0, 0) if k == "whole"]
    assert [json.loads(x)["type"] for x in want] == ["Feature"] * 20
    for cut in range(1, len(pieces), 7):
        s0, d0, _, _ = G._change(iter(pieces[:cut]), 0)
        got = [*G.objects(iter(pieces[:cut]), 0, 0, 0), *G.objects(iter(pieces[cut:]), 1, s0, d0)]
        joined, open_ = [], ""
        for kind, t in got:
            if kind == "whole":
                joined.append(t)
            elif kind == "tail":
                open_ = t
            else:
                joined.append(open_ + t)
        assert joined == want


def test_owners_by_default(spark, folder):
    a = S.read_owners(spark, f"{folder}/a.geojson").agg(F.count("*"), F.max("owner")).first()
    assert a == S.read_owners(spark, f"{folder}/a.geojson", multiline=True).agg(F.count("*"), F.max("owner")).first()
