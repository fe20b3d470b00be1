import os

from nomen import session
from nomen.session import checkpoint_dir, materialize, release_tables


def test_checkpoint_dir_is_read_from_the_session(spark):
    d = checkpoint_dir(spark)
    conf = spark.conf.get("spark.checkpoint.dir", None)
    assert d == (conf or spark.sparkContext.getCheckpointDir())
    assert checkpoint_dir(spark) == d                     # stable, no new folder per call
    t = materialize(spark.range(10), "probe")
    assert t.count() == 10
    local = d[len("file:"):] if d.startswith("file:") else d
    assert any(p.startswith("nomen-probe-") for p in os.listdir(local))


def test_release_removes_the_tables_written(spark, monkeypatch):
    monkeypatch.setattr(session, "_TABLES", [])          # those of other tests stay
    t = materialize(spark.range(5), "gone")
    at = session._TABLES[0][1]
    local = at[len("file:"):] if at.startswith("file:") else at
    assert t.count() == 5 and os.path.isdir(local)
    assert release_tables(spark) == 1 and not os.path.exists(local)
    assert release_tables(spark) == 0
