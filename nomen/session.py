"""Session helpers.

The library never assumes a machine-local folder on a cluster: lineage cuts go
to ``spark.checkpoint.dir`` as the cluster names it. Only when that setting is
absent (local tests) do we set our own scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_TABLES: list[tuple[str, str]] = []   # (application id, path) of the tables written by materialize

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # string parsing is CPU-heavy while its shuffles are small once
    # compressed: keep AQE from folding them into one or two tasks
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "nomen", extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir`` (as the cluster sets it), else from
    the SparkContext's checkpoint folder. Only when neither is set, and only
    on a local master (tests), a scratch folder is created and registered
    with the SparkContext; the runtime conf may refuse the key, which is fine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="nomen-ckpt-", dir=os.environ.get("NOMEN_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - a core conf; the SparkContext setting below suffices
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df, name: str = "t"):
    """Write ``df`` once as a parquet table under the session's checkpoint
    folder and read it back: one computation (``Dataset.checkpoint`` runs the
    plan twice unless persisted), reliable shared storage, lineage cut, and
    column pruning / predicate pushdown on the re-read. The table stays until
    :func:`release_tables`."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/nomen-{name}-{uuid.uuid4().hex}"
    _TABLES.append((spark.sparkContext.applicationId, path))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialize` wrote for this application,
    through the file system that holds them; returns their number. Results
    that still read them must have been written or collected before."""
    sc = spark.sparkContext
    mine = [p for app, p in _TABLES if app == sc.applicationId]
    for p in mine:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    _TABLES[:] = [t for t in _TABLES if t[0] != sc.applicationId]
    return len(mine)
