"""Replay-safe appends: one folder per batch number, committed by its ``_SUCCESS`` file.

A micro-batch (or a job that is run again after a failure) writes its rows to
``path/batch=<number>``. A folder is part of the table only once Spark's committer has
finished it; a batch that is run again finds it finished and writes nothing, or
overwrites what a lost run has left. So every batch is in the table once, whatever
is repeated, and readers never see half of one. Folders are listed through the
file system that holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "batch="


def _folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{PREFIX}{int(batch_id)}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    p, fs = _fs(spark, f"{_folder(path, batch_id)}/_SUCCESS")
    return fs.exists(p)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished batches, ascending (one folder each)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    ids = sorted(int(n[len(PREFIX):]) for n in names if n.startswith(PREFIX) and n[len(PREFIX):].isdigit())
    return [i for i in ids if is_committed(spark, path, i)]


def append_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> bool:
    """Write a batch once; ``False`` when it was there already."""
    spark = df.sparkSession
    if is_committed(spark, path, batch_id):
        return False
    w = df.write.format(fmt).mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    w.save(_folder(path, batch_id))
    return True


def read_batches(spark: SparkSession, path: str, schema, fmt: str = "parquet", before: int | None = None) -> DataFrame:
    """Rows of the finished batches (of numbers under ``before``); none give an empty table of ``schema``."""
    ids = [i for i in committed(spark, path) if before is None or i < before]
    r = spark.read.format(fmt).schema(schema)
    if not ids:
        return spark.createDataFrame([], schema)
    return r.load([_folder(path, i) for i in ids])


def append_new(df: DataFrame, path: str, batch_id: int, cols: list[str]) -> bool:
    """Append the rows whose ``cols`` no earlier batch holds, one row per distinct ``cols``.

    An anti join (null equals null) against the key columns of the finished earlier
    batches: exact at any distance in time. Of rows equal in ``cols`` the least stays."""
    spark = df.sparkSession
    if is_committed(spark, path, batch_id):
        return False
    rest = [c for c in df.columns if c not in cols]
    one = df.groupBy(*cols).agg(F.min(F.struct(*rest)).alias("_rest")).select(*cols, "_rest.*") if rest else df.distinct()
    had = read_batches(spark, path, df.schema, before=batch_id).select(*[F.col(c).alias(f"_had_{i}") for i, c in enumerate(cols)])
    same = F.lit(True)
    for i, c in enumerate(cols):
        same = same & one[c].eqNullSafe(had[f"_had_{i}"])
    return append_batch(one.join(had, same, "left_anti").select(*df.columns), path, batch_id)
