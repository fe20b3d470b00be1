"""Spark helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomen.session import materialize

__all__ = ["materialize", "n_parts", "held_out", "labelled_sample", "read", "col", "empty"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name}`")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: str, mod: int, remainder: int) -> Column:
    """crc32(id as text) mod ``mod`` = ``remainder``; a null id is held out (nothing is learnt from it)."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % mod == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, limit: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``limit`` labelled rows for fitting: (text, y), evenly spread by a hash of the id.

    Null labels, null ids and held-out rows are left out; repeated labels of one id
    count once if they agree and not at all if they differ. The ``limit`` ids are
    those of the smallest hashes: a bounded top-k, whose id list is broadcast.
    """
    y = (labels.select(col(id_col).alias("_id"), col(label).cast("int").alias("_y")).dropna()
         .where(~held_out("_id", mod, remainder))
         .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_m")).where("_y = _m").drop("_m"))
    picked = y.orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(limit)
    return (docs.select(col(id_col).alias("_id"), col(text_col).alias("text"))
            .join(F.broadcast(picked), "_id")
            .groupBy("_id", F.col("_y").alias("y")).agg(F.min("text").alias("text")))   # one row per id


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
