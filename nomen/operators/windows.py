"""Numbering and batching.

``number_rows`` gives a global 1-based number in sort order without a
single-partition window: the data is range-partitioned by the sort (one
shuffle), each partition numbers its rows locally
(``monotonically_increasing_id`` holds the partition id and the local index),
the per-partition counts — one row per partition, a bounded table, fetched
once as ``zipWithIndex`` does — give each partition its offset, joined back as
a broadcast of a literal table. The sorted data is
materialised first so both passes see the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.session import materialize as materialize_table

LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | local index


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number_rows(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Global 1-based row number by ``order`` (two passes, no single task).

    The sorted rows with their partition-local ids are always written once
    (``materialize``): both passes must see the same partitioning, which a
    recomputed sort does not promise."""
    # tie-breaks spread rows with equal sort keys over the range partitions
    # (a key held by a third of all rows would otherwise fill one task);
    # rows equal in every column are interchangeable, so their order is free
    hashable = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    s = df.orderBy(*order, *([F.xxhash64(*hashable)] if hashable else []), F.rand(17))
    s = s.withColumn("_mid", F.monotonically_increasing_id())
    s = materialize_table(s, "sorted")
    s = s.withColumn("_pid", F.shiftright("_mid", LOCAL_BITS)) \
         .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)))
    # one row per partition (bounded by the partition count, as in
    # zipWithIndex): fetched once, offsets summed, broadcast back as a literal
    # table, so every later use of the result is a broadcast hash join
    counts = sorted((r[0], r[1]) for r in s.groupBy("_pid").agg(F.count(F.lit(1))).collect())
    offs, acc = [], 0
    for pid, cnt in counts:
        offs.append((pid, acc))
        acc += cnt
    offs_df = df.sparkSession.createDataFrame(offs or [(0, 0)], "_pid long, _off long")
    out = s.join(F.broadcast(offs_df), "_pid").withColumn(name, F.col("_off") + F.col("_loc") + 1)
    return out.drop("_mid", "_pid", "_loc", "_off")


def batch_number(n, size: int) -> Column:
    """Batch of a 1-based number: floor((n - 1) / size) + 1."""
    return (F.floor((_c(n) - 1) / size) + 1).cast("long")


def batch_position(n, size: int) -> Column:
    return (F.pmod(_c(n) - 1, F.lit(size)) + 1).cast("long")


def n_batches(total, size: int) -> Column:
    return F.ceil(_c(total) / size).cast("long")


def round_robin(n, lanes: int) -> Column:
    """Lane of a 1-based number: (n - 1) mod lanes."""
    return F.pmod(_c(n) - 1, F.lit(lanes)).cast("int")
