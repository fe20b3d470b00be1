"""Join helpers for skewed keys.

``lookup_join`` joins a large, possibly skewed *probe* side to a *lookup* side
holding at most one row per key. Keys that hold many probe rows (a third of
all rows, say) would land in one task; they are found by a map-side combined
count of key hashes, and only those keys are salted: their probe rows spread
over as many buckets as the key has task-loads of rows, and their (single)
lookup row is copied into each bucket.

A key is hot from a quarter of a task's share of the probe rows, so at most
``4 x shuffle partitions`` keys are hot whatever the input: the list is complete,
and its size is bounded without a cut. Keys are listed by hash; two keys with one
hash only get salt they do not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOADS_PER_TASK = 4    # a key is hot from 1/4 of the rows a task would get ...
MIN_HOT_ROWS = 10_000  # ... and at least this many, below which salt costs more than it saves


def hot_hashes(probe: DataFrame, keys: list[str], min_rows: int | None = None) -> list[tuple[int, int]]:
    """``(hash, buckets)`` of the hot keys: at most ``LOADS_PER_TASK x shuffle
    partitions`` pairs of numbers, or, with ``min_rows`` given, the keys with as
    many rows."""
    counts = probe.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    if min_rows is None:
        loads = LOADS_PER_TASK * int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = counts.agg(F.sum("_n")).scalar()                 # from the counts' own exchange, not from the probe again
        load = F.greatest(F.lit(MIN_HOT_ROWS), F.ceil(total / F.lit(loads)))
    else:
        load = F.lit(min_rows)
    return [(r[0], r[1]) for r in counts.where(F.col("_n") >= load)
            .select("_h", F.ceil(F.col("_n") / load).cast("int")).collect()]


def lookup_join(probe: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner",
                salt_by: str | None = None, n_salt: int = 1,
                min_hot_rows: int | None = None) -> DataFrame:
    """Join ``probe`` to ``lookup`` (unique on ``keys``) with hot keys salted.

    Each hot key is split into ``max(n_salt, its task-loads)`` buckets: its
    probe rows are spread by a hash of ``salt_by`` (stable across task retries,
    unlike ``rand()``), its single lookup row is copied into each bucket. Cold
    keys join as usual; AQE's skew split remains as a second line.
    """
    rows = hot_hashes(probe, keys, min_hot_rows)
    if not rows:
        return probe.join(lookup, keys, how)
    hot = F.broadcast(probe.sparkSession.createDataFrame([(h, max(n, n_salt)) for h, n in rows], "_h long, _buckets int"))
    salt_src = [F.col(salt_by)] if salt_by else [F.col(c) for c in probe.columns]
    p = (probe.withColumn("_h", F.xxhash64(*keys)).join(hot, "_h", "left")
         .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salt_src), F.col("_buckets")), F.lit(0)).cast("int"))
         .drop("_h", "_buckets"))
    lk = (lookup.withColumn("_h", F.xxhash64(*keys)).join(hot, "_h", "left")
          .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_buckets"), F.lit(1)) - 1)))
          .drop("_h", "_buckets"))
    return p.join(lk, keys + ["_salt"], how).drop("_salt")
