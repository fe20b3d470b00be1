"""Aggregations over search logs and name columns.

A search log is a table ``(business_name, html_content, success,
error_message, search_time, response_size)``. All statistics are one
``agg`` (map-side combined) with safe division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomen.functions import text as T
from nomen.session import materialize

SEQUENTIAL_SECONDS = 10.0  # assumed time of one sequential search (speed-up base)
RANGE_BITS = 15            # a range of the prefix partition has at most 2^15 names, however large the input


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def search_success_counts(log: DataFrame, group=()) -> DataFrame:
    """Searches, successes and the average time per search."""
    g = log.groupBy(*group)
    return g.agg(F.count(F.lit(1)).alias("n_searches"),
                 F.count_if(F.col("success")).alias("n_success"),
                 F.round(F.try_divide(F.sum("search_time"), F.count(F.lit(1))), 6).alias("avg_seconds"))


def lookup_stats(log: DataFrame, group=(), sequential_seconds: float = SEQUENTIAL_SECONDS) -> DataFrame:
    """Totals, averages, rows per second and the speed-up against
    ``sequential_seconds`` per search; divisions are safe (NULL on zero)."""
    n = F.count(F.lit(1))
    tot = F.sum("search_time")
    return log.groupBy(*group).agg(
        n.alias("n_searches"),
        F.count_if(F.col("success")).alias("n_success"),
        F.round(tot, 6).alias("total_seconds"),
        F.round(F.try_divide(tot, n), 6).alias("avg_seconds"),
        F.round(F.try_divide(n, tot), 6).alias("per_second"),
        F.round(F.try_divide(n * F.lit(sequential_seconds), tot), 6).alias("speedup"),
        F.round(T.relative_gain(F.try_divide(tot, n),
                                F.try_divide(F.sum(F.when(F.col("success"), F.col("search_time"))),
                                             F.count_if(F.col("success")))), 6).alias("gain_pct"),
    )


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_if(F.col("is_match")).alias("n_matched"), F.count(F.lit(1)).alias("n_total"))


def results_per_search(pages: DataFrame, search: str = "search", html: str = "html") -> DataFrame:
    """Result containers per search over all its pages; a search without results counts 0."""
    from nomen.operators.pages import count_results
    return pages.groupBy(search).agg(F.sum(count_results(html)).cast("long").alias("n_results"))


def filtered_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def _common(a: str, b: str) -> int:
    """Length of the common prefix of two names."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _local_depths(names: list[str], rows: list[int], same: list[bool], cap: int) -> list[int]:
    """Per name of a sorted list the longest of its prefixes that ``cap`` rows
    of the list share (0: none). ``same[i]``: name i is of the group of i - 1.

    The branching prefixes of sorted names are met by a stack of open
    prefixes; one that closes with ``cap`` rows gives its depth to the names
    under it that no longer one has claimed."""
    total = [0]
    for r in rows:
        total.append(total[-1] + r)
    depth, free = [0] * len(names), list(range(len(names) + 1))   # free[i]: first name from i on without a depth

    def first_free(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    stack: list[tuple[int, int]] = []                              # (length, first name) of the open prefixes
    for i in range(len(names) + 1):
        shared = _common(names[i - 1], names[i]) if 0 < i < len(names) and same[i] else 0
        start = i
        while stack and stack[-1][0] > shared:
            length, start = stack.pop()
            if total[i] - total[start] >= cap:
                j = first_free(start)
                while j < i:
                    depth[j], free[j] = length, j + 1
                    j = first_free(j)
        if i < len(names):
            if shared and (not stack or stack[-1][0] < shared):
                stack.append((shared, start))
            stack.append((len(names[i]), i))
    return depth


def prefix_partition(names: DataFrame, name: str = "name", group=(), cap: int = 200,
                     max_depth: int | None = None) -> DataFrame:
    """Leaf prefixes of a name column such that each holds fewer than
    ``cap`` names (the adaptive prefix walk, re-aimed as common prefixes of
    sorted names).

    The walk deepens a prefix while it holds ``cap`` names or more; a prefix
    is a leaf when it holds fewer or when a name ends there (it cannot be
    deepened). There is no depth limit unless the caller sets ``max_depth``.
    A name's leaf is one letter longer than its longest saturated prefix, so
    that depth is all that is needed per distinct name:

    1. distinct names are counted and dealt by ranges of (group, name), once;
       a range has at most ``2 ** RANGE_BITS`` names, as Python holds one range at a time;
    2. within a range the saturated prefixes come from the common prefixes of
       neighbours (``_local_depths``), linear in the names;
    3. only the prefixes of a range's first and last name can go on in another
       range: their counts (at most two names' letters per range) are added up
       over the ranges, and lengthen the depths;
    4. names are grouped by the leaf that their depth gives.

    No name is cut into all its prefixes and nothing is joined with itself.
    Returns ``group..., prefix, depth, n_names``.
    """
    g = list(group)
    base = (names.select(*g, F.lower(F.col(name)).alias("_nm")).where(F.col("_nm").isNotNull() & (F.col("_nm") != ""))
            .groupBy(*g, "_nm").agg(F.count(F.lit(1)).alias("_rows")))
    # the group as one value in which null differs from every text
    base = base.withColumn("_group", F.to_json(F.struct(*g)) if g else F.lit(""))
    ranges = materialize(base.orderBy("_group", "_nm").withColumn("_part", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)), "prefix-ranges")

    def depths(pdf):
        pdf = pdf.sort_values(["_group", "_nm"], kind="stable", key=lambda c: c.map(lambda x: x.encode()))
        nm, gr, rows = pdf["_nm"].tolist(), pdf["_group"].tolist(), pdf["_rows"].tolist()
        same = [i > 0 and gr[i] == gr[i - 1] for i in range(len(nm))]
        pdf["_depth"] = _local_depths(nm, rows, same, cap)
        pdf["_first"] = [_common(nm[0], x) if k == gr[0] else 0 for x, k in zip(nm, gr, strict=True)]
        pdf["_last"] = [_common(nm[-1], x) if k == gr[-1] else 0 for x, k in zip(nm, gr, strict=True)]
        return pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    local = materialize(ranges.groupBy("_part").applyInPandas(depths, kinds + ", _depth int, _first int, _last int"), "prefix-depths")

    # prefixes of the first and last names: rows that share them, per range, then over all ranges
    edge = F.array(F.struct(F.lit("_first").alias("side"), F.col("_first").alias("n")), F.struct(F.lit("_last").alias("side"), F.col("_last").alias("n")))
    shared = local.select("_part", "_group", "_nm", "_rows", F.explode(edge).alias("e")).where("e.n > 0")
    counts = (shared.groupBy("_part", F.col("e.side").alias("side"), "_group", F.col("e.n").alias("n"))
              .agg(F.sum("_rows").alias("rows"), F.min("_nm").alias("nm")))           # one row per side and shared length
    edges = (counts.groupBy("_part", "side", "_group").agg(F.collect_list(F.struct("n", "rows")).alias("c"), F.max_by("nm", "n").alias("nm"))
             .withColumn("d", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("c", lambda x: x["n"])))))
             .select("_part", "side", "_group", "d", F.substring("nm", F.lit(1), F.col("d")).alias("prefix"),
                     F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["n"] >= F.col("d"), x["rows"]).otherwise(0)).alias("rows")))
    edges = materialize(edges, "prefix-edges")
    full = (edges.groupBy("_part", "_group", "prefix").agg(F.max("rows").alias("rows"))                # a range counts once, whichever side
            .groupBy("_group", "prefix").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= cap).select("_group", "prefix"))
    reach = (edges.join(full, ["_group", "prefix"]).groupBy("_part")
             .agg(*[F.coalesce(F.max(F.when(F.col("side") == x, F.col("d"))), F.lit(0)).alias("_g" + x) for x in ("_first", "_last")]))
    # one row per range: as bounded as the list of ranges itself
    d = F.greatest("_depth", *[F.least(F.col(x), F.coalesce("_g" + x, F.lit(0))) for x in ("_first", "_last")])
    leaf = d + 1 if max_depth is None else F.least(d + 1, F.lit(max_depth))
    return (local.join(F.broadcast(reach), "_part", "left").select(*g, "_nm", "_rows", leaf.cast("int").alias("depth"))
            .groupBy(*g, "depth", F.substring("_nm", F.lit(1), F.col("depth")).alias("prefix")).agg(F.sum("_rows").alias("n_names"))
            .select(*g, "prefix", "depth", "n_names"))


def union_batches(*batches: DataFrame) -> DataFrame:
    """Concatenate batch results by column name."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out
