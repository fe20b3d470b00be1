"""Writers. Every writer is a distributed DataFrame write; ordering comes
from a range-partitioned sort, never from gathering rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nomen.functions import text as T
from nomen.operators import windows as W
from nomen.sinks.batches import append_batch


def write_owner_lists(classified: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Kept and excluded owners as sorted numbered lines ``{i:4}. owner``,
    one folder per ``list=kept|excluded`` and reason."""
    d = classified.withColumn("list", F.when(F.col("keep"), "kept").otherwise("excluded")) \
        .withColumn("reason", F.coalesce(F.col("reason"), F.lit("KEPT")))
    kept = W.number_rows(d.where(F.col("keep")), ["owner"], "i")
    excl = W.number_rows(d.where(~F.col("keep")), ["owner"], "i")
    out = kept.unionByName(excl)
    line = F.concat(F.lpad(F.col("i").cast("string"), 4, " "), F.lit(". "), F.col("owner"))
    (out.repartitionByRange("list", "i").sortWithinPartitions("list", "i")
        .select("list", "reason", line.alias("value"))
        .write.mode(mode).partitionBy("list", "reason").text(out_dir))


def write_rule_trace(classified: DataFrame, path: str, debug: bool = False) -> tuple[DataFrame, dict | None]:
    """The debug switch of the classifier: ``(classified, counts)``.

    With ``debug`` every name is written to ``path`` in one pass, a folder per rule
    (the names past the LTD/LIMITED rule are those folders but ``empty``, ``short`` and
    ``ltd``), the totals are observed in that same pass, and later steps read
    what was written: the input is scanned once. Without it nothing is written
    and the frame is handed on as it is."""
    if not debug:
        return classified, None
    seen = Observation()
    passed = ~F.col("rule").isin("empty", "short", "ltd")
    watched = classified.observe(seen, F.count(F.lit(1)).alias("owners"), F.count_if("keep").alias("kept"),
                                 F.count_if(~F.col("keep")).alias("excluded"), F.count_if(passed).alias("past_ltd"))
    watched.write.mode("overwrite").partitionBy("rule").parquet(path)
    return classified.sparkSession.read.schema(classified.schema).parquet(path).select(*classified.columns), dict(seen.get)


def write_report(entries: DataFrame, path: str, n_col: str = "lookup_number", entry_col: str = "entry",
                 mode: str = "overwrite") -> None:
    """Entries in number order as text part files (range partitioned)."""
    (entries.repartitionByRange(n_col).sortWithinPartitions(n_col).select(F.col(entry_col).alias("value"))
        .write.mode(mode).text(path))


def write_json_records(records: DataFrame, path: str, sort_by: str = "business_name", mode: str = "overwrite") -> None:
    """Records sorted by ``sort_by`` (missing = '') as JSON lines, UTF-8,
    non-ASCII kept, NULL fields dropped."""
    (records.orderBy(F.coalesce(F.col(sort_by), F.lit("")), *records.columns)
        .write.mode(mode).option("ignoreNullFields", True).json(path))


def write_per_record(df: DataFrame, path: str, name_col: str = "business_name", buckets: int = 64,
                     mode: str = "overwrite", html_col: str | None = None, files_per_bucket: int = 1) -> None:
    """Raw page and JSON record per search, grouped into ``buckets`` folders
    by a hash of the name (never one file per row).

    Rows are shuffled by folder first, so a folder gets ``files_per_bucket``
    files and not one from every task; raise both numbers with the data. A
    row's file follows from all its columns, so a name that many rows share
    is spread over its folder's files. With ``html_col`` the raw pages go to
    ``path/pages`` and the other columns to ``path/records`` as JSON lines;
    without it everything is one parquet table."""
    d = df.withColumn("bucket", F.pmod(F.xxhash64(F.col(name_col)), F.lit(buckets)))
    d = d.withColumn("file_label", T.safe_name(F.col(name_col)))
    part = F.pmod(F.xxhash64(F.lit(1), *[F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]), F.lit(files_per_bucket))
    # one shuffle partition per output file (two files share one where their hashes meet)
    d = d.withColumn("_part", part).repartition(buckets * files_per_bucket, "bucket", "_part").drop("_part")
    if html_col is None:
        d.write.mode(mode).partitionBy("bucket").parquet(path)
        return
    d.select("bucket", "file_label", F.col(html_col)).write.mode(mode).partitionBy("bucket").parquet(f"{path}/pages")
    (d.drop(html_col).write.mode(mode).partitionBy("bucket").option("ignoreNullFields", True).json(f"{path}/records"))


def append_search_report(sections: DataFrame, path: str, value: str = "value", batch_id: int | None = None) -> bool:
    """Append sections to the report folder. With a ``batch_id`` the batch is there
    once, however often it is run (text under ``path/batch=<id>``); without one
    every call adds its rows. ``False`` when the batch was there already."""
    out = sections.select(F.col(value).alias("value"))
    if batch_id is not None:
        return append_batch(out, path, batch_id, "text")
    out.write.mode("append").text(path)
    return True


def write_ordered_text(header: DataFrame, lines: DataFrame, path: str, order: str = "i", mode: str = "overwrite") -> None:
    """A text report as one ordered, distributed write: the header row
    (order 0) and the numbered lines, range-partitioned by their number."""
    h = header.select(F.lit(0).cast("long").alias("_o"), F.col("value"))
    body = lines.select(F.col(order).cast("long").alias("_o"), F.col("value"))
    (h.unionByName(body).repartitionByRange("_o").sortWithinPartitions("_o").select("value")
        .write.mode(mode).text(path))


def write_filtered_report(summary: DataFrame, path: str, business_type: str, source: str = "",
                          generated: str = "1970-01-01 00:00:00") -> None:
    """Business-type report: header with the total, then ``i. company`` lines
    (``summary`` from ``pipelines.business_type_report``)."""
    from nomen.operators import reports as R
    header = summary.agg(F.count(F.lit(1)).alias("n")).select(
        R.filtered_report_header(F.col("n"), business_type, source, generated).alias("value"))
    write_ordered_text(header, summary.select("i", F.col("line").alias("value")), path, "i")


def write_unmatched_report(unmatched: DataFrame, path: str, source: str = "",
                           generated: str = "1970-01-01 00:00:00") -> None:
    """Unmatched report: header, numbered summaries, then the original
    entries in the same order (``unmatched`` from
    ``pipelines.unmatched_report``)."""
    from nomen.operators import reports as R
    n = unmatched.agg(F.count(F.lit(1)).alias("n"))
    header = n.select(R.unmatched_report_header(F.col("n"), source, generated).alias("value"))
    lines = unmatched.select("i", R.render_unmatched_line(
        F.col("i"), F.col("search_name"), F.col("found"), F.coalesce(F.col("status"), F.lit("Unknown")),
        F.coalesce(F.col("address"), F.lit("Unknown")), F.col("match_found"), F.col("confidence")).alias("value"))
    # the detailed entries follow all summary lines: their order key is shifted
    detail = unmatched.select((F.col("i") + F.lit(1 << 40)).alias("i"),
                              F.concat(F.col("original_entry"), F.lit("\n\n")).alias("value"))
    write_ordered_text(header, lines.unionByName(detail), path, "i")
