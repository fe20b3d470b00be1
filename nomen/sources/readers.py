"""Readers: GeoJSON owners, saved pages, text reports, CSV summaries,
search logs, newest file of a folder.

Schemas are declared, never inferred. Large text reports are cut into
entries *by the reader* (``lineSep`` = the entry separator), so a report file
is split across tasks like any line-oriented file instead of being read whole
into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nomen.functions.names import py_strip
from nomen.operators import reports as R
from nomen.sources.geojson import feature_texts

PROPS = T.MapType(T.StringType(), T.StringType())
FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", PROPS),
    T.StructField("geometry", T.StringType()),   # raw JSON: Points and Polygons differ in depth
])
GEOJSON_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(FEATURE)),
    T.StructField("properties", PROPS),
    T.StructField("geometry", T.StringType()),
])
SEARCH_LOG_SCHEMA = T.StructType([
    T.StructField("business_name", T.StringType()),
    T.StructField("html_content", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("search_time", T.DoubleType()),
    T.StructField("response_size", T.LongType()),
])
SUMMARY_SCHEMA = T.StructType([
    T.StructField("owner_name", T.StringType()),
    T.StructField("match_found", T.StringType()),
    T.StructField("matched_company", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])
ENTRY_SEP = "\n" + R.RULE + "\nBUSINESS LOOKUP #"
SECTION_SEP = "\n" + R.RULE60 + "\n\n"


def read_geojson_features(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Features of GeoJSON files: a FeatureCollection's ``features``, or a
    bare Feature; features without properties skipped.

    By default a file is cut at byte ranges, so that one large document is
    read by many tasks (:mod:`nomen.sources.geojson`). ``multiline=True`` reads
    every document whole (one task per file), ``multiline=False`` files with one
    Feature per line.
    """
    if multiline is None:
        d = feature_texts(spark, path).select(F.from_json("text", FEATURE).alias("f")).select("f.*")
        return d.where((F.col("type") == "Feature") & F.col("properties").isNotNull())
    if not multiline:
        d = spark.read.schema(FEATURE).json(path)
        return d.where(F.col("properties").isNotNull())
    d = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", True).json(path)
    single = F.array(F.struct(F.col("type"), F.col("properties"), F.col("geometry")))
    feats = (F.when(F.size(F.coalesce(F.col("features"), F.array())) > 0, F.col("features"))
             .when(F.col("type") == "Feature", single)
             .otherwise(F.array().cast(T.ArrayType(FEATURE))))
    return d.select(F.inline(feats)).where(F.col("properties").isNotNull())


def read_owners(spark: SparkSession, path: str, owner_field: str = "OWNERNAME", multiline: bool | None = None) -> DataFrame:
    """``owner`` = stripped ``properties[owner_field]``; NULL / empty skipped."""
    f = read_geojson_features(spark, path, multiline)
    o = py_strip(F.col("properties")[owner_field])
    return f.select(o.alias("owner")).where(F.col("owner").isNotNull() & (F.col("owner") != ""))


def read_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: ``path, value`` (whole text)."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Saved result pages as ``(page_id, url, html)``; page_id hashes the path."""
    t = read_text_files(spark, path, glob)
    return t.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.col("value").alias("html"))


def read_cleaned_results(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, detail`` — the pairs of ``RESULT #1`` of each cleaned file."""
    t = read_text_files(spark, path, glob)
    return t.select("path", R.parse_result_sections(F.col("value")).alias("detail"))


def read_lookup_report(spark: SparkSession, path: str) -> DataFrame:
    """Entries of lookup report files, cut at the entry separator in the
    reader: ``path, entry`` (entry text as the in-memory splitter gives it)."""
    t = spark.read.option("lineSep", ENTRY_SEP).text(path)
    v = F.col("value")
    cont = v.rlike(r"^\d+:")
    first = v.rlike(R.ENTRY_START_RE)
    bare = v.startswith("BUSINESS LOOKUP #")
    e = (F.when(cont, F.concat(F.lit(R.RULE + "\nBUSINESS LOOKUP #"), v))
         .when(first, v)
         .when(bare, F.concat(F.lit(R.RULE + "\n"), v)))
    # a bare header is only an entry at the very start of a file
    start = F.col("_metadata.file_block_start") == 0
    keep = cont | first | (bare & start)
    return t.where(keep).select(F.col("_metadata.file_path").alias("path"), py_strip(e).alias("entry"))


def read_search_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of search report files, cut at their closing rule in the reader: ``path`` and the fields of
    ``parse_search_section`` (label, status, time, result blocks). One section holds one search's results."""
    t = spark.read.option("lineSep", SECTION_SEP).text(path)
    d = t.where(F.col("value").rlike(R.RESULT_RE) | F.startswith("value", F.lit("SEARCH: ")))
    return d.select(F.col("_metadata.file_path").alias("path"), R.parse_search_section("value").alias("s")).select("path", "s.*")


def read_search_report(spark: SparkSession, path: str) -> DataFrame:
    """Result blocks of search report files with their search: ``path, search, prefix, business_type, status,
    seconds, block`` (blocks outside a section have no search)."""
    d = read_search_sections(spark, path)
    return d.select("path", "search", "prefix", "business_type", "status", "seconds", F.explode("blocks").alias("block"))


def latest_file(spark: SparkSession, folder: str, prefix: str, suffix: str) -> DataFrame:
    """Path of the newest file named ``prefix*suffix`` (metadata only: the
    content column is never read). One row, or none."""
    d = (spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}")
         .load(folder).select("path", "modificationTime"))
    return d.agg(F.max_by("path", "modificationTime").alias("path")).where(F.col("path").isNotNull())


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of five text columns; malformed lines kept in
    ``_corrupt_record`` (PERMISSIVE)."""
    return (spark.read.schema(SUMMARY_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))


def read_search_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SEARCH_LOG_SCHEMA).format(fmt).load(path)
