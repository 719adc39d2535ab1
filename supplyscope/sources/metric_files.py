"""Metric files: directories of JSON documents in, partitioned Parquet out.

A file holds one document, over any number of lines, or with `lines` one document a line. Files of the second kind are read
in splits and are what a large store should write: their number does not grow with the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, path: str, pattern: str, lines: bool) -> DataFrame:
    """One row per document with its text as a variant, null where the text is no JSON; empty lines are none."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=not lines)
    )
    meta = ["_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"]
    read = files.select(*meta, "value", F.try_parse_json("value").alias("doc"))
    return read.where(F.trim("value") != "") if lines else read


def _is_object() -> Column:
    return F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("doc", f"$.{name}", kind)


def bad_metric_records(spark: SparkSession, path: str, pattern: str = "metrics-*.json", lines: bool = False) -> DataFrame:
    """(file_path, record): the documents that `read_metric_files` skips, as they stand in their file."""
    return _documents(spark, path, pattern, lines).where(~_is_object()).select("file_path", F.col("value").alias("record"))


def read_metric_files(
    spark: SparkSession, path: str, pattern: str = "metrics-*.json", ordered: bool = True, lines: bool = False
) -> DataFrame:
    """Install metrics, one per document. What is no JSON object is skipped, missing fields get defaults.

    Times are seconds; `cache_hit` is read when it is there.
    """
    docs = _documents(spark, path, pattern, lines).where(_is_object())
    zero = F.lit(0.0)

    def text(name: str) -> Column:
        return F.coalesce(_field(name, "string"), F.lit("")).alias(name)

    def flag(name: str) -> Column:
        return F.coalesce(_field(name, "boolean"), F.lit(False)).alias(name)

    def seconds(name: str) -> Column:
        return (F.coalesce(_field(name, "double"), zero).cast("long") / 1000.0).alias(name)

    rows = docs.select(
        F.timestamp_seconds(_field("timestamp", "double").cast("long")).alias("ts"),
        text("method"),
        text("version"),
        text("platform"),
        flag("success"),
        seconds("total_time"),
        seconds("download_time"),
        F.coalesce(_field("download_size", "double"), zero).cast("long").alias("download_size"),
        flag("download_success"),
        flag("cache_hit"),
        text("error_type"),
    )
    return rows.orderBy("ts") if ordered else rows


def read_cache_index(spark: SparkSession, path: str, pattern: str = "*", lines: bool = False) -> DataFrame:
    """Cache entries with size and times; `problem` says why an entry is not valid.

    With `lines`, size is the length of the entry in bytes, `modified` still the time of its file.
    """
    docs = _documents(spark, path, pattern, lines)

    def meta(name: str) -> Column:
        return F.try_variant_get("doc", f"$.metadata.{name}", "string")

    stored, expires = meta("timestamp").try_cast("timestamp"), meta("expires").try_cast("timestamp")
    problem = (
        F.when(~_is_object(), "invalid JSON structure")
        .when(F.coalesce(meta("key"), F.lit("")) == "", "missing cache key")
        .when(stored.isNull(), "missing timestamp")
    )
    return docs.select(
        "file_path",
        (F.octet_length("value").cast("long") if lines else F.col("file_size")).alias("size"),
        F.col("file_modification_time").alias("modified"),
        meta("key").alias("entry_key"),
        stored.alias("created_at"),
        expires.alias("expires"),
        meta("source").alias("source"),
        meta("etag").alias("etag"),
        meta("last_modified").alias("last_modified"),
        problem.isNull().alias("is_valid"),
        problem.alias("problem"),
    )


def append_metrics(metrics: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a Parquet table partitioned by day, so that ranges of days prune."""
    metrics.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)
