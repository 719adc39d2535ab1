"""Queries over files that Spark first writes from the given tables, then reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.adapters import relation, table
from supplyscope.operators.corpus import parse_lockfiles
from supplyscope.plans.shared import shared_folder
from supplyscope.registry.base import Book
from supplyscope.sources import metric_files, text_trees

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _epoch(ts: str = "ts"):
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _metric_texts(spark, sf):
    """Every event as a JSON document; each fifth one is broken off."""
    good = F.to_json(
        F.struct(
            _epoch().alias("timestamp"), F.col("op").alias("method"), F.concat(F.lit("5."), F.col("source") % 9).alias("version"),
            F.col("success"), F.col("event_id").alias("total_time"), F.lit(True).alias("download_success"),
        )
    )
    broken = F.concat(F.lit('{"broken ": '), F.col("event_id"))
    return relation(spark, sf, "op_event").select(F.when(F.col("event_id") % 5 == 3, broken).otherwise(good).alias("text"))


@book.query(
    "h1_read_metric_files",
    ("op_event",),
    """select strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, op as method, event_id / 1000 as total_time, success, true as download_success, concat('5.', source % 9) as version,
    '' as platform, '' as error_type from op_event where event_id % 5 <> 3""",
)
def h1(spark, sf):
    path = _folder(spark)
    _metric_texts(spark, sf).write.text(path)
    read = metric_files.read_metric_files(spark, path, "part-*", ordered=False, lines=True)
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return read.select(shown, "method", "total_time", "success", "download_success", "version", "platform", "error_type")


@book.query("h1_bad_metric_records", ("op_event",), """select concat('{"broken ": ', event_id) as record from op_event where event_id % 5 = 3""")
def h1_bad(spark, sf):
    path = _folder(spark)
    _metric_texts(spark, sf).write.text(path)
    return metric_files.bad_metric_records(spark, path, "part-*", lines=True).select("record")


@book.query("h2_read_source_tree", sql="select text, concat(lang, '/', source) as place from documents")
def h2(spark, sf):
    path = _folder(spark)
    table(spark, sf, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").option("lineSep", "\u0001").text(path)
    parts = text_trees.read_source_tree(spark, path, ["txt"], text_end="\u0001")
    place = F.concat_ws("/", F.regexp_extract("path", "lang=([^/]*)/", 1), F.regexp_extract("path", "source=([^/]*)/", 1))
    return parts.select("text", place.alias("place"))


@book.query(
    "h3_read_cache_index",
    ("op_event",),
    """with d as (select *, event_id % 5 as kind from op_event)
    select case when kind in (1, 2) then null else concat(op, event_id) end as entry_key, kind not in (1, 2, 3) as is_valid,
    case kind when 1 then 'invalid JSON structure' when 2 then 'missing cache key' when 3 then 'missing timestamp' end as problem,
    case when kind in (1, 3) then null else strftime(ts, '%Y-%m-%d %H:%M:%S') end as created_at from d""",
)
def h3(spark, sf):
    kind = F.col("event_id") % 5
    key = F.when(kind != 2, F.concat("op", "event_id"))
    stamp = F.when(kind != 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    meta = F.struct(key.alias("key"), stamp.alias("timestamp"), F.lit("2024-02-02T03:04:05Z").alias("expires"))
    text = F.when(kind == 1, F.lit("{{")).otherwise(F.to_json(F.struct(meta.alias("metadata"), F.lit(1).alias("data"))))
    path = _folder(spark)
    relation(spark, sf, "op_event").select(text.alias("text")).write.text(path)
    read = metric_files.read_cache_index(spark, path, "part-*", lines=True)
    return read.select("entry_key", "is_valid", "problem", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@book.query(
    "h4_append_metrics",
    ("op_event",),
    "select strftime(ts, '%Y-%m-%d') as day, count(*) * 2 as n, round(sum(duration) * 2, 2) as total from op_event group by 1",
)
def h4(spark, sf):
    path = _folder(spark)
    events = relation(spark, sf, "op_event")
    metric_files.append_metrics(events, path)
    metric_files.append_metrics(events, path)
    daily = spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"))
    return daily.agg(F.count("*").alias("n"), F.round(F.sum("duration"), 2).alias("total"))


@book.query(
    "h4_lock_text_round_trip",
    sql="""with r as (select *, unnest([
      {'d': concat(source, '-1.', doc_id % 9), 'p': concat('A/B/', lang, '.tar.gz'), 's': 'provides', 'm': concat(source, '::P'), 'v': concat(doc_id % 5)},
      {'d': concat(source, '-1.', doc_id % 9), 'p': concat('A/B/', lang, '.tar.gz'), 's': 'provides', 'm': concat(source, '::Q'), 'v': 'undef'},
      {'d': concat(source, '-1.', doc_id % 9), 'p': concat('A/B/', lang, '.tar.gz'), 's': 'requirements', 'm': concat(lang, '::R'), 'v': '0'},
      {'d': concat('Empty-', lang), 'p': 'none.tgz', 's': null, 'm': null, 'v': null}]) as x from documents),
    g as (select distinct lang as project, x.d as dist, x.s as section, x.m as module from r)
    select project, count(*) as n_rows, count(distinct dist) as n_dists, count(module) as n_modules from g group by project""",
)
def h4_lock(spark, sf):
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("project"))
    parsed = parse_lockfiles(relation(spark, sf, "lock_source")).join(langs, "file_id")
    columns = ["project", "dist", "section", "module"]
    merged = parsed.groupBy(*columns).agg(*[F.max(c).alias(c) for c in ("interpreter", "pathname", "version")])
    path = _folder(spark)
    text_trees.write_lock_text(text_trees.lock_lines(merged, "2024-01-01 00:00:00"), path)
    again = parse_lockfiles(text_trees.read_lock_text(spark, path), key="project")
    return again.groupBy("project").agg(
        F.count("*").alias("n_rows"), F.count_distinct("dist").alias("n_dists"), F.count("module").alias("n_modules")
    )
