"""Streaming queries: each runs its stream over the given table to the end and returns what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.adapters import define, relation, table
from supplyscope.functions.moments import at
from supplyscope.plans.shared import shared_folder
from supplyscope.registry.base import Book
from supplyscope.registry.telemetry import STATE
from supplyscope.streaming import jobs

book = Book()
QUERIES, ORACLE = book.queries, book.oracle

define(
    "bus_event",
    """select event_id, event_type as type, concat('s', cast(user_id % 7 as varchar(9))) as source, case when user_id % 5 = 0 then '' else concat('c', cast(user_id % 3 as varchar(9))) end as component, ts from events""",
)
define(
    "subscription",
    """select s_suppkey as id, case when s_suppkey % 4 = 0 then '' when s_suppkey % 4 = 1 then 'click,view' else 'error' end as types_text,
    case when s_suppkey % 3 = 0 then '' else concat('s', cast(s_suppkey % 9 as varchar(9))) end as sources_text,
    case when s_suppkey % 5 < 2 then '' else concat('c', cast(s_suppkey % 4 as varchar(9)), ',c0') end as components_text, s_suppkey % 6 <> 0 as active
    from supplier""",
)


def _events(spark, sf) -> DataFrame:
    return jobs.open_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


def _as_op_event(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", F.col("event_type").alias("op"), F.col("user_id").alias("source"), "ts", F.col("value").alias("duration"),
        (F.col("event_type") != "error").alias("success"),
    )


def _finish(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what is there now, into Parquet, and read the result."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
    sink.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _finish_by_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run `work` on the micro-batches of what is there now, each into a folder of its own that a second try overwrites, and read the result."""
    spark = stream.sparkSession
    base, schema = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", work(spark.createDataFrame([], stream.schema)).schema

    def write(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    write(spark.createDataFrame([], stream.schema), -1)  # the result of a stream without rows
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)


def _subscriptions(spark, sf) -> DataFrame:
    df = relation(spark, sf, "subscription")
    for name in ("types", "sources", "components"):
        df = df.withColumn(name, F.filter(F.split(f"{name}_text", ","), lambda x: x != ""))
    return df


ROUTES = """select event_id, id as subscriber from bus_event join subscription on active
    and (types_text = '' or list_contains(string_split(types_text, ','), type)) and (sources_text = '' or sources_text = source)
    and (components_text = '' or (component <> '' and list_contains(string_split(components_text, ','), component)))"""


@book.query("g1_route_events", ("bus_event", "subscription"), ROUTES)
def g1(spark, sf):
    routed = jobs.route_events(relation(spark, sf, "bus_event"), _subscriptions(spark, sf))
    return routed.select("event_id", "subscriber")


@book.query("g1_route_events_stream", ("bus_event", "subscription"), ROUTES)
def g1_stream(spark, sf):
    named = _events(spark, sf).select(
        "event_id",
        F.col("event_type").alias("type"),
        F.concat(F.lit("s"), F.col("user_id") % 7).alias("source"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.col("user_id") % 3)).alias("component"),
    )
    subscribers = _subscriptions(spark, sf)
    return _finish_by_batch(named, lambda rows: jobs.route_events(rows, subscribers).select("event_id", "subscriber"))


ALERTS = "select event_id, duration from op_event where duration > 90"


@book.query("g2_threshold_alerts", ("op_event",), ALERTS)
def g2(spark, sf):
    return jobs.threshold_alerts(relation(spark, sf, "op_event"), 90, "duration").select("event_id", "duration")


@book.query("g2_threshold_alerts_stream", ("op_event",), ALERTS)
def g2_stream(spark, sf):
    return _finish(jobs.threshold_alerts(_as_op_event(_events(spark, sf)), 90, "duration").select("event_id", "duration"))


WINDOWS = """select strftime(time_bucket(interval '1' hour, ts), '%Y-%m-%d %H:%M:%S') as window_start, op, count(*) as n, count(*) filter (where not success) as failed,
    round(sum(duration), 4) as total_time, round(avg(duration), 6) as avg_time, max(duration) as max_time from op_event {where} group by all"""
# a window is final on a stream once the watermark, the latest event less two hours, has passed its end
CLOSED = "where time_bucket(interval '1' hour, ts) + interval '1' hour <= (select max(ts) from op_event) - interval '2' hour"


def _shown(df: DataFrame) -> DataFrame:
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return df.withColumns({"window_start": start, "total_time": F.round("total_time", 4), "avg_time": F.round("avg_time", 6)})


@book.query("g3_windowed_operation_metrics", ("op_event",), WINDOWS.format(where=""))
def g3(spark, sf):
    return _shown(jobs.windowed_operation_metrics(relation(spark, sf, "op_event"), "1 hour"))


@book.query("g3_windowed_metrics_stream", ("op_event",), WINDOWS.format(where=CLOSED))
def g3_stream(spark, sf):
    events = jobs.event_time(_as_op_event(_events(spark, sf)))
    return _shown(_finish(jobs.windowed_operation_metrics(events, "1 hour", "2 hours")))


def _arrivals(spark, sf) -> str:
    """Checks as files, in the order in which they come: a quarter of the time each, with some checks a quarter late."""
    path = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    checks = relation(spark, sf, "mirror_check")
    first, last = checks.agg(F.min("ts"), F.max("ts")).first()
    quarter = (last - first) / 4
    late = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    turn = sum((F.when(F.col("ts") >= at(checks, "ts", first + quarter * k), 1).otherwise(0) for k in (1, 2, 3)), late)
    placed = checks.withColumn("turn", F.coalesce(turn, F.lit(0)))
    for k in range(5):
        placed.where(F.col("turn") == k).drop("turn").coalesce(1).write.mode("append").parquet(path)
    return path


def _fold(spark, path: str, schema, fold: jobs.MirrorFold, base: str) -> int:
    """Run the stream of files, one a batch, and return its last batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    writer = source.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress["batchId"]


def _folded(spark, sf) -> tuple[jobs.MirrorFold, int]:
    base = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    fold = jobs.MirrorFold(f"{base}/state", timedelta(days=10), compact_every=2)
    schema = relation(spark, sf, "mirror_check").schema
    return fold, _fold(spark, _arrivals(spark, sf), schema, fold, base)


@book.query("g4_stream_mirror_state", ("mirror_check",), f"with {STATE} select * from st")
def g4(spark, sf):
    fold, last = _folded(spark, sf)
    return fold.latest(spark, last)


IDLE = """with s as (select source, ts, coalesce(ts - lag(ts) over (partition by source order by ts) >= interval '1' day, true)::int as fresh from op_event),
    g as (select *, sum(fresh) over (partition by source order by ts rows unbounded preceding) as no from s),
    r as (select source, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_events from g group by source, no)
    select source, strftime(first_ts, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(last_ts, '%Y-%m-%d %H:%M:%S') as last_seen, n_events from r {where}"""


def _seen(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@book.query("g5_idle_keys", ("op_event",), IDLE.format(where=""))
def g5(spark, sf):
    return _seen(jobs.idle_sessions(relation(spark, sf, "op_event"), timedelta(days=1)))


@book.query(
    "g5_idle_keys_stream",
    ("op_event",),
    IDLE.format(where="where last_ts + interval '1' day <= (select max(ts) from op_event) - interval '1' hour"),
)
def g5_stream(spark, sf):
    events = jobs.event_time(_as_op_event(_events(spark, sf)))
    return _seen(_finish(jobs.idle_keys(events, "1 day", watermark="1 hour")))


@book.query(
    "g5_idle_at",
    ("op_event",),
    "select source, max(ts) as last_seen from op_event group by source having max(ts) < timestamp '2024-01-30 00:00:00' - interval '12' hour",
)
def g5_at(spark, sf):
    return jobs.idle_at(relation(spark, sf, "op_event"), datetime(2024, 1, 30), timedelta(hours=12))
